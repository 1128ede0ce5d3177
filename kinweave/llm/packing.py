"""Vector bin packing of examples into training sequences.

A sequence has simultaneous limits on tokens, on segments and on loss-bearing tokens. Each task packs the documents that it
reads: a document's full sequences leave at once, the rests wait in a window and are placed by the dot-product heuristic
(Panigrahy, Talwar, Uyeda and Wieder, "Heuristics for vector bin packing", 2011): of the rests that fit, the one whose
demands have the greatest dot product with the sequence's free room, both in shares of the limits. Prompts of instruction
data bear no loss, so that answers and prompts fill two limits unlike each other. Where none fits, one is cut. A sequence is full or has a power of two of tokens, so that nothing is padded; the fewer than a sequence's tokens
that a task has left at its end go into powers of two. There is no shuffle, and a task holds one window of rests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash
from .tokens import WordTokenizer

VOCABULARY = "word_bpe_49k.json"
END = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    window: int = 1024  # rests that wait for a place


@dataclass
class Rest:
    key: int
    ids: bytes
    start: int
    length: int
    prompt: int = 0  # ids at the begin that bear no loss

    @property
    def loss(self) -> int:
        return loss_tokens(self, self.length)


def loss_tokens(rest: Rest, length: int) -> int:
    """Of the next `length` tokens of a document, all bear loss but those of its prompt and its closing id."""
    end, total = rest.start + length, len(rest.ids) // 4
    return max(0, end - (end == total) - max(rest.start, rest.prompt))


Piece = tuple[int, int, bytes, int, int, int]  # key, start, ids, tokens of the document, sequence, offset


class Packer:
    def __init__(self, limits: Limits = Limits()) -> None:
        if min(limits.tokens, limits.segments, limits.loss) < 1 or limits.tokens & (limits.tokens - 1):
            raise ValueError("limits are 1 at least, and that on tokens is a power of two")
        self.limits, self.sequences, self.waiting = limits, 0, []

    def add(self, key: int, ids: bytes, prompt: int = 0) -> Iterator[Piece]:
        rest, most = Rest(key, ids, 0, len(ids) // 4, prompt), min(self.limits.tokens, 1 << (self.limits.loss.bit_length() - 1))
        while rest.length >= most:
            yield from self._emit([(rest, most)])
        if rest.length:
            self.waiting.append(rest)
        if len(self.waiting) >= self.limits.window:
            yield from self.pack(False)

    def pack(self, final: bool) -> Iterator[Piece]:
        """Places what waits; unless final, fewer tokens than a sequence's stay."""
        limits, rests = self.limits, self.waiting
        length = np.array([r.length for r in rests], np.int64)
        loss = np.array([r.loss for r in rests], np.int64)
        while (total := int(length.sum())) >= (1 if final else limits.tokens):
            size = min(limits.tokens, 1 << (total.bit_length() - 1))
            room, segments, loss_room, chosen, free = size, limits.segments, limits.loss, [], length > 0
            while room and segments:
                demand = (length / limits.tokens) * (room / limits.tokens) + segments / limits.segments**2 + (loss / limits.loss) * (loss_room / limits.loss)
                fits = free & (length <= room) & (loss <= loss_room)
                if fits.any():
                    i = int(np.argmax(np.where(fits, demand, -1.0)))
                    take = int(length[i])
                else:
                    i = int(np.argmax(np.where(free, demand, -1.0)))
                    take = min(int(length[i]), room, loss_room)
                    if not free[i] or take < 1:
                        break
                chosen.append((i, take))
                free[i] = False
                room, segments, loss_room = room - take, segments - 1, loss_room - loss_tokens(rests[i], take)
            filled = size - room
            over = filled - (1 << (filled.bit_length() - 1))
            while over:  # back to a power of two
                i, take = chosen.pop()
                if take > over:
                    chosen.append((i, take - over))
                over -= min(over, take)
            yield from self._emit([(rests[i], take) for i, take in chosen])
            for i, _ in chosen:
                length[i], loss[i] = rests[i].length, rests[i].loss if rests[i].length else 0
        self.waiting = [r for r in rests if r.length]

    def _emit(self, chosen: list[tuple[Rest, int]]) -> Iterator[Piece]:
        offset = 0
        for rest, take in chosen:
            yield rest.key, rest.start, rest.ids[4 * rest.start : 4 * (rest.start + take)], len(rest.ids) // 4, self.sequences, offset
            rest.start, rest.length, offset = rest.start + take, rest.length - take, offset + take
        self.sequences += 1


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: Callable[[], str] = vocabulary_path, id_col: str = "doc_id", text_col: str = "text", end: int = END, prompt_col: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its prompt, if prompt_col names one (instruction data), which bear no loss, and of its text,
    nulls as empty, then `end`; an empty text is the closing id alone. Each id of
    each row of docs, repeated rows included, lies in exactly one piece; a null id stays null. An empty table gives an
    empty result. Other columns aren't read. path() gives the vocabulary's file where the tasks run. sequence_id holds the
    task's partition in its upper bits, so that a task that runs again gives the same.
    """
    field = docs.select(id_col).schema[0]
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        file = path()
        release("tokenizer")
        tokenizer = stash(f"tokenizer {file}", lambda: WordTokenizer(file))
        packer, keys, kind, rows = Packer(limits), {}, None, []
        held = 0

        def table() -> pa.RecordBatch:
            key, start, ids, tokens, sequence, offset = zip(*rows, strict=True) if rows else [()] * 6
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in key], kind), long(start), long([len(x) // 4 for x in ids]), pa.array(ids, pa.binary()), long(tokens), long([first + s for s in sequence]), long(offset)],
                names=[field.name, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        count = 0
        for batch in batches:
            kind = batch.column(0).type
            waiting = {r.key for r in packer.waiting}
            keys = {k: v for k, v in keys.items() if k in waiting}
            for i in range(batch.num_rows):
                keys[count] = batch.column(0)[i].as_py()
                prompt = tokenizer.encode(batch.column(2)[i].as_py() or "") if prompt_col else b""
                for piece in packer.add(count, prompt + tokenizer.encode(batch.column(1)[i].as_py() or "") + closing, len(prompt) // 4):
                    rows.append(piece)
                    held += len(piece[2])
                if held > 4 << 20:
                    yield table()
                    rows, held = [], 0
                count += 1
            if rows:
                yield table()
                rows, held = [], 0
        if count:
            rows = list(packer.pack(True))
            if rows:
                yield table()
        release("tokenizer")

    schema = f"`{field.name}` {field.dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col), F.col(text_col), *([F.col(prompt_col)] if prompt_col else [])).mapInArrow(run, schema)


def op7_vector_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
