"""Chroma fingerprints of a media column, and the alignment of recordings by them.

A recording is raw samples in a stated format. Its spectrum, in long frames that overlap by seven eighths, is folded into
twelve pitch classes a frame; sixteen rectangle filters over the integral image of these frames give two bits each,
Gray-coded, hence an unsigned 32-bit code per frame. Equal code sequences are one class.

Alignment: the upper bits of the codes at four places are a key of the first place, made from the recording and, so that cuts
between frames meet too, from the recording half a hop later; of these the keys with a hash divisible by three count, in all
recordings alike. Classes that share two keys (one, if either is short) are a candidate pair, however many share them. A bucket of up to
FEW gives rows of pairs; a larger one is dealt into blocks of about BLOCK, and each two blocks meet in a cell, which compares
their members in place and gives a row per member, not per pair. The comparisons grow with the square of a bucket; the rows
don't. Each pair is aligned by the histogram of offsets over all places of equal codes; under the histogram's peaks, the
stretch whose bits differ least decides. Pairs hold ids alone; codes travel once the pairs are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import stored
from .common import cut, drop_shuffles, join_by_key, release
from .graph import components

#: Samples a second, of a frame and between frames of the default format; frames under a filter.
RATE, FRAME, HOP, SPAN = 8000, 1024, 128, 8
#: Members up to whose number a bucket gives rows of pairs. Beyond: members of a block, the most blocks of a bucket (then they grow), bytes of cells in a task.
FEW, BLOCK, BLOCKS_OF, CELL_BYTES = 16, 256, 64, 16 << 20
#: Places of a key and codes between them; one in KEPT keys counts.
PLACES, GAP, KEPT = 4, 3, np.uint64(3)
#: Classes with fewer codes need one common key, others two.
SHORT = 24
#: Ids up to whose number they are broadcast.
BROADCAST = 200_000
#: A filter response is the log ratio of two areas; these cut it into four levels. No level ends near a ratio of one, the response to silence.
LEVELS = (-0.5, -0.15, 0.3)
#: Added to the mean of both areas, as a share of a frame's energy in one pitch class.
FLOOR = 0.02
RATIOS = tuple(float(np.exp(x)) for x in LEVELS)
CLASSES = 12
#: The upper bit of each filter.
UPPER = np.uint32(0xAAAAAAAA)
#: Peaks of the histogram that are tried; the largest share of differing bits; codes that an alignment has at least, of different ones among them.
PEAKS, MOST_ERROR, LEAST, LEAST_DIFFERENT = 4, 0.105, 10, 4
#: MOST_ERROR less a share of differing bits, over a code: (GAIN - LOSS * bits) / UNIT, in whole numbers.
GAIN, LOSS, UNIT = 84, 25, 800
#: Pairs of equal codes of two recordings that are listed; commoner codes are counted by a transform instead.
LISTED = 1 << 18


@dataclass(frozen=True)
class Format:
    """Samples are `width` bytes, unsigned at one byte, else signed little-endian; channels are interleaved. low: the least pitch in Hz."""

    rate: int = RATE
    frame: int = FRAME
    hop: int = HOP
    width: int = 1
    channels: int = 1
    low: float = 120.0

    def __post_init__(self) -> None:
        if self.width not in (1, 2, 4) or min(self.rate, self.hop, self.channels) < 1 or self.frame < 2 * self.hop:
            raise ValueError("a format has 1, 2 or 4 bytes a sample, and frames that overlap")

    def samples(self, data: bytes) -> np.ndarray:
        """Samples around zero, channels averaged; an incomplete last one is left out."""
        step = self.width * self.channels
        data = memoryview(data)[: len(data) // step * step]
        found = np.frombuffer(data, np.uint8).astype(np.float32) - 128 if self.width == 1 else np.frombuffer(data, f"<i{self.width}").astype(np.float32) / 256 ** (self.width - 1)
        return found if self.channels == 1 else found.reshape(-1, self.channels).mean(axis=1)


@lru_cache(8)
def pitch_map(form: Format) -> np.ndarray:
    """Spectrum bins x pitch classes: a bin's energy goes to the two classes next to its pitch, by nearness."""
    out = np.zeros((form.frame // 2 + 1, CLASSES), np.float32)
    for k in range(1, form.frame // 2):
        hertz = k * form.rate / form.frame
        if hertz >= form.low:
            pitch = 12 * np.log2(hertz / 440)
            below = int(np.floor(pitch))
            out[k, below % CLASSES] += below + 1 - pitch
            out[k, (below + 1) % CLASSES] += pitch - below
    return out


def filters() -> list[tuple[int, int, int]]:
    """(kind, first pitch class, height) of the sixteen filters: the four kinds at four places, with growing heights.

    Kinds: upper against lower half, earlier against later half, opposite quarters, middle against edge in time.
    """
    found = []
    for i in range(16):
        first, height = (3 * (i // 4) + i) % (CLASSES - 3), 4 + 2 * (i // 4 % 3)
        found.append((i % 4, first, height if first + height <= CLASSES else 4 if first + 4 <= CLASSES else CLASSES - first))
    return found


FILTERS = filters()


def chroma(samples: np.ndarray, form: Format = Format(), begins: np.ndarray | None = None) -> np.ndarray:
    """Frames x pitch classes, each frame of unit sum (of zeros, if silent); short recordings are lengthened by silence to the span of one code. With begins, of the frames that begin there."""
    least = form.frame + (SPAN - 1) * form.hop
    if len(samples) < least:
        samples = np.concatenate([samples, np.zeros(least - len(samples), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, form.frame)
    if begins is None:
        begins = np.arange(0, len(frames), form.hop)
    window, pitches, parts = np.hanning(form.frame).astype(np.float32), pitch_map(form).astype(np.float64), []
    for i in range(0, len(begins), 1024):
        spectrum = np.fft.rfft(frames[begins[i : i + 1024]] * window, axis=1)
        # In doubles: what a product differs by at another row of the matrix is far below a code's steps.
        parts.append((spectrum.real**2 + spectrum.imag**2).astype(np.float64) @ pitches)
    energy = np.concatenate(parts)
    return energy / (energy.sum(axis=1, keepdims=True) + 1e-6)


#: Bytes of recordings whose frames are held at once.
HELD = 1 << 18


def codes(data: bytes, form: Format = Format()) -> np.ndarray:
    """Unsigned 32-bit code of each place where all SPAN frames of a filter lie within the recording; none without a sample."""
    return codes_of([data], form)[0]


def codes_of(recordings: list[bytes], form: Format = Format()) -> list[np.ndarray]:
    """codes() of each recording, a few hundred short ones at once. A place's code depends on its samples alone, not on what lies beside or before it."""
    out: list[np.ndarray] = []
    turn: list[np.ndarray] = []
    size = 0
    for data in recordings:
        turn.append(form.samples(data))
        size += len(turn[-1])
        if size >= HELD:
            out += _codes_turn(turn, form)
            turn, size = [], 0
    return out + _codes_turn(turn, form) if turn else out


def _codes_turn(samples: list[np.ndarray], form: Format) -> list[np.ndarray]:
    least = form.frame + (SPAN - 1) * form.hop
    lengths = np.array([max(least, len(x)) if len(x) else 0 for x in samples])
    line = np.zeros(int(lengths.sum()), np.float32)
    begins = np.cumsum(lengths) - lengths
    for x, at in zip(samples, begins.tolist(), strict=True):
        line[at : at + len(x)] = x
    frames = np.where(lengths > 0, (lengths - form.frame) // form.hop + 1, 0)
    if not frames.sum():
        return [np.zeros(0, np.uint32) for _ in samples]
    first, owner, step = _ranges(frames)
    image = chroma(line, form, begins[owner] + step * form.hop)
    # Sums of 1, 2, 4 and 8 frames by halves, so that equal frames have equal sums wherever they lie; what reaches over a recording's end is left out at last.
    half, quarter = SPAN // 2, SPAN // 4
    sums = {1: np.concatenate([np.zeros((1, len(image))), image.T.astype(np.float64).cumsum(axis=0)])}
    for n in (1, 2, 4):
        sums[2 * n] = sums[n][:, :-n] + sums[n][:, n:]
    n = len(image) - SPAN + 1
    whole, early, late, middle = sums[SPAN], sums[half][:, :n], sums[half][:, half : half + n], sums[half][:, quarter : quarter + n]
    out = np.zeros(n, np.uint32)
    for i, (kind, y, height) in enumerate(FILTERS):
        centre, top = y + height // 2, y + height
        if kind == 0:
            a = whole[centre] - whole[y]
        elif kind == 1:
            a = early[top] - early[y]
        elif kind == 2:
            a = early[centre] - early[y] + (late[top] - late[centre])
        else:
            a = middle[top] - middle[y]
        b = np.maximum(whole[top] - whole[y] - a, 0) + FLOOR * height
        a += FLOOR * height
        one, two, three = (a >= ratio * b for ratio in RATIOS)
        # Gray codes 0, 1, 3, 2 of the levels: the upper bit from the second on, the lower between the first and the third.
        out |= (two.view(np.uint8) * np.uint8(2) + (one & ~three)).astype(np.uint32) << np.uint32(2 * i)
    return [out[at : at + k - SPAN + 1] if k else np.zeros(0, np.uint32) for at, k in zip(first.tolist(), frames.tolist(), strict=True)]


def hashed(code: np.ndarray) -> np.ndarray:
    """64-bit hash of the upper bits of the codes at PLACES places, GAP apart, from each place on; what lies beyond the end counts as a mark of its own."""
    out = np.full(len(code), 0x9E3779B97F4A7C15 + PLACES, np.uint64)
    masked = np.concatenate([code & UPPER, np.zeros(PLACES * GAP, np.uint32)]).astype(np.uint64) + np.uint64(1)
    masked[len(code) :] = 0
    for k in range(PLACES):
        out = (out ^ masked[k * GAP : k * GAP + len(code)]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def keys(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, first keys): the places that count, with the hash of the upper bits of PLACES codes from there on.

    Recordings too short for that have one place, with a key of all their upper bits and their length.
    """
    reach = (PLACES - 1) * GAP
    if len(code) <= reach:
        return np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest((code & UPPER).astype("<u4").tobytes(), len(code))], np.uint64)
    found = hashed(code)[: len(code) - reach]
    place = np.flatnonzero(found % KEPT == 0)
    return place, found[place]


def all_keys(data: bytes, code: np.ndarray, form: Format) -> np.ndarray:
    """Signed first keys of a recording whose codes these are, those of the recording half a hop later included."""
    return keys_of([data], [code], form)[0]


def keys_of(recordings: list[bytes], code: list[np.ndarray], form: Format) -> list[np.ndarray]:
    """all_keys() of each recording."""
    reach, skip = (PLACES - 1) * GAP, form.hop // 2 * form.width * form.channels
    long = [i for i, c in enumerate(code) if len(c) > reach]
    later = codes_of([memoryview(recordings[i])[skip:] for i in long], form)
    out = [np.zeros(0, np.uint64)] * len(code)
    for i in set(range(len(code))).difference(long):
        if len(code[i]):
            out[i] = keys(code[i])[1]
    if long:
        # One line of all codes: a hash whose places reach over the end of its own is left out.
        parts, owner = [code[i] for i in long] + later, np.array(long + long)
        lengths = np.array([len(c) for c in parts])
        _, part, step = _ranges(lengths)
        found = hashed(np.concatenate(parts))
        use = np.flatnonzero((found % KEPT == 0) & (step < lengths[part] - reach))
        whose, found = owner[part[use]], found[use]
        order = np.lexsort((found, whose))
        whose, found = whose[order], found[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
        whose, found = whose[new], found[new]
        ends = np.searchsorted(whose, np.arange(len(code) + 1))
        for i in long:
            out[i] = found[ends[i] : ends[i + 1]]
        for i, c in zip(long, later, strict=True):
            if 0 < len(c) <= reach:  # half a hop less can be a place less
                out[i] = np.unique(np.concatenate([out[i], keys(c)[1]]))
    return [x.view(np.int64) for x in out]


def offsets_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Histogram over all pairs of equal codes: element len(b) - 1 + offset counts those of b's place i and a's place i + offset."""
    order = np.argsort(b, kind="stable")
    line = b[order]
    low, high = np.searchsorted(line, a, "left"), np.searchsorted(line, a, "right")
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    counts = high - low
    if counts.sum() > LISTED:
        # The commonest codes, until what is left can be listed: correlations by Fourier transform, rounded, are exact counts.
        values, inverse = np.unique(a, return_inverse=True)
        product = np.bincount(inverse, weights=counts).astype(np.int64)
        size = 1 << (len(votes) - 1).bit_length()
        left = int(product.sum())
        for v in np.argsort(-product).tolist():
            if left <= LISTED:
                break
            x = np.fft.rfft((a == values[v]).astype(float), size) * np.fft.rfft((b[::-1] == values[v]).astype(float), size)
            votes += np.rint(np.fft.irfft(x, size)[: len(votes)]).astype(np.int64)
            counts[inverse == v] = 0
            left -= int(product[v])
    total = int(counts.sum())
    if total:
        at = np.repeat(np.arange(len(a)), counts)
        step = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        votes += np.bincount(at - order[np.repeat(low, counts) + step] + len(b) - 1, minlength=len(votes))
    return votes


def most_error(n: int) -> float:
    """Share of differing bits up to which a stretch of n codes counts; a short one must be the better. Best stretches of unrelated tones and texts lie above it (README)."""
    return MOST_ERROR - 0.45 / np.sqrt(n)


def stretch(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int, int, float] | None:
    """(score, begin in b, length, share of differing bits) of the stretch of the overlap with the greatest score, the sum of MOST_ERROR less the share over its places; None if that may be chance."""
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    errors = np.bitwise_count(x[:n] ^ y[:n]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(GAIN - LOSS * errors)])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.argmin(sums[: end + 1]))
    n = end - begin
    if n < LEAST:
        return None
    share = float(errors[begin:end].sum()) / (32 * n)
    if share > most_error(n) or len(np.unique(x[begin:end])) < LEAST_DIFFERENT:
        return None
    return float(sums[end] - sums[begin]) / UNIT, begin + max(0, -offset), n, share


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float, float] | None:
    """(offset, begin, overlap, bit error, score) of b against a: b's places from begin on lie at a's places offset further. None if none is beyond chance."""
    if not len(a) or not len(b):
        return None
    votes = offsets_of(a, b)
    both = votes[:-1] + votes[1:] if len(votes) > 1 else votes  # an offset between two frames votes for either
    best: tuple[float, int, int, int, float] | None = None
    tops = np.argsort(-both, kind="stable")[:PEAKS]
    tried = {int(t) + k - (len(b) - 1) for t in tops if both[t] for k in (0, 1) if t + k < len(votes) and votes[t + k]}
    for offset in sorted(tried, key=lambda o: (abs(o), o)):
        found = stretch(a, b, offset)
        if found and (best is None or found[0] > best[0]):
            best = (found[0], offset, *found[1:])
    return None if best is None else (best[1], best[2], best[3], best[4], best[0])


#: Codes of a stretch at least: a shorter one would have to differ by less than nothing.
REACH = int(np.ceil((0.45 / MOST_ERROR) ** 2))


def _ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, owners, steps) of ranges of these lengths that lie one after the other: whose range each place is in, and where there."""
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return begins, owner, np.arange(len(owner)) - begins[owner]


def align_many(a: np.ndarray, others: list[np.ndarray]) -> list[tuple[int, int, int, float, float] | None]:
    """align(a, b) of each b of others, a few hundred at once: the same numbers, without a Python step per pair."""
    out: list[tuple[int, int, int, float, float] | None] = [None] * len(others)
    if len(a) < REACH:
        return out
    order = np.argsort(a, kind="stable")
    index = (order, *np.unique(a[order], return_index=True, return_counts=True))
    turn: list[int] = []
    size = 0
    for i, b in enumerate(others):
        if len(b) >= REACH:
            turn.append(i)
            size += len(a) + len(b)
        if turn and (size >= LISTED or i == len(others) - 1):
            _align_turn(a, index, others, turn, out)
            turn, size = [], 0
    if turn:
        _align_turn(a, index, others, turn, out)
    return out


def _align_turn(a: np.ndarray, index: tuple, others: list[np.ndarray], turn: list[int], out: list) -> None:
    """Fills in those of out that turn names; index: the places of a by their codes, the codes, where each begins there, how often it is there."""
    order, values, starts, many = index
    lengths = np.array([len(others[i]) for i in turn])
    b = np.concatenate([others[i] for i in turn])
    code = np.minimum(np.searchsorted(values, b), len(values) - 1)
    counts = np.where(values[code] == b, many[code], 0)
    begins, owner, place = _ranges(lengths)
    listed = np.add.reduceat(counts, begins)
    if listed.sum() > 4 * LISTED and len(turn) > 1:  # halves, until what is listed is little
        for part in (turn[: len(turn) // 2], turn[len(turn) // 2 :]):
            _align_turn(a, index, others, part, out)
        return
    if listed.sum() > LISTED and len(turn) == 1:
        out[turn[0]] = align(a, others[turn[0]])
        return
    # Votes of all pairs, one histogram after the other.
    spans = len(a) + lengths - 1
    first = np.cumsum(spans) - spans
    met = np.repeat(starts[code] - (np.cumsum(counts) - counts), counts)
    met += np.arange(len(met))
    where = order[met] + np.repeat((first + lengths - 1)[owner] - place, counts)
    votes = np.bincount(where, minlength=int(spans.sum()))
    both = np.append(votes[:-1] + votes[1:], 0)
    both[first + spans - 1] = 0
    top = np.flatnonzero(both)
    pair = np.searchsorted(first, top, "right") - 1
    best = np.lexsort((top, -both[top], pair))
    top, pair = top[best], pair[best]
    top = top[np.arange(len(pair)) - np.searchsorted(pair, pair, "left") < PEAKS]
    tried = np.unique(np.concatenate([top, top + 1]))  # what lies beyond a pair's histogram has no vote of its own, as both has none at its end
    tried = tried[votes[tried] > 0]
    pair = np.searchsorted(first, tried, "right") - 1
    offset = tried - first[pair] - (lengths[pair] - 1)
    xs, ys = np.maximum(offset, 0), np.maximum(-offset, 0)
    n = np.minimum(len(a) - xs, lengths[pair] - ys)
    use = n >= REACH
    pair, offset, xs, ys, n = pair[use], offset[use], xs[use], ys[use], n[use]
    if not len(n):
        return
    # The best stretch under each offset: sums from a leading zero on; a falling base keeps the least of one pair from the next.
    begin, owner, step = _ranges(n + 1)
    inner = np.maximum(step - 1, 0)
    gain = GAIN - LOSS * np.bitwise_count(a[xs[owner] + inner] ^ b[begins[pair][owner] + ys[owner] + inner]).astype(np.int64)
    gain[begin] = 0
    sums = np.cumsum(gain)
    sums -= sums[begin][owner] + owner * np.int64(1 << 40)
    least = np.minimum.accumulate(sums)
    new = np.ones(len(sums), bool)
    new[1:] = sums[1:] < least[:-1]
    since = np.maximum.accumulate(np.where(new, np.arange(len(sums)), 0))
    rise = sums - least
    score = np.maximum.reduceat(rise, begin)
    ends = np.flatnonzero(rise == score[owner])
    end = ends[np.searchsorted(ends, begin)]
    start = since[end]
    n, start = end - start, start - begin
    share = (GAIN * n - score) // LOSS / np.maximum(32 * n, 1)
    good = np.flatnonzero((n >= max(REACH, LEAST)) & (share <= most_error(np.maximum(n, 1))))
    for i in good[np.lexsort((offset[good], np.abs(offset[good]), -score[good], pair[good]))].tolist():
        p = turn[pair[i]]
        if out[p] is None and len(np.unique(a[xs[i] + start[i] : xs[i] + start[i] + n[i]])) >= LEAST_DIFFERENT:
            out[p] = (int(offset[i]), int(start[i] + ys[i]), int(n[i]), float(share[i]), float(score[i]) / UNIT)


def _print(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("")
        for batch in batches:
            data = [batch.column(1)[i].as_py() or b"" for i in range(batch.num_rows)]
            found = codes_of(data, form)
            made = pa.array(keys_of(data, found, form), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in found], pa.int64()), pa.array([c.astype("<u4").tobytes() if len(c) else None for c in found], pa.binary()), made], names=["_id", "n_frames", "codes", "keys"])
        release("")

    return run


def _cell(key: int, members: list[dict]) -> Iterator[tuple[int, int, tuple]]:
    """(i, j, alignment) of the links between members j and i < j of a cell that are candidates and meet here: in the cell of the least large key that they share, and not within one of two blocks.

    members, by id: block, short, codes, small and large (the keys that they share with any others, in buckets up to FEW and larger).
    """
    block, short = np.array([m["block"] for m in members]), np.array([m["short"] for m in members])
    alike = np.zeros((len(members), len(members)), np.float32)
    before = np.zeros_like(alike, dtype=bool)
    for kind in ("small", "large"):
        lists = [np.array(m[kind], np.int64) for m in members]
        held, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        values, inverse, counts = np.unique(held, return_inverse=True, return_counts=True)
        common = np.flatnonzero(counts > 1)
        column = np.full(len(values), -1)
        column[common] = np.arange(len(common))
        has = np.zeros((len(members), len(common)), np.float32)
        use = column[inverse] >= 0
        has[owner[use], column[inverse][use]] = 1
        alike += has @ has.T
        if kind == "large":
            lesser = has[:, values[common] < key]
            before = lesser @ lesser.T > 0
    want = ~before & ((alike > 1) | short[:, None] | short[None, :])
    if len(np.unique(block)) > 1:
        want &= block[:, None] != block[None, :]
    code = [np.frombuffer(m["codes"], "<u4") for m in members]
    for i in range(len(members)):
        later = (np.flatnonzero(want[i, i + 1 :]) + i + 1).tolist()
        for j, found in zip(later, align_many(code[i], [code[j] for j in later]), strict=True):
            if found:
                yield i, j, found


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(key, members) of each cell that has pairs: of one block, or of two that both have members."""
    for batch in batches:
        for i in range(batch.num_rows):
            members = batch.column(3)[i].as_py()
            if batch.column(1)[i].as_py() == batch.column(2)[i].as_py() or len({m["block"] for m in members}) > 1:
                yield batch.column(0)[i].as_py(), members


def _cell_links(kind: pa.DataType):
    """The links of cells, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _cells(batches):
            rows = [(members[j]["rep"], members[i]["rep"], *found) for i, j, found in _cell(key, members)]
            if rows:
                kinds = (kind, kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["rep", "head", "offset", "begin", "overlap", "bit_error", "score"])

    return run


def _cell_sums(kind: pa.DataType):
    """Of the links of each cell a row per member that has any: their number, the best of them, and the least member reachable over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _cells(batches):
            root, number, best = list(range(len(members))), [0] * len(members), {}

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for i, j, (offset, _, overlap, error, score) in _cell(key, members):
                for own, other, way in ((j, i, offset), (i, j, -offset)):
                    number[own] += 1
                    best[own] = min(best.get(own, (0.0,)), (-score, other, way, overlap, error))
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
            if best:
                rows = [(members[i]["rep"], number[i], s, members[to]["rep"], *way, members[top(i)]["rep"]) for i, (s, to, *way) in best.items()]
                kinds = (kind, pa.int64(), pa.float64(), kind, pa.int64(), pa.int64(), pa.float64(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["class_id", "n", "s", "to", "offset", "overlap", "bit_error", "root"])

    return run


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            if batch.num_columns > 4 and not set(batch.column(4)[i].as_py() or ()).isdisjoint(batch.column(5)[i].as_py() or ()):
                continue  # a cell has this pair
            found = align(np.frombuffer(batch.column(3)[i].as_py(), "<u4"), np.frombuffer(batch.column(2)[i].as_py(), "<u4"))
            if found:
                rows.append((i, *found))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        at = pa.array(columns[0], pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=["rep", "head", "offset", "begin", "overlap", "bit_error", "score"])


def fingerprints(media: DataFrame, id_col: str, data_col: str, form: Format = Format()) -> DataFrame:
    """(_id, n_frames, codes: little-endian unsigned 32-bit, keys: array of long) of every row's whole recording; one that is null or has no sample has no frame, null codes and no key."""
    kind = media.select(id_col).schema[0].dataType.simpleString()
    return media.select(F.col(id_col).alias("_id"), F.col(data_col).cast("binary").alias("d")).mapInArrow(_print(form), f"_id {kind}, n_frames long, codes binary, keys array<long>")


def candidates(classes: DataFrame, code: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, cells) of classes (rep, n, keys), whose codes are in code (rep, codes), that share two keys, or one if either is short, and are as long as a stretch.

    pairs (rep, head, own, codes, ...) with head < rep share a bucket of a key with up to `few` classes; those that share a larger one
    too have a key in common in their last two columns, and count in cells alone. cells (key, i, j, members) are of larger buckets:
    each two blocks i <= j of a bucket; None without such buckets. No pair of a bucket is missed.
    """
    own = classes.where(F.col("n") >= REACH).select("rep", (F.col("n") < SHORT).alias("short"), F.explode("keys").alias("key"))
    members = cut(own.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))
    drop_shuffles(code.sparkSession)  # those of all keys are the heaviest, and nothing reads them any more
    lists = members.where(f"size <= {few}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "short"))).alias("all"))
    each = lists.select("all", F.posexplode("all").alias("place", "x")).where("place > 0").select("x", F.explode(F.slice("all", F.lit(1), F.col("place"))).alias("y"))
    votes = each.groupBy(F.col("x.rep").alias("rep"), F.col("y.rep").alias("head")).agg(F.count("*").alias("votes"), F.max(F.col("x.short") | F.col("y.short")).alias("short"))
    large = F.col("size") > few
    if not members.where(large).limit(1).count():
        pairs = cut(votes.where("votes > 1 or short").select("rep", "head"))
        wanted = _of(code, pairs.select("rep").unionByName(pairs.select(F.col("head").alias("rep"))).distinct())
        return pairs.join(wanted.select("rep", F.col("codes").alias("own")), "rep").join(wanted.select(F.col("rep").alias("head"), "codes"), "head").select("rep", "head", "own", "codes"), None
    sorted_keys = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("key"))))
    spread_over = F.collect_list(F.when(large, F.struct("key", F.least(F.ceil(F.col("size") / BLOCK), F.lit(BLOCKS_OF)).cast("int").alias("blocks"))))
    crowded = members.groupBy("rep").agg(F.max("short").alias("short"), sorted_keys(~large).alias("small"), sorted_keys(large).alias("large"), spread_over.alias("cells"))
    crowded = cut(crowded.where(F.size("large") > 0))
    # A pair with one common small key may have a large one besides: then a cell has it.
    pairs = cut(votes.where("votes > 1 or short").select("rep", "head"))
    wanted = pairs.select("rep").unionByName(pairs.select(F.col("head").alias("rep"))).unionByName(crowded.select("rep")).distinct()
    wanted = _of(code, wanted)
    drop_shuffles(code.sparkSession)
    known = wanted.join(crowded.select("rep", "large"), "rep", "left")
    both = pairs.join(known.select("rep", F.col("codes").alias("own"), F.col("large").alias("own_large")), "rep").join(known.select(F.col("rep").alias("head"), "codes", "large"), "head")
    dealt = crowded.select("rep", "short", "small", "large", F.explode("cells").alias("x")).select("rep", "short", "small", "large", "x.*")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = wanted.join(dealt, "rep").select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rep", "block", "short", "codes", "small", "large")
    size = rows.agg(F.sum(F.octet_length("codes") + 8 * (F.size("small") + F.size("large")) + 40)).first()[0]
    parts = max(4 * code.sparkSession.sparkContext.defaultParallelism, int(size or 0) // CELL_BYTES + 1)
    met = rows.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").agg(F.sort_array(F.collect_list(F.struct("rep", "block", "short", "codes", "small", "large"))).alias("members"))
    return both.select("rep", "head", "own", "codes", "own_large", "large"), met.where(F.size("members") > 1)


def _of(code: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of code (rep, codes) with these ids, cut, one each."""
    ids = cut(ids)
    return cut(code.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "rep", "left_semi").dropDuplicates(["rep"]))


def _pair_links(pairs: DataFrame) -> DataFrame:
    kind = dict(pairs.dtypes)["rep"]
    return pairs.mapInArrow(_aligned, f"rep {kind}, head {kind}, offset long, begin long, overlap long, bit_error double, score double")


def alignments(classes: DataFrame, code: DataFrame) -> DataFrame:
    """Links (rep, head, offset, begin, overlap, bit_error, score) of classes (rep, n, keys) with lesser ones, each once: rep's places from `begin` on lie at head's places `offset` further. code (rep, codes) may hold others too."""
    pairs, cells = candidates(classes, code)
    found = _pair_links(pairs)
    return found if cells is None else found.unionByName(cells.mapInArrow(_cell_links(to_arrow_type(classes.schema["rep"].dataType)), found.schema))


def best_alignments(classes: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the links of alignments(): (class_id, n: their number, x: s, to, offset, overlap, bit_error of the best) per class that has any, and edges (a, b) with the same components. No row per link of a large bucket is made."""
    pairs, cells = candidates(classes, code)
    links = cut(_pair_links(pairs))
    drop_shuffles(code.sparkSession)
    kind = dict(links.dtypes)["rep"]
    way = lambda end, other, sign: links.select(F.col(end).alias("class_id"), F.lit(1).cast("long").alias("n"), F.struct((-F.col("score")).alias("s"), F.col(other).alias("to"), (sign * F.col("offset")).alias("offset"), "overlap", "bit_error").alias("x"))
    ways, edges = way("rep", "head", 1).unionByName(way("head", "rep", -1)), links.select(F.col("rep").alias("a"), F.col("head").alias("b"))
    if cells is not None:
        sums = cut(cells.mapInArrow(_cell_sums(to_arrow_type(classes.schema["rep"].dataType)), f"class_id {kind}, n long, s double, to {kind}, offset long, overlap long, bit_error double, root {kind}"))
        ways = ways.unionByName(sums.select("class_id", "n", F.struct("s", "to", "offset", "overlap", "bit_error").alias("x")))
        edges = edges.unionByName(sums.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    return ways.groupBy("class_id").agg(F.min("x").alias("x"), F.sum("n").alias("n")), edges


def align_recordings(media: DataFrame, id_col: str, data_col: str, form: Format = Format()) -> DataFrame:
    """One row per row: id, n_frames, fingerprint (sha256 of the codes), class_id (least id with these codes), n_links (other classes that its class was found to align with), the best of these alignments: aligned_to, offset, overlap, bit_error (nulls without one), and group_id (least class_id reachable over alignments, whatever links them).

    The row's recording lies at `offset` in that of aligned_to. Rows that are null or have no sample have no frame, and null
    fingerprint and class. Rows with a null id are kept and take no part in classes and alignments, nor do those of an id that has
    several recordings, but for one of them, by a hash. Repeated rows stay. An empty table gives an empty result. Ties of the score go to the least id. Other columns aren't read.
    """
    prints = stored(fingerprints(media, id_col, data_col, form).withColumn("fingerprint", F.unhex(F.sha2("codes", 256))))
    whole = prints.where("_id is not null and codes is not null")
    mark = F.xxhash64("fingerprint")
    several = whole.groupBy("_id").agg(F.min(mark).alias("first"), F.max(mark).alias("last")).where("first <> last")
    if several.limit(1).count():
        whole = whole.join(several, "_id", "left").where(F.col("first").isNull() | (F.col("first") == mark)).drop("first", "last")
    least = F.min("_id").alias("class_id")
    classes = cut(whole.groupBy("fingerprint").agg(least, F.count("*").alias("rows")))
    # A class's codes are those of a row with its id; keys, which are heavy, are read once and not cut.
    keyed = whole.groupBy("fingerprint").agg(least.alias("rep"), F.any_value(F.struct(F.col("n_frames").alias("n"), "keys")).alias("x")).select("rep", "x.*")
    best, edges = best_alignments(keyed, whole.select(F.col("_id").alias("rep"), "codes"))
    groups = components(edges).select(F.col("node").alias("class_id"), "root")
    named = classes.select("fingerprint", "class_id", "rows").join(best, "class_id", "left").join(groups, "class_id", "left")
    named = cut(named.select("fingerprint", "rows", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.col("x.to").alias("aligned_to"), "x.offset", "x.overlap", "x.bit_error", F.coalesce("root", "class_id").alias("group_id")))
    apart, code_of = F.col("_id").isNull(), F.col("fingerprint")
    known = prints.select(F.col("_id").alias(id_col), "n_frames", F.when(apart, code_of).alias("fingerprint"), F.when(~apart, code_of).alias("_class"))
    found = join_by_key(known, named.withColumnRenamed("fingerprint", "_class"), "_class", "rows")
    return found.withColumn("fingerprint", F.lower(F.hex(F.coalesce("_class", "fingerprint")))).drop("_class", "rows")


#: The tables have no recordings: a document's bytes are 8-bit samples, 2,000 a second, in frames as long in time as the default ones.
TEXT = Format(rate=2000, frame=256, hop=32)


def op2_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The bytes of each whole document as samples."""
    return align_recordings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", TEXT)
