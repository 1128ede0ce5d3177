"""Tokenisation with a public vocabulary that closes every word with an end mark, piece by piece and remembered.

Its splitter cuts a lower-cased text into runs of letters, single digits, short forms such as 's and runs of other signs, and
its merges work within these pieces. So the ids of a text are those of its words, between white space, in a row, and those of a
word its pieces' ids; both recur, and each Python worker remembers those that it has met, up to a fixed number. Texts with characters outside the range where this
module cuts exactly as the splitter does go to the tokenizer whole, and so do those that hold a special token's string, which
the tokenizer's plain call gives as that token.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Words, and pieces, whose ids a worker remembers; as many older ones are kept until they are met again or pushed out.
WORDS, PIECES = 400_000, 200_000
#: What the splitter does below U+0250: letters, short forms, single digits, other signs.
PIECE = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
PLAIN = re.compile("[!-~]+")
#: Characters that Python and the tokenizer may treat differently.
OTHER = re.compile(r"[\x1c-\x1fİɐ-\U0010ffff]")


def _other(text: str) -> bool:
    """Whether OTHER finds a character; where the text fits Latin-1, as most do, without a look at each by the expression."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return OTHER.search(text) is not None
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


class Memory:
    """A bounded table in two generations: when the young one is full it becomes the old one, and what is met again moves back."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that neither generation has; the others are young afterwards."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        out = []
        for k in keys.difference(self.young):
            if k in self.old:
                self.young[k] = self.old[k]
            else:
                out.append(k)
        return out


class WordTokenizer:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers, equal to those of the whole text at once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        others = {x for c in range(1, 0x250) for x in chr(c).lower() if not PLAIN.fullmatch(x)}
        self.by_bytes = str.maketrans({c: "".join(x for x, _ in level.pre_tokenize_str(c)) for c in others})
        self.words, self.pieces = Memory(WORDS), Memory(PIECES)

    def encode(self, text: str) -> bytes:
        if _other(text) or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        try:
            return b"".join(map(self.words.young.__getitem__, words))
        except KeyError:
            new = [(w, PIECE.findall(w)) for w in self.words.missing(set(words))]
            known = self.pieces
            for piece in known.missing({p for _, pieces in new for p in pieces}):
                known.young[piece] = self._piece(piece)
            self.words.young.update((w, b"".join(map(known.young.__getitem__, pieces))) for w, pieces in new)
            return b"".join(map(self.words.young.__getitem__, words))

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, by the merges alone: printable ASCII stands for its own bytes there, others are put in terms of bytes first."""
        found = array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() and PLAIN.fullmatch(piece) else piece.translate(self.by_bytes))])
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()
