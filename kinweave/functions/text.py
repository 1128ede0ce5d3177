"""Text functions as Column expressions; only scripts that SQL cannot fold go through an Arrow function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# Characters that fold to others before accents are taken off.
SPECIAL_ONE = {"’": "'", "‘": "'", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "–": "-", "—": "-"}
SPECIAL_TWO = {"ß": "ss", "æ": "ae", "œ": "oe"}
INDIC = r"[ऀ-ൿ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: it is the variable of a function over an array of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_in(words: Iterable[str]) -> Callable[[Column], Column]:
    found = sorted(set(words))
    return lambda x: x.isin(found)


def lookup(table: dict[str, str], x: Column, other: Column | None = None) -> Column:
    """table[x], else other (x itself if not given); one hash lookup in a literal map would copy it a row, so values group their keys."""
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        if k != v or other is not None:
            groups.setdefault(v, []).append(k)
    out = None
    for v, keys in groups.items():
        test = x.isin(keys) if len(keys) > 1 else x == keys[0]
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    rest = x if other is None else other
    return rest if out is None else out.otherwise(rest)


@lru_cache(1)
def latin_table() -> tuple[str, str]:
    """Letters up to U+024F and from U+1E00 to U+1EFF whose compatibility decomposition is one letter with marks, and that letter."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def fold_latin(x: Column | str) -> Column:
    """Accents off and lower case for Latin text, without leaving the JVM; null as empty."""
    source, target = latin_table()
    text = F.coalesce(col(x), F.lit(""))
    for a, b in SPECIAL_TWO.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.translate(text, "".join(SPECIAL_ONE) + source, "".join(SPECIAL_ONE.values()) + target)
    return F.lower(F.regexp_replace(text, r"[̀-ͯ]", ""))


def is_native(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(INDIC), F.lit(False))


# Sounds by their place in a block of an Indian script; one layout serves all nine blocks.
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li"}
CONSONANTS = (0x15, "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h")
CONSONANTS_DOTTED = (0x58, "q kh g z r rh f y")
VOWEL_SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x56: "ai", 0x57: "au", 0x62: "li", 0x63: "li"}
SILENCER, MARKS = 0x4D, {0x01: "n", 0x02: "n", 0x03: "h", 0x3C: "", 0x3D: "", 0x55: "", 0x70: "n", 0x71: ""}
SINGLE = {0x09CE: "t", 0x0D7A: "n", 0x0D7B: "n", 0x0D7C: "r", 0x0D7D: "l", 0x0D7E: "l", 0x0D7F: "k", 0x0D54: "m", 0x0D55: "y", 0x0D56: "l", 0x0964: " ", 0x0965: " ", 0x200C: "", 0x200D: ""}


def _sounds() -> dict[str, tuple[str, str]]:
    """character -> (kind, sound); kinds: v vowel or other, c consonant, s vowel sign, h silencer."""
    found: dict[str, tuple[str, str]] = {}
    layout: dict[int, tuple[str, str]] = {k: ("v", v) for k, v in {**VOWELS, **MARKS}.items()}
    for first, sounds in (CONSONANTS, CONSONANTS_DOTTED):
        layout |= {first + i: ("c", s) for i, s in enumerate(sounds.split())}
    layout |= {k: ("s", v) for k, v in VOWEL_SIGNS.items()} | {SILENCER: ("h", "")} | {0x66 + d: ("v", str(d)) for d in range(10)}
    for block in BLOCKS:
        found |= {chr(block + k): v for k, v in layout.items() if unicodedata.name(chr(block + k), None)}
    return found | {chr(k): ("v", v) for k, v in SINGLE.items()}


SOUND_OF = _sounds()


def transliterate(text: str) -> str:
    """Indian scripts in Latin letters. A consonant has an inherent a, but before a vowel sign or a silencer and at the end of a word."""
    table, out = SOUND_OF, []
    marks = [(c, *table.get(c, ("", c))) for c in text]
    marks = [m for m in marks if m[1] != "v" or m[2]]  # marks without a sound stand in nothing's way
    for i, (_, kind, sound) in enumerate(marks):
        out.append(sound)
        if kind == "c":
            after = marks[i + 1] if i + 1 < len(marks) else ("", "", " ")
            if after[1] not in ("s", "h") and not (after[2][:1].isspace() or after[2][:1] in tuple(",.-/()")):
                out.append("a")
    return "".join(out)


def fold(text: str | None) -> str:
    """Any text in lower-case Latin letters without accents, as far as scripts are known; null as empty."""
    text = text or ""
    if re.search(r"[ऀ-ൿ]", text):
        text = transliterate(text)
    text = text.translate(str.maketrans({**SPECIAL_ONE, **SPECIAL_TWO}))
    return re.sub(r"[̀-ͯ]", "", unicodedata.normalize("NFKD", text)).lower()


def fold_text(x: Column | str) -> Column:
    """fold() of a column: Latin text stays in the JVM; only other text goes through an Arrow function, and only such rows carry text there."""
    text = F.coalesce(col(x), F.lit(""))
    other = text.rlike(r"[^\x00-ɏḀ-ỿ–—‘’]")
    through = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else fold(t)), "string")
    return F.when(other, through(F.when(other, text))).otherwise(fold_latin(text))


def replace_all(x: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, x)


def skeleton(word: Column | str) -> Column:
    """Sound-alike key of a word: confusable digits as letters, sounds made alike, later vowels dropped, repeated letters made one."""
    w = col(word)
    w = F.when(w.rlike(r"\p{L}"), F.translate(w, "0153", "olse")).otherwise(w)
    w = reduce(lambda t, p: F.regexp_replace(t, *p) if "(" in p[0] else F.replace(t, F.lit(p[0]), F.lit(p[1])), vocab.SOUNDS, w)
    return F.regexp_replace(F.regexp_replace(w, "(?<=.)[aeouy]", ""), r"(.)\1+", "$1")


def skeleton_old(word: Column | str) -> Column:
    """The older sound-alike key: sounds made alike, repeated letters made one, then in words over three letters the later vowels dropped."""
    w = F.regexp_replace(replace_all(col(word), vocab.SOUNDS_OLD), r"(.)\1+", "$1")
    return let(w, lambda t: F.when(F.length(t) > 3, F.concat(F.substring(t, 1, 1), F.translate(F.substr(t, F.lit(2)), "aeiou", ""))).otherwise(t))


def basic_clean(x: Column | str) -> Column:
    """The older cleaning: accents off, lower case, & and @ as words, possessive s joined, quotes off, others as spaces, spaces made one."""
    t = fold_latin(x)
    t = F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    t = F.regexp_replace(t, r"n°", " no ")
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])'s\b", "$1s")
    t = F.regexp_replace(t, "['’`]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def unleet(word: Column | str) -> Column:
    """Digits that stand for letters replaced, in words with a digit and three letters or more that aren't ordinals."""
    w = col(word)
    hit = w.rlike(r"[0-9]") & ~w.rlike(r"^[0-9]+(st|nd|rd|th)$") & (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 3)
    return F.when(hit, F.translate(w, "01534", "olsea")).otherwise(w)


def strip_junk(x: Column | str) -> Column:
    """Ids in brackets, tails after a bar, long numbers after a dash, and #numbers if a letter remains, each made a space."""
    t = F.regexp_replace(F.regexp_replace(col(x), r"\(\s*id\s*:?\s*[0-9]+\s*\)", " "), r"\|.*$", " ")
    t = F.regexp_replace(t, r"\s-\s*[0-9]{6,}", " ")
    bare = F.regexp_replace(t, r"#\s*[0-9]+", " ")
    return F.when(bare.rlike("[a-z]"), bare).otherwise(t)


# Endings of web addresses.
DOMAIN = r"(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:com|c0m|co\.in|in|net|org|co|fr|biz|io|info)\b"
HANDLE = r"(?:^|\s)[#@]([a-z0-9]{3,})\b"


def domain_of(x: Column | str) -> Column:
    """The name in the first web address, else in the first #tag or @handle, digits as letters and without hyphens; empty without one."""
    t = col(x)
    found = F.regexp_extract(t, DOMAIN, 1)
    found = F.when(found != "", found).otherwise(F.regexp_extract(t, HANDLE, 1))
    return unleet(F.replace(found, F.lit("-"), F.lit("")))


def without_domain(x: Column | str) -> Column:
    """The text with its first web address, else its first tag or handle, made a space."""
    t = col(x)
    cut = lambda p: F.regexp_replace(t, rf"(?s)^(.*?){p}(.*)$", "$1 $3")
    return F.when(t.rlike(DOMAIN), cut(DOMAIN)).when(t.rlike(HANDLE), cut(HANDLE)).otherwise(t)


def join_single_letters(x: Column | str) -> Column:
    """Single letters in a row made one word: a b c -> abc."""
    return F.regexp_replace(col(x), r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def tokens(x: Column | str) -> Column:
    """Words between white spaces."""
    return F.filter(F.split(col(x), r"\s+"), lambda w: w != "")


def alnum_tokens(x: Column | str) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def drop_repeats(words: Column) -> Column:
    """Without words equal to the one before."""
    return let(words, lambda a: F.filter(a, lambda w, i: (i == 0) | (w != F.get(a, i - 1))))


def split_alias(words: Column) -> Column:
    """struct(main, alias): at the first alias word that isn't the first word; the alias loses further alias words."""
    alias_word = is_in(vocab.ALIAS_WORDS)
    place = let(F.filter(F.transform(words, lambda w, i: F.when(alias_word(w) & (i > 0), i)), lambda i: i.isNotNull()), lambda a: F.get(a, F.lit(0)))
    none = F.array().cast("array<string>")
    return let(
        F.struct(words.alias("w"), place.alias("p")),
        lambda s: F.struct(
            F.when(s["p"].isNull(), s["w"]).otherwise(F.slice(s["w"], F.lit(1), F.coalesce(s["p"], F.lit(0)))).alias("main"),
            F.when(s["p"].isNull(), none).otherwise(F.filter(F.slice(s["w"], F.coalesce(s["p"], F.lit(0)) + 2, F.greatest(F.size(s["w"]), F.lit(1))), lambda w: ~alias_word(w))).alias("alias"),
        ),
    )


def first_nonempty(*arrays: Column) -> Column:
    out = arrays[-1]
    for a in reversed(arrays[:-1]):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def core_of(words: Column) -> Column:
    """struct(core, core2, legal) of name words: core is without legal forms, honorifics and stop words, core2 without fillers too; where nothing is left, less is taken away."""
    stop, out, fill, legal = is_in(vocab.STOP), is_in({*vocab.LEGAL, *vocab.HONORIFICS, *vocab.STOP}), is_in(vocab.FILLER), is_in(vocab.LEGAL)
    core = let(words, lambda w: first_nonempty(F.filter(w, lambda x: ~out(x)), F.filter(w, lambda x: ~stop(x)), w))
    forms = F.array_sort(F.array_distinct(F.transform(F.filter(words, legal), lambda x: lookup(vocab.LEGAL, x))))
    return let(F.struct(core.alias("core"), forms.alias("legal")), lambda s: F.struct(s["core"].alias("core"), first_nonempty(F.filter(s["core"], lambda x: ~fill(x)), s["core"]).alias("core2"), s["legal"].alias("legal")))


def name_words(folded: Column | str) -> Column:
    """struct(main, alias, joined) of a folded name: junk off, web address taken out, symbols as words, digits as letters, repeats dropped, alias split."""

    def words(t: Column) -> Column:
        t = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), F.lit("'"), F.lit(""))
        t = F.regexp_replace(t, rf"\b({'|'.join(vocab.ALIAS_PHRASES)})\b", " dba ")
        t = join_single_letters(F.regexp_replace(t, "[^a-z0-9 ]+", " "))
        return drop_repeats(F.transform(tokens(t), unleet))

    def build(t: Column) -> Column:
        split = let(words(let(t, without_domain)), split_alias)
        return let(F.struct(split.alias("s"), domain_of(t).alias("j")), lambda x: F.struct(x["s"]["main"].alias("main"), x["s"]["alias"].alias("alias"), x["j"].alias("joined")))

    return let(let(col(folded), strip_junk), build)


def segment(text: str, frequency: dict[str, float], longest: int = 24) -> list[str]:
    """The split of a joined text into known words with the greatest sum of log frequencies; unknown chunks of one or two letters cost 12 a letter.

    Of equal splits that with the longer last word counts. Where no split exists, the last part is what stands before it.
    """
    n = len(text)
    best: list[tuple[float, int] | None] = [(0.0, 0), *[None] * n]
    for end in range(1, n + 1):
        for begin in range(max(0, end - longest), end):
            word = text[begin:end]
            gain = frequency.get(word, -12.0 * len(word) if len(word) < 3 else None)
            if gain is not None and best[begin] is not None and (best[end] is None or best[begin][0] + gain > best[end][0]):
                best[end] = (best[begin][0] + gain, begin)
    out, end = [], n
    while end:
        begin = best[end][1] if best[end] else 0
        out.insert(0, text[begin:end])
        end = begin
    return out


def segment_words(x: Column | str, frequency: dict[str, float], longest: int = 24) -> Column:
    """segment() of a column; frequency is a vocabulary that the caller has bounded. Rows without text carry nothing to Python."""
    run = F.pandas_udf(lambda s: s.map(lambda t: segment(t, frequency, longest) if t else []), "array<string>")
    return run(col(x))


def script_of(text: str) -> str:
    """The most frequent script other than Latin, by the first word of the characters' names; empty for Latin text."""
    names = [unicodedata.name(c, "").split(" ")[0] for c in text if ord(c) > 0x24F and c.isalpha()]
    return max(sorted(set(names)), key=names.count, default="")


def scripts(x: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(script_of), "string")(F.coalesce(col(x), F.lit("")))

