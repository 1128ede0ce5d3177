"""Addresses as Column expressions: components, state, numbers, street words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import basic_clean, col, fold_latin, is_in, let, lookup, skeleton, skeleton_old, tokens


def skeleton_of(word: str) -> str:
    """skeleton() of one word, for tables that are built on the driver."""
    if any(c.isalpha() for c in word):
        word = word.translate(str.maketrans("0153", "olse"))
    for a, b in vocab.SOUNDS:
        word = re.sub(a, b, word)
    return re.sub(r"(.)\1+", r"\1", word[:1] + re.sub("[aeouy]", "", word[1:]))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def sound_states() -> dict[str, str]:
    """Names of more than one word by their sound-alike keys; of names that sound alike the first counts."""
    found: dict[str, str] = {}
    for name, code in vocab.states().items():
        if " " in name:
            found.setdefault(" ".join(map(skeleton_of, name.split())), code)
    return found


def state_of(component: Column) -> Column:
    """Code of the state that a component names, else empty: by its exact name or code, or by the sound of a name of several words."""
    key = F.array_join(tokens(F.regexp_replace(F.replace(component, F.lit("'"), F.lit(" ")), "[^a-z0-9 ]+", " ")), " ")

    def found(k: Column) -> Column:
        sound = F.array_join(F.transform(F.split(k, " "), skeleton), " ")
        spaces = F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit("")))
        by_sound = F.when(k.contains(" "), F.element_at(_map(sound_states()), sound))
        return F.when((k == "") | k.rlike("[0-9]") | (spaces > 6), F.lit("")).otherwise(F.coalesce(F.element_at(_map(vocab.states()), k), by_sound, F.lit("")))

    return let(key, found)


def clean_address(folded: Column | str) -> Column:
    """Post box numbers and words for a missing value made spaces."""
    t = F.regexp_replace(col(folded), r"\b(p\s?o\s?box|post box|pmb|pob)\s*#?\s*[0-9]+", " ")
    return F.regexp_replace(t, r"\b(null|none|n/a)\b", " ")


def components(text: Column) -> Column:
    """struct(state, rest): the components between commas without the first that names a state, and that state."""
    parts = F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c)), lambda c: c != "")

    def split(pairs: Column) -> Column:
        place = let(F.filter(F.transform(pairs, lambda p, i: F.when(p["s"] != "", i)), lambda i: i.isNotNull()), lambda a: F.get(a, F.lit(0)))
        return let(place, lambda k: F.struct(F.coalesce(F.get(pairs, k)["s"], F.lit("")).alias("state"), F.transform(F.filter(pairs, lambda p, i: k.isNull() | (i != k)), lambda p: p["c"]).alias("rest")))

    return let(F.transform(parts, lambda c: F.struct(c.alias("c"), state_of(c).alias("s"))), split)


def component_tokens(component: Column) -> Column:
    """Runs of letters or digits of a component, ordinal endings off."""
    t = F.translate(F.regexp_replace(component, r"\b([0-9]+)(st|nd|rd|th|er|eme|ere|e)\b", "$1"), "/-'", "   ")
    return F.regexp_extract_all(F.regexp_replace(t, "[^a-z0-9 ]+", " "), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def address_parts(folded: Column | str) -> Column:
    """struct(words, wset, nums, num1, pc, state, street, empty) of a folded address.

    num1 is the first number that isn't a unit's and has a word soon after it in its component, else the first that isn't a
    unit's, else the first. pc is the last number, of five or six digits, if there are several and it isn't num1. street
    holds the sound-alike keys of the words of components with a street type.
    """
    drop, unit, street_type = is_in(vocab.ADDRESS_DROP), is_in(vocab.UNIT_WORDS), is_in(vocab.STREET_TYPES)

    def marks(words: Column) -> Column:
        def mark(x: Column, j: Column) -> Column:
            digit = x.rlike("^[0-9]")
            soon = F.exists(F.slice(words, j + 2, F.lit(2)), lambda y: ~y.rlike("^[0-9]") & ~drop(y))
            free = digit & ~F.coalesce(unit(F.get(words, j - 1)) & (j > 0), F.lit(False))
            canon = lookup(vocab.ADDRESS_WORDS, x)
            return F.struct(
                F.when(digit, F.regexp_replace(x, "^0+(?=.)", "")).alias("n"),
                free.alias("free"),
                (free & soon).alias("street"),
                F.when(~digit & (F.length(canon) > 1) & ~drop(canon) & ~drop(x), canon).alias("w"),
            )

        return F.transform(words, mark)

    def street_words(part: Column) -> Column:
        words = F.filter(F.transform(part, lambda m: m["w"]), lambda w: w.isNotNull())
        return let(words, lambda ws: F.when(F.exists(ws, street_type), F.transform(F.filter(ws, lambda w: ~street_type(w) & ~w.startswith("_")), skeleton)).otherwise(F.array().cast("array<string>")))

    def gather(s: Column) -> Column:
        def from_marks(parts: Column) -> Column:
            return let(F.flatten(parts), lambda all_: from_flat(parts, all_))

        def from_flat(parts: Column, all_: Column) -> Column:
            nums = F.transform(F.filter(all_, lambda m: m["n"].isNotNull()), lambda m: m["n"])
            words = F.transform(F.filter(all_, lambda m: m["w"].isNotNull()), lambda m: m["w"])
            first = lambda test: F.get(F.filter(all_, test), F.lit(0))["n"]
            num1 = F.coalesce(first(lambda m: m["street"]), first(lambda m: m["free"]), first(lambda m: m["n"].isNotNull()), F.lit(""))
            return let(
                F.struct(nums.alias("nums"), words.alias("words"), num1.alias("num1")),
                lambda x: F.struct(
                    x["words"].alias("words"),
                    F.array_sort(F.array_distinct(x["words"])).alias("wset"),
                    F.array_distinct(x["nums"]).alias("nums"),
                    x["num1"].alias("num1"),
                    let(F.get(x["nums"], F.size(x["nums"]) - 1), lambda z: F.when((F.size(x["nums"]) > 1) & F.length(z).isin(5, 6) & (z != x["num1"]), z).otherwise("")).alias("pc"),
                    s["state"].alias("state"),
                    F.array_sort(F.array_distinct(F.flatten(F.transform(parts, street_words)))).alias("street"),
                    ((F.size(x["words"]) == 0) & (F.size(x["nums"]) == 0)).alias("empty"),
                ),
            )

        return let(F.transform(s["rest"], lambda c: let(component_tokens(c), marks)), from_marks)

    return let(let(clean_address(folded), components), gather)


def address_old(raw: Column | str) -> Column:
    """struct(core, words, landmark, nums, postcode, house, skel) by the older rules, which set landmark components apart."""
    text = F.regexp_replace(fold_latin(raw), r"\b([0-9]{5})-[0-9]{4}\b", "$1")
    parts = F.transform(F.filter(F.split(text, r"[,;()\n]"), lambda c: F.trim(c) != ""), basic_clean)
    landmark = lambda c: c.rlike(rf"^\s*({'|'.join(vocab.LANDMARKS_OLD)})\b")
    names = vocab.US_STATES | vocab.INDIAN_STATES_OLD
    any_name = rf"\b({'|'.join(names)})\b"
    drop = is_in(vocab.ADDRESS_DROP_OLD)

    def canon(c: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(c, r"\b([0-9]{3})\s([0-9]{3})\b", "$1$2"), r"\b([0-9]+)(st|nd|rd|th|er|ere|e|eme)\b", "$1")
        short = t
        for name in sorted(names, key=lambda n: (-len(n), n)):
            short = F.regexp_replace(short, rf"\b{name}\b", names[name])
        words = F.filter(F.transform(tokens(F.when(t.rlike(any_name), short).otherwise(t)), lambda w: lookup(vocab.ORDINALS_OLD, w)), lambda w: ~drop(w))
        both = F.transform(words, lambda w: F.when(w.rlike("^([0-9]+[a-z]{1,2}|[a-z]{1,2}[0-9]+)$"), F.regexp_extract_all(w, F.lit("[a-z]+|[0-9]+"), F.lit(0))).otherwise(F.array(lookup(vocab.ADDRESS_WORDS_OLD, w))))
        return F.flatten(both)

    def build(s: Column) -> Column:
        words = F.filter(s["core"], lambda w: ~w.rlike("^[0-9]+$"))
        nums = F.filter(s["core"], lambda w: w.rlike("^[0-9]+$"))
        pc = F.coalesce(F.get(F.reverse(F.filter(nums, lambda n: F.length(n).isin(5, 6))), F.lit(0)), F.lit(""))
        return let(pc, lambda p: F.struct(s["core"].alias("core"), words.alias("words"), s["landmark"].alias("landmark"), nums.alias("nums"), p.alias("postcode"), F.coalesce(F.get(F.filter(nums, lambda n: (n != p) & (F.length(n) <= 5)), F.lit(0)), F.lit("")).alias("house"), F.transform(words, skeleton_old).alias("skel")))

    both = let(parts, lambda p: F.struct(F.array_join(F.filter(p, lambda c: ~landmark(c)), " ").alias("a"), F.array_join(F.filter(p, landmark), " ").alias("b")))
    return let(let(both, lambda x: F.struct(canon(x["a"]).alias("core"), canon(x["b"]).alias("landmark"))), build)


def name_old(raw: Column | str) -> Column:
    """struct(clean, canon, core, aliases, legal, acronym, nospace, skel) of a name by the older rules; aliases are the cores of all its names."""
    legal, stop = is_in(vocab.LEGAL_OLD), is_in(vocab.NAME_STOP_OLD)
    split = rf"\b({'|'.join(vocab.ALIASES_OLD)})\b"

    def words(text: Column) -> Column:
        return F.transform(tokens(text), lambda w: lookup(vocab.ORDINALS_OLD, w))

    def canon(text: Column) -> Column:
        return F.transform(F.filter(words(text), lambda w: ~legal(w)), lambda w: lookup(vocab.NAME_WORDS_OLD, w))

    def core(text: Column) -> Column:
        return let(canon(text), lambda w: let(F.filter(w, lambda x: ~stop(x)), lambda c: F.when(F.size(c) > 0, c).otherwise(w)))

    def build(clean: Column) -> Column:
        parts = F.filter(F.transform(F.split(clean, split), lambda p: F.trim(p)), lambda p: p != "")
        return let(F.when(F.size(parts) > 0, parts).otherwise(F.array(clean)), lambda a: let(core(a[0]), lambda main: fields(clean, a, main)))

    def fields(clean: Column, names: Column, main: Column) -> Column:
        letters = F.array_join(F.transform(F.filter(main, lambda w: ~w.rlike("^[0-9]+$")), lambda w: F.substring(w, 1, 1)), "")
        forms = F.flatten(F.transform(names, lambda n: F.transform(F.filter(words(n), legal), lambda w: lookup(vocab.LEGAL_OLD, w))))
        return F.struct(
            clean.alias("clean"),
            canon(names[0]).alias("canon"),
            main.alias("core"),
            F.array_distinct(F.transform(names, lambda n: F.array_join(core(n), " "))).alias("aliases"),
            F.array_sort(F.array_distinct(forms)).alias("legal"),
            F.when(F.size(main) > 1, letters).otherwise("").alias("acronym"),
            F.array_join(main, "").alias("nospace"),
            F.transform(main, skeleton_old).alias("skel"),
        )

    return let(basic_clean(raw), build)


def country_old(raw: Column | str) -> Column:
    return let(basic_clean(raw), lambda c: lookup(vocab.COUNTRIES_OLD, c))
