import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import address, similarity, text, vocab
from kinweave.operators import decisions


def dp_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_length_against_table():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert similarity.common_length(a, b) == dp_common(a, b)


def test_similarity_edges():
    assert similarity.indel("", "") == 1.0 and similarity.indel("a", "") == 0.0
    assert similarity.token_set("", "a") == 0.0 and similarity.token_set("a b", "b a c") == 1.0
    assert similarity.token_sort("b a", "a b") == 1.0
    assert similarity.partial("abc", "xxabcxx") == 1.0 and similarity.partial("", "") == 1.0 and similarity.partial("", "a") == 0.0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert similarity.alias_best([], ["a"]) == 0.0


def test_best_size_against_enumeration():
    rnd = random.Random(2)
    for _ in range(60):
        p = sorted((rnd.random() for _ in range(rnd.randint(0, 6))), reverse=True)
        scores = []
        for k in range(len(p) + 1):
            total = 0.0
            for world in itertools.product((0, 1), repeat=len(p)):
                weight = 1.0
                for x, w in zip(p, world, strict=True):
                    weight *= x if w else 1 - x
                tp, true = sum(world[:k]), sum(world)
                total += weight * (1.0 if not k and not true else 0.0 if not tp else 1.25 * tp / (1.25 * tp + 0.25 * (true - tp) + (k - tp)))
            scores.append(total)
        assert scores[decisions.best_size(p, 12, False)] == pytest.approx(max(scores))


def test_transliteration_and_segments():
    assert text.fold("कमल") == "kamal"
    assert text.fold("Crème Ångelö ß") == "creme angelo ss" and text.fold(None) == ""
    assert text.segment("copperlantern", {"copper": -5.0, "lantern": -6.0}) == ["copper", "lantern"]
    assert "".join(text.segment("xyzcopper", {"copper": -5.0})) == "xyzcopper" and text.segment("", {}) == []


def test_fold_column_equals_function(spark):
    rows = ["Café", "कमल", None, "", "ﬁn ½", "ÀÉÎÕÜ—ø"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(text.fold_text("t")).collect()] == [text.fold(r) for r in rows]


def test_names(spark):
    df = spark.createDataFrame([("The Acme Foundation, Inc. dba Best One LLC",), ("ACME-CO www.acme-tools.co.in (id: 12)",), ("A B C Corp | x",), ("Shr33 Krishna 2nd Pvt Ltd",), ("",), (None,)], "n string")
    got = [r["w"].asDict() for r in df.select(text.name_words(text.fold_text("n")).alias("w")).collect()]
    assert got[0] == {"main": ["the", "acme", "foundation", "inc"], "alias": ["best", "one", "llc"], "joined": ""}
    assert got[1] == {"main": ["acme", "co"], "alias": [], "joined": "acmetools"}
    assert got[2]["main"] == ["abc", "corp"] and got[3]["main"] == ["shree", "krishna", "2nd", "pvt", "ltd"]
    assert got[4] == got[5] == {"main": [], "alias": [], "joined": ""}


def test_addresses(spark):
    cases = {
        "LARKSPUR CT, DUNMORE, TX": ("larkspur ct dunmore", "", "tx"),
        "2207 Larkspur Court, Old Mills, TX": ("larkspur ct old mills", "2207", "tx"),
        "Texas, 84 Quarry Trailer Homes, Dunmor CITY": ("quarry trailer homes dunmor", "84", "tx"),
        "C/O Mira Paul, Thazhevettom, Kerala": ("mira paul thazhevettom", "", "kl"),
        "Flat 12, 004410 Main St": ("main st", "4410", ""),
        "": ("", "", ""),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", address.address_parts(text.fold_latin("t")).alias("p")).select("t", F.array_join("p.words", " ").alias("w"), "p.num1", "p.state")
    assert {r["t"]: (r["w"], r["num1"], r["state"]) for r in df.collect()} == cases


def test_skeletons(spark):
    words = ["function", "phunctshun", "a", "", "zzz", "qu33n", "0153", "xylophone", "chccche", "bacch"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(text.skeleton("w")).collect()]
    assert got == [address.skeleton_of(w) for w in words] and got[0] == "fnksn" and got[-2:] == ["ckc", "bkc"]


def test_vocabulary_order():
    assert vocab.NAME_WORDS_OLD["mfrs"] == "mfrs" and vocab.states()["ct"] == "cg" and vocab.states()["tamil nadu"] == "tn"


def test_measures_of_many_pairs():
    """All pairs at once equal one at a time; texts over a machine word and of many letters too."""
    rng = random.Random(5)
    letters = ("ab ", "abcdefgh ij", "aé中文字क\U0001f600 ", "".join(chr(0x4E00 + i) for i in range(3000)))
    pairs = [tuple("".join(rng.choices(a, k=rng.choice((0, 1, 5, 40, 64, 65, 130)))) for _ in range(2)) for a in letters for _ in range(700)]
    assert similarity.common_lengths(pairs) == [similarity.common_length(a, b) for a, b in pairs]
    for kind, many in similarity.MANY.items():
        assert many(pairs) == [similarity.MEASURES[kind](a, b) for a, b in pairs], kind


def test_partial_leaves_out_no_better_stretch():
    """Against all stretches."""

    def plain(a, b):
        stretches = lambda x, y: [y[max(0, i) : i + len(x)] for i in range(1 - len(x), len(y))]
        x, y = sorted((a, b), key=len)
        return max([similarity.indel(x, w) for w in stretches(x, y)] + ([similarity.indel(y, w) for w in stretches(y, x)] if len(x) == len(y) else []))

    rng = random.Random(6)
    for k in (3, 9, 20):
        for _ in range(150):
            a, b = ("".join(rng.choices("abcde f", k=rng.randint(1, k))) for _ in range(2))
            assert similarity.partial(a, b) == plain(a, b), (a, b)
