"""The fitted models against definitions worked out in plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
import zstandard

from kinweave.llm import compression, language, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "x", "ing"]) for _ in range(n))


def test_segments_span_by_span():
    rnd = random.Random(7)
    for _ in range(400):
        n, gap = rnd.randint(0, 12), 0.4
        runs = [(i, rnd.uniform(-1, 2)) for i in range(n) if rnd.random() < 0.6]
        scores = [-gap] * n
        for i, s in runs:
            scores[i] = s

        def maximal(lo, hi):
            spans = [(sum(scores[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            total, i, j = max(spans, default=(0, 0, 0))
            return [*maximal(lo, i), (i, j, total), *maximal(j, hi)] if total > 0 else []

        got, want = toxicity.segments(runs, gap), maximal(0, n)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_toxicity_score_by_hand():
    rows = [(prose(i) + (" moron idiot scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    random.Random(8).shuffle(rows)
    model = toxicity.fit(rows)
    text = f"{prose(1000)} idiot moron {prose(1001)} scum scum"
    words = toxicity.TOKEN.findall(text.lower())

    def odds(word):
        return next((model.odds[u] for u in [word, *(word[:k] + "*" for k in range(7, 2, -1) if k <= len(word))] if u in model.odds), None)

    scores = [-model.settings.gap if odds(w) is None or i and w == words[i - 1] else odds(w) for i, w in enumerate(words)]
    found, _ = model.passages(text)
    assert max(s for *_, s in found) == pytest.approx(max(sum(scores[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)))
    logs = sorted((max(0.0, model.lam * s - model.log_k - math.log(len(words))) for *_, s in found), reverse=True)
    together = sum(logs) + sum(math.log(r) for r in range(1, sum(x > 0 for x in logs) + 1))
    assert model.evidence(text) == pytest.approx((logs[0], together))
    a, b, c = model.weights
    assert model.score([text])[0] == pytest.approx(1 / (1 + math.exp(-(a * math.log1p(logs[0]) + b * math.log1p(together) + c))))
    shares = {1.5: 0.05, 0.5: 0.1, -2.0: 0.05}
    lam = toxicity.karlin_lambda(shares, 0.3)
    assert sum(p * math.exp(lam * s) for s, p in shares.items()) + 0.8 * math.exp(-0.3 * lam) == pytest.approx(1, abs=1e-6)


def test_log_odds_by_hand():
    toxic, clean = toxicity.Counter({"bad": 30, "the": 40, "good": 1}), toxicity.Counter({"bad": 2, "the": 45, "good": 50})
    s = toxicity.Settings()
    found = toxicity.log_odds(toxic, clean, s)
    n_t, n_c, prior = 71, 97, {w: s.prior * (toxic[w] + clean[w]) for w in toxic}
    whole = sum(prior.values())
    for w in toxic:
        delta = math.log((toxic[w] + prior[w]) / (n_t + whole - toxic[w] - prior[w])) - math.log((clean[w] + prior[w]) / (n_c + whole - clean[w] - prior[w]))
        z = delta / math.sqrt(1 / (toxic[w] + prior[w]) + 1 / (clean[w] + prior[w]))
        assert (w in found) == (abs(z) >= s.least_z) and (w not in found or found[w] == pytest.approx(delta))


def test_compressed_sizes_by_hand():
    bad = lambda i: " ".join(w + "###" for w in prose(i).split())
    sample = [(prose(i), 1) if i % 2 else (bad(i), 0) for i in range(200)]
    random.Random(9).shuffle(sample)
    model = compression.fit(sample)
    for text in (prose(900, 700), bad(901), "", "é" * 3000):
        sizes, data = [], text.encode()
        for dictionary in (model.good, model.bad):
            one = zstandard.ZstdCompressor(level=model.settings.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(one.compress(data[i : i + model.settings.block])) for i in range(0, len(data), model.settings.block)))
        x = (sizes[1] - sizes[0]) / max(1, len(data))
        assert model.scorer()([text])[0] == pytest.approx(1 / (1 + math.exp(-(model.weights[0] * x + model.weights[1]))), rel=1e-6)


def test_field_expectations_by_enumeration():
    rng = np.random.default_rng(3)
    for sizes in ([1], [3], [2, 4, 1]):
        p, moves = rng.random((sum(sizes), 3)) + 0.05, rng.random((3, 3)) + 0.1
        node, pair = language._expectations(p, sizes, moves)
        want_node, want_pair, at = np.zeros_like(node), np.zeros((3, 3)), 0
        for n in sizes:
            paths = list(itertools.product(range(3), repeat=n))
            weights = np.array([math.prod(p[at + t, y] for t, y in enumerate(path)) * math.prod(moves[a, b] for a, b in itertools.pairwise(path)) for path in paths])
            for path, w in zip(paths, weights / weights.sum(), strict=True):
                for t, y in enumerate(path):
                    want_node[at + t, y] += w
                for a, b in itertools.pairwise(path):
                    want_pair[a, b] += w
            at += n
        assert node == pytest.approx(want_node) and pair == pytest.approx(want_pair)


def test_every_language_is_learned():
    rnd = random.Random(5)
    vocabulary = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for _ in range(70)]
    text = lambda k: " ".join(rnd.choice(vocabulary[k]) for _ in range(30))
    model = language.fit([(text(k), f"l{k:02}") for k in range(70) for _ in range(4)], language.Settings(sequences=500, epochs=2))
    assert len(model.languages) == 70
    found = model.marginals([language.tokens(text(k)) for k in range(70)])
    assert sum(int(m.mean(axis=0).argmax()) == k for k, m in enumerate(found)) >= 66


def test_long_words_count_whole():
    middle = lambda w: "a" * 24 + w + "b" * 24
    one, two = (language.tokens(middle(w)) for w in ("xxxxxxxx", "yyyyyyyy"))
    assert one != two and "".join(one) == middle("xxxxxxxx")
