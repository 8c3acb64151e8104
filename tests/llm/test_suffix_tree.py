"""Suffix-tree scores against a plain version, and the tree's own laws."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from runsift.llm import frequent, suffix_tree

RNG = np.random.default_rng(8)


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def held(key, mod):
    return key is not None and zlib.crc32(str(key).encode()) % mod == 0


class Plain:
    def __init__(self, rows, depth, least, alpha, cutoff, mod):
        self.depth, self.alpha = depth, alpha
        self.counts = Counter()
        for key, text in rows:
            if not held(key, mod):
                w = tokens(text)
                for size in range(1, depth + 2):
                    self.counts.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
        words = {g[0]: c for g, c in self.counts.items() if len(g) == 1 and g != ("<s>",)}
        self.n, self.v, self.words = sum(words.values()), len(words), words
        self.next = {}
        for g, c in self.counts.items():
            if len(g) > 1 and c >= least:
                self.next.setdefault(g[:-1], {})[g[-1]] = c
        self.states = set()
        for s, after in self.next.items():
            total, rest = self.counts[s], self.counts[s] - sum(after.values())
            gain = sum(c * math.log(self.p(s, x) / self.p(s[1:], x)) for x, c in after.items())
            gain += rest * math.log((rest + alpha) / (total + alpha))
            if gain >= cutoff * len(after):
                self.states.update(s[i:] for i in range(len(s)))

    def p(self, s, x):
        if not s:
            return (self.words.get(x, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))
        after, total = self.next[s], self.counts[s]
        rest = total - sum(after.values())
        return (after.get(x, 0) + (rest + self.alpha) * self.p(s[1:], x)) / (total + self.alpha)

    def text(self, text):
        w, base, score, known = tokens(text), 0.0, 0.0, 0
        for i in range(1, len(w)):
            s = max((tuple(w[max(0, i - k):i]) for k in range(self.depth + 1) if k == 0 or tuple(w[max(0, i - k):i]) in self.states), key=len)
            score += math.log10(self.p(s, w[i]))
            base += math.log10(self.p((), w[i]))
            known += w[i] in self.words
        return len(w) - 1, known, base, score


def check(spark, rows, depth=2, least=3, cutoff=1.0, mod=10):
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, score int, `key` string")
    model = Plain(rows, depth, least, 1.0, cutoff, mod)
    got = suffix_tree.score(frame, depth=depth, least=least, cutoff=cutoff).collect()
    want = [(k, held(k, mod), *model.text(t)[:2], model.n, *model.text(t)[2:]) for k, t in rows]
    order = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r) for r in got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def corpus():
    lexicon = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(RNG.choice(lexicon, RNG.integers(0, 60)))) for i in range(80)]
    passage = "The quick brown fox jumps over the lazy dog"
    rows += [(100 + i, f"{passage} w{i % 5} {passage}") for i in range(40)]
    rows += [(200 + i, ["aa xx yy pp", "bb xx yy qq"][i % 2]) for i in range(40)]
    return [*rows, (None, passage), (None, None), (7, "w1  w2\tunknown"), (7, "w1  w2\tunknown"), (300, ""), (301, " \n"),
            (302, "UNSEEN words here"), (303, "w3 " * 5000)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores(spark, depth):
    model = check(spark, corpus(), depth)
    assert len(model.states) > 5 and any(len(s) == depth for s in model.states)


def test_scores_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SLICE_WORDS", 500)
    monkeypatch.setattr(frequent, "BUCKET_BYTES", 1000)
    check(spark, corpus())


def test_contexts_help_on_held_out_texts(spark):
    rows = corpus()
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), least=3).where("held_out and doc_id >= 100").collect()
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def test_states_are_distributions():
    model = Plain(corpus(), 2, 3, 1.0, 1.0, 10)
    for s in model.states:
        seen = sum(model.p(s, x) for x in model.words) + model.p(s, "<never>")
        assert seen == pytest.approx(1.0)


def test_nothing_to_score_or_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.score(empty).count() == 0
    key = next(k for k in range(1000) if held(k, 10))
    (row,) = suffix_tree.score(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).collect()
    assert tuple(row) == (key, True, 3, 0, 0, 0.0, 0.0)


def test_filter_never_misses_a_frequent_key(spark):
    hashes = RNG.integers(0, 1 << 63, 5000, dtype=np.uint64)
    batches = [frequent.pack(np.concatenate([hashes[:1000], RNG.integers(0, 1 << 63, 3000, dtype=np.uint64)]), 4, 3) for _ in range(3)]
    blocks = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], frequent.KEY_BLOCKS)
    found = frequent.Filter(4).learn(blocks, 3)
    assert found.likely(hashes[:1000]).all() and found.likely(hashes[1000:]).mean() < 0.01
