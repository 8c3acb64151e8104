"""Collocations and hard negatives on small tables against plain versions."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from runsift.llm import collocations, hard_negatives
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_collocations(rows, max_words, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in range(1, max_words + 1):
                for i in range(len(w) - size + 1):
                    gram = tuple(w[i:i + size])
                    counts[lang, gram] = counts.get((lang, gram), 0) + 1
    out = []
    for (lang, gram), a in counts.items():
        if a < least or len(gram) < 2:
            continue
        longer = [f for (g, h), f in counts.items() if g == lang and len(h) > len(gram) and f >= least
                  and any(h[i:i + len(gram)] == gram for i in range(len(h) - len(gram) + 1))]
        if any(100 * f >= 50 * a for f in longer):
            continue
        cuts = [(1000000 * a * a // (counts[lang, gram[:k]] * counts[lang, gram[k:]]), k) for k in range(1, len(gram))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(gram).encode(), counts[lang, gram[:k]], counts[lang, gram[k:]]))
    result = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        for rank, (_, score, a, phrase, left, right) in enumerate(list(group)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(result)


@pytest.mark.parametrize("max_words,least", [(2, 2), (3, 3), (4, 2)])
def test_collocations(spark, max_words, least):
    words = ["The", "ox", "é", "ran", "far", "b", "　x"]
    rows = [(None if i % 9 == 0 else "xy"[i % 2], " ".join(RNG.choice(words, RNG.integers(0, 30)))) for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [("x", f"{passage}. ran far"), ("x", f"ox  {passage}\tb"), ("x", passage.upper()), ("y", None), ("y", ""), (None, " \t.,;"),
             ("x", "as " * 50), ("x", "a,b;c:d!e?f\ng\x0bh\x0ci\rj"), ("x", "far ran " * 3000), ("y", "one"), ("y", "one")]
    frame = spark.createDataFrame([(g, t, 1, "z") for g, t in rows], "lang string, text string, rank int, `group` string")
    got = sorted(tuple(r) for r in collocations.collocations(frame, max_words=max_words, least=least, top=30).select(
        "group", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(rows, max_words, least, 30)


def test_collocation_paths_are_the_edges_again(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    frame = spark.createDataFrame([("x", passage)] * 3 + [("x", "p7 p8 q"), ("x", "u v w"), ("x", "u v w")], "lang string, text string")
    _, _, nodes, edges = collocations.graph(frame, least=2)
    compact = collocations.paths(nodes, edges).collect()
    assert sorted(len(r["words"]) for r in compact) == [3, 9, 63]
    again = Counter()
    for r in compact:
        for i in range(len(r["words"]) - 2):
            again[" ".join(r["words"][i:i + 3])] += r["f"]
    assert again == {r["gram"]: r["f"] for r in edges.collect()}


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0


def plain_negatives(rows, every):
    clean = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        row = (label, [int(np.floor(256 * float(np.float32(x)))) for x in vector])
        clean[key] = min(clean.get(key, row), row)
    out = []
    for a, (label, v) in clean.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, u, strict=False)), b, other) for b, (other, u) in clean.items() if b != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            inside = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, rank, b, -s, -n) for rank, (n, b, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.2])
def test_hard_negatives(spark, spread):
    centres = RNG.normal(size=(6, 24))
    rows = [(i, [float(x) for x in centres[RNG.integers(6)] + spread * RNG.normal(size=24)], int(RNG.integers(4))) for i in range(400)]
    rows += [(400 + i, rows[10][1], i % 3) for i in range(30)]  # ties
    rows += [(None, rows[0][1], 1), (501, None, 1), (502, rows[3][1], None), (503, [1.0, None], 1), (504, [float("nan")] * 24, 1),
             (505, [float("inf")] * 24, 1), (506, [], 1), (507, [2.0] * 3, 2), (510, [0.0] * 24, 0), (20, rows[7][1], 0), rows[30]]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, `key` string")
    got = hard_negatives.mine(frame.drop("key"), F.col("key") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, 10)
    clashing = hard_negatives.mine(frame.withColumn("rank", F.lit("r")).withColumn("score", F.lit(1)), F.col("key") % 10 == 0)
    assert sorted(tuple(r) for r in clashing.collect()) == sorted(tuple(r) for r in got)


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("TILE", 8), ("GROUP", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [(i, [float(x) for x in RNG.normal(size=8) + 0.5], 0 if i % 3 == 0 else i % 5) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("key") % 10 == 0).collect()) == plain_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("key") % 100 == 0).count() == 0


def test_scan_leaves_exact_scores():
    block = hard_negatives._Block(np.arange(50).tobytes(), np.zeros(50, np.int64).tobytes(),
                                  [np.ascontiguousarray(c).tobytes() for c in RNG.integers(-99, 99, (20, 50)).astype(np.int32)])
    anchor = RNG.integers(-99, 99, 20)
    seen = []
    rows, scores = hard_negatives.scan(anchor, block, np.arange(50), lambda low, high: seen.append(len(low)) or (high >= 2000))
    exact = anchor @ block.columns
    assert set(rows) == set(np.flatnonzero(exact >= 2000)) and (scores == exact[rows]).all() and seen[0] > seen[-1]
