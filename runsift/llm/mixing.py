"""Mixing sources to target weights: soft domain membership, then nonnegative document rates by least squares.

A naive Bayes classifier learned from the labelled table gives every document a posterior over domains. The rates are
the nonnegative solution of a weighted least squares problem whose unknowns are one rate per document: the expected
tokens of each domain, summed over documents, should equal its target. One multiplier per domain gives all rates, and
Newton steps find the multipliers; a step needs only sums over domains and pairs of domains. Documents whose features
fall in the same bins have the same posterior, hence the same rate, so the steps run on one row per bin combination,
whose number the bins bound.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.storage import store, without
from runsift.llm.toxicity import held_out, training_sample

#: Target share of expected tokens by domain; a domain is the pair of labels.
TARGETS = {"q1t0": 0.88, "q0t0": 0.10, "q1t1": 0.015, "q0t1": 0.005}
MAX_TRAINING_ROWS = 20_000
LEXICON = 400  # words kept for the lexicon feature, a top-k
RIDGE = 0.02
STEPS = 60
TOLERANCE = 1e-3
#: Upper edges of the feature bins.
EDGES = {
    "distinct": (0.05, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8),
    "symbols": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.2),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.3),
    "lexicon": (0.5, 1.5, 2.5, 4.5),
    "size": (4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0),
}
_ADDED = ("n_tokens", "domain", "rate", "expected_tokens", *[f"p_{d}" for d in TARGETS])
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
_SYMBOLS = "!#$%&*|"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def lexicon(sample: DataFrame, size: int = LEXICON) -> list[str]:
    """The words of the sample that stand almost only in toxic texts, most frequent first."""
    rows = sample.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("w"), "toxic")
    counted = rows.groupBy(_bare(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    top = counted.where("w <> '' and n >= 5 and t >= 0.8 * n").orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    return reduce(lambda a, e: a + (value > F.lit(e)).cast("int"), edges, F.lit(0))


def features(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and one bin column ``b_<feature>`` per feature."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    out = docs.withColumn("__words", _words(t)).withColumn("n_tokens", F.size("__words").cast("long"))
    distinct = F.array_distinct("__words")
    hits = F.size(F.array_intersect(F.transform(distinct, lambda w: F.trim(w, F.lit(".,!?:;%&*#$|"))), known))
    value = {
        "distinct": F.size(distinct) / F.greatest(F.col("n_tokens"), F.lit(1)),
        "symbols": (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))) / chars,
        "upper": (F.length(t) - F.length(F.translate(t, _UPPER, ""))) / chars,
        "lexicon": hits.cast("double"),
        "size": F.col("n_tokens").cast("double"),
    }
    return out.withColumns({f"b_{n}": _bin(v, EDGES[n]) for n, v in value.items()}).drop("__words")


def classifier(sample: DataFrame) -> dict[str, dict]:
    """Smoothed log probabilities of each domain and of each bin given the domain, from grouped counts."""
    names = [f"b_{n}" for n in EDGES]
    counts = sample.groupBy("domain", *names).count().collect()  # rows bounded by domains times bin combinations
    prior = {d: 1.0 for d in TARGETS}
    bins = {n: {d: [0.5] * (len(EDGES[n]) + 1) for d in TARGETS} for n in EDGES}
    for row in counts:
        if row["domain"] in prior:
            prior[row["domain"]] += row["count"]
            for n in EDGES:
                bins[n][row["domain"]][row[f"b_{n}"]] += row["count"]
    total = sum(prior.values())
    return {"prior": {d: v / total for d, v in prior.items()},
            "bins": {n: {d: [v / sum(own) for v in own] for d, own in by.items()} for n, by in bins.items()}}


def with_posterior(cells: DataFrame, model: dict) -> DataFrame:
    """Add ``p_<domain>`` to rows of bin columns."""
    def log_of(values: list[float], at: Column) -> Column:
        return F.get(F.array(*[F.lit(math.log(v)) for v in values]), at)

    parts = {f"__s_{d}": reduce(lambda a, n: a + log_of(model["bins"][n][d], F.col(f"b_{n}")), EDGES,
                                F.lit(math.log(p))) for d, p in model["prior"].items()}
    scored = cells.withColumns(parts).withColumn("__top", F.greatest(*parts))
    likely = scored.withColumns({n: F.exp(F.col(n) - F.col("__top")) for n in parts})
    whole = reduce(lambda a, n: a + F.col(n), parts, F.lit(0.0))
    return likely.withColumns({f"p_{n[4:]}": F.col(n) / whole for n in parts}).drop(*parts, "__top")


def solve(cells: DataFrame, targets: dict[str, float], steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """Add ``rate`` to rows of ``tokens`` and ``p_<domain>``.

    Minimises sum_k (S_k - T_k)^2 / (2 U_k) + ridge / 2 * sum tokens * (rate - 1)^2 with S_k = sum rate * tokens * p_k
    over rate >= 0. T_k is the target share of all tokens and U_k the same, but one thousandth of all at least.

    At the minimum rate = max(0, 1 - sum_k p_k y_k / ridge) with y_k = (S_k - T_k) / U_k, so only one number per domain
    is unknown. They minimise the convex function sum_k (U_k y_k^2 / 2 + T_k y_k) + ridge / 2 * sum tokens * rate^2,
    whose gradient is U_k y_k + T_k - S_k. Newton steps with halving go on until the gradient, in tokens, is at most
    ``TOLERANCE`` of each U_k. One aggregation per trial. Raises if ``steps`` trials are not enough.
    """
    names = list(targets)
    p = [F.col(f"p_{d}") for d in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not whole:
        return cells.withColumn("rate", F.lit(1.0))
    goal = np.array([targets[d] for d in names]) * whole / sum(targets.values())
    unit = np.maximum(goal, whole * 1e-3)

    def rate(y: np.ndarray) -> Column:
        pull = reduce(lambda a, v: a + v[0] * F.lit(float(v[1])), zip(p, y, strict=True), F.lit(0.0))
        return F.greatest(F.lit(0.0), 1.0 - pull / F.lit(ridge))

    def measure(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and second derivatives at ``y``."""
        r = F.col("rate")
        used = F.when(r > 0, F.col("tokens")).otherwise(0.0)
        row = cells.withColumn("rate", rate(y)).agg(
            F.sum(F.col("tokens") * r * r), *[F.sum(F.col("tokens") * r * v) for v in p],
            *[F.sum(used * p[i] * p[j]) for i, j in pairs]).first()
        sums = np.array(row[1:1 + len(names)], float)
        curve = np.diag(unit)
        for (i, j), v in zip(pairs, row[1 + len(names):], strict=True):
            curve[i, j] += v / ridge
            curve[j, i] = curve[i, j]
        return float((unit * y ** 2 / 2 + goal * y).sum() + ridge / 2 * row[0]), unit * y + goal - sums, curve

    y = np.zeros(len(names))
    value, slope, curve = measure(y)
    move, size = -np.linalg.solve(curve, slope), 1.0
    for _ in range(steps):
        if np.all(np.abs(slope) <= TOLERANCE * unit):
            return cells.withColumn("rate", rate(y))
        trial = measure(y + size * move)
        if trial[0] <= value + 1e-4 * size * float(slope @ move) or np.all(np.abs(trial[1]) <= TOLERANCE * unit):
            y = y + size * move
            value, slope, curve = trial
            move, size = -np.linalg.solve(curve, slope), 1.0
        else:
            size /= 2
    if np.all(np.abs(slope) <= TOLERANCE * unit):
        return cells.withColumn("rate", rate(y))
    raise RuntimeError(f"rates not found in {steps} steps: gradient {dict(zip(names, slope / unit, strict=True))}")


def mix(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        targets: dict[str, float] | None = None, limit: int = MAX_TRAINING_ROWS,
        with_text: bool = True) -> DataFrame:
    """The input's rows with ``n_tokens``, ``domain`` (likeliest), ``p_<domain>``, ``rate``, ``expected_tokens``.

    Null texts hold no tokens; they get the posterior of an empty text. Without labelled rows the posterior is even
    over domains. ``with_text=False`` leaves the text out. Rows with a null key are mixed but not learned from. Clashing columns are replaced.
    Runs jobs while the plan is built.
    """
    targets = targets or TARGETS
    docs = without(docs, _ADDED)
    named = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(
        F.col(key), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
        .alias("domain"))
    plain = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    sample = store(training_sample(plain, named, "domain", key, limit).repartition(12))
    words = lexicon(sample.withColumn("toxic", F.col("domain").endswith("t1").cast("int")))
    model = classifier(features(sample, words))
    bins = [f"b_{n}" for n in EDGES]
    measured = features(docs, words, text)
    measured = store(measured if with_text else measured.drop(text))
    summed = measured.groupBy(*bins).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    cells = store(with_posterior(store(summed.coalesce(1)), model))  # at most one row per bin combination
    p = [f"p_{d}" for d in TARGETS]
    rates = store(solve(cells, targets).select(*bins, *p, "rate"))
    best = F.greatest(*p)
    domain = reduce(lambda a, d: F.when(F.col(f"p_{d}") == best, d).otherwise(a), reversed(list(TARGETS)), F.lit(None))
    out = measured.join(F.broadcast(rates), bins)  # one row per bin combination at most
    return (out.drop(*bins).withColumn("domain", domain).withColumn("expected_tokens", F.col("rate") * F.col("n_tokens")))
