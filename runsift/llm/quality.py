"""Quality: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled texts of the training folds; every document is unlabelled web text. With class prior
``pi`` the risk is pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]) for logistic loss l. If the second part falls
below zero, a step is taken that raises it again instead of one that fits it further. g is additive over binned text
statistics, so the gradient is one sum per bin: every step is one aggregation over all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm import words as W
from runsift.llm.storage import store, without
from runsift.llm.toxicity import held_out

FEATURES = ("words", "word_length", "distinct", "top_word", "distinct_pairs", "distinct_lines", "upper", "digits",
            "marks", "symbols", "bars", "beyond_ascii")
BINS = 16
STEPS = 30
RIDGE = 1e-3
KNOT_ACCURACY = 10_000  # a bin edge is off by at most one part in this many of all rows
_LINE = bytes(b not in (10, 13) for b in range(256))


def _class(*spans: Iterable[int]) -> bytes:
    inside = {b for s in spans for b in s}
    return bytes(b in inside for b in range(256))


_CLASSES = (_class(range(0x41, 0x5B)), _class(range(0x30, 0x3A)), _class(b"!"), _class(b"#$%&*@^~=_<>"), _class(b"|"),
            _class(range(0x80, 0x100)))


def _variety(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    runs = np.diff(np.append(first, len(keys)))
    own = (keys[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, own, runs)
    return np.bincount(own, minlength=n).astype(float), top


def statistics(chunk: W.Chunk) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros."""
    n = chunk.rows
    size = np.diff(chunk.offsets)
    found = W.words(chunk, W.NON_BLANK)
    rows, count = W.row_of(found), np.diff(found.rows)
    some = np.maximum(count, 1)
    distinct, top = _variety(rows, found.hashes, n)
    first, pairs = W.windows(found, 2)
    pair_distinct, _ = _variety(rows[first], pairs, n)
    lines = W.words(chunk, _LINE)
    line_distinct, _ = _variety(W.row_of(lines), lines.hashes, n)
    length = np.bincount(rows, found.ends - found.starts, minlength=n) if len(rows) else np.zeros(n)
    columns = [np.log1p(count), length / some, distinct / some, top / some, pair_distinct / np.maximum(count - 1, 1),
               line_distinct / np.maximum(np.diff(lines.rows), 1)]
    for table in _CLASSES:
        sums = np.concatenate(([0], np.cumsum(W.look_up(chunk.data, table), dtype=np.int64)))
        columns.append((sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]) / np.maximum(size, 1))
    return np.stack(columns, axis=1).astype(np.float32)


def _measure(text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(c) for c in W.chunks(batch.column(text))]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(flat, pa.float32()))
            keep = [i for i in range(batch.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], lists], [*[batch.schema.names[i] for i in keep], "__f"])
    return run


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its statistics in ``__f``."""
    rest = docs.withColumn("__text", F.col(text).cast("string"))
    rest = rest.select(*[f"`{c}`" for c in rest.columns if c != text])
    schema = rest.drop("__text").withColumn("__f", F.expr("cast(null as array<float>)")).schema
    return rest.mapInArrow(_measure(len(rest.columns) - 1), schema)


def _cells(column: pa.Array, edges: np.ndarray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.stack([np.searchsorted(edges[f], x[:, f], side="left") + f * BINS for f in range(x.shape[1])], axis=1)


def _sums(shared):
    """Per bin: counts, sums of sigmoid and its slope over unlabelled rows, sums of sigmoid over positives; and losses."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, w, bias = shared.value
        size = len(w) + 1
        total = np.zeros((5, size))
        for batch in batches:
            cells = _cells(batch.column(0), edges)
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            g = bias + w[cells].sum(axis=1)
            s = 1 / (1 + np.exp(-g))
            for k, v in enumerate((s, s * (1 - s), positive, positive * s)):
                total[k, :-1] += np.bincount(cells.ravel(), np.repeat(v, cells.shape[1]), minlength=size - 1)
                total[k, -1] += v.sum()
            loss = np.logaddexp(0, g)
            total[4, 0] += len(g)
            total[4, 1] += loss.sum()
            total[4, 2] += (positive * loss).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])
    return run


class Model:
    def __init__(self, edges: np.ndarray, prior: float):
        self.edges, self.prior = edges, prior
        self.w = np.zeros(len(edges) * BINS)
        self.bias = float(np.log(prior / (1 - prior)))

    def step(self, totals: np.ndarray) -> None:
        """One damped step along the diagonal of the curvature."""
        s_u, h_u, p_all, p_s = totals[:4]
        n_u, loss_u, loss_p = totals[4, :3]
        n_p = p_all[-1]
        if not n_u or not n_p:
            return
        rest = loss_u / n_u - self.prior * loss_p / n_p
        gradient = s_u / n_u - self.prior * p_all / n_p
        if rest < 0:
            gradient = -(s_u / n_u - self.prior * p_s / n_p)
        gradient[:-1] += RIDGE * self.w
        move = gradient / (h_u / n_u + RIDGE) / (len(self.edges) / 3)
        move = np.clip(move, -1, 1)
        self.w -= move[:-1]
        self.bias -= move[-1]


def fit(measured: DataFrame, prior: float, steps: int = STEPS) -> Model:
    """``measured`` holds ``__f`` and ``positive`` for all documents."""
    quantiles = [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
    found = measured.agg(*[F.percentile_approx(F.get("__f", F.lit(i)), quantiles, KNOT_ACCURACY)
                           for i in range(len(FEATURES))]).first()  # over all rows
    edges = np.array([e or [0.0] * len(quantiles) for e in found], float)
    model = Model(edges, prior)
    spark = measured.sparkSession
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((model.edges, model.w, model.bias))
        rows = measured.select("__f", "positive").mapInArrow(_sums(shared), "at long, v double").groupBy("at").agg(
            F.sum("v").alias("v")).collect()  # five sums per bin
        totals = np.zeros((5, len(model.w) + 1))
        for r in rows:
            totals.ravel()[r["at"]] = r["v"]
        model.step(totals)
        shared.destroy()
    return model


def _scorer(shared, at: int, column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, w, bias = shared.value
        for batch in batches:
            g = bias + w[_cells(batch.column(at), edges)].sum(axis=1) if batch.num_rows else np.zeros(0)
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(1 / (1 + np.exp(-g)))],
                [*[batch.schema.names[i] for i in keep], column])
    return run


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          column: str = "score") -> DataFrame:
    """The input without its text, and the probability of label 1. Empty and null texts are scored like any text.

    Labels of held-out keys, null labels and null keys are never used. The class prior is the smoothed share of label 1
    among the training labels. With no positives every score is the prior. Runs jobs while the plan is built.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(
        F.col(key).alias("__key")).agg(F.max(label).alias("__y"))
    n_pos, n_all = usable.agg(F.sum("__y"), F.count("__y")).first()
    prior = ((n_pos or 0) + 1) / (n_all + 2)
    measured = store(measure(without(docs, [column]), text))
    known = store(usable.where("__y = 1").select("__key"))
    marked = store(measured.select("__f", F.col(key).alias("__key")).join(
        known.withColumn("positive", F.lit(True)), "__key", "left").select(
        "__f", F.coalesce("positive", F.lit(False)).alias("positive")))
    model = fit(marked, prior)
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.w, model.bias))
    schema = measured.drop("__f").withColumn(column, F.lit(0.0)).schema
    return measured.mapInArrow(_scorer(shared, measured.columns.index("__f"), column), schema)
