"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training runs in shards: in every epoch each shard goes through its own labelled texts one by one with per-coordinate
learning rates, starting from the broadcast state, and the changes of a coordinate are averaged over the shards that
touched it. Coordinates of fewer than ``MIN_ROWS`` training rows are left out. The L1 term leaves few weights other than zero, and only those are broadcast for scoring. The state has at
most 2**bits coordinates, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm import words as W
from runsift.llm.storage import store, without

BITS = 18
SHARDS = 6
EPOCHS = 6
MAX_TRAINING_ROWS = 24_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1.5, 1.0
MIN_ROWS = 3  # training rows that must hold a coordinate before it can get a weight
SKIP = (1, 2)  # distance of the second word of a pair: neighbours, and over one word


def features(chunk: W.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every word, word pair and skip pair, in no order and with repeats."""
    found = W.words(chunk, W.ALNUM)
    rows = W.row_of(found)
    h = found.hashes
    out_rows, out = [rows], [W.mix(h + np.uint64(1))]
    for step in SKIP:
        if len(h) > step:
            same = rows[:-step] == rows[step:]
            pair = h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:] * np.uint64(2 * step + 1)
            out_rows.append(rows[:-step][same])
            out.append(W.mix(pair[same]))
    return np.concatenate(out_rows), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


def _present(rows: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort((rows.astype(np.int64) << bits) | at)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both >> bits, both & ((1 << bits) - 1)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _counter(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for chunk in W.chunks(batch.column(0)):
                total += np.bincount(_present(*features(chunk, bits), bits)[1], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "rows"])
    return run


def _epoch(shared, bits: int, turn: int):
    """One pass over a shard: changes of z and n at the coordinates it touched. The last coordinate is the bias."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << bits) + 1
        z, n = np.zeros(size), np.zeros(size)
        at, z_at, n_at, allowed, weight = shared.value
        z[at], n[at] = z_at, n_at
        z_old, n_old, touched = z.copy(), n.copy(), np.zeros(size, bool)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in W.chunks(batch.column(0)):
                rows, idx = features(chunk, bits)
                rows, idx = _present(rows[allowed[idx]], idx[allowed[idx]], bits)
                cut = np.searchsorted(rows, np.arange(chunk.rows + 1))
                for r in np.random.default_rng(turn).permutation(chunk.rows):
                    own = np.append(idx[cut[r]:cut[r + 1]], size - 1)
                    w = _weights(z[own], n[own])
                    y = labels[chunk.first + r]
                    g = (_sigmoid(w.sum()) - y) * (weight if y else 1.0)
                    root = np.sqrt(n[own])
                    n[own] += g * g
                    z[own] += g - (np.sqrt(n[own]) - root) / ALPHA * w
                    touched[own] = True
        where = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where), pa.array(z[where] - z_old[where]), pa.array(n[where] - n_old[where])], ["at", "dz", "dn"])
    return run


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", bits: int = BITS, shards: int = SHARDS,
          epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights other than zero; ``labelled`` should hold a bounded number of rows.

    Rows with a null label are left out. With no rows, the model is empty and every score is 0.5.
    """
    rows = store(labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("double").alias("y"))
        .repartition(shards))
    spark = labelled.sparkSession
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    n_pos, n_all = rows.agg(F.sum("y"), F.count("y")).first()
    weight = max(1.0, ((n_all - n_pos) / n_pos) ** 0.5) if n_pos else 1.0  # half-way to balanced classes
    seen = rows.mapInArrow(_counter(bits), "at long, rows long").groupBy("at").agg(F.sum("rows").alias("rows"))
    allowed = np.zeros(1 << bits, bool)
    allowed[seen.where(F.col("rows") >= MIN_ROWS).select("at").toArrow()["at"].to_numpy()] = True
    for turn in range(epochs):
        at = np.flatnonzero(n)
        shared = spark.sparkContext.broadcast((at, z[at], n[at], allowed, weight))
        moved = rows.mapInArrow(_epoch(shared, bits, turn), "at long, dz double, dn double").groupBy("at").agg(
            F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toArrow()  # packed columns, no row objects in the driver
        where = moved["at"].to_numpy()
        z[where] += moved["dz"].to_numpy()
        n[where] += moved["dn"].to_numpy()
        shared.destroy()
    w = _weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def _scorer(shared, bits: int, text: int, column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = weights
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for chunk in W.chunks(batch.column(text)):
                rows, idx = features(chunk, bits)
                used = dense[idx] != 0
                rows, idx = _present(rows[used], idx[used], bits)
                scores[chunk.first:chunk.first + chunk.rows] = dense[-1] + np.bincount(
                    rows, dense[idx], minlength=chunk.rows)
            keep = [i for i in range(batch.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(_sigmoid(scores))],
                [*[batch.schema.names[i] for i in keep], column])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", bits: int = BITS,
          column: str = "score") -> DataFrame:
    """Add the probability of label 1; an empty or null text gets the model's base rate. A clashing column is replaced."""
    out = without(docs, [column]).withColumn("__text", F.col(text).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = out.drop("__text").withColumn(column, F.lit(0.0)).schema
    return out.mapInArrow(_scorer(shared, bits, len(out.columns) - 1, column), schema)


def held_out(key: str = "doc_id"):
    """Rows whose label is never learned."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id",
                    limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold, in hash order, with their texts.

    The bound makes the broadcast of the sampled keys safe. Null keys, labels and repeated label rows are left out.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(key).agg(F.max(label).alias("__label"))
        .orderBy(F.xxhash64(key), key).limit(limit)
    )
    named = chosen.select(F.col(key).alias("__key"), "__label")
    return docs.join(F.broadcast(named), docs[key] == F.col("__key")).select(
        F.col("text"), F.col("__label").alias(label))


def fit_from_tables(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS):
    return train(training_sample(docs, labels, "toxic", limit=limit))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Leave out documents scored at the threshold or above; columns stay as they are."""
    scored = score(docs.withColumn("__kept", F.col("text")), fit_from_tables(docs, labels), "__kept", column="__score")
    return scored.where(F.col("__score") < threshold).select(*[f"`{c}`" for c in docs.columns])
