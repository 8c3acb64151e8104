"""Near-duplicate vectors: spherical-cap filters from structured random product codes, joined on filters, verified.

A filter is a rotation and a direction made of one code word per block of coordinates. A vector passes the filters whose
direction its rotated form meets at ``alpha`` or more. They are decoded block by block: a word of the first block that
cannot reach ``alpha`` with the best word of the second is cut before that block is looked at. The cap gets narrower and
the words more as the table grows, so that about ``BUCKET`` unrelated vectors pass a filter. Under a uniformly random
rotation every pair at the threshold has the same chance to share a filter, whatever its direction, and rotations are
independent; so that chance is measured on drawn pairs and the number of rotations follows from ``RECALL``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm import words as W
from runsift.llm.links import components
from runsift.llm.storage import store

BUCKET = 8
RECALL = 0.99995
PASSED = 2  # filters of one rotation that a vector passes on average
CHANCE = 0.05  # caps are widened until a pair at the threshold shares a filter of one rotation this often
HOT = 2048  # rows of a filter that one task compares with each other; more are cut into blocks
SEED = 7


def _tail(height: float, dims: int) -> float:
    """Share of the unit sphere that meets a fixed direction at ``height`` or more."""
    def area(top: float) -> float:
        t = (np.arange(4000) + 0.5) * top / 4000
        return float((np.sin(t) ** max(dims - 2, 0)).sum()) * top / 4000
    return area(math.acos(height)) / area(math.pi)


class Filters:
    """Code words per block, cap height and rotations, for ``n`` vectors of ``dims`` coordinates."""

    def __init__(self, n: int, dims: int, cosine: float):
        draw = np.random.default_rng(SEED)
        self.blocks = min(2, dims)
        self.cuts = np.linspace(0, dims, self.blocks + 1).astype(int)
        share, self.chance = min(0.05, BUCKET / max(n, 1)) / 2, 0.0
        while self.chance < CHANCE and share < 0.5:
            share = min(0.5, 2 * share)
            self._draw_codes(draw, share, dims)
            self.chance = self._measured(draw, dims, cosine)
        if self.chance <= 0:
            raise ValueError(f"vectors at cosine {cosine} hardly ever share a filter")
        count = max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-min(self.chance, 1 - 1e-9))))
        self.turns = []
        for _ in range(count):
            q, r = np.linalg.qr(draw.standard_normal((dims, dims)))
            self.turns.append(q * np.sign(np.diag(r)))

    def _draw_codes(self, draw: np.random.Generator, share: float, dims: int) -> None:
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if _tail(mid, dims) > share else (low, mid)
        self.alpha = low
        self.words = max(2, math.ceil((PASSED / share) ** (1 / self.blocks)))
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = draw.standard_normal((self.words, b - a))
            # A block's share of the direction's length follows its number of coordinates.
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dims))

    def _measured(self, draw: np.random.Generator, dims: int, cosine: float) -> float:
        """Chance, less three standard errors, that a pair at the threshold shares a filter of one rotation."""
        x, z = draw.standard_normal((2, 4096, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(z, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine ** 2)) * z / length if dims > 1 else x
        each = self.words ** self.blocks
        (r, f), (q, g) = self._passed(x), self._passed(y)
        p = len(np.unique(np.intersect1d(r * each + f, q * each + g) // each)) / len(x)
        return p - 3 * math.sqrt(p * (1 - p) / len(x))

    def _passed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filters of one rotation, for rotated vectors."""
        rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(x), 64):
            part = x[low:low + 64]
            scores = [part[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
            rest = sum((s.max(axis=1) for s in scores[1:]), np.zeros(len(part)))
            r, f = np.nonzero(scores[0] >= self.alpha - rest[:, None])
            total = scores[0][r, f]
            for s in scores[1:]:
                total = total[:, None] + s[r]
                k, w = np.nonzero(total >= self.alpha)
                r, f, total = r[k], f[k] * self.words + w, total[k, w]
            rows.append(r + low)
            filters.append(f)
        return np.concatenate(rows), np.concatenate(filters)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Ids of all filters that each unit vector passes, in rising order."""
        rows, ids = [], []
        for t, turn in enumerate(self.turns):
            r, f = self._passed(x @ turn)
            rows.append(r)
            ids.append(f + t * self.words ** self.blocks)
        row, found = np.concatenate(rows), np.concatenate(ids)
        order = np.lexsort((found, row))
        return np.split(found[order], np.searchsorted(row[order], np.arange(1, len(x)))) if len(x) else []


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / norm, norm


def _fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dimension (0 for a vector that links with nothing) and two 64-bit prints of the scaled direction."""
    for batch in batches:
        dims, one, two = [], [], []
        for v in batch.column(1):
            x = np.array([np.nan if c is None else c for c in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
            good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(np.any(x))
            dims.append(len(x) if good else 0)
            bits = (x + 0.0).view(np.uint64) if good else np.zeros(0, np.uint64)
            place = W.mix(np.arange(1, len(bits) + 1, dtype=np.uint64))
            one.append(int(W.mix(bits ^ place).sum(dtype=np.uint64).view(np.int64)))
            two.append(int(W.mix(bits + place).sum(dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(one, pa.int64()),
             pa.array(two, pa.int64())], ["id", "v", "dims", "f1", "f2"])


def _decoder(filters: Filters):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = filters.decode(_unit(part.column(1))[0])
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["id", "v", "filters"])
    return run


def _shares_earlier(a: list[np.ndarray], b: list[np.ndarray], now: int) -> np.ndarray:
    """Whether two rows have a common filter before ``now``, where the pair was already reported."""
    ids = np.unique(np.concatenate([*a, *b]))
    ids = ids[ids < now]

    def present(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(ids)), np.float32)
        for r, own in enumerate(rows):
            out[r, np.searchsorted(ids, own[own < now])] = 1
        return out

    return present(a) @ present(b).T > 0


def _compare(cosine: float):
    def pairs(now: int, left: int, right: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side = rows["own"].to_numpy()
        ids = rows["id"].to_numpy()
        x = _unit(rows["v"].combine_chunks())[0]
        lists = [np.array(v, np.int64) for v in rows["filters"].to_pylist()]
        for i in np.array_split(np.flatnonzero(side == left), max(1, (side == left).sum() // 512)):
            for j in np.array_split(np.flatnonzero(side == right), max(1, (side == right).sum() // 512)):
                if not len(i) or not len(j):
                    continue
                near = x[i] @ x[j].T >= cosine
                near &= ids[i][:, None] < ids[j][None, :] if left == right else True
                if near.any():
                    near &= ~_shares_earlier([lists[k] for k in i], [lists[k] for k in j], now)
                p, q = np.nonzero(near)
                if len(p):
                    a, b = ids[i][p], ids[j][q]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (filter, left, right); a group is handled when the next one begins."""
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
                if a == b:
                    continue
                now = tuple(int(v) for v in keys[a])
                if key is not None and now != key:
                    yield from pairs(*key, pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(*key, pa.Table.from_batches(held))
    return run


def _candidates(reps: DataFrame, filters: Filters, cosine: float) -> DataFrame:
    """Verified pairs of class representatives of one dimension."""
    coded = store(reps.mapInArrow(_decoder(filters), "id long, v array<double>, filters array<long>"))
    posted = store(coded.select("id", F.explode("filters").alias("filter")))
    sizes = store(posted.groupBy("filter").count().where("count > 1"))
    parts = F.ceil(F.col("count") / F.lit(HOT)).cast("int")
    placed = posted.join(sizes, "filter").withColumn("parts", parts).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A filter of one part stays one row; rows of a larger one meet every part once.
    dealt = placed.select("id", "filter", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keyed = dealt.select("filter", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                         "own", "id")
    whole = keyed.join(coded, "id").select("filter", "left", "right", "own", "id", "v", "filters")
    return whole.repartition("filter", "left", "right").sortWithinPartitions("filter", "left", "right").mapInArrow(
        _compare(cosine), "a long, b long")


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per input row: ``key``, ``n_links``, ``component_id`` (smallest key reachable), ``kept``.

    Two vectors are linked if their cosine, in double precision, is ``cosine`` or more. Vectors of different lengths,
    null, empty or zero vectors and vectors with null or non-finite components link with nothing. Equal vectors are one
    class, so thousands of copies are compared once. A null key stays unlinked. Rows with one key count as one vector
    each and link with each other if they are near. Other columns are ignored. Runs jobs while the plan is built.
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    made = store(rows.mapInArrow(_fingerprint, "id long, v array<double>, dims int, f1 long, f2 long"))
    usable = made.where("dims > 0 and id is not null")
    classes = store(usable.groupBy("dims", "f1", "f2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")).withColumn(
        "no", F.monotonically_increasing_id()))
    vectors = usable.join(classes.withColumnRenamed("rep", "id"), ["dims", "f1", "f2", "id"]).dropDuplicates(["no"])
    vectors = store(vectors.select("dims", F.col("no").alias("id"), "v"))
    links = None
    for row in vectors.groupBy("dims").count().collect():  # one row per vector length
        own = vectors.where(F.col("dims") == row["dims"]).select("id", "v")
        found = _candidates(own, Filters(row["count"], row["dims"], cosine), cosine)
        links = found if links is None else links.union(found)
    if links is None:
        links = vectors.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    links = store(links)
    sized = classes.select("no", "rep", "members")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = store(both.join(sized.withColumnRenamed("no", "b"), "b").groupBy("a").agg(F.sum("members").alias("others")))
    named = links.join(sized.select(F.col("no").alias("a"), F.col("rep").alias("ra")), "a").join(
        sized.select(F.col("no").alias("b"), F.col("rep").alias("rb")), "b")
    roots = store(components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    result = store(classes.join(linked.withColumnRenamed("a", "no"), "no", "left").join(
        roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "dims", "f1", "f2", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n"),
        F.coalesce("root", "rep").alias("root")))
    known = made.select("id", "dims", "f1", "f2").join(result, ["dims", "f1", "f2"], "left")
    counts = F.col("id").isNotNull()
    return known.select(
        F.col("id").alias(key), F.when(counts, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(counts, F.coalesce("root", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
