"""Exact nearest neighbours over a ball tree that is built and searched level by level.

A cell with more rows than a block is split around some of its own rows, each row joining the nearest; the next level
splits what is still too large. A query goes down to the one leaf it falls into; the centres on its way and the rows of that
leaf give its first bound. Queries and references are then cut, in the order of their leaves, into bands of a bounded number
of bytes. A pair of bands is compared unless their balls are too far apart for every query's bound; inside a pair the triangle
inequality drops a leaf for each query that it cannot improve.

The last ``codes`` numbers of a vector may be codes of categories. One stands for a vector of its own with a 1 at the place of
the code, or without any if it is negative, so a column of thousands of values costs one number per row.

No row carries a vector to every leaf that is open to it: a vector is sent once per open pair of bands, so where balls overlap,
as they do in high dimensions, the rows sent are those of a block join with bands of BAND_BYTES, although nearly all comparisons
are made; ``compared`` tells how many. The driver sees the number of cells to split and nothing else. A task holds one part of
a cell's rows and the cell's centres, or one band of queries and one of references.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.functions.order import rank_within, small_side, top_rows
from runsift.session import materialize

FAN = 16  # centres of a split
BLOCK_ROWS = 2048
PART_ROWS = 16_384  # rows of one cell that a task places
BAND_BYTES = 16 << 20  # vectors of one side that a task compares
CHUNK_CELLS = 4 << 20  # distances that a task holds at once
FEW_CODES = 32  # categories of a block that enter its matrix
STUCK = 0.9  # a cell that keeps this share of its parent's rows is left to the block comparison
SLACK = 1e-9


class Tree(NamedTuple):
    """``levels``: cell, child, center_id, center, radius. ``leaves``: ref_id, vec, cell. ``codes``: how many numbers are codes."""

    levels: list[DataFrame]
    leaves: DataFrame
    codes: int = 0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray, codes: int) -> np.ndarray:
    """Squared distances of rows, or of rows and one row."""
    n = a.shape[1] - codes
    x, y = a[:, n:], b[..., n:]
    return ((a[:, :n] - b[..., :n]) ** 2).sum(axis=1) + np.where(x == y, 0, (x >= 0) + 1 * (y >= 0)).sum(axis=1)


def _gaps(vectors: np.ndarray, centers: np.ndarray, codes: int) -> np.ndarray:
    return np.sqrt(np.stack([_squares(vectors, c, codes) for c in centers], axis=1))


def _middle(vectors: np.ndarray, codes: int) -> np.ndarray:
    """The mean of the numbers, without any category."""
    return np.append(vectors[:, :vectors.shape[1] - codes].mean(axis=0), np.full(codes, -1.0))


def _parted(rows: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Rows of the cells, dealt over parts of bounded size."""
    return rows.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))


def _every_part(centers: DataFrame) -> DataFrame:
    return centers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _place(codes: int):
    """The nearest centre of each row."""
    def run(rows: pa.Table, centers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"ref_id": rows["ref_id"], "vec": rows["vec"], "cell": rows["cell"], "child": rows["cell"], "gap": pa.array([], pa.float64())})
        gaps = _gaps(_matrix(rows["vec"]), _matrix(centers["center"]), codes)
        at = gaps.argmin(axis=1)
        return pa.table({"ref_id": rows["ref_id"], "vec": rows["vec"], "cell": rows["cell"],
                         "child": pa.array(centers["child"].to_numpy()[at]), "gap": pa.array(gaps[np.arange(len(at)), at])})
    return run


def build_tree(refs: DataFrame, codes: int = 0) -> Tree:
    """``refs``: ref_id, vec; different vectors of one length, of which the last ``codes`` numbers are codes."""
    id_type = dict(refs.dtypes)["ref_id"]
    done: list[DataFrame] = []
    levels: list[DataFrame] = []
    rows = materialize(refs.select("ref_id", "vec", F.lit(1).cast("long").alias("cell")))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > BLOCK_ROWS).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")))
    while large.count():
        done.append(rows.join(large, "cell", "left_anti"))
        split = _parted(rows, large, "ref_id")
        chosen = top_rows(split, [F.md5(F.col("ref_id").cast("string")), F.col("ref_id")], FAN, "__r", ["cell"])
        centers = materialize(chosen.select("cell", "parts", (F.col("cell") * FAN + F.col("__r") - 1).alias("child"),
                                            F.col("ref_id").alias("center_id"), F.col("vec").alias("center")))
        placed = materialize(split.groupBy("cell", "part").cogroup(_every_part(centers).groupBy("cell", "part")).applyInArrow(
            _place(codes), f"ref_id {id_type}, vec array<double>, cell long, child long, gap double"))
        balls = placed.groupBy("cell", "child").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
        levels.append(materialize(centers.drop("parts").join(balls, ["cell", "child"]).select(
            "cell", "child", "center_id", "center", "radius", "n")))
        rows = placed.select("ref_id", "vec", F.col("child").alias("cell"))
        before = large.select("cell", F.col("n").alias("__before"))
        large = materialize(levels[-1].join(before, "cell").where(
            (F.col("n") > BLOCK_ROWS) & (F.col("n") <= STUCK * F.col("__before"))).select(
            F.col("child").alias("cell"), "n", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    leaves = rows
    for part in done:
        leaves = leaves.unionByName(part)
    return Tree([x.drop("n") for x in levels], materialize(leaves) if levels else rows, codes)


def _enter(skip_same: bool, codes: int):
    """The nearest child of each query, and its best distance to a centre."""
    def run(queries: pa.Table, centers: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return queries.select(["query_id", "vec", "cell", "bound"])
        gaps = _gaps(_matrix(queries["vec"]), _matrix(centers["center"]), codes)
        at = gaps.argmin(axis=1)
        if skip_same:
            gaps[queries["query_id"].to_numpy()[:, None] == centers["center_id"].to_numpy()[None, :]] = np.inf
        return pa.table({"query_id": queries["query_id"], "vec": queries["vec"], "cell": pa.array(centers["child"].to_numpy()[at]),
                         "bound": pa.array(np.minimum(queries["bound"].to_numpy(), gaps.min(axis=1)))})
    return run


def _nearest(a: np.ndarray, b: np.ndarray, same: np.ndarray | None, codes: int) -> np.ndarray:
    """Distance of each row of ``a`` to the nearest row of ``b``; pairs marked ``same`` do not count."""
    n = a.shape[1] - codes
    middle = b[:, :n].mean(axis=0)
    high, low = a[:, :n] - middle, b[:, :n] - middle
    size = (low * low).sum(axis=1) + (b[:, n:] >= 0).sum(axis=1)
    many = []
    for k in range(n, n + codes):
        known = np.unique(b[:, k])
        known = known[known >= 0]
        if len(known) <= FEW_CODES:
            high, low = np.hstack([high, a[:, k, None] == known]), np.hstack([low, b[:, k, None] == known])
        else:
            many.append(k)
    scores = high @ (-2.0 * low.T)
    scores += size
    for k in many:
        # Two rows without a category have nothing in common.
        np.subtract(scores, 2.0, out=scores, where=a[:, k, None].astype(np.int32) == np.where(b[:, k] < 0, -2, b[:, k]).astype(np.int32))
    if same is not None:
        scores[same] = np.inf
    at = scores.argmin(axis=1)
    # The expanded form only finds the neighbour; the distance itself is taken directly.
    exact = np.sqrt(_squares(a, b[at], codes))
    exact[~np.isfinite(scores[np.arange(len(a)), at])] = np.inf
    return exact


def _compare(skip_same: bool, codes: int):
    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        if not queries.num_rows or not refs.num_rows:
            return pa.table({"query_id": queries["query_id"].slice(0, 0), "distance": pa.array([], pa.float64()),
                             "compared": pa.array([], pa.int64())})
        a, b = _matrix(queries["vec"]), _matrix(refs["vec"])
        same = queries["query_id"].to_numpy()[:, None] == refs["ref_id"].to_numpy()[None, :] if skip_same else None
        exact = _nearest(a, b, same, codes)
        return pa.table({"query_id": queries["query_id"], "distance": pa.array(exact), "compared": pa.array(np.full(len(a), len(b)))})
    return run


def block_nearest(queries: DataFrame, refs: DataFrame, cells: list[str], skip_same: bool, codes: int = 0) -> DataFrame:
    """Per query, the smallest distance among the references of its cells, and how many it was compared with.

    ``queries``: cells, query_id, vec. ``refs``: cells, ref_id, vec. Each cell is cut into blocks of about BLOCK_ROWS
    rows on both sides, so a hot cell becomes many small groups.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))

    sizes = blocks(queries, "nq").join(blocks(refs, "nr"), cells)

    def own(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = queries.join(sizes, cells).select(*cells, "query_id", "vec", own("query_id", "nq").alias("bq"), every("nr").alias("br"))
    right = refs.join(sizes, cells).select(*cells, "ref_id", "vec", own("ref_id", "nr").alias("br"), every("nq").alias("bq"))
    by = [*cells, "bq", "br"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _compare(skip_same, codes), f"query_id {dict(queries.dtypes)['query_id']}, distance double, compared long")
    return best.groupBy("query_id").agg(F.min("distance").alias("distance"), F.sum("compared").alias("compared"))


def _homes(queries: DataFrame, tree: Tree, skip_same: bool) -> DataFrame:
    """Each query with the leaf it falls into and its best distance to a centre on the way: query_id, vec, cell, bound."""
    id_type = dict(queries.dtypes)["query_id"]
    at = queries.withColumns({"cell": F.lit(1).cast("long"), "bound": F.lit(float("inf"))})
    for level in tree.levels:
        parts = at.join(level.select("cell").distinct(), "cell", "left_semi").groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
        moved = _parted(at, parts, "query_id").groupBy("cell", "part").cogroup(
            _every_part(level.join(parts.toDF("cell", "parts"), "cell")).groupBy("cell", "part")).applyInArrow(
            _enter(skip_same, tree.codes), f"query_id {id_type}, vec array<double>, cell long, bound double")
        at = materialize(moved.unionByName(at.join(level.select("cell"), "cell", "left_anti").select("query_id", "vec", "cell", "bound")))
    return at


def _banded(rows: DataFrame, key: str, size: int, band: str) -> DataFrame:
    """Rows numbered in the order of their leaves and cut into bands of ``size`` rows."""
    path = F.conv(F.col("cell").cast("string"), 10, FAN)
    return rank_within(rows, [path, F.col(key)], "__r").withColumn(band, F.floor((F.col("__r") - 1) / size)).drop("__r")


def _balls(rows: DataFrame, band: str, codes: int) -> DataFrame:
    """A ball around each band, with the largest bound in it: band, center, radius, bound."""
    def run(part: pa.Table) -> pa.Table:
        vectors = _matrix(part["vec"])
        middle = _middle(vectors, codes)
        return pa.table({band: part[band].slice(0, 1), "center": pa.array([middle.tolist()], pa.list_(pa.float64())),
                         "radius": [float(_gaps(vectors, middle[None, :], codes).max())], "bound": [float(part["bound"].to_numpy().max())]})

    return rows.groupBy(band).applyInArrow(run, f"{band} long, center array<double>, radius double, bound double")


def _compare_bands(skip_same: bool, codes: int):
    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        best = np.full(queries.num_rows, np.inf)
        compared = np.zeros(queries.num_rows, np.int64)
        if queries.num_rows and refs.num_rows:
            a, b = _matrix(queries["vec"]), _matrix(refs["vec"])
            asks, ids = queries["query_id"].to_numpy(), refs["ref_id"].to_numpy()
            home, bound = queries["cell"].to_numpy(), queries["bound"].to_numpy().copy()
            cells = refs["cell"].to_numpy()
            order = np.argsort(cells, kind="stable")
            for leaf in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                for piece in np.split(leaf, range(BLOCK_ROWS, len(leaf), BLOCK_ROWS)):
                    rows = b[piece]
                    middle = _middle(rows, codes)[None, :]
                    low = _gaps(a, middle, codes)[:, 0] - _gaps(rows, middle, codes).max()
                    still = np.flatnonzero((low <= bound + SLACK) & (home != cells[piece[0]]))
                    step = max(1, CHUNK_CELLS // len(piece))
                    for at in np.split(still, range(step, len(still), step)):
                        if not len(at):
                            continue
                        same = asks[at][:, None] == ids[piece][None, :] if skip_same else None
                        best[at] = np.minimum(best[at], _nearest(a[at], rows, same, codes))
                        bound[at] = np.minimum(bound[at], best[at])
                        compared[at] += len(piece)
        looked = pa.array(compared > 0)
        return pa.table({"query_id": queries["query_id"], "distance": pa.array(best), "compared": pa.array(compared)}).filter(looked)
    return run


def search(queries: DataFrame, tree: Tree, skip_same: bool = False) -> DataFrame:
    """``query_id``, ``distance`` (null without a neighbour) and ``compared``, the number of leaf rows looked at.

    ``queries``: query_id, vec, with different ids. ``skip_same``: a reference of the query's own id is no neighbour.
    """
    id_type = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", "vec")
    infinite = F.lit(float("inf"))
    if not tree.levels:
        found = block_nearest(asked.withColumn("cell", F.lit(1).cast("long")), tree.leaves, ["cell"], skip_same, tree.codes)
        return asked.select("query_id").join(found, "query_id", "left").select(
            "query_id", F.nullif("distance", infinite).alias("distance"), F.coalesce("compared", F.lit(0)).alias("compared"))
    home = _homes(asked, tree, skip_same)
    first = home.join(block_nearest(home, tree.leaves, ["cell"], skip_same, tree.codes), "query_id", "left").select(
        "query_id", "vec", "cell", F.least("bound", F.coalesce("distance", infinite)).alias("bound"),
        F.coalesce("compared", F.lit(0)).alias("__n"))
    size = max(BLOCK_ROWS, BAND_BYTES // (8 * tree.levels[0].select(F.size("center")).first()[0]))
    asking = _banded(first, "query_id", size, "qband")
    known = _banded(tree.leaves.withColumn("bound", F.lit(0.0)), "ref_id", size, "rband")
    left, right = _balls(asking, "qband", tree.codes).alias("q"), _balls(known, "rband", tree.codes).alias("r")
    # Middles have no categories.
    gap = F.sqrt(F.aggregate(F.zip_with("q.center", "r.center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = small_side(materialize(left.crossJoin(right).where(
        gap - F.col("q.radius") - F.col("r.radius") <= F.col("q.bound") + SLACK).select("qband", "rband")))
    by = ["qband", "rband"]
    more = asking.join(pairs, "qband").select(*by, "query_id", "vec", "cell", "bound").groupBy(*by).cogroup(
        known.join(pairs, "rband").select(*by, "ref_id", "vec", "cell").groupBy(*by)).applyInArrow(
        _compare_bands(skip_same, tree.codes), f"query_id {id_type}, distance double, compared long")
    found = more.groupBy("query_id").agg(F.min("distance").alias("distance"), F.sum("compared").alias("compared"))
    return asking.select("query_id", "bound", "__n").join(found, "query_id", "left").select(
        "query_id", F.nullif(F.least("bound", F.coalesce("distance", infinite)), infinite).alias("distance"),
        (F.col("__n") + F.coalesce("compared", F.lit(0))).alias("compared"))
