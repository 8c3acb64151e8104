"""Hard negatives by vertical scans: vectors lie column by column, and an anchor reads its largest dimensions first.

What the unread dimensions can still add lies between bounds taken from the least and greatest component of each
column. After every few columns, candidates whose bounds miss all wanted scores leave the bitmap. What is left after
the last column has its exact score.

Vectors lie in blocks of at most ``BLOCK`` rows and anchors in tiles of at most ``TILE``. Every tile meets every group
of blocks in one task of bounded size, so a hot label or a frequent vector is just more blocks. A task returns at most
``n_positives`` rows per anchor, then ``n_negatives`` rows per anchor and window; ranks are taken over those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.storage import store

BLOCK = 4096  # vectors in a block
TILE = 1024  # anchors in a tile
GROUP = 8  # blocks that one task reads per tile, about
STEP = 8  # columns read between two looks at the bounds
LARGEST = 1 << 27  # components saturate here, so that 512 products still add up exactly in 64 bits

_BLOCK_SCHEMA = "block long, keys binary, labels binary, columns array<binary>"


def _packer(rows: int):
    """Cut a partition, in its order, into blocks of columns; a shorter vector counts as padded with zeros."""
    def pack(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
        lists = batch.column(2)
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False)
        matrix = np.zeros((batch.num_rows, int(lengths.max(initial=0))), np.int32)
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = values
        return pa.RecordBatch.from_arrays(
            [pa.array([first], pa.int64()), *[pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
                                                       pa.binary()) for i in (0, 1)],
             pa.array([[np.ascontiguousarray(c).tobytes() for c in matrix.T]], pa.list_(pa.binary()))],
            ["block", "keys", "labels", "columns"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, have = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - have)
                waiting.append(part)
                have += part.num_rows
                batch = batch.slice(part.num_rows)
                if have == rows:
                    yield pack(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], number)
                    number, waiting, have = number + 1, [], 0
        if have:
            yield pack(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], number)
    return run


class _Block:
    def __init__(self, keys: bytes, labels: bytes, columns: Sequence[bytes]):
        self.keys, self.labels = np.frombuffer(keys, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.array([np.frombuffer(c, np.int32) for c in columns], np.int64).reshape(len(columns), len(self.keys))
        self.low, self.high = self.columns.min(1, initial=LARGEST), self.columns.max(1, initial=-LARGEST)


def scan(anchor: np.ndarray, block: _Block, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that no bound has ruled out, and their exact scores.

    ``keep(lower, upper)`` says which rows may still matter when their scores lie between the bounds.
    """
    dims = min(len(anchor), len(block.columns))
    order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
    a = anchor[order]
    ends = np.stack([a * block.low[order], a * block.high[order]])
    rest_low = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)
    rest_high = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
    partial = np.zeros(len(alive), np.int64)
    for at in range(0, dims, STEP):
        for k in range(at, min(at + STEP, dims)):
            partial += a[k] * block.columns[order[k]][alive]
        done = min(at + STEP, dims)
        stay = keep(partial + rest_low[done], partial + rest_high[done])
        if not stay.all():
            alive, partial = alive[stay], partial[stay]
        if not len(alive):
            break
    return alive, partial


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; a value below all scores when there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -(1 << 62)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((keys, -scores))[:k]


class _Top:
    """The first k of all rows seen so far: higher scores first, ties by smaller key."""

    def __init__(self, k: int):
        self.k, self.scores, self.keys = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.append(self.scores, scores), np.append(self.keys, keys)
        first = _best(scores, keys, self.k)
        self.scores, self.keys = scores[first], keys[first]

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else -(1 << 62)


def _positives(k: int):
    def search(anchor, key, label, _, blocks: Sequence[_Block]):
        top = _Top(k)
        for block in blocks:
            alive = np.flatnonzero((block.labels == label) & (block.keys != key))
            if len(alive):
                rows, scores = scan(anchor, block, alive, lambda low, high: high >= max(top.least, _kth(low, k)))
                top.add(scores, block.keys[rows])
        return [(0, top)]
    return search


def _negatives(k: int, low_pct: int, high_pct: int):
    def search(anchor, key, label, wanted: Sequence[int], blocks: Sequence[_Block]):
        # whole numbers n with low_pct * s <= 100 * n <= high_pct * s
        windows = [(-(-low_pct * s // 100), high_pct * s // 100, s, _Top(k)) for s in wanted]
        windows = [w for w in windows if w[0] <= w[1]]

        def keep(low, high):
            stay = np.zeros(len(low), bool)
            for first, last, _, top in windows:
                certain = low[(low >= first) & (high <= last)]
                stay |= (high >= max(first, top.least, _kth(certain, k))) & (low <= last)
            return stay

        for block in blocks if windows else ():
            alive = np.flatnonzero(block.labels != label)
            if len(alive):
                rows, scores = scan(anchor, block, alive, keep)
                for first, last, _, top in windows:
                    inside = (scores >= first) & (scores <= last)
                    top.add(scores[inside], block.keys[rows[inside]])
        return [(s, top) for _, _, s, top in windows]
    return search


def _task(search):
    """Every anchor of a tile against a group of blocks."""
    def run(anchors: pa.Table, group: pa.Table) -> pa.Table:
        blocks = [_Block(*[group.column(c)[i].as_py() for c in ("keys", "labels", "columns")]) for i in range(group.num_rows)]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for key, label, ints, wanted in zip(*[anchors.column(c).to_pylist() for c in ("key", "label", "ints", "wants")],
                                            strict=True):
            for about, top in search(np.array(ints, np.int64), key, label, wanted or [], blocks):
                n = len(top.keys)
                for column, values in zip(out, (np.full(n, key), np.full(n, about), top.keys, top.scores), strict=True):
                    column.append(values)
        names = ["anchor_id", "about", "found_id", "score"]
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(names, out, strict=True)},
                        schema=pa.schema([(c, pa.int64()) for c in names]))
    return run


def _search(anchors: DataFrame, n_anchors: int, blocks: DataFrame, n_blocks: int, search) -> DataFrame:
    """Tiles of anchors meet groups of blocks: both sides are copied, so a task holds one tile and one group."""
    tiles, groups = max(1, -(-n_anchors // TILE)), max(1, -(-n_blocks // GROUP))
    left = anchors.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(
        _task(search), "anchor_id long, about long, found_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of what the tasks found; Spark keeps k rows per key before the exchange."""
    order = Window.partitionBy("anchor_id", "about").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         n_positives: int = 5, n_negatives: int = 10, low_pct: int = 30, high_pct: int = 90, scale: int = 256) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the key column, named ``key`` there. Components are ``floor(scale * x)``, scores are
    whole inner products; higher scores come first, ties by smaller key. Positives are the first ``n_positives`` other
    rows of the anchor's label. Negatives are the first ``n_negatives`` rows of other labels with ``low_pct *
    positive_score <= 100 * negative_score <= high_pct * positive_score``; a positive of negative score has none.

    Left out are rows with a null key, label or vector, or with a null or non-finite component. Rows that repeat a key
    count once, with the least label and vector. Vectors of different lengths meet as if padded with zeros.
    Components beyond ``LARGEST`` in size are set to it. An empty table gives no rows. Other columns are not read.
    """
    ints = F.transform(F.col(vector), lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)),
                                                          F.lit(-LARGEST)).cast("int"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    clean = store(
        rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), ints.alias("ints"))
        .groupBy("key").agg(F.min(F.struct("label", "ints")).alias("row")).select("key", "row.*"))
    n_rows = clean.count()
    blocks = store(clean.repartitionByRange(max(1, -(-n_rows // BLOCK)), "label", "key").sortWithinPartitions("label", "key")
                   .mapInArrow(_packer(BLOCK), _BLOCK_SCHEMA))
    asked = clean.where(anchors).withColumn("wants", F.lit(None).cast("array<long>"))
    n_anchors, n_blocks = asked.count(), blocks.count()
    positives = store(_ranked(_search(asked, n_anchors, blocks, n_blocks, _positives(n_positives)), n_positives).select(
        "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wants = positives.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("wants"))
    again = asked.drop("wants").join(wants, F.col("key") == F.col("anchor_id")).drop("anchor_id")
    found = _ranked(_search(again, n_anchors, blocks, n_blocks, _negatives(n_negatives, low_pct, high_pct)), n_negatives)
    return positives.join(found.select("anchor_id", F.col("about").alias("positive_score"), "rank", F.col("found_id").alias(
        "negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
