"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact check.

1. Every text becomes its set of word shingles (63-bit hashes); documents with equal sets are one class.
2. A class keeps the k smallest hashes. How many of them two similar sets have in common follows a hypergeometric
   law, whose lower bound (``_least_common``) is missed with a chance below 1e-5. Of each sketch only the rarest values
   are listed: as many as still guarantee one common listed value. Frequent shingles are thereby never listed by texts
   that hold rarer ones.
3. Inverted lists of these values propose pairs. A list first pairs its members with one hub, then with more and more;
   links found merge classes into components, and only members of different components are paired. What is left after
   the hubs is paired in full, so a group of thousands of copies costs a few comparisons a member and no link between
   two components is lost.
4. The union sketch of a pair estimates its similarity, from more values than are listed, since these cost no list
   rows; what passes is compared on the full sets. In the last round 512 bits of parity per document are a condition of
   the join: where more bits differ than the sketches may have values apart, the estimate would fail as well.
5. Sketches and full sets are sent only for documents of a pair. These are picked by a filter of fixed size that all
   tasks hold, so neither texts nor sets go through an exchange for pairs that they are not part of.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm import frequent
from runsift.llm import words as W
from runsift.llm.links import components
from runsift.llm.storage import store, without

SKETCH = 64
ESTIMATE = 256  # values of a union sketch
MARKS = [f"g{j}" for j in range(8)]  # columns of 64 parity bits each
SAFE = 4.5  # standard deviations that a bound lies below its mean
HUBS = (1, 16)  # expected hubs of a list, round by round, before all that is left is paired


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer than ``width`` words make one shingle, no word makes none."""
    for chunk in W.chunks(column):
        found = W.words(chunk, W.NON_BLANK)
        first, hashes = W.windows(found, width)
        hashes = (hashes >> np.uint64(1)).astype(np.int64)
        cut = np.searchsorted(first, found.rows)
        for r in range(chunk.rows):
            own = hashes[cut[r]:cut[r + 1]]
            n = int(found.rows[r + 1] - found.rows[r])
            if 0 < n < width:
                part = W.Words(found.hashes[found.rows[r]:found.rows[r + 1]], found.starts, found.ends,
                               np.array([0, n]))
                own = (W.windows(part, n)[1] >> np.uint64(1)).astype(np.int64)
            own = np.sort(own)
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _marks(sketches: list[np.ndarray]) -> np.ndarray:
    """For each sorted sketch, how many of its distinct values fall on each bit, modulo 2: eight words a row."""
    width, out = 64 * len(MARKS), []
    for low in range(0, len(sketches), 1024):
        part = sketches[low:low + 1024]
        flat = np.concatenate(part).astype(np.int64)
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        new = np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))[:len(flat)]
        bit = (W.mix(flat.view(np.uint64)) % np.uint64(width)).astype(np.int64)
        odd = np.bincount((row * width + bit)[new], minlength=len(part) * width) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, len(MARKS)))
    return np.concatenate(out) if out else np.zeros((0, len(MARKS)), np.int64)


def _sketcher(width: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, kept, wide = [], [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                bits = own.view(np.uint64)
                sizes.append(len(own))
                one.append(int(W.mix(bits + np.uint64(0x51)).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(W.mix(bits ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                kept.append(own[:k].copy())
                wide.append((own[:ESTIMATE] >> 32).astype(np.int32))  # the upper 31 bits keep the order
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 _lists(kept), _lists(wide, np.int32), *[pa.array(c) for c in _marks(wide).T.copy()]],
                ["id", "n", "f1", "f2", "sketch", "wide", *MARKS])
    return run


def _id_hashes(ids: pa.Array) -> np.ndarray:
    return W.mix(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64))


def _packed_ids(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield frequent.pack(_id_hashes(batch.column(0)), bits, 1)
    return run


def _passing(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.likely(_id_hashes(batch.column(0)))))
    return run


def _setter(shared, width: int):
    only = _passing(shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in only(batches):
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(list(shingle_sets(part.column(1), width)))], ["id", "shingles"])
    return run


def _members(pairs: DataFrame, bits: int):
    """A filter of the ids of all pairs, as a broadcast. It may let a few others pass."""
    ids = pairs.select("a").union(pairs.select("b"))  # each block holds an id once
    learned = frequent.Filter(bits).learn(ids.mapInArrow(_packed_ids(bits), frequent.KEY_BLOCKS), 1)
    return pairs.sparkSession.sparkContext.broadcast(learned)


def _least_common(whole, largest, k: int, pct: int):
    """Of k smallest values, how many are common at the least if the similarity reaches ``pct`` per cent.

    ``largest`` bounds the size of the sets the sketch is drawn from; up to k values the sketch is the whole set, and
    the share of ``whole`` holds exactly. Beyond, the count is hypergeometric.
    """
    exact = F.ceil(whole * pct / 100)
    spread = k * pct * (100 - pct) / 1e4 * (largest - k) / F.greatest(largest - 1, F.lit(1))
    drawn = F.floor(k * pct / 100 - SAFE * F.sqrt(spread))
    return F.when(largest <= k, exact).otherwise(F.greatest(F.lit(1), F.least(exact, drawn)))


def _listed(sketches: DataFrame, k: int, pct: int) -> DataFrame:
    """The rarest values of each sketch that can decide a pair: value, id, n, and 32 bits of the values listed before it."""
    rows = sketches.select("id", "n", F.explode("sketch").alias("value"))
    shared = store(rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    needed = _least_common(F.col("n"), F.floor(F.col("n") * 100 / pct), k, pct)
    per_id = (
        rows.join(shared.hint("shuffle_hash"), "value")
        .groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("common"))
        .withColumn("take", (F.size("common") - needed + 1).cast("int"))
        .where("take > 0")
        .withColumn("listed", F.transform(F.slice("common", F.lit(1), F.greatest("take", F.lit(0))), lambda c: c["value"]))
    )
    short = F.transform("listed", lambda v: F.shiftright(F.shiftleft(v, 32), 32).cast("int"))
    return store(per_id.select("id", "n", short.alias("short"), F.posexplode("listed").alias("at", "value"))
                 .select("value", "id", "n", F.slice("short", F.lit(1), F.col("at")).alias("prior")))


def _close_in_size(pct: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * pct


def _hubs(lists: DataFrame, number: int) -> DataFrame:
    """Hubs of each list: its smallest id, or about ``number`` members by a hash of the id."""
    if number == 1:
        first = F.struct("id", "n", "root")
        return lists.groupBy("value").agg(F.min(first).alias("h")).select("value", "h.*")
    sizes = store(lists.groupBy("value").agg(F.count(F.lit(1)).alias("members")))
    chance = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << 20)) * F.col("members")
    return lists.join(sizes, "value").where(chance < number << 20).select("value", "id", "n", "root")


def _pairs_with_hub(lists: DataFrame, pct: int, number: int) -> DataFrame:
    """Pair each member with those hubs of its list that lie in another component."""
    hubs = store(_hubs(lists, number).select(
        "value", F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("root").alias("rh")))
    whose = F.col("id") != F.col("hub")
    pairs = lists.join(hubs, "value").where("root <> rh").where(whose).select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"),
        F.least("n", "nh").alias("na"), F.greatest("n", "nh").alias("nb"))
    return pairs.where(_close_in_size(pct)).distinct()


def _marked(pairs: DataFrame, marks: DataFrame, pct: int) -> DataFrame:
    """Pairs that their marks let pass."""
    for side in "ab":
        pairs = pairs.join(marks.select(F.col("id").alias(side), *[F.col(g).alias(g + side) for g in MARKS]), side)
    return pairs.where(_may_be_likely(pct)).select("a", "b", "na", "nb")


def _likely(pct: int):
    """Whether the union sketch of ``sa`` and ``sb`` lets a pair of sizes ``na`` and ``nb`` reach ``pct``."""
    both, largest = F.array_intersect("sa", "sb"), F.floor(F.least("na", "nb") * 100 / pct)
    possible = F.size(both) >= _least_common(F.greatest(F.size("sa"), F.size("sb")), largest, ESTIMATE, pct)
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, ESTIMATE)
    return possible & (F.size(F.array_intersect(union, both)) >= _least_common(F.size(union), largest, ESTIMATE, pct))


def _may_be_likely(pct: int):
    """Whether so few marks differ that the sketches of a pair may have as many values in common as ``_likely`` asks.

    A value that only one sketch holds turns one bit, so no more bits differ than the sketches have values apart.
    """
    size_a, size_b = (F.least(n, F.lit(ESTIMATE)) for n in ("na", "nb"))
    largest = F.floor(F.least("na", "nb") * 100 / pct)
    apart = size_a + size_b - 2 * _least_common(F.greatest(size_a, size_b), largest, ESTIMATE, pct)
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(g + "a").bitwiseXOR(F.col(g + "b"))) for g in MARKS]) <= apart


def _pairs_across(lists: DataFrame, marks: DataFrame, pct: int) -> DataFrame:
    """Pairs of one list whose members lie in different components, in the first list that they share."""
    mixed = store(lists.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                  .where("lo < hi").select("value"))
    wide = lists.join(mixed, "value", "left_semi").join(marks, "id")
    sides = [wide.select("value", *[F.col(c).alias(new + side) for c, new in (
        ("id", ""), ("n", "n"), ("root", "r"), ("prior", "p"))], *[F.col(g).alias(g + side) for g in MARKS]) for side in "ab"]
    return (sides[0].join(sides[1], "value").where("a < b and ra <> rb").where(_close_in_size(pct))
            .where(_may_be_likely(pct)).where(~F.arrays_overlap("pa", "pb")).select("a", "b", "na", "nb"))


def _across(lists: DataFrame) -> tuple[int, int]:
    """How many pairs ``_pairs_across`` would compare at most, and the rows of the lists."""
    by_root = lists.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c"))
    per_list = by_root.groupBy("value").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    row = per_list.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.sum("m")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _estimated(pairs: DataFrame, made: DataFrame, pct: int, bits: int) -> DataFrame:
    """Pairs that their union sketches let pass."""
    shared = _members(pairs, bits)
    wide = made.where("n > 0 and id is not null").select("id", "wide").mapInArrow(_passing(shared), "id long, wide array<int>")
    a, b = (wide.select(F.col("id").alias(x), F.col("wide").alias("s" + x)) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_likely(pct)).select("a", "b")


def _links(likely: DataFrame, texts: DataFrame, width: int, pct: int, bits: int) -> DataFrame:
    """Compare full sets."""
    sets = store(texts.where("id is not null").mapInArrow(_setter(_members(likely, bits), width), "id long, shingles array<long>"))
    fa = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    fb = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return (likely.join(fb, "b").join(fa, "a").withColumn("i", inter)
            .where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * pct).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5,
                    similarity_pct: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable by links), ``kept``.

    Two documents are linked if 100 * |A & B| >= similarity_pct * |A | B| on their sets of ``width``-word shingles.
    ``similarity_pct`` must be at least 50, for which the bounds are safe. Null, empty and wordless texts have no
    shingle and are linked with nothing. Rows with one key are one document. A null key is never linked: its
    component is null and it is kept. Other columns of the input are ignored.
    """
    if similarity_pct < 50:
        raise ValueError("similarity_pct must be 50 or more")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = store(texts.mapInArrow(_sketcher(width, k), "id long, n long, f1 long, f2 long, sketch array<long>, wide array<int>, "
                                  + ", ".join(f"{g} long" for g in MARKS)))
    classes = store(made.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")))
    sketches = store(made.join(classes.withColumnRenamed("rep", "id"), ["n", "f1", "f2", "id"]).select(
        "id", "n", "sketch"))
    listed = _listed(sketches, k, similarity_pct)
    marks = made.where("n > 0 and id is not null").select("id", *MARKS)
    bits = min(31, int((made.agg(F.sum("n")).first()[0] or 0) >> 20).bit_length())

    # Rows that share a key are one document, whatever their texts.
    several = made.where("n > 0 and id is not null").groupBy("id").agg(
        (F.min(F.struct("n", "f1", "f2")) != F.max(F.struct("n", "f1", "f2"))).alias("several")).where("several")
    edges = store(made.join(several, "id", "left_semi").join(classes, ["n", "f1", "f2"]).select(
        F.col("id").alias("a"), F.col("rep").alias("b")))
    lists = listed.withColumn("root", F.col("id"))
    roots = store(components(edges))
    for turn, number in enumerate((*HUBS, None)):
        total, rows = _across(lists)
        if total == 0:
            break
        last = number is None or turn > 0 and total <= rows
        pairs = store(_pairs_across(lists, marks, similarity_pct) if last else _marked(
            _pairs_with_hub(lists, similarity_pct, number), marks, similarity_pct))
        likely = store(_estimated(pairs, made, similarity_pct, bits))
        edges = store(edges.union(_links(likely, texts, width, similarity_pct, bits)).distinct())
        roots = store(components(edges))
        if last:
            break
        lists = store(listed.join(roots, "id", "left").select(
            "value", "id", "n", "prior", F.coalesce("root", "id").alias("root")))
    named = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "f1", "f2", F.coalesce("root", "rep").alias("root"))
    return made.join(store(named), ["n", "f1", "f2"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The input's columns, with one document of each near-duplicate group: the one with the smallest key.

    Of rows that share a key one stays. Rows with a null key all stay.
    """
    found = near_duplicates(docs, text, key, **options)
    go = store(found.where("not kept").select(F.col(key).alias("__key")).distinct())
    out = docs.join(go, docs[key].cast("long") == F.col("__key"), "left_anti")
    repeated = found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count()
    if repeated:
        out = out.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(out.where(F.col(key).isNull()))
    return out
