"""Collocations from a weighted de Bruijn graph of word sequences.

Edges are the longest grams (``max_words`` words) with their counts, nodes the grams one word shorter; an edge leads
from its first words to its last ones. Where a piece ends, or no frequent gram goes on, a shorter gram stands in as the
correction, so each word of a piece begins exactly one row. The count of a node is the weight of the edges that leave
it plus its corrections; counts of ever shorter grams follow the same way, one aggregation per word less.

Only grams in which every shorter gram occurs ``least`` times can occur as often themselves. ``frequent`` finds the
shorter ones beforehand, by hash and without missing any, so rare long grams are never shipped.

Frequent edges are compacted: where all of a node's occurrences come from one edge and go on by one edge, both join.
Such a path lies within one piece, so paths are no longer than the longest piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm import frequent
from runsift.llm import words as W
from runsift.llm.storage import small_batches, store

_U = np.uint64
FLUSH = 2_000_000  # words gathered before equal grams are merged
PIECE = 1 << 17  # words of a flush looked at together
WRITTEN = 1 << 14  # grams written together; the text of a gram takes some hundred bytes of places
_SECOND = 0xC2B2AE3D27D4EB4F
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_WORD = bytes(b not in _BREAKS and b not in b" \t" for b in range(256))
_BREAK = bytes(b in _BREAKS for b in range(256))


class _Run:
    """Words of some texts, one after the other: two hashes, group, place in ``text``, and whether the next word follows.

    With ``spelled`` false the first hash and the last column alone are kept.
    """

    def __init__(self, spelled: bool = True):
        self.spelled = spelled
        self.columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        self.words = self.bytes = 0
        self.names: dict[str, int] = {}
        self.salts = np.zeros((0, 2), _U)

    def add(self, batch: pa.RecordBatch) -> Iterator[None]:
        """Take in a batch; stops between chunks whenever enough words wait to be flushed."""
        groups = batch.column(1).dictionary_encode()
        codes = np.array([self.names.setdefault(g, len(self.names)) for g in groups.dictionary.to_pylist()], np.int32)
        new = list(self.names)[len(self.salts):]
        self.salts = np.concatenate([self.salts, np.array(
            [np.frombuffer(blake2b(g.encode(), digest_size=16).digest(), _U) for g in new], _U).reshape(-1, 2)])
        group = codes[groups.indices.to_numpy()] if batch.num_rows else codes
        for chunk in W.chunks(batch.column(0)):
            found = W.words(chunk, _WORD)
            if len(found.hashes):
                row = W.row_of(found)
                own = group[row + chunk.first]
                piece = np.cumsum(W.look_up(chunk.data, _BREAK), dtype=np.int64)[found.starts]
                follows = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
                # The group is part of every word's hashes.
                first = found.hashes + self.salts[own, 0]
                self.words += len(first)
                if not self.spelled:
                    self.columns[0].append(first)
                    self.columns[5].append(follows)
                    if self.words >= FLUSH:
                        yield
                    continue
                lowered = W.look_up(chunk.data, W.LOWER)
                second = W.mix(W.span_hash(W.prefix_hash(lowered, _SECOND), found.starts, found.ends, _SECOND))
                size = found.ends - found.starts
                at = np.cumsum(size + 1) - (size + 1)
                text = lowered[np.minimum(np.repeat(found.starts - at, size + 1) + np.arange(int((size + 1).sum())), len(lowered) - 1)]
                text[at + size] = 0x20
                for column, values in zip(self.columns, (
                        first, second ^ self.salts[own, 1], own, (at + self.bytes).astype(np.uint32),
                        (at + size + self.bytes).astype(np.uint32), follows, text), strict=True):
                    column.append(values)
                self.bytes += len(text)
            if self.words >= FLUSH:
                yield

    def take(self) -> list[np.ndarray]:
        """Everything gathered so far."""
        out = []
        for column in self.columns:
            out.append(np.concatenate(column) if column else np.zeros(0, _U))
            column.clear()
        self.words = self.bytes = 0
        return out


def _longer(hashes: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the grams of ``size`` words from those of one word less; the last ones mean nothing."""
    out = np.zeros_like(hashes)
    for low in range(0, len(out) - size + 1, PIECE):
        high = min(low + PIECE, len(out) - size + 1)
        out[low:high] = W.mix(hashes[low:high] * _U(0x9FB21C651E98DF25) + words[low + size - 1:high + size - 1] + _U(size))
    return out


def _inside(follows: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from here lie in one piece."""
    out = np.ones(len(follows), bool)
    for j in range(size - 1):
        out[:len(out) - j] &= follows[j:]
        out[len(out) - j:] = False
    return out


def _lengths(first: np.ndarray, follows: np.ndarray, likely: frequent.Filter, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest gram from each word that can be frequent as far as sizes up to ``known`` tell, and hashes of ``known`` words."""
    n = len(first)
    length, hashes, may = np.ones(n, np.int8 if known < 127 else np.int32), first, np.ones(n, bool)
    for size in range(2, known + 2):
        here = _inside(follows, size) & may
        here[:-1] &= may[1:]
        here[n - 1:] = False
        if size <= known:
            hashes = _longer(hashes, first, size) if n >= size else hashes
            for low in range(0, n, PIECE):
                own = here[low:low + PIECE]
                own[own] = likely.likely(hashes[low:low + PIECE][own])
        length[here] = size
        may = here
    return length, hashes


def _hashed(shared, known: int, bits: int, least: int):
    """Blocks of the hashes of all grams of ``known + 1`` words that can be frequent."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Run(spelled=False)

        def flush():
            first, _, _, _, _, follows, _ = gathered.take()
            length, hashes = _lengths(first, follows, shared.value, known)
            if len(first) > known:
                hashes = _longer(hashes, first, known + 1)
            hashes = hashes[length == known + 1]
            if len(hashes):
                yield frequent.pack(hashes, bits, least)

        for batch in batches:
            for _ in gathered.add(batch):
                yield from flush()
        if gathered.words:
            yield from flush()
    return run


def _edges(shared, size: int):
    """One row per distinct gram and flush: the longest gram of at most ``size`` words from each word that can be frequent."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Run()

        def flush():
            first, second, group, starts, ends, follows, text = gathered.take()
            length = _lengths(first, follows, shared.value, size - 1)[0]
            one, two = first, second
            for low in range(0, len(length), PIECE):  # in place: a gram's hash takes no word that lies before it
                a, b = first[low:low + PIECE + size - 1].copy(), second[low:low + PIECE + size - 1].copy()
                for k in range(2, size + 1):
                    here = np.flatnonzero(length[low:low + PIECE] >= k)
                    one[here + low] = W.mix(one[here + low] * _U(0x9FB21C651E98DF25) + a[here + k - 1] + _U(k))
                    two[here + low] = W.mix(two[here + low] * _U(0xE7037ED1A0B428DB) + b[here + k - 1] + _U(k))
            del first, second, follows
            order = np.argsort(one, kind="stable").astype(np.uint32)
            new = np.ones(len(order), bool)
            one = one[order]
            new[1:] = one[1:] != one[:-1]
            del one
            two = two[order]
            new[1:] |= two[1:] != two[:-1]
            del two
            at = np.flatnonzero(new).astype(np.uint32)
            rows, counts = order[at], np.diff(at, append=np.uint32(len(order)))
            del new, order, at
            names = pa.array(list(gathered.names))
            for low in range(0, len(rows), WRITTEN):
                part = rows[low:low + WRITTEN]
                a, b = starts[part].astype(np.int64), ends[part + length[part] - 1].astype(np.int64)
                offsets = np.append(0, np.cumsum(b - a))
                picked = text[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
                grams = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(picked)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(group[part])), grams, pa.array(length[part].astype(np.int32)),
                     pa.array(counts[low:low + WRITTEN].astype(np.int64))], ["group", "gram", "size", "f"])

        for batch in batches:
            for _ in gathered.add(batch):
                yield from flush()
        if gathered.words:
            yield from flush()
    return run


def _first(words: int):
    return F.substring_index("gram", " ", words)


def _last(words: int):
    return F.substring_index("gram", " ", -words)


def graph(docs: DataFrame, text: str = "text", group: str = "lang", max_words: int = 3, least: int = 10) -> list[DataFrame]:
    """Counts of all frequent grams by size: ``[totals, words, pairs, ...]``, each with ``group``, ``gram`` and ``f``.

    The last table holds the edges, the one before it the nodes of the graph. ``totals`` has one row per group (no
    ``gram``), with the number of all words.
    """
    if max_words < 2:
        raise ValueError("an edge has at least two words")
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("group"))
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    bits = frequent.bucket_bits(rows, F.col("text"))
    likely = frequent.Filter(bits)
    for known in range(1, max_words - 1):
        shared = context.broadcast(likely)
        likely = frequent.Filter(bits).add(likely).learn(
            rows.mapInArrow(_hashed(shared, known, bits, least), frequent.KEY_BLOCKS), least)
        shared.destroy()
    shared = context.broadcast(likely)
    level = store(rows.mapInArrow(_edges(shared, max_words), "group string, gram string, size int, f long")
                  .groupBy("group", "gram", "size").agg(F.sum("f").alias("f")))
    tables = []
    for size in range(max_words, 0, -1):
        tables.append(level.where((F.col("size") == size) & (F.col("f") >= least)).select("group", "gram", "f"))
        shorter = F.least("size", F.lit(size - 1))
        if size > 1:
            level = store(level.groupBy("group", _first(size - 1).alias("gram"), shorter.alias("size")).agg(F.sum("f").alias("f")))
    return [level.groupBy("group").agg(F.sum("f").alias("n")), *tables[::-1]]


def paths(nodes: DataFrame, edges: DataFrame, max_words: int = 3) -> DataFrame:
    """Edges with unary nodes compacted: ``group``, ``words``, ``f``; a path of w words holds w - max_words + 1 edges.

    Chains are followed by doubling over the unary nodes: each round twice as far, on tables of one row per node.
    """
    at = nodes.select("group", F.col("gram").alias("node"), "f")
    both = store(
        edges.select("group", _first(max_words - 1).alias("source"), _last(max_words - 1).alias("target"), F.col("f").alias("w"))
        .join(at.select("group", F.col("node").alias("source"), F.col("f").alias("out")), ["group", "source"])
        .join(at.select("group", F.col("node").alias("target"), F.col("f").alias("in")), ["group", "target"]))
    leaves = both.where("w = out").select("group", F.col("source").alias("node"), F.col("target").alias("to"))
    comes = both.where("w = in").select("group", F.col("target").alias("node"), F.col("source").alias("from"))
    unary = store(leaves.join(comes, ["group", "node"]))
    known = unary.select("group", F.col("node").alias("from"), F.lit(True).alias("inner"))
    now = store(unary.join(known, ["group", "from"], "left").select(
        "group", "node", F.when(F.col("inner"), F.col("from")).otherwise(F.col("node")).alias("head"),
        F.coalesce("inner", F.lit(False)).cast("int").alias("steps")))
    moved = now.where("steps > 0").count()
    while moved:
        step = now.select("group", F.col("node").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        grown = store(now.join(step, ["group", "head"]).select(
            "group", "node", F.col("next").alias("head"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("more") > 0).alias("went")))
        moved = grown.where("went").count()
        now = grown.drop("went")
    place = now.select("group", "node", "head", "steps")
    placed = both.join(place.select("group", F.col("node").alias("target"), F.col("head").alias("h1"), F.col("steps").alias("s1")),
                       ["group", "target"], "left").join(
        place.select("group", F.col("node").alias("source"), F.col("head").alias("h2"), F.col("steps").alias("s2")),
        ["group", "source"], "left")
    alone = F.struct(F.coalesce("h1", "h2").alias("head"), F.when(F.coalesce("h1", "h2").isNull(), F.concat_ws(
        " ", "source", _word("target"))).alias("edge"))
    return placed.select("group", "w", "source", _word("target").alias("word"), alone.alias("path"),
                         F.coalesce("s1", F.col("s2") + 1, F.lit(0)).alias("at")).groupBy("group", "path").agg(
        F.first("w").alias("f"), F.min(F.struct("at", "source"))["source"].alias("start"),
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("rest")).select(
        "group", F.concat(F.split("start", " ", -1), F.transform("rest", lambda r: r["word"])).alias("words"), "f")


def _word(column: str):
    return F.substring_index(column, " ", -1)


def _windows(words, size: int):
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", max_words: int = 3, least: int = 10,
                 cover_pct: int = 50, top: int | None = 2000) -> DataFrame:
    """Phrases of 2 to ``max_words`` words by association: ``group, rank, phrase, a, l, r, n, score``.

    A-Z count as a-z, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``; all counts are per group, a
    null group is ``und``. A phrase needs ``a >= least`` occurrences. Cut after k words it has parts with counts l and
    r; the lowest ``floor(1000000 * a * a / (l * r))`` is its score, ties go to the smallest k. A phrase goes when its
    words lie within a longer one with ``100 * f(longer) >= cover_pct * a``. Ranks go by score, then a, then phrase in
    byte order. Products are exact decimals of 38 digits, so counts may reach 10 ** 16.

    Null and empty texts have no words, and a table without words gives no rows. Rows that repeat count each time.
    Other columns of ``docs`` are not read. A text is read whole and held by one task.
    """
    totals, *sizes = graph(docs, text, group, max_words, least)
    compact = store(paths(sizes[-2], sizes[-1], max_words))
    # Windows of the compact paths are the edges again; the nodes within a path have its count.
    longest = compact.select("group", "f", F.explode(_windows(F.col("words"), max_words)).alias("gram"))
    tables = {k + 1: t for k, t in enumerate(sizes[:-1])} | {max_words: longest}
    candidates = []
    for size in range(2, max_words + 1):
        rows = tables[size]
        if size < max_words:
            above = tables[size + 1]
            covers = above.select("group", _first(size).alias("gram"), F.col("f").alias("g")).union(
                above.select("group", _last(size).alias("gram"), F.col("f").alias("g"))).groupBy("group", "gram").agg(F.max("g").alias("g"))
            rows = rows.join(covers, ["group", "gram"], "left").where(
                F.coalesce(100 * F.col("g") < cover_pct * F.col("f"), F.lit(True))).drop("g")
        cuts = F.array(*[F.struct(F.lit(k).alias("k"), _first(k).alias("left"), _last(size - k).alias("right")) for k in range(1, size)])
        candidates.append(rows.select("group", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(cuts).alias("cut"))
                          .select("group", "phrase", "a", "cut.*"))
    parts = store(reduce(DataFrame.union, [t.select("group", "gram", "f") for k, t in tables.items() if k < max_words]))
    asked = store(reduce(DataFrame.union, candidates))

    def wide(column: str):
        return F.col(column).cast("decimal(18,0)")

    scored = asked.join(parts.select("group", F.col("gram").alias("left"), F.col("f").alias("l")), ["group", "left"]).join(
        parts.select("group", F.col("gram").alias("right"), F.col("f").alias("r")), ["group", "right"]).withColumn(
        "score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r")))
    best = scored.groupBy("group", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "group", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "group").select(
        "group", "rank", "phrase", "a", "l", "r", "n", "score")
