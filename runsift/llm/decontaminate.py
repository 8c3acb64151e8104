"""Benchmark decontamination: a broadcast hash set of item windows, scanned over every document, verified by words.

The item side is measured first. Up to ``SLICE_BYTES`` of item text is broadcast at once; a larger benchmark is cut
into slices by a hash of the item and the documents pass one scan per slice, so the broadcast never grows with the
data. Nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.llm import words as W
from runsift.llm.storage import without

WIDTH = 10
SLICE_BYTES = 16 << 20
_SCREEN = 22  # bits of a hash that a byte table screens before the exact lookup
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", _SPANS)])


class ItemWindows:
    """Windows of some items, by length: screen, sorted hashes, and for each hash its items and words."""

    def __init__(self, items: Sequence[Row], width: int):
        found: dict[int, dict[int, list[tuple[str | None, tuple[bytes, ...]]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            raw = (text or "").encode()
            own = W.of_text(raw, W.ALNUM)
            n = len(own.hashes)
            if not n:
                continue
            length = min(n, width)
            low = raw.lower()  # bytes: A-Z only
            spelled = [low[a:b] for a, b in zip(own.starts, own.ends, strict=True)]
            for i, h in zip(*W.windows(own, length), strict=True):
                entry = (item_id, tuple(spelled[i:i + length]))
                if entry not in found[length][int(h)]:
                    found[length][int(h)].append(entry)
        self.by_length = {}
        for length, table in found.items():
            keys = np.array(sorted(table), np.uint64)
            screen = np.zeros(1 << _SCREEN, bool)
            screen[keys >> np.uint64(64 - _SCREEN)] = True
            self.by_length[length] = (screen, keys, [table[int(k)] for k in keys])

    def hits(self, chunk: W.Chunk, found: W.Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """First word, length and items of every verified window."""
        for length, (screen, keys, entries) in self.by_length.items():
            first, hashes = W.windows(found, length)
            maybe = np.flatnonzero(screen[hashes >> np.uint64(64 - _SCREEN)])
            at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
            for m, k in zip(maybe, at, strict=True):
                if keys[k] != hashes[m]:
                    continue
                i = int(first[m])
                said = tuple(chunk.data[a:b].tobytes().lower()
                             for a, b in zip(found.starts[i:i + length], found.ends[i:i + length], strict=True))
                named = [item for item, spelled in entries[k] if spelled == said]
                if named:
                    yield i, length, named


def _scanner(shared, text: int, before: tuple[int, int] | None, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: ItemWindows = shared.value
        for batch in batches:
            counts, items, spans = [], [], []
            earlier = [batch.column(c).to_pylist() for c in before] if before else None
            for chunk in W.chunks(batch.column(text)):
                found = W.words(chunk, W.ALNUM)
                counts += np.diff(found.rows).tolist()
                hit = np.zeros(len(found.hashes) + 1, np.int64)
                own = defaultdict(set)
                for i, length, named in windows.hits(chunk, found):
                    hit[i] += 1
                    hit[i + length] -= 1
                    own[int(np.searchsorted(found.rows, i, side="right")) - 1].update(named)
                covered = np.cumsum(hit)[:-1] > 0
                for r in range(chunk.rows):
                    base = int(found.rows[r])
                    mark = covered[base:found.rows[r + 1]]
                    named = own.get(r, set())
                    if earlier:
                        named = named | set(earlier[0][chunk.first + r])
                        mark = mark.copy()
                        for s in earlier[1][chunk.first + r]:
                            mark[s["start"]:s["end"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
                    items.append(sorted(x for x in named if x is not None))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in names]
            kept_names = [n for n in batch.schema.names if n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*kept_names, "n_words", "hit_items", "hit_spans"])
    return run


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WIDTH, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The input's rows with ``n_words``, ``hit_items`` (sorted ids as text) and ``hit_spans`` (word runs, end exclusive).

    Words are runs of ASCII letters, digits and characters beyond ASCII, compared with A-Z lower-cased. A window is
    ``width`` consecutive words of an item, or a whole item of fewer words. Null texts and items have no words; an item
    with a null id hits but is not named. Input columns called like an added one are replaced. Runs a job on ``items``
    while the plan is built.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    out = without(docs, ADDED.names)
    columns = out.columns
    for s in range(slices):
        part = named.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s).collect()
        shared = spark.sparkContext.broadcast(ItemWindows([tuple(r) for r in part], width))
        before = (len(columns) + 1, len(columns) + 2) if s else None
        schema = T.StructType([*out.select(*[f"`{c}`" for c in columns]).schema.fields, *ADDED.fields])
        out = out.mapInArrow(_scanner(shared, columns.index(text), before, columns), schema)
    return out


def _scan_renamed(docs: DataFrame, items: DataFrame, text: str, options: dict) -> tuple[DataFrame, list[str]]:
    """Scan under neutral column names, so that no input column is replaced."""
    plain = [f"__c{i}" for i in range(len(docs.columns))]
    return scan(docs.toDF(*plain), items, plain[docs.columns.index(text)], **options), plain


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Leave out documents in which a window of an item occurs."""
    found, plain = _scan_renamed(docs, items, text, options)
    return found.where(F.size("hit_spans") == 0).select(*plain).toDF(*docs.columns)


def _cutter(text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(text).to_pylist()
            for r, own in enumerate(spans):
                if own:
                    raw = texts[r].encode()
                    found = W.of_text(raw, W.ALNUM)
                    parts, at = [], 0
                    for s in own:
                        parts.append(raw[at:found.starts[s["start"]]])
                        at = int(found.ends[s["end"] - 1])
                    texts[r] = (b"".join(parts) + raw[at:]).decode()
            columns = list(batch.columns[:-1])
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
    return run


def cut_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Cut the hit word runs out of the texts and keep all documents."""
    found, plain = _scan_renamed(docs, items, text, options)
    cut = found.select(*plain, "hit_spans").mapInArrow(
        _cutter(docs.columns.index(text)), docs.toDF(*plain).schema)
    return cut.toDF(*docs.columns)
