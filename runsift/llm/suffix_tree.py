"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of up to ``depth`` preceding words (a text begins after a start mark and closes with an end mark).
Next words that follow a context ``least`` times have their own probability there; the mass of all others goes to the
next shorter context:

    P(x | s) = (c(sx) + (c(s) - kept + alpha) * P(x | shorter s)) / (c(s) + alpha)

with c(sx) = 0 for a rare x, and ``kept`` the sum of the others. Each is a proper distribution. The root is the smoothed
word distribution. A context stays when its gain in log likelihood over the shorter one reaches ``cutoff`` per own next
word, and so do its suffixes. A word is scored in the longest state that its history ends with.

Texts are turned once into slices of some million words with a dictionary each. Counting and asking then go by distinct
keys of a slice, not by word, and keys that a filter of fixed size rules out are never sent. Words and longer keys go by
hashes of 64 bits: among a hundred million distinct words, two share one with a chance of 3 in 10,000.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm import frequent
from runsift.llm import words as W
from runsift.llm.storage import small_batches, store

_U = np.uint64
SLICE_WORDS = 3_000_000
PART_WORDS = 200_000  # words of a slice that are looked at together
START, END = _U(0x53F1D5A7C0B3E921), _U(0xA1E4C39B5D7F2867)
_CONTEXT = _U(0x94D049BB133111EB)


def _squeeze(values: np.ndarray) -> bytes:
    """Small numbers first by byte plane, so that their zero bytes lie together."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(parts)
    parts.clear()
    return out


def _slicer(key_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        keys, held, sizes, hashes, have = [], [], [], [], 0

        def settle() -> pa.RecordBatch:
            one, n, out = (_joined(parts) for parts in (hashes, sizes, held))
            order = np.argsort(one, kind="stable")
            one = one[order]
            at = frequent.runs(one)
            total = np.diff(np.append(at, len(one)))
            common = np.argsort(-total, kind="stable")  # frequent words get small numbers
            names = np.empty(len(at), np.int64)
            names[common] = np.arange(len(at))
            tokens = np.empty(len(one), np.int64)
            tokens[order] = np.repeat(names, total)
            seen = np.bincount(tokens[np.repeat(~out, n)], minlength=len(at))
            cells = [_squeeze(tokens), n.astype(np.int32).tobytes(), out.tobytes(), one[at[common]].tobytes(), _squeeze(seen)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(key_type)),
                 *[pa.array([c], pa.binary()) for c in cells]],
                ["slice", "keys", "tokens", "sizes", "held", "one", "seen"])

        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                found = W.words(chunk, W.NON_BLANK)
                keys.append(batch.column(0).slice(chunk.first, chunk.rows))
                held.append(batch.column(2).slice(chunk.first, chunk.rows).to_numpy(zero_copy_only=False).astype(bool))
                sizes.append(np.diff(found.rows))
                hashes.append(found.hashes)
                have += len(found.hashes) + chunk.rows
                if have >= SLICE_WORDS:
                    yield settle()
                    keys.clear()
                    number, have = number + 1, 0
        if have:
            yield settle()
    return run


class _Part:
    """Word hashes of some texts with a start and an end mark around each; ``doc`` is the text of each place."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, held: np.ndarray, one: np.ndarray):
        self.words, self.sizes, self.held = words, sizes, held
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
        ends = np.cumsum(sizes + 2)
        self.hashes = np.empty(len(self.doc), _U)
        self.hashes[ends - 1], self.hashes[ends - sizes - 2] = END, START
        self.is_word = np.ones(len(self.doc), bool)
        self.is_word[ends - 1] = self.is_word[ends - sizes - 2] = False
        self.hashes[self.is_word] = one[words]

    def grams(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Hashes of the grams of 1, 2, ... words that begin at each place, and where such a gram lies in one text."""
        hashes, n = self.hashes, len(self.hashes)
        yield 1, hashes, np.ones(n, bool)
        for k in range(2, size + 1):
            longer, inside = np.zeros_like(hashes), np.zeros(n, bool)
            if n >= k:
                longer[:n - k + 1] = W.mix(hashes[:n - k + 1] * _U(0x9FB21C651E98DF25) + self.hashes[k - 1:] + _U(k))
                inside[:n - k + 1] = self.doc[:n - k + 1] == self.doc[k - 1:]
            hashes = longer
            yield k, hashes, inside


def _parts(table, row: int) -> Iterator[_Part]:
    """The texts of a slice, some at a time; a longer text is a part of its own."""
    tokens, sizes, held, one = (table.column(c)[row].as_py() for c in ("tokens", "sizes", "held", "one"))
    words, sizes = _expand(tokens), np.frombuffer(sizes, np.int32).astype(np.int64)
    held, one = np.frombuffer(held, bool), np.frombuffer(one, _U)
    at = np.append(0, np.cumsum(sizes))
    steps = at + np.arange(len(at))  # each text counts one more, so empty ones fill a part too
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(steps, steps[low] + PART_WORDS, side="right")) - 1)
        yield _Part(words[at[low]:at[high]], sizes[low:high], held[low:high], one)
        low = high


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Sorted different keys; parts are joined one by one, so that only one lies beside the result."""
    keys = np.zeros(0, _U)
    for part in parts:
        keys = np.sort(np.concatenate([keys, part]))
        keys = keys[frequent.runs(keys)]
    return keys


def _possible(part: _Part, likely: frequent.Filter, size: int):
    """Grams of 2 to ``size`` words of training texts whose shorter grams all pass the filter: ``k, hashes, shorter hashes, where``."""
    shorter = may = None
    for k, hashes, inside in part.grams(size):
        if k == 1:
            may = likely.likely(hashes) & ~part.held[part.doc]
        else:
            here = inside & may
            here[:-1] &= may[1:]
            yield k, hashes, shorter, np.flatnonzero(here)
            here[here] = likely.likely(hashes[here])
            may = here
        shorter = hashes


def _hashed(shared, size: int, bits: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [np.zeros(0, _U)]
                for part in _parts(batch, row):
                    found += [hashes[where] for k, hashes, _, where in _possible(part, shared.value, size) if k == size]
                hashes = np.concatenate(found)
                del found
                if len(hashes):
                    yield frequent.pack(hashes, bits, least)
    return run


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal first columns made one row, last columns summed."""
    first, *rest, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(first, kind="stable")
    at = frequent.runs(first[order])
    total = np.add.reduceat(counts[order], at) if len(at) else counts
    return (*[c[order[at]] for c in (first, *rest)], total)


def _counted(shared, size: int):
    """Exact counts per slice of the grams that pass: the gram, its context, and the same next word after the shorter context."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found: dict[int, list] = {k: [] for k in range(2, size + 1)}
                for part in _parts(batch, row):
                    for k, hashes, shorter, where in _possible(part, shared.value, size):
                        where = where[shared.value.likely(hashes[where])]
                        found[k].append((hashes[where], shorter[where], shorter[where + 1], np.ones(len(where), np.int64)))
                        found[k] = [_added(found[k])]
                for k, parts in found.items():
                    gram, context, tail, counts = _added(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(gram), k, np.int32)), _long(gram), _long(context), _long(tail), pa.array(counts)],
                        ["size", "gram", "context", "tail", "c"])
    return run


def _packed_keys(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield frequent.pack(batch.column(0).to_numpy().view(_U), bits, 1)
    return run


def _word_blocks(bits: int):
    """The dictionary of a slice as sorted blocks, one per bucket, with the counts in training texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, seen = np.frombuffer(batch.column("one")[row].as_py(), _U), _expand(batch.column("seen")[row].as_py())
                order = np.argsort(one, kind="stable")
                one, seen = one[order], seen[order]
                if not len(one):
                    continue
                buckets, blocks = _blocks(one, bits)
                cells = np.split(seen, np.cumsum([len(b) for b in blocks])[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.full(len(buckets), batch.column("slice")[row].as_py(), np.int64)),
                     pa.array([frequent.planes(b, 8) for b in blocks], pa.binary()),
                     pa.array([frequent.planes(c, 8) for c in cells], pa.binary())], ["bucket", "slice", "words", "counts"])
    return run


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all slices, bucket by bucket: a row with the words, and one per slice in the order of its own block."""
    now, slices, words, counts = None, [], [], []

    def settle() -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate(counts).astype(np.int64))
        own = np.split(total[at], np.cumsum([len(w) for w in words])[:-1])
        n = len(slices)
        out = pa.RecordBatch.from_arrays(
            [pa.array([now] * (n + 1), pa.int32()), pa.array([None, *slices], pa.int64()),
             pa.array([frequent.planes(distinct, 8), *[None] * n], pa.binary()),
             pa.array([frequent.planes(c, 8) for c in (total, *own)], pa.binary())], ["bucket", "slice", "words", "counts"])
        for parts in (slices, words, counts):
            parts.clear()
        return out

    for batch in batches:
        for bucket, number, block, seen in zip(*[batch.column(i) for i in range(4)], strict=True):
            if bucket.as_py() != now and slices:
                yield settle()
            now = bucket.as_py()
            slices.append(number.as_py())
            words.append(frequent.from_planes(block.as_buffer(), 8))
            counts.append(frequent.from_planes(seen.as_buffer(), 8))
    if slices:
        yield settle()


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, counts in zip(batch.column(0), batch.column(1), strict=True):
            c = frequent.from_planes(counts.as_buffer(), 8).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [_long(frequent.from_planes(words.as_buffer(), 8)[c > 0]), pa.array(c[c > 0])], ["one", "c"])


def _states(part: _Part, likely: frequent.Filter, depth: int):
    """For each depth: where the preceding words may be a state, its key, and the key of the word that follows there."""
    places, shorter = {}, None
    for k, hashes, inside in part.grams(depth + 1):
        if k > 1:
            where = np.flatnonzero(inside)
            contexts = W.mix(shorter[where] ^ _CONTEXT)
            some = likely.likely(contexts)
            places[k - 1] = (where[some] + k - 1, contexts[some], hashes[where[some]])
        shorter = hashes
    return places


def _asked(part: _Part, likely: frequent.Filter, depth: int) -> np.ndarray:
    keys = []
    for _, contexts, grams in _states(part, likely, depth).values():
        keys += [contexts, grams[likely.likely(grams)]]
    return _distinct(keys)


def _blocks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted keys cut at their first bits."""
    buckets = (keys >> _U(32) >> _U(32 - bits)).astype(np.int32)
    cut = frequent.runs(buckets)
    return buckets[cut], np.split(keys, cut[1:])


def _questions(shared, depth: int, bits: int):
    """The keys that a slice asks for, as sorted blocks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                buckets, blocks = _blocks(_distinct(_asked(p, shared.value, depth) for p in _parts(batch, row)), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.full(len(buckets), batch.column("slice")[row].as_py(), np.int64)),
                     pa.array([frequent.planes(b, 8) for b in blocks[:len(buckets)]], pa.binary()),
                     pa.array([None] * len(buckets), pa.binary())], ["bucket", "slice", "keys", "values"])
    return run


def _tree_blocks(bits: int):
    """Some of the tree as sorted blocks with their values; a bucket may have several."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()
            order = np.argsort(keys, kind="stable")
            if len(order):
                buckets, blocks = _blocks(keys[order], bits)
                cells = np.split(values[order], np.cumsum([len(b) for b in blocks])[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array([None] * len(buckets), pa.int64()),
                     pa.array([frequent.planes(b, 8) for b in blocks], pa.binary()),
                     pa.array([c.tobytes() for c in cells], pa.binary())], ["bucket", "slice", "keys", "values"])
    return run


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, the tree's rows come first; then each slice's keys get their values, NaN where the tree has none."""
    now, keys, values = None, [], []
    for batch in batches:
        for bucket, number, block, cells in zip(*[batch.column(i) for i in range(4)], strict=True):
            if bucket.as_py() != now:
                now, keys, values = bucket.as_py(), [np.zeros(0, _U)], [np.zeros(0)]
            block = frequent.from_planes(block.as_buffer(), 8)
            if not number.is_valid:
                keys.append(block)
                values.append(np.frombuffer(cells.as_buffer(), np.float64))
                continue
            if len(keys) > 1:
                order = np.argsort(np.concatenate(keys), kind="stable")
                keys, values = [np.concatenate(keys)[order]], [np.concatenate(values)[order]]
            out = np.full(len(block), np.nan)
            if len(keys[0]):
                at = np.minimum(np.searchsorted(keys[0], block), len(keys[0]) - 1)
                hit = keys[0][at] == block
                out[hit] = values[0][at[hit]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number.as_py()]), pa.array([now], pa.int32()), pa.array([None], pa.binary()), pa.array([out.tobytes()], pa.binary())],
                ["slice", "bucket", "counts", "values"])


def _scorer(shared, depth: int, key_type: pa.DataType, n_train: int, n_words: int, n_docs: int):
    """Word and text sums of a slice, from the counts of its words and the states it asked for."""
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        blocks = [b.as_buffer() for b in answers.filter(pc.is_valid(answers.column("counts"))).column("counts")]
        cells = [b.as_buffer() for b in answers.filter(pc.is_valid(answers.column("values"))).column("values")]
        names = ["held_out", "n_tokens", "n_known", "base_score", "score"]
        out: list[pa.Table] = []
        for row in range(slices.num_rows):
            one = np.frombuffer(slices.column("one")[row].as_py(), _U)
            counts = np.zeros(len(one))
            if len(one):
                counts[np.argsort(one, kind="stable")] = np.concatenate([frequent.from_planes(b, 8) for b in blocks])
            logs = np.concatenate([np.zeros(0), *[np.frombuffer(c, np.float64) for c in cells]])
            keys = _distinct(_asked(p, shared.value, depth) for p in _parts(slices, row))
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for part in _parts(slices, row):
                for column, values in zip(columns, _text_sums(part, counts, keys, logs), strict=True):
                    column.append(values)
            out.append(pa.table({"key": pa.array(slices.column("keys")[row].as_py(), key_type),
                                 **{c: np.concatenate(v) for c, v in zip(names, columns, strict=True)}}))
        schema = pa.schema([("key", key_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else schema.empty_table()

    def _text_sums(part: _Part, counts: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, ...]:
        def found(asked: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(asked), np.nan)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[at] == asked, logs[at], np.nan)

        c = np.full(len(part.doc), float(n_docs))
        c[part.is_word] = counts[part.words]
        base = np.log10((c + 0.1) / (n_train + 0.1 * (n_words + 1)))
        score = base.copy()
        for _, (where, contexts, grams) in sorted(_states(part, shared.value, depth).items()):
            rest = found(contexts)
            is_state = ~np.isnan(rest)
            where, rest = where[is_state], rest[is_state]
            own = found(grams[is_state])
            score[where] = np.where(np.isnan(own), rest + score[where], own)
        counted = np.append(False, part.doc[1:] == part.doc[:-1])  # all but the start marks

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(part.doc[counted], values[counted], minlength=len(part.sizes))

        return part.held, part.sizes + 1, per_text((c > 0).astype(float)).astype(np.int64), per_text(base), per_text(score)
    return run


def grow(slices: DataFrame, words: DataFrame, n_train: int, n_words: int, n_docs: int, bits: int, depth: int, least: int,
         alpha: float, cutoff: float) -> DataFrame:
    """The tree: ``key``, ``value``; log10 of a next word's probability in its state, or of the mass a state hands on."""
    context = slices.sparkSession.sparkContext
    often = store(words.where(F.col("c") >= least))  # no other word can follow a state or make one
    likely = frequent.Filter(bits).learn(often.select("one").mapInArrow(_packed_keys(bits), frequent.KEY_BLOCKS), 1)
    likely.put(np.array([START, END]))
    texts = slices.select("tokens", "sizes", "held", "one")
    for size in range(2, depth + 2):
        shared = context.broadcast(likely)
        likely = frequent.Filter(bits).add(likely).learn(
            texts.mapInArrow(_hashed(shared, size, bits, least), frequent.KEY_BLOCKS), least)
        shared.destroy()
    shared = context.broadcast(likely)
    grams = store(texts.mapInArrow(_counted(shared, depth + 1), "size int, gram long, context long, tail long, c long")
                  .groupBy("size", "gram", "context", "tail").agg(F.sum("c").alias("c")).where(F.col("c") >= least))
    marks = slices.sparkSession.createDataFrame(
        [(int(START.view(np.int64)), n_docs), (int(END.view(np.int64)), n_docs)], "one long, c long")
    above = often.union(marks).select(
        F.col("one").alias("gram"), "c", ((F.col("c") + 0.1) / (n_train + 0.1 * (n_words + 1))).alias("p"),
        F.lit(None).cast("long").alias("context"))
    levels = []
    for size in range(2, depth + 2):
        rows = grams.where(F.col("size") == size)
        totals = rows.groupBy("context").agg(F.sum("c").alias("kept"), F.count("c").alias("own")).join(
            above.select(F.col("gram").alias("context"), F.col("c").alias("total")), "context")
        rows = rows.join(totals, "context").join(
            above.select(F.col("gram").alias("tail"), F.col("p").alias("shorter"), F.col("context").alias("parent")), "tail")
        handed = (F.col("total") - F.col("kept") + alpha) / (F.col("total") + alpha)
        rows = store(rows.select(
            "gram", "context", "parent", "c", "total", "own", "shorter", handed.alias("handed"), (F.col("total") - F.col("kept")).alias("rest"),
            (F.col("c") / (F.col("total") + alpha) + handed * F.col("shorter")).alias("p")))
        gain = F.sum(F.col("c") * F.log(F.col("p") / F.col("shorter"))) + F.max(F.col("rest") * F.log("handed"))
        passed = rows.groupBy("context").agg(gain.alias("gain"), F.max("own").alias("own")).where(
            F.col("gain") >= cutoff * F.col("own")).select("context")
        levels.append((rows, passed))
        above = rows.select("gram", "c", "p", "context")
    parts, needed = [], None
    for rows, passed in levels[::-1]:
        states = store((passed if needed is None else passed.union(needed)).distinct())
        inside = rows.join(states, "context")
        needed = inside.where(F.col("parent").isNotNull()).select(F.col("parent").alias("context"))
        parts.append(inside.select(F.lit(1).alias("kind"), F.col("gram").alias("key"), F.log10("p").alias("value")))
        parts.append(inside.groupBy("context").agg(F.max(F.log10("handed")).alias("value")).select(
            F.lit(2), "context", "value"))
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.union(part)
    return store(tree.mapInArrow(_state_keys, "key long, value double"))


def _state_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States get keys of their own, apart from those of grams."""
    for batch in batches:
        kind, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U)
        yield pa.RecordBatch.from_arrays([_long(np.where(kind == 2, W.mix(key ^ _CONTEXT), key)), batch.column(2)], ["key", "value"])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 2, least: int = 10, alpha: float = 1.0,
          cutoff: float = 4.0, held_out: int = 10) -> DataFrame:
    """Score every text: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A-Z count as a-z, words are ``[^\\x20\\x09-\\x0D]+``, and an end mark closes each text. Learned are the texts whose
    crc32 of the key as text is not 0 modulo ``held_out``; a null key counts as learned. ``base_score`` is the sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the words and the end mark, ``score`` that of the tree.

    A null or empty text is its end mark alone. Rows that repeat a key are learned and scored each. An empty table gives
    no rows; without texts to learn from every word has probability 1. Other columns are not read. A text is read whole
    and held by one task.
    """
    key_type = docs.schema[key].dataType
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % held_out == 0, F.lit(False)).alias("held"))
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    arrow_key = docs.select(key).limit(0).toArrow().schema.field(0).type
    slices = store(rows.mapInArrow(
        _slicer(arrow_key), f"slice long, keys array<{key_type.simpleString()}>, tokens binary, sizes binary, held binary, one binary, "
        "seen binary"))
    bits = frequent.bucket_bits(rows, F.col("text"))
    blocks = "bucket int, slice long, words binary, counts binary"
    counted = store(slices.select("slice", "one", "seen").mapInArrow(_word_blocks(bits), blocks)
                    .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_words, blocks))
    words = counted.where("slice is null").select("words", "counts").mapInArrow(_word_rows, "one long, c long")
    n_docs = rows.where(~F.col("held")).count()
    n_words, total = words.agg(F.count("c"), F.sum("c")).first()
    n_train, n_words = (total or 0) + n_docs, n_words + (1 if n_docs else 0)
    tree = grow(slices, words, n_train, n_words, n_docs, bits, depth, least, alpha, cutoff)
    known = frequent.Filter(bits).learn(tree.select("key").mapInArrow(_packed_keys(bits), frequent.KEY_BLOCKS), 1)
    shared = context.broadcast(known)
    asking = "bucket int, slice long, keys binary, values binary"
    asked = slices.select("slice", "tokens", "sizes", "held", "one").mapInArrow(_questions(shared, depth, bits), asking).union(
        tree.mapInArrow(_tree_blocks(bits), asking))
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", F.col("slice").asc_nulls_first()).mapInArrow(
        _answers, "slice long, bucket int, counts binary, values binary").union(
        counted.where("slice is not null").select("slice", "bucket", "counts", F.lit(None).cast("binary")))
    out = f"key {key_type.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = slices.select("slice", "keys", "tokens", "sizes", "held", "one").groupBy("slice").cogroup(
        answers.groupBy("slice")).applyInArrow(_scorer(shared, depth, arrow_key, n_train, n_words, n_docs), out)
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                         "base_score", "score")
