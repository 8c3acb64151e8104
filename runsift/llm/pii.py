"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Spans that pass their kind's strict rule are always kept. Looser generators add proposals of the same kinds: addresses
with spelled-out signs, numbers with other separators, phones without a plus. The trees see only format and context,
never the checksum or range that decides a span. A loose proposal is right if its form with the usual signs passes its
kind's rule and, for the kinds whose rule many plain numbers pass (ip, phone), a word of the kind stands before it. It is
wrong if that form fails; the others are unlabelled and teach nothing. A proposal that overlaps no strict span is added
where its calibrated probability reaches the threshold of its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm import words as W
from runsift.llm.boosting import Isotonic, Trees
from runsift.llm.storage import store, without

KINDS = ("email", "ip", "card", "phone")
MAX_TRAINING_ROWS = 20_000  # different feature vectors; each counts all its proposals
STEPS_PER_DOUBLING = (8, 4, 2, 1)  # rounding of features, tried in turn while there are more
PRECISION = 0.95  # a threshold is the lowest probability from which proposals are right this often

_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = (
    (0, re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}"
                   rb"(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,8}")),
    (0, re.compile(rb"(?<![^\s<>\"'])[^\s@<>\"']{1,64}@[^\s@<>\"']{1,255}")),
    (1, re.compile(rb"(?<![0-9.])[0-9]{1,3}(?:[.:-][0-9]{1,3}){2,7}(?![0-9])")),
    (2, re.compile(rb"(?<![0-9])[0-9]{3,6}(?:[ ._/-]?[0-9]{2,6}){2,6}(?![0-9])")),
    (3, re.compile(rb"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9])")),
)
_HINTS = (rb"mail|contact|e-?mail", rb"\bip\b|host|server|addr", rb"card|visa|pay|account|iban",
          rb"phone|tel|call|mobile|fax")
_HINT = [re.compile(h, re.I) for h in _HINTS]
FEATURES = 17
_AT = re.compile(rb" ?[\[(]at[\])] ?")
_DOT = re.compile(rb" ?[\[(]dot[\])] ?")
_ADDRESS = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?: ?\.(?: ?[A-Za-z0-9-]+))+")


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = (d - 48) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the sign: the local part is the run before it, cut at the previous match."""
    end, at = 0, raw.find(b"@")
    while at >= 0:
        tail = _DOMAIN.match(raw, at)
        if tail:
            start = at
            while start > end and _LOCAL.match(raw, start - 1):
                start -= 1
            if start < at:
                end = tail.end()
                yield start, end
        at = raw.find(b"@", max(at + 1, end))


def strict_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of every span that passes its rule."""
    out = [(0, s, e) for s, e in _emails(raw)]
    for m in _IP.finditer(raw):
        if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m[0].split(b".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(raw):
        digits = m[0].replace(b" ", b"").replace(b"-", b"")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(raw):
        if 10 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _class(raw: bytes, at: int) -> int:
    if not 0 <= at < len(raw) or raw[at] in b" \t\n\r":
        return 0
    c = raw[at:at + 1]
    return 2 if c.isdigit() else 1 if c.isalpha() or raw[at] > 127 else 3


def _features(raw: bytes, kind: int, start: int, end: int) -> list[float]:
    own = raw[start:end]
    runs = re.findall(rb"[0-9]+", own)
    before = raw[max(0, start - 32):start]
    return [
        kind, end - start, sum(map(len, runs)), sum(c.isalpha() for c in map(chr, own)),
        sum(own.count(c) for c in (b" ", b"-", b"(", b")")), own.count(b"."), own.count(b"@"),
        own.startswith(b"+"), _class(raw, start - 1), _class(raw, end), max(map(len, runs), default=0),
        min(map(len, runs), default=0), len(runs), *[bool(h.search(before)) for h in _HINT]]


def proposals(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Strict spans, and the looser ones that overlap none of them."""
    strict = sorted(strict_spans(raw), key=lambda s: (s[1], s[0]))
    taken = sorted((s, e) for _, s, e in strict)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    starts = np.array([s for s, _ in taken])
    loose = set()
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(raw):
            s, e = m.span()
            k = int(np.searchsorted(starts, e)) if taken else 0
            if not k or ends[k - 1] <= s:
                loose.add((kind, s, e))
    return strict, sorted(loose, key=lambda s: (s[1], s[0], s[2]))


def _label(raw: bytes, kind: int, start: int, end: int) -> bool | None:
    """Whether a loose proposal is right; None if its form passes but nothing near it says so."""
    own = raw[start:end]
    if kind == 0:
        return bool(_ADDRESS.fullmatch(_DOT.sub(b".", _AT.sub(b"@", own)).rstrip(b".,;:!?)]}")))
    runs = re.findall(rb"[0-9]+", own)
    digits = b"".join(runs)
    if kind == 1:
        good = len(runs) == 4 and all(int(r) <= 255 for r in runs)
    elif kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits)
    else:
        good = 10 <= len(digits) <= 15
    return (True if _HINT[kind].search(raw[max(0, start - 32):start]) else None) if good else False


def _code_points(raw: bytes, offsets: list[int]) -> list[int]:
    if raw.isascii():
        return offsets
    inner = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
    return [int(o - np.searchsorted(inner, o)) for o in offsets]


def _maybe(chunk: W.Chunk) -> np.ndarray:
    """Rows with a digit, an at sign or a spelled-out one; no other row can hold a span."""
    d = chunk.data
    spot = ((d - np.uint8(48)) < 10) | (d == 64)
    spot[3:] |= ((d[:-3] == 91) | (d[:-3] == 40)) & (d[1:-2] == 97) & (d[2:-1] == 116) & ((d[3:] == 93) | (d[3:] == 41))
    spot = np.flatnonzero(spot)
    return np.unique(np.searchsorted(chunk.offsets, spot, side="right") - 1)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()),
                   ("label", pa.bool_()), ("f", pa.list_(pa.float32()))])
_SPAN_SQL = "array<struct<kind:int,start:bigint,end:bigint,strict:boolean,label:boolean,f:array<float>>>"


def _propose(text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for chunk in W.chunks(batch.column(text)):
                for r in _maybe(chunk):
                    raw = chunk.data[chunk.offsets[r]:chunk.offsets[r + 1]].tobytes()
                    strict, loose = proposals(raw)
                    spans = [(*s, True) for s in strict] + [(*s, False) for s in loose]
                    at = _code_points(raw, [x for s in spans for x in s[1:3]])
                    out[chunk.first + r] = [
                        {"kind": k, "start": at[2 * i], "end": at[2 * i + 1], "strict": b,
                         "label": b or _label(raw, k, s, e), "f": _features(raw, k, s, e)} for i, (k, s, e, b) in enumerate(spans)]
            keep = [i for i in range(batch.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(out, pa.list_(_SPAN))],
                [*[batch.schema.names[i] for i in keep], "proposed"])
    return run


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``proposed``: spans with code-point offsets, strict or not, and their features."""
    rest = without(docs, ["proposed"]).withColumn("__text", F.col(text).cast("string"))
    rest = rest.select(*[f"`{c}`" for c in rest.columns if c != text])
    schema = rest.drop("__text").withColumn("proposed", F.expr(f"cast(null as {_SPAN_SQL})")).schema
    return rest.mapInArrow(_propose(len(rest.columns) - 1), schema)


class Selector:
    """Trees, calibration and one threshold per kind, fitted on feature rows that stand for many proposals each.

    Row i stands for ``learn[i]`` proposals of the trees and ``tune[i]`` of calibration and thresholds.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, learn: np.ndarray, tune: np.ndarray):
        self.limits = np.full(len(KINDS), np.inf)
        self.trees = self.scale = None
        fold = tune > 0
        if min(len(np.unique(y[fold])), len(np.unique(y[learn > 0]))) < 2:
            return
        self.trees = Trees().fit(x[learn > 0], y[learn > 0], learn[learn > 0])
        x, y, w = x[fold], y[fold], tune[fold]
        margin = self.trees.margin(x)
        self.scale = Isotonic().fit(margin, y, w)
        p = self.scale.predict(margin)
        for k in range(len(KINDS)):
            own = x[:, 0] == k
            levels, at = np.unique(-p[own], return_inverse=True)
            n = np.bincount(at, w[own], minlength=len(levels)).cumsum()
            right = np.bincount(at, w[own] * y[own], minlength=len(levels)).cumsum() / n
            good = np.flatnonzero(right >= PRECISION)
            if len(good):
                self.limits[k] = max(-levels[good[-1]], PRECISION)

    def choose(self, spans: list[dict]) -> list[dict]:
        """Strict spans, and the added ones by falling probability that overlap nothing chosen before."""
        chosen = [s for s in spans if s["strict"]]
        loose = [s for s in spans if not s["strict"]]
        if loose and self.trees is not None:
            x = np.array([s["f"] for s in loose], np.float32)
            p = self.scale.predict(self.trees.margin(x))
            for i in np.argsort(-p, kind="stable"):
                s = loose[i]
                if p[i] >= self.limits[s["kind"]] and all(
                        s["end"] <= c["start"] or c["end"] <= s["start"] for c in chosen):
                    chosen.append(s)
        return sorted(chosen, key=lambda s: (s["start"], s["kind"], s["end"]))


def _coarse(f: Column, steps: int) -> Column:
    """Features but the kind rounded up to ``steps`` values per doubling."""
    return F.transform(f, lambda v, i: F.when((i == 0) | (v < 1), v).otherwise(
        F.pow(F.lit(2.0), F.ceil(F.log2(v) * steps) / steps)).cast("float"))


def fit(proposed: DataFrame, limit: int = MAX_TRAINING_ROWS) -> Selector:
    """Learn from every labelled proposal.

    Equal feature vectors of one class are one row that counts its proposals. Beyond ``limit`` such rows the features
    are rounded more coarsely and the rows merged, which drops no proposal. About a third of every row's proposals
    calibrate.
    """
    rows = proposed.select(F.explode("proposed").alias("s")).where("s.label is not null").select("s.label", "s.f")
    groups = store(rows.groupBy("label", "f").agg(F.count(F.lit(1)).alias("n")))
    for steps in STEPS_PER_DOUBLING:
        if groups.limit(limit + 1).count() <= limit:
            break
        groups = store(groups.groupBy("label", _coarse(F.col("f"), steps).alias("f")).agg(F.sum("n").alias("n")))
    turn = F.pmod(F.xxhash64("f", "label"), F.lit(3))
    tune = F.floor((F.col("n") + turn) / 3)
    known = groups.select("label", "f", tune.cast("double").alias("tune"),
                          (F.col("n") - tune).cast("double").alias("learn")).orderBy("label", "f").toPandas()
    x = np.array(known["f"].tolist(), np.float32).reshape(-1, FEATURES)
    return Selector(x, known["label"].to_numpy(float), known["learn"].to_numpy(float), known["tune"].to_numpy(float))


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def _finish(shared, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selector: Selector = shared.value
        for batch in batches:
            counts, digest, spans = [[] for _ in KINDS], [], []
            for own in batch.column(at).to_pylist():
                strict = [s for s in own if s["strict"]]
                for k in range(len(KINDS)):
                    counts[k].append(sum(s["kind"] == k for s in strict))
                digest.append(hashlib.sha256(_joined(strict).encode()).hexdigest())
                spans.append(_joined(selector.choose(own)) if own else "")
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], *[pa.array(c, pa.int64()) for c in counts], pa.array(digest),
                 pa.array(spans, pa.string())],
                [*[batch.schema.names[i] for i in keep], *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return run


def find(docs: DataFrame, text: str = "text", limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The input's columns without the text, ``n_email`` .. ``n_phone``, ``base_sha256`` and ``spans``.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. A table without both kinds of
    examples gets no added spans. Clashing columns are replaced. Runs jobs while the plan is built.
    """
    names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    proposed = store(propose(without(docs, names), text))
    shared = docs.sparkSession.sparkContext.broadcast(fit(proposed, limit))
    schema = proposed.drop("proposed").select(
        "*", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], F.lit("").alias("base_sha256"),
        F.lit("").alias("spans")).schema
    return proposed.mapInArrow(_finish(shared, proposed.columns.index("proposed")), schema)


def _redactor(shared, text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selector: Selector = shared.value
        for batch in batches:
            texts: dict[int, str] = {}
            for chunk in W.chunks(batch.column(text)):
                for r in _maybe(chunk):
                    raw = chunk.data[chunk.offsets[r]:chunk.offsets[r + 1]].tobytes()
                    strict, loose = proposals(raw)
                    spans = selector.choose([
                        {"kind": k, "start": s, "end": e, "strict": b, "f": [] if b else _features(raw, k, s, e)}
                        for group, b in ((strict, True), (loose, False)) for k, s, e in group])
                    if not spans:
                        continue
                    parts, done = [], 0
                    for s in spans:
                        if s["start"] >= done:
                            parts += [raw[done:s["start"]], f"[{KINDS[s['kind']].upper()}]".encode()]
                        done = max(done, s["end"])
                    texts[chunk.first + r] = (b"".join(parts) + raw[done:]).decode()
            columns = list(batch.columns)
            if texts:
                columns[text] = pa.array([texts.get(i, t) for i, t in enumerate(columns[text].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return run


def redact(docs: DataFrame, text: str = "text", limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The same rows and columns, with every chosen span replaced by its kind in brackets; null stays null."""
    selector = fit(propose(docs.select(F.col(text).alias("text"))), limit)
    shared = docs.sparkSession.sparkContext.broadcast(selector)
    return docs.mapInArrow(_redactor(shared, docs.columns.index(text)), docs.schema)
