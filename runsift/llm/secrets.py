"""Secret scans with DataFrame functions alone: fixed patterns, and sliding-window entropy over candidate strings.

Positions come from splitting a text at the matches of a pattern: the pieces between matches and the matches themselves
add up to offsets. Nothing is shuffled.

Candidates are runs of key-like characters with a digit and a letter. A window slides over each, one character enters
and one leaves, and only their two counts change the entropy. Windows at or above the limit of the candidate's
character class are joined to one span, unless an allow-list pattern matches the candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.storage import without

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run cannot hold a longer match that begins later
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: (class, its pattern, its characters, bits that a window must reach)
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.1),
    ("alnum", r"^[A-Za-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.7),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.9),
)
#: Candidates that look random and are none.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefghij|0123456789",
    r"^[^/]*(/[A-Za-z_=-]+)+/?[0-9]*$",
)
_ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,said:string>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Every leftmost, non-overlapping match with its offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(state: Column, i: Column) -> Column:
        said = F.get(found, i)
        start = state["at"] + F.length(F.get(pieces, i))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(said)).alias("end"),
                        said.alias("said"))
        return F.struct((start + F.length(said)).alias("at"), F.array_append(state["out"], span).alias("out"))

    every = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(
        F.expr("cast(array() as array<int>)"))
    return F.aggregate(every, begin, step, lambda s: s["out"])


def _lookup(values: list[float], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def window_span(said: Column, characters: str, bits: float, window: int = WINDOW) -> Column:
    """First and last position (end exclusive) covered by windows of ``bits`` or more; null where there is none."""
    of_count = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    letters = F.split(said, "")
    at = F.transform(letters, lambda c: F.instr(F.lit(characters), c) - 1)
    counts = F.array_repeat(F.lit(0), len(characters))
    begin = F.struct(counts.alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"),
                     F.lit(None).cast("int").alias("last"))

    def step(state: Column, i: Column) -> Column:
        enters, leaves = F.get(at, i), F.coalesce(F.get(at, i - window), F.lit(-1))
        gone = F.coalesce(F.get(state["counts"], leaves), F.lit(0))
        here = F.get(state["counts"], enters) - (enters == leaves).cast("int")
        total = (state["sum"] - _lookup(of_count, gone) + _lookup(of_count, F.greatest(gone - 1, F.lit(0)))
                 - _lookup(of_count, here) + _lookup(of_count, here + 1))
        moved = F.transform(state["counts"], lambda c, j: c + (j == enters).cast("int") - (j == leaves).cast("int"))
        high = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= bits - 1e-9)
        return F.struct(
            moved.alias("counts"), total.alias("sum"),
            F.coalesce(state["first"], F.when(high, i - (window - 1))).alias("first"),
            F.when(high, i + 1).otherwise(state["last"]).alias("last"))

    whole = F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), begin, step,
                        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return F.when(F.length(said) >= window, whole)


def _entropy_spans(text: Column, allowed: tuple[str, ...]) -> Column:
    def keep(s: Column) -> Column:
        plain = s["said"].rlike("[0-9]") & s["said"].rlike("[A-Za-z]")
        for pattern in allowed:
            plain = plain & ~s["said"].rlike(pattern)
        return plain

    def narrowed(s: Column) -> Column:
        inner = None
        for _, pattern, characters, bits in reversed(CLASSES):
            own = window_span(s["said"], characters, bits)
            inner = own if inner is None else F.when(s["said"].rlike(pattern), own).otherwise(inner)
        return F.struct((s["start"] + inner["first"]).alias("start"), s["kind"].alias("kind"),
                        (s["start"] + inner["last"]).alias("end"), F.lit("").alias("said"))

    found = F.filter(_matches(text, CANDIDATE, 3), keep)
    return F.filter(F.transform(found, narrowed), lambda s: s["start"].isNotNull())


def _joined(spans: Column) -> Column:
    def said(s: Column) -> Column:
        kind = F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
        return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, said), ",")


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The input's rows with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.

    ``spans`` holds the fixed patterns' spans and the entropy spans that overlap none of them, as kind:start:end in code
    points. Null and empty texts have none. Clashing columns are replaced. Very long texts are one row like any other.
    """
    out = without(docs, _ADDED).withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t, low = F.col("__t"), F.lower("__t")
    none = F.expr(f"cast(array() as {_SPAN})")
    spoken = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    group = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(
        F.transform(_matches(t, ASSIGN, 0), lambda s, i: F.struct(s.alias("span"), F.length(F.get(group, i)).alias("n"))),
        lambda x: x["n"] >= ASSIGN_LENGTH)
    out = out.withColumns({
        "__a": F.when(spoken, F.transform(assign, lambda x: x["span"])).otherwise(none),
        "__k": F.when(t.contains("AKIA"), _matches(t, ACCESS, 1)).otherwise(none),
        "__h": F.when(t.rlike(HEX), _matches(t, HEX, 2)).otherwise(none),
        "__e": F.when(t.rlike(CANDIDATE), _entropy_spans(t, allowed)).otherwise(none),
    })
    base = F.array_sort(F.transform(F.concat("__a", "__k", "__h"), lambda s: s.withField("said", F.lit(""))))
    out = out.withColumn("__base", base)
    free = F.filter("__e", lambda e: ~F.exists("__base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return out.withColumns({
        "n_assign": F.size("__a").cast("long"), "n_access": F.size("__k").cast("long"),
        "n_hex": F.size("__h").cast("long"), "base_sha256": F.sha2(_joined(F.col("__base")), 256),
        "spans": _joined(F.array_sort(F.concat("__base", free))),
    }).drop("__t", "__a", "__k", "__h", "__e", "__base")
