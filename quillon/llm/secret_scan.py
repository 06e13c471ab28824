"""Secret scans: base patterns, and multipart credentials linked by an interval join within scopes."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import small_batches, staged, worker_state

# Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ID = re.compile(
    r"""\b(?:client|account|access|key|app|tenant|user|login)[_-]?(?:id|name)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,}|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:\d{2,5}\b""")
BLANK_LINE = re.compile(r"\n[\x20\t]*\n")
LEAST_ENTROPY = 3.5

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_PART = pa.struct([("role", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32()), ("weak", pa.bool_())])
_SPAN_SQL = "array<struct<kind:int,start:int,end:int>>"
_PART_SQL = "array<struct<role:int,start:int,end:int,scope:int,weak:boolean>>"
_ID, _SECRET, _ENDPOINT = 3, 4, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by start and kind: leftmost, non-overlapping within a kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _strong_looking(token: str) -> bool:
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    counts = Counter(token)
    return -sum(c / len(token) * math.log2(c / len(token)) for c in counts.values()) >= LEAST_ENTROPY


class Taken:
    """Intervals of a text; tells whether another is clear of all of them."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def clear_of(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start


def credential_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(role, start, end, scope, weak): identifiers, secrets and endpoints of a text that holds any secret."""
    taken = Taken([(s, e) for _, s, e in base])
    weak = [(_SECRET, m.start(), m.end(), True) for m in WEAK_SECRET.finditer(text) if _strong_looking(m[0]) and taken.clear_of(*m.span())]
    parts = weak + [(_ID if k == 1 else _SECRET, s, e, False) for k, s, e in base]
    if not any(p[0] == _SECRET for p in parts):
        return []
    taken = Taken([(s, e) for _, s, e, _ in parts])
    for role, pattern, group in ((_ID, WEAK_ID, 1), (_ENDPOINT, ENDPOINT, 0)):
        for m in pattern.finditer(text):
            if taken.clear_of(*m.span(group)):
                parts.append((role, *m.span(group), True))
    if not any(p[3] for p in parts):
        return []
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    return [(r, s, e, bisect_left(breaks, s), w) for r, s, e, w in sorted(parts)]


def _scan(carry: list[str]):
    def run(batches):
        worker_state("secret_scan")
        for batch in batches:
            base, parts = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text or "")
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                parts.append(
                    [dict(zip(("role", "start", "end", "scope", "weak"), p, strict=True)) for p in credential_parts(text or "", found)]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(base, pa.list_(_SPAN)), pa.array(parts, pa.list_(_PART))],
                names=[*carry, "base_spans", "parts"],
            )

    return run


def linked_parts(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts that stand within ``reach`` characters of what completes them, in one scope: ``(uid, kind, start, end)``.

    An interval join: a part lies in all bins from its start to its end, and
    looks at these and the bins beside them, so a part within ``reach`` is met
    in one bin at least.  An identifier needs a secret, a secret an identifier
    or an endpoint, an endpoint both.  A bin holds at most ``reach`` starts.
    """
    first, last = f"cast(start / {reach} as int)", f"cast(end / {reach} as int)"
    weak = parts.where("weak").withColumn("bin", F.explode(F.expr(f"sequence({first} - 1, {last} + 1)")))
    other = parts.select(
        "uid",
        "scope",
        F.explode(F.expr(f"sequence({first}, {last})")).alias("bin"),
        F.col("role").alias("r"),
        F.col("start").alias("s"),
        F.col("end").alias("e"),
    )
    near = weak.join(other, ["uid", "scope", "bin"]).where(f"s - end <= {reach} and start - e <= {reach} and r <> role")
    has = near.groupBy("uid", "role", "start", "end").agg(
        *[F.max((F.col("r") == k).cast("int")).alias(n) for k, n in ((_ID, "id"), (_SECRET, "secret"), (_ENDPOINT, "endpoint"))]
    )
    return has.where(
        f"(role = {_ID} and secret = 1) or (role = {_SECRET} and (id = 1 or endpoint = 1)) or (role = {_ENDPOINT} and id = 1 and secret = 1)"
    ).select("uid", F.col("role").alias("kind"), "start", "end")


def secret_scan(docs: DataFrame, reach: int = 200, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets of every whole text: one row per input row, ``carry`` columns, ``base_spans`` and ``linked_spans``.

    Spans are ``(kind, start, end)``, kind an index of KINDS, in code points.
    Base spans follow the fixed patterns.  Weak candidates (identifiers,
    high-entropy tokens, endpoints) are added only when parts that complete
    each other stand within ``reach`` characters of one paragraph.

    A null text counts as empty: no spans.  Rows repeated whole, null ids and
    other columns are kept as they are; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    carry = list(carry)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    cols = list(dict.fromkeys([*carry, "text"]))
    found = staged(
        docs.select(*cols)
        .mapInArrow(_scan(carry), f"{schema}, base_spans {_SPAN_SQL}, parts {_PART_SQL}")
        .withColumn("_uid", F.monotonically_increasing_id()),
        "secrets",
    )
    parts = found.where("size(parts) > 0").select(F.col("_uid").alias("uid"), F.inline("parts"))
    linked = (
        linked_parts(parts, reach)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("linked_spans"))
    )
    return found.join(linked, F.col("_uid") == F.col("uid"), "left").select(
        *carry, "base_spans", F.coalesce("linked_spans", F.from_json(F.lit("[]"), _SPAN_SQL)).alias("linked_spans")
    )


def span_text(spans):
    """``kind:start:end`` joined by commas, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """The rows of ``docs`` with every span found by ``secret_scan`` replaced; ``n_chars``, if there, follows the text.

    Overlapping spans become one mask.  Null texts stay null.
    """
    columns = docs.columns
    inner = {c: "text" if c == "text" else f"_c{i}" for i, c in enumerate(columns)}
    found = secret_scan(docs.toDF(*inner.values()), reach, tuple(inner.values()))

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            at, bits = 0, []
            if t is None:
                out.append(None)
                continue
            for start, end in sorted((s["start"], s["end"]) for s in own):
                if start >= at:
                    bits += [t[at:start], mask]
                at = max(at, end)
            out.append("".join(bits) + t[at:])
        return pd.Series(out)

    every = F.concat("base_spans", "linked_spans")
    changed = F.size(every) > 0
    out = found.withColumn("text", F.when(changed, masked("text", every)).otherwise(F.col("text")))
    if "n_chars" in columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(inner["n_chars"], F.when(changed, count).otherwise(F.col(inner["n_chars"])))
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()])
