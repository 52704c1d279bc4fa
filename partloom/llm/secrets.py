"""Secret scan with multipart credential linking.

Strong findings (base kinds) are reported wherever they stand. Weak parts (account names, endpoints, high-entropy words)
say little alone; each is an interval on the text, widened to its scope, and is reported only if its scope meets that of a
part that completes it: an account name needs a secret, an endpoint needs a secret or an access identifier, an entropy word
needs an account name, an access identifier or an endpoint, and is a secret where it has one. A scope reaches SCOPE characters
to either side. The interval join sorts the ends of one side and looks up the other, so it takes
n log n steps. A weak part that overlaps a base span is no part. Parts of any length are taken whole.

Defined cases: null text is empty and has no spans; repeated rows each get their row, and a null doc_id keeps its row; spans
of one kind never overlap; texts of any length are scanned whole; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import annotated, arrow_rows

# The base patterns and least lengths of the contract.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "account", "endpoint", "entropy")
ACCOUNT = re.compile(r"""\b(?ai:user(?:name|_id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?(?![\d.])")
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")

#: Characters on either side of a part in which its complement must lie.
SCOPE = 160
#: Bits a character from which a mixed word counts as an entropy candidate.
LEAST_BITS = 3.5

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _bits(word: str) -> float:
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def weak_parts(text: str) -> list[Span]:
    found = [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)] if ":" in text or "=" in text else []
    found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    for m in WORD.finditer(text):
        w = m[0]
        if any(c.isdigit() for c in w) and any(c.isupper() for c in w) and any(c.islower() for c in w) and _bits(w) >= LEAST_BITS:
            found.append(("entropy", m.start(), m.end()))
    return found


def meets(left: Iterable[Span], right: list[Span], scope: int = SCOPE) -> set[Span]:
    """The left spans of which some right span lies within scope characters, without overlapping it."""
    starts, ends = sorted(s for _, s, _ in right), sorted(e for _, _, e in right)

    def near(s: int, e: int) -> bool:
        i, j = bisect_left(starts, e), bisect_left(ends, s - scope)
        return i < len(starts) and starts[i] <= e + scope or j < len(ends) and ends[j] <= s

    return {span for span in left if near(span[1], span[2])}


def linked(text: str, base: list[Span]) -> list[Span]:
    """The weak parts whose complements co-occur in their scope."""
    weak = weak_parts(text)
    if not weak:
        return []
    taken = sorted((s, e) for _, s, e in base)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(span: Span) -> bool:
        """Whether no base span that begins before the span's end reaches into it."""
        i = bisect_left(begins, span[2])
        return not i or reach[i - 1] <= span[1]

    weak = [x for x in weak if free(x)]
    of = {k: [x for x in weak if x[0] == k] for k in KINDS[3:]}
    strong = [x for x in base if x[0] != "access"]
    ids = of["account"] + [x for x in base if x[0] == "access"]
    entropy = meets(of["entropy"], ids) | meets(of["entropy"], of["endpoint"]) if of["entropy"] else set()
    secrets = strong + list(entropy)
    return [*meets(of["account"], secrets), *meets(of["endpoint"], secrets + [x for x in base if x[0] == "access"]), *entropy]


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def render(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


def redact(text: str, spans: Iterable[Span]) -> str:
    """text with each run of overlapping spans replaced by a mark of its first kind."""
    out, at = [], 0
    for kind, s, e in ordered(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", SPANS), ("extra", SPANS), ("redacted", pa.string())])


def scan(docs: DataFrame, redacted: bool = True) -> DataFrame:
    """doc_id, base and linked spans and, if wanted, the redacted text of each row of documents."""
    schema = SCHEMA if redacted else SCHEMA.remove(SCHEMA.get_field_index("redacted"))
    row = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in ordered(spans)]

    def step(c: dict) -> dict:
        texts = [t or "" for t in c["text"]]
        base = [base_spans(t) for t in texts]
        extra = [linked(t, b) for t, b in zip(texts, base)]
        return {"doc_id": c["doc_id"], "base": [row(b) for b in base], "extra": [row(x) for x in extra], "redacted": [t if t is None or not redacted else redact(t, b + x) for t, b, x in zip(c["text"], base, extra)]}

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(arrow_rows(["doc_id", "text"], schema, step), f"doc_id bigint, base {kind}, extra {kind}" + ", redacted string" * redacted)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from scan()."""
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return scan(docs, redacted=False).select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(keyed).alias("spans"))



def redacted(docs: DataFrame) -> DataFrame:
    """docs with a mark in place of each secret, and n_chars of the new texts; clean rows stay as they are."""
    fields = [("text", "string", pa.string())]

    def step(texts: list[str | None]) -> list[list]:
        out = []
        for t in texts:
            base = base_spans(t or "")
            spans = base + linked(t or "", base)
            out.append(redact(t, spans) if spans else t)
        return [out]

    found = annotated(docs, fields, step, replace=("text",))
    return found.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
