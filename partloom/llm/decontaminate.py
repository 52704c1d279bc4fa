"""Benchmark decontamination by winnowing, in DataFrame operations only.

Items and documents are cut into words; K-word grams are hashed, and of the grams in each window of SPAN words the least
hash is the window's fingerprint. Two equal spans have equal fingerprints, so every shared span of SPAN words or more is
met: documents keep the windows whose fingerprint is one of the benchmark's (first by a bitmap of bounded size, which only
ever lets too much pass), and these hits are extended to the whole span by joining on the hash of all its words. Items of
fewer than SPAN words are one window, met by the hash of all their words.

Defined cases: null and empty texts have no words; items without words meet nothing; every row gets its row, whatever its
id, null ids included; repeated items count once by id, and an item with a null id is hit but not listed; texts of any
length are cut whole; empty tables meet nothing; other columns are ignored; ties between equal gram hashes don't matter, as the
fingerprint is the hash and not a place.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import fresh, stored

SPAN = 10
GRAM = 5
#: Windows of the benchmark up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Bits of the fingerprint bitmap, at most; a fuller bitmap passes more windows on to the join, none fewer.
MOST_BITS = 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; lower() does where no other character has a lower case."""
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gram(h: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(h, at + k) for k in range(n)])


def _least(g: Column, at: Column) -> Column:
    return F.least(*[F.get(g, at + k) for k in range(SPAN - GRAM + 1)])


def _places(size: Column, n: int) -> Column:
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def _windows(h: Column, keep_long, keep_short, lengths: list[int]) -> Column:
    """start, n, print and whole hash of the windows that pass the given tests of fingerprints."""
    size = F.size(h)
    kind = "array<struct<start:int,n:int,print:bigint,whole:bigint>>"

    def long(g: Column) -> Column:
        row = lambda j: F.struct(j.alias("start"), F.lit(SPAN).alias("n"), _least(g, j).alias("print"), _gram(h, j, SPAN).alias("whole"))
        at = _places(size, SPAN)
        return F.transform(F.filter(at, lambda j: keep_long(_least(g, j))) if keep_long else at, row)

    parts = [_let(F.transform(_places(size, GRAM), lambda i: _gram(h, i, GRAM)), long).cast(kind)]

    def short(n: int) -> Column:
        at = _places(size, n)
        row = lambda j: F.struct(j.alias("start"), F.lit(n).alias("n"), _gram(h, j, n).alias("print"), _gram(h, j, n).alias("whole"))
        return F.transform(F.filter(at, lambda j: keep_short(_gram(h, j, n))) if keep_short else at, row).cast(kind)

    parts += map(short, lengths)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def item_windows(bench: DataFrame) -> DataFrame:
    """item_id, n, print and whole of every window of the items; an item of fewer than SPAN words is one window."""
    h = bench.select("item_id", _hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    full = h.where(F.size("h") >= SPAN).select("item_id", F.explode(_windows(F.col("h"), None, None, [])).alias("w"))
    full = full.select("item_id", "w.n", "w.print", "w.whole")
    # A whole short item: its gram of as many words as it has.
    whole = F.coalesce(*[F.when(F.size("h") == n, _gram(F.col("h"), F.lit(0), n)) for n in range(1, SPAN)])
    short = h.where(F.size("h") < SPAN).select("item_id", F.size("h").alias("n"), whole.alias("print"), whole.alias("whole"))
    return full.unionByName(short).distinct()


def _bitmap(prints: DataFrame, count: int):
    """A test whether a fingerprint's bit is set, from a bitmap whose size depends on count and is bounded."""
    bits = 1 << 12
    while bits < 32 * count and bits < MOST_BITS:
        bits <<= 1
    slot = lambda p: F.shiftrightunsigned(p, 7).bitwiseAND(F.lit(bits - 1))
    s = prints.select(slot(F.col("print")).alias("s"))
    cells = s.groupBy(F.shiftright("s", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("v")).collect()
    cell = [0] * (bits // 32)
    for r in cells:
        cell[r["cell"]] = r["v"]
    table = F.from_json(F.lit(json.dumps(cell)), "array<bigint>")

    def test(p: Column) -> Column:
        return _let(slot(p), lambda s: F.get(table, F.shiftright(s, 5).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(31)).cast("int"))) != 0)

    return test


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, spans (start and end of the hit words, merged windows not joined) and item_ids."""
    items = stored(item_windows(bench.select("item_id", "text")), "items")
    stats = {r["n"]: r["c"] for r in items.groupBy("n").agg(F.count("*").alias("c")).collect()}
    total, lengths = sum(stats.values()), sorted(n for n in stats if n < SPAN)
    long = _bitmap(items.where(F.col("n") == SPAN).select("print").distinct(), stats.get(SPAN, 0)) if SPAN in stats else lambda p: F.lit(False)
    short = _bitmap(items.where(F.col("n") < SPAN).select("print").distinct(), total) if lengths else None
    h = docs.select("doc_id", _hashes(F.col("text")).alias("h"))
    found = h.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("h").cast("long").alias("n_words"), _windows(F.col("h"), long, short, lengths).alias("met"))
    found = stored(found, "met")

    whole = items.groupBy("n", "whole").agg(F.collect_set("item_id").alias("items"))
    whole = F.broadcast(whole) if total <= BROADCAST_WINDOWS else whole
    hits = found.where(F.size("met") > 0).select("row", F.explode("met").alias("w")).select("row", "w.start", "w.n", "w.whole").join(whole, ["n", "whole"])
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    ids = hits.select("row", F.explode("items").alias("item_id")).distinct().groupBy("row").agg(F.collect_list("item_id").alias("item_ids"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"])
    out = found.select("row", "doc_id", "n_words").join(spans, "row", "left").join(ids, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), "spans", "item_ids")


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's columns, from overlaps()."""
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    o = overlaps(docs, bench)
    return o.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that share no window with the benchmark. Their texts alone decide: rows are told by a hash of the text
    and its length, whatever their ids; a null text shares nothing."""
    h, size = fresh(docs, "h"), fresh(docs, "size")
    texts = docs.where(F.col("text").isNotNull()).select(F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("size")).alias("doc_id"), "text")
    hit = stored(overlaps(texts, bench).where("n_hit > 0").select(F.col("doc_id.h").alias(h), F.col("doc_id.size").alias(size)).distinct(), "hit")
    return docs.join(hit, (F.xxhash64("text") == F.col(h)) & (F.length("text") == F.col(size)), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""
