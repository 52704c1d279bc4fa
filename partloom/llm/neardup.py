"""Near-duplicate groups by a signature-coordinate inverted join.

Every text becomes its set of word shingles and K MinHash coordinates. Texts with equal sets are one class from the start.
Classes are posted under each (coordinate, value) pair. A pair of sets as similar as asked agrees on at least `least` of the
K coordinates (but for odds of MISS), so it agrees on one of any K - least + 1 of them: each class keeps that many of its
rarest values as its prefix, and values that no other class has, which are the rarest, need no posting at all; a class
with a prefix of such values is left out.

Pairs that meet in a posting are merged, skipping pairs that links already connect: groups are connected components, so
these can add nothing. Long postings begin with rounds in which each member meets one pivot of its posting only; what the
rounds connect need not meet again. Then long postings are split into tiles of bounded size, in which the members outside
the posting's largest component meet all others, and short ones give their pairs by a join. The collisions of each pair
are counted on the whole signatures, pairs with at least `least` are retained, and these are confirmed on full sets; of a
tile's links a forest is kept, which connects the same.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle has,
but not none, is one shingle; rows are told apart by themselves and not by their id, so rows with equal ids can be in
different groups, and a row with a null id is in its group like any other, whose component_id is the smallest id that is not
null (null if there is none); repeated rows are all in the result; texts of any length are used whole; columns other than
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import arrow_rows, fresh, stored
from partloom.llm.components import components
from partloom.llm.shingles import minhash, shingles

K = 64
#: Odds that two sets just similar enough agree on fewer coordinates than are asked for.
MISS = 1e-6
#: Members up to which a posting gives all its pairs by a join, and shingles on a side of a longer one's tile.
SHORT, TILE = 64, 1 << 17
#: Shared shingles compared at once, which bounds a tile's memory.
COLUMNS = 4096
#: A round of pivots is worth its passes while it leaves at most this share of the tiles' pairs.
WORTH = 0.7
#: Bits of the filter of texts whose sets are needed: so many for each, and at most; a fuller filter passes more, none fewer.
BITS_EACH, MOST_BITS = 16, 1 << 27


def least_matches(percent: int, k: int = K, miss: float = MISS) -> int:
    """The most coordinates that a pair with similarity percent / 100 agrees on but for odds of miss."""
    s, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * s**t * (1 - s) ** (k - t)
        if tail > miss:
            return max(t, 1)
    return k


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hash of the text), at (hash of both), n_shingles, set_key (digest of the set; null if empty) and the K coordinates of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def step(c: dict) -> dict:
        sets = shingles(c["text"], width)
        sig = minhash(sets, K).view(np.int32)
        ends = np.arange(0, K * (len(sets) + 1), K, dtype=np.int32)
        key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return {"doc_id": c["doc_id"], "h": c["h"], "at": c["at"], "n_shingles": [len(s) for s in sets], "set_key": key, "sig": pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))}

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), _at())
    return hashed.mapInArrow(arrow_rows(["doc_id", "text", "h", "at"], schema, step), "doc_id bigint, h bigint, at bigint, n_shingles bigint, set_key binary, sig array<int>")


def prefixes(classes: DataFrame, least: int) -> DataFrame:
    """node and key of every posting in a prefix that another class shares."""
    posted = classes.select("node", F.posexplode("sig").alias("k", "value")).select("node", (F.col("value").cast("long") * K + F.col("k")).alias("key"))
    shared = stored(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = posted.join(shared, "key")
    own = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("met"))
    # The values that no other class has come first in the prefix; what is left of it is filled with the rarest shared ones.
    room = F.lit(K - least + 1) - (F.lit(K) - F.size("met"))
    return own.where(room > 0).select("node", F.explode(F.slice("met", F.lit(1), room)).alias("p")).select("node", "p.key")


def _filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of keys, of bounded size."""
    n, bits = keys.count(), 1 << 16
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits <<= 1
    slot = F.pmod(F.xxhash64("at"), F.lit(bits))
    cells = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[cells["cell"].to_numpy(np.int64)] = cells["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, sig and sorted shingle hashes of the given nodes (node, at, set_key, sig), from their texts."""
    cells = _filter(nodes.select("at"))
    bits = docs.sparkSession.sparkContext.broadcast(cells)  # MOST_BITS at most
    schema = pa.schema([("at", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def step(c: dict) -> dict:
        slot = np.array(c["slot"], np.int64)
        on = np.flatnonzero(bits.value[slot >> 5] >> (slot & 31).astype(np.uint32) & 1)
        on = on[np.unique(np.array(c["at"], np.int64)[on], return_index=True)[1]].tolist()
        sets = shingles([c["text"][i] for i in on], width)
        key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return {"at": [c["at"][i] for i in on], "set_key": key, "shingles": [s.view(np.int64) for s in sets]}

    hashed = docs.select("text", _at(), F.pmod(F.xxhash64(_at()), F.lit(len(cells) * 32)).alias("slot"))
    found = hashed.mapInArrow(arrow_rows(["text", "at", "slot"], schema, step), "at bigint, set_key binary, shingles array<bigint>")
    sets = stored(found.join(nodes, ["at", "set_key"]).select("node", "sig", "shingles"), "sets")
    # Only rows that are equal in id and text give a node's set more than once.
    return sets if sets.count() == nodes.count() else stored(sets.dropDuplicates(["node"]), "sets")


def _at() -> Column:
    """What tells rows apart that differ in id or text."""
    return F.xxhash64("doc_id", "text").alias("at")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, key and component, which is the node itself as long as nothing is linked with it."""
    if labels is None:
        return postings.withColumn("component", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member and the pivot of its posting, unless they are connected. A hash decides, the same one for all postings, so
    postings of the same members have the same pivot and give the same pairs."""
    pivots = members.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("pivot"), F.col("component").alias("of")), F.xxhash64("node", F.lit(turn))).alias("p")).select("key", "p.*")
    return members.join(pivots, "key").where("component <> of").select(*_pair("node", "pivot")).distinct()


def short_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a posting that aren't connected; each posting has SHORT members at most."""
    a = members.select("key", F.col("node").alias("a"), F.col("component").alias("x"))
    b = members.select("key", F.col("node").alias("b"), F.col("component").alias("y"))
    return a.join(b, "key").where("a < b and x <> y").select(*_pair("a", "b")).distinct()


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a (rows) and b (columns), in pieces of COLUMNS shared elements."""
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    _, column, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        x = np.zeros((len(a) + len(b), min(COLUMNS, total - lo)), np.float32)
        x[owner[i:j], column[i:j] - lo] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def _forest(pairs, component: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of members, those that connect components not yet connected."""
    root = {c: c for c in component.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in pairs:
        if (p := find(int(component[x]))) != (q := find(int(component[y]))):
            root[p] = q
            out.append((x, y))
    return out


def tile_links(members: DataFrame, sets: DataFrame, percent: int, least: int, tile: int = TILE) -> DataFrame:
    """Links u and v that connect what the links between members of each long posting do.

    One side of the tiles are all members, the other those outside the posting's largest component, which alone are copied
    to more than a few tiles. A tile has about `tile` shingles on a side, or a single member. Its members' collisions are
    counted, and pairs that reach `least` are confirmed on the sets there and then, in the first posting that they share.
    """
    m = members.join(sets.withColumn("size", F.size("shingles")), "node")
    per = m.groupBy("key", "component").agg(F.sum("size").alias("n"))
    per = per.groupBy("key").agg(F.sum("n").alias("all"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"))
    per = stored(per.select("key", "main", F.ceil(F.col("all") / tile).cast("int").alias("rows"), F.ceil((F.col("all") - F.col("most")) / tile).cast("int").alias("cols")).where("cols > 0"), "tiles")
    keys = members.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # of a prefix, so few
    m = stored(m.join(per, "key").join(keys, "node"), "members")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    i, j = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols")).cast("int")
    what = ["key", "node", "component", "keys", "sig", "shingles"]
    every = m.select(*what, F.lit(0).alias("side"), i.alias("i"), spread("cols").alias("j"))
    rest = m.where("component <> main").select(*what, F.lit(1).alias("side"), spread("rows").alias("i"), j.alias("j"))

    def meet(table: pa.Table) -> pa.Table:
        side, node, of = (table.column(c).to_numpy() for c in ("side", "node", "component"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, K)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hits = np.zeros((len(left), len(right)), np.uint8)
        for k in range(K):
            hits += sig[left, k][:, None] == sig[right, k][None, :]
        wanted = (hits >= least) & (of[left][:, None] != of[right][None, :])
        rows, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        links: list[tuple[int, int]] = []
        if len(rows):
            left, right, wanted = left[rows], right[cols], wanted[np.ix_(rows, cols)]
            key = table.column("key")[0].as_py()
            # Pairs that share an earlier posting meet there.
            earlier = [{x for x in table.column("keys")[int(k)].as_py() if x < key} for k in (*left, *right)]
            number = {x: n for n, x in enumerate(set().union(*earlier))}
            has = np.zeros((len(earlier), max(1, len(number))), np.float32)
            for k, own in enumerate(earlier):
                has[k, [number[x] for x in own]] = 1
            wanted &= has[: len(left)] @ has[len(left) :].T == 0
            shingle = table.column("shingles").combine_chunks()
            sets = [shingle[int(k)].values.to_numpy() for k in (*left, *right)]
            if wanted.any():
                size = np.array([len(s) for s in sets], np.float64)
                both = _common(sets[: len(left)], sets[len(left) :])
                near = wanted & (100 * both >= percent * (size[: len(left)][:, None] + size[len(left) :][None, :] - both))
                links = _forest(((left[x], right[y]) for x, y in zip(*np.nonzero(near))), of)
        a, b = (np.array([node[pair[k]] for pair in links], np.int64) for k in (0, 1))
        return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)})

    return every.unionByName(rest).groupBy("key", "i", "j").applyInArrow(meet, "u bigint, v bigint").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs u and v that agree on `least` coordinates and are as similar as asked."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("shingles").alias(f"set_{end}"))
    hits = F.aggregate(F.zip_with("sig_u", "sig_v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    both = F.size(F.array_intersect("set_u", "set_v"))
    met = pairs.join(side("u"), "u").join(side("v"), "v").where(hits >= least)
    return met.where(100 * both >= percent * (F.size("set_u") + F.size("set_v") - both)).select("u", "v")


def linked(postings: DataFrame, sets: DataFrame, percent: int, least: int, short: int = SHORT, tile: int = TILE) -> DataFrame:
    """node and component of all nodes that links connect."""
    sizes = stored(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    links: list[DataFrame] = []
    labels: DataFrame | None = None
    together = lambda: stored(components(reduce(DataFrame.unionByName, links)), "labels")
    long = postings.join(sizes.where(F.col("n") > short).select("key"), "key")
    if not sizes.where(F.col("n") > short).isEmpty():
        long, turn, before = stored(long, "long"), 0, math.inf
        while True:
            # Pairs that tiles would have to meet: members outside a posting's largest component, each with all members.
            of = _labelled(long, labels).groupBy("key", "component").agg(F.count("*").alias("n"))
            left = of.groupBy("key").agg(((F.sum("n") - F.max("n")) * F.sum("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
            if not left or left > WORTH * before:
                break
            before = left
            found = stored(confirmed(stored(pivot_pairs(_labelled(long, labels), turn), "pairs"), sets, percent, least), "links")
            links.append(found)
            labels, turn = together(), turn + 1
        links.append(stored(tile_links(_labelled(long, labels), sets, percent, least, tile), "links"))
        labels = together()
    rest = postings.join(sizes.where(F.col("n") <= short).select("key"), "key")
    pairs = stored(short_pairs(_labelled(rest, labels)), "pairs")
    links.append(stored(confirmed(pairs, sets, percent, least), "links"))
    return together()


def row_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_shingles, group (null without shingles), and the group's smallest id and the
    text hash that stands with it."""
    docs = docs.select("doc_id", "text")
    least = least_matches(percent)
    sigs = stored(signatures(docs, width).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = stored(sigs.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("row").alias("node"), F.min(first).alias("first")), "classes")
    one = sigs.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "at", "set_key", "sig")
    postings = stored(prefixes(one, least), "postings")
    sets = sets_of(docs, stored(one.join(postings.select("node").distinct(), "node", "left_semi"), "nodes"), width)
    labels = linked(postings, sets, percent, least)
    groups = classes.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node"))
    best = groups.groupBy("group").agg(F.min("first").alias("best"))
    groups = stored(groups.select("set_key", "group").join(best, "group").select("set_key", "group", F.col("best.doc_id").alias("least_id"), F.col("best.h").alias("least_h")), "groups")
    return sigs.select("doc_id", "h", "n_shingles", "set_key").join(groups, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id among the documents it is linked with, in turns."""
    rows = row_groups(docs, width, percent)
    return rows.select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: three-word shingles, similarity of 0.85 or more; a row with a null id isn't kept."""
    return near_duplicates(docs, 3, 85).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(len(w), 3)], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, d.doc_id = min(r.seen) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that with the smallest id, then by a hash of the text, then any of equal rows.

    Rows without shingles are in no group and stay. A row is told by its id and a hash of its text.
    """
    h = fresh(docs, "h")
    rows = row_groups(docs, width, percent).where(F.col("group").isNotNull())
    stays = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("h") == F.col("least_h"))
    rows = stored(rows.groupBy("doc_id", F.col("h").alias(h)).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "repeated")
    here = docs.withColumn(h, F.xxhash64("text"))

    def among(table: DataFrame, how: str) -> DataFrame:
        t = table.select(F.col("doc_id").alias("_id"), F.col(h).alias("_h"))
        return here.join(t, here["doc_id"].eqNullSafe(t["_id"]) & (here[h] == t["_h"]), how)

    kept = among(rows, "left_anti").select(*docs.columns)
    again = rows.where("stays")
    if again.isEmpty():
        return kept
    return kept.unionByName(among(again, "left_semi").dropDuplicates(["doc_id", h]).select(*docs.columns))
