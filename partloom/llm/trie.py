"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A turn is its digest (SHA-256 of role and text, 128 bits of it) and its number of code points; texts never move. A prefix of
turns is a node, named by sums over its turns of 128-bit hashes of place and digest, so the names of a whole conversation are
running sums, which are worked out in blocks whatever its length, and a parent's name is a subtraction. Two different
prefixes share a name with odds of 2^-128.

The child with the most members (of several, that with the smallest member) is a node's heavy one. A heavy path ends at a
childless node and is told by the smallest conversation there: it holds what follows the last light node among that
conversation's prefixes, and the number of light nodes among them is its level. A light child has at most half of its
parent's members, so there are at most log2(conversations) + 1 levels. From the last level up, a path's nodes, with what light
paths have brought them, are put into arrays of at most BLOCK nodes, summed from their ends, and the sum at the path's top is
brought to its parent: a round for each level, in which a node takes part once.

Defined cases: rows without a conv_id take no part; null roles and texts are empty; turns are in order of their number, nulls
first, and those of one number in order of their digests, so repeated rows are repeated turns; a remainder has the sign of
its conv_id; a conversation whose turns are all replaced by none is a member of the root alone; extra columns, whatever they
are called, are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.llm.common import stored

#: Nodes of a path in one array.
BLOCK = 1024
#: Conversations that share their first turns in the contract's data, and how many turns at most.
FAMILY, SHARED = 100, 6
PARTS = 4
ROOT = "-".join(["0"] * PARTS)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and chars of every row that has a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """rows with running sums over each key's rows in order.

    Rows are put in order as a whole, so a key of any size is spread over blocks; sums inside a block and those of the blocks
    before it are worked out apart.
    """
    block = W.partitionBy("_block", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    t = rows.repartitionByRange(F.col(key), *order).withColumn("_block", F.spark_partition_id())
    t = stored(t.withColumns({n: F.sum(x).over(block) for n, x in sums.items()}), label)
    whole = t.groupBy(key, "_block").agg(*[F.max(n).alias(n) for n in sums])
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = whole.select(key, "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    return t.join(before, [key, "_block"]).select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def placed(own: DataFrame) -> DataFrame:
    """turns with pos, counted from 1 in each conversation."""
    return running(own, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {"pos": F.lit(1).cast("long")}, "placed")


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (conv_id, total), (conv_id, depth, digest, chars, total)."""
    own = stored(placed(turns(conversations)), "own")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("total"))
    return stored(convs, "convs"), own.join(convs, "conv_id").select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "total")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations whose first turns are those of their family's first one, as the contract asks."""
    own = stored(placed(turns(conversations)), "own")
    first = own.where(F.col("pos") < SHARED).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    mine = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "family": F.col("conv_id") - F.col("conv_id") % FAMILY})
    given = F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = mine.join(first.withColumnRenamed("conv_id", "family"), "family", "left").withColumn("given", given)
    taken = F.size("given").cast("long")
    convs = stored(convs.select("conv_id", "h", "given", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")
    borrowed = convs.select("conv_id", "total", F.explode("given").alias("g")).select("conv_id", F.col("g.pos").alias("depth"), "g.digest", "g.chars", "total")
    rest = own.join(convs.select("conv_id", "h", "taken", "total"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars", "total")
    return convs.select("conv_id", "total"), borrowed.unionByName(rest)


def _named(rows: DataFrame) -> DataFrame:
    """conv_id, depth, chars, whether the conversation ends there, node and parent of every prefix but the empty one."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "digest") for seed in range(PARTS // 2)]
    half = lambda x: (x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))
    own = rows.withColumns({f"h{k}": x for k, x in enumerate(p for x in hashes for p in half(x))})
    t = running(own, "conv_id", [F.col("depth")], {f"s{k}": F.col(f"h{k}") for k in range(PARTS)}, "names")
    name = lambda less: F.concat_ws("-", *[(F.col(f"s{k}") - (F.col(f"h{k}") if less else 0)).cast("string") for k in range(PARTS)])
    return t.select("conv_id", "depth", "chars", (F.col("depth") == F.col("total")).alias("ends"), name(False).alias("node"), name(True).alias("parent"))


def trie(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the prefixes of every conversation.

    convs: conv_id, total (its turns); rows: conv_id, depth (from 1), digest, chars, total. Nodes: node, parent, conv_id,
    depth, n_convs, own (what the node itself saves), n_children, light, parent_conv_id.
    """
    named = stored(_named(rows), "prefixes")
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = named.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    nodes = stored(nodes.unionByName(root), "nodes")
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.max_by("node", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    nodes = stored(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    light = F.coalesce(F.col("chosen") != F.col("node"), F.lit(False))
    own = (F.col("n_convs") - 1) * F.col("chars")
    tree = nodes.join(above, "parent", "left").select("node", "parent", "conv_id", "depth", "n_convs", own.alias("own"), "n_children", light.alias("light"), "parent_conv_id")
    return stored(tree, "tree"), named


def heavy_paths(tree: DataFrame, named: DataFrame) -> DataFrame:
    """path, level, depth, top (whether it is the path's first node), node, parent, leaves and saved (its own) of every node."""
    ends = tree.where("n_children = 0").select("conv_id")
    rows = stored(named.join(ends, "conv_id", "left_semi").select("conv_id", "depth", "node"), "ways")
    lights = rows.join(tree.where("light").select("node"), "node", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("first"), F.count("*").alias("level"))
    heads = stored(ends.join(lights, "conv_id", "left").select("conv_id", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("level", F.lit(0)).alias("level")), "heads")
    on = rows.join(heads, "conv_id").where("depth >= first").select(F.col("conv_id").alias("path"), "level", (F.col("depth") == F.col("first")).alias("top"), "node")
    root = heads.where("first = 0").select(F.col("conv_id").alias("path"), "level", F.lit(True).alias("top"), F.lit(ROOT).alias("node"))
    own = tree.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    return on.unionByName(root).join(own, "node").select("path", "level", "depth", "top", "node", "parent", "leaves", "saved")


ITEM = "struct<depth:bigint,top:boolean,node:string,parent:string,leaves:bigint,saved:bigint>"


def _from_the_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of nodes with leaves and saved summed from each array's end, and the sums of the whole array."""
    for b in batches:
        at = b.schema.get_field_index("items")
        lists = b.column(at)
        items, size = lists.flatten(), np.asarray(lists.value_lengths())
        stop = np.cumsum(size)
        last = np.repeat(stop, size)
        fields, whole = {f.name: items.field(f.name) for f in items.type}, {}
        for name in ("leaves", "saved"):
            total = np.concatenate([[0], np.cumsum(fields[name].to_numpy())])
            whole[name] = pa.array(total[stop] - total[stop - size])
            fields[name] = pa.array(total[last] - total[:-1])
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("block"), made, whole["leaves"], whole["saved"]], names=["path", "block", "items", "leaves", "saved"])


def suffix_sums(nodes: DataFrame) -> DataFrame:
    """The nodes of paths with leaves and saved summed from each path's end to them."""
    item = F.struct("depth", "top", "node", "parent", "leaves", "saved")
    arrays = nodes.repartition("path").groupBy("path", F.floor(F.col("depth") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    t = arrays.mapInArrow(_from_the_ends, f"path bigint, block bigint, items array<{ITEM}>, leaves bigint, saved bigint")
    later = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    t = t.select("items", *[F.coalesce(F.sum(n).over(later), F.lit(0)).alias(f"more_{n}") for n in ("leaves", "saved")])
    t = t.select(F.explode("items").alias("x"), "more_leaves", "more_saved")
    return t.select("x.node", "x.parent", "x.top", *[(F.col(f"x.{n}") + F.col(f"more_{n}")).alias(n) for n in ("leaves", "saved")])


def subtree_sums(paths: DataFrame) -> DataFrame:
    """node, leaves and saved, summed over the subtrees: a round for each level of light edges, from the last one up."""
    paths = stored(paths, "paths")
    deepest = paths.agg(F.max("level").alias("n")).first()["n"]
    out = brought = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        mine = paths.where(F.col("level") == level).drop("level")
        if brought is not None:
            mine = mine.join(brought, "node", "left").withColumns({n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        done = stored(suffix_sums(mine), "summed")
        out = done if out is None else out.unionByName(done)
        brought = done.where("top").groupBy(F.col("parent").alias("node")).agg(*[F.sum(n).alias(f"more_{n}") for n in ("leaves", "saved")])
    return (suffix_sums(paths.drop("level")) if out is None else out).select("node", "leaves", "saved")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node as one text of its ids, with the first of them."""
    for b in batches:
        if not b.num_rows:
            continue
        nodes, ids = b.column("node").to_pylist(), b.column("conv_id").to_pylist()
        begins = [0, *(k for k in range(1, len(nodes)) if nodes[k] != nodes[k - 1]), len(nodes)]
        runs = [(nodes[lo], ids[lo], ",".join(map(str, ids[lo:hi]))) for lo, hi in zip(begins, begins[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*runs)], names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, one after another: nothing of a node is kept but the state of its hash."""
    node, state = None, None
    for b in batches:
        done = []
        for of, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
            if of != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = of, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
    if node is not None:
        yield _digests([(node, state.hexdigest())])


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256 of nodes at which conversations (node, conv_id) end. A node's ids are joined wherever they lie, in
    order, and only these texts come together."""
    texts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node string, first bigint, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node string, ends_sha256 string")


def summary(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The contract's columns for conversations as trie() takes them."""
    rows = stored(rows, "rows")
    tree, named = trie(convs, rows)
    sums = subtree_sums(heavy_paths(tree, named))
    last = named.where("ends").select("node", "conv_id").unionByName(convs.where("total = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    t = tree.join(sums, "node").join(end_digests(stored(last, "ends")), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return t.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations."""
    return summary(*rebuilt(conversations))


ORACLE = r"""
WITH src AS (SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, said, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos FROM src),
crc AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(i))),
convs AS (SELECT conv_id, n, conv_id - conv_id % 100 AS family, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crc),
seq AS (SELECT c.conv_id, o.pos AS depth, said, chars FROM convs c JOIN own o ON o.conv_id = c.family AND o.pos <= c.h
        UNION ALL SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(f.n, 0)), said, chars FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN convs f ON f.conv_id = c.family),
pre AS (SELECT conv_id, depth, chars, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, depth = count(*) OVER (PARTITION BY conv_id) AS ends FROM seq
        UNION ALL SELECT conv_id, 0, 0, 'root', conv_id NOT IN (SELECT conv_id FROM seq) FROM convs),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM pre),
nodes AS (SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own,
          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM up GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT a.node, count(*) FILTER (k.n IS NULL) AS leaves, sum(b.own) AS saved FROM nodes b JOIN up a ON a.conv_id = b.conv_id AND a.depth <= b.depth LEFT JOIN kids k ON k.node = b.node GROUP BY a.node)
SELECT CAST(x.conv_id AS BIGINT) AS conv_id, CAST(x.depth AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN kids k ON k.node = x.node JOIN sums s ON s.node = x.node
"""
