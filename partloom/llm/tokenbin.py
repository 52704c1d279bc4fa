"""Token ids in files: documents in order of their ids, as frames of range-coded blocks.

Documents are dealt into ranges of doc_id and sorted; each task encodes its documents one after another and closes a frame
when it holds FRAME_IDS ids or more, so a frame has whole documents. A frame (see rangecoder) is a row of a Parquet table: the table
gives commit, listing and reading by any store, and the frame's bytes are the format. Its document table (ids and counts)
stands beside the code. Reading decodes every frame, checks the checksums and works out where each document starts from the
frames before it: sums of a range's frames by a window over that range, sums of ranges on the driver (one number each).

Defined cases: null and empty texts have the end id only; a null id comes first; rows with equal ids follow each other in
the order of their texts' hashes, each as a document; texts of any length are one document in one frame; other columns are
ignored; an empty table makes no frames; ids that don't add up, and damaged frames, raise ValueError.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.llm import rangecoder
from partloom.llm.bpe import encoder
from partloom.llm.common import shared_dir, slices

FRAME_IDS = 1 << 22
END_ID = 0
FRAME = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("count", pa.list_(pa.int64())), ("frame", pa.binary())])
SCHEMA = "part int, seq int, doc_id array<bigint>, count array<bigint>, frame binary"


def frames(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The frames of docs, in ranges of doc_id."""

    def run(batches):
        bpe, seq, ids, docs_in, counts, total, part = encoder(path), 0, [], [], [], 0, 0

        def closed():
            frame = rangecoder.encode(np.concatenate(ids))
            columns = [[part], [seq], [docs_in], [np.concatenate(counts)], [frame]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FRAME)], schema=FRAME)

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for lo, hi in slices(b.column("size").to_pylist()):
                own = b.slice(lo, hi - lo)
                got, n = bpe.encode_many(own.column("text").to_pylist())
                ids.append(np.insert(got, np.cumsum(n), END_ID))
                counts.append(n + 1)
                docs_in += own.column("doc_id").to_pylist()
                total += len(ids[-1])
                if total >= FRAME_IDS:
                    yield closed()
                    seq, ids, docs_in, counts, total = seq + 1, [], [], [], 0
        if docs_in:
            yield closed()

    # Rows of one id may be many, so ranges end within them: by the hash of their texts.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    size = F.coalesce(F.length("text"), F.lit(0)).alias("size")
    return dealt.select("doc_id", "text", size, F.spark_partition_id().alias("part")).mapInArrow(run, SCHEMA)


def write(docs: DataFrame, to: str, path: str | None = None) -> None:
    frames(docs, path).write.parquet(to)


def read(spark: SparkSession, at: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids, all from the decoded frames."""
    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    out = out.append(pa.field("ids", pa.list_(pa.int32()))) if ids else out

    def run(batches):
        for b in batches:
            for part, seq, docs, counts, frame in zip(*(b.column(c).to_pylist() for c in FRAME.names)):
                got = rangecoder.decode(frame)
                if len(got) != sum(counts):
                    raise ValueError(f"frame {part}.{seq} has {len(got)} ids, its documents {sum(counts)}")
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
                own = [got[s : s + n] for s, n in zip(starts, counts)]
                columns = [[part] * len(docs), [seq] * len(docs), docs, starts, [len(x) for x in own], [zlib.crc32(x.tobytes()) for x in own]]
                columns += [[x.astype("i4") for x in own]] if ids else []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    table = spark.read.schema(SCHEMA).parquet(at)
    kind = "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    sizes = table.select("part", "seq", F.aggregate("count", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(parts):
        before.append((part, total))
        total += parts[part]
    offsets = spark.createDataFrame(before or [(0, 0)], "part int, before bigint")
    earlier = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.join(offsets, "part").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("begin"))
    found = table.mapInArrow(run, kind).join(begins, ["part", "seq"])
    return found.select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from files written and read again."""
    to = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write(docs, to)
    return read(docs.sparkSession, to)
