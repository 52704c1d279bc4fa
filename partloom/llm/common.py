"""What the corpus operators share: reading, splits, stable storage, Arrow plumbing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.sources.storage import shared_dir, stored  # noqa: F401  (the operators take them from here)

#: Texts handed to one vectorised step hold about this many characters, so memory is bounded whatever a batch holds.
SLICE_CHARS = 500_000


#: Most bytes that an Arrow batch of texts takes on its way to a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict = {}


def kept(key: tuple, build: Callable):
    """What build() makes, kept in this process until another operator needs its own: a worker holds one model at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; the fold key of the contracts."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def crc_mod_py(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def arrow_rows(names: list[str], schema: pa.Schema, step: Callable[[dict[str, list]], dict[str, list]], text: str = "text"):
    """A mapInArrow function that applies step to column lists, in slices of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in names}
            if not batch.num_rows:
                continue
            for lo, hi in slices(pa.compute.fill_null(pa.compute.utf8_length(cols[text]), 0).to_pylist() if text in cols else [1] * batch.num_rows):
                out = step({n: c.slice(lo, hi - lo).to_pylist() for n, c in cols.items()})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

    return run


def slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def annotated(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], step: Callable[[list[str | None]], list[list]], replace: tuple[str, ...] = ()) -> DataFrame:
    """docs with further columns that step works out from the whole texts, in one pass and without a join.

    fields: name, Spark type and Arrow type of each column that step returns; names in `replace` take the place of the
    column of that name, the others must be new.
    """
    at = docs.columns.index("text")
    new = [f for f in fields if f[0] not in replace]
    places = {f[0]: docs.columns.index(f[0]) for f in fields if f[0] in replace}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {kind}" for n, kind, _ in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.utf8_length(batch.column(at)), 0).to_pylist()
            for lo, hi in slices(lengths):
                part = batch.slice(lo, hi - lo)
                columns, names = list(part.columns), list(part.schema.names)
                for (name, _, kind), values in zip(fields, step(part.column(at).to_pylist())):
                    if name in places:
                        columns[places[name]] = pa.array(values, kind)
                    else:
                        columns.append(pa.array(values, kind))
                        names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
