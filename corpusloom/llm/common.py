"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder that spark.checkpoint.dir names; a temporary folder only where all tasks run in the driver, and where it is unset."""
    shared_folder(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], start: Callable[[], Callable[..., list]]) -> DataFrame:
    """df with the columns of ``fields``, which replace columns of the same name.

    start() runs once a partition and returns a function that takes the input columns of some rows as
    Python lists and returns one list a field. Rows stream in slices of SLICE_BYTES: memory follows the
    slice (or its longest row), not the batch or the partition.
    """
    bound_batches(df.sparkSession)
    names = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in names]
    out = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in keep), *fields])
    kept = [f.name for f in keep]
    own = [f"__in{k}" for k in range(len(inputs))]
    source = df.select(*kept_columns(df, kept), *(df[f"`{c}`"].alias(n) for c, n in zip(inputs, own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        apply = start()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in slices(batches, len(kept)):
            made = apply(*(batch.column(len(kept) + k).to_pylist() for k in range(len(own))))
            arrays = [batch.column(k) for k in range(len(kept))] + [pa.array(v, type=t) for v, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, out)


#: Rows of the Arrow batches that this subpackage asks for, where the session has Spark's default: texts are long, and a batch of its ten thousand rows is held on both sides.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Bytes of input columns that are Python objects at a time.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], first: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices whose columns from ``first`` on take about ``limit`` bytes; a longer row is a slice by itself."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and sum(part.column(k).nbytes for k in range(first, part.num_columns)) > limit:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def keeping_columns(docs: DataFrame, added: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What run() makes of docs, with the columns of docs and their values only: those that are called like what it adds are put aside meanwhile."""
    aside = {c: f"__own{k}" for k, c in enumerate(docs.columns) if c in added}
    out = run(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def kept_columns(df: DataFrame, names: list[str]) -> list[Column]:
    return [df[f"`{c}`"] for c in names]


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: unlike an alias, an exploded array of one isn't put in place of its name by the optimizer, which would compute it again in each lambda or pushed filter that mentions it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Entries of a table that may be broadcast: some tens of MB. Beyond, joins shuffle.
BROADCAST_ENTRIES = 1_000_000


def broadcast_if_small(df: DataFrame, entries: int) -> DataFrame:
    """df, marked for broadcast if what it holds, counted by the caller, is within BROADCAST_ENTRIES."""
    return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df


def bounded_sample(df: DataFrame, key: str, bound: int, group: str | None = None, salt: str = "sample") -> DataFrame:
    """About ``bound`` rows of df (of each value of ``group``), the same ones at each run: those whose hashed key is low. A sample of a sample needs another salt."""
    scale = 1 << 30
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(scale))
    if group is None:
        n = df.count()
        return df if n <= bound else df.where(spread < int(scale * bound / n))
    wanted = F.lit(False)
    for value, n in df.groupBy(group).count().collect():
        wanted = wanted | (F.col(group).eqNullSafe(F.lit(value)) & (spread < int(scale * min(1.0, bound / n))))
    return df.where(wanted)
