"""Helpers that the corpus operators share.

Conventions, for every operator of this subpackage:

* a null text counts as empty; a null ``doc_id`` sorts after every other one;
* rows that agree in ``doc_id`` and ``text`` are one document and get the
  same result, once for each row;
* columns other than those an operator names are carried or ignored, never
  looked at, whatever their names are;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null doc_id where ids are compared: after all others.
NULL_ID = 2**63 - 1


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that their Python workers can import it."""
    import io
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_loom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(os.path.join(top, "loomgraph")):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), top))
    path = os.path.join(tempfile.mkdtemp(), "loomgraph_pkg.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)
    sc._loom_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or (unset, as in tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        else:
            where = f"/tmp/loomgraph-{spark.sparkContext.applicationId}"
            spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/loom-{uuid.uuid4().hex}"


def written(df: DataFrame, *, by: str | None = None, beside: int = 0) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and outlives executors.

    One pass, unlike checkpoint(), which computes the last stage twice. Spark is
    told to drop the shuffle files of the write when it ends; else they stay
    until the driver happens to collect its garbage. Each value of `by` has its
    own files; a task writes those of up to `beside` values without a sort.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    out = df.write.option("compression", "zstd")
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if beside:
        conf["spark.sql.maxConcurrentOutputFileWriters"] = str(beside)
    before = {x: spark.conf.get(x, None) for x in conf}
    for x, to in conf.items():
        spark.conf.set(x, to)
    try:
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        for x, to in before.items():
            spark.conf.unset(x) if to is None else spark.conf.set(x, to)
    held = spark.read.schema(df.schema).parquet(path)
    held._loom_path = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """_id, _key, _text and extra of docs.

    (_id, _key) names a document. Where doc_ids are unique, _key is 0; else it
    is a hash of the text, so that rows of one doc_id and other texts stay apart.
    """
    again = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    key = F.xxhash64("_text") if again else F.lit(0).cast("long")
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        *extra,
    )
    return base.select("_id", key.alias("_key"), "_text", *extra)


def shown_id() -> F.Column:
    """doc_id as given, from _id."""
    return F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")


def tidy() -> None:
    """Give the memory that this process has freed back to its machine: an idle Python worker otherwise holds on to its peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has its own ways
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | T.StructType, close: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function of one batch, which returns a batch or yields some; close is called when a partition ends."""

    ship(df.sparkSession)

    def run(batches):
        try:
            for batch in batches:
                if batch.num_rows:
                    out = fn(batch)
                    if isinstance(out, pa.RecordBatch):
                        yield out
                    else:
                        yield from out
        finally:
            if close:
                close()
            tidy()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batch with about `most` bytes of text each (one row at least), so that work arrays stay small."""
    ends = batch.column(column)
    start, size = 0, 0
    sizes = pc.binary_length(ends).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null as b''."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, or bytes of one of texts, as one array, and where those of each row begin in it (and the last row's end); null is empty."""
    nested = pa.types.is_list(column.type)
    if column.null_count:
        column = pa.array(column.to_pylist(), column.type) if nested else column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.int64 if nested else np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if nested:
        values = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    else:
        held = column.buffers()[2]
        values = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return values, at - at[0]


def rowed(docs: DataFrame) -> DataFrame:
    """keyed(docs) with the other columns of each row as _row, so that no column's name can clash; unrowed() shows them again. The text goes once."""
    cells = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    row = F.struct(cells.alias("cells"), F.col("text").isNotNull().alias("has_text")).alias("_row")
    return keyed(docs.select(F.col("doc_id"), F.col("text"), row), "_row")


def unrowed(names: list[str]) -> list[F.Column]:
    """The columns of docs from the _row and _text of rowed(docs)."""
    text = F.when(F.col("_row.has_text"), F.col("_text")).alias("text")
    return [text if c == "text" else F.col("_row.cells")[c].alias(c) for c in names]
