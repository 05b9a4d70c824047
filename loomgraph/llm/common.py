"""What the operators of this subpackage share: stashed tables, tables by path, byte-bounded Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below `spark.checkpoint.dir`; only where that is unset and Spark runs on this
    machine alone, a local one (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        _own[app] = f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes the folder when the driver ends, if its JVM still answers."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: lineage ends there, and lost
    executors cost nothing, since the files outlive them."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and a worker, at most; the session's own figure if that is lower.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's limit for Arrow batches, so that a worker holds little text at once. The setting is read
    when a query is planned, which is why it stays lowered."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", df.sparkSession.conf.get(key)) or 0)
    if not 0 < now <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns freed memory to the machine at the end of a partition: workers live on, and what one stage needed would
    add to what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", most: int = 4 << 20) -> DataFrame:
    """mapInArrow with batches cut to about `most` bytes of the column `text`, so that a worker's memory is
    bounded by that or by one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                yield f(part)
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    off = offsets(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than rows; nulls take no bytes."""
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one array, and the offsets in it; null reads as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    off = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Parts that a key's rows are dealt to.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, least: str, count: str | None = None) -> DataFrame:
    """Adds the least `value` of each `key`, and the count of its rows. A key may hold a third of all rows, so these are
    dealt to SALTS parts of it and meet, in each part, one row with the key's figures."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    part = salted.groupBy(key, "_salt").agg(F.min(value).alias("_m"), F.count("*").alias("_n"))
    whole = part.groupBy(key).agg(F.min("_m").alias(least), F.sum("_n").alias(count or "_n"), F.collect_list("_salt").alias("_salts"))
    dealt = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(dealt, [key, "_salt"]).select(*rows.columns, least, *([count] if count else []))


def with_one(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """`rows` joined, left outer, to a table of one row a key. A key, or null, may hold a third of all rows, so these are
    dealt to SALTS parts by `spread`, and the key's row goes to those parts that have any."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    dealt = salted.select(key, "_salt").filter(F.col(key).isNotNull()).distinct().join(table, key)
    return salted.join(dealt, [key, "_salt"], "left").drop("_salt")
