"""Helpers that the corpus operators share: choosing columns, slicing Arrow batches, shipping the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text is worked on in slices of about so many bytes; one longer text makes a slice alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch where the session has Spark's default: rows are whole texts, and several batches are held at once.
BATCH_ROWS, DEFAULT_BATCH_ROWS = 1000, "10000"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under new names: pick(df, id="doc_id", text="text").

    Columns are found by exact name and position, so other columns may clash with them (also by case) or with any result.
    """
    have = list(df.columns)
    if missing := [v for v in names.values() if v not in have]:
        raise ValueError(f"no such column: {missing}")
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    return plain.select(*[plain[f"c{have.index(v)}"].alias(k) for k, v in names.items()])


def carried(df: DataFrame, column: str, keep: tuple[str, ...], made: Iterable[str] = ()) -> tuple[DataFrame, list[T.StructField], list[Column]]:
    """What an operator on one column maps over: rows with that column as `in__` and the kept ones, the fields that its results
    begin with, and columns that give the kept ones their names back. A kept column that is the operator's own goes once.

    made: the names of the operator's results. A kept column of such a name, also by case, or one kept twice, raises ValueError.
    """
    low = [k.lower() for k in keep]
    if clash := sorted({k for k in low if low.count(k) > 1} | set(low) & {m.lower() for m in made}):
        raise ValueError(f"kept columns clash with results or each other: {clash}")
    names = {k: "in__" if k == column else f"k{i}" for i, k in enumerate(keep)}
    rows = pick(df, in__=column, **{v: k for k, v in names.items() if v != "in__"})
    return rows, [rows.schema[v] for v in names.values()], [F.col(v).alias(k) for k, v in names.items()]


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark context, so that they need no shared folder or installation.
    Also lowers the session's Arrow batches to BATCH_ROWS, unless the session has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_sparkferry_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        with zipfile.ZipFile(path := os.path.join(folder, "sparkferry_code.zip"), "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        held = tempfile.NamedTemporaryFile(prefix="sparkferry_code_", suffix=".zip", delete=False)  # the driver serves it while the context lives
        held.write(Path(path).read_bytes())
        held.close()
    context.addPyFile(held.name)
    context._sparkferry_shipped = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch, each of at most `limit` bytes in the text column, or of one row."""
    ends = text_offsets(batch.column(column))[1]
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def text_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n + 1 offsets, both without a copy where possible; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers, at, n = column.buffers(), column.offset, len(column)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without one, a local session gets a folder of this
    machine, as driver and executors are one process; a cluster's session raises."""
    context = spark.sparkContext
    if (named := context._jsc.sc().getCheckpointDir()).isDefined():
        return named.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sparkferry_shared_")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Bits of the filter that goes before a shuffled join of whole rows with a list of ids, and of one of its rows: 8 MB in all, whatever the data.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15


def _sifted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with __may: false only where the key is surely not among the ids. A Bloom filter of one hash and a fixed size, so it is
    broadcast; where the list is so long that it fills, more rows are shuffled afterwards, and results stay the same."""
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    part, bit = lambda k: (place(k) / FILTER_ROW).cast("int"), lambda k: place(k) % FILTER_ROW
    bits = ids.groupBy(part(key).alias("__part")).agg(F.bitmap_construct_agg(bit(key)).alias("__bits"))
    found = rows.withColumns({"__part": part(key), "__bit": bit(key)}).join(F.broadcast(bits), "__part", "left")
    may = F.expr("shiftright(cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int), cast(__bit % 8 as int)) & 1 = 1")
    return found.withColumn("__may", F.coalesce(may, F.lit(False))).drop("__part", "__bit", "__bits")


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids (a table of one column, where ids may repeat)."""
    return _sifted(rows, ids, key).where("__may").drop("__may").join(ids, key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the ids."""
    sifted = _sifted(rows, ids, key)
    return sifted.where("not __may").drop("__may").unionByName(sifted.where("__may").drop("__may").join(ids, key, "left_anti"))


class Held:
    """A table written to the shared folder and read again: it cuts lineage, and a lost executor loses nothing of it."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/sparkferry-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the table; nothing that reads it may be left to run."""
        context = self.df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(result: DataFrame) -> None:
    """Deletes the tables in the shared folder that a result of this package still reads, once nothing needs the result any more."""
    spark = result.sparkSession
    context, folder = spark.sparkContext, shared_folder(spark).rstrip("/")
    for top in {f"{folder}/{m[0]}" for f in result.inputFiles() if (m := re.search(r"sparkferry-[0-9a-f]{32}(?=/)", f))}:
        path = context._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
