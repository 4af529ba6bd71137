"""Helpers that the operators share: durable intermediate tables, ids, columns.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, the
folder that a cluster shares.  A table that was written survives the loss of any
executor, and cuts the lineage of what is built on it.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MINE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is set only where none is, and only if all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jvm_dir.get() if jvm_dir.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the Python process ends."""
    path = f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    _MINE.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MINE:
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may have gone before us
            return


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The plain path behind a ``file:`` URI or a bare path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def open_sink(uri: str):
    """A file to write in the shared folder.

    Local and mounted paths go through the operating system, every other scheme
    through pyarrow's file systems.  Callers choose a name of their own for each
    attempt of a task, so what a lost attempt leaves is never read.
    """
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")  # noqa: SIM115
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    return files.open_output_stream(path)


class RangeReader:
    """Random access to a file of the shared folder: ``read(offset, length)``."""

    def __init__(self, uri: str):
        if path := local_path(uri):
            self._file = open(path, "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(uri)
            self._file = files.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(length)

    def size(self) -> int:
        return self._file.seek(0, os.SEEK_END) if isinstance(self._file, io.IOBase) else self._file.size()

    def close(self) -> None:
        self._file.close()


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task.

    Spark reuses workers for whatever comes next, so the first call of another
    operator drops what the last one has kept, and gives the memory back.
    """
    if owner not in _CACHES:
        had = bool(_CACHES)
        _CACHES.clear()
        _CACHES[owner] = {}
        give_back(had)
    return _CACHES[owner]


def give_back(collect: bool = False) -> None:
    """Return freed memory to the system, and let large arrays go back as soon as they are freed.

    The C library otherwise keeps what a worker has once used, while the JVM beside
    it may need it.
    """
    if collect:
        gc.collect()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def let_go(spark: SparkSession) -> None:
    """Free what steps have left behind in the driver: samples in Python, plans, and with them broadcasts and shuffle files."""
    give_back(collect=True)  # Python's handles first: they keep the JVM's objects alive
    spark.sparkContext._jvm.System.gc()


def made_apart(rows: DataFrame, make: Callable[[list[tuple]], object]) -> object:
    """What `make` gets from all rows of a bounded table, as tuples in no order.

    One task of an executor does it, so neither the rows nor what making takes are
    in the driver's memory, only what was made.
    """
    names = rows.columns

    def run(batches):
        import pandas as pd

        worker_cache("made apart")
        held = [row for batch in batches for row in zip(*[batch[c].tolist() for c in names], strict=True)]
        yield pd.DataFrame({"made": [pickle.dumps(make(held))]})
        del held
        give_back(collect=True)

    found = rows.repartition(1).mapInPandas(run, "made binary").collect()  # one row, or none of an empty table
    return pickle.loads(found[0].made) if found else make([])


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, most: dict[str | int, int] | int, most_bytes: int, salt: str) -> tuple[dict, DataFrame]:
    """Of rows (id, kind, text): the number of rows of each kind, and a sample (id, kind, text) of whole texts.

    Rows are drawn in the order of a hash of id and text, equal rows once; a kind
    has at most `most` rows in the sample, and at most `most_bytes` bytes of text: its
    draw ends before the text that exceeds them.  So neither one id with many rows nor
    long texts make the sample larger than that.  A first filter at about twice the
    rate needed keeps what is ranked small; every kind with a row is drawn from.
    """
    keyed = rows.withColumn("_h", F.xxhash64("id", "text", F.lit(salt))).withColumn("_u", F.pmod("_h", F.lit(1 << 30)))
    told = keyed.groupBy("kind").agg(F.count("*").alias("n"), F.approx_count_distinct("_h").alias("d")).collect()  # a row a kind
    counts = {r.kind: r.n for r in told}
    limit = {k: most if isinstance(most, int) else most.get(k, 0) for k in counts}
    rate = F.lit(0.0)
    below = F.lit(0)
    for r in told:
        rate = F.when(F.col("kind") == r.kind, min(1.0, (2.2 * limit[r.kind] + 50) / max(1, r.d))).otherwise(rate)
        below = F.when(F.col("kind") == r.kind, limit[r.kind]).otherwise(below)
    near = durable(keyed.filter(F.col("_u") < rate * float(1 << 30)).groupBy("kind", "_u", "_h").agg(F.first("id").alias("id"), F.first("text").alias("text")), "sample")
    order = Window.partitionBy("kind").orderBy("_u", "_h")
    small = near.select("kind", "_u", "_h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_b"))
    ranked = small.withColumn("_r", F.row_number().over(order)).withColumn("_s", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.filter((F.col("_r") <= below) & (F.col("_s") <= most_bytes)).select("kind", "_u", "_h")
    return counts, near.join(kept, ["kind", "_u", "_h"]).select("id", "kind", "text")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
