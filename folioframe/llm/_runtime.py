"""Session plumbing shared by the corpus operators: shared scratch tables, input shaping, and lean workers."""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch folders and tables that are still there: path -> catalogue name or None.
_written: dict[str, str | None] = {}
_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset, only a local session gets a folder of
    its own; on a cluster that would be a different disk for each machine."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        folder = tempfile.mkdtemp(prefix="folioframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own = "file://" + folder
    return _own


def materialize(df: DataFrame, tag: str, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; later stages no longer depend on its lineage.

    ``by`` stores it in as many buckets of that column, so that joins and groups by it don't move its rows again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioframe-{uuid.uuid4().hex}/{tag}"
    if by:
        name = f"folioframe_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", path).saveAsTable(name)
        out = spark.table(name)
    else:
        name = None
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    _written[path] = name
    if (owner := _owner.get()) is not None:
        owner.paths.append(path)
    out._scratch = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    name = _written.pop(path, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        if getattr(t, "_scratch", None) in _written:
            _remove(t.sparkSession, t._scratch)


class Scratch:
    """What is written while this is open belongs to it, and ``release`` deletes that and nothing else; results of other runs, which
    may be read later, keep what they need."""

    def __enter__(self) -> Scratch:
        self.paths: list[str] = []
        self._outer = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._outer)

    def release(self, spark: SparkSession, *but: DataFrame) -> None:
        """Delete it, but for some tables. Call this once all results that read it are stored."""
        kept = {getattr(t, "_scratch", None) for t in but}
        for path in [p for p in self.paths if p not in kept and p in _written]:
            _remove(spark, path)


_owner: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


def keyed(docs: DataFrame) -> DataFrame | None:
    """Rows (_key, _row) with a unique key each, stored; None where doc_ids are such keys already."""
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count().where("doc_id is null or count > 1")
    if again.isEmpty():
        return None
    return materialize(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")), "keyed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts or blobs may hold in a Python worker; it concerns Python stages only."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


_lean = False


def lean() -> None:
    """Let this worker give memory back: workers are kept from task to task, and with them what their allocators hold.

    Arrays of a megabyte or more are mapped on their own, so freeing them returns their pages at once.
    """
    global _lean
    if not _lean:
        _lean = True
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):  # another C library: nothing to set
            pass
        pa.set_memory_pool(pa.system_memory_pool())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
