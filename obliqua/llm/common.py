"""Helpers shared by the corpus operators: scratch space, batches, paths."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20, most_rows: int = 2000) -> None:
    """Bounds the Arrow batches of the session, for the queries and the pipeline: rows hold whole texts."""
    for name, most in (("maxBytesPerBatch", most_bytes), ("maxRecordsPerBatch", most_rows)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, as Spark keeps Python workers for the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) is a temporary folder
    set, and then for the session as a whole; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="obliqua-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    return f"{scratch_root(spark)}/obliqua-{purpose}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables written below the scratch folder; what is not dropped before goes when the block ends, on errors too.

    ``keep`` cuts lineage: the table is read again from its files.  It also lets Spark delete the shuffle
    files of plans that are no longer referred to, so that disk holds what is still needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            remove_path(self.spark, path)
        self.paths = {}
        free_shuffles(self.spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = scratch_path(self.spark, name)
        df.write.parquet(path)
        free_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, self.paths.pop(name))


def free_shuffles(spark: SparkSession) -> None:
    """Collects the driver's garbage; Spark's cleaner then deletes the shuffles of unreachable plans everywhere."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint (never a local one)."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within, Arrow batches hold so many rows at most; for actions on rows with several long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds few text bytes; a single longer text stays whole."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(np.diff(string_offsets(text)))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(sizes, done + most_bytes, "right"))), at + most_rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def string_offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a string column into its data buffer, one more than it has rows."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string column; null counts as empty."""
    offsets = string_offsets(column)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
        offsets = string_offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_ids(df: DataFrame, ids: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """``df`` joined to a set of ``doc_id`` by "left_semi" or "left_anti".

    The set is counted first: up to ``most`` ids (a few megabytes) are broadcast, so
    that texts need no shuffle; a larger set meets them in a shuffle.
    """
    from pyspark.sql import functions as F

    ids = checkpointed(ids.select("doc_id").distinct())
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", how)


def bounded_sample(df: DataFrame, key: str, most: int, salt: str) -> DataFrame:
    """About ``most`` rows, the same in every run: those whose hashed key is low.

    Only the count of the rows is gathered; keys should be distinct, as the
    bound holds in expectation.
    """
    from pyspark.sql import functions as F

    share = min(1.0, most / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 40)) < int(share * (1 << 40)))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores put before it while the table has it in any case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_remainder(column, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; a null id counts as empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
