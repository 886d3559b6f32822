"""Token-id output: wavelet-matrix shards in ascending order of document ids.

Documents are dealt out by ranges of ``doc_id`` (the one shuffle of the texts),
sorted within each range, encoded, and cut into shards of about
``shard_tokens`` ids.  A shard is one byte image (see ``wavelet``), stored as one
row of a Parquet file, so that Spark's committer makes retries and lost
executors safe on any file system.

Defined cases: null text is empty (only the end id is written); equal or null
``doc_id`` keep their rows, nulls first, ties in order of text; a document is never cut
(one longer than ``shard_tokens`` fills a shard of its own); an empty table
gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, remove_path, scratch_path, text_slices
from .tokens import encoder
from .wavelet import open_shard, pack_shard

#: Words remembered by a worker, some 150 megabytes; nothing else runs beside this operator's encoding.
MOST_WORDS = 1_200_000
SHARD_SCHEMA = "part long, shard long, n_docs long, n_tokens long, image binary"
SHARD_ARROW = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
DOC_SCHEMA = "doc_id long, part long, shard long, local_start long, n_tokens long, ids_crc32 long"


def _shards(tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, tail = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        docs: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, size
            ends = np.cumsum([len(x) // 4 for x in ids])
            image = pack_shard(np.frombuffer(b"".join(ids), "<u4"), docs, ends)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, shard, len(docs), int(ends[-1]), image), SHARD_ARROW.types, strict=True)], schema=SHARD_ARROW)
            shard += 1
            size = 0
            ids.clear()
            docs.clear()
            return row

        size = 0
        for batch in text_slices(batches, 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, got in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer, MOST_WORDS).encode(texts), strict=True):
                if size and size + len(got) // 4 + 1 > shard_tokens:
                    yield close()
                ids.append(got + tail)
                docs.append(doc)
                size += len(got) // 4 + 1
        if docs:
            yield close()

    return run


KNOTS = 64


def range_part(docs: DataFrame, parts: int):
    """A column with the number of each document's range, ascending with ``doc_id``, nulls in the first.

    A scan of ``doc_id`` alone gives ``KNOTS`` approximate quantiles; between two of
    them ranges are cut evenly.  Spark's own range partitioning would read the texts once more for its sample.
    """
    chances = [k / KNOTS for k in range(KNOTS + 1)]
    found = docs.select("doc_id").stat.approxQuantile("doc_id", chances, 1 / 1024)
    knots: list[tuple[float, float]] = []  # (id, share of the documents below it), ids rising
    for value, chance in zip(found, chances):  # an empty table has no quantiles
        if not knots or value > knots[-1][0]:
            knots.append((value, chance))
    if len(knots) < 2:
        return F.lit(0)
    x = F.col("doc_id").cast("double")

    def share(low: int, high: int):
        if high - low == 1:
            (a, p), (b, q) = knots[low], knots[high]
            return F.lit(p) + (x - F.lit(a)) / F.lit(b - a) * F.lit(q - p)
        middle = (low + high) // 2
        return F.when(x < knots[middle][0], share(low, middle)).otherwise(share(middle, high))

    number = F.floor(share(0, len(knots) - 1) * parts).cast("int")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(parts - 1), number)), F.lit(0))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 18) -> DataFrame:
    """Writes the shards under ``path`` and returns the stored table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionById(parts, range_part(rows, parts)).sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_shards(tokenizer, end_id, shard_tokens), SHARD_SCHEMA)
    shards.write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, image in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("image"), strict=True):
            matrix, docs, ends = open_shard(image.as_py())
            raw = matrix.to_array().astype("<u4", copy=False).data.cast("B")
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int64()), pa.array([shard] * len(docs), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "shard", "local_start", "n_tokens", "ids_crc32"],
            )


def shard_starts(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """part, shard, base: ids before each shard.

    Only a total for each range of documents (one for each writing task) reaches
    the driver; within a range the running sum stays distributed.
    """
    from pyspark.sql import Window

    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for row in totals:
        bases.append((row["part"], total))
        total += row["n"]
    per_part = spark.createDataFrame(bases, "part long, before long")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    local = stored.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner"))
    return local.join(per_part, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("base"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the stored images."""
    stored = spark.read.schema(SHARD_SCHEMA).parquet(path)
    decoded = stored.select("part", "shard", "image").mapInArrow(_read, DOC_SCHEMA)
    return decoded.join(shard_starts(spark, stored), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 18) -> DataFrame:
    """Shards written to scratch space, read back and removed; see ``read_shards`` for the columns."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    try:
        write_shards(docs, path, tokenizer, end_id, shard_tokens)
        return checkpointed(read_shards(spark, path))
    finally:
        remove_path(spark, path)


def occurrences(stored: DataFrame, token: int, most_places: int = 0) -> DataFrame:
    """part, shard, n, places: how often a token id occurs in each shard that holds it, and its first ``most_places`` places there.

    Counting and lookup go by rank and select on the planes that the id's bits name; no id is decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, shard, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                matrix, _, _ = open_shard(image.as_py())
                n = matrix.count(token)
                if n:
                    rows.append((part, shard, n, [matrix.locate(token, k) for k in range(min(n, most_places))]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "shard", "n", "places"])

    return stored.select("part", "shard", "image").mapInArrow(run, "part long, shard long, n long, places array<long>")
