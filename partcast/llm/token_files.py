"""Token-ID output: ids in fixed-size blocks, transposed into byte or bit planes, each
plane compressed with zstandard, with a chunk index; and the reader.

Documents are range-partitioned by doc_id, so a task writes one shard of consecutive
documents.  Ids run on across documents; every ``block`` of them is one chunk: its planes
(plane k holds byte, or bit, k of every id) are compressed on their own.  High planes are
nearly constant and shrink to almost nothing.  Chunks are rows of Parquet files without
further compression, so any store that Spark reaches will do.  A chunk's index columns name
the shard, the chunk, its number of ids, and the documents in it with their places.

Defined results: a null or empty text is the end id alone; very long texts are encoded whole,
over as many blocks as they take; rows with one doc_id are written in the order of their texts; null doc_ids come first; an empty table gives files without
rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partcast.llm.tokens import DEFAULT_TOKENIZER, encoded
from partcast.session import ensure_checkpoint_dir

BLOCK = 32_768
LEVEL = 3
CHUNK = ("shard int, chunk int, n_ids int, bits int, planes array<binary>, "
         "docs array<struct<doc_id:bigint,doc_start:bigint,n_tokens:bigint,here:int>>")


def to_planes(ids: np.ndarray, bits: int, level: int = LEVEL) -> list[bytes]:
    """Compressed planes of little-endian 32-bit ids: 4 byte planes (bits=8) or 32 bit
    planes (bits=1)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level)
    data = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        planes = [np.ascontiguousarray(data[:, k]) for k in range(4)]
    else:
        flat = np.unpackbits(data, axis=1, bitorder="little")
        planes = [np.packbits(flat[:, k]) for k in range(32)]
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, bits: int) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p, max_output_size=max(1, n_ids)), dtype=np.uint8) for p in planes]
    if bits == 8:
        data = np.stack(raw, axis=1)
    else:
        data = np.packbits(np.stack([np.unpackbits(p, count=n_ids) for p in raw], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(data).view("<u4").reshape(-1)


def write_ids(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0, block: int = BLOCK,
              bits: int = 8, level: int = LEVEL) -> None:
    """Encode ``docs`` (doc_id, text) and write the files to ``path``."""
    if bits not in (1, 8):
        raise ValueError("bits is 1 or 8")

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("doc_start", pa.int64()), ("n_tokens", pa.int64()), ("here", pa.int32())]))
        shard, chunk, written = TaskContext.get().partitionId(), 0, 0
        held, n_held, docs_here = [], 0, []

        def flush(ids):
            nonlocal chunk
            row = {"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                   "n_ids": pa.array([len(ids)], pa.int32()), "bits": pa.array([bits], pa.int32()),
                   "planes": pa.array([to_planes(ids, bits, level)], pa.list_(pa.binary())),
                   "docs": pa.array([docs_here], kinds)}
            chunk += 1
            return pa.RecordBatch.from_pydict(row)

        for part, texts_ids in encoded(batches, tokenizer):
            for doc_id, ids in zip(part.column(0).to_pylist(), texts_ids):
                n, begin, start = len(ids) + 1, 0, written
                ids = np.append(ids, np.uint32(end_id))
                written += n
                while begin < n:
                    take = min(n - begin, block - n_held)
                    held.append(ids[begin:begin + take])
                    docs_here.append({"doc_id": doc_id, "doc_start": start, "n_tokens": n, "here": take})
                    begin, n_held = begin + take, n_held + take
                    if n_held == block:
                        yield flush(np.concatenate(held))
                        held, n_held, docs_here = [], 0, []
        if n_held:
            yield flush(np.concatenate(held))

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, CHUNK)
     .write.option("compression", "uncompressed").parquet(path))


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, chunk, n_ids, n_docs, start (of its first id among all ids)."""
    rows = spark.read.schema(CHUNK).parquet(path).select("shard", "chunk", "n_ids", F.size("docs").alias("n_docs"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.join(F.broadcast(shard_starts(rows)), "shard")
            .withColumn("start", F.col("shard_start") + F.sum("n_ids").over(before) - F.col("n_ids")).drop("shard_start"))


def shard_starts(rows: DataFrame) -> DataFrame:
    """One row per shard (at most the number of write tasks): ids before it."""
    w = W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n"))
            .select("shard", (F.sum("n").over(w) - F.col("n")).alias("shard_start")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    A document within one chunk is summed there; the parts of one that crosses chunks are
    brought together by its place (their number is bounded by the document's own length).
    """
    files = spark.read.schema(CHUNK).parquet(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids, at = from_planes(row["planes"], row["n_ids"], row["bits"]), 0
                out = {k: [] for k in ("shard", "chunk", "doc_id", "doc_start", "n_tokens", "crc", "part")}
                for d in row["docs"]:
                    raw = ids[at:at + d["here"]].tobytes()
                    at += d["here"]
                    all_here = d["here"] == d["n_tokens"]
                    for k, v in (("shard", row["shard"]), ("chunk", row["chunk"]), ("doc_id", d["doc_id"]),
                                 ("doc_start", d["doc_start"]), ("n_tokens", d["n_tokens"]),
                                 ("crc", zlib.crc32(raw) if all_here else None), ("part", None if all_here else raw)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["shard"], pa.int32()), pa.array(out["chunk"], pa.int32()),
                     *(pa.array(out[k], pa.int64()) for k in ("doc_id", "doc_start", "n_tokens", "crc")),
                     pa.array(out["part"], pa.binary())], names=list(out))

    parts = files.mapInArrow(run, "shard int, chunk int, doc_id long, doc_start long, n_tokens long, crc long, part binary")
    docs = (parts.groupBy("shard", "doc_start", "doc_id", "n_tokens")
            .agg(F.max("crc").alias("crc"), F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("chunk", "part")))).alias("p"))
            .withColumn("ids_crc32", F.coalesce("crc", F.crc32(F.aggregate(F.col("p.part"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))))))
    starts = shard_starts(files.select("shard", "n_ids"))
    return (docs.join(F.broadcast(starts), "shard")
            .select("doc_id", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/partcast-llm/token-files-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
