"""What the corpus operators share: tables, folds, written intermediate tables and views of Arrow text as numpy."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.store import scratch

#: Bytes of text that one numpy step takes at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal digits, modulo parts; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one (tests) gets a temporary folder."""
    return scratch(spark)


def own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/frameloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet below the shared folder and read it back.

    A lost executor then costs a read, not the stages before. The table outlives the query; clear() removes it.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that written() left for this application below the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: int = 1, limit: int = SLICE_BYTES):
    """Cut record batches into slices of about `limit` bytes in the given text column, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and the len + 1 places where rows start; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def trim() -> None:
    """Give what a fit has freed back to the system, as far as the C library can."""
    gc.collect()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def smallest(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hash of doc_id, so that a sample doesn't depend on partitioning."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame, max_chars: int) -> DataFrame:
    """(text, other columns of ids) of a bounded table of ids, which is broadcast; longer texts don't take part."""
    return docs.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(F.broadcast(ids), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: int, class_bytes: int) -> list[tuple[str, int]]:
    """At most per_class (text, label) rows, of class_bytes in all, of either class from the folds that may be learnt from.

    Ids are chosen before texts are touched, in the order of a hash, which bounds what reaches the driver. No length of its
    own leaves a text out: only one that doesn't fit what is left of class_bytes is passed over.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", parts) != held)).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    sizes = docs.where("text <> ''").groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("_bytes"))
    known = known.join(sizes, "doc_id")
    chosen = []
    for y in (0, 1):
        left = class_bytes
        for r in smallest(known.where(F.col("_y") == y), per_class).collect():
            if r["_bytes"] <= left:
                left -= r["_bytes"]
                chosen.append((r["doc_id"], y))
    ids = docs.sparkSession.createDataFrame(chosen, known.select("doc_id", "_y").schema)
    texts = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(ids), "doc_id")
    return sorted(((r["text"], r["_y"]) for r in texts.collect()), key=lambda x: (x[1], x[0]))  # whatever the partitioning
