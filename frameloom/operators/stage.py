"""The folder that driver and executors share: files in it, and intermediate tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from frameloom.schemas import ServiceError, new_id


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[1]):
        raise ServiceError(f"{source} can't be renamed to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


#: Bytes of a generated method up to which the JVM compiles it.
_COMPILED_BYTES = "8000"


def tuned(spark: SparkSession) -> None:
    """Let Spark generate only methods that the JVM compiles, unless the session has a limit of its own.

    Parsers and decoders make wide projections; whole in one method, these would run three times slower, interpreted.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > int(_COMPILED_BYTES):
        spark.conf.set(limit, _COMPILED_BYTES)


_OWN_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ServiceError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_SCRATCH:
            _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="frameloom-"))
        root = _OWN_SCRATCH[0]
    return root.rstrip("/")


def _staging(spark: SparkSession) -> str:
    return f"{scratch(spark)}/frameloom-staged/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write an intermediate table below the shared folder and read it back: it is evaluated once, and a lost executor costs a read.

    It outlives the query; clear_staged() removes all of this application.
    """
    path = f"{_staging(df.sparkSession)}/{tag}-{new_id()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    _delete(spark, _staging(spark))
