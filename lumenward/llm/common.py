"""What the operators of this subpackage share: inputs, scratch tables and word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, so that long texts do not pile up in a worker.
BATCH_BYTES = "4m"
#: Scratch folders of this driver that are not deleted yet, in the order they were named.
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows, unless the session has its own settings."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lumenward-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    _MADE.append(f"{shared_dir(spark)}/lumenward/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no plan reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _MADE:
            _MADE.remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch folders named inside are deleted at the end, but for those added to the list that this yields.

    For callers that write their result inside; a lazy result still reads its folders.
    """
    begin, kept = len(_MADE), []
    yield kept
    remove(spark, *[path for path in _MADE[begin:] if path not in kept])


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """A text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def sampled(df: DataFrame, key: str, rows: int, limit: int) -> DataFrame:
    """About limit of df's rows, chosen by a hash of a column; all of them if there are no more.

    For fitting only. Unlike a sort with a limit, no task or driver ever holds more than its share.
    """
    if rows <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(limit / rows * (1 << 30)))


def crc_of_id(column: str = "doc_id") -> Column:
    """Unsigned CRC-32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def portions(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in runs of about so many characters (a longer text is a run by itself), to bound what is held at once."""
    run: list[str] = []
    held = 0
    for text in texts:
        if run and held + len(text) > size:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs without ASCII white space, A-Z lower-cased.

    bytes.lower and bytes.split know ASCII only: exactly A-Z, and 0x20 with 0x09 to 0x0D.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
