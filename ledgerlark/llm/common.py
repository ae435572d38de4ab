"""What the operators of this subpackage share: tables, the shared folder, text rules."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class of Java, Python and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of rows that Python workers get at once; texts are long, so rows are no measure.
ARROW_BYTES = 4 << 20
#: Bytes of a row group of long rows, as written.
GROUP_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches of Arrow jobs by bytes, so that workers hold few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one;
    a cluster's executors couldn't see that, so that it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_ledgerlark_dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = spark._ledgerlark_dir = tempfile.mkdtemp(prefix="spark-ledgerlark-")
    return at.rstrip("/")


def written(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there,
    and a lost executor costs no recomputation of what came before.

    Parquet looks at its buffers every 100 rows, and Spark reads up to 4,096 rows of a row group at once. long_rows is for rows of
    megabytes: buffers are looked at row by row, so that a task holds a small row group and not its whole file.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if long_rows:
        out = out.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1)
    out.parquet(path)
    del df, out
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._written_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps whose results are written; it
    otherwise waits for the driver to happen to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, as the contracts ask; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
