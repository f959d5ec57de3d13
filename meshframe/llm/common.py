"""What the training-data operators share: table access, lineage cuts and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. On one machine a temporary folder stands in where it is
    unset; on a cluster that is an error, as executors could not read each other's files."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshframe-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables that operators wrote for their own use and whose results may still read them.
_made: list[str] = []


def written(df: DataFrame, name: str) -> str:
    """Write a Parquet table into the shared folder, for results as wide as texts; returns its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _one_file_scan(docs: DataFrame) -> bool:
    """Whether docs are the rows of files, each once at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a struct (file, at) that names each row whoever reads it again: the place in its Parquet file, and
    for rows from elsewhere a number in a copy that is written out."""
    if _one_file_scan(docs):
        try:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.select("*", place.alias("__row"))
        except AnalysisException:  # the files are not Parquet
            pass
    place = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    path = written(docs.withColumn("__row", place), "rows")
    _made.append(path)
    return docs.sparkSession.read.parquet(path)


def forget_rows(spark: SparkSession) -> None:
    """Delete the copies that numbered() wrote, once the results are written."""
    while _made:
        removed(spark, _made.pop())


def whole(text: str | Column) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def word_count(text: str | Column) -> Column:
    """Number of maximal runs without white space."""
    flat = F.trim(F.regexp_replace(whole(text), SPACES, " "))
    return F.when(flat == "", F.lit(0)).otherwise(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1
    ).cast("long")
