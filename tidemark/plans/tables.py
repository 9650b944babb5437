"""Tables that plans write on their way: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is set, a local master gets a folder of its own; a cluster must name one, since a
    folder of one machine would lose rows.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, *, instead_of: DataFrame | None = None, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder; `instead_of` names a written table that df was made
    from and that nothing needs any more: its files go once df's are there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    if instead_of is not None:
        removed(instead_of)
    return out


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that `written` returned; other DataFrames stay as they are."""
    if path := table.__dict__.get("_tidemark_path"):
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def numbered(df: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """df with `name`: the rows' places from 0 in the given total order, and `_rows`, how many there are.

    Rows are sorted by range; a place is put together from the place in the range and the sizes of the
    ranges before it, of which there is one row each. So no task sorts all rows.
    """
    at = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row for each range
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return out.withColumn(name, place).drop("_part", "_start", "_at")
