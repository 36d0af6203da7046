"""Dataset dispatch and table scans."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder; NaN becomes NULL at scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return nan_to_null(df)


def spread(df: DataFrame) -> DataFrame:
    """Give row-wise work every core when a scan yields fewer splits than the
    cluster's default parallelism (e.g. a single-row-group file).  A large
    scan already has more splits than cores and is returned unchanged, so
    this never adds a shuffle at scale.  Measured locally it costs more than
    it saves for the driver tables, so callers opt in."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN is a missing value in this model (Spark aggregates would
    otherwise treat it as a number)."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def load_dataset(spark: SparkSession, path: str, format: str | None = None, sheet: str | None = None,
                 **options) -> DataFrame:
    """Dispatch by format — csv/tsv/txt, xlsx, parquet, or a catalog table."""
    fmt = (format or os.path.splitext(path)[1].lstrip(".")).lower()
    if not fmt and "/" in path:  # a folder: by the ending of its first file
        names = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
        fmt = os.path.splitext(names[0][0])[1].lstrip(".").lower() if names else "table"
    fmt = fmt or "table"
    if fmt in {"csv", "tsv", "txt"}:
        from proofsheet.sources.delimited import read_delimited
        return read_delimited(spark, path, **options)
    if fmt in {"xlsx", "xlsm"}:
        from proofsheet.sources.workbook import read_sheet
        return read_sheet(spark, path, sheet)
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt == "table":
        return nan_to_null(spark.table(path))
    return nan_to_null(spark.read.format(fmt).options(**options).load(path))
