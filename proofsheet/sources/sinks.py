"""Sinks (S12–S15): preview rows, detail table, result registry and audit,
written as Parquet by Spark (never collected)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions.expr import col


def preview_frame(df: DataFrame) -> DataFrame:
    """Every row, NaN → null, timestamps as ISO text."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(c), None).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_analysis(result, out_dir: str, mode: str = "overwrite") -> dict[str, str]:
    """Write every output of ``analyze`` under ``out_dir``."""
    frames = {
        "results": result.results, "kpis": result.kpis, "charts": result.charts, "insights": result.insights,
        "filters": result.filters, "table": result.table, "quality": result.quality, "profile": result.profile,
        "audit_counters": result.clean.counters, "audit_actions": result.clean.actions,
        "removed_rows": result.clean.removed_rows, "missing_locations": result.clean.missing_locations,
    }
    paths = {}
    for name, frame in frames.items():
        path = os.path.join(out_dir, name)
        frame.write.mode(mode).parquet(path)
        paths[name] = path
    return paths
