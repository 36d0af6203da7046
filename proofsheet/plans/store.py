"""Cleaned copies that later runs use again (S17), and the preview of one.

A copy is found by what it was made from: the files of the input (path, size,
time of change), the roles given, the mode, the manual values, the rows deleted
and the reader's options.  Its frames are written first and its manifest row
last, in one append, so a copy that a lost driver left half written is never
found; two runs that make the same copy at once both succeed, the later
manifest row wins.  A file replaced by another of the same size within the same
millisecond is not noticed.  ``evict`` removes copies.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions.expr import col
from proofsheet.operators.clean import SRC, CleanResult, clean_dataset
from proofsheet.operators.explore import repaired_cells
from proofsheet.operators.profile import ColumnProfile, infer_columns, profile_frame
from proofsheet.plans.analysis import with_source_row
from proofsheet.sources.sinks import preview_frame
from proofsheet.sources.tables import load_dataset

MANIFEST = "key string, folder string, written timestamp, evicted boolean, content string"
FRAMES = [f.name for f in fields(CleanResult) if f.type == "DataFrame"]


def _checksum(df: DataFrame) -> list:
    """Rows and two order-free sums of their hashes."""
    marks = [x for c in df.columns for x in (col(c).isNull(), col(c).cast("string"))]
    sums = [F.sum(F.xxhash64(F.lit(i), *marks).cast("decimal(38,0)")).cast("string") for i in (0, 1)]
    return list(df.agg(F.count(F.lit(1)), *sums).collect()[0])


def input_key(spark: SparkSession, path: str, request: dict, tables: list[DataFrame]) -> str:
    """SHA-256 of the input's file list, the request and its small tables.  The
    list is summed up by Spark; only the sums come to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    said = [_checksum(files), request, [_checksum(t) for t in tables]]
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _enter(spark: SparkSession, store: str, key: str, folder: str, evicted: bool, content: str | None) -> None:
    row = spark.createDataFrame([(key, folder, evicted, content)], "key string, folder string, evicted boolean, content string")
    row.withColumn("written", F.current_timestamp()).select("key", "folder", "written", "evicted", "content").coalesce(1) \
        .write.mode("append").parquet(f"{store}/manifest")


def _latest(spark: SparkSession, store: str, key: str):
    gone = _manifest(spark, store).where("evicted").select("folder")
    rows = _manifest(spark, store).where(~F.col("evicted") & (F.col("key") == key)).join(gone, "folder", "left_anti")
    return next(iter(rows.orderBy(F.col("written").desc(), "folder").limit(1).collect()), None)


def cleaned_copy(spark: SparkSession, store: str, path: str, mapping: dict[str, str] | None = None, mode: str = "recommended",
                 overrides: DataFrame | None = None, deleted_rows=None, source_row: str | None = None,
                 **options) -> tuple[CleanResult, bool]:
    """The cleaned copy of the files at ``path`` and whether an earlier run had
    made it.  ``store``: a folder that all executors and runs share."""
    tables = [t for t in (overrides, deleted_rows) if isinstance(t, DataFrame)]
    request = {"path": path, "mapping": mapping or {}, "mode": mode, "source_row": source_row, "options": options,
               "overrides": overrides is not None, "deleted": None if isinstance(deleted_rows, DataFrame) or deleted_rows is None else sorted(deleted_rows)}
    store = store.rstrip("/")
    key = input_key(spark, path, request, tables)
    row = _latest(spark, store, key)
    reused = row is not None
    if not reused:
        df = with_source_row(load_dataset(spark, path, **options), source_row)
        made = clean_dataset(df, infer_columns(df, mapping), mode, overrides, deleted_rows)
        folder = f"{store}/{key}-{uuid.uuid4().hex}"
        for name in FRAMES:
            getattr(made, name).write.parquet(f"{folder}/{name}")
        content = {"profiles": [{**asdict(p), "sample_values": [str(v) for v in p.sample_values]} for p in made.profiles],
                   "empty": made.excluded_empty_columns, "schemas": {n: getattr(made, n).schema.jsonValue() for n in FRAMES}}
        _enter(spark, store, key, folder, False, json.dumps(content, ensure_ascii=False))
        row = _latest(spark, store, key)
    content = json.loads(row["content"])
    frames = {n: spark.read.schema(T.StructType.fromJson(content["schemas"][n])).parquet(f"{row['folder']}/{n}") for n in FRAMES}
    return CleanResult(**frames, profiles=[ColumnProfile(**p) for p in content["profiles"]], excluded_empty_columns=content["empty"]), reused


def evict(spark: SparkSession, store: str, before) -> int:
    """Remove the copies written before a time: first entered as evicted, so
    that no run finds them, then their folders go.  A run that reads one of
    them at this moment fails and makes its own copy when started again."""
    store = store.rstrip("/")
    m = _manifest(spark, store)
    old = m.where(~F.col("evicted") & (F.col("written") < F.lit(before))).join(m.where("evicted").select("folder"), "folder", "left_anti")
    rows = old.select("key", "folder").collect()   # one row a copy
    for r in rows:
        _enter(spark, store, r["key"], r["folder"], True, None)
        target = spark._jvm.org.apache.hadoop.fs.Path(r["folder"])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(rows)


@dataclass
class Preview:
    """Every cleaned row as the review shows it, with the names of its
    repaired columns; the profile inferred again from the cleaned rows; the
    audit's counters and actions."""
    rows: DataFrame
    profile: DataFrame
    counters: DataFrame
    actions: DataFrame


def preview(cleaned: CleanResult, mapping: dict[str, str] | None = None) -> Preview:
    """S12/P32/J6.  ``rows``: ``__source_row``, the data columns with missing
    numbers null and times as ISO text, ``repaired_columns``."""
    work = cleaned.cleaned
    shown = repaired_cells(preview_frame(work), cleaned.actions, SRC)
    return Preview(shown, profile_frame(work.sparkSession, infer_columns(work, mapping)), cleaned.counters, cleaned.actions)
