"""proofsheet — audited table analytics expressed as Spark DataFrame jobs.

Every operator takes and returns lazy DataFrames.  Nothing row-level is
collected on the driver; the only driver-side values are bounded metadata
(column names, roles, one-row aggregates such as a mean used for imputation).
"""

from proofsheet.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
