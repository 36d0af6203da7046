"""Sources and sinks: table/parquet/CSV/workbook scans, result writers."""
