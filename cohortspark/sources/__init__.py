"""Readers and writers of sample tables, side tables and reports."""

from cohortspark.sources.readers import (
    RUN_REPORT_SCHEMA,
    explode_run_files,
    read_run_report,
    read_run_table,
    read_samples,
    read_side_table,
    read_studies,
    sample_schema,
)
from cohortspark.sources.writers import (
    load_model,
    save_model,
    write_json,
    write_report,
    write_samples,
)

__all__ = [
    "RUN_REPORT_SCHEMA",
    "explode_run_files",
    "load_model",
    "read_run_report",
    "read_run_table",
    "read_samples",
    "read_side_table",
    "read_studies",
    "sample_schema",
    "save_model",
    "write_json",
    "write_report",
    "write_samples",
]
