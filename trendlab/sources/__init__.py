from trendlab.sources.files import accepted, detect_encoding, file_quality_report, inspect_files, missing_columns, run_summary
from trendlab.sources.sinks import (
    Matrix, load_features, read_matrix, read_vectors, write_change_log, write_mapped, write_mapping_sample,
    write_matrix, write_stats, write_vectors,
)
from trendlab.sources.term_log import PANDAS_NA, LogColumns, date_layouts, read_term_log

__all__ = [
    "LogColumns", "Matrix", "PANDAS_NA", "accepted", "detect_encoding", "file_quality_report", "inspect_files",
    "date_layouts", "load_features", "missing_columns", "read_matrix", "read_term_log", "read_vectors", "run_summary",
    "write_change_log", "write_mapped", "write_mapping_sample", "write_matrix", "write_stats", "write_vectors",
]
