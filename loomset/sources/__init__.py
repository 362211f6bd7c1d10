from loomset.sources.metrics import read_metrics
from loomset.sources.records import (
    file_counts,
    read_csv,
    read_json,
    read_jsonl,
    read_records,
    read_tsv,
    read_txt,
    scan_files,
)
