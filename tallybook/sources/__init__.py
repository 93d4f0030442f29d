"""Readers and writers of ledgers, lookups and datasets."""

from tallybook.sources.files import (
    missing_files,
    read_csv,
    read_dataset,
    read_ledgers,
    read_named,
    write_csv,
    write_dataset,
)

__all__ = [
    "missing_files",
    "read_csv",
    "read_dataset",
    "read_ledgers",
    "read_named",
    "write_csv",
    "write_dataset",
]
