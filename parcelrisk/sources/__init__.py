"""Readers (delimited, zipped delimited, directories, Parquet) and sinks."""

from parcelrisk.sources.readers import (  # noqa: F401
    directory_entries, entry_table_name, list_files, read_delimited, read_directory, read_table,
    read_zipped_delimited, synthetic_binary,
)
from parcelrisk.sources.sinks import (  # noqa: F401
    register_directory, write_delimited, write_run, write_zipped_delimited,
)
