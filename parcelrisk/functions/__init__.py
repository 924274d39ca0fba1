"""Column-level functions (all built-in Spark expressions, no Python UDFs)."""

from parcelrisk.functions.scalars import (  # noqa: F401
    bool_to_int, composite_key, epoch_seconds, flag, nan_to_null, not_blank, not_in_keep_null,
    numeric_key_to_string, run_stamp, safe_ratio, zero_pad,
)
