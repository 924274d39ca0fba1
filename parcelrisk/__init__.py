"""parcelrisk: user-level PySpark operators for scoring entities by the
probability of an event.

Every operator takes and returns Spark DataFrames (or Columns); nothing is
collected to the driver except results whose size is bounded by a parameter
(bucket splits, a checked small lookup table, a histogram range).
"""

from parcelrisk.session import build_session, scratch_dir  # noqa: F401

__version__ = "0.1.0"
