"""Column roles and schema-level operators (metadata only, no jobs)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnRoles:
    """Which column plays which part in feature building and scoring."""
    key: str
    identity: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    label: str | None = None
    fold: str | None = None
    passthrough: tuple[str, ...] = field(default=())

    def validate(self, df: DataFrame) -> "ColumnRoles":
        """Every named column exists and no column has two roles."""
        named = [self.key, *self.identity, *self.numeric, *self.categorical,
                 *self.binary, *self.passthrough]
        named += [c for c in (self.label, self.fold) if c]
        missing = [c for c in named if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        dup = sorted({c for c in named if named.count(c) > 1})
        if dup:
            raise ValueError(f"columns with more than one role: {dup}")
        return self


def other_columns(df: DataFrame, known: Sequence[str]) -> list[str]:
    """Columns of ``df`` not in ``known``, in table order."""
    k = set(known)
    return [c for c in df.columns if c not in k]


def column_slice(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Columns by position, Python slice semantics (``iloc[:, a:b]``)."""
    return df.select(*df.columns[slice(start, stop)])


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop columns; with ``strict`` a missing name is an error (pandas)."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"cannot drop missing columns: {missing}")
    return df.drop(*cols)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, plus the table's row
    count.  One aggregate over the table, then the column list is expanded
    from literals, so there is no join and nothing is collected."""
    meta = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"))
        for i, f in enumerate(df.schema.fields)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.inline(meta), "n_rows")


def duplicate_keys(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Key values held by more than one row, with their row count (a key
    column meant to be an index should return nothing)."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
