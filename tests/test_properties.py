"""Property tests: each generated example is checked as one DataFrame."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelrisk.functions import zero_pad
from parcelrisk.operators import profile

digits = st.from_regex(r"[+-]?[0-9]{0,9}", fullmatch=True)


@settings(max_examples=8, deadline=None)
@given(values=st.lists(digits, min_size=1, max_size=40), width=st.integers(1, 12))
def test_zero_pad_equals_zfill(spark, values, width):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(zero_pad("v", width)).collect()]
    assert got == [v.zfill(width) for v in values]


@settings(max_examples=6, deadline=None)
@given(xs=st.lists(st.integers(-1000, 1000), min_size=2, max_size=300), bins=st.integers(1, 20))
def test_histogram_equals_numpy(spark, xs, bins):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["count"] for r in profile.histogram(df, "x", bins).orderBy("bin").collect()]
    lo, hi = min(xs), max(xs)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    want, _ = np.histogram(np.array(xs, dtype=float), bins=bins, range=(lo, hi))
    assert got == want.tolist()


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 10**6)),
                     min_size=1, max_size=200, unique_by=lambda r: r[1]),
       parts=st.integers(1, 6))
def test_row_numbers_equal_a_full_sort(spark, rows, parts):
    from pyspark.sql import functions as F

    from parcelrisk.operators.ranking import row_numbers
    df = spark.createDataFrame(rows, "g int, k long").repartition(parts)
    got = row_numbers(df, [F.col("g").desc_nulls_last(), F.col("k").asc()], "pos") \
        .orderBy("pos").collect()
    # descending g with nulls last, then ascending k
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r.pos for r in got] == list(range(len(rows)))
    assert [(r.g, r.k) for r in got] == want
