import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from smelter.functions.categories import normalize_categories
from smelter.functions.text import as_date, empty_to_null, iso_timestamp, last_segment, strip


def cleaned(spark, lists):
    df = spark.createDataFrame([(x,) for x in lists], "c array<string>")
    return [r[0] for r in df.select(normalize_categories(F.col("c"))).collect()]


def one_code(text):
    """Clean-up of one code by the letter of the rules; brute force for the column form."""
    text = re.sub(r"[ \t\n\x0b\f\r]-[^\n\r\x85\u2028\u2029]*", "", text)
    text = re.sub(r"[ \t\n\x0b\f\r]*\([^\n\r\x85\u2028\u2029]*\)", "", text)
    text = text.strip(" ").lower()
    return text if "." in text else text + ".gen"


def brute(categories):
    if categories is None:
        return None
    codes = [one_code(p) for c in categories if c is not None for p in c.split(",")]
    return [c for c in codes if c != ".gen"]


def test_dirty_categories(spark):
    dirty = [
        "cs.SE (Software Engineering)", "cs.AI - something, cs.CL", None, "", " (x)", "ml",
        "cs.LG\t", "math.CO (a) b (c)", "cs.AI-x", ",",
    ]
    clean = ["cs.se", "cs.ai", "cs.cl", "ml.gen", "cs.lg\t", "math.co", "cs.ai-x"]
    assert cleaned(spark, [dirty, None, [], [""], [None], [" - x"], ["cs.AI", "cs.AI (x)"]]) == [
        clean, None, [], [], [], [], ["cs.ai", "cs.ai"],
    ]


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.lists(st.one_of(st.none(), st.text(alphabet="aB.,- ()\t\n\r$\\\x85\u2028", max_size=14))),
        ),
        min_size=20,
        max_size=60,
    )
)
def test_clean_up_equals_brute_force(spark, lists):
    assert cleaned(spark, lists) == [brute(x) for x in lists]


@pytest.mark.parametrize(
    "path, segment", [("http://x/abs/2401.1v1", "2401.1v1"), ("a/", ""), ("", ""), ("a", "a"), (None, None)]
)
def test_last_segment(spark, path, segment):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(last_segment(F.col("p"))).first()[0] == segment


def test_strip_is_python_strip(spark):
    texts = [" a ", "\t\n a b \r", " x　", "\xa0\x1fy\x85", "\u200bz", "", "  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip(F.col("t"))).collect()]
    assert got == [t.strip() if t is not None else None for t in texts]


def test_empty_to_null(spark):
    df = spark.createDataFrame([("",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(empty_to_null(F.col("t"))).collect()] == [None, " ", None]


def test_iso_timestamp(spark):
    texts = [
        "2024-01-01T12:00:00Z", "2024-01-01T12:00:00+02:00", "2024-01-01", "2024", "12:30",
        "1704067200", "garbage", "2024-13-01T00:00:00Z", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(iso_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2024-01-01 12:00:00", "2024-01-01 10:00:00", "2024-01-01 00:00:00"] + [None] * 6


def test_as_date(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("nonsense",)], "t string")
    assert [str(r[0]) for r in df.select(as_date(F.col("t"))).collect()] == ["2024-01-01", "None"]
    ts = spark.sql("SELECT timestamp '2024-05-06 23:59:59' t")
    assert str(ts.select(as_date(F.col("t"))).first()[0]) == "2024-05-06"


def test_clean_up_stays_in_generated_code(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(["a"],)], "c array<string>").write.parquet(path)
    df = spark.read.parquet(path).select(normalize_categories(F.col("c")).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.lstrip().startswith("*(1) Project") and "Exchange" not in plan
