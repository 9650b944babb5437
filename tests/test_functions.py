import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fn


def values(spark, column, items):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_durations(spark):
    items = ["PT1H2M3S", "PT59S", "PT", "P1DT1S", "junk", "", None, "PT2H"]
    assert values(spark, fn.duration_seconds, items) == [3723, 59, 0, -1, -1, -1, -1, 7200]
    assert values(spark, fn.duration_seconds_with_days, items) == [3723, 59, None, 86401, None, None, None, 7200]


def test_last_value_of_pairs(spark):
    texts = ["a=1;b=2;a=3", "", "x", " a = u=v ;", None]
    last = lambda key: values(spark, lambda c: fn.last_value(fn.pairs_list(c), F.lit(key)), texts)
    assert last("a") == ["3", None, None, "u=v", None] and last("b") == ["2", None, None, None, None]


def test_channel_keys(spark):
    items = ["https://y.test/channel/UCx/", "https://y.test/@Name?x=1", "Name", "", "https://y.test/c/Some"]
    assert values(spark, fn.channel_key, items) == ["channel:ucx", "handle:name", "last:name", "", "last:some"]


def test_text(spark):
    assert values(spark, fn.normalized, ["  A \n b ", None]) == ["a b", None]
    assert values(spark, fn.first_line, ["\n  \n first \nsecond", "", None]) == ["first", None, None]
    assert values(spark, fn.truthy, ["True", "1", " yes ", "y", None]) == [True, True, True, False, False]
    assert values(spark, fn.label_list, ["a; b;;a", "", None]) == [["a", "b"], [], None]
    assert values(spark, fn.json_tags, ['["a","b"]', "x y", None]) == ["a b", "x y", ""]


def test_z_and_p(spark):
    rows = spark.createDataFrame([(30, 100, 10, 100), (0, 0, 1, 2), (0, 5, 0, 5)], "a int, b int, c int, d int")
    z = fn.two_proportion_z(*(F.col(c) for c in "abcd"))
    got = rows.select(z.alias("z")).withColumn("p", fn.two_sided_p(F.col("z"))).collect()
    assert got[0].z == pytest.approx(3.5355, abs=1e-3) and got[0].p == pytest.approx(0.000407, abs=1e-5)
    assert got[1].z is None and got[2].z is None
