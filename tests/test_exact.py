import __spark_entry__ as e
from pyspark.sql import functions as F

from sparkloom.functions.normalize import dedup_key
from sparkloom.operators.exact import exact_dedup, hash_edges


def test_normalize(spark):
    rows = [("Hello https://example.com   WORLD",), ("<b>Ａ&amp;B</b>，c",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(dedup_key(F.col("t"))).collect()]
    assert got == ["hello world", "a&b c", "", ""]


def test_one_kept_per_group_and_entry_works(spark):
    rows = [(9, "Same, text."), (10, "same text"), (3, "other"), (4, None), (5, " <p> ")]
    got = {tuple(r) for r in exact_dedup(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(10, 10, 2, "keep"), (9, 10, 2, "remove"), (3, 3, 1, "keep"), (4, None, 0, "review"), (5, None, 0, "review")}
    out = e.entry(spark)
    assert out.count() == spark.read.parquet(f"{e.SMOKE_DIR}/documents.parquet").count()
    assert out.where("action = 'keep'").count() == out.where("group_size > 0").select("keep_id").distinct().count()


def test_star_edges_and_empty_table(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x"), ("d", "y"), ("e", None)], "id string, k string")
    assert {(r.left_id, r.right_id) for r in hash_edges(df, "id", F.col("k")).collect()} == {("a", "b"), ("a", "c")}
    assert exact_dedup(df.where("false"), "id", "k").count() == 0
