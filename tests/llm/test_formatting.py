from pyspark.sql import functions as F

from sparkloom.llm.formatting import collapse, copies


def test_characters_and_notations(spark):
    rows = [
        ("a1", "Le café ferme"), ("a2", "le cafe\u0301 FERME!"), ("a3", "le cafe ferme"), ("w1", "ABC 12"), ("w2", "ＡＢＣ １２"), ("h1", "take ½"), ("h2", "take 12"),
        ("e1", "x = one\ny = two\nz = three"), ("e2", "z = three\nx = one\ny = two"), ("p1", "x: a|b\ny: two\nz: three"), ("p2", "y: two\nx: a|b\nz: three"),
    ]
    got = {(r.id, r.keep_id) for r in copies(spark.createDataFrame(rows, "id string, text string"), "id", F.col("text")).collect()}
    assert got == {("a1", "a1"), ("a2", "a1"), ("w1", "w1"), ("w2", "w1"), ("e1", "e1"), ("e2", "e1"), ("p1", "p1"), ("p2", "p1")}


def groups(spark, rows):
    got = copies(spark.createDataFrame(rows, "id string, text string, n int"), "id", F.col("text")).collect()
    return {frozenset(r.id for r in got if r.keep_id == k) for k in {r.keep_id for r in got}}


def test_two_fields_nested_objects_and_separators(spark):
    rows = [
        ("a", '{"name": "Ann", "age": 7}', 1), ("b", "age: 7\nname: Ann", 1), ("c", "name: Ann\tage: 7", 1), ("d", "age = 7, name = ann", 1), ("e", "AGE: 7; NAME: ANN", 1), ("x", "age: Ann\nname: 7", 1),
        ("f", '{"p": {"q": 1, "r": 2}, "s": 3}', 1), ("g", '{"s": 3, "p": {"r": 2, "q": 1}}', 1), ("h", '{"only": "one"}', 1), ("i", "only: one", 1),
        ("k1", "\u0915\u093f", 1), ("k2", "\u0915\u093e", 1), ("n", None, 1), ("m", " -- ", 1), ("m2", "...", 1),
    ]
    assert groups(spark, rows) == {frozenset("abcde"), frozenset("fg"), frozenset("hi")}


def test_collapse_counts_ids_and_variants(spark):
    rows = [("a", "One two", "x"), ("b", "one-TWO", None), ("b", "one-TWO", None), ("c", "onetwo", "y"), ("c", "onetwo", "x"), ("d", "three", None), ("n", None, "x")]
    got = collapse(spark.createDataFrame(rows, "id string, text string, v string"), "id", F.col("text"), F.col("v")).collect()
    assert {(r.keep_id, r.copies, tuple(r.variants)) for r in got} == {("a", 3, ("x", "y")), ("d", 1, ())}
    assert collapse(spark.createDataFrame([], "id string, text string, v string"), "id", F.col("text"), F.col("v")).count() == 0
