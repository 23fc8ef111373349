from sparkloom.llm import lookalike
from sparkloom.llm.lookalike import classes, equal_pairs, one_form

ROWS = [("a", "Pass word", 1), ("b", "Раss word", 1), ("c", "Pass\u00a0word", 1), ("d", "Pa\u200bss word ", 1), ("e", "pass word", 1), ("f", "Pass word", 1), ("g", "Pass  word", 1), ("h", None, 1), ("i", "ﬁne ＡＢ", 1), ("j", "fine AB", 1), ("k", "x²", 1), ("l", "x2", 1), ("m", "café", 1), ("n", "cafe\u0301", 1), ("o", "cafe", 1), ("a", "Pass word", 2)]


def test_forms():
    assert one_form("½ № ² ß") == "½ № ² ß" and one_form("½", signs=True) == "1⁄2"
    assert one_form("ꓮꓐ Ꭰ ρυ") == "AB D pu" and one_form("\u200b\ufeff") == ""


def test_pairs(spark, monkeypatch):
    want = {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("b", "f"), ("c", "d"), ("c", "f"), ("d", "f"), ("i", "j"), ("m", "n")}
    df = spark.createDataFrame(ROWS, "id string, text string, form int")
    assert {tuple(r) for r in equal_pairs(df).collect()} == want
    monkeypatch.setattr(lookalike, "SHARE", 2)  # hot forms are dealt out
    assert {tuple(r) for r in equal_pairs(df).collect()} == want


def test_classes_and_empty_table(spark):
    got = {r.form: (r.ids, r.spellings) for r in classes(spark.createDataFrame(ROWS, "id string, text string, form int")).collect()}
    assert got["Pass word"] == (5, 4) and got["café"] == (2, 2) and got["cafe"] == (1, 1)
    assert equal_pairs(spark.createDataFrame([], "id string, text string")).count() == 0
