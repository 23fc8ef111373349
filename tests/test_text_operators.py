import pytest
from pyspark.sql import functions as F

from sparkloom.functions.fields import key_conflicts, overlap
from sparkloom.functions.pii import mask
from sparkloom.operators import denoise, evaluate


@pytest.mark.parametrize("text, out, kinds", [
    ("call 13812345678 now", "call [PHONE] now", ["phone"]), ("id 440308199901101512", "id [ID_CARD]", ["id_card"]), ("id 440308199901101513", "id 440308199901101513", []), ("card 4111111111111111", "card [BANK_CARD]", ["bank_card"]), ("card 4111111111111112", "card 4111111111111112", []),
    ("see https://192.168.1.1/a.", "see [URL].", ["url"]), ("host 10.0.0.1 and 999.1.1.1", "host [IP] and 999.1.1.1", ["ip"]), ("write a.b@example.com", "write [EMAIL]", ["email"]), ("bad@@example 12345678901", "bad@@example 12345678901", []), ("00:1A:2b:3c:4d:5e or 00:1A-2b:3c:4d:5e", "[MAC_ADDRESS] or 00:1A-2b:3c:4d:5e", ["mac_address"]),
    ("QQ: 123456", "[QQ]", ["qq"]), ("wechat: abc_12345", "[WECHAT]", ["wechat"]), ("tel 010-12345678", "tel [LANDLINE]", ["landline"]), (None, None, []), ("", "", []),
])
def test_personal_data(text, out, kinds):
    assert mask(text) == (out, kinds)


def brackets(spark, rows):
    return {r.t: (r.p.unpaired, r.p.mismatched) for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", evaluate.pairing_errors(F.col("t")).alias("p")).collect()}


def test_pairing(spark):
    want = {"(a [b])": (0, 0), "It's fine": (0, 0), "(a]": (0, 1), ")": (1, 0), "（x": (1, 0), 'say "hi': (1, 0), "“a” ‘b’": (0, 0), "({)": (1, 1), "'q' and \"q\"": (0, 0), "": (0, 0)}
    assert brackets(spark, want) == want


def test_evaluation(spark):
    rows = [
        (1, "a", "A proper text of some length.", "x"), (2, None, "short", "x"), (3, "c", None, None), (4, "d", "  ", "x"), (5, "e", "Same text here today", "x"), (6, "f", "same  TEXT here today", "x"),
        (7, "g", "aaaaaaaaaaaaaaaa", "x"), (8, "h", "What?!? No,,, really", "x"), (9, "i", "hidden​mark in the text", "x"), (10, "j", "☃☃☃☃☃☃☃☃ ☃☃☃", "x"), (11, "k", "open (bracket here", "x"), (12, "l", "fine…… really ?! yes", "x"), (13, "m", "x" * 10 + " word" * 500, "x"),
    ]
    got = {r.n: r for r in evaluate.evaluate_text(spark.createDataFrame(rows, "n int, id string, text string, label string")).collect()}
    issues = {n: r.issues for n, r in got.items()}
    assert issues[1] == [] and got[1].score == 100 and got[1].level == "Excellent" and got[1].action == "keep"
    assert issues[2] == ["missing_id", "too_short"] and issues[3] == ["missing_text_field", "empty_text", "missing_label"] and got[3].action == "drop" and issues[4] == ["empty_text"]
    assert issues[5] == issues[6] == ["duplicate_text"] and issues[7] == ["high_repetition"] and issues[8] == ["consecutive_punctuation_abnormal"] and issues[9] == ["special_characters_abnormal"]
    assert "abnormal_chars" in issues[10] and issues[11] == ["punctuation_pairing_abnormal"] and issues[12] == [] and "too_long" in issues[13]
    assert got[2].suggestions and got[5].action == "review"


def test_summary_and_levels(spark):
    df = spark.createDataFrame([(100.0, [], "keep"), (40.0, ["duplicate_text"], "drop")], "score double, issues array<string>, action string")
    s = evaluate.summarize(df).first()
    assert (s.rows, s.average_score, s.keep, s.drop, s.uniqueness_score, s.weighted_score) == (2, 70.0, 1, 1, 50.0, 90.0)
    assert [tuple(r) for r in evaluate.issue_counts(df).collect()] == [("duplicate_text", 1)]
    got = spark.createDataFrame([(90.0,), (89.9,), (75.0,), (60.0,), (59.9,)], "s double").select(evaluate.level(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == ["Excellent", "Good", "Good", "Average", "Poor"]


def test_denoising(spark):
    rows = [(1, "<p>Das ist ein ganz normaler Text mit mehr davon.</p> https://x.example/y"), (2, None), (3, "ab" * 200), (4, "# Title\n\nSome **bold** words [here](http://a.b) and more of them."), (5, "mail me at ann@example.com please, thank you"), (6, "数据 治理 平台 需要 处理。 这是 一段 文字"), (7, "Ã©tÃ© Ã©tÃ© was read with the wrong table")]
    got = {r.id: r for r in denoise.denoise_text(spark.createDataFrame(rows, "id int, text string"), language_detect={"allowed": ("zh", "en", "mixed")}).collect()}
    assert got[1].text == "Das ist ein ganz normaler Text mit mehr davon." and "html_or_url_removed" in got[1].issues and got[1].action == "keep"
    assert "empty_text" in got[2].issues and got[2].action == "drop" and "high_repetition" in got[3].issues
    assert got[5].text.startswith("mail me at [EMAIL]") and got[5].masked_types == ["email"] and got[5].action == "drop"
    assert got[6].text == "数据治理平台需要处理。这是一段文字" and "mojibake_repaired" in got[7].issues and got[7].text.startswith("été été")
    one = denoise.markdown_clean(denoise.start(spark.createDataFrame([rows[3]], "id int, text string"))).first()
    assert one.text == "Title Some bold words here and more of them."


def test_gate_leaks_and_routes(spark):
    df = spark.createDataFrame([(0.75, []), (0.74, []), (0.55, []), (0.54, []), (0.9, ["too_short"])], "quality_score double, issues array<string>")
    assert [r.action for r in denoise.gate(df).collect()] == ["keep", "review", "review", "drop", "drop"]
    leaks = denoise.leakage_guard(denoise.start(spark.createDataFrame([('{"a": [{"gold": 1}], "expected": 2}', ""), ('{"b": 1}', ""), (None, "")], "j string, text string")), "j").collect()
    assert [r.leakage_hits for r in leaks] == [["$.a[0].gold", "$.expected"], [], []]
    routes = denoise.route(spark.createDataFrame([("t", "i", None, None), (None, "i", None, None), ("t", None, "v", None), (None, None, None, " VIDEO "), (None, None, None, None)], "text string, image_path string, video_path string, modality string")).collect()
    assert [r.route for r in routes] == ["image_text_pair", "image", "video", "video", "unknown"]


def test_fields(spark):
    df = spark.createDataFrame([("a bike from 2024-05-01, AB12, 77", "The bicycle of 2024/5/1, XY99, 77"), (None, "x")], "a string, b string")
    got = df.select(overlap(F.col("a"), F.col("b")).alias("o"), key_conflicts(F.col("a"), F.col("b")).alias("k")).collect()
    assert got[0].o > 0.3 and (got[0].k.compared, got[0].k.conflicts) == (3, 1) and got[1].o == 0 and got[1].k.score is None
