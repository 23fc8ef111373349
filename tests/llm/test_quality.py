import signal

import pytest

import __spark_entry__ as e
from sparkloom.llm.quality import stats


def test_p5_is_registered():
    assert {"p5_found", "p5_stats"} <= set(e.queries())


def test_speech_behind_dashes_ends_and_is_prose():
    text = "– The router measures the second copy while the disk is still busy.\nThe batch holds 28 clips.\n– The format is rarely used at the edge of the marsh."
    signal.alarm(5)  # it never ended
    try:
        assert stats(text)[-1] is None
    finally:
        signal.alarm(0)


def test_kinds():
    assert stats("Held:\n- the index cards\n- the wet maps\n- the crates")[-1] == "list"
    assert stats("a\tb\tc\n1\t2\t3\n4\t5\t6")[-1] == "table"
    assert stats("ok " * 60)[-1] == "junk"


@pytest.mark.parametrize("text", [
    "Kot śpi na dachu, a pies biega po ogrodzie i szczeka na sąsiadów.", "Kedi damda uyuyor ve köpek bahçede koşuyor, ama kimse onu görmüyor.",
    "Katten sover på taket och hunden springer runt i trädgården hela dagen.", "Kissa nukkuu katolla ja koira juoksee puutarhassa, mutta kukaan ei näe sitä.",
    "Pes běhá po zahradě a kočka spí na střeše celý den.", "A kutya fut a kertben, és a macska alszik a tetőn.", "Η γάτα κοιμάται στη στέγη και ο σκύλος τρέχει στον κήπο.",
])
def test_prose_of_other_languages_is_no_junk(text):
    assert stats(text)[-1] is None


@pytest.mark.parametrize("text", [
    "Grouboundfeind hiakrail furtkiathdi kerdim stiammeiskzirt giakliart tasfask gainfirthisk tiapruk.", "giwh ldpfuz jstwapjrq gfi fjhhs drtdigepald ituf leiwp hrhhkle qagl wprjqk fza qre",
    "^%!@~*_ ~.||*=.\\#@*$ |^@*-*&/.//|^_%?++?~", "download labels captions cheap bulk fast audio dataset corpus annotate best online",
])
def test_junk_stays_junk(text):
    assert stats(text)[-1] == "junk"


def test_nulls_blanks_and_long_texts(spark):
    from sparkloom.llm.quality import text_stats

    rows = [(1, None), (2, " "), (3, ""), (4, "A quiet word. " * 4000)]
    got = {r.id: r for r in text_stats(spark.createDataFrame(rows, "row_no long, text string"), "row_no").collect()}
    assert got[1].words is None and got[1].kind is None and got[2].words == 0 and got[2].kind is None and got[4].words == 12000
    assert text_stats(spark.createDataFrame([], "row_no long, text string, id string"), "row_no").count() == 0
