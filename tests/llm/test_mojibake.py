import pytest

import __spark_entry__ as e
from sparkloom.llm.mojibake import repair, restore

SOUND = ["La façade du château était déjà fermée, même en été.", "Die größeren Bücher über Möbel hörten früh auf.", "Según él, la señora añadió más café allí.", "Красная книга лежала на столе у окна."]
KEPT = ["TNFα binds before IFNγ does", "x√2 is no rational number", "A∩B holds three", "Þórður fór heim", "5 º 7", "naïve Ωmega", "1 µm", "½ cup"]


@pytest.mark.parametrize("text", [None, "", "plain", *SOUND, *KEPT])
def test_sound_text_is_left_alone(text):
    assert repair(text) == (False, text, 0, False)


@pytest.mark.parametrize("text", SOUND)
@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "mac_roman", "cp850", "cp437"])
def test_utf8_read_with_a_table_is_restored(text, codec):
    try:
        garbled = text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        pytest.skip("bytes without a character")
    found, now, n, lost = repair(garbled)
    assert found and n and not lost
    if codec in ("latin-1", "cp1252"):
        assert now == text


def test_twice_garbled_and_only_in_part():
    text = SOUND[0]
    twice = text.encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252")
    assert repair("Sound: déjà vu. " + twice)[1] == "Sound: déjà vu. " + text


def test_lost_bytes_and_quoted_examples():
    assert repair("the caf� closed")[3]
    assert not repair('search for "Ã©" in the text')[0]


def test_single_byte_tables_by_what_the_corpus_attests(spark):
    rows = [(k, SOUND[k % 4]) for k in range(200)]
    rows += [(1000, SOUND[0].encode("cp1252").decode("mac_roman")), (1001, SOUND[1].encode("cp1252").decode("cp850")), (1002, SOUND[3].encode("koi8-r").decode("cp1251"))]
    rows += [(2000 + k, t) for k, t in enumerate(KEPT)] + [(3000, None), (3001, " ")]
    got = {r.id: r.restored for r in restore(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000: SOUND[0], 1001: SOUND[1], 1002: SOUND[3]}


def test_empty_table(spark):
    assert restore(spark.createDataFrame([], "doc_id long, text string, id string")).count() == 0


def test_registered():
    assert {"p9_found", "p9_restored"} <= set(e.queries())
