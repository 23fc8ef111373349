import io
import math
import struct
import wave
import zipfile

from pyspark.sql import functions as F

from sparkloom.operators import media, parse, remote, synthesize

HTML = "<html><head><style>x</style></head><body><nav>menu</nav><h1>Title</h1><p>One <b>bold</b> line<table><tr><th>a</th><td>b</td></tr><tr><td>1</td><td></td></tr></table><ul><li>item<li>two</ul><h2></h2><footer>end</footer></body></html>"


def test_html():
    got = [(a["type"], a["text"]) for a in parse.html_artifacts(HTML)]
    assert got[0] == ("heading", "Title") and ("paragraph", "item") in got and ("paragraph", "two") in got and got[-1] == ("table", "a | b\n1")
    assert parse.html_artifacts("x<!--StartFragment--><p>in</p><!--EndFragment--><p>out</p>")[0]["text"] == "in" and parse.html_artifacts(None) == [] == parse.html_artifacts("<nav>x</nav>")


def test_parse_markdown_and_chunks(spark):
    df = parse.parse(spark.createDataFrame([(1, HTML), (2, None)], "id int, html string"), "html")
    one, two = df.orderBy("id").select("action", "artifact_count", parse.markdown(F.col("artifacts")).alias("m")).collect()
    assert one.action == "parsed" and one.m.startswith("## Title\n\n") and "| a | b |\n| --- | --- |\n| 1 |  |" in one.m and two.action == "failed"
    table = "| h |\n| --- |\n" + "".join(f"| row {k} with words |\n" for k in range(40))
    got = parse.chunk_text("Intro。Second sentence。\n" + table + "Tail. Not cut here. " * 3, 200)
    assert all("| h |\n| --- |" in c for c in got if "| row" in c) and sum(c.count("| row") for c in got) == 40 and got[-1].count("Not cut") == 3
    assert parse.chunk_text("x" * 500, 100) == ["x" * 500] and parse.chunk_text(None) == []
    rows = parse.explode_chunks(spark.createDataFrame([(1, "a。" * 30), (2, None)], "id int, t string"), "id", "t", 20).collect()
    assert [r.chunk_index for r in rows] == list(range(rows[0].chunk_count)) and {r.id for r in rows} == {1}


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    files = {"word/document.xml": doc, "word/media/p.png": "img", "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="One" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    assert [(a["type"], a["text"]) for a in parse.word_artifacts(buf.getvalue())] == [("heading", "Head"), ("paragraph", "Body text"), ("table", "c1 | c2")]
    assert [(a["type"], a["text"]) for a in parse.excel_artifacts(buf.getvalue())] == [("heading", "One"), ("table", "name | 5")] and parse.word_media(buf.getvalue()) == [("word/media/p.png", 3)]


def tone(seconds=0.5, rate=24000, level=8000):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(level * math.sin(k / 9) * (1 if k % 4800 < 3600 else 0.01))) for k in range(int(seconds * rate))))
    return buf.getvalue()


def picture(f, w=240, h=240):
    return f"P3 {w} {h} 255\n".encode() + b" ".join(b"%d %d %d" % f(x, y) for y in range(h) for x in range(w))


def test_media(spark):
    noise = picture(lambda x, y: ((x * 7 + y * 13) % 256, (x * y) % 256, (x ^ y) % 256))
    white = picture(lambda x, y: (255, 255, 255))
    rows = [("a.ppm", noise), ("b.ppm", white), ("c.png", b"broken"), ("d.ppm", None), ("e.ppm", noise)]
    got = {r.image_path: r for r in media.flag_duplicates(media.evaluate_images(spark.createDataFrame(rows, "image_path string, content binary")), F.col("image.pixel_hash"), "duplicate_image").collect()}
    assert got["a.ppm"].image.width == 240 and "duplicate_image" in got["a.ppm"].issues and "duplicate_image" in got["e.ppm"].issues
    assert "pure_white_image" in got["b.ppm"].issues and not got["c.png"].image.readable and got["d.ppm"].issues == ["image_not_found", "unsupported_format"]
    assert media.compare_images(noise, noise)["ssim"] > 0.999 and media.compare_images(noise, white)["ssim"] < 0.5
    audio = {r.audio_path: r for r in media.evaluate_audio(spark.createDataFrame([("a.wav", tone()), ("b.wav", tone(level=20)), ("c.wav", b"x"), ("d.mp3", b"x"), ("e.wav", None)], "audio_path string, content binary")).collect()}
    assert audio["a.wav"].audio.sample_rate == 24000 and "audio_sample_rate_mismatch" not in audio["a.wav"].issues and "audio_volume_range_abnormal" not in audio["a.wav"].issues
    assert "audio_volume_range_abnormal" in audio["b.wav"].issues and "audio_decode_failed" in audio["c.wav"].issues and "unsupported_audio_format" in audio["d.mp3"].issues and "audio_not_found" in audio["e.wav"].issues
    frames = spark.createDataFrame([("v", k, 5.0, 1.0, None if k == 0 else 0.5) for k in range(5)], "video_id string, frame int, mean double, std double, diff double")
    assert {"black_frames", "freeze_frames"} <= set(media.video_frames(frames).first().issues)


def test_synthesis(spark):
    schema = [{"name": "kind", "choices": ["a", "b"]}, {"name": "n", "type": "integer", "start": 1, "max": 3}, {"name": "m", "type": "integer", "start": 2}, {"name": "x", "type": "float", "start": 0.5, "step": 0.1}, {"name": "ok", "type": "boolean"}, {"name": "s", "prefix": "p"}]
    df = synthesize.records(spark.createDataFrame([("i", 0), ("j", 5)], "id string, source_index int"), schema)
    assert [tuple(r.record) for r in df.collect()] == [("a", 2, 4, 0.8, True, "p_i_5"), ("b", 3, 9, 1.3, False, "p_j_5")]
    bad = synthesize.validate_records(df, [*schema, {"name": "gone"}], [{"left": "m", "op": "<", "right": "n"}]).first()
    assert bad.issues == ["missing_field:gone", "consistency_rule_failed:m < n"] and synthesize.distribution(schema)["kind"]["type"] == "categorical"
    assert synthesize.replace_synonyms_in("big cat, big dog, bigger", {"big": ["large", "huge"], "bigger": ["larger"]}) == ("large cat, huge dog, larger", [("big", "large", 0), ("big", "huge", 9), ("bigger", "larger", 18)])
    one = spark.createDataFrame([("Hello there. More.", "1. What is it?\n- Why?\nno", "name | age\nAnn | 7")], "t string, q string, tab string")
    r = one.select(synthesize.first_sentence(F.col("t")).alias("f"), synthesize.parse_questions(F.col("q")).alias("q"), synthesize.fill_template("{a} and {{ a }} {b}", a=F.col("t")).alias("x")).first()
    assert (r.f, r.q, r.x) == ("Hello there.", ["What is it?", "Why?"], "Hello there. More. and Hello there. More. {b}")
    assert [(r.question, r.answer) for r in synthesize.table_questions(one.withColumn("id", F.lit(1)), "id", "tab").collect()] == [("What is the age of Ann?", "7")]
    made = synthesize.generate(one.select("t"), "t", remote.echo()).first()
    assert made.generated_text == "answer to: Hello there. More." and made.generated_text_error is None
    gated = synthesize.gate(synthesize.diversity(spark.createDataFrame([(1, "x", []), (2, "x", []), (3, "", ["bad"])], "k int, t string, issues array<string>"), "t", "k"), F.col("t") != "", retries=F.lit(1)).orderBy("k").collect()
    assert [(r.quality, r.status) for r in gated] == [(1.0, "accepted"), (0.6, "needs_retry"), (0.2, "needs_retry")]
    tries = synthesize.with_retries(spark.createDataFrame([(1,), (2,)], "k int"), lambda d, n: d.withColumn("status", F.when(F.col("k") <= n + 1, "accepted").otherwise("needs_retry")), 0)
    assert {r.k: r.status for r in tries.collect()} == {1: "accepted", 2: "filtered"}


def test_answers_of_models():
    assert remote.json_object('so ```json\n{"a": {"b": 1}}\n``` done') == {"a": {"b": 1}} and remote.json_object("none {x") is None
    for url in ("http://a.b/c", "https://u:p@a.b", "file:///x", "https://"):
        try:
            remote.checked(url)
        except ValueError:
            continue
        raise AssertionError(url)
