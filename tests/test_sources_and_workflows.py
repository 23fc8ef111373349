import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.plans import registry, shared, workflow
from sparkloom.sources import readers, writers
from sparkloom.streaming.exact import first_seen


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scans_and_envelope(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '﻿{"id": "x", "text": "one", "more": 1}\n\nnot json\n{"content": "two", "image": "p.png", "payload": {"audio": "a.wav"}}\n')
    rows = readers.envelope(readers.scan(spark, p, bad="keep")).orderBy("line_no").collect()
    assert [(r.id, r.modality, r.payload.text, r.line_no) for r in rows] == [("x", "text", "one", 1), ("a_3", "unknown", None, 3), ("a_4", "image_text_pair", "two", 4)]
    assert readers.scan(spark, p, bad="drop").count() == 2
    with pytest.raises(Exception, match="MALFORMED|parse"):
        readers.scan(spark, p).select("record").collect()
    c = write(tmp_path / "b.csv", 'id,text,label\n1,"two\nlines, ""quoted""",x\n2,,\n')
    got = readers.envelope(readers.scan(spark, c)).collect()
    assert got[0].payload.text == 'two\nlines, "quoted"' and got[0].meta.label == "x" and got[1].modality == "unknown"
    j = write(tmp_path / "c.json", '[{"uid": "u", "body": "text"}]')
    assert readers.envelope(readers.scan(spark, j)).first().id == "u"
    y = write(tmp_path / "d.yaml", "items:\n  - {id: s1, content: seed}\n  - content: other\n")
    assert [r.payload.text for r in readers.envelope(readers.scan(spark, y)).orderBy("line_no").collect()] == ["seed", "other"]
    assert readers.envelope(readers.from_stdin(spark, "plain words")).first().payload.text == "plain words"
    (tmp_path / "deep").mkdir()
    write(tmp_path / "deep" / "t.txt", "in a file")
    write(tmp_path / "deep" / ".hidden.txt", "no")
    assert [r.text for r in readers.manifest(spark, [str(tmp_path / "deep")]).collect()] == ["in a file"] and readers.resolve(str(tmp_path / "deep")) == "directory"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "keep"), ("b", "drop"), ("c", "odd")], "id string, action string")
    counts = writers.write_split(df, str(tmp_path / "out"), "denoise")
    assert counts == {"total": 3, "clean": 1, "dropped": 1, "review": 1} and os.path.isdir(tmp_path / "out" / "split=clean")
    stage = str(tmp_path / "stage")
    assert writers.append_stage(df, stage) == 3 and writers.append_stage(df.unionByName(spark.createDataFrame([("d", "keep")], df.schema)), stage) == 1
    assert "| a | keep |" in writers.markdown_report("T", {"rows": 3}, {"all": df.orderBy("id")})


def test_workflows(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", "\n".join(json.dumps({"id": str(k), "text": t}) for k, t in enumerate(["<b>Hello</b> world of texts", "plain"])))
    own = write(tmp_path / "own.py", registry.template("my_length"))
    flow = {"input": {"path": p, "type": "json"}, "custom_operators": [own], "steps": [{"id": "s", "operator": "modality_router"}], "output": {"path": str(tmp_path / "o")}}
    assert {r.route for r in workflow.run(spark, flow, [str(tmp_path)]).collect()} == {"text"}
    assert "my_length" in registry.names()
    with pytest.raises(PermissionError):
        workflow.run(spark, flow, [str(tmp_path / "elsewhere")])
    steps = [{"id": "c", "operator": "x", "depends_on": ["a", "b"]}, {"id": "a", "operator": "x"}, {"id": "b", "operator": "x", "depends_on": ["a"]}]
    assert [[s["id"] for s in level] for level in workflow.levels(steps)] == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="circle"):
        workflow.levels([{"id": "a", "operator": "x", "depends_on": ["b"]}, {"id": "b", "operator": "x", "depends_on": ["a"]}])
    assert workflow.validate({"steps": [{"operator": "nothing"}]}) and workflow.closure(["b"], {"a": [], "b": ["a"], "c": []}) == ["a", "b"]
    with pytest.raises(ValueError):
        registry.register("Bad Name", len)
    with pytest.raises(ValueError):
        registry.register("text_denoise", len)


def test_rows_and_command_line(spark, tmp_path, capsys):
    op = registry.row_operator(lambda r, s: {"id": r["id"], "n": len(r["text"]) + s}, "id string, n long", setup=lambda: 10)
    assert op(spark.createDataFrame([("a", "xyz")], "id string, text string")).first().n == 13
    conf = write(tmp_path / "w.json", json.dumps({"input": {"path": "x"}, "steps": [{"operator": "html_clean"}]}))
    assert cli.main(["validate", "-c", conf]) == 0 and cli.main(["operators"]) == 0 and "html_clean" in capsys.readouterr().out


def test_stream_keeps_the_first(spark, tmp_path):
    src = tmp_path / "s"
    spark.createDataFrame([("a", "Same text", 1), ("b", "same TEXT!", 2), ("c", "other", 3)], "id string, text string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.json(str(src))
    stream = first_seen(spark.readStream.schema("id string, text string, ts timestamp").json(str(src)), "text", "ts")
    query = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.hash for r in spark.table("firsts").collect()}
    assert spark.table("firsts").count() == 2 == len(got)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.scratch_root(type("Session", (), {"conf": Conf(), "sparkContext": Context()})())
