from __future__ import annotations

import pytest
from compare import rows
from pyspark.sql import functions as F

from inkwell.operators import corpus
from inkwell.plans.discovery import Models, Settings, discover, report
from inkwell.schemas import INVENTORY
from inkwell.sources import files, sinks
from inkwell.streaming import logs as stream_logs
from inkwell.types import struct_of


def test_text_files(spark, tmp_path):
    root = tmp_path / "books"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("甲乙", "utf-8")
    (root / "bom.txt").write_bytes("﻿甲乙".encode())
    (root / "sub" / "g.txt").write_bytes("第一章 开始 这是一个测试文件。".encode("gb18030"))
    (root / "stray.txt").write_bytes("这是一个测试".encode("gb18030") + b"\xff" + "文件内容".encode("gb18030"))
    (root / "bad.txt").write_bytes(b"\xff" * 5000)
    (root / "._x.txt").write_text("junk")
    (root / ".hidden.txt").write_text("junk")
    found = {r["relative_path"]: r for r in files.text_files(spark, str(root)).collect()}
    assert set(found) == {"a.txt", "bom.txt", "sub/g.txt", "stray.txt", "bad.txt"}
    assert found["bom.txt"]["text"] == "﻿甲乙" and found["bom.txt"]["encoding"] == "utf-8"
    assert found["sub/g.txt"]["encoding"] == "gb18030"
    assert found["stray.txt"]["replacements"] == 1
    assert found["bad.txt"]["text"] is None and found["bad.txt"]["error"]
    made = corpus.inventory(files.text_files(spark, str(root)))
    assert set(made.columns) == set(INVENTORY.names)
    assert {r["file_name"]: r["read_status"] for r in made.collect()}["bad.txt"] == "failed"
    assert files.text_files(spark, str(tmp_path / "missing")).count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"query_id": "a", "query": "x"}\n\nbroken\n{"query_id": "b"}\n')
    schema = struct_of("query_id string, query string")
    assert rows(files.json_lines(spark, str(path), schema)) == [("a", "x"), ("b", None)]
    with pytest.raises(Exception, match="lacks"):
        files.json_lines(spark, str(path), schema, required=("query_id", "query")).collect()


def test_csv_round_trip(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("1", 'a "b", c\nd')], "k string, v string"), str(tmp_path / "c"))
    assert rows(files.csv_rows(spark, str(tmp_path / "c"))) == [("1", 'a "b", c\nd')]


def test_markdown(spark, tmp_path):
    path = tmp_path / "t.md"
    path.write_text("# t\n| id | q | w | u | a | g | s | ok |\n|---|---|---|---|---|---|---|---|\n| e1 | 凡人流 | 修仙、慢热 | — | | x | kw | ✓ |\n| e2 | q | a | b | c | x | kw | |\n")
    assert rows(files.markdown_rows(spark, str(path))) == [("e1", "凡人流", ["修仙", "慢热"], [], [], "x", "kw")]


def test_index_and_reports(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    sinks.save_index(vectors, str(tmp_path / "i"), model="m")
    with pytest.raises(Exception, match="exist"):
        sinks.save_index(vectors, str(tmp_path / "i"), model="m")
    stored, about = files_index(spark, tmp_path)
    assert stored.count() == 1 and about.first()["embedding_dim"] == 2
    for label in ("a", "b", "a"):
        sinks.write_report(spark.createDataFrame([(0.5,)], "agreement double"), str(tmp_path / "r"), label)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def files_index(spark, tmp_path):
    return sinks.load_index(spark, str(tmp_path / "i"))


def models(matcher=None):
    def encoder():
        return lambda texts, role: [[1.0, float(len(t) % 5)] for t in texts]

    return Models(encoder, matcher)


def test_discovery(spark):
    vectors = spark.createDataFrame([(f"n{i}", i, [1.0, i / 3]) for i in range(12)], "novel_id string, row long, embedding array<double>")
    profiles = spark.createDataFrame([(f"n{i}", f"书{i}", f"profile {i}") for i in range(12)], "novel_id string, title_guess string, profile_text string")

    def matcher():
        return lambda prompt: '{"llm_match_score": %s, "confidence": "high", "violated_preferences": []}' % (0.9 if "profile 3" in prompt else 0.1)

    out = discover(spark, "凡人流 不要系统", vectors, profiles, models(matcher), Settings(top_k=4, scored=12))
    found = out.collect()
    assert [r["final_rank"] for r in found] == [1, 2, 3, 4] and found[0]["novel_id"] == "n3"
    assert "书3" in report(out) and report(out, "json").startswith("[")
    plain = discover(spark, "x", vectors, profiles, models(), Settings(top_k=2))
    assert plain.count() == 2
    with pytest.raises(ValueError, match="empty"):
        discover(spark, "  ", vectors, profiles, models())
    with pytest.raises(ValueError, match="missing columns"):
        discover(spark, "x", vectors.drop("row"), profiles, models())


def test_streamed_log(spark, tmp_path):
    source = str(tmp_path / "log")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = stream_logs.counts(stream_logs.read_log(spark, source, schema, "ts"), "ts", "1 day", "event_type")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    total = spark.table("windows").agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(source).count()
