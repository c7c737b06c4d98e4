"""Files of runs, indexes, checkpoints."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, runs

AT = datetime(2025, 9, 17, 10, 6, 50)


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    assert runs.config(spark, str(path), {"a": 1}) == {"a": 1}
    path.write_text('{"a": 2, "b": "é"}')
    assert runs.config(spark, str(path), {"a": 1, "c": 3}) == {"a": 2, "b": "é", "c": 3}
    path.write_text("[1]")
    with pytest.raises(ValueError):
        runs.config(spark, str(path))


def test_responses_of_both_layouts(spark, tmp_path):
    folder = str(tmp_path / "responses")
    assert runs.latest(spark, folder) is None
    saved = [runs.save(spark, {"mode": "batch", "batch_processing": True, "responses": ["a", "b"]}, folder, AT, "r1"), runs.save(spark, {"responses": ["头"]}, folder, AT, "0001"), runs.save(spark, {}, folder, AT)]
    assert [p.removeprefix(folder) for p in saved] == ["/2025-09-17/responses_batch_20250917_100650.json", "/2025-09-17/responses_0001.json", "/2025-09-17/responses_20250917_100650.json"]
    (tmp_path / "responses" / "responses_zz.json").write_text(json.dumps({"run_id": "头", "timestamp": "t"}))
    (tmp_path / "responses" / "responses_bad.json").write_text("{")
    (tmp_path / "responses" / "other.json").write_text("{}")
    assert runs.latest(spark, folder)["run_id"] == "头"
    got = [(r.run_id, r.mode, r.total_prompts) for r in runs.runs(spark, folder).collect()]
    assert got == [("zz", "realtime", 0), ("batch_20250917_100650", "batch", 2), ("0001", "realtime", 1)]
    assert runs.unescape(spark, folder) == [f"file:{folder}/responses_zz.json"]
    assert "头" in (tmp_path / "responses" / "responses_zz.json").read_text()


def test_delete_run_takes_exactly_one(spark, tmp_path):
    ratings, responses, benchmarks = (str(tmp_path / x) for x in ("ratings", "responses", "benchmarks"))
    for run in ("r1", "r11"):
        (tmp_path / "ratings" / f"run_id={run}").mkdir(parents=True)
        (tmp_path / "ratings" / f"rating_{run}_3.json").write_text("{}")
        for kind, folder in (("responses", responses), ("benchmark", benchmarks)):
            runs.save(spark, {}, folder, AT, run, kind)
    assert len(runs.delete_run(spark, "r1", ratings, responses, benchmarks)) == 4
    assert not any(p.name.endswith(("r1.json", "r1", "r1_3.json")) and "r11" not in p.name for p in tmp_path.rglob("*"))
    assert len([p for p in tmp_path.rglob("*") if "r11" in p.name and not p.name.endswith(".crc")]) == 4
    with pytest.raises(ValueError):
        runs.delete_run(spark, "", ratings, responses, benchmarks)


def test_remove_empty(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f").write_text("x")
    assert [p.rsplit("/", 1)[1] for p in runs.remove_empty(spark, str(tmp_path))] == ["b", "a"]


def test_jobs_and_prompts(spark, tmp_path):
    path = str(tmp_path / "jobs.json")
    assert runs.load_jobs(spark, path) == {}
    runs.save_jobs(spark, {"j1": {"status": "completed", "at": AT, "n": 1}}, path)
    assert runs.load_jobs(spark, path)["j1"] == {"status": "completed", "at": str(AT), "n": 1}
    assert files.jobs(spark, path).first().job["status"] == "completed"
    runs.export_prompts(spark, "sys", ["a", "头"], str(tmp_path / "p.json"))
    system, rows = files.prompts(spark, str(tmp_path / "p.json"))
    assert system == "sys" and [r.prompt for r in rows.orderBy("prompt_index").collect()] == ["a", "头"]


def test_requests_and_mock_table(spark, tmp_path):
    rows = spark.createDataFrame([(k, json.dumps({"k": k})) for k in range(30)], "prompt_index int, line string")
    runs.write_requests(rows, str(tmp_path / "req"))
    lines = [x for p in sorted((tmp_path / "req").glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["k"] for x in lines] == list(range(30))
    (tmp_path / "mock.json").write_text(json.dumps({"q": ["plain", {"text": "rich", "similarity": 0.5, "metadata": {"s": "x"}}], "none": []}))
    got = [(r.query, r.rank, r.text, r.similarity, r.metadata) for r in runs.mock_table(spark, str(tmp_path / "mock.json")).orderBy("rank").collect()]
    assert got == [("q", 1, "plain", None, {}), ("q", 2, "rich", 0.5, {"s": "x"})]


def test_indexes(spark, tmp_path):
    folder = str(tmp_path / "idx")
    runs.save_index(spark.range(3), folder, {"model": "m"})
    runs.save_index(spark.range(5), folder, {"model": "n"})
    index, about = runs.load_index(spark, folder)
    assert index.count() == 5 == about["rows"] and (about["version"], about["model"]) == (1, "n")
    built = []

    def build():
        built.append(1)
        return spark.range(2)

    assert [runs.load_or_build(spark, str(tmp_path / "tags"), build).count() for _ in range(2)] == [2, 2] and len(built) == 1


def test_checkpoints(spark, tmp_path):
    folder = str(tmp_path / "ck")
    assert runs.resumed(spark, folder) == ({}, 0)
    for k in (1, 2):
        runs.checkpoint({"nodes": spark.range(k), "edges": spark.range(2 * k)}, folder, k, AT.replace(second=k))
    tables, chapter = runs.resumed(spark, folder)
    assert chapter == 2 and {n: t.count() for n, t in tables.items()} == {"nodes": 2, "edges": 4}
    assert len(list((tmp_path / "ck").glob("checkpoint_2025*.json"))) == 2


def test_sinks(spark, tmp_path):
    runs.write_book(spark.createDataFrame([("b", 5, ["y"]), ("a", 1, ["x"])], "title string, first_pos int, sections array<string>"), str(tmp_path / "book"))
    assert [json.loads(x)["title"] for p in sorted((tmp_path / "book").glob("part-*")) for x in p.read_text().splitlines()] == ["a", "b"]
    runs.write_categories(spark.createDataFrame([("herb", "z", "e", 0), ("organ", "z", "e", 1)], "category string, name_zh string, name_en string, first_pos int"), str(tmp_path / "tags"))
    assert {p.name for p in (tmp_path / "tags").glob("category=*")} == {"category=herb", "category=organ"}
    results = spark.createDataFrame([(1, "p", "r", 2.0, 3, None)], "case_number int, prompt string, response string, processing_time double, num_chunks_used int, error string")
    runs.write_evaluation(results, results.agg(F.count(F.lit(1)).alias("total_cases")), str(tmp_path), "x")
    assert spark.read.json(str(tmp_path / "benchmark_x")).first().total_cases == 1 and "processing_time" not in spark.read.json(str(tmp_path / "responses_x")).columns
    head = runs.write_batch([{"a": "头"}, {"error": "e"}], spark, str(tmp_path / "batch.json"), AT, mode="test")
    assert head["successful"] == 1 and json.loads((tmp_path / "batch.json").read_text())["results"][0] == {"a": "头"}
