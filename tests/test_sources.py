from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import files as S
from millrace.streaming import incremental as I
from millrace.streaming.windows import tumbling


def test_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.txt").write_text("héllo")
    (tmp_path / "c.md").write_text("not read")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>t</w:t></w:r><w:r><w:t>wo</w:t></w:r></w:p></w:body></w:document>')
    got = {r.source: r.text for r in S.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": "中文", "b.txt": "héllo", "d.docx": "one\ntwo", "e.pdf": ""}
    with_pdf = S.documents(spark, str(tmp_path), (".pdf",), {".pdf": lambda b: b.decode()})
    assert with_pdf.first().text == "%PDF"
    assert {r.ext: r.files for r in S.stats(S.documents(spark, str(tmp_path))).collect()} == {".txt": 2, ".docx": 1, ".pdf": 1}


def test_json_inputs(spark, tmp_path):
    for name, value in (("list", ["a", "b"]), ("cases", {"cases": ["a", "b"]}), ("prompts", {"system_prompt": "s", "prompts": ["a", "b"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert [tuple(r) for r in S.cases(spark, str(tmp_path / f"{name}.json")).collect()] == [(0, "a"), (1, "b")]
    assert S.prompts(spark, str(tmp_path / "prompts.json"))[0] == "s"
    with pytest.raises(ValueError):
        S.prompts(spark, str(tmp_path / "cases.json"))
    (tmp_path / "tags.json").write_text(json.dumps({"sections": [{"chapter_id": "1", "section_id": "2", "tags": [{"tag_zh": "风", "tag_en": "wind"}]}]}))
    assert S.tags(spark, str(tmp_path / "tags.json")).first().tags[0].tag_en == "wind"
    (tmp_path / "bad.json").write_text("nothing")
    assert S.tags(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "jobs.json").write_text(json.dumps({"j": {"status": "failed", "n": 1}}))
    assert S.jobs(spark, str(tmp_path / "jobs.json")).first().job["status"] == "failed"
    (tmp_path / "graph.json").write_text(json.dumps({"symptoms": [{"id": "a", "name": "咳"}], "syndromes": [{"id": "s", "symptoms": ["a", "b"]}]}))
    assert S.graph(spark, str(tmp_path / "graph.json"))[2].count() == 2


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("r1", 5), ("r2", 3)], "run_id string, overall_rating int")
    S.write_ratings(df, str(tmp_path / "ratings"))
    read = S.read_ratings(spark, [str(tmp_path / "ratings")], "overall_rating int, run_id string", "r1")
    assert [r.overall_rating for r in read.collect()] == [5]
    assert S.drop_run(df, "r1").count() == 1
    S.write_dated(df.withColumn("at", F.lit("2024-05-06").cast("timestamp")), str(tmp_path / "dated"), F.col("at"))
    assert (tmp_path / "dated" / "run_date=2024-05-06").exists()


def test_resume(spark, tmp_path):
    inputs = spark.createDataFrame([(c, s) for c in range(3) for s in range(2)], "chapter int, section int")
    calls = []

    def step(df):
        calls.append([r.chapter for r in df.select("chapter").distinct().collect()])
        if len(calls) == 3:
            raise RuntimeError("broken off")
        return df.withColumn("done", F.lit(True))

    folder = str(tmp_path / "snapshots")
    with pytest.raises(RuntimeError):
        I.resumed(spark, inputs, "chapter", step, folder, ["chapter", "section"])
    assert I.resumed(spark, inputs, "chapter", step, folder, ["chapter", "section"]).count() == 6
    assert calls == [[0], [1], [2], [2]]


def test_retry_and_batches(spark):
    slept, left = [], [2]

    def call():
        if left[0]:
            left[0] -= 1
            raise OSError
        return "ok"

    assert I.retried(call, sleep=slept.append) == "ok" and slept == [1.0, 2.0]
    with pytest.raises(KeyError):
        I.retried(lambda: {}["x"], retry=(OSError,), sleep=slept.append)
    rows = spark.range(12).coalesce(1)
    sizes = I.in_batches(rows, lambda p: p.assign(n=len(p))[["n"]], "n long").groupBy("n").count().collect()
    assert {r.n: r["count"] for r in sizes} == {5: 10, 2: 2}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.stream(source, lambda df: df.select("event_id"), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == events.count()
    counts = tumbling(source, "1 hour").writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == events.count()
