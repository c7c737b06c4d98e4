"""Runs on a file system: configuration, the small JSON files of a run, indexes with their metadata, checkpoints.

Small files (a run's responses, a registry of jobs) are read and written through Hadoop's file system, so they may lie
wherever Spark reads from; tables are written as tables.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import file_name
from .files import restore, run_of, snapshot, versions

KINDS = ("responses", "benchmark")
#: Keys that a prompts file must have (fixed values).
PROMPT_KEYS = ("system_prompt", "prompts")


class Store:
    """Files and folders at paths of any file system that Spark reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.gateway, self.conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def found(self, pattern: str) -> list[str]:
        """Paths that a pattern matches, in order."""
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def children(self, folder: str) -> list[tuple[str, bool]]:
        """(path, whether it is a folder) of what a folder holds; nothing if there is none."""
        fs, p = self._at(folder)
        return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside the path and renames over it in one step: a reader sees the old file or the new one, whenever the writer
        dies."""
        self._renamed(self._beside(path, text), path, "OVERWRITE")

    def write_new(self, path: str, text: str) -> bool:
        """The same, only if nothing is there; whether it was so. Of several writers one finds it so."""
        beside = self._beside(path, text)
        try:
            self._renamed(beside, path, "NONE")
            return True
        except Py4JJavaError as e:
            self.delete(beside)
            if "FileAlreadyExistsException" in str(e.java_exception) or self.exists(path):
                return False
            raise

    def _beside(self, path: str, text: str) -> str:
        beside = f"{path}.{uuid.uuid4().hex}.part"
        fs, p = self._at(beside)
        fs.mkdirs(p.getParent())
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return beside

    def _renamed(self, old: str, new: str, how: str) -> None:
        fs, target = self._at(new)
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), how)
        source, target = (fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(p)) for p in (old, new))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, options)

    def modified(self, path: str) -> float:
        """When a file was last changed, in seconds."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def plain(value: Any) -> Any:
    """What JSON can't hold as its fields, or as text."""
    return value.__dict__ if hasattr(value, "__dict__") else str(value)


def dumped(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=plain)


def config(spark: SparkSession, path: str, defaults: Mapping[str, Any] | None = None) -> dict:
    """A JSON object over defaults; a file that isn't there gives the defaults, one that isn't an object is an error."""
    store = Store(spark)
    found = json.loads(store.read(path)) if store.exists(path) else {}
    if not isinstance(found, dict):
        raise InvalidInput(f"{path} isn't a JSON object")
    return {**(defaults or {}), **found}


# --- responses and benchmarks of a run --------------------------------------------------------------

def file_of(kind: str, run_id: str | None, at: datetime, batch: bool = False) -> str:
    """Name of a run's file: by its id, or by the time for batches and runs without an id."""
    stamp = at.strftime("%Y%m%d_%H%M%S")
    # the forms of file names, here and below, are fixed values
    return f"{kind}_{'batch_' + stamp if batch and run_id else run_id or stamp}.json"


def dated(folder: str, at: datetime) -> str:
    return f"{folder}/{at:%Y-%m-%d}"


def save(spark: SparkSession, data: Mapping[str, Any], folder: str, at: datetime, run_id: str | None = None, kind: str = "responses") -> str:
    """Writes a run's file into the folder of its date; gives the path."""
    path = f"{dated(folder, at)}/{file_of(kind, run_id, at, bool(data.get('batch_processing')))}"
    Store(spark).write(path, dumped(dict(data)))
    return path


def run_files(spark: SparkSession, folder: str, kind: str = "responses") -> list[str]:
    """Files of both layouts: in the folder itself, and in folders by date."""
    store = Store(spark)
    return store.found(f"{folder}/{kind}_*.json") + store.found(f"{folder}/*/{kind}_*.json")


def latest(spark: SparkSession, folder: str, kind: str = "responses") -> dict | None:
    """The content of the file with the largest name, which holds the time; of equal names the one in a dated folder."""
    files = run_files(spark, folder, kind)
    return json.loads(Store(spark).read(max(files, key=lambda p: (p.rsplit("/", 1)[1], p.count("/"), p)))) if files else None


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, path, mode, total_prompts, timestamp) of all responses files under a folder, newest first; a file without
    a mode is of a realtime run, one that isn't JSON has no rows."""
    schema = "struct<mode:string,timestamp:string,responses:array<string>,run_id:string>"
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="responses_*.json").select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("r"))
    rows = whole.filter("r is not null and (r.mode is not null or r.timestamp is not null or r.responses is not null or r.run_id is not null)")
    return rows.select(run_of(F.col("path")).alias("run_id"), "path", F.coalesce("r.mode", F.lit("realtime")).alias("mode"), F.greatest(F.size("r.responses"), F.lit(0)).alias("total_prompts"), F.col("r.timestamp").alias("timestamp")).orderBy(F.desc(file_name(F.col("path"))), "path")


def delete_run(spark: SparkSession, run_id: str, ratings: str, responses: str, benchmarks: str) -> list[str]:
    """Deletes the ratings, responses and benchmarks of exactly this run, in all layouts; gives the paths."""
    if not run_id or "/" in run_id:
        raise InvalidInput("a run needs an id")
    store, name = Store(spark), re.escape(run_id)
    gone = [p for p, _ in store.children(ratings) if re.fullmatch(rf"(run_id=)?{name}|rating_{name}_\d+\.json", p.rsplit("/", 1)[1])]
    for folder, kind in ((responses, "responses"), (benchmarks, "benchmark")):
        gone += [p for p in run_files(spark, folder, kind) if re.fullmatch(rf"{kind}_(batch_)?{name}\.json", p.rsplit("/", 1)[1])]
    for path in gone:
        store.delete(path)
    return gone


def remove_empty(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the folders under this one that hold nothing, the innermost first; gives their paths."""
    store, gone = Store(spark), []
    for path, inner in store.children(folder):
        if inner:
            gone += remove_empty(spark, path)
            if not store.children(path):
                store.delete(path)
                gone.append(path)
    return gone


def unescape(spark: SparkSession, folder: str, kind: str = "responses") -> list[str]:
    """Writes the JSON files of a folder itself again with their characters as they are; one that isn't JSON stays."""
    store, done = Store(spark), []
    for path in store.found(f"{folder}/{kind}_*.json"):
        try:
            value = json.loads(store.read(path))
        except ValueError:
            continue
        store.write(path, dumped(value))
        done.append(path)
    return done


# --- jobs, prompts, requests --------------------------------------------------------------------------

def save_jobs(spark: SparkSession, jobs: Mapping[str, Mapping[str, Any]], path: str) -> None:
    """A registry {job_id: {...}}; values that JSON can't hold are written as their fields or as text."""
    Store(spark).write(path, dumped({k: dict(v) for k, v in jobs.items()}))


def load_jobs(spark: SparkSession, path: str) -> dict[str, dict]:
    """The registry; an unreadable or missing one is empty."""
    store = Store(spark)
    try:
        found = json.loads(store.read(path)) if store.exists(path) else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def export_prompts(spark: SparkSession, system_prompt: str, prompts: Sequence[str], path: str) -> None:
    """A file that `files.prompts` reads."""
    Store(spark).write(path, dumped(dict(zip(PROMPT_KEYS, (system_prompt, list(prompts)), strict=True))))


def write_requests(lines: DataFrame, folder: str, order: str = "prompt_index", column: str = "line") -> None:
    """Request lines as JSONL, in order over the files."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(column).write.mode("overwrite").text(folder)


def mock_table(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, text, similarity, metadata) of a file {query: [chunk, ...]}; a chunk is a text, or an object with
    text, similarity and metadata."""
    item = "struct<text:string,similarity:double,metadata:map<string,string>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query", "chunks"))
    rows = whole.select("query", F.posexplode("chunks").alias("k", "chunk")).withColumn("c", F.when(F.ltrim("chunk").startswith("{"), F.from_json("chunk", item)))
    return rows.select("query", (F.col("k") + 1).alias("rank"), F.coalesce("c.text", "chunk").alias("text"), F.col("c.similarity").alias("similarity"), F.coalesce("c.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


# --- indexes and checkpoints --------------------------------------------------------------------------

def save_index(index: DataFrame, folder: str, metadata: Mapping[str, Any] | None = None) -> dict:
    """A version of an index and, beside it, what is known about it: the number of rows and what the caller adds."""
    spark = index.sparkSession
    known = versions(spark, folder)
    version = known[-1] + 1 if known else 0
    snapshot(index, folder, version)
    about = {"version": version, "rows": restore(spark, folder, version).count(), "columns": index.columns, **(metadata or {})}
    Store(spark).write(f"{folder}/metadata.json", dumped(about))
    return about


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The index that the metadata speaks of, and the metadata; without metadata the latest complete version."""
    store = Store(spark)
    about = json.loads(store.read(f"{folder}/metadata.json")) if store.exists(f"{folder}/metadata.json") else {}
    return restore(spark, folder, about.get("version")), about


def load_or_build(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once, such as the vectors of all tags, and read from then on."""
    if not versions(spark, folder):
        snapshot(build(), folder, 0)
    return restore(spark, folder)


def checkpoint(tables: Mapping[str, DataFrame], folder: str, next_chapter: int, at: datetime) -> None:
    """A version of each table, then the state that names it, as the latest and under its time; a reader of the latest
    state never sees tables that are half written."""
    spark = next(iter(tables.values())).sparkSession
    state: dict[str, Any] = {"next_chapter_idx": next_chapter, "saved_at": at.isoformat(), "versions": {}}
    for name, df in tables.items():
        known = versions(spark, f"{folder}/{name}")
        state["versions"][name] = known[-1] + 1 if known else 0
        snapshot(df, f"{folder}/{name}", state["versions"][name])
    store = Store(spark)
    store.write(f"{folder}/checkpoint_{at:%Y%m%d_%H%M%S}.json", dumped(state))
    store.write(f"{folder}/checkpoint_latest.json", dumped(state))


def resumed(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], int]:
    """The tables of the latest checkpoint and the chapter to go on with; ({}, 0) where there is none. If the latest state is
    missing, can't be read or names tables that aren't whole, that of the newest time that can be used."""
    store = Store(spark)
    for path in [f"{folder}/checkpoint_latest.json", *store.found(f"{folder}/checkpoint_[0-9]*_[0-9]*.json")[::-1]]:
        try:
            state = json.loads(store.read(path)) if store.exists(path) else {}
            if all(v in versions(spark, f"{folder}/{name}") for name, v in state["versions"].items()):
                return {name: restore(spark, f"{folder}/{name}", v) for name, v in state["versions"].items()}, int(state["next_chapter_idx"])
        except (ValueError, KeyError):  # not the JSON of a state
            continue
    return {}, 0


# --- sinks of results ---------------------------------------------------------------------------------

def write_book(chapters: DataFrame, folder: str) -> None:
    """Parsed chapters (title, sections in order), a JSON object each, in the order of the book."""
    chapters.repartitionByRange("first_pos").sortWithinPartitions("first_pos").select("title", "sections").write.mode("overwrite").json(folder)


def write_categories(tags: DataFrame, folder: str) -> None:
    """Flattened tags (category, name_zh, name_en, first_pos), a folder for each category."""
    tags.write.mode("overwrite").partitionBy("category").json(folder)


def write_evaluation(results: DataFrame, summary: DataFrame, folder: str, run_id: str) -> None:
    """The three tables of an evaluation: responses, benchmark (times and counts), and all in one."""
    times = [c for c in ("case_number", "processing_time", "num_chunks_used", "error") if c in results.columns]
    results.drop("processing_time").write.mode("overwrite").json(f"{folder}/responses_{run_id}")
    results.select(times).crossJoin(F.broadcast(summary)).write.mode("overwrite").json(f"{folder}/benchmark_{run_id}")  # summary: one row
    results.write.mode("overwrite").json(f"{folder}/consolidated_{run_id}")


def write_batch(results: Sequence[Mapping[str, Any]], spark: SparkSession, path: str, at: datetime, **about: Any) -> dict:
    """Results of a batch or of a diagnosis run under a header: when, how many, and how many without an error."""
    head = {"timestamp": at.isoformat(), **about, "total": len(results), "successful": sum(not r.get("error") for r in results)}
    Store(spark).write(path, dumped({**head, "results": list(results)}))
    return head
