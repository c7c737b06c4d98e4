"""Files in and out: documents, JSON inputs, partitioned result folders and snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import file_name, suffix
from . import formats

#: Suffixes that have an extractor (fixed values), and encodings tried in this order.
SUPPORTED = (".txt", ".docx", ".doc", ".pdf")
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


# --- documents -----------------------------------------------------------------------------------

def extractor_of(path: Column) -> Column:
    """Name of the extractor by suffix, empty if there is none."""
    return F.when(suffix(path).isin(*SUPPORTED), F.substring(suffix(path), 2, 10)).otherwise("")


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def docx_text(content: bytes) -> str:
    """Paragraphs of a .docx file, joined by newlines; nothing if it isn't one."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def word_text(content: bytes) -> str:
    """A .doc file's text; some are .docx files by content."""
    return docx_text(content) if content[:2] == b"PK" else formats.doc_text(content)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".txt": decoded, ".docx": docx_text, ".doc": word_text, ".pdf": formats.pdf_text}


def register_extractor(ending: str, extract: Callable[[bytes], str]) -> None:
    """For more formats, or in place of a reader that is there; a file that a reader fails on has an empty text."""
    EXTRACTORS[ending.lower()] = extract


def any_case(endings: Sequence[str]) -> str:
    """A glob for files with one of the endings, in any case, so that no other file's content is read."""
    letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return f"*{{{','.join(map(letters, endings))}}}"


#: Endings of a book's files, in the order in which they are read (fixed values).
BOOK_ENDINGS = (".txt", ".docx", ".doc")


def book_files(spark: SparkSession, folders: Mapping[str, str], extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(book_id, pos, path, ext, text) of the files of books (book_id -> folder), in the order of their endings and then of
    their paths. Endings are taken as they are written, and a .txt that isn't UTF-8 has an empty text."""
    known = {**EXTRACTORS, ".txt": utf8_only, **(extractors or {})}
    parts = []
    for book, folder in folders.items():
        for rank, ending in enumerate(BOOK_ENDINGS):
            files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder)
            parts.append(files.select(F.lit(book).alias("book_id"), F.lit(rank).alias("rank"), "path", F.lit(ending).alias("ext"), "content"))
    every = reduce(DataFrame.unionByName, parts)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in ("book_id", "rank", "path", "ext")}, "text": [_extracted(known, e, c) for e, c in zip(b.ext, b.content, strict=True)]})

    rows = every.mapInPandas(extract, "book_id string, rank int, path string, ext string, text string")
    order = Window.partitionBy("book_id").orderBy("rank", "path")
    return rows.select("book_id", (F.row_number().over(order) - 1).alias("pos"), "path", "ext", "text")


def utf8_only(content: bytes) -> str:
    return content.decode("utf-8")


def _extracted(known: Mapping[str, Callable[[bytes], str]], ending: str, content: bytes) -> str:
    try:
        return known[ending](content) if ending in known else ""
    except Exception:  # noqa: BLE001  any extractor may fail on any file
        return ""


def documents(spark: SparkSession, folder: str, endings: tuple[str, ...] = SUPPORTED, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, source, ext, size, text) of a folder's own files with these endings, in any case; an extractor that
    fails gives an empty text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", any_case(endings)).load(folder)
    files = files.withColumn("ext", suffix(F.col("path"))).filter(F.col("ext").isin(*endings))
    known = {**EXTRACTORS, **(extractors or {})}

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "ext": b.ext, "size": b.length, "text": [_extracted(known, e, c) for e, c in zip(b.ext, b.content, strict=True)]})

    rows = files.select("path", "ext", "length", "content").mapInPandas(extract, "path string, ext string, size long, text string")
    return rows.select("path", file_name(F.col("path")).alias("source"), "ext", "size", "text")


def stats(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_bytes"))


# --- JSON inputs ---------------------------------------------------------------------------------

def cases(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_index, prompt) of a JSON list of texts, or of an object that has one as `cases` or `prompts`."""
    whole = spark.read.text(path, wholetext=True).select("value")
    lists = [F.from_json("value", "array<string>"), *[F.from_json("value", f"struct<{k}:array<string>>")[k] for k in ("cases", "prompts")]]
    return whole.select(F.posexplode(F.coalesce(*lists)).alias("prompt_index", "prompt"))


def prompts(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """System prompt and (prompt_index, prompt) of an uploaded file; both keys must be there."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<system_prompt:string,prompts:array<string>>").alias("v")).first()
    if row is None or row.v is None or row.v.system_prompt is None or row.v.prompts is None:
        raise InvalidInput("a prompts file needs system_prompt and prompts")
    return row.v.system_prompt, cases(spark, path)


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(pos, chapter_id, section_id, tags) of a tags file; an unreadable one has no rows."""
    kind = "struct<sections:array<struct<chapter_id:string,section_id:string,tags:array<struct<tag_zh:string,tag_en:string>>>>>"
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["sections"]).alias("pos", "s")).select("pos", "s.*")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symptoms, syndromes and edges(syndrome, symptom, pos) of a graph file."""
    node = "id:string,name:string,name_zh:string,name_en:string,description:string"
    kind = f"struct<symptoms:array<struct<{node}>>,syndromes:array<struct<{node},symptoms:array<string>,herbal_treatments:string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("g"))
    symptoms, syndromes = (whole.select(F.posexplode(f"g.{k}").alias("seq", "n")).select("seq", "n.*") for k in ("symptoms", "syndromes"))
    edges = syndromes.select(F.col("id").alias("syndrome"), F.posexplode("symptoms").alias("pos", "symptom")).select("syndrome", "symptom", "pos")
    return symptoms, syndromes.drop("symptoms"), edges


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """One row per job of a registry file {job_id: {...}}, the job's fields as a map of texts."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("job_id", "job"))


# --- results -------------------------------------------------------------------------------------

def write_dated(df: DataFrame, folder: str, stamp: Column, kind: str = "json") -> None:
    """Appends rows to a folder per run date."""
    df.withColumn("run_date", F.date_format(stamp, "yyyy-MM-dd")).write.mode("append").partitionBy("run_date").format(kind).save(folder)


def write_ratings(ratings: DataFrame, folder: str) -> None:
    ratings.write.mode("append").partitionBy("run_id").json(folder)


def read_ratings(spark: SparkSession, folders: list[str], schema: str, run_id: str | None = None) -> DataFrame:
    """Ratings of several layouts, of all runs or of one (only its partitions are read)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.schema(schema).json(f) for f in folders])
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def named(files: DataFrame, prefix: str = "", ending: str = "") -> DataFrame:
    """files(path) whose name begins and ends so."""
    name = file_name(F.col("path"))
    return files.filter(name.startswith(prefix) & name.endswith(ending))


def latest_file(files: DataFrame, by_name: bool = True) -> DataFrame:
    """files(path, modified): the one of the largest name, as the stored names sort by time, or of the latest time."""
    order = file_name(F.col("path")) if by_name else F.struct("modified", "path")
    return files.agg(F.max_by("path", order).alias("path"))


def run_of(path: Column) -> Column:
    """Run id in the name of a responses file."""
    return F.replace(F.replace(file_name(path), F.lit("responses_")), F.lit(".json"))


def snapshot(df: DataFrame, folder: str, version: int) -> None:
    """Writes a version of a table; readers take the latest that is complete (see `restore`)."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a table, in order; none if there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(hadoop.Path(p, "_SUCCESS")))


def restore(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a table, the latest by default."""
    return spark.read.parquet(f"{folder}/version={versions(spark, folder)[-1] if version is None else version}")


def drop_run(rows: DataFrame, run_id: str) -> DataFrame:
    """All rows but those of a run."""
    return rows.filter(~F.col("run_id").eqNullSafe(F.lit(run_id)))
