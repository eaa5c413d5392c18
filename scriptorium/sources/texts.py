"""Text files, lexicons, title lists, manifests and job records."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, folded, without_boilerplate
from . import books

TEXT_SUFFIXES = (".txt", ".text", ".md", ".markdown")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, strip_boilerplate: bool = False) -> DataFrame:
    """(path, text) by the file's suffix: text files whole, EPUB by its reading order; other suffixes are refused."""
    suffix = posixpath.splitext(path)[1].lower()
    if suffix in TEXT_SUFFIXES:
        out = read_texts(spark, path)
        return out.withColumn("text", without_boilerplate(F.col("text"))) if strip_boilerplate else out
    if suffix == ".epub":
        return books.read_epubs(spark, path).select("path", "text")
    if suffix == ".pdf":
        return read_pdfs(spark, path)
    raise ValueError(f"unsupported file format {suffix!r}; supported are .pdf, .epub and {', '.join(TEXT_SUFFIXES)}")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Text of PDF pages, blank ones left out, through PyMuPDF where it is installed."""
    try:
        import fitz  # noqa: F401
    except ImportError as error:
        raise ImportError("reading PDF files needs PyMuPDF") from error

    def run(batches):
        import fitz
        import pandas as pd

        for batch in batches:
            texts = []
            for content in batch["content"]:
                with fitz.open(stream=content, filetype="pdf") as pages:
                    texts.append("\n\n".join(t for t in (p.get_text("text") for p in pages) if t.strip()))
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order (path, pos, line); line ends don't count."""
    texts = read_texts(spark, path)
    rows = texts.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    last = Window.partitionBy("path").orderBy(F.desc("pos"))
    return rows.withColumn("_n", F.row_number().over(last)).where("not (_n = 1 and line = '')").drop("_n")


def write_titles(titles: DataFrame, path: str) -> None:
    """``titles(pos, title)`` as lines in order, one file for a book."""
    titles.orderBy("pos").select("title").coalesce(1).write.text(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    rows = read_lines(spark, path).withColumn("title", collapsed(F.col("line"))).where("title <> ''")
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).alias("n"), "title")


def lexicon_rows(lines: DataFrame, by: str = "path") -> DataFrame:
    """Entries (by, term, respelling, bad) of ``lines(by, pos, line)``: ``term = respelling``, the last of equals; bad lines come back as they are.

    Lines that begin with # are comments, a byte order mark is passed over, and
    only the first = counts.
    """
    line = F.trim(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), r"(?U)^\s+|\s+$", ""))
    rows = lines.withColumn("line", line).where("line <> '' and not startswith(line, '#')")
    term, respelling = F.trim(F.substring_index("line", "=", 1)), F.trim(F.regexp_replace("line", "^[^=]*=", ""))
    good = F.contains(F.col("line"), F.lit("=")) & (term != "") & (respelling != "")
    entries = rows.where(good).select(by, F.lower(term).alias("_fold"), term.alias("term"), respelling.alias("respelling"), "pos")
    last = entries.groupBy(by, "_fold").agg(F.max_by("term", "pos").alias("term"), F.max_by("respelling", "pos").alias("respelling"))
    return last.select(by, "term", "respelling", F.lit(None).cast("string").alias("bad")).unionByName(rows.where(~good).select(by, F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("respelling"), F.col("line").alias("bad")))


def read_lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """One book's lexicon (a small file) by folded term."""
    rows = lexicon_rows(read_lines(spark, path)).where("bad is null").select("term", "respelling").collect()
    return {folded(r[0]): r[1] for r in rows}


MANIFEST = (
    "source string, model string, language string, seed bigint, fingerprint string, cache_dir string, sample_rate int, total_chunks int, chunk_pause_ms int, "
    "chunks map<string, struct<status:string,error:string,retries:int,sub_chunks:array<string>,parent:string,seed:bigint,key:string,reused:boolean,"
    "qc:struct<wer:double,ratio:double,attempts:int,verdict:string,error:string>,pause_ms:int,speed:double,ends_paragraph:boolean>>"
)


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs and chunk states of JSON manifests; keys that older ones lack get their defaults."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.from_json("value", MANIFEST).alias("m")).select("run", "m.*")
    runs = whole.drop("chunks").fillna({"seed": 0, "fingerprint": "", "total_chunks": 0})
    states = whole.select("run", F.explode("chunks").alias("chunk_id", "c")).select("run", "chunk_id", "c.*")
    return runs, states.withColumns({"status": F.coalesce("status", F.lit("pending")), "retries": F.coalesce("retries", F.lit(0))})


def write_manifest(runs: DataFrame, states: DataFrame, path: str) -> None:
    """Runs with their chunk states as JSON, a line for each; readers see a whole write or none."""
    fields = [c for c in states.columns if c not in ("run", "chunk_id")]
    chunks = states.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", F.struct(*fields)))).alias("chunks"))
    runs.join(chunks, "run", "left").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


JOB = "id string, pid bigint, title string, state string, model string, created_at string, log string"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records, one JSON file each; those that can't be read are left out."""
    rows = spark.read.schema(JOB + ", _bad string").json(path, mode="PERMISSIVE", multiLine=True, columnNameOfCorruptRecord="_bad")
    return rows.where("_bad is null and id is not null").drop("_bad").withColumn("created_at", F.try_to_timestamp("created_at"))


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Hosts (name, settings) of a JSON object; a missing file has none."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "name string, settings map<string,string>")
    return rows.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("name", "settings"))
