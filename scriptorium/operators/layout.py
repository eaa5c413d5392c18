"""Paragraphs from the lines of laid-out pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

# Fixed values.
HEADING_LINE, CENTERED, CENTERED_CHARS = "[IVXLC]+", 10, 4

#: Between lines while they are put together: a code point that no text has.
BREAK = "\uffff"


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def paragraph_indents(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, indent): two more than the most common indent of lines with text, the earlier one of equals; 2 without any."""
    rows = lines.where(F.col("line").rlike(r"(?U)\S")).withColumn("_lead", indent_of(F.col("line")))
    counts = rows.groupBy(by, "_lead").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    most = counts.groupBy(by).agg(F.max_by("_lead", F.struct("n", -F.col("first"))).alias("lead"))
    return lines.select(by).distinct().join(most, by, "left").select(by, (F.coalesce("lead", F.lit(0)) + 2).alias("indent"))


def cleaned(lines: DataFrame, heading: str = HEADING_LINE, indent: int | None = None, by: str = "doc_id", first: int | None = None, last: int | None = None) -> DataFrame:
    """``lines(by, pos, line)``, from the ``first`` to the ``last`` where given (counted from 1), to paragraphs (by, paragraph, text, heading_line, heading).

    Heading lines become "Chapter n."; short centred lines and page numbers go;
    a paragraph starts at a heading and where a line is indented enough.  Blank
    lines don't end one.  Words cut by a hyphen at a line's end are put together.
    """
    if first is not None:
        lines = lines.where(F.col("pos") + 1 >= first)
    if last is not None:
        lines = lines.where(F.col("pos") + 1 <= last)
    rows = lines.withColumn("_line", F.regexp_replace(F.regexp_replace("line", "\f", ""), "­", "-"))
    rows = rows.withColumn("_line", F.regexp_replace("_line", r"(?U)\s+$", ""))
    rows = rows.withColumn("_text", F.regexp_replace("_line", r"(?U)^\s+", "")).where("_text <> ''")
    if indent is None:
        # All in the one dealing by page that the paragraphs need too.
        raw, page = indent_of(F.col("line")), Window.partitionBy(by)
        alike = Window.partitionBy(by, "_raw")
        rows = rows.withColumn("_raw", raw).withColumn("_n", F.struct(F.count("*").over(alike).alias("n"), (-F.min("pos").over(alike)).alias("first")))
        rows = rows.withColumn("indent", F.max_by("_raw", "_n").over(page) + 2)
    else:
        rows = rows.withColumn("indent", F.lit(indent))
    rows = rows.withColumn("_lead", indent_of(F.col("_line"))).withColumn("_heading", F.col("_text").rlike(f"^(?:{heading})$"))
    rows = rows.where(F.col("_heading") | ~((F.col("_lead") >= CENTERED) & (F.length("_text") <= CENTERED_CHARS)))
    bare = F.regexp_replace(F.regexp_replace("_text", r" {5,}\d{1,3}(?= |$)", ""), r"^\d{2,3} (?=[a-z])", "")
    w = Window.partitionBy(by).orderBy("pos")
    after_heading = F.coalesce(F.lag("_heading").over(w), F.lit(False))
    rows = rows.withColumn("_starts", F.col("_heading") | after_heading | (F.col("_lead") >= F.col("indent")))
    rows = rows.withColumns({
        "_text": F.when(F.col("_heading"), F.col("_text")).otherwise(bare),
        "_island": F.sum(F.col("_starts").cast("int")).over(w),
        "_number": F.sum(F.col("_heading").cast("int")).over(w),
    })
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda x: x["_text"])

    joined = F.regexp_replace(F.array_join(ordered, BREAK), rf"-{BREAK}(?=\p{{Ll}})", "")

    found = rows.groupBy(by, F.col("_island").alias("paragraph")).agg(
        F.replace(joined, F.lit(BREAK), F.lit(" ")).alias("_joined"), F.bool_or("_heading").alias("_is"), F.min("_number").alias("_number"), F.min("pos").alias("_pos"), F.min("_text").alias("_raw")
    )
    return found.select(
        by, F.col("paragraph").cast("int"), F.when(F.col("_is"), F.format_string("Chapter %d.", "_number")).otherwise(F.regexp_replace("_joined", " {2,}", " ")).alias("text"),
        F.when(F.col("_is"), F.col("_pos")).alias("heading_line"), F.when(F.col("_is"), F.col("_raw")).alias("heading"),
    )


def report(paragraphs: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, headings, n_words): the headings that ``cleaned`` has found, with their lines counted from 1, and the words of all paragraphs."""
    heading = F.when(F.col("heading").isNotNull(), F.struct((F.col("heading_line") + 1).alias("line"), F.col("heading").alias("text")))
    return paragraphs.groupBy(by).agg(F.array_sort(F.collect_list(heading)).alias("headings"), F.sum(word_count(F.col("text"))).alias("n_words"))
