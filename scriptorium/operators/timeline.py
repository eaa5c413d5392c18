"""Running timelines, chapters and chapter metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADING, TITLE_CHARS, first_line, is_heading


def pause_after(text: Column, pause_ms: Column) -> Column:
    """A quarter of the pause after a text that a clause mark ends."""
    return F.when(F.coalesce(text.rlike(r"[,;:\-—]\s*$"), F.lit(False)), F.floor(pause_ms / 4).cast("int")).otherwise(pause_ms)


def gap_after(text: Column, ends_paragraph: Column, pause_ms: Column, paragraph_pause_ms: Column) -> Column:
    own = pause_after(text, pause_ms)
    return F.when(F.coalesce(ends_paragraph, F.lit(False)), F.greatest(paragraph_pause_ms, own)).otherwise(own)


def offsets(chunks: DataFrame, pause_ms: int, paragraph_pause_ms: int | None = None, by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Add start_ms and total_ms to chunks (by, pos, duration_ms, text[, ends_paragraph, extra_pause_ms]).

    The gap after the last chunk of a timeline does not count.  One timeline is
    one group of a window; timelines are spread by their key.
    """
    has = set(chunks.columns)
    ends = F.col("ends_paragraph") if "ends_paragraph" in has else F.lit(False)
    extra = F.coalesce(F.col("extra_pause_ms"), F.lit(0)) if "extra_pause_ms" in has else F.lit(0)
    gap = gap_after(F.col("text"), ends, F.lit(pause_ms), F.lit(pause_ms if paragraph_pause_ms is None else paragraph_pause_ms)) + extra
    w = Window.partitionBy(by).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("duration_ms").cast("long") + F.when(F.lead(pos).over(w).isNotNull(), gap).otherwise(0)
    rows = chunks.withColumn("_step", step)
    return rows.withColumns({
        "start_ms": F.coalesce(F.sum("_step").over(before), F.lit(0)).cast("long"),
        "total_ms": F.sum("_step").over(Window.partitionBy(by)).cast("long"),
    }).drop("_step")


def heading_chapters(timed: DataFrame, heading_text: str = "text", pattern: str = HEADING, by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Chapters (by, start_ms, end_ms, title) where a chunk's first line is a heading other than the one before."""
    line = first_line(F.col(heading_text))
    rows = timed.withColumn("title", F.left(line, F.lit(TITLE_CHARS))).where(is_heading(line, pattern))
    w = Window.partitionBy(by).orderBy(pos)
    rows = rows.withColumn("_before", F.lag("title").over(w)).where(~F.col("title").eqNullSafe(F.col("_before")))
    return spans(rows.select(by, F.col(pos).alias("_pos"), "start_ms", "total_ms", "title"), by)


def spans(starts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Chapters from their starts: each ends where the next begins, the last with the timeline; empty ones go."""
    w = Window.partitionBy(by).orderBy("_pos")
    rows = starts.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("total_ms")))
    return rows.where("end_ms > start_ms").select(by, "start_ms", "end_ms", "title")


def title_chapters(timed: DataFrame, titles: DataFrame, heading_text: str = "text", by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Chapters where given titles begin: each title in order at the first later chunk that opens with it.

    ``titles(by, n, title)``.  A chunk opens with a title if its first line is
    the title or the words it begins with.  A title that never comes is left
    out.  Only chunks that open some title are gathered, per timeline.
    """
    lines = timed.withColumn("_line", first_line(F.col(heading_text))).where("_line <> ''")
    opens = (F.col("_line") == F.col("title")) | F.col("title").startswith(F.concat(F.col("_line"), F.lit(" ")))
    first_word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    left = lines.withColumn("_w", first_word(F.col("_line")))
    right = titles.withColumn("_w", first_word(F.col("title")))
    pairs = left.join(right, [by, "_w"]).where(opens)
    grouped = pairs.groupBy(by, "n", "title").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "start_ms", "total_ms"))).alias("at"))
    in_order = grouped.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "title", "at"))).alias("all"))

    def take(seen: Column, x: Column) -> Column:
        later = F.filter(x["at"], lambda a: a["p"] > seen["p"])
        hit = F.try_element_at(later, F.lit(1))
        row = F.struct(hit["p"].alias("p"), hit["start_ms"].alias("start_ms"), hit["total_ms"].alias("total_ms"), F.left(x["title"], F.lit(TITLE_CHARS)).alias("title"))
        return F.when(F.size(later) > 0, F.struct(hit["p"].cast("long").alias("p"), F.concat(seen["out"], F.array(row)).alias("out"))).otherwise(seen)

    kind = f"array<struct<p:{dict(timed.dtypes)[pos]},start_ms:bigint,total_ms:bigint,title:string>>"
    start = F.struct(F.lit(-1).cast("long").alias("p"), F.array().cast(kind).alias("out"))
    found = in_order.select(by, F.inline(F.aggregate("all", start, take, lambda s: s["out"])))
    return spans(found.withColumnRenamed("p", "_pos"), by)


def metadata_lines(chapters: DataFrame, by: str = "doc_id") -> DataFrame:
    """Chapters as the lines of a metadata file (by, pos, line); marks with a meaning there are escaped."""
    title = F.regexp_replace("title", r"([=;#\\])", r"\\$1")
    lines = F.array(F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), "start_ms"), F.concat(F.lit("END="), "end_ms"), F.concat(F.lit("title="), title))
    rows = chapters.select(by, "start_ms", F.posexplode(lines).alias("k", "line"))
    head = chapters.select(by).distinct().select(by, F.lit(-1).cast("long").alias("start_ms"), F.lit(0).alias("k"), F.lit(";FFMETADATA1").alias("line"))
    w = Window.partitionBy(by).orderBy("start_ms", "k")
    return rows.unionByName(head).select(by, (F.row_number().over(w) - 1).alias("pos"), "line")
