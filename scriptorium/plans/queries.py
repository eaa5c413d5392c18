"""One query for each operator, over whole tables.

The tables hold no pacing tags, indents, headings and the like, so inputs are
derived from their columns, in the same way here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, loudness, signal, text
from ..operators import clips, layout, metrics, reuse, runs, segment, state, timeline, tree
from ..sources import audio, books, markup

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as chunks; every third one begins with a heading line, every fourth ends in a clause mark."""
    rows = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Chapter "), F.floor(F.col("turn") / 6).cast("int").cast("string"), F.lit("\n"), "text")).otherwise(F.col("text"))
    said = F.when(F.col("turn") % 4 == 1, F.concat(said, F.lit(","))).otherwise(said)
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), said.alias("text"), (F.length("text") * 50).alias("duration_ms"), (F.col("turn") % 2 == 1).alias("ends_paragraph"), (F.col("turn") % 5 * 10).cast("int").alias("extra_pause_ms"))


TURNS = r"""
c AS (SELECT conv_id AS doc_id, turn AS pos, length(text) * 50 AS duration_ms, turn % 2 = 1 AS ends_paragraph, turn % 5 * 10 AS extra_pause_ms,
        (CASE WHEN turn % 3 = 0 THEN 'Chapter ' || CAST(turn // 6 AS VARCHAR) || chr(10) || text ELSE text END) || CASE WHEN turn % 4 = 1 THEN ',' ELSE '' END AS text
      FROM conversations),
g AS (SELECT *, CASE WHEN regexp_matches(text, '[,;:\-—]\s*$') THEN 100 ELSE 400 END AS pause FROM c),
s AS (SELECT *, duration_ms + CASE WHEN lead(pos) OVER w IS NULL THEN 0 ELSE CASE WHEN ends_paragraph THEN greatest(800, pause) ELSE pause END + extra_pause_ms END AS step
      FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, CAST(coalesce(sum(step) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
        CAST(sum(step) OVER (PARTITION BY doc_id) AS BIGINT) AS total_ms FROM s)
"""


@query(f"WITH {TURNS} SELECT doc_id, pos, start_ms, total_ms FROM o")
def timeline_offsets(spark, sf_dir):
    return timeline.offsets(turns(spark, sf_dir), 400, 800).select("doc_id", "pos", "start_ms", "total_ms")


CHAPTERS = rf"""WITH {TURNS},
h AS (SELECT *, trim(regexp_replace(split_part(trim(text, chr(10) || ' '), chr(10), 1), '\s+', ' ', 'g')) AS title FROM o),
k AS (SELECT *, lag(title) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM h
      WHERE title <> '' AND length(title) <= 60 AND regexp_matches(title, '(?i)^\s*(part|book|chapter|section|prologue|epilogue)\b')),
e AS (SELECT doc_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY doc_id ORDER BY pos), total_ms) AS end_ms, title FROM k WHERE title IS DISTINCT FROM before)
SELECT * FROM e WHERE end_ms > start_ms"""


@query(CHAPTERS)
def chapters_timeline(spark, sf_dir):
    return timeline.heading_chapters(timeline.offsets(turns(spark, sf_dir), 400, 800))


@query(rf"""WITH RECURSIVE {TURNS},
f AS (SELECT *, trim(regexp_replace(split_part(trim(text, chr(10) || ' '), chr(10), 1), '\s+', ' ', 'g')) AS line FROM o),
t AS (SELECT doc_id, n, 'Chapter ' || n || ' and more' AS title FROM (SELECT DISTINCT doc_id FROM o), unnest(range(3)) AS u(n)),
m AS (SELECT t.doc_id, n, title, pos, start_ms, total_ms FROM t JOIN f ON f.doc_id = t.doc_id AND line <> '' AND (line = title OR starts_with(title, line || ' '))),
r AS (SELECT doc_id, -1::BIGINT AS n, -1::BIGINT AS pos, false AS hit FROM (SELECT DISTINCT doc_id FROM o)
      UNION ALL SELECT r.doc_id, r.n + 1, coalesce((SELECT min(m.pos) FROM m WHERE m.doc_id = r.doc_id AND m.n = r.n + 1 AND m.pos > r.pos), r.pos),
        EXISTS (SELECT 1 FROM m WHERE m.doc_id = r.doc_id AND m.n = r.n + 1 AND m.pos > r.pos) FROM r WHERE r.n < 2),
e AS (SELECT m.doc_id, m.start_ms, coalesce(lead(m.start_ms) OVER (PARTITION BY m.doc_id ORDER BY m.pos), m.total_ms) AS end_ms, m.title FROM r JOIN m ON r.hit AND m.doc_id = r.doc_id AND m.n = r.n AND m.pos = r.pos)
SELECT * FROM e WHERE end_ms > start_ms""")
def chapters_by_title(spark, sf_dir):
    timed = timeline.offsets(turns(spark, sf_dir), 400, 800)
    titles = timed.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).withColumn("title", F.format_string("Chapter %d and more", "n"))
    return timeline.title_chapters(timed, titles)


@query(rf"""WITH c AS ({CHAPTERS}),
l AS (SELECT doc_id, start_ms, unnest(range(5)) AS k, unnest(['[CHAPTER]', 'TIMEBASE=1/1000', 'START=' || start_ms, 'END=' || end_ms, 'title=' || regexp_replace(title, '([=;#\\])', '\\\1', 'g')]) AS line FROM c
      UNION ALL SELECT DISTINCT doc_id, -1, 0, ';FFMETADATA1' FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, k) - 1 AS INTEGER) AS pos, line FROM l""")
def chapter_metadata(spark, sf_dir):
    return timeline.metadata_lines(chapters_timeline(spark, sf_dir))


def keyed_documents(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reuse.keyed(docs.select("doc_id", "text", F.when(F.col("lang") == "en", 0.85).alias("speed")), "run-1")


KEYED = "k AS (SELECT doc_id, sha1('run-1' || chr(0) || CASE WHEN lang = 'en' THEN '0.85' ELSE 'None' END || chr(0) || text) AS key FROM documents)"


@query(f"WITH {KEYED} SELECT doc_id, key, EXISTS (SELECT 1 FROM k c WHERE c.key = k.key AND c.doc_id % 2 = 0) AS reused FROM k")
def cache_reuse(spark, sf_dir):
    rows = keyed_documents(spark, sf_dir)
    cache = rows.where("doc_id % 2 = 0").select("key").distinct().withColumn("valid", F.lit(True))
    hit = reuse.reusable(rows, cache).withColumn("reused", F.lit(True))
    return hit.unionByName(reuse.to_make(rows, cache).withColumn("reused", F.lit(False))).select("doc_id", "key", "reused")


@query(f"""WITH {KEYED}, o AS (SELECT key, min(doc_id) AS made FROM k WHERE doc_id % 2 = 0 GROUP BY key), n AS (SELECT key, max(doc_id) AS made FROM k WHERE doc_id % 3 = 0 GROUP BY key)
SELECT key, coalesce(n.made, o.made) AS made FROM o FULL JOIN n USING (key) WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 5 = 0)""")
def cache_publish(spark, sf_dir):
    rows = keyed_documents(spark, sf_dir)
    cache = rows.where("doc_id % 2 = 0").groupBy("key").agg(F.min("doc_id").alias("made"))
    new = rows.where("doc_id % 3 = 0").groupBy("key").agg(F.max("doc_id").alias("made"))
    return reuse.published(cache, new, rows.where("doc_id % 5 = 0"))


# CRC-32 from a table of the 256 remainders of its polynomial.
@query("""WITH RECURSIVE z AS (SELECT b, b AS x, 0 AS n FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), n + 1 FROM z WHERE n < 8),
c AS (SELECT list(x ORDER BY b) AS crc FROM z WHERE n = 8),
d AS (SELECT doc_id, list_transform(range(octet_length(encode(text))), lambda i: ('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM documents),
r AS (SELECT doc_id, xor(4294967295, list_reduce(bytes, lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]), 4294967295::BIGINT)) AS sum FROM d, c)
SELECT doc_id, (42 + sum + doc_id % 4 * 2654435761) % 2147483648 AS seed FROM r""")
def chunk_seeds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.chunk_seed(F.lit(42), F.col("text"), (F.col("doc_id") % 4).cast("int")).alias("seed"))


@query("SELECT doc_id, strlen(text) || '-' || sha1(text) AS fingerprint FROM documents")
def file_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.file_fingerprint(F.col("text").cast("binary")).alias("fingerprint"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


@query("""SELECT doc_id, speed, CAST((row_number() OVER (PARTITION BY source, speed ORDER BY length(text), doc_id) - 1) // 8 AS INTEGER) AS batch
FROM (SELECT *, CASE WHEN lang = 'en' THEN 0.85 END AS speed FROM documents)""")
def length_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("doc_id").alias("pos"), F.when(F.col("lang") == "en", 0.85).alias("speed"))
    return state.batches(docs, 8, "source").select("doc_id", "speed", "batch")


def order_state(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("split")
    return orders.select(F.col("o_custkey").alias("doc_id"), F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "_0").otherwise("")).alias("chunk_id"), status.alias("status"))


@query("""SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 7 <> 0) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed,
count(*) FILTER (o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 = 0) AS failed, count(*) FILTER (o_orderstatus = 'O') AS pending,
count(*) FILTER (o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 <> 0) AS split FROM orders GROUP BY 1""")
def progress_summary(spark, sf_dir):
    return state.progress(order_state(spark, sf_dir))


@query("""WITH r AS (SELECT user_id AS book, strftime(ts, '%Y-%m-%d-%H%M') AS stamp, CASE WHEN event_id % 4 = 0 THEN event_id % 40 + 2 ELSE 1 END AS serial, event_type AS tag,
  event_id % 3 = 0 AS finished, CASE WHEN event_id % 5 > 0 THEN 's' || (event_id % 2) END AS source FROM events)
SELECT book, tag, stamp || CASE WHEN serial > 1 THEN '.' || serial ELSE '' END || '-' || tag AS name FROM r
WHERE NOT finished AND (source IS NULL OR source = 's1') QUALIFY row_number() OVER (PARTITION BY book, tag ORDER BY stamp DESC, serial DESC) = 1""")
def run_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.date_format("ts", "yyyy-MM-dd-HHmm"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("."), (F.col("event_id") % 40 + 2).cast("string"))).otherwise(""), F.lit("-"), "event_type")
    source = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string"), F.lit(" ")))
    rows = e.select(F.col("user_id").alias("book"), name.alias("name"), (F.col("event_id") % 3 == 0).alias("finished"), source.alias("source"), F.lit("s1").alias("wanted_source"))
    return runs.resumable(rows).select("book", "tag", "name")


# A row of the table of edit distances at a time, as Spark's side has it.
@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(strip_accents(lower(replace(replace(text, '-', ' '), '—', ' '))), '[\p{M}\p{P}\p{S}]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS a, w AS b FROM t),
n AS (SELECT *, list_transform(b, lambda x: list_position(b, x)::BIGINT) AS v, list_transform(a, lambda x: [coalesce(list_position(b, x), 0)::BIGINT]) AS u FROM p WHERE a IS NOT NULL),
d AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, list_reduce(u, lambda row, x: list_transform(range(1, len(v) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k:
        j - k + CASE WHEN k = 1 THEN row[1] + 1 ELSE least(row[k] + 1, row[k - 1] + CASE WHEN v[k - 1] = x[1] THEN 0 ELSE 1 END) END))), range(len(v) + 1)) AS last FROM n)
SELECT conv_id, turn, CASE WHEN na > 0 THEN last[-1] / na WHEN nb = 0 THEN 0.0 ELSE 1.0 END AS wer FROM d""")
def wer_turns(spark, sf_dir):
    """The error rate of each whole turn against the one before."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("b"))
    rows = rows.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a is not null")
    return rows.select("conv_id", "turn", metrics.long_error_rate(F.col("a"), F.col("b")).alias("wer"))


JUDGED = """m AS (SELECT lang, doc_id, (n_chars % 40) / 100.0::DOUBLE AS wer, 0.5::DOUBLE + (doc_id % 13) / 10.0::DOUBLE AS ratio, length(text) / 20.0::DOUBLE AS expected FROM documents),
s AS (SELECT lang, ratio, expected FROM m UNION ALL SELECT d.lang, 1.5::DOUBLE, 9.0::DOUBLE FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1),
q AS (SELECT lang, CASE WHEN count(*) >= 5 THEN median(ratio) END AS median FROM s WHERE expected >= 4 GROUP BY lang),
v AS (SELECT m.lang, m.doc_id, q.median, m.wer, CASE WHEN m.wer <= 0.25 AND (m.expected < 4 OR coalesce(m.ratio / CASE WHEN q.median <> 0 THEN least(greatest(q.median, 0.6), 1.6) END, m.ratio) BETWEEN 0.6 AND 1.6) THEN 'pass' ELSE 'fail' END AS verdict
  FROM m LEFT JOIN q USING (lang))"""


def judged_documents(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = docs.select("lang", F.col("doc_id").alias("chunk_id"), ((F.col("n_chars") % 40) / 100.0).alias("wer"), (0.5 + (F.col("doc_id") % 13) / 10.0).alias("ratio"), metrics.expected_seconds(F.col("text"), F.lit(1.0)).alias("expected"))
    stored = labels.where("quality = 1").join(docs.select("doc_id", "lang"), "doc_id").select("lang", F.lit(1.5).alias("ratio"), F.lit(9.0).alias("expected"))
    return state.judged(measured, stored, "lang")


@query(f"WITH {JUDGED} SELECT doc_id, median, verdict FROM v")
def qc_verdict(spark, sf_dir):
    return judged_documents(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), "median", "verdict")


@query(f"""WITH {JUDGED}, t AS (SELECT lang, CASE WHEN verdict = 'pass' THEN 'passed' WHEN doc_id % 4 < 2 THEN 'retry' WHEN doc_id % 3 < 2 AND doc_id % 5 > 1 THEN 'split' ELSE 'gave_up' END AS step FROM v)
SELECT lang, count(*) AS checked, count(*) FILTER (step IN ('retry', 'split')) AS flipped, count(*) FILTER (step = 'gave_up') AS gave_up FROM t GROUP BY lang""")
def qc_round(spark, sf_dir):
    rows = judged_documents(spark, sf_dir)
    step = state.transition(F.col("verdict"), F.col("chunk_id") % 4, F.col("chunk_id") % 3, F.col("chunk_id") % 5, 2, 2)
    return state.counters(rows.select("lang", step.alias("step")), "lang")


def page_lines(spark, sf_dir) -> DataFrame:
    """Documents' lines as a laid-out page: indents, roman headings, page numbers and cut words by place."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    k = (F.col("doc_id") + F.col("pos")) % 11
    line = F.when(k == 0, F.lit("XIV")).when(k == 1, F.lit("            12")).when(k == 2, F.concat(F.lit("      "), "line")).when(k == 3, F.concat("line", F.lit("-"))).when(k == 4, F.concat(F.lit("12 "), F.lower("line"))).when(k == 5, F.lit("  ")).otherwise(F.concat(F.lit(" "), "line"))
    return rows.select("doc_id", "pos", line.alias("line"))


PAGE = r"""l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM l0),
p AS (SELECT doc_id, pos, CASE (doc_id + pos) % 11 WHEN 0 THEN 'XIV' WHEN 1 THEN '            12' WHEN 2 THEN '      ' || line WHEN 3 THEN line || '-' WHEN 4 THEN '12 ' || lower(line) WHEN 5 THEN '  ' ELSE ' ' || line END AS line FROM l1),
i AS (SELECT doc_id, length(line) - length(ltrim(line)) AS lead, count(*) AS n, min(pos) AS first FROM p WHERE trim(line) <> '' GROUP BY 1, 2),
ind AS (SELECT doc_id, lead + 2 AS indent FROM i QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
indents AS (SELECT DISTINCT p.doc_id, coalesce(indent, 2) AS indent FROM p LEFT JOIN ind USING (doc_id))"""


@query(f"WITH {PAGE} SELECT * FROM indents")
def indent_mode(spark, sf_dir):
    return layout.paragraph_indents(page_lines(spark, sf_dir))


ISLANDS = rf"""r AS (SELECT p.doc_id, pos, indent, trim(line) AS t, length(line) - length(ltrim(line)) AS lead, regexp_full_match(trim(line), '[IVXLC]+') AS h FROM p JOIN indents USING (doc_id) WHERE trim(line) <> ''),
k AS (SELECT * FROM r WHERE h OR NOT (lead >= 10 AND length(t) <= 4)),
s AS (SELECT *, h OR coalesce(lag(h) OVER w, false) OR lead >= indent AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(starts::INT) OVER w AS paragraph, sum(h::INT) OVER w AS number,
        regexp_replace(regexp_replace(t, ' {{5,}}\d{{1,3}}( |$)', '\1', 'g'), '^\d{{2,3}} ([a-z])', '\1') AS bare FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
j AS (SELECT doc_id, paragraph, bool_or(h) AS h, min(number) AS number, string_agg(bare, chr(1) ORDER BY pos) AS joined FROM n GROUP BY 1, 2),
x AS (SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CASE WHEN h THEN 'Chapter ' || number || '.' ELSE regexp_replace(replace(regexp_replace(joined, '-' || chr(1) || '(\p{{Ll}})', '\1', 'g'), chr(1), ' '), ' {{2,}}', ' ', 'g') END AS text, h FROM j)"""


@query(f"WITH {PAGE}, {ISLANDS} SELECT doc_id, paragraph, text FROM x")
def paragraph_islands(spark, sf_dir):
    return layout.cleaned(page_lines(spark, sf_dir)).select("doc_id", "paragraph", "text")


@query(rf"""WITH {PAGE.replace("FROM l1)", "FROM l1 WHERE pos BETWEEN 2 AND 39)")}, {ISLANDS}
SELECT doc_id, count(*) FILTER (h) AS n_headings, CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words FROM x GROUP BY 1""")
def page_report(spark, sf_dir):
    """Lines 3 to 40 of each page: headings found, and words kept."""
    found = layout.report(layout.cleaned(page_lines(spark, sf_dir), first=3, last=40))
    return found.select("doc_id", F.size("headings").cast("long").alias("n_headings"), "n_words")


@query(r"""WITH l AS (SELECT user_id AS doc_id, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN (event_id % 997) / 10.0::DOUBLE END AS s, CASE WHEN event_id % 3 <> 0 THEN (event_id % 991) / 10.0::DOUBLE END AS e FROM events),
f AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS start, last_value(CASE WHEN s IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS opened FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, start, e AS "end" FROM f WHERE e IS NOT NULL AND start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, opened ORDER BY pos) = 1""")
def silence_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[x] silence_start: "), ((F.col("event_id") % 997) / 10.0).cast("string"))).otherwise(F.concat(F.lit("silence_end: "), ((F.col("event_id") % 991) / 10.0).cast("string"), F.lit(" | d")))
    return clips.silences(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), line.alias("line")))


@query("""WITH q AS (SELECT user_id AS doc_id, event_id / 10.0::DOUBLE AS start, event_id / 10.0::DOUBLE + 0.5 AS "end" FROM events),
t AS (SELECT user_id AS doc_id, CASE WHEN user_id % 9 = 0 THEN 8.0::DOUBLE ELSE max(event_id) / 10.0::DOUBLE + 61 END AS total FROM events GROUP BY user_id),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") AS n FROM (SELECT * FROM q UNION ALL SELECT doc_id, 0.0, 0.0 FROM t UNION ALL SELECT doc_id, total, total FROM t)),
b AS (SELECT a.doc_id, a."end" AS x, c.start AS y FROM e a JOIN e c ON a.doc_id = c.doc_id AND c.start - a."end" BETWEEN 3 AND 10 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(c.start - a."end" - 7), a.n, c.n) = 1),
d AS (SELECT doc_id, arg_min("end", start) AS lead FROM q WHERE start < 1 GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN total <= 10 THEN 0.0 WHEN x IS NOT NULL THEN x ELSE coalesce(lead, 0.0) END AS "from", CASE WHEN total <= 10 THEN total WHEN x IS NOT NULL THEN y ELSE least(coalesce(lead, 0.0) + 10, total) END AS "to"
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN d USING (doc_id)""")
def clip_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    quiet = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") / 10.0).alias("start"), (F.col("event_id") / 10.0 + 0.5).alias("end"))
    totals = e.groupBy(F.col("user_id").alias("doc_id")).agg((F.max("event_id") / 10.0 + 61).alias("total")).withColumn("total", F.when(F.col("doc_id") % 9 == 0, 8.0).otherwise(F.col("total")))
    return clips.clip_windows(quiet, totals)


def line_tree(spark, sf_dir) -> DataFrame:
    """Order lines as a tree of chunks split once or twice."""
    ids = F.element_at(F.array(*map(F.lit, ("0", "0_0", "0_1", "0_1_0", "0_1_1", "1", "2"))), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber between 1 and 7").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("r"))
    status = F.when(F.col("l_linenumber").isin(1, 3), "split").otherwise("completed")
    return rows.select(F.col("l_orderkey").alias("doc_id"), ids.alias("chunk_id"), F.when(F.col("q") > 25, F.col("q") / 50).alias("speed"), F.col("q").cast("int").alias("pause_ms"), (F.col("r") == "R").alias("ends_paragraph"), status.alias("status"))


TREE = """l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_quantity) AS q, max(l_returnflag) AS r FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY 1, 2),
c AS (SELECT doc_id, ['0', '0_0', '0_1', '0_1_0', '0_1_1', '1', '2'][n] AS chunk_id, CASE WHEN q > 25 THEN q / 50 END AS speed, CAST(q AS INTEGER) AS pause_ms, r = 'R' AS ends_paragraph, CASE WHEN n IN (1, 3) THEN 'split' ELSE 'completed' END AS status FROM l),
u AS (SELECT *, CASE WHEN contains(chunk_id, '_') THEN regexp_replace(chunk_id, '_[^_]*$', '') END AS up FROM c),
z AS (SELECT *, up IS NULL OR row_number() OVER (PARTITION BY doc_id, up ORDER BY chunk_id DESC) = 1 AS is_last FROM u)"""


@query(f"""WITH RECURSIVE {TREE},
w AS (SELECT doc_id, chunk_id, chunk_id AS node, 0 AS steps, true AS reaches FROM z
      UNION ALL SELECT w.doc_id, w.chunk_id, z.up, steps + 1, reaches AND z.is_last FROM w JOIN z ON z.doc_id = w.doc_id AND z.chunk_id = w.node WHERE z.up IS NOT NULL)
SELECT w.doc_id, w.chunk_id, arg_min(z.speed, steps) FILTER (z.speed IS NOT NULL) AS own_speed, CAST(coalesce(sum(z.pause_ms) FILTER (reaches), 0) AS INTEGER) AS extra_pause_ms, bool_or(reaches AND z.ends_paragraph) AS paragraph_end
FROM w JOIN z ON z.doc_id = w.doc_id AND z.chunk_id = w.node GROUP BY 1, 2""")
def tree_attrs(spark, sf_dir):
    return tree.with_inherited(line_tree(spark, sf_dir)).select("doc_id", "chunk_id", "own_speed", "extra_pause_ms", "paragraph_end")


@query(f"""WITH {TREE}, o AS (SELECT doc_id, chunk_id FROM c WHERE status = 'completed' AND (NOT contains(chunk_id, '_') OR EXISTS (SELECT 1 FROM c p WHERE p.doc_id = c.doc_id AND p.chunk_id = '0'))
  AND (NOT starts_with(chunk_id, '0_1_') OR EXISTS (SELECT 1 FROM c p WHERE p.doc_id = c.doc_id AND p.chunk_id = '0_1')))
SELECT doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS INTEGER) AS pos FROM o""")
def leaf_order(spark, sf_dir):
    return tree.leaves_in_order(line_tree(spark, sf_dir)).select("doc_id", "chunk_id", F.col("pos").cast("int").alias("pos"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, i // 4 AS frame, round(sqrt(sum(v::DOUBLE * v::DOUBLE) / 4), 6) AS level FROM x GROUP BY 1, 2""")
def frame_rms(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.posexplode(signal.frame_levels(F.col("embedding"), F.lit(400))).alias("frame", "level")).select("vec_id", F.col("frame").cast("long"), F.round("level", 6).alias("level"))


@query("""WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE * CASE WHEN unnest(range(len(embedding))) BETWEEN 20 AND 30 THEN 1 ELSE 0.0001 END AS v, unnest(range(len(embedding))) AS i FROM embeddings),
f AS (SELECT vec_id, n, i // 4 AS k, sqrt(sum(v * v) / 4) AS level FROM x GROUP BY 1, 2, 3),
t AS (SELECT *, max(level) OVER (PARTITION BY vec_id) AS top FROM f),
e AS (SELECT vec_id, n, min(k) FILTER (level > greatest(top * 0.01, least(pow(10, -2.5), top * 0.1))) AS a, max(k) FILTER (level > greatest(top * 0.01, least(pow(10, -2.5), top * 0.1))) AS b FROM t GROUP BY 1, 2)
SELECT vec_id, CASE WHEN a IS NULL THEN 16 ELSE least((b + 1) * 4 + 16, n) - greatest(a * 4 - 16, 0) END AS kept FROM e""")
def trim_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    shaped = F.transform("embedding", lambda x, i: x.cast("double") * F.when(i.between(20, 30), 1.0).otherwise(0.0001))
    return rows.select("vec_id", F.size(signal.trimmed(shaped, F.lit(400))).cast("long").alias("kept"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '!{4,}', '!!!', 'g'), '[ \t]+', ' ', 'g'), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS clean
FROM (SELECT doc_id, replace(replace(text, '. ', '!!!!!' || chr(7) || '  ' || chr(9)), chr(10), chr(13) || chr(10) || chr(10) || chr(10)) AS t FROM documents)""")
def normalize_basic(spark, sf_dir):
    raw = F.replace(F.replace("text", F.lit(". "), F.lit("!!!!!\x07  \t")), F.lit("\n"), F.lit("\r\n\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.tidy_layout(text.short_mark_runs(text.without_control(raw))).alias("clean"))


@query(r"""SELECT doc_id, trim(text, ' ' || chr(10)) || chr(10) AS body FROM documents""")
def boilerplate_strip(spark, sf_dir):
    framed = F.concat(F.lit("Title\n*** START OF THIS PROJECT GUTENBERG EBOOK X ***\n"), "text", F.lit("\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\nlicense"))
    return table(spark, sf_dir, "documents").select("doc_id", text.without_boilerplate(framed).alias("body"))


@query()
def number_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.spoken_text(F.col("text"), F.col("lang")).alias("spoken"))


@query()
def lexicon_replace(spark, sf_dir):
    respell = text.with_lexicon({"the": "thee", "die": "dee", "straße": "strasse"})
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(respell(F.col("text")).cast("binary")).alias("sha1"))


SENTENCES = r"""w AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS x FROM documents)),
v AS (SELECT *, rtrim(raw, ' ' || chr(10) || chr(9) || chr(13)) AS t, regexp_replace(ltrim(rtrim(raw, ' ' || chr(10) || chr(9) || chr(13)), '"«''('), '\.+$', '') AS bare FROM w),
b AS (SELECT *, lag(t) OVER d AS last, lag(bare) OVER d AS last_bare, lag(t, 2) OVER d AS earlier, lag(bare, 2) OVER d AS earlier_bare, regexp_extract(t, '^["«''(—-]?\+?(.)', 1) AS head FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT string_split('mr mrs ms dr prof st jr sr vs etc e.g i.e a.m p.m vol ch fig т.е т.д т.п г гг ул проф', ' ') AS abbreviations),
c AS (SELECT *, regexp_matches(last, '[.!?…]$') AND regexp_matches(head, '[\p{L}\p{Nl}\p{No}]') AND NOT regexp_matches(head, '[a-zа-яё]')
        AND NOT (ends_with(last, '.') AND (list_contains(abbreviations, lower(last_bare)) OR (regexp_full_match(last_bare, '[A-ZА-ЯЁ]') AND ends_with(t, '.') AND regexp_full_match(bare, '[A-ZА-ЯЁ]')))) AS opens,
        i > 1 AND ends_with(last, '.') AND (list_contains(abbreviations, lower(regexp_replace(ltrim(earlier || last, '"«''('), '\.+$', '')))
          OR (regexp_full_match(last_bare, '[A-ZА-ЯЁ]') AND ends_with(earlier, '.') AND regexp_full_match(earlier_bare, '[A-ZА-ЯЁ]'))) AS tied FROM b, a),
s AS (SELECT doc_id, i, raw, i = 0 OR last_value(CASE WHEN i = 0 THEN 1 WHEN NOT opens THEN 0 WHEN NOT tied THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) = 1 AS starts FROM c),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM s)"""


# A start that two words before could tie to them is one only if the word before is one: the last word that decides is looked for.
@query(f"""WITH {SENTENCES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, rtrim(string_agg(raw, '' ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS sentence FROM g GROUP BY 1, 2""")
def sentences(spark, sf_dir):
    return segment.sentence_rows(table(spark, sf_dir, "documents"))


@query()
def chunks(spark, sf_dir):
    return segment.chunked(table(spark, sf_dir, "documents"), 300)


@query(rf"""WITH {SENTENCES},
t AS (SELECT doc_id, pos, rtrim(string_agg(raw, '' ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS sentence, max(pos) OVER (PARTITION BY doc_id) + 1 AS n FROM g GROUP BY 1, 2),
h AS (SELECT doc_id, (pos >= n // 2)::INT AS k, string_agg(sentence, ' ' ORDER BY pos) AS text FROM t WHERE n > 1 GROUP BY 1, 2),
o AS (SELECT doc_id, sentence AS x, length(sentence[1 : length(sentence) // 2]) - strpos(reverse(sentence[1 : length(sentence) // 2]), ' ') AS cut, strpos(reverse(sentence[1 : length(sentence) // 2]), ' ') > 0 AS there FROM t WHERE n = 1),
p AS (SELECT doc_id, unnest([0, 1]) AS k, unnest([trim(x[1 : cut]), trim(x[cut + 1 : length(x)])]) AS text FROM o WHERE there AND cut > 0)
SELECT doc_id::VARCHAR AS chunk_id, doc_id || '_' || k AS sub_id, text FROM (SELECT * FROM h UNION ALL SELECT * FROM p)""")
def retry_pieces(spark, sf_dir):
    return segment.retry_pieces(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"))


@query(r"""WITH r AS (SELECT doc_id, replace(replace(text, '. ', '. [pause 800ms] '), chr(10), chr(10) || '[slow]') AS t FROM documents),
h AS (SELECT doc_id, 0 AS part, CASE WHEN contains(t, '[slow]') THEN t[1 : strpos(t, '[slow]') - 1] ELSE t END AS x FROM r UNION ALL SELECT doc_id, 1, t[strpos(t, '[slow]') + 6 : length(t)] FROM r WHERE contains(t, '[slow]')),
p AS (SELECT doc_id, part, len(string_split(x, '[pause 800ms]')) AS n, unnest(string_split(x, '[pause 800ms]')) AS text, unnest(range(len(string_split(x, '[pause 800ms]')))) AS i FROM h),
m AS (SELECT *, CASE WHEN i < n - 1 THEN 800 ELSE 0 END AS ms, NOT regexp_full_match(text, '\s*') AS said FROM p),
g AS (SELECT *, sum(said::INT) OVER (PARTITION BY doc_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) AS seg FROM m)
SELECT doc_id, CAST(seg - 1 AS INTEGER) AS pos, any_value(text) FILTER (said) AS text, any_value(CASE WHEN part = 1 THEN 0.85::DOUBLE END) FILTER (said) AS speed, CAST(least(sum(ms), 10000) AS INTEGER) AS pause_ms FROM g WHERE seg > 0 GROUP BY 1, 2""")
def paced_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit(". "), F.lit(". [pause 800ms] ")), F.lit("\n"), F.lit("\n[slow]")).alias("text"))
    return segment.segmented(rows)


@query()
def html_blocks(spark, sf_dir):
    return markup.blocks(table(spark, sf_dir, "pages"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'v' || c_custkey END AS voice, CASE WHEN c_custkey % 3 = 0 THEN 'kani' ELSE 'omni' END AS model, CASE WHEN c_custkey % 5 = 0 THEN 'de-DE' WHEN c_custkey % 2 = 0 THEN 'en-GB' ELSE 'RU' END AS lang, c_mktsegment AS instruct FROM customer),
s AS (SELECT *, CASE WHEN voice IS NOT NULL THEN 'sample:' || voice WHEN model = 'omni' AND regexp_extract(lower(lang), '^[^-_]*') IN ('en', 'ru') THEN 'designed:0:' || sha1(instruct || lang) END AS source FROM c)
SELECT c_custkey, source, CASE WHEN source IS NULL THEN 'none' WHEN c_custkey % 7 > 1 AND c_custkey % 11 > 0 AND (CASE WHEN c_custkey % 6 > 0 THEN source END) IS NOT DISTINCT FROM source THEN 'reuse' WHEN starts_with(source, 'designed:') THEN 'design' ELSE 'clone' END AS plan FROM s""")
def narrator_plans(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 4 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("voice"), F.when(k % 3 == 0, "kani").otherwise("omni").alias("model"), F.when(k % 5 == 0, "de-DE").when(k % 2 == 0, "en-GB").otherwise("RU").alias("lang"), "c_mktsegment")
    rows = rows.withColumn("source", identity.requested_narrator(F.col("voice"), F.col("model"), F.col("lang"), F.lit("0"), F.col("c_mktsegment")))
    return rows.select(k, "source", identity.narrator_plan(F.col("source"), k % 7 > 1, k % 11 == 0, F.when(k % 6 > 0, F.col("source"))).alias("plan"))


@query("""WITH m AS (SELECT p_partkey, -14.0::DOUBLE - p_size / 10.0::DOUBLE AS i, -4.0::DOUBLE + (p_partkey % 30) / 10.0::DOUBLE AS tp, CASE WHEN p_partkey % 2 = 0 THEN 'default' ELSE 'acx' END AS preset FROM part),
p AS (SELECT * FROM (VALUES ('default', -18.0::DOUBLE, -2.0::DOUBLE, 2.0::DOUBLE, false), ('acx', -19.0::DOUBLE, -3.0::DOUBLE, 1.0::DOUBLE, true)) v(preset, lufs, peak, tol, enforce))
SELECT p_partkey, abs(i - lufs) > tol OR (enforce AND tp > peak) AS off_target, NOT enforce AND tp > peak AS peak_warning, least(greatest(-18.5::DOUBLE + lufs - i, lufs), lufs + tol) AS target FROM m JOIN p USING (preset)""")
def loudness_check(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, (-14.0 - F.col("p_size") / 10.0).alias("i"), (-4.0 + (k % 30) / 10.0).alias("tp"), F.when(k % 2 == 0, "default").otherwise("acx").alias("preset"))
    given = F.broadcast(loudness.presets(spark))  # two rows
    rows = rows.join(given.select("preset", F.struct("lufs", "true_peak", "range", "tolerance", "enforce_peak").alias("p")), "preset")
    return rows.select(k, loudness.needs_normalizing(F.col("i"), F.col("tp"), F.col("p")).alias("off_target"), loudness.peak_warning(F.col("tp"), F.col("p")).alias("peak_warning"), loudness.raised_target(F.lit(-18.5), F.col("i"), F.col("p")).alias("target"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'unknown model' WHEN s_suppkey % 8 = 0 THEN 'unknown format' WHEN s_suppkey % 6 NOT BETWEEN 1 AND 4 THEN 'workers must be 1 to 4' WHEN s_suppkey % 7 = 0 THEN 'bad language' END AS error FROM supplier""")
def option_errors(spark, sf_dir):
    k = F.col("s_suppkey")
    error = runs.option_error(F.when(k % 9 == 0, "none").otherwise("omni"), F.when(k % 8 == 0, "ogg").otherwise("mp3"), (k % 6).cast("double"), F.when(k % 7 == 0, "e!").otherwise("en-US"), F.lit(""))
    return table(spark, sf_dir, "supplier").select(k, error.alias("error"))


def page_books(spark, sf_dir) -> DataFrame:
    """EPUB files of up to eight pages each: a cover, a short unlisted page, and parts in falling order, of which the even ones are listed."""
    import io
    import zipfile

    import pandas as pd

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(k=rows.page_id % 8).sort_values("k", ascending=False)
        order = sorted(rows.k.tolist(), key=lambda k: (k != 0, k != 7, -k))
        page = lambda k, url: f'<html xmlns:epub="e"><body epub:type="{"cover" if k == 0 else "bodymatter"}"><p>{url}</p></body></html>'
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
            items = "".join(f'<item id="i{k}" href="k{k}.xhtml"/>' for k in rows.k)
            z.writestr("p.opf", f'<package><manifest><item id="n" href="nav.xhtml" properties="nav"/>{items}</manifest><spine>{"".join(f"""<itemref idref="i{k}"/>""" for k in order)}</spine></package>')
            z.writestr("nav.xhtml", f'<html xmlns:epub="e"><nav epub:type="toc">{"".join(f"""<a href="k{k}.xhtml">Part&nbsp;{k}</a>""" for k in rows.k if k % 2 == 0 and k > 0)}</nav></html>')
            for k, url in zip(rows.k, rows.url):
                z.writestr(f"k{k}.xhtml", page(k, url))
        return pd.DataFrame({"path": [str(rows.page_id.iloc[0] // 8)], "content": [held.getvalue()]})

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.floor(F.col("page_id") / 8).alias("book"))
    return pages.groupBy("book").applyInPandas(lambda rows: made(rows), "path string, content binary")


@query(r"""WITH p AS (SELECT page_id // 8 AS book, page_id % 8 AS k, url FROM pages),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY k <> 0, k <> 7, k DESC) - 1 AS INTEGER) AS pos FROM p),
f AS (SELECT *, min(pos) FILTER (k % 2 = 0 AND k > 0) OVER (PARTITION BY book) AS first, bool_or(k % 2 = 0 AND k > 0) OVER (PARTITION BY book) AS lists FROM o)
SELECT book::VARCHAR AS path, pos, CASE WHEN k % 2 = 0 THEN 'Part ' || k || chr(10) || chr(10) ELSE '' END || url AS text, CASE WHEN k % 2 = 0 THEN 'Part ' || k ELSE '' END AS titles
FROM f WHERE k > 0 AND NOT (lists AND (first IS NULL OR pos < first))""")
def epub_sections(spark, sf_dir):
    found = books.sections(books.parts(page_books(spark, sf_dir)))
    return found.select("path", "pos", "text", F.array_join("titles", "|").alias("titles"))


def chunk_state(spark, sf_dir) -> DataFrame:
    """Orders as chunks of their customers, with a status, retries and a speaker's seed."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    values = {
        "doc_id": F.col("o_custkey"), "chunk_id": key.cast("string"), "text": F.col("o_orderpriority"), "retries": key % 3, "error": F.when(key % 5 == 0, "old"), "seed": key * 7,
        "status": F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed"),
        "qc": F.struct((key % 10 / 10).alias("wer"), F.lit(1.0).alias("ratio"), F.lit(0).alias("attempts"), F.when(key % 2 == 0, "pass").alias("verdict"), F.lit(None).alias("error")),
    }
    fields = [f.split(" ", 1) for f in state.STATE.split(", ")]
    return orders.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END"


@query(f"""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS k, {STATUS} AS status FROM orders),
n AS (SELECT *, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'completed' ELSE 'failed' END END AS new FROM s)
SELECT doc_id, k::VARCHAR AS chunk_id, CASE WHEN new = 'completed' AND k % 3 <> 0 THEN 'pending' WHEN new IS NOT NULL THEN new WHEN status = 'completed' AND k % 3 <> 0 THEN 'pending' ELSE status END AS status,
  CASE WHEN new = 'failed' THEN 'boom' WHEN new = 'completed' THEN NULL WHEN k % 5 = 0 THEN 'old' END AS error, CAST(k % 3 + CASE WHEN new = 'failed' THEN 1 ELSE 0 END AS INTEGER) AS retries,
  CASE WHEN new IS NOT NULL THEN 1 ELSE k * 7 END AS seed, CASE WHEN new IS DISTINCT FROM 'completed' AND k % 2 = 0 THEN 'pass' END AS verdict FROM n""")
def state_updates(spark, sf_dir):
    """A round's changes, then completed chunks without audio (two of three) pending again."""
    chunks, k = chunk_state(spark, sf_dir), F.col("chunk_id").cast("long")
    new = F.when(k % 8 == 0, "completed").otherwise("failed")
    changes = chunks.where(k % 4 == 0).select("doc_id", "chunk_id", new.alias("new_status"), F.when(new == "failed", "boom").alias("new_error"), F.lit(1).cast("long").alias("new_seed"))
    after = state.reset_invalid(state.updated(chunks, changes), chunks.where(k % 3 == 0).select("doc_id", "chunk_id"))
    return after.select("doc_id", "chunk_id", "status", "error", "retries", "seed", "qc.verdict")


@query(f"""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey::VARCHAR AS chunk_id, o_orderpriority AS text, {STATUS} AS status, o_orderkey % 3 AS retries FROM orders)
SELECT doc_id, chunk_id, NULL::VARCHAR AS parent_id, CASE WHEN status = 'failed' AND contains(text, ' ') THEN 'split' ELSE status END AS status, text, CAST(retries AS INTEGER) AS retries FROM s
UNION ALL SELECT doc_id, chunk_id || '_' || k, chunk_id, 'pending', piece, 0 FROM (SELECT *, unnest(range(2)) AS k, unnest([split_part(text, ' ', 1), split_part(text, ' ', 2)]) AS piece FROM s WHERE status = 'failed' AND contains(text, ' '))""")
def state_pieces(spark, sf_dir):
    """Failed chunks split at the space of their text, as far as they have one."""
    chunks = chunk_state(spark, sf_dir)
    failed = state.with_status("failed", chunks).where(F.instr("text", " ") > 0)
    pieces = failed.select("doc_id", "chunk_id", F.posexplode(F.split("text", " ", 2)).alias("n", "text"))
    pieces = pieces.select("doc_id", "chunk_id", F.concat_ws("_", "chunk_id", F.col("n").cast("string")).alias("sub_id"), "text")
    return state.with_pieces(chunks, pieces).select("doc_id", "chunk_id", "parent_id", "status", "text", "retries")


@query(f"""WITH {KEYED}, c AS (SELECT key, min(doc_id) AS first FROM k WHERE doc_id % 3 = 0 GROUP BY key)
SELECT doc_id, CASE WHEN first % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN first % 2 = 0 THEN true END AS reused,
  CASE WHEN first % 2 = 0 AND first % 4 = 0 THEN 2 ELSE 0 END AS retries, CASE WHEN first % 2 = 0 AND first % 4 = 0 THEN 0.25::DOUBLE END AS wer FROM k LEFT JOIN c USING (key)""")
def cache_restore(spark, sf_dir):
    rows = keyed_documents(spark, sf_dir)
    own = rows.select(F.col("doc_id"), F.col("doc_id").cast("int").alias("pos"), "text", F.lit(0).alias("pause_ms"), "speed", F.lit(True).alias("ends_paragraph"))
    chunks = state.initial(own).drop("key").join(rows.select("doc_id", "key"), "doc_id")
    first = F.col("first")
    cache = rows.where("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("first")).select("key", (first % 2 == 0).alias("valid"), F.when(first % 4 == 0, 0.25).alias("wer"), F.lit(1.0).alias("ratio"), F.lit(2).alias("attempts"))
    return reuse.restored(chunks, cache).select("doc_id", "status", "reused", "retries", "qc.wer")


@query("""WITH r AS (SELECT user_id AS book, strftime(ts, '%Y-%m-%d-%H00') AS stamp, event_id % 4 + 1 AS serial, event_type AS tag FROM events WHERE event_id % 5 > 0),
w AS (SELECT DISTINCT user_id AS book, strftime(ts, '%Y-%m-%d-%H00') AS stamp, event_type AS tag FROM events),
s AS (SELECT *, (SELECT min(n) FROM (SELECT unnest(range(1, 7)) AS n) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.book = w.book AND r.stamp = w.stamp AND r.tag = w.tag AND r.serial = n)) AS n FROM w)
SELECT book, stamp, tag, stamp || CASE WHEN n > 1 THEN '.' || n ELSE '' END || '-' || tag AS name FROM s""")
def free_run_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.date_format("ts", "yyyy-MM-dd-HH'00'").alias("stamp"), F.col("event_type").alias("tag"), "event_id")
    serial = F.col("event_id") % 4 + 1
    taken = e.where("event_id % 5 > 0").select("book", F.concat("stamp", F.when(serial > 1, F.concat(F.lit("."), serial.cast("string"))).otherwise(""), F.lit("-"), "tag").alias("name"))
    return runs.free_names(taken, e.select("book", "stamp", "tag").distinct())


@query("""SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 3 > 0 THEN 'succeeded' WHEN user_id % 4 = 0 THEN 'running' WHEN event_id % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS state,
  CASE WHEN event_id % 3 = 0 AND (user_id % 4 = 0 OR event_id % 2 = 1) THEN 'at ' || event_type END AS log, event_id % 3 > 0 OR (user_id % 4 > 0 AND event_id % 2 = 0) AS downloadable FROM events""")
def job_states(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    jobs = e.select(k.cast("string").alias("id"), F.col("user_id").alias("pid"), F.when(k % 3 > 0, "succeeded").otherwise("running").alias("state"), F.col("ts").cast("string").alias("created_at"), F.concat(F.lit("at /srv/"), "event_type").alias("log"))
    alive = e.where("user_id % 4 = 0").select(F.col("user_id").alias("pid")).distinct()
    outputs = e.where("event_id % 2 = 0").select(k.cast("string").alias("id"))
    return runs.job_views(runs.settled_jobs(jobs, alive, outputs), "/srv/").select("id", "state", "log", "downloadable")


@query("""WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT *, abs(v) <= 0.1::FLOAT::DOUBLE AS quiet, max(CASE WHEN abs(v) > 0.1::FLOAT::DOUBLE THEN i END) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS loud FROM x)
SELECT vec_id, count(*) FILTER (loud IS NULL OR i - loud <= 1) AS kept FROM q GROUP BY 1""")
def silence_capped(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.size(signal.capped_silence(F.col("embedding"), F.lit(100), F.lit(0.1).cast("float"), 10)).cast("long").alias("kept"))


@query("""WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS v FROM embeddings)
SELECT vec_id, n AS frames, CAST(round(n * 1000.0 / 8000) AS BIGINT) AS duration_ms, true AS valid, sum(trunc(v * 32767::FLOAT)::BIGINT) AS total FROM x GROUP BY 1, 2""")
def wav_files(spark, sf_dir):
    """Vectors as WAV files: what their headers say, and the sum of the samples read back."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", audio.wav_file(signal.to_pcm16(F.col("embedding")), F.lit(8000)).alias("content"))
    read = rows.select("vec_id", audio.wav_facts("content").alias("f"), F.transform(audio.wav_samples("content"), lambda x: F.round(x.cast("double") * 32767).cast("long")).alias("s"))
    return read.select("vec_id", "f.frames", "f.duration_ms", "f.valid", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'TTS_SIZE=' || p_size || ',' ELSE '' END || 'TTS_BRAND=' || p_brand AS handed_on FROM part""")
def environment_forwarded(spark, sf_dir):
    size = F.when(F.col("p_size") % 2 == 0, "TTS_SIZE").otherwise("OTHER_SIZE")
    environment = F.create_map(size, F.col("p_size").cast("string"), F.lit("HOME"), F.col("p_name"), F.lit("TTS_BRAND"), F.col("p_brand"))
    named = F.transform(F.map_entries(runs.forwarded(environment, "TTS_", "GPU_")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(named, ",").alias("handed_on"))
