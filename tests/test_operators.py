"""Operators on small tables whose results can be told by hand."""

import io
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import identity, loudness, signal, text
from scriptorium.operators import clips, engines, layout, metrics, reuse, runs, segment, state, timeline, tree
from scriptorium.sources import audio, books, markup, texts


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_offsets(spark):
    schema = "doc_id long, pos int, duration_ms int, text string, ends_paragraph boolean, extra_pause_ms int"
    chunks = spark.createDataFrame([(1, 0, 1000, "cut here,", False, 0), (1, 1, 1000, "end.", True, 800), (1, 2, 500, None, False, 0)], schema)
    timed = timeline.offsets(chunks, 400, 800).orderBy("pos")
    assert [(r.start_ms, r.total_ms) for r in timed.collect()] == [(0, 4200), (1100, 4200), (3700, 4200)]


def test_chapters(spark):
    timed = spark.createDataFrame([(1, i, s, 100, t) for i, (s, t) in enumerate([(0, "Chapter 1\nx"), (10, "said"), (20, "Chapter  1"), (30, "PART two"), (30, "Epilogue"), (99, "The End")])], "doc_id int, pos int, start_ms long, total_ms long, text string")
    assert sorted(rows(timeline.heading_chapters(timed))) == [(1, 0, 30, "Chapter 1"), (1, 30, 100, "Epilogue")]
    titles = spark.createDataFrame([(1, 0, "Chapter 1 and all"), (1, 1, "Nowhere"), (1, 2, "Chapter 1"), (1, 3, "The End")], "doc_id int, n int, title string")
    assert sorted(rows(timeline.title_chapters(timed, titles))) == [(1, 0, 20, "Chapter 1 and all"), (1, 20, 99, "Chapter 1"), (1, 99, 100, "The End")]
    lines = timeline.metadata_lines(spark.createDataFrame([(1, 0, 5, "a=b;c")], "doc_id int, start_ms long, end_ms long, title string")).orderBy("pos")
    assert [r.line for r in lines.collect()] == [";FFMETADATA1", "[CHAPTER]", "TIMEBASE=1/1000", "START=0", "END=5", r"title=a\=b\;c"]


def test_tree(spark):
    schema = "doc_id int, chunk_id string, speed double, pause_ms int, ends_paragraph boolean, status string"
    chunks = spark.createDataFrame([(1, "0", 0.85, 800, True, "split"), (1, "0_0", None, None, None, "split"), (1, "0_0_0", None, 5, False, "completed"), (1, "0_0_1", None, None, None, "completed"), (1, "0_1", None, None, None, "completed"), (1, "1", None, 100, False, "completed"), (1, "10", None, None, None, "completed"), (1, "2", None, None, None, "pending")], schema)
    found = {r.chunk_id: (r.own_speed, r.extra_pause_ms, r.paragraph_end) for r in tree.with_inherited(chunks).collect()}
    assert found["0_0_0"] == (0.85, 5, False) and found["0_1"] == (0.85, 800, True) and found["0_0_1"] == (0.85, 0, False) and found["1"] == (None, 100, False)
    assert [r.chunk_id for r in tree.leaves_in_order(chunks).orderBy("pos").collect()] == ["0_0_0", "0_0_1", "0_1", "1", "10"]


def test_state(spark):
    docs = spark.createDataFrame([(1, "One is here. Two is there."), (1, "Three.")], "doc_id long, text string")
    chunks = docs.select("doc_id", F.monotonically_increasing_id().cast("int").alias("pos"), "text", F.lit(0).alias("pause_ms"), F.lit(None).cast("double").alias("speed"), F.lit(True).alias("ends_paragraph"))
    start = state.initial(chunks.withColumn("pos", F.when(F.col("text") == "Three.", 1).otherwise(0)))
    assert {r.status for r in start.collect()} == {"pending"} and start.where("pause_ms is not null").count() == 0
    changes = spark.createDataFrame([(1, "0", "failed", "boom", None), (1, "1", "completed", None, 7)], "doc_id long, chunk_id string, new_status string, new_error string, new_seed long")
    after = state.updated(start, changes)
    assert {(r.chunk_id, r.status, r.error, r.retries, r.seed) for r in after.collect()} == {("0", "failed", "boom", 1, None), ("1", "completed", None, 0, 7)}
    pieces = segment.retry_pieces(state.with_status("failed", after)).withColumn("doc_id", F.lit(1).cast("long"))
    split = state.with_pieces(after, pieces)
    assert {(r.chunk_id, r.status, r.parent_id) for r in split.collect()} == {("0", "split", None), ("1", "completed", None), ("0_0", "pending", "0"), ("0_1", "pending", "0")}
    assert rows(state.progress(split)) == [(1, 2, 1, 0, 2, 1)]
    assert state.unchecked(split).count() == 1
    assert state.reset_invalid(split, spark.createDataFrame([], "doc_id long, chunk_id string")).where("status = 'completed'").count() == 0


def test_batches(spark):
    chunks = spark.createDataFrame([(1, i, "x" * (9 - i), [0.85, None][i % 2]) for i in range(4)], "doc_id int, pos int, text string, speed double")
    found = state.batches(chunks, 1).collect()
    assert {(r.pos, r.batch) for r in found} == {(2, 0), (0, 1), (3, 0), (1, 1)}
    assert [one(spark, state.batch_width(F.lit(g), F.lit(True))) for g in (1, 2, 6, 12)] == [1, 2, 4, 8]


@pytest.mark.parametrize("a, b, wer", [("a b c d", "a b d", 0.25), ("", "", 0.0), ("", "x", 1.0), ("при+вет мир", "привет мир", 0.0), ("你好", "你们", 0.5), ("well-known", "well known", 0.0), ("Café!", "cafe", 0.0), ("a", "b c", 2.0)])
def test_error_rate(spark, a, b, wer):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    split = df.withColumns({"x": metrics.tokens("a"), "y": metrics.tokens("b")})
    assert split.select(metrics.error_rate(F.col("x"), F.col("y"))).first()[0] == pytest.approx(wer)
    assert df.select(metrics.long_error_rate("a", "b")).first()[0] == pytest.approx(wer)


def test_spoken_error_rate(spark):
    cases = [("В 25 раз", "в 25-го раз", "ru", 0.0), ("In 1905.", "in nineteen oh five", "en", 0.0), ("21 men", "twenty-one cats", "en", 1 / 3), (None, "x", "en", 1.0), ("21", "21", None, 0.0)]
    df = spark.createDataFrame([c[:3] for c in cases], "a string, b string, lang string")
    assert [r[0] for r in df.select(metrics.spoken_error_rate("a", "b", "lang")).collect()] == pytest.approx([c[3] for c in cases])


@pytest.mark.parametrize("wer, ratio, expected, median, result", [(0.1, 9.0, 3.9, None, "pass"), (0.3, 1.0, 9.0, None, "fail"), (0.1, 2.0, 9.0, None, "fail"), (0.1, 2.0, 9.0, 1.5, "pass"), (0.1, 3.0, 9.0, 3.0, "fail"), (0.1, 1.0, 9.0, 3.0, "pass"), (0.1, 2.0, 9.0, 0.0, "fail"), (0.25, 1.6, 9.0, None, "pass")])
def test_verdict(spark, wer, ratio, expected, median, result):
    assert one(spark, metrics.verdict(F.lit(wer), F.lit(ratio), F.lit(expected), F.lit(median).cast("double"))) == result


def test_seed_and_key(spark):
    import hashlib

    for base, attempt in ((0, 0), (1 << 40, 7)):
        assert one(spark, identity.chunk_seed(F.lit(base), F.lit("Привет"), F.lit(attempt))) == (base + zlib.crc32("Привет".encode()) + attempt * 2654435761) % 2**31
    for speed in (None, 0.85, 1.0):
        assert one(spark, identity.chunk_key(F.lit("f"), F.lit(speed).cast("double"), F.lit("t"))) == hashlib.sha1(f"f\0{speed}\0t".encode()).hexdigest()


def test_reuse(spark):
    docs = spark.createDataFrame([(1, "0", "A"), (1, "1", "B"), (1, "2", "A")], "doc_id long, chunk_id string, text string").withColumn("speed", F.lit(None).cast("double"))
    keyed = reuse.keyed(docs, "f")
    cache = keyed.where("text = 'A'").select("key").distinct().selectExpr("key", "true as valid", "0.1d as wer", "1.2d as ratio", "2 as attempts")
    assert {r.chunk_id for r in reuse.reusable(keyed, cache).collect()} == {"0", "2"} and [r.chunk_id for r in reuse.to_make(keyed, cache).collect()] == ["1"]
    full = state.initial(docs.selectExpr("doc_id", "cast(chunk_id as int) as pos", "text", "0 as pause_ms", "speed", "true as ends_paragraph")).drop("key").join(keyed.select("chunk_id", "key"), "chunk_id")
    back = {r.chunk_id: r for r in reuse.restored(full, cache).collect()}
    assert back["0"].status == "completed" and back["0"].retries == 2 and back["0"].qc.wer == 0.1 and back["0"].qc.verdict is None and back["1"].status == "pending"
    assert reuse.published(cache, cache.withColumn("wer", F.lit(0.5))).first().wer == 0.5 and reuse.published(cache, cache, cache).count() == 0


def test_layout(spark):
    page = ["   II", "  It was a long lo-", " ne road     12", "", " and then­", "             17", "    New one", " 12 begins here-", " There."]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(page)], "doc_id int, pos int, line string")
    assert layout.paragraph_indents(lines).first().indent == 3
    found = layout.cleaned(lines, indent=4).orderBy("paragraph").collect()
    assert [r.text for r in found] == ["Chapter 1.", "It was a long lone road and then-", "New one begins here- There."]
    assert (found[0].heading_line, found[0].heading) == (0, "II")
    part = layout.cleaned(lines, indent=4, first=2, last=5)
    assert [r.text for r in part.collect()] == ["It was a long lone road and then-"] and layout.report(part).first()[1:] == ([], 8)
    assert layout.report(layout.cleaned(lines, indent=4)).first().headings[0].asDict() == {"line": 1, "text": "II"}


def test_clips(spark):
    log = spark.createDataFrame([(1, i, x) for i, x in enumerate(["silence_start: 0.5", "silence_end: 1.0 | d", "silence_end: 9", "silence_start: 4", "silence_start: 7.5", "silence_end: 8"])], "doc_id int, pos int, line string")
    assert sorted(rows(clips.silences(log))) == [(1, 0.5, 1.0), (1, 7.5, 8.0)]
    totals = spark.createDataFrame([(1, 30.0), (2, 9.0), (3, 40.0)], "doc_id int, total double")
    quiet = clips.silences(log).unionAll(spark.createDataFrame([(3, 0.2, 0.4)], "doc_id int, start double, end double"))
    assert sorted(rows(clips.clip_windows(quiet, totals))) == [(1, 1.0, 7.5) if abs(6.5 - 7) < abs(7.5 - 7) else (1, 0.0, 7.5), (2, 0.0, 9.0), (3, 0.4, 10.4)]


def test_signal(spark):
    rate = 24000
    tone = (0.5 * np.sin(np.arange(rate // 5) / 20)).astype(np.float32)
    given = np.concatenate([np.zeros(rate // 2, np.float32), tone, np.zeros(rate, np.float32), tone, np.zeros(rate // 3, np.float32)])
    df = spark.createDataFrame([(given.tolist(),), ([],), ([0.0] * 5000,)], "x array<float>")
    sizes = [r[0] for r in df.select(F.size(signal.trimmed(F.col("x"), F.lit(rate)))).collect()]
    frame, margin = rate // 100, rate * 40 // 1000
    levels = np.sqrt((np.pad(given, (0, -len(given) % frame)).reshape(-1, frame) ** 2).mean(1))
    loud = np.flatnonzero(levels > max(levels.max() * 0.01, min(10**-2.5, levels.max() * 0.1)))
    assert sizes == [min((loud[-1] + 1) * frame + margin, len(given)) - max(loud[0] * frame - margin, 0), 0, margin]
    short = spark.createDataFrame([([0.0, 1.0] + [0.0] * 9 + [1.0],)], "x array<float>")
    assert len(short.select(signal.capped_silence(F.col("x"), F.lit(10), F.lit(0.1)).alias("y")).first().y) == 6
    assert one(spark, signal.to_pcm16(F.array(F.lit(0.5), F.lit(-0.5)))) == [16383, -16383]
    assert len(one(spark, signal.joined(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0))), F.lit(1000), 5))) == 7


def test_wavs(spark, tmp_path):
    held = io.BytesIO()
    with wave.open(held, "wb") as f:
        f.setparams((1, 2, 24000, 0, "NONE", "none"))
        f.writeframes(np.arange(2400, dtype="<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(held.getvalue())
    (tmp_path / "b.wav").write_bytes(held.getvalue()[:-10])
    (tmp_path / "c.wav").write_bytes(b"nothing")
    found = {r.path[-5:]: (r.duration_ms, r.valid) for r in audio.read_wavs(spark, str(tmp_path)).collect()}
    assert found == {"a.wav": (100, True), "b.wav": (100, False), "c.wav": (None, False)}
    again = spark.createDataFrame([([1, 2, 3], 8000)], "s array<short>, r int").select(audio.wav_file("s", "r").alias("c"))
    assert again.select(audio.wav_samples("c").alias("x")).first().x == pytest.approx([1 / 32767, 2 / 32767, 3 / 32767])


def test_blocks(spark):
    html = "<head><title>t</title></head><body><h2>One <b>two</b></h2>text<p>a &amp; b<script>x</script></p><ul><li><a href='#x'>in</a></li><li><a href='http://e.com'>out</a></li></ul></body>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert [tuple(r)[1:] for r in markup.blocks(df).orderBy("pos").collect()] == [(0, "h2", "One two"), (1, "p", "text"), (2, "p", "a & b"), (3, "li", "out")]


def book(**more):
    page = lambda body, kind="": f'<html xmlns:epub="e"><body epub:type="{kind}">{body}</body></html>'
    entries = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
        "OPS/p.opf": '<package><metadata><meta name="cover" content="c"/></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c" href="c.png"/><item id="two" href="t%20wo.xhtml"/><item id="one" href="one.xhtml"/><item id="cv" href="cv.xhtml"/><item id="pre" href="pre.xhtml"/><item id="gone" href="gone.xhtml"/></manifest>'
        '<spine><itemref idref="cv"/><itemref idref="pre"/><itemref idref="one"/><itemref idref="gone"/><itemref idref="two"/></spine></package>',
        "OPS/nav.xhtml": '<html xmlns:epub="e"><nav epub:type="toc"><a href="one.xhtml">First&nbsp;part</a><a href="t%20wo.xhtml#s">x</a></nav></html>',
        "OPS/cv.xhtml": page("<p>cover</p>", "cover"), "OPS/pre.xhtml": page("<p>short preface</p>"),
        "OPS/one.xhtml": page("<p>Hello.</p>"), "OPS/t wo.xhtml": page("<h1>Second</h1><p>World.</p>"), "OPS/c.png": b"\x89PNG\r\n\x1a\nrest",
    } | more
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return held.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(b"no zip")
    found = {r.path[-6:]: r for r in books.read_epubs(spark, str(tmp_path)).collect()}
    assert found["a.epub"].text == "First part\n\nHello.\n\nSecond\n\nWorld." and found["a.epub"].titles == ["First part", "Second"]
    assert found["b.epub"].text is None and "not a valid EPUB" in found["b.epub"].error
    cover = books.read_covers(spark, str(tmp_path)).collect()
    assert [(c.extension, bytes(c.content)[:4]) for c in cover] == [(".png", b"\x89PNG")]
    parts = books.parts(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert [r.file for r in books.missing(parts).collect()] == ["OPS/gone.xhtml"]
    assert books.decoded("é".encode("utf-16")) == "é" and books.decoded(b"<?xml encoding='latin-1'?>\xe9").endswith("é") and books.decoded(b"charset=nonsense x").endswith("x")


def test_text_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("﻿# note\nDr = Doctor\nbad line\nNew York = NY = city\ndr = Doc\n", encoding="utf-8")
    assert texts.read_lexicon(spark, str(tmp_path / "l.txt")) == {"dr": "Doc", "new york": "NY = city"}
    assert [r.bad for r in texts.lexicon_rows(texts.read_lines(spark, str(tmp_path / "l.txt"))).where("bad is not null").collect()] == ["bad line"]
    (tmp_path / "t.txt").write_text("One  two\n\n Three \n")
    assert [r.title for r in texts.read_titles(spark, str(tmp_path / "t.txt")).orderBy("n").collect()] == ["One two", "Three"]
    (tmp_path / "m.json").write_text('{"model": "omni", "total_chunks": 2, "chunks": {"0": {"status": "completed", "qc": {"wer": 0.1}}, "1": {}}}')
    run, chunks = texts.read_manifests(spark, str(tmp_path / "m.json"))
    assert run.first().seed == 0 and run.first().fingerprint == "" and {(r.chunk_id, r.status, r.retries) for r in chunks.collect()} == {("0", "completed", 0), ("1", "pending", 0)}
    texts.write_manifest(run, chunks, str(tmp_path / "out"))
    assert texts.read_manifests(spark, str(tmp_path / "out"))[1].count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"id": "a", "pid": 1, "state": "running", "created_at": "2024-01-02T03:04:05Z"}')
    (tmp_path / "j/b.json").write_text("{broken")
    assert [r.id for r in texts.read_jobs(spark, str(tmp_path / "j")).collect()] == ["a"]
    assert texts.read_hosts(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        texts.read_documents(spark, "x.docx")
    (tmp_path / "g.txt").write_text("Head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nBody.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail")
    assert texts.read_documents(spark, str(tmp_path / "g.txt"), True).first().text == "Body.\n"


def test_runs(spark):
    names = [("b", "2024-01-01-0900-omni", False, None), ("b", "2024-01-01-0900.2-omni", False, None), ("b", "2024-01-01-0900.10-omni", False, "s"), ("b", "2024-01-02-0900-omni", True, None), ("b", "other", False, None)]
    df = spark.createDataFrame(names, "book string, name string, finished boolean, source string").withColumn("wanted_source", F.lit("s"))
    assert [r.name for r in runs.newest_first(df).collect()][:2] == ["2024-01-02-0900-omni", "2024-01-01-0900.10-omni"]
    assert runs.resumable(df).first().name == "2024-01-01-0900.10-omni" and runs.resumable(df.withColumn("wanted_source", F.lit("t"))).first().name == "2024-01-01-0900.2-omni"
    wanted = spark.createDataFrame([("b", "2024-01-01-0900", "omni"), ("b", "2024-01-03-0900", "omni")], "book string, stamp string, tag string")
    assert {r.name for r in runs.free_names(df, wanted).collect()} == {"2024-01-01-0900.3-omni", "2024-01-03-0900-omni"}
    assert [one(spark, runs.inside(F.lit(p))) for p in ("a/b", "a/../b", "../x", "a/../../b", "/x")] == [True, True, False, False, False]
    jobs = spark.createDataFrame([("1", 10, "running", "2", "log /p/x"), ("2", 11, "running", "1", ""), ("3", 12, "running", "3", "")], "id string, pid long, state string, created_at string, log string")
    settled = runs.settled_jobs(jobs, spark.createDataFrame([(10,)], "pid long"), spark.createDataFrame([("2",)], "id string"))
    assert [(r.id, r.state) for r in settled.collect()] == [("3", "failed"), ("1", "running"), ("2", "succeeded")]
    assert {(r.id, r.log, r.downloadable) for r in runs.job_views(settled, "/p/").collect()} == {("1", "log x", False), ("2", None, True), ("3", "", False)}
    assert one(spark, runs.upload_limit_mb(F.lit("250"))) == 250 and one(spark, runs.upload_limit_mb(F.lit("0"))) == 100


def test_narrators_and_loudness(spark):
    ask = lambda voice, model, language: one(spark, identity.requested_narrator(F.lit(voice).cast("string"), F.lit(model), F.lit(language), F.lit("0"), F.lit("warm")))
    assert ask("abc", "kani", "en") == "sample:abc" and ask(None, "kani", "en") is None and ask(None, "omni", "en-US").startswith("designed:0:") and ask(None, "omni", "de") is None
    log = 'noise {"x": 1}\n{\n"input_i" : "-23.1", "input_tp" : "-5.0", "input_lra" : "3.0", "input_thresh" : "-33.0"\n}\n'
    assert one(spark, loudness.parsed(F.lit(log)))[:2] == (-23.1, -5.0)
    assert engines.limits(spark).count() == 5
    with pytest.raises(ValueError):
        engines.engine("nothing")
    made = engines.rendered(spark.createDataFrame([("x" * 20, None), ("x" * 20, 0.5)], "text string, speed double"), "stub", 100)
    assert [len(r.samples) for r in made.collect()] == [100, 200]


def test_simple_text(spark):
    assert one(spark, text.closed(F.lit('Done."'))) == 'Done."' and one(spark, text.closed(F.lit("Done"))) == "Done."
    assert one(spark, text.base_language(F.lit("EN_us-x"))) == "en" and one(spark, text.without_ordinal_suffix(F.lit("25-ГО мая"))) == "25 мая"
    assert one(spark, text.accent_after_vowel(F.lit("з+амок"))) == "за́мок" and one(spark, text.slug(F.lit("a b/../c"))) == "a-b-.-c"
    assert one(spark, text.paragraphs(F.lit("a\n \nb\n\n\nc"))) == ["a", "b", "c"] and one(spark, text.first_line(F.lit(" \n A  b\nc"))) == "A b"
    names = spark.createDataFrame([("Déjà vu!.epub",), ("....txt",)], "n string").select(text.safe_title("n")).collect()
    assert [r[0] for r in names] == ["De-ja-vu", "book"]


def test_whole_turns_are_read(spark, tmp_path):
    from scriptorium.plans import QUERIES

    said = " ".join(f"w{i}" for i in range(12))
    turns = [(1, 0, said + " one two"), (1, 1, said + " one six"), (1, 2, said), (2, 0, "a"), (2, 1, "")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["wer_turns"](spark, str(tmp_path)).orderBy("conv_id", "turn")
    assert rows(found) == [(1, 1, 1 / 14), (1, 2, 2 / 14), (2, 1, 1.0)]


def test_number_words_reads_texts(spark, tmp_path):
    from scriptorium.plans import QUERIES

    docs = [(1, "It cost 3.14 in 1905. " + "Then 21 came. " * 50, "en"), (2, "Их было 21.", "ru"), (3, "Es waren 21.", "de"), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spoken = dict(rows(QUERIES["number_words"](spark, str(tmp_path))))
    assert spoken == {i: None if t is None else text.spoken(t, lang) for i, t, lang in docs}
    assert spoken[1].count("twenty-one") == 50 and spoken[2] != docs[1][1] and spoken[3] == docs[2][1]
