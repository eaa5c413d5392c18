import uuid

from pyspark.sql import functions as F

from scriptorium.operators import rounds, state


def test_rounds_settle(spark, tmp_path):
    texts = ["Good one.", "Bad one is here. It stays bad. Good end.", "Bad"]
    chunks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    start = state.initial(chunks.selectExpr("*", "0 as pause_ms", "cast(null as double) as speed", "true as ends_paragraph"))

    def keep(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    make = lambda df: df.selectExpr("doc_id", "chunk_id", "'completed' as new_status", "cast(null as string) as new_error", "1L as new_seed")
    wer = F.when(F.instr("text", "ad") > 0, 1.0).otherwise(0.0)
    measure = lambda df: df.select("doc_id", "chunk_id", wer.alias("wer"), F.lit(1.0).alias("ratio"), (F.length("text") / 20.0).alias("expected"))
    done = {r.chunk_id: (r.status, r.retries, r.qc.verdict if r.qc else None) for r in rounds.settled(start, make, measure, keep, 1, 2).collect()}
    assert done["0"] == ("completed", 0, "pass") and done["1"][0] == "split" and done["2"] == ("completed", 1, "fail")
    assert done["1_0"][0] == "split" and done["1_1"][0] == "split" and done["1_1_1"] == ("completed", 0, "pass") and done["1_1_0"] == ("completed", 1, "fail")
