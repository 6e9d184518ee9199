"""The chunk log as a source, statistics gathered on the way, the table function, and audits with terms and tickers."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from millrace.operators import audit, chunks, metrics
from millrace.sources import chunk_log
from millrace.streaming import transcripts

ROWS = [(m, k, f"chunk {k} of {m} " + "ก" * (k * 7 % 40)) for m in range(3) for k in range(40)]


def lines(rows):
    return "".join(json.dumps({"media_id": m, "idx": k, "text": t, "ts": 100 + k}, ensure_ascii=False) + "\n" for m, k, t in rows)


def append(path, text):
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def read(df):
    return sorted((r["media_id"], r["idx"], r["text"]) for r in df.collect())


def test_log_as_a_table(spark, tmp_path):
    chunk_log.register(spark)
    load = lambda **o: spark.read.format("chunk_log").options(path=str(tmp_path), **o).load()
    assert load().count() == 0
    append(tmp_path / "a.jsonl", lines(ROWS[:50]) + '{"broken\n{"idx": 1}\n[1]\n\n' + '{"media_id": 9, "idx": 0, "text": null}\n' + '{"media_id": 7, "idx"')
    append(tmp_path / "b.jsonl", lines(ROWS[50:]))
    append(tmp_path / "_b.jsonl", lines(ROWS))
    append(tmp_path / "c.jsonl", "no line's end")
    want = sorted([*ROWS, (9, 0, None)], key=str)
    for size in (701, 3000, 1 << 20):
        df = load(splitBytes=size)
        assert sorted(read(df.where("text is not null"))) == sorted(ROWS)
        assert sorted(((r["media_id"], r["idx"], r["text"]) for r in df.collect()), key=str) == want
    assert load().where("media_id = 9").first()["status"] == "failed" and load().where("idx = 3 and media_id = 0").select(F.col("ts").cast("long")).first()[0] == 103
    assert spark.read.format("chunk_log").load(f"{tmp_path}/nothing").count() == 0


def test_log_as_a_stream_goes_on_after_a_restart(spark, tmp_path):
    chunk_log.register(spark)
    out = []

    def run():
        with transcripts.rocksdb(spark):
            stream = spark.readStream.format("chunk_log").load(f"{tmp_path}/log")
            made = transcripts.stream_stitch(stream.select("media_id", "idx", "text"))
            query = made.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
            query = query.foreachBatch(lambda df, n: out.extend(r.asDict() for r in df.collect())).start()
        query.awaitTermination()

    (tmp_path / "log").mkdir()
    random.seed(4)
    text = " ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(600))
    parts = [(1, k, text[a : a + 450]) for k, a in enumerate(range(0, len(text) - 150, 300))]
    whole = lines(parts)
    cut = len(whole) // 2  # within a line
    append(tmp_path / "log" / "a.jsonl", whole[:cut])
    run()
    before = len(out)
    assert out and max(r["next_idx"] for r in out) < len(parts)
    append(tmp_path / "log" / "a.jsonl", whole[cut:])
    append(tmp_path / "log" / "b.jsonl", lines([(2, 0, "another")]))
    run()
    run()
    assert max(r["next_idx"] for r in out if r["media_id"] == 1) == len(parts) and len(out) == before + 2
    assert "".join(r["piece"] for r in sorted((r for r in out if r["media_id"] == 1), key=lambda r: r["start"])).strip() == text


def test_metrics_of_a_run_equal_an_aggregate(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, (4, 0, None), (4, 1, "")], "media_id long, idx int, text string").repartition(4)
    columns = metrics.chunk_metrics("text", "idx")
    rows, seen = metrics.observed(df, columns, "batch")
    rows.write.parquet(f"{tmp_path}/out")
    assert seen.get == df.agg(*[c.alias(n) for n, c in columns.items()]).first().asDict()
    by_media = {r["media_id"]: r for r in metrics.media_stats(df, duration="idx").collect()}
    assert by_media[1]["n_chunks"] == 40 and by_media[4]["n_empty"] == 2 and by_media[4]["n_chars"] == 0 and abs(by_media[0]["seconds_median"] - 19) <= 1


def test_metrics_of_a_stream_add_up(spark, tmp_path):
    listener = metrics.StreamMetrics()
    spark.streams.addListener(listener)
    schema = "media_id long, idx int, text string"
    for k in range(3):
        spark.createDataFrame(ROWS[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    try:
        stream = metrics.observed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), metrics.chunk_metrics(), "chunks")
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if len(listener.found.get("chunks", [])) >= 3:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    want = spark.createDataFrame(ROWS, schema).agg(*[c.alias(n) for n, c in metrics.chunk_metrics().items() if not n.startswith("size")]).first().asDict()
    assert listener.total("chunks") == want


def test_table_function_equals_split_text(spark):
    random.seed(6)
    texts = [(k, "".join(random.choice("ab \n") for _ in range(random.randint(0, 300)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    chunks.register_split_text(spark)
    got = spark.sql("SELECT doc_id, p.idx, p.piece FROM {t}, LATERAL split_text(text, 20) AS p", t=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.split_text(df, 20).collect()))


def test_table_function_holds_few_texts(spark):
    """A task never asks for thousands of texts before the pieces of the first are out."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 20) AS text").coalesce(1)
    chunks.register_split_text(spark)
    made = spark.sql("SELECT doc_id, p.idx, p.piece FROM {t}, LATERAL split_text(text, 100) AS p", t=df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert made.select("doc_id").distinct().count() == 20_000


def test_audits_of_terms_and_tickers(spark):
    df = spark.createDataFrame([(1, "QoQ up 5 and YoY up 5, QoQs", "QoQ up 5", "PTT and CPF.BK rose 7; ABC", "ptt PTT fell 7")], "id long, raw string, fixed string, summary string, source string")
    assert {(r["fact"], r["n_lost"]) for r in audit.lost_facts(df, "id", "raw", "fixed", terms=["QoQ", "YoY"]).collect()} == {("5", 1), ("YoY", 1)}
    tickers = spark.createDataFrame([("PTT.BK",), ("CPF.BK",)], "ticker string")
    assert [r["fact"] for r in audit.grounding(df, "id", "summary", "source", tickers=tickers).collect()] == ["CPF"]
