"""The pipeline's stages, and the whole of it, on odd, empty and clashing tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus import ODD, brute_components

CLASHES = ["gone_id", "gone_turn", "ld_cut", "ld_doc", "ld_lines", "pii_spans", "pii_doc", "pii_version", "key", "id", "label", "component_id", "doc", "version", "n_shingles", "a", "b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "web", len(t or "")) for i, t, lang in ODD] + [(7, "another text under an id that is there", "en", "web", 3), (20, "mail me@host.org or call +1 (555) 555-1234", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(os.path.join(path, "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 0), (4, 1, 0), (None, 1, 1), (99, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(os.path.join(path, "labels.parquet"))
    return path


@pytest.mark.parametrize("place", range(4))
def test_stages_keep_the_columns_of_odd_tables(spark, odd, folder, place):
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd, folder)
    rows = out.collect()
    assert out.columns == odd.columns and all(r[c] == "x" for r in rows for c in CLASHES)
    if name == "near_duplicates":
        assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 20]
    elif name == "pii":
        assert {r["doc_id"]: r["text"] for r in rows}[20] == "mail [EMAIL] or call [PHONE]"
    if name in ("line_dedup", "pii"):
        assert len(rows) == odd.count()
    none = stage(spark, odd.where("false"), folder)
    assert none.columns == odd.columns and none.count() == 0


def test_run_on_odd_and_empty_tables(spark, odd, folder, tmp_path):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} >= {1, 2, 4, 8, 20, None}
    odd.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines_and_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))
    holders: dict[str, set[int]] = {}
    for d, text in texts.items():
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    want = {d: "\n".join(x for x in text.split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d) for d, text in texts.items()}
    got = corpus_pipeline.drop_lines(spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, got, "").collect()}
    assert kept == {d for d, (_, root) in brute_components(list(want.items())).items() if d == root}
