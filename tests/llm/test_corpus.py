"""The corpus operators against brute force, round trips and held-out rows, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, language_id, line_dedup, nn_descent, packing, pii, quality, queries, topk, toxicity
from millrace.llm.piece_bpe import PieceModel, decode_table, digest_table, encode_table

DATA = "/root/testdata/sf0.001"
LONG = ("Lorem ipsum dolor " * 4000).strip()
ODD = [
    (1, None, "en"), (2, "", None), (3, "   \n\t ", "en"), (4, LONG, "fr"), (5, "same text here for all\nx", "de"), (5, "same text here for all\nx", "de"),
    (6, "Same text here for ALL \ny", "de"), (7, "12345 67890", "en"), (8, "ü漢字 😀\x00 mixed", "es"), (None, "no id at all here", "en"),
]
CLASHES = ["key", "line", "pos", "version", "doc", "n", "label", "id", "base", "spans", "rep", "v", "part", "score"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_line_dedup_odd_rows(odd, empty):
    found = {(r["doc_id"], r["text"], r["ld_n_lines"], r["ld_n_dropped"]) for r in line_dedup.line_dedup(odd).collect()}
    assert (5, "same text here for all\nx", 2, 0) in found and (6, "y", 2, 1) in found
    assert (1, "", 1, 0) in found and (None, "no id at all here", 1, 0) in found
    assert line_dedup.line_dedup(odd).count() == len(ODD) and line_dedup.line_dedup(empty).count() == 0
    assert set(odd.columns) <= set(line_dedup.line_dedup(odd).columns)


def test_line_dedup_more_documents(spark):
    df = spark.createDataFrame([(k, "a line to share\nown line %d" % k) for k in range(3)] + [(9, "a line for two\n"), (10, "a line for two\n")], "doc_id long, text string")
    found = {r["doc_id"]: r["ld_n_dropped"] for r in line_dedup.line_dedup(df, min_docs=3).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 9: 0, 10: 0}


def test_pieces_equal_the_library(docs, odd):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_MODEL)
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(1)
    texts = [r["text"] for r in docs.select("text").collect()] + [t or "" for _, t, _ in ODD] + ["  a", "a  b ", " ", "▁a", "<s>", "\n\n x", "a \nb"]
    texts += ["".join(random.choice(model.pieces) for _ in range(random.randint(1, 6))).replace("▁", " ") for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(300):
        ids = [random.choice([random.randrange(32000), random.randrange(262)]) for _ in range(random.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)
    back = {r["doc_id"]: r["text"] for r in decode_table(encode_table(odd, path), path).collect()}
    assert back[1] == "" and back[4] == LONG and back[8] == ODD[8][1]
    row = next(r for r in digest_table(odd, path).collect() if r["doc_id"] == 4)
    ids = library.encode(LONG, add_eos=True)
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and row["n_tokens"] == len(ids)


def plain_shingles(text):
    """Five-word shingles by the definition, with none of the operator's code."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = {d: plain_shingles(t) for d, t in rows}
    over = {d: d for d in sets}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                over[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("options", [{}, {"few": 2}, {"few": 2, "most_items": 1}, {"few": 3, "most_items": 900}])
def test_jaccard_join_equals_brute_force(spark, options):
    random.seed(7)
    vocabulary, rows, n = [f"w{i}" for i in range(2000)], [], 0
    for _ in range(14):
        base = [random.choice(vocabulary) for _ in range(random.choice([1, 3, 5, 6, 9, 20, 60, 200]))]
        for _ in range(random.choice([1, 3, 20])):
            p = random.choice([0, 0.01, 0.04, 0.08])
            rows.append((n := n + 1, " ".join(w if random.random() > p else random.choice(vocabulary) for w in base)))
    passage = " ".join(random.choice(vocabulary) for _ in range(60))
    for k in (0, 2, 5, 10, 15, 20, 40, 100) * 3:
        rows.append((n := n + 1, " ".join(random.choice(vocabulary) for _ in range(k)) + " " + passage))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "A b"), (n + 4, "a  B")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_odd_rows(odd, empty):
    found = jaccard_join.jaccard_join(odd)
    assert found.count() == len(ODD) and jaccard_join.jaccard_join(empty).count() == 0
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert rows[1] == (0, 1) and rows[3] == (0, 3) and rows[5] == (2, 5) and rows[None] == (1, None)


def test_jaccard_join_one_id_with_two_texts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(7, "one short text of six words"), (7, long), (3, long + " more"), (9, "one short text of six words"), (9, None), (4, "alone here")]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 57, 3), (4, 1, 4), (7, 2, 3), (7, 56, 3), (9, 0, 9), (9, 2, 3)]


def test_partenum_signatures_hold_the_guarantee():
    rng = np.random.default_rng(3)
    made = []
    for size in [1, 2, 3, 4, 6, 7, 8, 12, 15, 16, 24, 31, 32, 50, 63, 64, 100, 127, 128, 200, 500, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            # A partner at the threshold: as many shingles gone and come as it allows.
            gone = rng.integers(0, len(a) // 4 + 1)
            come = max(0, (100 * (len(a) - gone) - 75 * len(a)) // 75)
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 2**63, come).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 75 * (len(a) + len(b) - both)
            (bands_a, sigs_a), (bands_b, sigs_b) = jaccard_join.signatures(a), jaccard_join.signatures(b)
            assert len(np.intersect1d(np.concatenate(sigs_a), np.concatenate(sigs_b)))
            # The count filter: in some band both take part in, they agree as often as either's sound partitions ask.
            common = [(x, y, i, k) for i, x in enumerate(bands_a) for k, y in enumerate(bands_b) if x[0] == y[0]]
            assert any(len(np.intersect1d(sigs_a[i], sigs_b[k])) >= max(1, x[1] - x[2], y[1] - y[2]) for x, y, i, k in common)
            made.append(sum(map(len, sigs_a)) / len(a))
    assert np.mean(made[-48:]) < 1.6  # signatures a shingle


def test_top_inner(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 12)) + 6 * rng.normal(size=(7, 12))[rng.integers(0, 7, 700)]
    x[100:300] = x[0]
    rows = [(k, [float(v) for v in x[k]]) for k in range(700)] + [(900, None), (901, [float("nan")] * 12), (902, [1.0, None] + [0.0] * 10), (903, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = {}
    for r in topk.top_inner(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = np.floor(64 * x).astype(int)
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        s = whole @ whole[q]
        order = [int(k) for k in np.lexsort((np.arange(700), -s)) if k != q][:20]
        assert [found[k + 1] for k in range(20)] == [(k, int(s[k])) for k in order]
    assert topk.top_inner(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rows += [(10_000 + k, rows[3][1]) for k in range(30)] + [(20_000, None), (20_001, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([k for k, v in rows if v is not None and any(v)])
    x = np.array([v for _, v in rows if v is not None and any(v)], float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        true = ids[np.lexsort((ids, d))[:10]].tolist()
        found = [v for _, v, _ in sorted(got[q])]
        hit, total = hit + len(set(found) & set(true)), total + 10
    assert hit >= 0.9 * total
    assert nn_descent.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 96)  # 2,000 vectors: pivots, deals and descent rounds all take part
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    assert len(rows) > 10 * nn_descent.BLOCK
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit.append(len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hit) >= 0.9


def test_language_id(docs, odd, empty):
    counts = language_id.learn(docs.where(queries.fold_of("doc_id", 5) != 0))
    held = docs.where(queries.fold_of("doc_id", 5) == 0)
    both = language_id.predict(held, counts).join(held.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in both]) > 0.95
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, counts).collect()}
    assert found[1] == found[2] == found[3] == found[7] == "und" and found[8] != "und"
    assert language_id.predict(empty, counts).count() == 0
    nothing = language_id.learn(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_toxicity(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = spark.createDataFrame([(k, f"word{k % 7} some plain text {'you moron idiot' if k % 3 == 0 else 'of good will'} number {k}") for k in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(toxic, marks)
    wrong = [r for r in toxicity.score_table(toxic, model).collect() if (r["score"] >= 0.7) != (r["doc_id"] % 3 == 0)]
    assert not wrong
    assert toxicity.filter_toxic(toxic, model).count() == 200
    assert toxicity.score_table(odd, toxicity.fit(docs, labels)).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.filter_toxic(odd, toxicity.fit(docs, labels)).columns == odd.columns
    assert toxicity.score_table(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score_table(odd, toxicity.fit(docs, labels.where("false"))).collect()} <= {toxicity.fit(docs, labels.where("false")).score(np.zeros(0, int))}


def test_quality(docs, odd, empty):
    model = quality.fit(docs)
    junk = docs.limit(50).select((F.col("doc_id") + 100000).alias("doc_id"), F.upper(F.replace("text", F.lit(" "), F.lit("!! $$$ "))).alias("text"))
    bad = [r["score"] for r in quality.score_table(junk, model).collect()]
    good = [r["score"] for r in quality.score_table(docs, model).collect()]
    assert np.median(bad) < np.median(good)
    assert quality.score_table(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert quality.score_table(empty, quality.fit(empty)).count() == 0


@pytest.mark.parametrize("period", [*range(61, 70), 128])
def test_quality_sees_repeats_of_any_period(period):
    random.seed(9)
    passage = "".join(random.choice("abcdefghijklmnop ") for _ in range(period))
    repeats = list(quality.LABELLERS).index("repeats")
    for copies in (2, 3, 8):
        text = (passage * copies).encode()
        windows = [text[k : k + 16] for k in range(len(text) - 15)]
        found = quality.figures(np.frombuffer(text, np.uint8))[repeats]
        assert found == pytest.approx(1 - len(set(windows)) / len(windows)) and found > 0.3


def luhn_ok(digits):
    return sum((d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, form, keep in [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn_ok(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]:
        out += [(kind, m.start(), m.end()) for m in re.finditer(form, text) if keep(m.group())]
    return out


def test_pii_base_equals_brute_force(spark, docs, odd):
    random.seed(4)
    parts = ["a@b.c", "_d@e.f", "x.y@mail-1.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.4", "00300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 555-1234", "+12", "+1 2", "12 ", "9" * 20, "ü", "漢", " ", "\n", ".", "-", "+", "5"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 12))) for _ in range(600)] + [r["text"] for r in docs.collect()] + [t or "" for _, t, _ in ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find(df).select("doc_id", "base").collect()}
    for k, text in enumerate(texts):
        assert found[k] == brute_spans(text), text
    assert pii.find(odd).count() == len(ODD) and pii.find(odd.where("false")).count() == 0


def test_pii_of_texts_full_of_identifiers(spark):
    full = lambda n: "".join(f"wörd u{k}@mail{k % 9}.example.com, or 10.0.{k % 300}.1 " for k in range(n))
    texts = [full(n) for n in (pii.STRIDE - 1, pii.STRIDE, pii.STRIDE + 1, 3 * pii.STRIDE + 7)] + ["a@b.c", ""]
    seeds = pii.seed_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in seeds.select("doc_id", "base").collect()}
    assert found == {k: brute_spans(text) for k, text in enumerate(texts)}


def test_pii_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"word{chr(97 + k % 26)} please call mobile +1 555 000 {1000 + k} now") for k in range(40)]
    rows += [(100, "kindly call mobile 5550009999x and wait"), (101, "the lot a5550001 of wood")]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == [("phone", 19, 30)] and found[101] == []


def test_pii_rounds_go_on_until_nothing_is_new(spark):
    # Each word stands before 13 phones, the 3 identifiers that the word before it leads to, and 3 new ones: 13 of 19 known are too few, 16 enough.
    new = lambda k: [f"zq{k}000{i}" for i in range(3)] if k >= 0 else []
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    rows = [f"please {w} {x} now" for k, w in enumerate(words) for x in [f"+1 555 {k}00 {1000 + i}" for i in range(13)] + new(k - 1) + new(k)]
    seeds = pii.seed_table(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "doc_id", "text")
    found = {(r["kind"], r["found"]) for r in pii.bootstrap(seeds).collect()}
    assert found == {("phone", x) for k in range(len(words)) for x in new(k)}


def test_pii_redact(spark, odd):
    df = spark.createDataFrame([(1, "mail a@b.c or 1.2.3.4."), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == {1: "mail [EMAIL] or [IP].", 2: None, 3: "clean"}
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_MODEL)
    plain = Tokenizer.from_file(path)
    for table in (docs, odd):
        rows = packing.pack(table, path).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()]
        want = sorted((str(d), np.asarray([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in texts)
        rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        stream, got, now = 0, [], b""
        for r in rows:
            assert r["sequence_id"] * 2048 + r["offset"] == stream and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
            assert len(now) == 4 * r["start"]
            stream, now = stream + r["length"], now + r["ids"]
            if len(now) == 4 * r["doc_tokens"]:
                got.append((str(r["doc_id"]), now))
                now = b""
        assert sorted(got) == want
    assert packing.pack(empty, path).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns
        rows = now.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near_duplicates":
            parts = brute_components(list(before.items()))
            assert set(after) == {d for d, (_, root) in parts.items() if root == d}
        elif name == "pii":
            assert not any(brute_spans(t) for t in after.values())
        now = spark.createDataFrame(rows, docs.schema)


def test_oracle_queries(spark):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        result = c.execute(sql)
        columns = [x[0] for x in result.description]
        assert sorted(map(str, (tuple(r[k] for k in columns) for r in df.collect()))) == sorted(map(str, result.fetchall()))
