"""The numbered queries: each applies its operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, table

#: Names of vocabulary files; ``public_tokenizers.path`` gives their place on each machine.
PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold_of("doc_id", 3) != 1))
    scored = toxicity.score_table(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_dedup import line_dedup

    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), shared AS (
  SELECT line_key, min(doc_id) AS keeper FROM keyed
  WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.keeper <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN shared s ON s.line_key = k.line_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.topk import top_inner

    return top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.piece_bpe import digest_table

    return digest_table(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import language_id

    docs = table(spark, sf_dir, "documents")
    counts = language_id.learn(docs.where(fold_of("doc_id", 5) != 0))
    found = language_id.predict(docs, counts)
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import quality

    docs = table(spark, sf_dir, "documents")
    scored = quality.score_table(docs, quality.fit(docs))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_MODEL), with_ids=False)


def op11_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bbit_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 1, least(len(w), 1))), lambda i: hash(array_to_string(list_slice(w, i + 1, i + 2), ' '))))) AS s FROM lists
), classes AS MATERIALIZED (
  SELECT s, len(s) AS n, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT id, n, unnest(s) AS item FROM classes
), often AS (
  SELECT item, count(*) AS often FROM items GROUP BY item
), front AS MATERIALIZED (  -- linked sets of n have one of their n - ceil(0.8 n) + 1 rarest shingles in common
  SELECT id, n, item FROM (SELECT id, n, item, row_number() OVER (PARTITION BY id ORDER BY often, item) AS place FROM items JOIN often USING (item)) WHERE place <= n - (80 * n + 99) // 100 + 1
), met AS MATERIALIZED (
  SELECT DISTINCT a.id AS a, b.id AS b FROM front a JOIN front b ON a.item = b.item AND a.id <> b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM met JOIN classes a ON a.id = met.a JOIN classes b ON b.id = met.b
  WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n)
), reach AS (
  SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN roots ON roots.a = classes.id
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def _crc_steps() -> list[int]:
    """What four steps of the CRC-32 make of each value of four bits, from its polynomial."""
    out = list(range(16))
    for _ in range(4):
        out = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS h FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), coded AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h)), lambda i: (instr('0123456789ABCDEF', h[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1)::BIGINT)),
         lambda c, x: xor(c >> 4, ({_crc_steps()}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295) AS crc FROM counted
), words AS (
  SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INTEGER) || substr(run, (crc % length(run))::INTEGER + 2) ELSE run END AS word, n FROM coded
), vocabulary AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word)))::INTEGER AS i FROM vocabulary)
), shorter AS (
  SELECT DISTINCT less.word AS a, v.word AS b FROM less JOIN vocabulary v ON v.word = d
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
), ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place FROM near JOIN vocabulary o ON o.word = other
), forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), chain AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_topk": op3_topk,
    "op4_piece_bpe": op4_piece_bpe,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_nn_descent": op9_nn_descent,
    "op10_packing": op10_packing,
    "op11_bbit_minhash": op11_bbit_minhash,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}
ORACLES = {"op2_line_dedup": OP2_SQL, "op3_topk": OP3_SQL, "op11_bbit_minhash": OP11_SQL, "op13_spelling": OP13_SQL}
