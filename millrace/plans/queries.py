"""One query an operator, over the given tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import scratch
from millrace.functions import text as X
from millrace.operators import audit, chunks, corrections, infer, metrics, prompts, resolve
from millrace.plans import fixtures as fx
from millrace.plans.fixtures import ALL_WORDS, CACHE, HITS, KB, MARKDOWN, MEDIA, MENTIONS, QUOTES, t
from millrace.sources import knowledge
from millrace.sources.cache_table import CacheTable, learner
from millrace.streaming import transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents")


def per_doc(name: str, column: Callable, sql: str) -> None:
    """A query that applies one expression to every text. ``sql`` is the same over the column ``text``."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", column(F.col("text")).alias("value")))


# --- flagship ---------------------------------------------------------------------------------------------------
@query("AGG11_sector_rollup", f"""WITH {MENTIONS}, home AS (SELECT ticker, arg_min(sector, sector_pos) AS sector FROM sectors GROUP BY ticker)
SELECT sector, ticker, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM mentions JOIN home USING (ticker) GROUP BY ROLLUP (sector, ticker)""")
def sector_rollup(spark, d):
    return resolve.sector_rollup(fx.mentions(spark, d), fx.sectors(spark, d))


# --- sources and sinks --------------------------------------------------------------------------------------------
_KB_FLAT = f"""WITH {KB}, flat AS (SELECT sector, ticker, alias, dense_rank() OVER (ORDER BY sector) - 1 AS sector_pos,
 dense_rank() OVER (PARTITION BY sector ORDER BY ticker) - 1 AS ticker_pos,
 row_number() OVER (PARTITION BY sector, ticker ORDER BY item_id * 100000 + alias_pos) - 1 AS alias_pos FROM kb) """


def _kb_file(spark, d) -> str:
    path = scratch.new_path(spark, "kb-json")
    knowledge.write_kb(fx.kb(spark, d).withColumn("ord", F.col("item_id") * 100000 + F.col("alias_pos")), path)
    return path


@query("SRC1_kb_scan", _KB_FLAT + "SELECT * FROM flat")
def kb_scan(spark, d):
    return knowledge.read_kb(spark, _kb_file(spark, d))


@query("SRC2_terms_scan", _KB_FLAT + "SELECT sector AS grp, sector_pos AS grp_pos, ticker AS canonical, ticker_pos AS canonical_pos, alias, alias_pos FROM flat")
def terms_scan(spark, d):
    return knowledge.read_kb(spark, _kb_file(spark, d), ("grp", "canonical", "alias"))


@query("SRC3_vocab_scan", "SELECT p_name AS term, p_brand AS \"desc\", [p_type] AS hints, NULL::VARCHAR AS logic FROM part")
def vocab_scan(spark, d):
    rows = t(spark, d, "part").select(F.to_json(F.struct(F.lit("base").alias("investment_prompt"), F.array(F.struct(F.col("p_name").alias("term"), F.col("p_brand").alias("desc"), F.array("p_type").alias("hints"))).alias("vocab_list"))).alias("value"))
    path = scratch.new_path(spark, "vocabulary")
    rows.write.text(path)  # one document a line, so that the file is read in parallel
    return knowledge.read_vocabulary(spark, path)


@query("SRC4_cache_scan", f"WITH {KB} SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key AS mention, ticker FROM dictionary")
def cache_scan(spark, d):
    path = scratch.new_path(spark, "cache-json")
    knowledge.write_cache(fx.dictionary(spark, d).withColumnRenamed("key", "mention"), path)
    return knowledge.read_cache(spark, path)


@query("SRC5_media_scan", f"WITH {MEDIA} SELECT media_id, coalesce(title, 'Unknown_Video') AS title, coalesce(description, '') AS description, tags, channel, duration_sec FROM media")
def media_scan(spark, d):
    return knowledge.media(fx.media(spark, d))


@query("SRC6_chunk_text_scan", "SELECT conv_id AS media_id, turn AS idx, text, 'ok' AS status FROM conversations")
def chunk_text_scan(spark, d):
    return knowledge.chunk_text(fx.turns(spark, d))


@query("SNK1_kb_write", f"WITH {KB} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT sector) AS n_sectors FROM kb")
def kb_write(spark, d):
    return knowledge.read_kb(spark, _kb_file(spark, d)).agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("sector").alias("n_sectors"))


@query("SNK2_cache_upsert", f"""WITH {CACHE}, every AS (SELECT key AS mention, ticker, updated_at FROM cache UNION ALL
 SELECT lower(p_brand), 'N' || (p_partkey % 7) || '.BK', p_partkey::BIGINT + p_partkey % 3 FROM part)
SELECT mention, ticker, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY updated_at DESC, ticker DESC) AS n FROM every) WHERE n = 1""")
def cache_upsert(spark, d):
    changes = t(spark, d, "part").select(F.col("p_brand").alias("mention"), F.concat(F.lit("N"), F.col("p_partkey") % 7, F.lit(".BK")).alias("ticker"), (F.col("p_partkey") + F.col("p_partkey") % 3).cast("long").alias("updated_at"))
    table = _cache_table(spark, d, "cache-upsert")
    table.merge(changes)
    return table.table()


def _cache_table(spark, d, name: str) -> CacheTable:
    """The learned entries as a table of its own."""
    table = CacheTable(spark, scratch.new_path(spark, name), buckets=16)
    table.merge(fx.cache(spark, d).withColumnRenamed("key", "mention"))
    return table


@query("SNK3_transcript_write", "SELECT conv_id AS media_id, CASE WHEN turn % 2 = 0 THEN 'RAW' ELSE 'CLEAN' END AS kind, turn AS run_ts, text FROM conversations")
def transcript_write(spark, d):
    path = scratch.new_path(spark, "artifacts")
    rows = fx.turns(spark, d).select(F.col("conv_id").alias("media_id"), F.when(F.col("turn") % 2 == 0, "RAW").otherwise("CLEAN").alias("kind"), F.col("turn").alias("run_ts"), "text")
    knowledge.write_artifacts(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


# --- scalar text --------------------------------------------------------------------------------------------------
_WS = r"[\t\n\v\f\r ]"


@query("TXT1_strip_suffix", f"WITH {KB} SELECT alias, alias_pos, item_id, replace(ticker, '.BK', '') AS code FROM kb")
def strip_suffix(spark, d):
    return fx.kb(spark, d).select("alias", "alias_pos", "item_id", X.strip_suffix(F.col("ticker")).alias("code"))


per_doc("TXT2_norm_key", lambda x: X.norm_key(x), f"regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g')")


@query("TXT3_script_filter", "SELECT doc_id, list_filter(['ก' || lang, lang, source || '๙'], lambda x: regexp_matches(x, '[ก-๙]')) AS value FROM documents")
def script_filter(spark, d):
    aliases = F.array(F.concat(F.lit("ก"), "lang"), F.col("lang"), F.concat("source", F.lit("๙")))
    return docs(spark, d).select("doc_id", X.thai_only(aliases).alias("value"))


@query("TXT4_tier_config", f"""WITH {MEDIA} SELECT media_id, CASE WHEN duration_sec <= 1740 THEN 'short' WHEN duration_sec <= 3600 THEN 'medium' ELSE 'long' END AS mode,
 CASE WHEN duration_sec <= 1740 THEN 45 WHEN duration_sec <= 3600 THEN 60 ELSE 600 END AS chunk_sec, CASE WHEN duration_sec <= 3600 THEN 15 ELSE 20 END AS overlap_sec,
 CASE WHEN duration_sec <= 1740 THEN 5 WHEN duration_sec <= 3600 THEN 3 ELSE 2 END AS workers, CASE WHEN duration_sec <= 3600 THEN 4000 ELSE 3000 END AS text_chars FROM media""")
def tier_config(spark, d):
    return fx.media(spark, d).select("media_id", X.tier(F.col("duration_sec")).alias("t")).select("media_id", "t.*")


@query("TXT5_fmt_duration", f"""WITH {MEDIA}, s AS (SELECT media_id, floor(duration_sec)::BIGINT AS s FROM media)
SELECT media_id, (s // 60) || 'm ' || (s % 60) || 's' AS short, format('{{:02d}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) AS clock FROM s""")
def fmt_duration(spark, d):
    return fx.media(spark, d).select("media_id", X.fmt_duration(F.col("duration_sec")).alias("short"), X.fmt_clock(F.col("duration_sec")).alias("clock"))


per_doc("TXT6_slug", lambda x: X.slug(x), rf"""coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(text, '[^\pL\pN_ก-๙\s-]', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g'), '\s+', '_', 'g'), 1, 50), ''), 'audio_output')""")
per_doc("TXT7_paragraphs", lambda x: X.paragraphs(x), rf"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')""")


@query("TXT8_bullets", f"WITH {MARKDOWN} SELECT doc_id, regexp_replace(markdown, '(?m)^([ \\t]*)\\* ', '\\1- ', 'g') AS value FROM summary")
def bullets(spark, d):
    return fx.markdown(spark, d).select("doc_id", X.bullets(F.col("markdown")).alias("value"))


per_doc("TXT9_collapse_ws", lambda x: X.collapse_ws(x), rf"regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g')")
per_doc("TXT10_halve_blanks", lambda x: X.halve_blanks(F.replace(x, F.lit("e"), F.lit("  "))), "replace(replace(replace(text, 'e', '  '), '  ', ' '), '. .', '.')")
per_doc("TXT11_drop_triggers", lambda x: X.drop_phrases(x, ["the ", "MIT License", "de la"]), "replace(replace(replace(text, 'the ', ''), 'MIT License', ''), 'de la', '')")
per_doc("TXT12_drop_fillers", lambda x: X.drop_fillers(F.replace(x, F.lit("on"), F.lit("อ่าา"))), "".join(["regexp_replace("] * len(X.FILLERS)) + "replace(text, 'on', 'อ่าา')" + "".join(f", '{p}', '', 'g')" for p in X.FILLERS))
per_doc("TXT13_cap_text", lambda x: X.cap(x, 1000), "substr(text, 1, 1000)")
per_doc("TXT14_size_mb", lambda x: X.size_mb(x), "strlen(text) / 1048576.0::DOUBLE")


@query("TXT15_strip_echo", rf"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[CONTEXT] old] ' || text WHEN doc_id % 3 = 1 THEN '[CONTEXT] ' || replace(text, ']', '') ELSE text END AS r FROM documents),
a AS (SELECT doc_id, r, CASE WHEN contains(r, '[CONTEXT]') THEN string_split(r, '[CONTEXT]')[-1] ELSE r END AS x FROM s)
SELECT doc_id, regexp_replace(CASE WHEN contains(r, '[CONTEXT]') AND contains(x, ']') THEN string_split(x, ']')[-1] ELSE x END, '^{_WS}+|{_WS}+$', '', 'g') AS value FROM a""")
def strip_echo(spark, d):
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[CONTEXT] old] "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[CONTEXT] "), F.replace("text", F.lit("]"), F.lit("")))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", X.strip_echo(reply).alias("value"))


_SHARP = "replace(text, 'ß', 'ss')"  # the one letter whose upper case differs between the engines
_CANDS = f"list_filter(string_split_regex(upper({_SHARP}), '[^\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,8}}'))"
_BLACK = "[" + ", ".join(f"'{w}'" for w in X.BLACKLIST) + "]"
_sharp = lambda x: F.replace(x, F.lit("ß"), F.lit("ss"))
per_doc("TXT16_cand_tokens", lambda x: X.candidates(_sharp(x)), _CANDS)
per_doc("TXT17_blacklist", lambda x: X.not_blacklisted(X.candidates(_sharp(x))), f"list_filter({_CANDS}, lambda x: NOT list_contains({_BLACK}, x))")


@query("TXT18_index_guard", f"WITH {CACHE} SELECT key, ticker, NOT contains(ticker, 'SET.BK') AND NOT contains(ticker, '^') AND ticker <> '' AS ok FROM cache")
def index_guard(spark, d):
    return fx.cache(spark, d).select("key", "ticker", X.index_guard(F.col("ticker")).alias("ok"))


per_doc("TXT19_protected_gate", lambda x: F.array_sort(X.protected(X.candidates(_sharp(x)), F.array(F.lit("IT"), F.lit("DE")))), f"list_sort(list_distinct(list_filter({_CANDS}, lambda x: x IN ('IT', 'DE') OR (length(x) >= 3 AND NOT list_contains({_BLACK}, x)))))")


def _replaced(term: str, rule: str = "true") -> str:
    """Texts with the dictionary's words replaced by ``term`` where ``rule`` holds. Texts are cut at the ends of words, so all else stays."""
    return rf"""WITH {KB}, lists AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+') AS a, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws, regexp_matches(text, '^\s')::INTEGER AS led FROM documents),
parts AS (SELECT doc_id, led, unnest(a) AS w, generate_subscripts(a, 1) AS n FROM lists),
placed AS MATERIALIZED (SELECT doc_id, n, w, coalesce(sum(len(regexp_extract_all(w, '\s+'))) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT - led AS place FROM parts),
met AS MATERIALIZED (SELECT doc_id, n, place, ticker, key FROM placed JOIN dictionary ON lower(w) = key),
ruled AS MATERIALIZED (SELECT doc_id, n, ticker, key, array_to_string(list_slice(ws, greatest(place - 5, 0) + 1, greatest(place - 5, 0) + 10), ' ') AS around FROM met JOIN lists USING (doc_id)),
made AS (SELECT doc_id, string_agg(CASE WHEN key IS NOT NULL AND {rule} THEN {term} ELSE w END, '' ORDER BY n) AS made FROM placed LEFT JOIN ruled USING (doc_id, n) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(made, '') END AS text FROM documents LEFT JOIN made USING (doc_id)"""


@query("TXT20_hint_replace", _replaced("upper(key)"))
def hint_replace(spark, d):
    hints = fx.dictionary(spark, d).select(F.col("key").alias("hint"), F.upper("key").alias("term"))
    return corrections.hint_replace(docs(spark, d), hints)


@query("TXT21_context_rule", _replaced("upper(key)", "regexp_matches(around, '(^| )(the|de|und)( |$)')"))
def context_rule(spark, d):
    rules = fx.dictionary(spark, d).select(F.col("key").alias("hint"), F.upper("key").alias("term"), F.lit("(^| )(the|de|und)( |$)").alias("ctx"))
    return corrections.context_rule(docs(spark, d), rules)


@query("TXT22_split_text", "SELECT doc_id, i AS idx, substr(text, i * 450 + 1, 450) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 450)) AS i FROM documents WHERE length(text) > 0)")
def split_fixed(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.fixed_slices(F.col("text"), 450)).alias("idx", "piece"))


@query("TXT22b_split_recursive")
def split_recursive(spark, d):
    return chunks.split_text(docs(spark, d), 4000)


@query("TXT22c_split_lateral")
def split_lateral(spark, d):
    """The table function, in a lateral join."""
    chunks.register_split_text(spark)
    return spark.sql("SELECT doc_id, p.idx, p.piece FROM {texts}, LATERAL split_text(text, 4000) AS p", texts=docs(spark, d).select("doc_id", "text"))


@query("TXT23_ticker_standardise", _replaced("upper(ticker)"))
def ticker_standardise(spark, d):
    return corrections.standardise(docs(spark, d), fx.dictionary(spark, d).withColumnRenamed("key", "mention"))


@query("TXT24_artifact_name", "SELECT o_orderkey, o_orderstatus || '_RAW_' || strftime(o_orderdate::TIMESTAMP, '%Y%m%d_%H%M') AS name FROM orders")
def artifact_name(spark, d):
    return t(spark, d, "orders").select("o_orderkey", knowledge.artifact_name(F.lit("RAW"), F.col("o_orderdate"), F.col("o_orderstatus")).alias("name"))


# --- replies ------------------------------------------------------------------------------------------------------
_ENTITY = "array<struct<mention:string,ticker:string>>"


def replies(spark, d, fenced: bool) -> DataFrame:
    rows = fx.mentions(spark, d).groupBy("doc_id", "mention", "ticker").agg(F.min("pos").alias("pos"))
    body = rows.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mention", "ticker"))), lambda x: F.struct(x["mention"].alias("mention"), x["ticker"].alias("ticker")))).alias("j"))
    k = F.col("doc_id") % 5
    fence = F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```\nDone"))
    prose = F.concat(F.lit("The list is "), "j", F.lit(" as asked")) if not fenced else F.concat(F.lit("```"), "j", F.lit("```"))
    return body.select("doc_id", F.when(k == 0, F.col("j")).when(k == 1, fence).when(k == 2, prose).when(k == 3, F.lit("[{broken")).otherwise(F.lit('{"a": 1}')).alias("reply"))


_REPLY = f"WITH {MENTIONS} SELECT doc_id, mention, ticker FROM firsts WHERE doc_id % 5 < 3"


@query("JSON1_bracket_json", _REPLY)
def bracket_json(spark, d):
    return replies(spark, d, False).select("doc_id", F.inline(X.bracket_json(F.col("reply"), _ENTITY)))


@query("JSON2_fence_json", _REPLY)
def fence_json(spark, d):
    return replies(spark, d, True).select("doc_id", F.inline(X.fence_json(F.col("reply"), _ENTITY)))


@query("INF4_structured_out", f"WITH {MENTIONS} SELECT doc_id, count(*) AS n FROM firsts WHERE doc_id % 5 < 3 GROUP BY doc_id")
def structured_out(spark, d):
    return infer.structured(replies(spark, d, False), F.col("reply"), _ENTITY).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- lookups ------------------------------------------------------------------------------------------------------
def distinct_words(spark, d) -> DataFrame:
    return fx.words(docs(spark, d), "doc_id").select(F.col("word").alias("mention")).distinct()


_WORDS = MENTIONS + ", distinct_words AS (SELECT DISTINCT mention FROM doc_words WHERE length(mention) >= 6)"


@query("JOIN1_exact_resolve", f"WITH {ALL_WORDS} SELECT mention, ticker FROM (SELECT DISTINCT mention FROM all_words) LEFT JOIN dictionary ON mention = key")
def exact_resolve(spark, d):
    return resolve.resolve_exact(fx.all_words(docs(spark, d)).distinct(), fx.dictionary(spark, d))


@query("JOIN2_code_resolve", f"""WITH {KB}, m AS (SELECT 't' || (doc_id % 40) AS mention, count(*) AS n FROM documents GROUP BY 1)
SELECT mention, n, CASE WHEN code IS NOT NULL THEN code || '.BK' END AS code_ticker FROM m LEFT JOIN (SELECT DISTINCT replace(ticker, '.BK', '') AS code FROM kb) ON upper(mention) = code""")
def code_resolve(spark, d):
    m = docs(spark, d).groupBy(F.concat(F.lit("t"), F.col("doc_id") % 40).alias("mention")).agg(F.count("*").alias("n"))
    return resolve.resolve_code(m, fx.kb(spark, d))


@query("JOIN3_overlay", f"WITH {CACHE} SELECT coalesce(c.key, b.key) AS key, coalesce(c.ticker, b.ticker) AS ticker, CASE WHEN c.ticker IS NOT NULL THEN 'cache' ELSE 'kb' END AS src FROM dictionary b FULL JOIN cache c ON c.key = b.key")
def overlay(spark, d):
    return resolve.overlay(fx.dictionary(spark, d), fx.cache(spark, d))


_FUZZY = f"""WITH {_WORDS.replace("distinct_words AS (", "distinct_words AS MATERIALIZED (").replace("dictionary AS (", "dictionary AS MATERIALIZED (")},
near AS MATERIALIZED (SELECT key, ticker, unnest(generate_series(length(key) - length(key) // 8 - 1, length(key) + length(key) // 8 + 1)) AS len FROM dictionary),
scored AS MATERIALIZED (SELECT mention, key AS alias, ticker, round(100.0 * (1 - levenshtein(mention, key)::DOUBLE / greatest(length(mention), length(key))))::INTEGER AS score
 FROM distinct_words JOIN near ON length(mention) = len WHERE abs(length(mention) - length(key)) <= 0.11 * greatest(length(mention), length(key))),
best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, alias) AS n FROM scored WHERE score >= 90),
fuzzy AS MATERIALIZED (SELECT mention, alias, ticker, score FROM best WHERE n = 1 AND NOT (length(replace(ticker, '.BK', '')) <= 3 AND score < 100) AND NOT (regexp_full_match(mention, '[A-Za-z]+') AND score < 95)) """


@query("JOIN4_fuzzy_resolve", _FUZZY + "SELECT mention, alias, ticker, score FROM fuzzy")
def fuzzy_resolve(spark, d):
    return resolve.fuzzy_matches(distinct_words(spark, d), fx.dictionary(spark, d))


@query("JOIN4b_fuzzy_sequence")
def fuzzy_sequence(spark, d):
    """Words of any letters and length, by the block-matching ratio."""
    return resolve.fuzzy_matches(fx.all_words(docs(spark, d)).distinct(), fx.dictionary(spark, d), scorer="sequence")


@query("LIM1_top1", _FUZZY + "SELECT mention, alias, score FROM fuzzy")
def top1(spark, d):
    return fuzzy_resolve(spark, d).drop("ticker")


@query("JOIN5_cascade", _FUZZY.rstrip() + """, codes AS MATERIALIZED (SELECT DISTINCT replace(ticker, '.BK', '') AS code FROM kb)
SELECT w.mention, coalesce(d.ticker, code || '.BK', f.ticker) AS ticker, CASE WHEN d.ticker IS NOT NULL THEN 'exact' WHEN code IS NOT NULL THEN 'code' WHEN f.ticker IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
FROM distinct_words w LEFT JOIN dictionary d ON w.mention = d.key LEFT JOIN codes ON upper(w.mention) = code LEFT JOIN fuzzy f ON f.mention = w.mention""")
def cascade(spark, d):
    return resolve.cascade(distinct_words(spark, d), fx.dictionary(spark, d), fx.kb(spark, d))


@query("JOIN6_unknown", f"WITH {ALL_WORDS} SELECT DISTINCT mention FROM all_words WHERE mention NOT IN (SELECT key FROM dictionary)")
def unknown(spark, d):
    return resolve.unknown(fx.all_words(docs(spark, d)).distinct(), fx.dictionary(spark, d))


@query("JOIN7_priority", f"""WITH {KB}, tok AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(upper(source || ' T' || (doc_id % 40)), '[^\\pL\\pN_]+'), lambda x: length(x) >= 2)) AS token FROM documents)
SELECT doc_id, token FROM tok WHERE token IN (SELECT replace(ticker, '.BK', '') FROM kb)""")
def priority(spark, d):
    title = F.upper(F.concat_ws(" ", "source", F.concat(F.lit("T"), F.col("doc_id") % 40)))
    return resolve.priority(docs(spark, d), title, fx.kb(spark, d))


_TRADED = f"""WITH {MENTIONS}, {QUOTES.strip()}, latest AS (SELECT max(ts) AS ts FROM events),
recent AS (SELECT DISTINCT ticker FROM quotes, latest WHERE quotes.ts <= latest.ts AND quotes.ts >= latest.ts - INTERVAL 5 DAY)"""


def _recent(spark, d) -> tuple[DataFrame, object]:
    return fx.quotes(spark, d), F.lit(t(spark, d, "events").agg(F.max("ts")).first()[0])


@query("JOIN8_verify_traded", _TRADED + " SELECT doc_id, pos, mention, ticker FROM mentions WHERE ticker IN (SELECT ticker FROM recent)")
def verify_traded(spark, d):
    quotes, asof = _recent(spark, d)
    return resolve.verify_traded(fx.mentions(spark, d), quotes, asof, 5).select("doc_id", "pos", "mention", "ticker")


@query("JOIN9_suffix_order", _TRADED + " SELECT DISTINCT replace(ticker, '.BK', '') AS code, ticker FROM kb WHERE ticker IN (SELECT ticker FROM quotes)")
def suffix_order(spark, d):
    codes = fx.kb(spark, d).select(X.strip_suffix(F.col("ticker")).alias("code")).distinct()
    return resolve.first_verified(codes, fx.quotes(spark, d), ["", ".BK"])


_HIT = rf"""WITH {HITS.strip()}, joined AS (SELECT query, upper(string_agg(concat_ws(' ', title, body), ' ' ORDER BY rank)) AS text FROM hits WHERE rank <= 3 GROUP BY query)
SELECT query, coalesce(nullif(regexp_extract(text, '([A-Z]{{2,8}}\.BK)', 1), ''), list_filter(string_split_regex(text, '[^\pL\pN_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,8}}') AND NOT list_contains({_BLACK}, x))[1]) AS candidate FROM joined"""


@query("JOIN10_hits_to_candidate", _HIT)
def hits_to_candidate(spark, d):
    return resolve.hits_to_candidate(fx.hits(spark, d), 3)


@query("JOIN11_hits_to_candidate_v2", rf"""WITH {HITS.strip()}, joined AS (SELECT query, string_agg(concat_ws(' ', title, body, href), ' ' ORDER BY rank) AS text FROM hits WHERE rank <= 5 GROUP BY query)
SELECT query, list_filter(string_split_regex(text, '[^\pL\pN_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}') AND NOT list_contains({_BLACK}, x))[1] AS candidate FROM joined""")
def hits_to_candidate_v2(spark, d):
    return resolve.hits_to_candidate_v2(fx.hits(spark, d), 5)


@query("LIM3_top_k_hits", f"WITH {HITS.strip()} SELECT query, rank, href FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 3")
def top_k_hits(spark, d):
    return resolve.top_k_hits(fx.hits(spark, d), 3).select("query", "rank", "href")


per_doc("LIM4_first_candidate", lambda x: X.first_candidate(_sharp(x)), f"{_CANDS}[1]")


def entities(spark, d) -> DataFrame:
    """Typed entities from the mentions."""
    kind = F.element_at(F.array(*map(F.lit, ["stock_th", "company", "index", "fund"])), (F.col("pos") % 4 + 1).cast("int"))
    return resolve.first_seen(fx.mentions(spark, d)).select("doc_id", "pos", "mention", kind.alias("type"))


_ENTITIES = f"""WITH {MENTIONS}, entities AS (SELECT doc_id, pos, mention, ['stock_th', 'company', 'index', 'fund'][pos % 4 + 1] AS type FROM firsts),
enriched AS (SELECT e.*, CASE WHEN type IN ('stock_th', 'company') THEN d.ticker END AS ticker, CASE WHEN type NOT IN ('stock_th', 'company') THEN 'ner_only' WHEN d.ticker IS NOT NULL THEN 'ddg+yf' ELSE 'ddg_only_or_failed' END AS source
 FROM entities e LEFT JOIN dictionary d ON e.mention = d.key AND length(d.key) % 2 = 0)"""


@query("JOIN12_enrich", _ENTITIES + " SELECT doc_id, pos, mention, type, ticker, source FROM enriched")
def enrich(spark, d):
    return resolve.enrich(entities(spark, d), fx.dictionary(spark, d).where(F.length("key") % 2 == 0))


@query("WIN3_first_seen", f"WITH {MENTIONS} SELECT doc_id, mention, pos, ticker FROM firsts")
def first_seen(spark, d):
    return resolve.first_seen(fx.mentions(spark, d))


# --- aggregates and prompts ---------------------------------------------------------------------------------------
@query("AGG1_dict_build", f"WITH {KB} SELECT key, ticker FROM dictionary")
def dict_build(spark, d):
    return fx.dictionary(spark, d)


_TICKERS = f"WITH {KB}, ts AS (SELECT sector, ticker, min(item_id) AS ticker_pos FROM kb GROUP BY ALL)"


@query("AGG2_sector_list", _TICKERS + " SELECT sector, sector || ': ' || string_agg(ticker, ', ' ORDER BY ticker_pos) AS line FROM ts GROUP BY sector")
def sector_list(spark, d):
    return prompts.sector_list(fx.sectors(spark, d).withColumnRenamed("sector_pos", "ticker_pos"))


@query("AGG3_terms_list", f"""WITH {KB}, one AS (SELECT sector AS grp, ticker AS canonical, min(item_id * 100000 + alias_pos) AS pos, string_agg(alias, ', ' ORDER BY item_id * 100000 + alias_pos) AS a FROM kb GROUP BY ALL)
SELECT grp, '## ' || grp || chr(10) || string_agg('- ' || canonical || ': ' || a, chr(10) ORDER BY pos) AS text FROM one GROUP BY grp
UNION ALL SELECT DISTINCT n_name, '{prompts.NO_TERMS}' FROM nation WHERE n_name NOT IN (SELECT grp FROM one)""")
def terms_list(spark, d):
    terms = fx.kb(spark, d).select(F.col("sector").alias("grp"), F.col("ticker").alias("canonical"), "alias", (F.col("item_id") * 100000 + F.col("alias_pos")).alias("pos"))
    groups = t(spark, d, "nation").select(F.col("n_name").alias("grp")).union(terms.select("grp"))
    return prompts.terms_list(terms, groups)


@query("AGG4_kb_count", f"WITH {KB} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers FROM (SELECT DISTINCT sector, ticker FROM kb)")
def kb_count(spark, d):
    return resolve.kb_count(fx.kb(spark, d))


@query("AGG5_keep_first", """WITH lists AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), w AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS n FROM lists),
f AS (SELECT doc_id, x, min(n) AS n FROM w WHERE trim(x) <> '' GROUP BY doc_id, x), j AS (SELECT doc_id, list(x ORDER BY n) AS value FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(value, []) END AS value FROM documents LEFT JOIN j USING (doc_id)""")
def keep_first(spark, d):
    return docs(spark, d).select("doc_id", prompts.keep_first(F.split("text", " ")).alias("value"))


def vocabulary(spark, d) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("term"), F.array("p_type").alias("hints"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("logic"))


@query("AGG6_keyword_prompt", """WITH w AS (SELECT p_brand AS grp, p_partkey AS pos, unnest([p_name, p_type]) AS word, unnest([0, 1]) AS k FROM part), f AS (SELECT grp, word, min(pos * 2 + k) AS pos FROM w GROUP BY ALL)
SELECT grp, 'Terms: ' || string_agg(word, ' ' ORDER BY pos) AS prompt FROM f GROUP BY grp""")
def keyword_prompt(spark, d):
    return prompts.keyword_prompt(vocabulary(spark, d), "grp", "Terms:")


@query("AGG7_mapping_text", f"WITH {MENTIONS} SELECT doc_id, string_agg('- ' || mention || ' -> ' || ticker, chr(10) ORDER BY pos) AS mapping FROM firsts GROUP BY doc_id")
def mapping_text(spark, d):
    return prompts.mapping_text(resolve.first_seen(fx.mentions(spark, d)))


@query("AGG8_entity_text", _ENTITIES + f""", made AS (SELECT doc_id, string_agg(mention || ' (' || type || '): ' || coalesce(ticker, 'UNKNOWN') || ' [' || source || ']', chr(10) ORDER BY pos) AS entities FROM enriched GROUP BY doc_id)
SELECT doc_id, coalesce(entities, '{prompts.NO_ENTITIES}') AS entities FROM documents LEFT JOIN made USING (doc_id)""")
def entity_text(spark, d):
    return prompts.entity_text(enrich(spark, d), docs=docs(spark, d))


@query("AGG9_hint_text", "SELECT p_brand AS grp, string_agg('- ' || p_name || ' (heard as: ' || p_type || ')' || CASE WHEN p_partkey % 2 = 0 THEN ' rule: ' || p_type ELSE '' END, chr(10) ORDER BY p_partkey) AS hints_text FROM part GROUP BY 1")
def hint_text(spark, d):
    return prompts.hint_text(vocabulary(spark, d), "grp")


@query("AGG10_media_prompt", f"WITH {MEDIA} SELECT media_id, substr(concat_ws(' | ', 'Channel: ' || channel, CASE WHEN channel = 'F' THEN title END, array_to_string(tags, ' ')), 1, 1000) AS prompt FROM media")
def media_prompt(spark, d):
    return prompts.media_prompt(fx.media(spark, d), F.when(F.col("channel") == "F", F.col("title")))


@query("AGG12_cache_audit", f"""WITH {CACHE} SELECT c.ticker, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM cache) AS share, count(*) FILTER (b.ticker <> c.ticker) AS n_contradict
FROM cache c LEFT JOIN dictionary b ON b.key = c.key GROUP BY c.ticker""")
def cache_audit(spark, d):
    return resolve.cache_audit(fx.cache(spark, d), fx.dictionary(spark, d))


@query("AGG13_run_stats", f"WITH {MENTIONS} SELECT doc_id, count(*) AS n_mentions, count(DISTINCT mention) AS n_distinct, max(pos)::INTEGER AS last_pos FROM mentions GROUP BY doc_id")
def run_stats(spark, d):
    return resolve.run_stats(fx.mentions(spark, d))


@query("AGG13b_run_metrics", """SELECT count(*) AS n_chunks, count(*) FILTER (coalesce(length(text), 0) = 0) AS n_empty, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, max(length(text)) AS longest,
 sum(turn)::BIGINT AS seconds, max(turn) AS most_seconds FROM conversations""")
def run_metrics(spark, d):
    """What the run that writes the artifacts finds besides."""
    rows, seen = metrics.observed(fx.turns(spark, d), metrics.chunk_metrics("text", "turn"))
    scratch.written(rows, "observed")
    found = {k: v for k, v in seen.get.items() if not k.endswith(("_median", "_95"))}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'int' if k == 'longest' else 'long'}" for k in found))


@query("AGG13c_media_stats", """SELECT conv_id, count(*) AS n_chunks, count(*) FILTER (coalesce(length(text), 0) = 0) AS n_empty, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, max(length(text))::INTEGER AS longest,
 sum(turn)::BIGINT AS seconds, max(turn) AS most_seconds FROM conversations GROUP BY conv_id""")
def media_stats(spark, d):
    return metrics.media_stats(fx.turns(spark, d), "conv_id", "text", "turn").drop("size_median", "size_95", "seconds_median", "seconds_95")


@query("AGG14_reassemble", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_parts FROM conversations GROUP BY conv_id")
def reassemble(spark, d):
    return chunks.reassemble(fx.turns(spark, d), "conv_id", "turn", "text")


# --- chunks and windows -------------------------------------------------------------------------------------------
_PLAN = f"""WITH {MEDIA}, c AS (SELECT media_id, floor(duration_sec * 1000)::BIGINT AS l, CASE WHEN duration_sec <= 1740 THEN 45000 WHEN duration_sec <= 3600 THEN 60000 ELSE 600000 END AS c, CASE WHEN duration_sec <= 3600 THEN 15000 ELSE 20000 END AS o FROM media),
p AS (SELECT media_id, l, c, o, unnest(generate_series(0, l - 1, c - o)) AS start_ms FROM c WHERE l > 0)
SELECT media_id, (start_ms // (c - o))::INTEGER AS idx, start_ms, least(start_ms + c, l) AS end_ms FROM p"""


def _plan(spark, d, tail):
    m = fx.media(spark, d)
    config = X.tier(F.col("duration_sec"))
    return chunks.chunk_plan(m, F.floor(F.col("duration_sec") * 1000), config["chunk_sec"] * 1000, config["overlap_sec"] * 1000, tail)


@query("WIN1_chunk_plan", _PLAN)
def chunk_plan(spark, d):
    return _plan(spark, d, "all")


@query("WIN2_chunk_plan_stop", _PLAN + " WHERE start_ms = 0 OR start_ms + o < l")
def chunk_plan_stop(spark, d):
    return _plan(spark, d, "stop")


@query("WIN4_restore_order", "SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def restore_order(spark, d):
    return chunks.in_order(fx.turns(spark, d), "conv_id", "turn", "text")


def _slices(spark, d) -> DataFrame:
    """Every text as overlapping chunks of 450 characters, 150 of them shared."""
    n = F.length("text")
    return docs(spark, d).where(n > 0).select(F.col("doc_id").alias("media_id"), "text", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(300))).alias("idx", "at")).select("media_id", "idx", F.substring("text", F.col("at") + 1, F.lit(450)).alias("text"))


def _numbered_slices(spark, d) -> DataFrame:
    """As ``_slices``, of the texts with each word's number behind it, so that no overlap occurs twice, up to the first chunk that reaches the end."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    text = F.array_join(F.transform(words, lambda x, i: F.concat(x, i.cast("string"))), " ")
    rows = docs(spark, d).select(F.col("doc_id").alias("media_id"), text.alias("text")).where(F.length("text") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.length("text") - 151, F.lit(0)), F.lit(300))
    return rows.select("media_id", "text", F.posexplode(at).alias("idx", "at")).select("media_id", "idx", F.substring("text", F.col("at") + 1, F.lit(450)).alias("text"))


_NUMBERED = r"""WITH lists AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS a FROM documents),
numbered AS (SELECT doc_id AS media_id, array_to_string(list_transform(a, lambda x, i: x || (i - 1)), ' ') AS text FROM lists WHERE len(a) > 0) """


@query("WIN5_stitch", _NUMBERED + "SELECT media_id, text FROM numbered")
def stitch(spark, d):
    return chunks.stitch(_numbered_slices(spark, d))


@query("WIN6_stitch_words")
def stitch_words(spark, d):
    return chunks.stitch(_slices(spark, d), words=30)


@query("WIN7_lookback_dedupe")
def lookback_dedupe(spark, d):
    return docs(spark, d).select("doc_id", chunks.lookback_dedupe(F.col("text")).alias("value"))


@query("WIN7b_lookback_dedupe_sequence")
def lookback_dedupe_sequence(spark, d):
    return chunks.lookback_dedupe_sequence(fx.turns(spark, d).groupBy("conv_id").agg(F.array_join(prompts.ordered("text", "turn"), "\n").alias("text")), "conv_id")


@query("WIN8_carry_context","SELECT conv_id, turn, text, coalesce(lag(right(text, 300)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations")
def carry_context(spark, d):
    return chunks.carry_context(fx.turns(spark, d).select("conv_id", "turn", "text"), "conv_id", "turn", "text")


def stub(prompt: str) -> str:
    """A model for tests: capitals; it fails on prompts whose length leaves 3 when divided by 7."""
    if len(prompt) % 7 == 3:
        raise ValueError(prompt)
    return prompt.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def stub_with_context(prompt: str) -> str:
    """A model for tests whose answer depends on all of the prompt: its length and its end in capitals. It fails as ``stub`` does."""
    return f"{len(prompt)}|{stub(prompt)[-120:]}"


_OUTPUT = f"""CASE WHEN length(p) % 7 = 3 THEN text ELSE regexp_replace(CASE WHEN contains(reply, '[CONTEXT]') AND contains(x, ']') THEN string_split(x, ']')[-1] ELSE x END, '^{_WS}+|{_WS}+$', '', 'g') END AS output"""
_REPLIED = """length(p) || '|' || right(translate(p, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 120) AS reply,
 CASE WHEN contains(reply, '[CONTEXT]') THEN string_split(reply, '[CONTEXT]')[-1] ELSE reply END AS x"""


@query("WIN8b_carry_output", f"""WITH RECURSIVE ranked AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
wave AS (SELECT conv_id, turn, text, k, '' AS context, text AS p, {_REPLIED}, {_OUTPUT} FROM ranked WHERE k = 1
 UNION ALL SELECT r.conv_id, r.turn, r.text, r.k, right(w.output, 300) AS context, CASE WHEN context <> '' THEN '[CONTEXT] ' || context || ']' || chr(10) || text ELSE text END AS p, {_REPLIED}, {_OUTPUT}
 FROM (SELECT conv_id AS of, k AS before, output FROM wave) w JOIN ranked r ON r.conv_id = w.of AND r.k = w.before + 1)
SELECT conv_id, turn, text, context, output, CASE WHEN length(p) % 7 = 3 THEN 'failed' ELSE 'ok' END AS status FROM wave""")
def carry_output(spark, d):
    return infer.carry_output(fx.turns(spark, d), "conv_id", "turn", "text", stub_with_context, attempts=1, wait=0)


@query("WIN9_neighbour_check", f"""WITH {MENTIONS}, lists AS (SELECT ticker, list(sector) AS s FROM sectors GROUP BY ticker),
w AS (SELECT doc_id, pos, ticker, s, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM mentions JOIN lists USING (ticker))
SELECT doc_id, pos, ticker, coalesce(NOT list_has_any(s, b), false) AND coalesce(NOT list_has_any(s, a), false) AS odd FROM w""")
def neighbour_check(spark, d):
    return resolve.neighbour_check(fx.mentions(spark, d), fx.sectors(spark, d))


# --- sets and samples ---------------------------------------------------------------------------------------------
@query("LIM2_sample_terms", "SELECT p_name FROM (SELECT DISTINCT p_name FROM part) ORDER BY md5(p_name || 'seed'), p_name LIMIT 100")
def sample_terms(spark, d):
    return prompts.sample_terms(t(spark, d, "part").select("p_name").distinct(), "seed", 100, "p_name")


@query("SET1_vocab_union", f"WITH {KB} SELECT ticker AS term FROM kb UNION ALL SELECT alias FROM kb UNION ALL SELECT p_brand FROM part")
def vocab_union(spark, d):
    k = fx.kb(spark, d)
    return prompts.vocab_union(k.select("ticker"), k.select("alias"), t(spark, d, "part").select("p_brand"))


per_doc("SET2_distinct_set", lambda x: F.array_sort(F.array_distinct(X.candidates(_sharp(x)))), f"list_sort(list_distinct({_CANDS}))")


# --- audits -------------------------------------------------------------------------------------------------------
_PROTECTED = ["QoQ", "YoY"]
_FACTS = r"list_concat(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?'), list_filter(string_split_regex({0}, '[^\pL\pN_&-]+'), lambda x: x IN ('QoQ', 'YoY')))"


@query("SET3_retained_facts", f"""WITH raw AS (SELECT conv_id * 1000 + turn AS id, unnest({_FACTS.format("text || ' ' || turn || ' 7 YoY QoQ'")}) AS fact FROM conversations),
fixed AS (SELECT conv_id * 1000 + turn AS id, unnest({_FACTS.format("text || ' YoY'")}) AS fact FROM conversations),
d AS (SELECT id, fact, 1 AS n FROM raw UNION ALL SELECT id, fact, -1 FROM fixed)
SELECT id, fact, sum(n)::BIGINT AS n_lost FROM d GROUP BY id, fact HAVING sum(n) > 0""")
def retained_facts(spark, d):
    rows = fx.turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit(" "), "turn", F.lit(" 7 YoY QoQ")).alias("raw"), F.concat("text", F.lit(" YoY")).alias("fixed"))
    return audit.lost_facts(rows, "id", "raw", "fixed", terms=_PROTECTED)


@query("AUD1_no_bold", f"WITH {MARKDOWN} SELECT doc_id, markdown, len(regexp_extract_all(markdown, '\\*\\*[A-Z0-9&-]+\\*\\*'))::INTEGER AS n_bold, regexp_replace(markdown, '\\*\\*([A-Z0-9&-]+)\\*\\*', '\\1', 'g') AS clean FROM summary")
def no_bold(spark, d):
    return audit.bold_audit(fx.markdown(spark, d))


@query("AUD2_sections", f"""WITH {MARKDOWN}, h AS (SELECT doc_id, list_filter(string_split(markdown, chr(10)), lambda x: starts_with(x, '#')) AS h FROM summary),
n AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(h) AS x FROM h) GROUP BY doc_id, x), r AS (SELECT doc_id, list(x ORDER BY x) AS repeated FROM n WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, list_filter(['# Summary', '## Stocks', '## Risks'], lambda x: NOT list_contains(h, x)) AS missing, coalesce(repeated, []) AS repeated FROM h LEFT JOIN r USING (doc_id)""")
def sections(spark, d):
    return audit.sections(fx.markdown(spark, d), ["# Summary", "## Stocks", "## Risks"], "doc_id")


@query("AUD3_length_ratio", "SELECT conv_id, turn, coalesce(length(replace(text, 'e', ''))::DOUBLE / nullif(length(text), 0), 1.0) AS ratio, coalesce(length(replace(text, 'e', ''))::DOUBLE / nullif(length(text), 0), 1.0) < 0.9 AS too_short FROM conversations")
def length_ratio(spark, d):
    rows = fx.turns(spark, d).withColumn("fixed", F.replace("text", F.lit("e"), F.lit("")))
    return audit.length_ratio(rows, "text", "fixed").select("conv_id", "turn", "ratio", "too_short")


@query("AUD4_verify_status", f"WITH {ALL_WORDS}, u AS (SELECT DISTINCT doc_id, mention FROM all_words WHERE mention NOT IN (SELECT key FROM dictionary)) SELECT doc_id, count(*) AS n_unknown, string_agg(mention, ',' ORDER BY mention) AS unknown FROM u GROUP BY doc_id")
def verify_status(spark, d):
    return audit.verify_status(resolve.unknown(fx.all_words(docs(spark, d), "doc_id", once=True), F.broadcast(fx.dictionary(spark, d))))


@query("AUD5_bullet_detail", f"""WITH {MARKDOWN}, b AS (SELECT doc_id, list_filter(string_split(markdown, chr(10)), lambda x: starts_with(x, '- ')) AS b FROM summary)
SELECT doc_id, len(b)::INTEGER AS n_bullets, len(list_filter(b, lambda x: regexp_matches(x, '[0-9]')))::INTEGER AS n_with_number FROM b""")
def bullet_detail(spark, d):
    return audit.bullet_detail(fx.markdown(spark, d), "doc_id")


@query("AUD6_grounding", f"""WITH {MARKDOWN}, pairs AS (SELECT s.doc_id, s.markdown, o.text FROM summary s JOIN documents o USING (doc_id)),
named AS (SELECT doc_id, text, unnest(list_distinct(list_filter(string_split_regex(markdown, '[^\\pL\\pN_&-]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9&-]*')))) AS fact FROM pairs)
SELECT DISTINCT doc_id, fact FROM (SELECT doc_id, text, unnest(regexp_extract_all(markdown, '[0-9]+(?:\\.[0-9]+)?')) AS fact FROM pairs) WHERE NOT list_contains(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), fact)
UNION ALL SELECT doc_id, fact FROM named WHERE fact IN (SELECT replace(ticker, '.BK', '') FROM kb) AND NOT list_contains(string_split_regex(text, '[^\\pL\\pN_&-]+'), fact)""")
def grounding(spark, d):
    rows = fx.markdown(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return audit.grounding(rows, "doc_id", "markdown", "text", tickers=fx.kb(spark, d))


# --- model calls --------------------------------------------------------------------------------------------------
@query("INF1_render_prompt", f"WITH {MEDIA} SELECT media_id, 'Title: ' || title || ' on ' || channel AS prompt FROM media")
def render_prompt(spark, d):
    return fx.media(spark, d).select("media_id", prompts.render("Title: {title} on {channel}", title=F.col("title"), channel=F.col("channel")).alias("prompt"))


_UPPER = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("INF2_batch_call", f"SELECT conv_id, turn, text, CASE WHEN length(text) % 7 = 3 THEN text ELSE {_UPPER} END AS response, CASE WHEN length(text) % 7 = 3 THEN 3 ELSE 1 END AS attempts, CASE WHEN length(text) % 7 = 3 THEN 'failed' ELSE 'ok' END AS status FROM conversations")
def batch_call(spark, d):
    return infer.batch_call(fx.turns(spark, d).select("conv_id", "turn", "text"), "text", stub, attempts=3, wait=0)


_CALLED = f"SELECT conv_id, turn, CASE WHEN length(text) % 7 = 3 THEN '' ELSE {_UPPER} END AS response, 1 AS attempts, CASE WHEN length(text) % 7 = 3 THEN 'failed' ELSE 'ok' END AS status FROM conversations"


@query("INF3_concurrency", _CALLED)
def concurrency(spark, d):
    """Three calls at a time over all tasks, logged; what is no rate limit or time-out is not tried again."""
    log = infer.ResponseLog(spark, scratch.new_path(spark, "responses"))
    rows = fx.turns(spark, d).select("conv_id", "turn", "text")
    made = infer.batch_call(rows, "text", stub, workers=3, wait=0, fallback="empty", retry_on=lambda x: isinstance(x, TimeoutError), log=log)
    return made.select("conv_id", "turn", "response", "attempts", "status")


@query("INF5_chain", f"SELECT conv_id, turn, CASE WHEN length(x) % 7 = 3 THEN x ELSE translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS response FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g') AS x FROM conversations)")
def chain(spark, d):
    clean = lambda df: df.withColumn("text", X.collapse_ws(F.col("text")))
    call = lambda df: infer.batch_call(df, "text", stub, workers=4, attempts=1, wait=0)
    return infer.chain(fx.turns(spark, d).select("conv_id", "turn", "text"), clean, call).select("conv_id", "turn", "response")


# --- streams ------------------------------------------------------------------------------------------------------
def mention_stream(spark, d) -> DataFrame:
    return fx.mentions(spark, d).select(F.col("doc_id").alias("media_id"), "mention", F.timestamp_seconds("pos").alias("ts"))


@query("STR1_sliding_mentions", f"""WITH {MENTIONS}, w AS (SELECT doc_id AS media_id, unnest(generate_series(pos // 30 * 30 - 30, pos // 30 * 30, 30)) AS s, pos FROM mentions)
SELECT media_id, make_timestamp(s * 1000000) AS start, make_timestamp((s + 45) * 1000000) AS "end", count(*) AS n_mentions FROM w WHERE pos < s + 45 AND s >= 0 GROUP BY ALL""")
def sliding_mentions(spark, d):
    out = transcripts.replay(mention_stream(spark, d), transcripts.sliding_mentions, "complete", "sliding")
    return out.select("media_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_mentions")


@query("STR2_stream_stitch", _NUMBERED + "SELECT media_id, (greatest(length(text) - 151, 0) // 300 + 1)::INTEGER AS next_idx, text FROM numbered")
def stream_stitch(spark, d):
    return transcripts.stitched(transcripts.replay(_numbered_slices(spark, d), transcripts.stream_stitch, "update", "stitch"))


@query("STR3_stream_first_seen", f"WITH {MENTIONS} SELECT DISTINCT doc_id AS media_id, mention FROM mentions")
def stream_first_seen(spark, d):
    # An hour on, so that no row stands at the first watermark, the epoch.
    rows = mention_stream(spark, d).withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    return transcripts.replay(rows, transcripts.first_seen, "append", "first")


@query("STR4_stream_resolve", f"WITH {ALL_WORDS} SELECT doc_id AS media_id, mention, ticker FROM all_words LEFT JOIN dictionary ON mention = key")
def stream_resolve(spark, d):
    rows = fx.all_words(docs(spark, d), "doc_id").withColumnRenamed("doc_id", "media_id")
    return transcripts.replay(rows, lambda s: transcripts.stream_resolve(s, fx.dictionary(spark, d)), "append", "resolve")


@query("STR4b_stream_resolve_cache", _FUZZY.rstrip() + f""", {CACHE.replace(KB + ",", "").strip()},
codes AS MATERIALIZED (SELECT DISTINCT replace(ticker, '.BK', '') AS code FROM kb),
seen AS MATERIALIZED (SELECT mention, 1000000 + max(doc_id) AS updated_at FROM doc_words WHERE length(mention) >= 6 GROUP BY mention),
news AS (SELECT s.mention, coalesce(d.ticker, c.ticker, f.ticker) AS ticker, s.updated_at FROM seen s LEFT JOIN dictionary d ON s.mention = d.key LEFT JOIN cache c ON s.mention = c.key
 LEFT JOIN codes ON upper(s.mention) = code LEFT JOIN fuzzy f ON f.mention = s.mention WHERE coalesce(d.ticker, c.ticker) IS NOT NULL OR (code IS NULL AND f.ticker IS NOT NULL)),
every AS (SELECT key AS mention, ticker, updated_at FROM cache UNION ALL SELECT * FROM news)
SELECT mention, ticker, updated_at::BIGINT AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY updated_at DESC, ticker DESC) AS n FROM every) WHERE n = 1""")
def stream_resolve_cache(spark, d):
    """The cache after a stream has run: what it resolved exactly or nearly replaces older entries."""
    rows = fx.words(docs(spark, d), "doc_id").select(F.col("doc_id").alias("media_id"), F.col("word").alias("mention"), (F.col("doc_id") + 1000000).alias("ts"))
    table = _cache_table(spark, d, "resolve-cache")
    resolved = transcripts.resolve_all(fx.dictionary(spark, d), fx.kb(spark, d), cache_wins=False, learn=("exact", "fuzzy"))
    transcripts.replay(rows, lambda s: s, "append", "resolve", learner(table, "mentions", resolved))
    return table.table()
