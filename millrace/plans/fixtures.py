"""Tables that the queries derive from the given ones, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resolve import build_dictionary


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def words(df: DataFrame, *keep: str) -> DataFrame:
    """Lower-case words of six letters or more with their place."""
    return df.select(*keep, F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "word")).where(F.length("word") >= 6)


def all_words(df: DataFrame, *keep: str, once: bool = False) -> DataFrame:
    """Lower-case words of any letters and length; with ``once`` each a single time a text."""
    found = F.split(F.lower("text"), r"[^\p{L}]+")
    return df.select(*keep, F.explode(F.array_distinct(found) if once else found).alias("mention")).where("mention <> ''")


def kb(spark: SparkSession, d: str) -> DataFrame:
    """Aliases from the benchmark's words: item_id, alias_pos, alias, ticker, sector."""
    rows = words(t(spark, d, "benchmark"), "item_id")
    region = t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    rows = rows.select("item_id", F.col("pos").alias("alias_pos"), F.col("word").alias("alias"), F.concat(F.lit("T"), F.col("item_id") % 16, F.lit(".BK")).alias("ticker"))
    return rows.join(region, F.col("item_id") % 5 == F.col("r_regionkey")).drop("r_regionkey")


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return build_dictionary(kb(spark, d), ["item_id", "alias_pos"], include_codes=False)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, mention, ticker."""
    m = words(t(spark, d, "documents"), "doc_id").withColumnRenamed("word", "mention")
    return m.join(dictionary(spark, d), F.col("mention") == F.col("key")).select("doc_id", "pos", "mention", "ticker")


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """ticker, sector, sector_pos (first item of the sector)."""
    return kb(spark, d).groupBy("ticker", "sector").agg(F.min("item_id").alias("sector_pos"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Learned entries: brands, and dictionary keys with another ticker: key, ticker, updated_at."""
    part = t(spark, d, "part").groupBy(F.lower("p_brand").alias("key")).agg(F.concat(F.lit("T"), F.max(F.col("p_partkey") % 16), F.lit(".BK")).alias("ticker"), F.max("p_partkey").alias("updated_at"))
    wrong = dictionary(spark, d).select("key", F.concat(F.lit("W"), F.length("key"), F.lit(".BK")).alias("ticker"), F.length("key").cast("long").alias("updated_at")).where(F.length("key") % 3 == 0)
    return part.union(wrong)


def media(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("media_id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("description"), F.array("o_orderstatus").alias("tags"), F.col("o_orderstatus").alias("channel"), (F.col("o_totalprice") / 60).cast("double").alias("duration_sec"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of the tickers with even numbers; all events take part."""
    return t(spark, d, "events").select(F.concat(F.lit("T"), F.col("user_id") % 8 * 2, F.lit(".BK")).alias("ticker"), "ts", F.col("value").alias("close"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages")
    body = F.regexp_replace("html", "<[^>]*>", " ")
    return p.select((F.col("page_id") % 20).alias("query"), F.floor(F.col("page_id") / 20).alias("rank"), F.col("url").alias("href"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("body"))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """A summary a document: headings, and a bullet a first mention, marked in three ways."""
    m = mentions(spark, d).groupBy("doc_id", "mention", "ticker").agg(F.min("pos").alias("pos"))
    code = F.replace("ticker", F.lit(".BK"), F.lit(""))
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("* "), code, F.lit(" "), "mention")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  * **"), code, F.lit("** "), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("- **"), code, F.lit("**")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mention", line.alias("l")))), lambda x: x["l"])
    heads = F.when(F.col("doc_id") % 2 == 0, F.lit("# Summary\n## Stocks\n")).otherwise(F.lit("# Summary\n# Summary\n"))
    return m.groupBy("doc_id").agg(lines.alias("l")).select("doc_id", F.concat(heads, F.array_join("l", "\n")).alias("markdown"))


KB = """
words AS (SELECT item_id, unnest(a) AS alias, generate_subscripts(a, 1) - 1 AS alias_pos
          FROM (SELECT item_id, string_split_regex(lower(text), '[^a-z]+') AS a FROM benchmark)),
kb AS (SELECT item_id, alias_pos, alias, 'T' || (item_id % 16) || '.BK' AS ticker, r_name AS sector
       FROM words JOIN region ON r_regionkey = item_id % 5 WHERE length(alias) >= 6),
dictionary AS (SELECT alias AS key, arg_max(ticker, item_id * 100000 + alias_pos) AS ticker FROM kb GROUP BY alias),
sectors AS (SELECT ticker, sector, min(item_id) AS sector_pos FROM kb GROUP BY ticker, sector)"""
MENTIONS = KB + """,
doc_words AS (SELECT doc_id, unnest(a) AS mention, generate_subscripts(a, 1) - 1 AS pos
              FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS a FROM documents)),
mentions AS (SELECT doc_id, pos, mention, ticker FROM doc_words JOIN dictionary ON mention = key WHERE length(mention) >= 6),
firsts AS (SELECT doc_id, mention, ticker, min(pos) AS pos FROM mentions GROUP BY ALL)"""
ALL_WORDS = KB + r""",
every_word AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\pL]+')) AS mention FROM documents),
all_words AS (SELECT doc_id, mention FROM every_word WHERE mention <> '')"""
CACHE = KB + """,
cache AS (SELECT lower(p_brand) AS key, 'T' || max(p_partkey % 16) || '.BK' AS ticker, max(p_partkey)::BIGINT AS updated_at FROM part GROUP BY 1
          UNION ALL SELECT key, 'W' || length(key) || '.BK', length(key)::BIGINT FROM dictionary WHERE length(key) % 3 = 0)"""
MEDIA = """
media AS (SELECT o_orderkey AS media_id, o_orderpriority AS title, NULL::VARCHAR AS description, [o_orderstatus] AS tags,
                 o_orderstatus AS channel, (o_totalprice / 60)::DOUBLE AS duration_sec FROM orders)"""
QUOTES = """
quotes AS (SELECT 'T' || (user_id % 8 * 2) || '.BK' AS ticker, ts, value AS close FROM events)"""
HITS = """
hits AS (SELECT page_id % 20 AS query, page_id // 20 AS rank, url AS href, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages)"""
MARKDOWN = MENTIONS + """,
summary AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# Summary' || chr(10) || '## Stocks' || chr(10) ELSE '# Summary' || chr(10) || '# Summary' || chr(10) END
            || string_agg(CASE doc_id % 3 WHEN 0 THEN '* ' || replace(ticker, '.BK', '') || ' ' || mention
                          WHEN 1 THEN '  * **' || replace(ticker, '.BK', '') || '** ' || pos ELSE '- **' || replace(ticker, '.BK', '') || '**' END,
                          chr(10) ORDER BY pos, mention) AS markdown FROM firsts GROUP BY doc_id)"""
