"""Audits of corrected texts and summaries against what they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import no_bold

NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def bold_audit(df: DataFrame, text: str = "markdown") -> DataFrame:
    return df.withColumn("n_bold", F.regexp_count(text, F.lit(r"\*\*[A-Z0-9&-]+\*\*"))).withColumn("clean", no_bold(F.col(text)))


def sections(df: DataFrame, required: list[str], id_col: str, text: str = "markdown") -> DataFrame:
    """Per document the required headings that are missing and the headings that repeat."""
    heads = F.filter(F.split(text, "\n"), lambda x: x.startswith("#"))
    known = F.array(*map(F.lit, required))
    return df.withColumn("_h", heads).select(id_col, F.array_except(known, "_h").alias("missing"), F.array_sort(F.array_distinct(F.filter("_h", lambda x: F.size(F.filter("_h", lambda y: y == x)) > 1))).alias("repeated"))


def length_ratio(df: DataFrame, raw: str, corrected: str, least: float = 0.9) -> DataFrame:
    ratio = F.length(corrected) / F.when(F.length(raw) > 0, F.length(raw))
    return df.withColumn("ratio", F.coalesce(ratio, F.lit(1.0))).withColumn("too_short", F.col("ratio") < least)


def verify_status(unknown: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document the number of its unknown mentions and their list. The set is gathered once and counted, so a row a document is shuffled."""
    sets = unknown.groupBy(doc).agg(F.array_sort(F.collect_set("mention")).alias("_u"))
    return sets.select(doc, F.size("_u").cast("long").alias("n_unknown"), F.array_join("_u", ",").alias("unknown"))


def bullet_detail(df: DataFrame, id_col: str, text: str = "markdown") -> DataFrame:
    """Share of bullets that carry a number."""
    marks = F.filter(F.split(text, "\n"), lambda x: x.startswith("- "))
    return df.withColumn("_b", marks).select(id_col, F.size("_b").alias("n_bullets"), F.size(F.filter("_b", lambda x: x.rlike("[0-9]"))).alias("n_with_number"))


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """A text's words, whole: letters, digits, and the marks that tickers have within."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_&-]+"), lambda x: x != "")


def facts(text: Column, pattern: str = NUMBER, terms: Sequence[str] = ()) -> Column:
    """What a text states that must not get lost: matches of ``pattern`` (by default numbers), and the protected ``terms`` among its words."""
    found = F.coalesce(_tokens(text, pattern), F.array().cast("array<string>"))
    return F.concat(found, F.coalesce(F.filter(words(text), lambda x: x.isin(*terms)), F.array().cast("array<string>"))) if terms else found


def lost_facts(df: DataFrame, id_col: str, raw: str, corrected: str, pattern: str = NUMBER, terms: Sequence[str] = ()) -> DataFrame:
    """Facts (by default numbers), and protected ``terms``, that the corrected text has less often than the raw one."""
    count = lambda c, sign: df.select(id_col, F.explode(facts(F.col(c), pattern, terms)).alias("fact"), F.lit(sign).alias("n"))
    return count(raw, 1).union(count(corrected, -1)).groupBy(id_col, "fact").agg(F.sum("n").alias("n_lost")).where("n_lost > 0")


def grounding(df: DataFrame, id_col: str, summary: str, source: str, pattern: str = NUMBER, tickers: DataFrame | None = None) -> DataFrame:
    """Facts of the summary that its source does not have: matches of ``pattern`` and, with ``tickers`` (``ticker``), bare tickers among its words."""
    found = df.select(id_col, F.explode(F.array_except(facts(F.col(summary), pattern), facts(F.col(source), pattern))).alias("fact"))
    if tickers is None:
        return found
    capitals = lambda c: F.coalesce(F.filter(words(F.col(c)), lambda x: x.rlike("^[A-Z][A-Z0-9&-]*$")), F.array().cast("array<string>"))
    named = df.select(id_col, F.explode(F.array_except(capitals(summary), capitals(source))).alias("fact"))
    bare = tickers.select(F.replace("ticker", F.lit(".BK"), F.lit("")).alias("fact")).distinct()
    return found.union(named.join(bare, "fact", "left_semi").select(id_col, "fact"))
