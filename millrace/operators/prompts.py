"""Ordered lists and texts made from tables: sector and term lists, hints, mappings, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import cap

#: What stands in place of a list that is empty, and of a vocabulary without a base text, unless the caller says otherwise.
NO_TERMS = "(no terms)"
NO_ENTITIES = "(no entities)"
FALLBACK_CONTEXT = "Terms:"


def ordered(value: str, *order: str) -> Column:
    """Values of a group in order, as an array (an aggregate)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def or_notice(texts: DataFrame, wanted: DataFrame, key: str, text: str, notice: str) -> DataFrame:
    """A text for each ``key`` of ``wanted``: its own, or the notice where ``texts`` has none."""
    return wanted.select(key).distinct().join(texts, key, "left").select(key, F.coalesce(text, F.lit(notice)).alias(text))


def sector_list(tickers: DataFrame, style: str = "colon") -> DataFrame:
    """Per sector its tickers in order as one line: ``sector: A, B`` or ``[sector] A B``."""
    lists = tickers.groupBy("sector").agg(ordered("ticker", "ticker_pos").alias("t"))
    line = F.concat("sector", F.lit(": "), F.array_join("t", ", ")) if style == "colon" else F.concat(F.lit("["), "sector", F.lit("] "), F.array_join("t", " "))
    return lists.select("sector", line.alias("line"))


def terms_list(terms: DataFrame, groups: DataFrame | None = None, notice: str = NO_TERMS) -> DataFrame:
    """Per group a heading and one line a canonical term with its aliases; the notice for those of ``groups`` (grp) that have no term."""
    one = terms.groupBy("grp", "canonical").agg(F.min("pos").alias("pos"), F.array_join(ordered("alias", "pos"), ", ").alias("aliases"))
    made = one.withColumn("line", F.concat(F.lit("- "), "canonical", F.lit(": "), "aliases")).groupBy("grp").agg(F.concat(F.lit("## "), F.first("grp"), F.lit("\n"), F.array_join(ordered("line", "pos", "canonical"), "\n")).alias("text"))
    return made if groups is None else or_notice(made, groups, "grp", "text", notice)


def keep_first(values: Column) -> Column:
    """Each non-blank string once, in order of first occurrence."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")))


def keyword_prompt(vocabulary: DataFrame, group: str, base: str | None, extra: str | None = None, fallback: str = FALLBACK_CONTEXT) -> DataFrame:
    """Per group the base text, then its terms and hints, each once, in order.

    ``extra`` stands in front of the base; a blank or missing base gives way to ``fallback``, without ``extra``.
    """
    lists = vocabulary.groupBy(group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "hints"))), lambda x: F.concat(F.array(x["term"]), F.coalesce(x["hints"], F.array().cast("array<string>"))))).alias("w"))
    front = " ".join(x.strip() for x in (extra or "", base) if x.strip()) if base and base.strip() else fallback.strip()
    return lists.select(group, F.trim(F.concat(F.lit(front), F.lit(" "), F.array_join(keep_first(F.transform("w", lambda x: F.trim(x))), " "))).alias("prompt"))


def mapping_text(resolved: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document the lines ``- mention -> TICKER`` of its first mentions, in order."""
    line = resolved.withColumn("_line", F.concat(F.lit("- "), "mention", F.lit(" -> "), "ticker"))
    return line.groupBy(doc).agg(F.array_join(ordered("_line", "pos"), "\n").alias("mapping"))


def entity_text(entities: DataFrame, doc: str = "doc_id", docs: DataFrame | None = None, notice: str = NO_ENTITIES) -> DataFrame:
    """Per document one line an entity, with where its ticker comes from; the notice for those of ``docs`` that have none."""
    line = entities.withColumn("_line", F.format_string("%s (%s): %s [%s]", "mention", "type", F.coalesce("ticker", F.lit("UNKNOWN")), F.coalesce("source", F.lit("?"))))
    made = line.groupBy(doc).agg(F.array_join(ordered("_line", "pos"), "\n").alias("entities"))
    return made if docs is None else or_notice(made, docs, doc, "entities", notice)


def hint_text(vocabulary: DataFrame, group: str) -> DataFrame:
    """Per group one line a term, with its hints and rule where it has them."""
    line = F.concat(F.lit("- "), "term", F.when(F.size("hints") > 0, F.concat(F.lit(" (heard as: "), F.array_join("hints", ", "), F.lit(")"))).otherwise(""), F.coalesce(F.concat(F.lit(" rule: "), "logic"), F.lit("")))
    return vocabulary.withColumn("_line", line).groupBy(group).agg(F.array_join(ordered("_line", "pos"), "\n").alias("hints_text"))


def media_prompt(media: DataFrame, title: Column | str = "title", terms: Sequence[str] = (), most: int = 1000) -> DataFrame:
    """``media_id`` and ``prompt``: channel, title, tags and fixed terms, as far as there are any, parted by bars and cut at ``most``."""
    title = F.col(title) if isinstance(title, str) else title
    parts = [F.concat(F.lit("Channel: "), "channel"), title, F.array_join("tags", " "), F.lit(" ".join(terms)) if terms else F.lit(None).cast("string")]
    return media.select("media_id", cap(F.concat_ws(" | ", *parts), most).alias("prompt"))


def sample_terms(terms: DataFrame, seed: str, n: int, term: str = "term") -> DataFrame:
    """n terms in an order that the seed fixes: a repeatable random sample."""
    return terms.orderBy(F.md5(F.concat(F.col(term), F.lit(seed)).cast("binary")), term).limit(n)


def vocab_union(*columns: DataFrame) -> DataFrame:
    """One column ``term`` of all rows of one-column tables, repeats kept."""
    out = columns[0].toDF("term")
    for more in columns[1:]:
        out = out.union(more.toDF("term"))
    return out


def render(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` places filled from columns."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
