"""Mentions to tickers: a layered dictionary, exact, code and fuzzy lookups, verification, enrichment.

Dictionaries are reference data of bounded size; whether a lookup is broadcast is left to the optimiser, which
knows the sizes, so a dictionary that outgrows memory is joined by a shuffle.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import LATIN, WORD, candidates, index_guard, not_blacklisted, strip_suffix

#: Shares that the mentions of one length are dealt to.
SALTS = 64

#: Bytes of a dictionary's pieces up to which they are sent to the mentions, which then don't move.
SENT = 64_000_000


def build_dictionary(aliases: DataFrame, order: list[str], include_codes: bool = True) -> DataFrame:
    """``key`` -> ``ticker``: for a lower-case alias that several tickers own the last in ``order`` wins.

    With ``include_codes`` a ticker without its suffix is a key, too, ahead of its aliases in the last column of ``order``.
    """
    rows = aliases.select(F.lower("alias").alias("key"), "ticker", *order)
    if include_codes:
        rows = rows.union(aliases.select(F.lower(F.replace("ticker", F.lit(".BK"), F.lit(""))).alias("key"), "ticker", *order[:-1], F.lit(-1).alias(order[-1])))
    return rows.groupBy("key").agg(F.max_by("ticker", F.struct(*order, "ticker")).alias("ticker"))


def overlay(base: DataFrame, cache: DataFrame, cache_wins: bool = True) -> DataFrame:
    """Both dictionaries as one; the cache's entry counts where both have one, and ``src`` says whose it is."""
    c = cache.select("key", F.col("ticker").alias("c_ticker"))
    first, second = ("c_ticker", "ticker") if cache_wins else ("ticker", "c_ticker")
    src = F.when(F.col(first).isNotNull(), "cache" if cache_wins else "kb").otherwise("kb" if cache_wins else "cache")
    return base.join(c, "key", "full_outer").select("key", F.coalesce(first, second).alias("ticker"), src.alias("src"))


def resolve_exact(mentions: DataFrame, dictionary: DataFrame, key: str = "mention") -> DataFrame:
    d = dictionary.select(F.col("key").alias("_key"), "ticker")
    return mentions.join(d, mentions[key] == d["_key"], "left").drop("_key")


def resolve_code(mentions: DataFrame, tickers: DataFrame, key: str = "mention") -> DataFrame:
    """A mention that is a bare ticker gets it with the suffix."""
    bare = tickers.select(F.replace("ticker", F.lit(".BK"), F.lit("")).alias("_code")).distinct()
    met = mentions.join(bare, F.upper(key) == F.col("_code"), "left")
    return met.select(*mentions.columns, F.when(F.col("_code").isNotNull(), F.concat("_code", F.lit(".BK"))).alias("code_ticker"))


def score(a: Column, b: Column) -> Column:
    """100 for equal strings down to 0: the share of characters that need no edit."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.round(100.0 * (1 - F.levenshtein(a, b) / longest)).cast("int")


def edit_pairs(words: DataFrame, aliases: DataFrame, threshold: int) -> DataFrame:
    """``mention``, ``alias``, ``t``, ``score`` of all pairs whose share of characters without edits reaches the threshold.

    Blocking is lossless: with at most e edits one of e + 1 pieces of the alias stands unchanged in the mention, at most
    e places away. The alias's pieces are joined to the mention's substrings of those places, so only pairs that share
    a piece are scored. Lengths differ by the allowed edits at most.
    """
    edits = lambda n: F.floor((100.5 - threshold) / 100.0 * n).cast("int")
    # For each possible length of the mention the longer of both fixes the edits; pieces follow from alias and edits.
    n = F.length("alias")
    plans = aliases.select("alias", "t", F.explode(F.sequence(F.greatest(F.lit(1), n - edits(n * 10 / 9 + 1)), n + edits(n * 10 / 9 + 1))).alias("len")).withColumn("e", edits(F.greatest("len", n))).where(F.abs(F.col("len") - n) <= F.col("e"))
    begin = lambda i: F.floor(i * n / (F.col("e") + 1)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.col("e")), lambda i: F.struct(begin(i).alias("at"), F.substring("alias", begin(i) + 1, begin(i + 1) - begin(i)).alias("piece")))
    plans = plans.select("alias", "t", "len", "e", F.explode(piece).alias("x")).select("alias", "t", "len", "e", "x.at", "x.piece")
    plans = plans.select("alias", "t", "len", "piece", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("e")), F.least(F.col("len") - F.length("piece"), F.col("at") + F.col("e")))).alias("place")).where(F.length("piece") > 0)
    plans = plans.where("place >= 0")
    # The mention's substrings of the lengths that pieces have, at their places. Lengths are few and uneven, so each is salted.
    shapes = plans.select("len", F.length("piece").alias("size"), "place").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = words.select("mention", F.length("mention").alias("len"), F.pmod(F.xxhash64("mention"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = m.join(shapes, ["len", "salt"]).select("mention", "len", "place", F.substring("mention", F.col("place") + 1, F.col("size")).alias("piece"))
    return parts.join(plans, ["len", "place", "piece"]).select("mention", "alias", "t").distinct().withColumn("score", score(F.col("mention"), F.col("alias"))).where(F.col("score") >= threshold)


def letters(word: Column) -> Column:
    """A word's letters, each with its number among equal ones: what two words have in common are these, as a set."""
    each = F.filter(F.split(word, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def sequence_pairs(words: DataFrame, aliases: DataFrame, threshold: int) -> DataFrame:
    """``mention``, ``alias``, ``t``, ``score`` of all pairs whose block-matching ratio, 2 * matched / both lengths, reaches the threshold.

    Blocking is lossless. At a ratio of r, words of n and m letters match at least k = r (n + m) / 2 of them, in order, so
    the alias loses n - k letters at most and the mention has m - k of its own at most. Each of these breaks one piece of
    the alias at most: of one piece more than both, or of its single letters, one stands unchanged in the mention, at
    most n - k places before and m - k places behind its own. Pairs that share one are held against bounds on edits and
    on letters in common, and what is left is matched in Arrow batches.
    """
    least = (threshold - 0.5) / 100 - 1e-9  # what is rounded up to the threshold
    share = least / (2 - least)
    n, m = F.length("alias"), F.col("len")
    k = F.ceil(least * (n + m) / 2).cast("int")
    # For each possible length of the mention, by which the letters lost and gained are known.
    plans = aliases.select("alias", "t", F.explode(F.sequence(F.ceil(n * share).cast("int"), F.floor(n / share).cast("int"))).alias("len"))
    plans = plans.withColumns({"lost": n - k, "own": m - k}).where("lost >= 0 and own >= 0")
    count = F.least(n, F.col("lost") + F.col("own") + 1)
    begin = lambda i: F.floor(i * n / count).cast("int")
    piece = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(begin(i).alias("at"), F.substring("alias", begin(i) + 1, begin(i + 1) - begin(i)).alias("piece")))
    plans = plans.withColumn("x", F.explode(piece)).select("alias", "t", "len", "x.piece", F.greatest(F.lit(0), F.col("x.at") - F.col("lost")).alias("first"), F.least(m - F.length("x.piece"), F.col("x.at") + F.col("own")).alias("last"))
    plans = plans.where("first <= last").select("alias", "t", "len", "piece", F.explode(F.sequence("first", "last")).alias("place"))
    shapes = plans.select("len", F.length("piece").alias("size"), "place").distinct()
    size = plans.agg(F.sum(F.octet_length("alias") + F.octet_length("piece") + 100)).first()[0] or 0
    known = words.select("mention", F.length("mention").alias("len"))
    if size <= SENT:
        plans, shapes = F.broadcast(plans), F.broadcast(shapes)
        parts = known.join(shapes, "len")
    else:  # lengths are few and uneven, so each is salted
        shapes = shapes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = known.withColumn("salt", F.pmod(F.xxhash64("mention"), F.lit(SALTS)).cast("int")).join(shapes, ["len", "salt"])
    parts = parts.select("mention", "len", "place", F.substring("mention", F.col("place") + 1, F.col("size")).alias("piece"))
    met = parts.join(plans, ["len", "place", "piece"]).select("mention", "alias", "t")
    both = F.length("mention") + F.length("alias")
    few = F.levenshtein("mention", "alias") <= (1 - least) * both
    met = met.where(F.when(few, 2 * F.size(F.array_intersect(letters(F.col("mention")), letters(F.col("alias")))) >= least * both).otherwise(False))
    near = met.distinct()

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = difflib.SequenceMatcher(None, autojunk=False)
        for frame in frames:
            ratios = []
            for mention, alias in zip(frame["mention"], frame["alias"], strict=True):
                matcher.set_seqs(mention, alias)
                ratios.append(matcher.ratio())
            yield frame.assign(ratio=ratios)

    scored = near.select("mention", "alias", "t").mapInPandas(matched, "mention string, alias string, t string, ratio double")
    return scored.select("mention", "alias", "t", F.round(100 * F.col("ratio")).cast("int").alias("score")).where(F.col("score") >= threshold)


#: How fuzzy lookups score a mention and an alias.
SCORERS = {"edits": edit_pairs, "sequence": sequence_pairs}


def fuzzy_matches(mentions: DataFrame, dictionary: DataFrame, threshold: int = 90, key: str = "mention", scorer: str = "edits") -> DataFrame:
    """The best alias of each distinct mention and the rules on it: ``mention``, ``alias``, ``ticker``, ``score``.

    ``scorer`` is 'edits' or 'sequence', see ``edit_pairs`` and ``sequence_pairs``; neither loses a pair.
    Only the best alias counts (ties: first key); it is rejected, not replaced, when a bare ticker of three characters
    or fewer scores under 100, or an all-ASCII-letters mention scores under 95.
    """
    words = mentions.select(F.col(key).alias("mention")).where(F.length(key) > 0).distinct()
    aliases = dictionary.select(F.col("key").alias("alias"), F.col("ticker").alias("t")).where(F.length("key") > 0)
    pairs = SCORERS[scorer](words, aliases, threshold)
    best = pairs.groupBy("mention").agg(F.min_by(F.struct("alias", "t", "score"), F.struct(-F.col("score"), "alias")).alias("b")).select("mention", "b.alias", F.col("b.t").alias("ticker"), "b.score")
    short = (F.length(F.replace("ticker", F.lit(".BK"), F.lit(""))) <= 3) & (F.col("score") < 100)
    plain = F.col("mention").rlike("^[A-Za-z]+$") & (F.col("score") < 95)
    return best.where(~short & ~plain)


def cascade(mentions: DataFrame, dictionary: DataFrame, tickers: DataFrame, threshold: int = 90, fuzzy: DataFrame | None = None, scorer: str = "edits") -> DataFrame:
    """Distinct mentions with ``ticker`` and ``method``: exact, code, fuzzy or none. Only what is left goes to the fuzzy join.

    ``fuzzy`` is the dictionary of the fuzzy lookup, if it isn't the same one: entries learned by it are no aliases.
    """
    words = mentions.select("mention").distinct()
    first = resolve_code(resolve_exact(words, dictionary), tickers)
    near = fuzzy_matches(first.where("ticker is null and code_ticker is null"), dictionary if fuzzy is None else fuzzy, threshold, scorer=scorer)
    met = first.join(near.select("mention", F.col("ticker").alias("f_ticker")), "mention", "left")
    method = F.when(F.col("ticker").isNotNull(), "exact").when(F.col("code_ticker").isNotNull(), "code").when(F.col("f_ticker").isNotNull(), "fuzzy").otherwise("none")
    return met.select("mention", F.coalesce("ticker", "code_ticker", "f_ticker").alias("ticker"), method.alias("method"))


def unknown(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    return mentions.join(dictionary, mentions["mention"] == dictionary["key"], "left_anti")


def first_seen(mentions: DataFrame, doc: str = "doc_id", mention: str = "mention", pos: str = "pos") -> DataFrame:
    """The first occurrence of each mention in its document."""
    return mentions.groupBy(doc, mention).agg(F.min_by(F.struct(*[c for c in mentions.columns if c not in (doc, mention)]), pos).alias("_x")).select(doc, mention, "_x.*")


def verify_traded(rows: DataFrame, quotes: DataFrame, asof: Column, days: int) -> DataFrame:
    """Rows whose ticker has a quote in the ``days`` days up to ``asof``."""
    recent = quotes.where((F.col("ts") <= asof) & (F.col("ts") >= asof - F.expr(f"interval {days} days"))).select("ticker").distinct()
    return rows.join(recent, "ticker", "left_semi")


def first_verified(rows: DataFrame, traded: DataFrame, orders: list[str], key: str = "code") -> DataFrame:
    """Of each code's spellings, tried in order (suffixes), the first that is traded."""
    tries = F.array(*[F.struct(F.lit(i).alias("prio"), F.concat(F.col(key), F.lit(s)).alias("ticker")) for i, s in enumerate(orders)])
    return rows.select(key, F.explode(tries).alias("x")).select(key, "x.*").join(traded.select("ticker").distinct(), "ticker", "left_semi").groupBy(key).agg(F.min_by("ticker", "prio").alias("ticker"))


def top_k_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k first hits of each query, by rank."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("_n") <= k).drop("_n")


def priority(docs: DataFrame, title: Column, tickers: DataFrame, id_col: str = "doc_id", least: int = 2) -> DataFrame:
    """``id_col`` and ``token``: the words of a title that are bare tickers, each once."""
    tokens = docs.select(id_col, F.explode(F.array_distinct(F.split(title, r"[^\p{L}\p{N}_]+"))).alias("token")).where(F.length("token") >= least)
    return tokens.join(tickers.select(strip_suffix(F.col("ticker")).alias("token")).distinct(), "token", "left_semi").select(id_col, "token")


def kb_count(kb: DataFrame) -> DataFrame:
    """One row: pairs of sector and ticker, and distinct tickers."""
    return kb.select("sector", "ticker").distinct().agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"))


def run_stats(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document its mentions, distinct ones, and the last place."""
    return mentions.groupBy(doc).agg(F.count("*").alias("n_mentions"), F.count_distinct("mention").alias("n_distinct"), F.max("pos").alias("last_pos"))


def hits_to_candidate(hits: DataFrame, k: int) -> DataFrame:
    """From the first k hits of a query: the first ``X.BK``, else the first allowed token."""
    text = hits.where(F.col("rank") <= k).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "body"))), lambda x: F.concat_ws(" ", x["title"], x["body"])), " ").alias("text"))
    suffixed = F.upper(F.regexp_extract("text", rf"({LATIN}{{2,8}}\.[Bb][Kk])", 1))
    return text.select("query", F.coalesce(F.when(suffixed != "", suffixed), F.get(not_blacklisted(candidates(F.col("text"))), F.lit(0))).alias("candidate"))


def hits_to_candidate_v2(hits: DataFrame, k: int) -> DataFrame:
    """As above, 2 to 6 capitals without upper-casing, link text too, each token once."""
    text = hits.where(F.col("rank") <= k).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "body", "href"))), lambda x: F.concat_ws(" ", x["title"], x["body"], x["href"])), " ").alias("text"))
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?<!{WORD})([A-Z]{{2,6}})(?!{WORD})"), F.lit(1)))
    return text.select("query", F.get(not_blacklisted(tokens), F.lit(0)).alias("candidate"))


def enrich(entities: DataFrame, lookup: DataFrame) -> DataFrame:
    """Stocks and companies get a ticker by their mention, the others pass; ``source`` says how."""
    wanted = F.col("type").isin("stock_th", "company")
    l = lookup.select(F.col("key").alias("_key"), F.col("ticker").alias("_ticker"))  # noqa: E741
    met = entities.join(l, wanted & (F.col("mention") == F.col("_key")), "left")
    good = index_guard(F.col("_ticker"))
    source = F.when(~wanted, "ner_only").when(good, "ddg+yf").otherwise("ddg_only_or_failed")
    return met.select(*entities.columns, F.when(good, F.col("_ticker")).alias("ticker"), source.alias("source"))


def sector_rollup(mentions: DataFrame, sectors: DataFrame, fan_out: bool = False) -> DataFrame:
    """Mentions by sector and ticker with subtotals; a ticker in several sectors counts in its first unless ``fan_out``."""
    home = sectors.select("ticker", "sector").distinct() if fan_out else sectors.groupBy("ticker").agg(F.min_by("sector", F.struct("sector_pos", "sector")).alias("sector"))
    return mentions.join(home, "ticker").rollup("sector", "ticker").agg(F.count("*").alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"))


def neighbour_check(mentions: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mentions whose sectors meet neither neighbour's: ``doc_id``, ``pos``, ``ticker``, ``odd``."""
    lists = sectors.groupBy("ticker").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    met = mentions.join(lists, "ticker").withColumn("before", F.lag("sectors").over(w)).withColumn("after", F.lead("sectors").over(w))
    apart = lambda c: F.coalesce(~F.arrays_overlap("sectors", c), F.lit(False))
    return met.select("doc_id", "pos", "ticker", (apart("before") & apart("after")).alias("odd"))


def cache_audit(cache: DataFrame, base: DataFrame) -> DataFrame:
    """Per target of the cache: entries, share of all, and entries that contradict the base."""
    total = cache.agg(F.count("*").alias("total"))
    b = base.select(F.col("key").alias("_key"), F.col("ticker").alias("_ticker"))
    met = cache.join(b, cache["key"] == b["_key"], "left")
    counts = met.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_ticker") != F.col("ticker"), 1).otherwise(0)).alias("n_contradict"))
    return counts.join(F.broadcast(total)).select("ticker", "n", (F.col("n") / F.col("total")).alias("share"), "n_contradict")  # the total is one row
