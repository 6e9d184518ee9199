"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four fixed forms: e-mail, IP, card and phone. What stands about an identifier, and what it looks
like, are its patterns: the last word before it, the last two, the word after it, both neighbours, the marks that join it
to the word before, and its shape (letters and digits as classes, runs with their lengths). Spark keeps the graph of
patterns and instances (the strings found there: the seeds, and unseen identifiers, words of six characters or more with
a digit) and scores it in rounds:

* A pattern's confidence is the share of known identifiers among all its distinct instances. It is kept if at least
  ``MIN_SUPPORT`` are known, the confidence reaches ``MIN_CONFIDENCE``, and confidence times log2 of the known ones
  reaches ``MIN_STRENGTH``: a pattern seen often with identifiers counts for more than one seen seldom.
* An unseen identifier is taken over when the kept patterns of at least two sorts that it has leave little doubt (noisy
  or over ``MIN_INSTANCE``). Its kind is the one that those patterns' known instances have most of.
* What is taken over counts as known in the next round. Rounds go on until one takes nothing; each takes at least one of
  finitely many identifiers. In the end the occurrences of the new instances join the seeds' spans.

Counts go by distinct (pattern, instance) pairs with partial sums first, so a pattern or a number that a third of
all rows hold costs a task one row a pair. Texts are read once for the seeds and never shuffled; positions of new
instances are made for the texts that hold one.

Positions are code points, ends exclusive. Regular expressions carry look-behinds and possessive repeats that do
not change what the plain forms match but keep long runs linear. Words of context are looked for in the ``AROUND``
characters before and after an identifier; a word that is longer than that counts by its nearest ones.

Defined cases: a null or empty text has no span. Repeated rows are answered as often as they occur. Spans of
different kinds may overlap; ``redact`` joins them. Without seeds there are no patterns. Extra columns are ignored,
and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm.common import free_prefix

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single blanks or hyphens between, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![0-9])(?![ -][0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: An unseen identifier: a word of six characters or more that holds a digit.
UNSEEN = r"(?<![\p{L}\p{N}_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
#: Cheap tests that must hold before a form is looked for.
MAY_HOLD = {"email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9][ ().0-9-]"}
FORMS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
AROUND = 80
STRIDE = 256
MIN_SUPPORT, MIN_CONFIDENCE, MIN_STRENGTH, MIN_INSTANCE = 4, 0.5, 1.5, 0.8

_SPAN = "struct<kind:string,start:int,end:int,found:string,before:string,after:string>"


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the check digit of cards."""

    def value(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """Whether a match of the form is kept."""
    if kind == "ip":
        return ~F.exists(F.split(found, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) > 3) | (F.coalesce(F.try_to_number(F.substring(x, -4, 4), F.lit("9999")), F.lit(0)) > 255))
    if kind == "card":
        return luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def about(i: Column) -> list[Column]:
    """``before`` and ``after`` of the match i: the ends of the gaps next to it."""
    return [F.right(F.get("_g", i), F.lit(AROUND)).alias("before"), F.left(F.get("_g", i + 1), F.lit(AROUND)).alias("after")]


def spans_of(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """``df`` with the column ``kind``: array of (kind, start, end, found, before, after), the text's matches that are kept."""
    here, form = F.col(text).rlike(MAY_HOLD[kind]), FORMS[kind]
    df = df.withColumn("_m", F.when(here, F.regexp_extract_all(text, F.lit(form), F.lit(0))))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(text, form, -1)))
    # A match starts after the gaps and matches before it. Their lengths are summed by runs of STRIDE matches first, so
    # that a text full of matches doesn't sum all that is before each of them.
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    df = df.withColumn("_l", F.when(F.size("_m") > 0, F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, x: F.length(g) + F.length(x))))
    runs = F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / STRIDE).cast("int"))
    df = df.withColumn("_s", F.when(F.size("_l") > 0, F.transform(runs, lambda r: total(F.slice("_l", r * STRIDE + 1, F.lit(STRIDE))))))
    df = df.withColumn("_p", F.transform("_s", lambda _, r: total(F.slice("_s", F.lit(1), r))))
    run = lambda i: F.floor(i / STRIDE).cast("int")
    start = lambda i: F.get("_p", run(i)) + total(F.slice("_l", run(i) * STRIDE + 1, i % STRIDE)) + F.length(F.get("_g", i))
    rows = F.transform("_m", lambda x, i: F.struct(F.lit(kind).alias("kind"), start(i).alias("start"), (start(i) + F.length(x)).alias("end"), x.alias("found"), *about(i)))
    df = df.withColumn(kind, F.when(F.size("_m") > 0, F.filter(rows, lambda s: holds(kind, s["found"]))))
    return df.drop("_m", "_g", "_l", "_s", "_p")


def shape(found: Column) -> Column:
    """An identifier's look: each run of letters or digits as its class and length; other characters stand for themselves.

    Runs of letters and digits that alternate three times or more are one run of hexadecimal digits or of mixed characters.
    """
    mixed = F.when(found.rlike("^(?:[0-9]+[A-Za-z]+|[A-Za-z]+[0-9]+){2,}[0-9A-Za-z]*$"), F.concat(F.when(found.rlike("^[0-9A-Fa-f]+$"), F.lit("hex ")).otherwise(F.lit("mixed ")), F.length(found).cast("string")))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a")
    runs = F.regexp_extract_all(classes, F.lit("9+|A+|a+|[^9Aa]+"), F.lit(0))
    return F.coalesce(mixed, F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[9Aa]"), F.concat(F.left(r, F.lit(1)), F.length(r).cast("string"))).otherwise(r)), ""))


def patterns(found: Column, before: Column, after: Column) -> Column:
    """The patterns of an identifier as (sort, pattern)."""
    low, then = F.lower(before), F.lower(after)
    one = F.regexp_extract(low, r"(\p{L}+)[^\p{L}]*$", 1)
    two = F.regexp_extract(low, r"(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}]*$", 1)
    joint = F.regexp_extract(low, r"\p{L}([^\p{L}]*)$", 1)
    following = F.regexp_extract(then, r"^[^\p{L}]*(\p{L}+)", 1)
    made = [
        ("before", F.when(one != "", one)),
        ("two before", F.when(two != "", F.concat_ws(" ", two, one))),
        ("after", F.when(following != "", following)),
        ("both", F.when((one != "") & (following != ""), F.concat_ws(" _ ", one, following))),
        ("joint", F.when((one != "") & (F.trim(joint) != ""), F.concat(one, joint))),
        ("shape", shape(found)),
    ]
    return F.filter(F.array(*[F.struct(F.lit(sort).alias("sort"), p.alias("pattern")) for sort, p in made]), lambda x: x["pattern"].isNotNull())


def seed_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its seeds, and the unseen identifiers with what stands about them. Written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = reduce(spans_of, KINDS, rows)
    rows = rows.withColumn("_m", F.when(F.col("text").rlike(r"[0-9]"), F.regexp_extract_all("text", F.lit(UNSEEN), F.lit(0))))
    rows = rows.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", UNSEEN, -1)))
    unseen = F.when(F.size("_m") > 0, F.transform("_m", lambda x, i: F.struct(x.alias("found"), *about(i))))
    base = F.flatten(F.array(*[F.coalesce(F.col(k), F.array().cast(f"array<{_SPAN}>")) for k in KINDS]))
    return scratch.written(rows.select("doc_id", F.xxhash64("text").alias("version"), base.alias("base"), unseen.alias("unseen")), "pii-seeds")


def pattern_graph(seeds: DataFrame) -> DataFrame:
    """Distinct ``found``, ``kind`` (null: unseen), ``sort`` and ``pattern``."""
    known = seeds.select(F.explode("base").alias("s")).select("s.found", "s.kind", "s.before", "s.after")
    # A seed's inner parts look like unseen identifiers too; they aren't. No identifier spans the line ends between seeds.
    own = F.array_join(F.transform("base", lambda b: b["found"]), "\n")
    fresh = seeds.where(F.size("unseen") > 0).withColumn("own", own).select(F.explode(F.filter("unseen", lambda u: ~F.contains(F.col("own"), u["found"]))).alias("s"))
    every = known.union(fresh.select("s.found", F.lit(None).cast("string"), "s.before", "s.after"))
    return every.select("found", "kind", F.explode(patterns(F.col("found"), F.col("before"), F.col("after"))).alias("p")).select("found", "kind", "p.sort", "p.pattern").distinct()


def kept_patterns(graph: DataFrame, min_support: int, min_confidence: float, min_strength: float) -> DataFrame:
    """``sort``, ``pattern``, ``confidence`` and ``kinds`` (how many known instances of each kind) of the patterns that are kept."""
    one = graph.groupBy("sort", "pattern", "found").agg(F.max("kind").alias("kind"))  # an instance counts once, known if it is anywhere
    every = one.groupBy("sort", "pattern").agg(F.count("*").alias("all"), F.count("kind").alias("known"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
    every = every.withColumn("confidence", F.col("known") / F.col("all")).where((F.col("known") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("confidence") * F.log2("known") >= min_strength))
    return every.select("sort", "pattern", "confidence", *KINDS)


def taken_over(graph: DataFrame, kept: DataFrame, min_instance: float) -> DataFrame:
    """``found`` and ``kind`` of the unseen identifiers that the kept patterns leave little doubt about."""
    known = graph.where("kind is not null").select("found").distinct()
    met = graph.where("kind is null").select("found", "sort", "pattern").join(known, "found", "left_anti").join(kept, ["sort", "pattern"])
    # Of each sort the surest pattern: a place that is seen several times tells no more than once.
    by_sort = met.groupBy("found", "sort").agg(F.max("confidence").alias("confidence"), *[F.sum(F.col("confidence") * F.col(k)).alias(k) for k in KINDS])
    odds = by_sort.groupBy("found").agg((1 - F.exp(F.sum(F.log(F.lit(1.000001) - F.col("confidence"))))).alias("score"), F.count("*").alias("sorts"), *[F.sum(k).alias(k) for k in KINDS])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("weight"), F.lit(-n).alias("turn"), F.lit(k).alias("kind")) for n, k in enumerate(KINDS)]))["kind"]
    return odds.where((F.col("score") >= min_instance) & (F.col("sorts") >= 2)).select("found", best.alias("kind"))


def bootstrap(seeds: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_strength: float = MIN_STRENGTH, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """``kind`` and ``found`` of the identifiers that the patterns discover."""
    graph = scratch.written(pattern_graph(seeds), "pii-graph")
    taken: DataFrame | None = None
    while True:
        now = graph
        if taken is not None:
            now = graph.join(taken.select("found", F.col("kind").alias("new")), "found", "left").select("found", F.coalesce("kind", "new").alias("kind"), "sort", "pattern")
        best = scratch.written(taken_over(now, kept_patterns(now, min_support, min_confidence, min_strength), min_instance), "pii-taken")
        if best.isEmpty():
            break
        taken = best if taken is None else scratch.written(taken.union(best), "pii-taken")
    return taken.select("kind", "found") if taken is not None else graph.where("false").select("kind", "found")


def added_spans(docs: DataFrame, seeds: DataFrame, taken: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Occurrences of the discovered identifiers: ``doc_id``, ``version`` and their spans."""
    hold = seeds.where(F.size("unseen") > 0).select("doc_id", "version", F.explode("unseen.found").alias("found")).join(taken, "found").select("doc_id", "version").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text")).join(hold, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    rows = rows.withColumn("_m", F.regexp_extract_all("text", F.lit(UNSEEN), F.lit(0))).withColumn("_g", F.split("text", UNSEEN, -1))
    parts = rows.select("doc_id", "version", F.posexplode(F.arrays_zip(F.slice("_g", F.lit(1), F.size("_m")).alias("gap"), F.col("_m").alias("found"))).alias("pos", "x")).select("doc_id", "version", "pos", F.length("x.gap").alias("gap"), F.col("x.found").alias("found"))
    upto = Window.partitionBy("doc_id", "version").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one text's words
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(upto))
    return parts.join(taken, "found").groupBy("doc_id", "version").agg(F.collect_list(F.struct("kind", (F.col("end") - F.length("found")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``version`` (hash of its text), ``base`` and ``spans``, arrays of (kind, start, end) by kind, then start."""
    seeds = seed_table(docs, id_col, text_col)
    added = added_spans(docs, seeds, bootstrap(seeds), id_col, text_col)
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    met = seeds.select("doc_id", "version", base.alias("base")).join(added, ["doc_id", "version"], "left")
    more = F.filter(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    met = met.withColumn("more", more)
    every = F.flatten(F.array(*[F.concat(F.filter("base", of_kind(k)), F.filter("more", of_kind(k))) for k in KINDS]))
    order = lambda a, b: F.when(rank(a["kind"]) != rank(b["kind"]), rank(a["kind"]) - rank(b["kind"])).otherwise(a["start"] - b["start"])
    return met.select("doc_id", "version", "base", F.when(F.size("more") > 0, F.array_sort(every, order)).otherwise(F.col("base")).alias("spans"))


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, each span of its text replaced by its kind in brackets. Overlapping spans are one, with the first one's kind."""
    prefix = free_prefix(docs.columns, "pii_")
    found = find(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias(f"{prefix}doc"), F.col("version").alias(f"{prefix}version"), F.col("spans").alias(f"{prefix}spans")).dropDuplicates([f"{prefix}doc", f"{prefix}version"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(f"{prefix}doc")) & (F.xxhash64(text) == F.col(f"{prefix}version")), "left")
    by_place = F.array_sort(F.col(f"{prefix}spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")))
    whole = F.aggregate(by_place, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.col(f"{prefix}spans").isNull(), F.col(text_col)).otherwise(whole)
    return met.select(*[clean.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
