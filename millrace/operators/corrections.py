"""Replacing misheard words: hint tables, context rules, tickers, found by one automaton over all hints."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace import scratch
from millrace.operators.chunks import sliced

#: Bytes of hints, terms and rules in one automaton; it takes some 40 times as much memory in each worker.
MOST_TABLE_BYTES = 8 << 20
#: Words before the place, and words in all, that a context rule looks at.
BEFORE, AROUND = 5, 10
# Blocks of scripts written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han).
UNSPACED = re.compile("[฀-๿຀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_HITS = "array<struct<at:int,end:int,priority:long,term:string>>"


@cache
def _kind(c: str) -> tuple[bool, bool, bool]:
    """Whether a character is part of a word, of a script without blanks, and a mark on the one before it."""
    group = category(c)[0]
    return group in "LNM" or c == "_", bool(UNSPACED.match(c)), group == "M"


def inside_word(text: str, at: int, end: int) -> bool:
    """Whether the place is part of a longer word: a letter or digit goes on beside it, in a script with blanks, or a mark follows."""
    if at > 0:
        out, edge = _kind(text[at - 1]), _kind(text[at])
        if edge[2] or out[0] and not out[1] and not edge[1]:
            return True
    if end < len(text):
        out, edge = _kind(text[end]), _kind(text[end - 1])
        return out[2] or out[0] and not out[1] and not edge[1]
    return False


def folded(text: str) -> str:
    """Lower case, a character for a character."""
    low = text.lower()
    if len(low) != len(text) or "Σ" in text:
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low


def single_blanks(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with one blank for each run of white space; where runs of several ended, and what had gone by then."""
    ends, gone, total = [], [], 0

    def one(m: re.Match) -> str:
        nonlocal total
        if m.end() - m.start() > 1:
            total += m.end() - m.start() - 1
            ends.append(m.end() - total)
            gone.append(total)
        return " "

    return re.sub(r"\s\s+|[^\S ]", one, text), ends, gone  # single blanks stay as they are


def forms(hint: str) -> set[str]:
    """A hint as it is looked for: as written, and without the marks around it."""
    whole = single_blanks(folded(hint))[0].strip()
    first = next((i for i, c in enumerate(whole) if _kind(c)[0]), 0)
    last = next((i for i in range(len(whole), 0, -1) if _kind(whole[i - 1])[0]), len(whole))
    return {f for f in (whole, whole[first:last]) if f}


class Finder:
    """Places of hints in a text. ``rows``: hint, term, context pattern or None, priority."""

    def __init__(self, rows: list[tuple[str, str, str | None, int]]) -> None:
        import ahocorasick

        patterns: dict[str, list[tuple[int, str, re.Pattern | None]]] = {}
        for hint, term, context, priority in rows:
            for form in forms(hint):
                patterns.setdefault(form, []).append((priority, term, None if context is None else re.compile(context)))
        self.automaton = ahocorasick.Automaton()
        for form, entries in patterns.items():
            self.automaton.add_word(form, (len(form), sorted(entries, key=lambda e: e[:2])))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def __call__(self, text: str) -> list[tuple[int, int, int, str]]:
        """Begin, end, priority and term of each place that is no part of a longer word and whose rule holds."""
        if self.empty:
            return []
        low, ends, gone = single_blanks(folded(text))
        found, words = [], None
        for last, (size, entries) in self.automaton.iter(low):
            if inside_word(low, last + 1 - size, last + 1):
                continue
            at, end = ((p + gone[k - 1] if (k := bisect_right(ends, p)) else p) for p in (last + 1 - size, last))
            for priority, term, context in entries:
                if context is not None:
                    if words is None:
                        spans = [m.span() for m in re.finditer(r"\S+", low)]
                        words, starts = [low[a:b] for a, b in spans], [a for a, _ in spans]
                    first = max(bisect_right(starts, last + 1 - size) - 1 - BEFORE, 0)
                    if not context.search(" ".join(words[first : first + AROUND])):
                        continue
                found.append((at, end + 1, priority, term))
                break
        return found


def replaced(text: str, hits: list[tuple[int, int, int, str]]) -> str:
    """Left to right: of the places that begin after the last one's end the first, and there the longest."""
    out, done = [], 0
    for at, end, _, term in sorted(hits, key=lambda h: (h[0], -h[1], h[2], h[3])):
        if at >= done:
            out += [text[done:at], term]
            done = end
    return "".join(out) + text[done:] if out else text


_finders: dict[str, Finder] = {}


def _finder(held) -> Finder:
    """The automaton of a broadcast table, made once in a worker; only the last one is kept."""
    if held.value[0] not in _finders:
        _finders.clear()
        _finders[held.value[0]] = Finder(held.value[1])
    return _finders[held.value[0]]


def _shards(hints: DataFrame, most_bytes: int) -> Iterator:
    """Broadcasts of the table's rows, each of about ``most_bytes`` at most. The size is looked up before anything is collected."""
    columns = hints.columns
    rows = hints.select(F.col("hint"), F.col("term"), (F.col("ctx") if "ctx" in columns else F.lit(None).cast("string")).alias("ctx"), (F.col("priority") if "priority" in columns else F.lit(0)).cast("long").alias("priority"))
    rows = rows.where("hint is not null and term is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("hint") + F.octet_length("term") + F.coalesce(F.octet_length("ctx"), F.lit(0)))).first()[0] or 0
    shards = int(size // most_bytes) + 1
    for k in range(shards):
        part = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("hint"), F.lit(shards)) == k)
        table = [(r["hint"], r["term"], r["ctx"], r["priority"]) for r in part.collect()]
        yield rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, table)), k + 1 == shards


def hint_replace(docs: DataFrame, hints: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_TABLE_BYTES) -> DataFrame:
    """``id_col`` and the text with hints (``hint``, ``term``) replaced, in one pass over the texts.

    A hint is found whatever its case, with any white space between its words, as written or without the marks around
    it; marks beside it stay. It is not found inside longer words: no letter or digit may go on beside it. In scripts
    written without blanks, where words can't be told apart, it is found anywhere but before a combining mark. Where
    hints overlap the one that begins first counts, and of those the longest.

    ``hints`` may also have ``ctx``, a regular expression that must occur in the ten words about the place (lower case,
    joined by blanks; null: none needed), and ``priority``: of the rules that hold at one place the lowest counts, then
    the first term.

    The hints go to all tasks as an automaton of a checked size. A larger table is cut by hash into several, which read
    the texts one after another and write down what they find; the last one replaces. Texts are never joined or grouped,
    so ids may repeat or be null. A null text stays null. Hints without a character and null ones are passed over.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), F.lit(None).cast(_HITS).alias("_h"))
    folder = None
    for held, last in _shards(hints, most_bytes):

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            find = _finder(held)
            for batch in sliced(batches):
                before = batch.column(2).to_pylist()
                texts = batch.column(1).to_pylist()
                hits = [[*((h["at"], h["end"], h["priority"], h["term"]) for h in b or ()), *(find(t) if t else ())] for t, b in zip(texts, before, strict=True)]
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t and replaced(t, h) for t, h in zip(texts, hits, strict=True)], pa.string())], names=[id_col, text_col])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([[dict(zip(("at", "end", "priority", "term"), h, strict=True)) for h in hs] for hs in hits], batch.schema.field(2).type)], names=["_id", "_t", "_h"])

        if last:
            return texts.mapInArrow(run, StructType([StructField(id_col, id_type), StructField(text_col, StringType())]))
        folder = folder or scratch.new_path(docs.sparkSession, "hints")
        texts = scratch.written(texts.mapInArrow(run, texts.schema), "hits", folder)
    raise AssertionError("a table has at least one shard")


def context_rule(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hints whose term depends on the words about them: ``rules`` has ``hint``, ``term``, ``ctx`` and, if wanted, ``priority``."""
    return hint_replace(docs, rules, id_col, text_col)


def standardise(docs: DataFrame, mapping: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Resolved mentions, of any number of words, become their tickers in capitals; parts of longer words stay."""
    return hint_replace(docs, mapping.select(F.col("mention").alias("hint"), F.upper("ticker").alias("term")), id_col, text_col)
