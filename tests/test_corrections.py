"""Hints in texts: writing without blanks, white space, marks, and equality with a plain scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import corrections

HINTS = [("กันกุล", "GUNKUL"), ("ไทยคม", "THCOM"), ("gunkool", "GUNKUL"), ("C.P.", "CPF"), ("user facebook", "USO Phase"), ("user", "USER"), ("ทอ", "TOR"), ("วายวาย", "YoY")]


def fixed(spark, texts, hints=HINTS, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(hints, "hint string, term string")
    return [r["text"] for r in corrections.hint_replace(docs, table, **options).orderBy("doc_id").collect()]


def test_thai_runs_line_ends_and_marks(spark):
    assert fixed(spark, ["หุ้นกันกุลวันนี้ขึ้น", "tab\tgunkool here", "a\ngunkool\nb", "the C.P. group and the c.p, too", "Gunkool's gunkoolish Xgunkool (GUNKOOL)"]) == [
        "หุ้นGUNKULวันนี้ขึ้น", "tab\tGUNKUL here", "a\nGUNKUL\nb", "the CPF group and the CPF, too", "GUNKUL's gunkoolish Xgunkool (GUNKUL)",
    ]
    assert fixed(spark, ["user \n\t facebook  and user  face", "İ user facebook", "ทอ่", "ซื้อไทยคมABC", "gunkoolไทย", "", None]) == ["USO Phase  and USER  face", "İ USO Phase", "ทอ่", "ซื้อTHCOMABC", "GUNKULไทย", "", None]


def test_longest_of_the_first_and_odd_tables(spark):
    hints = [("a b c", "3"), ("a b", "2"), ("b c d", "X"), ("a", "1"), ("a", "0"), ("", "no"), (None, "no"), ("d", None)]
    assert fixed(spark, ["a b c d", "a b d", "a c", "b c d a"], hints) == ["3 d", "2 d", "0 c", "X 0"]
    docs = spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string").withColumn("_h", F.lit(1))
    empty = spark.createDataFrame([], "hint string, term string")
    assert sorted(r["text"] for r in corrections.hint_replace(docs, empty).collect()) == ["a", "a"]
    assert corrections.hint_replace(docs.where("false"), empty).count() == 0


def test_rules_by_context_and_priority(spark):
    rules = [("user facebook", "Phase 2", "revenue|รายได้", 1), ("user facebook", "Phase 3", "tender|revenue", 2), ("user facebook", "Phase", None, 3)]
    table = spark.createDataFrame(rules, "hint string, term string, ctx string, priority int")
    texts = ["Revenue of user facebook", "tender for User Facebook", "user facebook alone", "revenue one two three four user facebook", "revenue one two three four five user facebook"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in corrections.context_rule(docs, table).orderBy("doc_id").collect()]
    assert got == ["Revenue of Phase 2", "tender for Phase 3", "Phase alone", "revenue one two three four Phase 2", "revenue one two three four five Phase"]


def plain(text, hints):
    """Place by place, each hint in turn, by the rules as they are stated."""
    spaced = lambda c: ("a" <= c.lower() <= "z") or c.isdigit()

    def fits(at, hint):
        i = at
        for c in hint:
            if c == " ":
                if i >= len(text) or not text[i].isspace():
                    return None
                while i < len(text) and text[i].isspace():
                    i += 1
            elif i < len(text) and text[i].lower() == c:
                i += 1
            else:
                return None
        before, after = text[at - 1 : at], text[i : i + 1]
        if before and spaced(before) and not "ก" <= text[at] <= "ฮ" or after and (after == "่" or spaced(after) and not "ก" <= text[i - 1] <= "ฮ"):
            return None
        return i

    out, at = "", 0
    while at < len(text):
        found = [(end, term) for hint, term in hints for form in {hint, hint.strip(". ")} if form and (end := fits(at, form)) is not None]
        if found:
            end, term = min(found, key=lambda f: (-f[0], f[1]))
            out, at = out + term, end
        else:
            out, at = out + text[at], at + 1
    return out


@pytest.mark.parametrize("most_bytes", [corrections.MOST_TABLE_BYTES, 12])
def test_equals_a_plain_scan(spark, most_bytes):
    random.seed(1)
    letters = "abกข. "
    word = lambda n: "".join(random.choice(letters) for _ in range(n))
    hints = {w for w in (" ".join(word(random.randint(1, 5)).split()) for _ in range(25)) if w.strip(". ")}
    hints = [(h, f"<{k}>") for k, h in enumerate(sorted(hints)) if not h.startswith((" ", "่"))]
    texts = ["".join(random.choice("aAbBกข. \n\t่1") for _ in range(random.randint(0, 40))) for _ in range(300)]
    assert fixed(spark, texts, hints, most_bytes=most_bytes) == [plain(t, hints) for t in texts]
