"""Hand-made cases of the operators that SQL can't express, and edges of the others."""

from __future__ import annotations

import difflib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import audit, chunks, corrections, resolve


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tier_edges(spark):
    for seconds, mode in [(0.0, "short"), (1740.0, "short"), (1741.0, "medium"), (3600.0, "medium"), (3601.0, "long")]:
        assert one(spark, X.tier, seconds, "double")["mode"] == mode


def test_paragraphs_and_bullets_are_idempotent(spark):
    text = "a \r\n\r\n\r\n\r\n  b\n * c\n"
    first = one(spark, X.paragraphs, text)
    assert first == "a\n\nb\n* c" and one(spark, X.paragraphs, first) == first
    assert one(spark, X.bullets, "  * a\n* b * c") == "  - a\n- b * c"


def test_replies(spark):
    schema = "array<struct<mention:string>>"
    good = [('[{"mention":"a"}]', 1), ('x [{"mention":"a"}] y', 1), ("[{broken", 0), ('{"a": 1}', 0), ("", 0)]
    for reply, n in good:
        assert len(one(spark, lambda c: X.bracket_json(c, schema), reply)) == n
    assert len(one(spark, lambda c: X.fence_json(c, schema), '```json\n[{"mention":"a"}]\n```')) == 1


def test_stitch_gives_the_text_back(spark):
    random.seed(3)
    text = " ".join("".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 9))) for _ in range(300))
    rows = [(1, k, text[a : a + 450]) for k, a in enumerate(range(0, len(text) - 150, 300))]
    rows.append((2, 0, "only one"))
    random.shuffle(rows)
    found = {r["media_id"]: r["text"] for r in chunks.stitch(spark.createDataFrame(rows, "media_id long, idx int, text string")).collect()}
    assert found == {1: text, 2: "only one"}


def test_stitch_words(spark):
    rows = [(1, 0, "a b c d"), (1, 1, "c d e f"), (1, 2, "x"), (1, 3, "  ")]
    found = chunks.stitch(spark.createDataFrame(rows, "media_id long, idx int, text string"), words=30).first()["text"]
    assert found == "a b c d e f x"


def test_lookback_dedupe(spark):
    text = "the same long line here\nanother\nthe same long line hero\nthird"
    assert one(spark, lambda c: chunks.lookback_dedupe(c), text) == "the same long line here\nanother\nthird"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lookback_dedupe_lines_of_any_length(spark):
    random.seed(6)
    long = lambda n: "".join(random.choice("abcdefgh ü") for _ in range(n)).strip()
    first, second = long(2500), long(6000)
    other = first[:1000] + "x" * 600 + first[1600:]
    text = "\n".join([first, first[:1200] + "X" + first[1201:], second, other, second[1:], second[:3000] + long(40) + second[3000:], second + "\n" + first])
    assert one(spark, lambda c: chunks.lookback_dedupe(c), text) == "\n".join([first, second, other])


def test_lookback_dedupe_equals_the_plain_fold(spark):
    random.seed(8)
    texts = []
    for _ in range(60):
        lines = ["".join(random.choice("abü") for _ in range(random.randint(1, 40)))]
        for _ in range(8):
            line = list(random.choice(lines))
            for _ in range(random.randint(0, 7)):
                line.insert(random.randrange(len(line) + 1), random.choice("abü")) if random.random() < 0.5 or len(line) < 2 else line.pop(random.randrange(len(line)))
            lines.append("".join(line))
        texts.append("\n".join(lines))
    found = [r["y"] for r in spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", chunks.lookback_dedupe(F.col("x")).alias("y")).orderBy("n").collect()]
    for text, got in zip(texts, found, strict=True):
        kept = []
        for line in text.split("\n"):
            if not any(1 - edits(a, line) / max(len(a), len(line)) > 0.85 for a in kept[-5:]):
                kept.append(line)
        assert got == "\n".join(kept)


def test_split_recursive_keeps_all_words():
    text = "a b c\n\n" + "word " * 50 + "\n" + "x" * 90
    parts = chunks.split_recursive(text, 40)
    assert max(map(len, parts)) <= 40
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_chunk_plan_tails(spark):
    df = spark.createDataFrame([(1, 100), (2, 0)], "media_id long, n long")
    plan = lambda tail: chunks.chunk_plan(df, F.col("n"), F.lit(45), F.lit(15), tail).count()
    assert plan("all") == 4 and plan("stop") == 3


def test_hint_replace_longest_first(spark):
    docs = spark.createDataFrame([(1, "we saw big red car, and Big red. end"), (2, "none"), (3, None)], "doc_id long, text string")
    hints = spark.createDataFrame([("big red car", "BRC"), ("big red", "BR"), ("red", "R")], "hint string, term string")
    found = {r["doc_id"]: r["text"] for r in corrections.hint_replace(docs, hints).collect()}
    assert found == {1: "we saw BRC, and BR. end", 2: "none", 3: None}


def test_fuzzy_blocking_loses_nothing(spark):
    random.seed(5)
    keys = {"".join(random.choice("abcd") for _ in range(random.randint(1, 24))) for _ in range(150)}
    words = set(keys)
    for k in sorted(keys):
        for _ in range(4):
            w = list(k)
            for _ in range(random.randint(0, 3)):
                at = random.randrange(len(w) + 1)
                random.choice([lambda: w.insert(at, random.choice("abcd1")), lambda: w.pop() if w else None, lambda: w.__setitem__(at - 1, "c") if w else None])()
            words.add("".join(w))
    words.discard("")
    d = spark.createDataFrame([(k, "T1234.BK") for k in keys], "key string, ticker string")
    m = spark.createDataFrame([(w,) for w in words], "mention string")
    got = {r["mention"]: (r["alias"], r["score"]) for r in resolve.fuzzy_matches(m, d, 80).collect()}
    every = m.crossJoin(d).withColumn("s", resolve.score(F.col("mention"), F.col("key"))).where("s >= 80")
    best = every.groupBy("mention").agg(F.min_by(F.struct("key", "s"), F.struct(-F.col("s"), "key")).alias("b"))
    plain = F.col("mention").rlike("^[A-Za-z]+$") & (F.col("b.s") < 95)
    want = {r["mention"]: (r["b"]["key"], r["b"]["s"]) for r in best.where(~plain).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [80, 90, 95])
def test_sequence_scorer_equals_the_full_scan(spark, threshold):
    random.seed(threshold)
    keys = {"".join(random.choice("abcdeกข ") for _ in range(random.randint(1, 24))) for _ in range(120)}
    words = set(keys)
    for k in sorted(keys):
        for _ in range(5):
            w = list(k)
            for _ in range(random.randint(0, 4)):
                at = random.randrange(len(w) + 1)
                random.choice([lambda: w.insert(at, random.choice("abcก1")), lambda: w.pop() if w else None, lambda: w.reverse()])()
            words.add("".join(w))
    words = words - {""} | {"a" * 50_000}
    d = spark.createDataFrame([(k, "T1234.BK") for k in sorted(keys)], "key string, ticker string")
    m = spark.createDataFrame([(w,) for w in words], "mention string")
    got = {(r["mention"], r["alias"]): r["score"] for r in resolve.sequence_pairs(m, d.selectExpr("key AS alias", "ticker AS t"), threshold).collect()}
    want = {}
    for w in words - {"a" * 50_000}:
        for k in keys:
            score = int(100 * difflib.SequenceMatcher(None, w, k, autojunk=False).ratio() + 0.5)
            if score >= threshold:
                want[w, k] = score
    assert got == want
    best = {r["mention"]: r["alias"] for r in resolve.fuzzy_matches(m, d, threshold, scorer="sequence").collect()}
    assert all(best.get(w, a) == a for w, a in ((w, min((k for v, k in want if v == w), key=lambda k: (-want[w, k], k))) for w, _ in want))


@pytest.mark.parametrize("threshold, sent", [(90, None), (90, 0), (50, None), (20, 0)])
def test_sequence_scorer_moves_pairs_only(spark, monkeypatch, threshold, sent):
    """Mentions meet a small dictionary where they are; nothing is lost where it is large, nor where a piece is one letter."""
    random.seed(threshold)
    keys = sorted({"".join(random.choice("abcdก") for _ in range(random.randint(1, 12))) for _ in range(40)})
    words = sorted({k[:i] + x + k[j:] for k in keys for i in range(0, len(k), 3) for j, x in ((i, "ab"), (i + 1, ""), (i + 1, "z"))} - {""})
    aliases = spark.createDataFrame([(k, "T1234.BK") for k in keys], "alias string, t string")
    if sent is not None:
        monkeypatch.setattr(resolve, "SENT", sent)
    made = resolve.sequence_pairs(spark.createDataFrame([(w,) for w in words], "mention string"), aliases, threshold)
    score = lambda w, k: int(100 * difflib.SequenceMatcher(None, w, k, autojunk=False).ratio() + 0.5)
    assert {(r["mention"], r["alias"]): r["score"] for r in made.collect()} == {(w, k): s for w in words for k in keys if (s := score(w, k)) >= threshold}
    if sent is None:
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
        moved = [x for x in made._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1].split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(mention" in x]
        assert len(moved) <= 1, moved


def test_rules_on_short_tickers(spark):
    d = spark.createDataFrame([("apple1", "A.BK"), ("longer-key-12", "LONG.BK")], "key string, ticker string")
    m = spark.createDataFrame([("apple2",), ("apple1",), ("longer-key-13",)], "mention string")
    assert {r["mention"] for r in resolve.fuzzy_matches(m, d, 80).collect()} == {"apple1", "longer-key-13"}


def test_empty_dictionary(spark):
    d = spark.createDataFrame([], "key string, ticker string")
    m = spark.createDataFrame([("abc",)], "mention string")
    assert resolve.cascade(m, d, d).first()["method"] == "none"


def test_hint_replace_any_length_and_any_ids(spark):
    hints = spark.createDataFrame([("one two three four five", "LONG"), ("big red", "BR"), ("Two", "2")], "hint string, term string")
    rows = [(1, "say (one two three four five), two"), (1, "nothing here now"), (1, "big red big big red."), (None, "Big Red!"), (2, ""), (2, None), (3, "one two three four")]
    found = corrections.hint_replace(spark.createDataFrame(rows, "doc_id long, text string"), hints).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted(
        [("1", "say (LONG), 2"), ("1", "nothing here now"), ("1", "BR big BR."), ("None", "BR!"), ("2", ""), ("2", "None"), ("3", "one 2 three four")]
    )


def test_context_rule_and_standardise_of_several_words(spark):
    rules = spark.createDataFrame([("the phase", "Phase 2", "revenue"), ("the phase", "Phase 3", "tender")], "hint string, term string, ctx string")
    docs = spark.createDataFrame([(1, "revenue of the phase grew"), (2, "a tender for the phase, then"), (3, "the phase alone")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in corrections.context_rule(docs, rules).collect()} == {1: "revenue of Phase 2 grew", 2: "a tender for Phase 3, then", 3: "the phase alone"}
    mapping = spark.createDataFrame([("big red", "brd.bk")], "mention string, ticker string")
    assert corrections.standardise(docs.selectExpr("doc_id", "'the big red, bigger' AS text"), mapping).first()["text"] == "the BRD.BK, bigger"


def test_lookback_dedupe_sequence_equals_difflib(spark):
    import difflib

    random.seed(12)
    texts = []
    for _ in range(40):
        lines = ["".join(random.choice("ab cü") for _ in range(random.randint(1, 260)))]
        for _ in range(7):
            line = list(random.choice(lines))
            for _ in range(random.randint(0, 9)):
                line.insert(random.randrange(len(line) + 1), random.choice("abü"))
            lines.append("".join(line))
        texts.append("\n".join(lines))
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    for autojunk in (False, True):
        found = {r["doc_id"]: r["value"] for r in chunks.lookback_dedupe_sequence(df, autojunk=autojunk).collect()}
        assert found[99] is None
        for n, text in enumerate(texts):
            kept = []
            for line in filter(None, (x.strip() for x in text.split("\n"))):
                if not any(difflib.SequenceMatcher(None, a, line, autojunk=autojunk).ratio() > 0.85 for a in kept[-5:]):
                    kept.append(line)
            assert found[n] == "\n".join(kept)


def test_readers_survive_missing_and_broken_files(spark, tmp_path):
    from millrace.sources import knowledge

    nowhere, broken = str(tmp_path / "nowhere"), tmp_path / "broken.json"
    broken.write_text("{oops")
    for whole in (False, True):
        for path in (nowhere, str(broken)):
            for read in (knowledge.read_kb, knowledge.read_vocabulary, knowledge.read_cache):
                assert read(spark, path, whole=whole).count() == 0
    (tmp_path / "kb.json").write_text('{"Energy": {"PTT.BK": ["ptt", "p t t"], "EGCO.BK": []}, "Bank": {"KBANK.BK": ["kasikorn"]}}')
    rows = [tuple(r) for r in knowledge.read_kb(spark, str(tmp_path / "kb.json"), whole=True).collect()]
    assert rows == [("Energy", 0, "PTT.BK", 0, 0, "ptt"), ("Energy", 0, "PTT.BK", 0, 1, "p t t"), ("Energy", 0, "EGCO.BK", 1, None, None), ("Bank", 1, "KBANK.BK", 0, 0, "kasikorn")]
    (tmp_path / "cache.json").write_text('{"b": "B.BK", "a": "A.BK"}')
    assert [tuple(r) for r in knowledge.read_cache(spark, str(tmp_path / "cache.json"), whole=True).collect()] == [(0, "b", "B.BK"), (1, "a", "A.BK")]


def test_options_of_text_functions(spark):
    assert one(spark, lambda c: X.drop_fillers(c, protect=["อ่างทอง"]), "อ่าา อ่างทอง") == " อ่างทอง"
    assert one(spark, lambda c: X.strip_echo(c, anchored=True), " [CONTEXT old] answer [1] x") == "[CONTEXT old] answer [1] x"
    assert one(spark, lambda c: X.strip_echo(c, marker="[CONTEXT", anchored=True), " [CONTEXT old] answer [1] x") == "answer [1] x"


def test_notices_and_fallback(spark):
    from millrace.operators import prompts

    v = spark.createDataFrame([("g", 1, "SET ", ["fed", "", None]), ("g", 2, "fed", None)], "grp string, pos int, term string, hints array<string>")
    prompt = lambda *a: prompts.keyword_prompt(v, "grp", *a).first()["prompt"]
    assert prompt("Base ", " more ") == "more Base SET fed" and prompt(" ", "more") == prompts.FALLBACK_CONTEXT + " SET fed"


def test_longest_block_equals_difflib():
    random.seed(9)
    for _ in range(400):
        a, b = ("".join(random.choice("abc"[: random.randint(1, 3)]) for _ in range(random.randint(0, 40))) for _ in range(2))
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        assert chunks.longest_block(a, b) == (m.a, m.b, m.size) or m.size == 0 == chunks.longest_block(a, b)[2]


@pytest.mark.parametrize("options", [{}, {"segment": 4}, {"segment": 5, "window": 60, "least": 3}, {"segment": 4, "words": 6}, {"segment": 6, "cleanup": "single", "autojunk": True}])
def test_stitch_in_segments_equals_one_fold(spark, options):
    random.seed(11)
    rows = []
    for m in range(8):
        text = "".join(random.choice("ab  cdefgh\n") if m % 2 else random.choice("ab ") for _ in range(random.choice([0, 30, 900, 4000])))
        size, share = random.choice([(40, 15), (90, 80), (450, 150)])
        rows += [(m, k, text[a : a + size] if random.random() > 0.1 else random.choice(["", "  ", None])) for k, a in enumerate(range(0, max(len(text), 1), size - share))]
    window, least, words = options.get("window", 500), options.get("least", 10), options.get("words")
    want = {}
    for m in {r[0] for r in rows}:
        out = ""
        for part in [p for p in ((t or "").strip() for n, _, t in rows if n == m) if p]:
            if words:
                out = chunks.stitch_words_two(out, part, words)
            else:
                out = chunks.stitch_two(out, part, window, least, options.get("autojunk", False)) if out else part
        want[m] = " ".join(out.split()) if options.get("cleanup", "collapse") == "collapse" else out.replace("  ", " ")
    df = spark.createDataFrame(rows, "media_id long, idx int, text string").repartition(5)
    assert {r["media_id"]: r["text"] for r in chunks.stitch(df, **options).collect()} == want


def test_options_of_dictionaries(spark):
    rows = spark.createDataFrame([("X", "CPF.BK", "ptt", 0, 0), ("X", "PTT.BK", "oil", 1, 0), ("Y", "AOT.BK", "oil", 2, 0)], "sector string, ticker string, alias string, a int, b int")
    keys = lambda **k: {r["key"]: r["ticker"] for r in resolve.build_dictionary(rows, ["a", "b"], **k).collect()}
    assert keys() == {"ptt": "PTT.BK", "oil": "AOT.BK", "cpf": "CPF.BK", "aot": "AOT.BK"}
    assert keys(include_codes=False) == {"ptt": "CPF.BK", "oil": "AOT.BK"}
    d = spark.createDataFrame([("k", "B")], "key string, ticker string")
    cache = spark.createDataFrame([("k", "C"), ("z", "Z")], "key string, ticker string")
    laid = lambda wins: {r["key"]: (r["ticker"], r["src"]) for r in resolve.overlay(d, cache, wins).collect()}
    assert laid(True) == {"k": ("C", "cache"), "z": ("Z", "cache")} and laid(False) == {"k": ("B", "kb"), "z": ("Z", "cache")}


def test_rollup_counts_a_ticker_once_or_in_each_sector(spark):
    mentions = spark.createDataFrame([(1, "T"), (2, "T")], "doc_id long, ticker string")
    sectors = spark.createDataFrame([("T", "A", 1), ("T", "B", 0)], "ticker string, sector string, sector_pos int")
    count = lambda **k: {(r["sector"], r["ticker"]): r["n_mentions"] for r in resolve.sector_rollup(mentions, sectors, **k).collect()}
    assert count() == {("B", "T"): 2, ("B", None): 2, (None, None): 2}
    assert count(fan_out=True) == {("A", "T"): 2, ("B", "T"): 2, ("A", None): 2, ("B", None): 2, (None, None): 4}


def test_lookback_dedupe_strips_all_white_space(spark):
    assert one(spark, chunks.lookback_dedupe, "\ta line here\u00a0\n \u3000a line here\r\n\x0b\nother") == "a line here\nother"


def test_stitching_looks_at_few_places(monkeypatch):
    """A block that is as long as overlaps are is found by its pieces, without comparing all parts of a size."""
    seen = []
    monkeypatch.setattr(chunks, "_alike", lambda a, b, real=chunks._alike: seen.append(1) or real(a, b))
    text = " ".join(f"word{i}" for i in range(300))
    assert chunks.longest_block(text[:500], text[350:800]) == (350, 0, 150) and len(seen) == 2
    assert chunks.longest_block("a" * 400, "a" * 300) == (0, 0, 300) and chunks.longest_block("abcd", "xbcy") == (1, 1, 2)
    assert chunks.longest_block("abcdefgh", "xabcdefy", least=10) == (0, 0, 0)


def test_texts_become_pythons_a_few_at_a_time():
    rows = pa.table({"x": pa.array(range(200))}).to_batches()
    parts = list(chunks.sliced(iter(rows)))
    assert max(p.num_rows for p in parts) == chunks.SLICE_ROWS and [x for p in parts for x in p.column(0).to_pylist()] == list(range(200))


def test_unknown_mentions_are_gathered_once(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c"), (2, None)], "doc_id long, mention string")
    made = audit.verify_status(df)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, made.collect())) == [(1, 2, "a,b"), (2, 1, "c")]
