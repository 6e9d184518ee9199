"""Streams that stop and start again: stitching with gaps, and the cache that learns."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest

from millrace.operators import chunks
from millrace.sources.cache_table import CacheTable, learner
from millrace.streaming import transcripts


def text_of(n, seed=5):
    random.seed(seed)
    return " ".join("".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 9))) for _ in range(n))


def chunks_of(text, media=1):
    return [(media, k, text[a : a + 450]) for k, a in enumerate(range(0, len(text) - 150, 300))]


def test_stream_stitch_equals_batch(spark):
    rows = chunks_of(text_of(400)) + [(2, 1, "late"), (3, 0, " "), (3, 1, "first words"), (3, 2, "words after"), (3, 3, None)]
    table = spark.createDataFrame(rows, "media_id long, idx int, text string").repartition(5)
    found = {r["media_id"]: r["text"] for r in transcripts.stitched(transcripts.replay(table, transcripts.stream_stitch, "update", "test")).collect()}
    assert found == {r["media_id"]: r["text"] for r in chunks.stitch(table).collect()} | {2: ""}


class Run:
    """A stream over files in a folder that ends when they are read; started again it goes on from its log."""

    def __init__(self, spark, folder, schema, make, each=None):
        self.spark, self.folder, self.schema, self.make, self.out = spark, folder, schema, make, []
        self.each = each or (lambda df, n: df)

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

        def write(df, n):
            self.out += [r.asDict() for r in self.each(df, n).collect()]

        with transcripts.rocksdb(self.spark):
            made = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
            query = made.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        return self.out


def test_a_gap_closes_on_time_while_chunks_keep_coming(spark, tmp_path):
    schema, wait = "media_id long, idx int, text string", 10
    rows, out = chunks_of(text_of(2000)), []

    def send(*k):
        spark.createDataFrame([rows[i] for i in k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    send(0)
    with transcripts.rocksdb(spark):
        made = transcripts.stream_stitch(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), wait_ms=wait * 1000)
        query = made.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="1 second")
        query = query.foreachBatch(lambda df, n: out.extend((time.time(), *r) for r in df.collect())).start()
    try:
        reached = lambda: max([r[3] for r in out], default=0)
        began = time.time()
        while reached() < 1 and time.time() - began < 60:
            time.sleep(0.2)
        began, last = time.time(), 2
        send(2)
        while reached() < 2 and time.time() - began < 60:
            time.sleep(1.5)
            last += 1
            send(last)
        closed = next(r[0] for r in out if r[3] >= 2)
        assert closed - began >= wait - 0.5 and last > 4
        send(1)  # too late
        while reached() < last + 1 and time.time() - began < 90:
            time.sleep(0.2)
    finally:
        query.stop()
    parts = sorted((r[2], r[3], r[4]) for r in out)
    want = chunks.stitch(spark.createDataFrame([r for r in rows[: last + 1] if r[1] != 1], schema)).first()["text"]
    assert " ".join("".join(p for _, _, p in parts).split()) == want
    assert all(a + len(p) == b for (a, _, p), (b, _, _) in zip(parts, parts[1:], strict=False))


class Memory:
    """States, timers and clock for the processor's own tests."""

    def __init__(self):
        self.timers, self.value, self.held = set(), None, {}

    def getValueState(self, *_):  # noqa: N802
        return type("V", (), {"exists": lambda s: self.value is not None, "get": lambda s: self.value, "update": lambda s, v: setattr(self, "value", v)})()

    def getMapState(self, *_):  # noqa: N802
        return type("M", (), {"iterator": lambda s: iter([((k,), v) for k, v in self.held.items()]), "removeKey": lambda s, k: self.held.pop(k[0]), "updateValue": lambda s, k, v: self.held.__setitem__(k[0], v)})()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_each_gap_has_its_own_time():
    rows = chunks_of(text_of(4000))
    handle, now, out = Memory(), 0, []
    machine = transcripts.Stitcher(500, 10, 60_000)
    machine.init(handle)
    missing = {1, 3, 30}
    for k, (_, _, text) in enumerate(rows):
        now = k * 30_000
        for at in sorted(t for t in handle.timers if t <= now):
            out.append(machine.advance((1,), {}, now, at))
            handle.timers.discard(at)
        if k not in missing:
            out.append(machine.advance((1,), {k: text}, now))
        assert len(handle.held) <= 4 and len(handle.timers) <= 1
    got = " ".join("".join(f["piece"][0] for f in out).split())
    parts = [t for k, (_, _, t) in enumerate(rows) if k not in missing]
    want = parts[0]
    for p in parts[1:]:
        want = chunks.stitch_two(want, p.strip(), 500, 10)
    assert got == " ".join(want.split()) and not handle.held
    assert [f["start"][0] for f in out[1:]] == pd.Series([len(f["piece"][0]) for f in out]).cumsum()[:-1].tolist()


DICTIONARY = [("ptt global", "PTTGC.BK"), ("abcdefghijkl", "OLDKEY.BK"), ("known word", "KNOWN.BK")]


def test_cache_learns_across_restarts(spark, tmp_path):
    dictionary = spark.createDataFrame(DICTIONARY, "key string, ticker string")
    tickers = spark.createDataFrame([("PTTGC.BK",), ("OLDKEY.BK",), ("KNOWN.BK",)], "ticker string")
    schema = "media_id long, mention string, ts long"
    CacheTable(spark, f"{tmp_path}/cache", buckets=8).merge(spark.createDataFrame([("abcdefghijkx", "OLD.BK", 1_700_000_000), ("other", "OTHER.BK", 1)], "mention string, ticker string, updated_at long"))

    def start():
        table = CacheTable(spark, f"{tmp_path}/cache")
        resolve = transcripts.resolve_all(dictionary, tickers, learn=("fuzzy",))
        return table, Run(spark, tmp_path, schema, lambda s: s, learner(table, "mentions", resolve))

    table, run = start()
    out = run([(1, "ptt globai 1", 5), (1, "ptt global", 6), (2, "pttgc", 7), (2, "abcdefghijkx", 8), (3, "zzz", 9)])
    assert {(r["mention"], r["ticker"], r["method"]) for r in out} == {
        ("ptt globai 1", None, "none"), ("ptt global", "PTTGC.BK", "exact"), ("pttgc", "PTTGC.BK", "code"), ("abcdefghijkx", "OLD.BK", "exact"), ("zzz", None, "none"),
    }
    table, run = start()  # a new driver: the log and the table are all it has
    out = run([(4, "known words", 1_800_000_000), (4, "abcdefghijkx", 10)])
    assert ("known words", "KNOWN.BK", "fuzzy") in {(r["mention"], r["ticker"], r["method"]) for r in out}
    table, run = start()
    out = run([(5, "known words", 1_800_000_001)])
    assert [(r["ticker"], r["method"]) for r in out] == [("KNOWN.BK", "exact")]  # learned before
    entries = {r["mention"]: (r["ticker"], r["updated_at"]) for r in table.table().collect()}
    assert entries == {"abcdefghijkx": ("OLD.BK", 1_700_000_000), "other": ("OTHER.BK", 1), "known words": ("KNOWN.BK", 1_800_000_000)}


def entries(table, version=None):
    return {r["mention"]: r["ticker"] for r in table.table(version).collect()}


def test_cache_table(spark, tmp_path):
    table = CacheTable(spark, f"{tmp_path}/t", buckets=4, keep=2)
    rows = lambda *r: spark.createDataFrame(list(r), "mention string, ticker string, updated_at long")
    assert entries(table) == {}
    table.merge(rows(("ABC", "OLD.BK", 1_700_000_000), ("x", "X1", 5), ("x", "X2", 5), (None, "N", 1)))
    assert entries(table) == {"abc": "OLD.BK", "x": "X2"}
    assert table.merge(rows(("abc", "NEW.BK", 1_700_000_001)), "s", 0)
    before = table.state()
    assert not table.merge(rows(("abc", "AGAIN.BK", 1_900_000_000)), "s", 0)  # the same batch once more
    assert table.state() == before and entries(table) == {"abc": "NEW.BK", "x": "X2"}
    assert table.merge(rows(("abc", "OTHER.BK", 1)), "other stream", 0) and entries(table)["abc"] == "NEW.BK"
    # Only the mention's bucket is written anew.
    first, second = table.state(table.versions()[-2])["folders"], table.state()["folders"]
    assert sum(first[k] != second[k] for k in second) == 1
    # A writer that is late makes its change again on what the other one left.
    late, commit = CacheTable(spark, f"{tmp_path}/t", keep=2), CacheTable._commit
    late._commit = lambda state, tried=[]: (tried or (tried.append(1), table.merge(rows(("y", "Y", 1))))) and commit(late, state)
    late.merge(rows(("z", "Z", 1)))
    assert entries(late) == {"abc": "NEW.BK", "x": "X2", "y": "Y", "z": "Z"}
    for k in range(4):
        late.merge(rows(("k", f"K{k}", k)))
    assert len(late.versions()) == 2 and entries(late, late.versions()[0])["k"] == "K2" and entries(late)["k"] == "K3"
    held = {f.split("/")[1] for v in late.versions() for f in late.state(v)["folders"].values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()} == held


@pytest.mark.parametrize("wins, ticker", [(True, "C"), (False, "D")])
def test_cache_wins(spark, wins, ticker):
    cache = spark.createDataFrame([("k", "C", 1)], "mention string, ticker string, updated_at long")
    d = spark.createDataFrame([("k", "D")], "key string, ticker string")
    got = transcripts.resolve_all(d, d.where("false"), cache_wins=wins)(spark.createDataFrame([("k",)], "mention string"), cache).first()
    assert (got["ticker"], got["method"], got["learned"]) == (ticker, "exact", False)


class OneGroup:
    """A group's state, as a stream keeps it between the calls for one item."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.now, self.due, self.calls = None, False, False, 0, None, 0

    def update(self, value):
        self.get, self.exists, self.calls = value, True, self.calls + 1

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.due = self.now + ms

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now


def test_state_goes_with_the_rows_once_a_batch():
    state, stitcher, out = OneGroup(), transcripts.Stitcher(500, 10, 60_000), []

    def send(now, *rows):
        state.now, state.due, state.hasTimedOut, before = now, None, not rows, state.calls
        out.extend(stitcher((1,), iter([pd.DataFrame(rows, columns=["idx", "text"])]) if rows else iter(()), state))
        assert state.calls == before + 1

    send(0, (0, "one"), (2, "three"))
    assert state.due == 60_000 and state.get[2] == 1 and state.get[4] == [(2, "three", 0)]
    send(20_000, (4, "five"))  # does not put the end of the gap off
    assert state.due == 60_000 and [w[0] for w in state.get[4]] == [2, 4]
    send(60_000)
    assert state.due == 80_000 and state.get[2] == 3 and [w[0] for w in state.get[4]] == [4]
    send(70_000, (1, "too late"), (3, "four"))
    assert state.due is None and state.get[2] == 5 and state.get[4] == []
    assert "".join(f["piece"][0] for f in out) == "one three four five"


def test_gaps_stay_open_over_restarts_and_many_items(spark, tmp_path):
    run = Run(spark, tmp_path, "media_id long, idx int, text string", transcripts.stream_stitch)
    run([(m, k, f"text {k}") for m in range(600) for k in (0, 2)])
    out = run([(m, 1, "text 1") for m in range(600) if m % 2])
    texts = {r["media_id"]: (r["next_idx"], r["text"]) for r in transcripts.stitched(spark.createDataFrame(out, "media_id long, start long, next_idx int, piece string")).collect()}
    assert texts == {m: (3, "text 0 text 1 text 2") if m % 2 else (1, "text 0") for m in range(600)}
