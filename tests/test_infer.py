"""Model calls: bounds over all tasks, retries, the log, and outputs carried from chunk to chunk."""

from __future__ import annotations

import os
import sys
import time

import pytest
from pyspark import cloudpickle

from millrace.operators import infer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this module


class Counted:
    """A model that notes when each call begins and ends, in a file that all workers append to."""

    def __init__(self, path, pause=0.0, fails=()):
        self.path, self.pause, self.fails = str(path), pause, fails

    def __call__(self, prompt):
        self.note(f"+{time.time():.6f}\t{prompt}")
        time.sleep(self.pause)
        self.note(f"-{time.time():.6f}\t{prompt}")
        if prompt in self.fails:
            raise ValueError(prompt)
        if prompt == "crash" and not os.path.exists(self.path + ".mended"):
            os._exit(1)  # as when an executor is lost
        return prompt.upper()

    def note(self, line):
        with open(self.path, "a") as f:
            f.write(line + "\n")

    def lines(self):
        return [(x[0], float(x[1:].split("\t")[0]), x.split("\t")[1].strip()) for x in open(self.path)] if os.path.exists(self.path) else []

    def asked(self):
        return sorted(p for sign, _, p in self.lines() if sign == "+")

    def most_open(self):
        now = most = 0
        for _, sign in sorted((at, 1 if s == "+" else -1) for s, at, _ in self.lines()):
            now += sign
            most = max(most, now)
        return most


def prompts(spark, n, parts):
    return spark.range(n).selectExpr("id", "concat('p', id) AS text").repartition(parts)


def test_calls_are_bounded_over_all_tasks(spark, tmp_path):
    model, df = Counted(tmp_path / "a", pause=0.05), prompts(spark, 60, 16)
    with infer.CallLimits(spark, 3) as limits:
        made = infer.batch_call(df, "text", model, limits)
        assert made.rdd.getNumPartitions() == 16  # the data stay where they are
        assert {r["response"] for r in made.collect()} == {f"P{k}" for k in range(60)}
    assert 1 < model.most_open() <= 3 and len(model.asked()) == 60
    free = Counted(tmp_path / "b", pause=0.1)
    assert infer.batch_call(df, "text", free, threads=4).count() == 60 and free.most_open() > 4


def test_rate_holds_over_all_tasks(spark, tmp_path):
    model = Counted(tmp_path / "a")
    with infer.CallLimits(spark, 8, per_second=20) as limits:
        infer.batch_call(prompts(spark, 30, 8), "text", model, limits).collect()
    starts = sorted(at for sign, at, _ in model.lines() if sign == "+")
    assert starts[-1] - starts[0] >= 29 / 20 - 0.2


def test_a_permit_comes_back_when_its_task_is_gone(spark):
    with infer.CallLimits(spark, 1) as limits:
        lost = infer._Permit(limits.address)
        lost.__enter__()
        lost.socket.close()
        with infer._Permit(limits.address):
            pass


@pytest.mark.parametrize("fallback, response", [("input", "p1"), ("empty", "")])
def test_retries_only_what_is_asked_for(spark, tmp_path, fallback, response):
    model = Counted(tmp_path / "a", fails=("p1",))
    df = spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,)], "text string").coalesce(1)
    call = lambda **k: sorted((str(r["text"]), r["response"], r["attempts"], r["status"]) for r in infer.batch_call(df, "text", model, wait=0, fallback=fallback, **k).collect())
    none = ("None", "" if fallback == "empty" else None, 0, "failed")
    assert call(attempts=3) == [none, ("p1", response, 3, "failed"), ("p2", "P2", 1, "ok"), ("p2", "P2", 1, "ok")]
    assert call(retry_on=lambda e: isinstance(e, TimeoutError))[1] == ("p1", response, 1, "failed")
    assert model.asked() == ["p1"] * 4 + ["p2"] * 2


def test_logged_prompts_are_not_asked_again(spark, tmp_path):
    model, log = Counted(tmp_path / "a", fails=("p7",)), infer.ResponseLog(spark, f"{tmp_path}/log")
    rows = spark.createDataFrame([(f"p{k}",) for k in range(200)] + [("crash",)], "text string").coalesce(1)
    made = infer.batch_call(rows, "text", model, attempts=1, threads=1, log=log)
    with pytest.raises(Exception, match="(?i)worker|crash|abort"):
        made.collect()
    first = model.asked()
    assert len(first) == 201
    open(f"{tmp_path}/a.mended", "w").close()
    assert len(made.select("*").collect()) == 201  # the task runs again
    again = model.asked()[:]
    for p in first:
        again.remove(p)
    assert len(again) <= infer.LOG_ROWS and "p1" not in again  # what was logged before the loss is not asked
    before = len(model.asked())
    later = infer.batch_call(spark.createDataFrame([("p1",), ("p7",), ("new",)], "text string"), "text", model, attempts=1, log=log)
    assert {(r["text"], r["response"], r["status"]) for r in later.collect()} == {("p1", "P1", "ok"), ("p7", "p7", "failed"), ("new", "NEW", "ok")}
    assert len(model.asked()) == before + 2 and log.table().where("response = 'NEW'").count() == 1


def test_outputs_are_carried(spark):
    """Against a plain loop over each group."""

    def model(prompt):
        if len(prompt) % 5 == 0:
            raise ValueError(prompt)
        head = prompt.split("]\n")[0] if prompt.startswith("[CONTEXT] ") else ""
        return (prompt if len(prompt) % 5 == 1 else f"<{len(head)}>" + prompt.rsplit("]\n")[-1] + " tail") * 3

    rows = [(g, k, "".join(chr(97 + (g * k + i) % 26) for i in range(1 + (g * 7 + k * 3) % 90))) for g in range(6) for k in range(1 + g * 2)] + [(None, 1, "no group"), (None, 2, None)]
    want = {}
    for g in {r[0] for r in rows}:
        context = ""
        for _, k, text in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            text = text or ""
            prompt = f"[CONTEXT] {context}]\n{text}" if context else text
            try:
                out = model(prompt)
                if "[CONTEXT]" in out:
                    out = out.split("[CONTEXT]")[-1]
                    out = out.split("]")[-1]
                out = out.strip()
                status = "ok"
            except ValueError:
                out, status = text, "failed"
            want[g, k] = (context, out, status)
            context = out[-50:]
    df = spark.createDataFrame(rows, "g long, k int, text string")
    got = {(r["g"], r["k"]): (r["context"], r["output"], r["status"]) for r in infer.carry_output(df, "g", "k", "text", model, length=50, attempts=1, wait=0, workers=4).collect()}
    assert got == want
    assert infer.carry_output(df.where("false"), "g", "k", "text", model).count() == 0


def test_permits_are_asked_for_without_delay(monkeypatch):
    """A return and a request in a row must not wait for an acknowledgement."""
    options = []
    fake = type("S", (), {"setsockopt": lambda s, *o: options.append(o), "sendall": lambda s, b: None})()
    monkeypatch.setattr(infer.socket, "create_connection", lambda a: fake)
    infer._Permit(("driver", 1, "secret"))
    assert (infer.socket.IPPROTO_TCP, infer.socket.TCP_NODELAY, 1) in options
