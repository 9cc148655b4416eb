"""Stateful guard-rails over several micro-batches, with restarts, expiry and late rows, against their batch twins."""

import datetime
import random

import pytest

from colloquy.streaming import guards

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = "trace_id long, event_id long, ts timestamp, tool_name string, ok boolean, violation boolean, safety boolean, prev_hash string, own_hash string, seq long"


def events(seed, n):
    r, rows, tips = random.Random(seed), [], {}
    for i in range(n):
        t = r.randrange(4)
        own, before = f"h{i}", tips.get(t, "0" * 64)
        rows.append((t, i, START + i * DAY / 20, r.choice(["ask", "pay", "look"]), r.random() < 0.7, r.random() < 0.5, r.random() < 0.3, before if r.random() < 0.9 else "broken", own, i))
        tips[t] = own
    return rows


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a rule over batches of rows; each batch is a run of its own that starts from the checkpoint of the last."""

    def run(rule, ddl, batches, **clock):
        out = []
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = guards.stateful(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), rule, **clock)
            made = []
            query = stream.writeStream.foreachBatch(lambda df, _, made=made: made.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            out.append(sorted(made, key=str))
        return out

    return run


@pytest.mark.parametrize("name", ["tool_gate", "guard_budget", "chain_check"])
def test_batches_as_one_table(spark, streamed, name):
    rule = {"tool_gate": lambda: guards.tool_gate({"pay": ["ask", "look"]}), "guard_budget": lambda: guards.guard_budget(5), "chain_check": guards.chain_check}[name]()
    rows = events(1, 120)
    got = sum(streamed(rule, EVENTS, [rows[:50], rows[50:70], rows[70:]], clock="ts", idle="365 days"), [])
    want = list(map(tuple, guards.batch(spark.createDataFrame(rows, EVENTS), rule).collect()))
    assert sorted(got, key=str) == sorted(want, key=str) != []


def test_state_expires(streamed):
    """A trace that is idle for longer than that starts anew; one that isn't goes on."""
    at = lambda t, i, day, tool: (t, i, START + day * DAY, tool, True, False, False, None, None, i)
    rule = guards.tool_gate({"pay": ["ask"]})
    batches = [[at(1, 1, 0, "ask"), at(2, 2, 0, "ask")], [at(2, 3, 20, "look"), at(3, 4, 35, "look")], [at(1, 5, 36, "pay"), at(2, 6, 36, "pay"), at(1, 7, 37, "ask"), at(1, 8, 38, "pay"), at(9, 9, 2, "pay")]]
    first, second, third = streamed(rule, EVENTS, batches, clock="ts", idle="30 days")
    assert first == second == [] and third == [(1, 5, "pay", "ask")]  # trace 9 comes too late


TURNS = "trace_id long, turn long, place int, role string, negative boolean, ending boolean, required array<string>, tool_name string, ok boolean, clock timestamp"


def test_premature_end(spark, streamed):
    """Both clauses: required tools that are missing, and negative turns just before."""
    say = lambda turn, role, negative=False, ending=False, need=("a", "b"): (1, turn, 1, role, negative, ending, list(need), None, None, START + turn * DAY)
    call = lambda turn, tool, ok=True: (1, turn, 0, None, False, False, None, tool, ok, START + turn * DAY)
    rows = [say(1, "agent", ending=True), call(2, "a"), call(2, "b", ok=False), say(2, "agent", ending=True), say(3, "user", negative=True), call(4, "b"), say(4, "agent", ending=True), say(5, "agent", ending=True), say(6, "agent", ending=True), say(7, "agent", ending=True, need=["c"])]
    want = [(1, 1, "a,b", None), (1, 2, "b", None), (1, 4, "", 3), (1, 5, "", 3), (1, 7, "c", None)]
    rule = guards.premature_end(2)
    assert sorted(map(tuple, guards.batch(spark.createDataFrame(rows, TURNS), rule).collect())) == want
    assert sorted(sum(streamed(rule, TURNS, [rows[:4], rows[4:6], rows[6:]]), [])) == want
