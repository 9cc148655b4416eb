"""Online guard-rails on Structured Streaming. Stateful rules are keyed by trace_id; each has a batch twin with the same rows.

A rule names its state (values and sets of keys) and says what one row of a trace, in order, gives and changes. `stateful` keeps the state in the
stream's state store, with an event-time timer that drops what a trace has left once it is idle; `batch` keeps it in memory, over a table.
Watermarks, late-data handling and expiry are additions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from colloquy.functions.text import any_of
from colloquy.sources.shared import shared_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held:
    """State in memory."""

    def __init__(self, rule: Rule):
        self.values, self.sets = {n: start for n, (_, start) in rule.values.items()}, {n: set() for n in rule.sets}

    def get(self, name: str) -> tuple:
        return self.values[name]

    def put(self, name: str, value: tuple) -> None:
        self.values[name] = value

    def has(self, name: str, key: str) -> bool:
        return key in self.sets[name]

    def add(self, name: str, key: str) -> None:
        self.sets[name].add(key)


@dataclass(frozen=True)
class Rule:
    """`step(state, row)`: the output rows of one input row. `values`: name -> (columns, start); `sets`: names of sets of strings."""

    step: Callable[[Held, object], Iterable[tuple]]
    order: list[str]
    schema: str
    values: dict[str, tuple[str, tuple]] = field(default_factory=dict)
    sets: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema.split(",")]

    def over(self, state: Held, key, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(self.order, kind="stable").itertuples(index=False)
        made = pd.DataFrame([(key, *out) for r in rows for out in self.step(state, r)], columns=self.columns)
        return made.astype({c: "Int64" for c, kind in zip(self.columns, self.schema.split(",")) if kind.endswith(" long")})  # numbers that may be missing


class Stored(Held):
    """State of one trace in the stream's store: values and sets are read when first asked for, and changed ones are written by `save`."""

    def __init__(self, rule: Rule, values: dict, maps: dict):
        self.rule, self.own_values, self.own_maps = rule, values, maps
        self.values, self.sets, self.changed = {}, {n: {} for n in rule.sets}, set()

    def get(self, name):
        if name not in self.values:
            state = self.own_values[name]
            self.values[name] = tuple(state.get()) if state.exists() else self.rule.values[name][1]
        return self.values[name]

    def put(self, name, value):
        self.values[name] = value
        self.changed.add(name)

    def has(self, name, key):
        known = self.sets[name]
        if key not in known:
            known[key] = self.own_maps[name].containsKey((key,))
        return known[key]

    def add(self, name, key):
        if not self.has(name, key):
            self.own_maps[name].updateValue((key,), (True,))
            self.sets[name][key] = True

    def save(self):
        for name in self.changed:
            self.own_values[name].update(self.values[name])


class Guard(StatefulProcessor):
    """A rule over the traces of a stream. `clock`: the event-time column, and after how many milliseconds without an event a trace's state goes."""

    def __init__(self, rule: Rule, clock: tuple[str, int] | None):
        self.rule, self.clock = rule, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.values = {n: handle.getValueState(n, ddl) for n, (ddl, _) in self.rule.values.items()}
        self.maps = {n: handle.getMapState(n, "key string", "seen boolean") for n in self.rule.sets}
        self.due = handle.getValueState("due", "due long") if self.clock else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))  # one trace's rows of a micro-batch, which have to be put in order
        state = Stored(self.rule, self.values, self.maps)
        made = self.rule.over(state, key[0], part)
        state.save()
        if self.clock:
            column, idle = self.clock
            at = int(part[column].max().timestamp() * 1000) + idle
            before = self.due.get()[0] if self.due.exists() else None
            if before is None or at > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.due.update((at,))
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (*self.values.values(), *self.maps.values(), self.due):
            state.clear()
        yield pd.DataFrame(columns=self.rule.columns)

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, rule: Rule, clock: str | None = None, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """The rule on a stream; rows of a micro-batch are put in order first, so its size bounds what a trace's task holds.

    With `clock`, an event-time column, state of a trace goes once the watermark (`late` behind the newest event) is `idle` past its last event; rows that
    are older than the watermark are dropped. Without one, state stays. State and timers are in the checkpoint, so a restarted stream goes on where it was.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if clock is None:
        return stream.groupBy("trace_id").transformWithStateInPandas(Guard(rule, None), rule.schema, "append", "None")
    ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {idle})").first()[0]
    return stream.withWatermark(clock, late).groupBy("trace_id").transformWithStateInPandas(Guard(rule, (clock, ms)), rule.schema, "append", "EventTime")


def batch(rows: DataFrame, rule: Rule) -> DataFrame:
    """The rule on a table; a trace's events are one group."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return rule.over(Held(rule), key[0], part)

    return rows.groupBy("trace_id").applyInPandas(run, rule.schema)


def forbidden_alerts(messages: DataFrame, words: list[str]) -> DataFrame:
    """Stateless: trace_id, turn, keyword of agent messages with a forbidden word."""
    first = F.coalesce(*(F.when(F.col("content").contains(w), F.lit(w)) for w in words))
    return messages.where(F.col("role") == "agent").where(any_of(F.col("content"), words)).select("trace_id", "turn", first.alias("keyword"))


def tool_gate(gates: dict[str, list[str]], order: list[str] = ("ts", "event_id")) -> Rule:
    """Calls of a gated tool before all its required tools have succeeded are blocked. Rows have event_id, tool_name, ok. State: tools that have succeeded.

    trace_id, event_id, tool_name, missing."""

    def step(state, r):
        missing = [t for t in gates.get(r.tool_name, ()) if not state.has("done", t)]
        if missing:
            yield r.event_id, r.tool_name, ",".join(missing)
        elif r.ok:
            state.add("done", r.tool_name)

    return Rule(step, list(order), "trace_id long, event_id long, tool_name string, missing string", sets=("done",))


def premature_end(reach: int = 2, order: list[str] = ("turn", "place")) -> Rule:
    """Closing agent messages while a required tool has not succeeded yet, or up to `reach` turns after a negative user turn.

    Rows are messages (turn, role, negative, ending, required: the tools that the trace's policy asks for before the end) and tool events (turn, tool_name,
    ok), in order of turn and place. State: the last negative turn, tools that have succeeded.
    trace_id, turn, missing (in order, joined by commas), negative_turn (null if none is near)."""

    def step(state, r):
        if isinstance(r.tool_name, str):
            if r.ok:
                state.add("done", r.tool_name)
        elif r.role == "user" and r.negative:
            state.put("last", (int(r.turn),))
        elif r.role == "agent" and r.ending:
            missing = [t for t in (r.required if r.required is not None else ()) if not state.has("done", t)]
            last = state.get("last")[0]
            near = last is not None and r.turn - last <= reach
            if missing or near:
                yield int(r.turn), ",".join(missing), last if near else None

    return Rule(step, list(order), "trace_id long, turn long, missing string, negative_turn long", {"last": ("turn long", (None,))}, ("done",))


def guard_budget(budget: int = 6, patience: int = 2, order: list[str] = ("ts", "event_id")) -> Rule:
    """Violations are blocked; once `budget` blocks have happened, advisory ones are skipped, safety ones never. After `patience`
    blocks in a row that were followed by another violation, the level falls from full to block_only for good. Rows have event_id, violation, safety.

    trace_id, event_id, action, level."""

    def step(state, r):
        blocks, streak, level = state.get("so_far")
        if not r.violation:
            streak, action = 0, "pass"
        elif blocks >= budget and not r.safety:
            action = "skip"
        else:
            action, blocks, streak = "block", blocks + 1, streak + 1
            if streak > patience:
                level = "block_only"
        state.put("so_far", (blocks, streak, level))
        yield r.event_id, action, level

    return Rule(step, list(order), "trace_id long, event_id long, action string, level string", {"so_far": ("blocks long, streak long, level string", (0, 0, "full"))})


def chain_check(genesis: str = "0" * 64, order: list[str] = ("ts", "seq")) -> Rule:
    """The first event whose prev_hash isn't the hash before it. Rows have seq, prev_hash, own_hash. State: last hash, whether a bad one was reported.

    trace_id, bad_seq."""

    def step(state, r):
        tip, bad = state.get("tip")
        wrong = r.prev_hash != tip and not bad
        state.put("tip", (r.own_hash, bad or wrong))
        if wrong:
            yield (int(r.seq),)

    return Rule(step, list(order), "trace_id long, bad_seq long", {"tip": ("tip string, bad boolean", (genesis, False))})


def session_scores(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """trace_id, session_start, session_end, events, errors, total per session; on streams sessions are given once the watermark passes."""
    return events.withWatermark("ts", late).groupBy("trace_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.sum(F.col("error").isNotNull().cast("long")).alias("errors"), F.sum("amount").alias("total")
    ).select("trace_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "errors", "total")


def violation_rate(events: DataFrame, violation: Column, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, tool_name, events, rate per tumbling (or sliding) window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "tool_name").agg(F.count("*").alias("events"), F.avg(violation.cast("double")).alias("rate"))
    return g.select(F.col("w.start").alias("window_start"), "tool_name", "events", "rate")


def dedup_events(events: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    """Events without repeats of the keys; on streams repeats that come later than `within` are not recognised."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def guard_actions(events: DataFrame, budget: int = 6) -> DataFrame:
    """The actions of `guard_budget` on a table, by a window in each trace: the first `budget` violations are blocked, later ones if
    safety asks for it. `events` (trace_id, violation, safety and the order ts, event_id)."""
    nth = F.sum(F.col("violation").cast("long")).over(Window.partitionBy("trace_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("action", F.when(~F.col("violation"), "pass").when((nth > budget) & ~F.col("safety"), "skip").otherwise("block"))


def intervention_summary(actions: DataFrame) -> DataFrame:
    """action, n, per_100 events."""
    total = actions.agg(F.count("*").alias("total"))
    return actions.groupBy("action").agg(F.count("*").alias("n")).join(total).select("action", "n", (F.col("n") * 100.0 / F.col("total")).alias("per_100"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there now, as a table in the shared folder.

    Each micro-batch has a folder of its own, so one that is tried again replaces its rows. In complete mode the last batch counts.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    schema = stream.schema

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out").select(schema.names)
