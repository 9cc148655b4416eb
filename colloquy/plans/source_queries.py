"""Queries of the sources and sinks, over documents and sheets that Spark derives from the given tables, and of the streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.plans.analytics_queries import rd, rounded
from colloquy.plans.registry import query
from colloquy.plans.text_queries import has
from colloquy.plans.views import DUCK, duck
from colloquy.sources import traces as A
from colloquy.sources.shared import shared_path
from colloquy.streaming import guards as N


def _documents(v, name: str) -> str:
    """Trace documents, one JSON object per line, of the conversations; the path."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: m)
    docs = v.table("conversations").groupBy("conv_id").agg(turns.alias("messages"))
    docs = docs.select(F.concat(F.lit("t"), "conv_id").alias("id"), F.struct(F.concat(F.lit("s"), F.col("conv_id") % 7).alias("id")).alias("scenario"), F.struct("messages").alias("conversation"),
                       F.when(F.col("conv_id") % 10 < 9, F.struct((F.size("messages") / 10.0).alias("hard_score"))).alias("score_report"))
    path = shared_path(v.spark, name)
    docs.select(F.to_json(F.struct("*"))).write.text(path)
    return path


@query("a1_read_traces", "SELECT concat('t', CAST(conv_id AS VARCHAR)) AS trace_id, concat('s', CAST(any_value(conv_id % 7) AS VARCHAR)) AS scenario_id, " + rd("count(*) / 10.0", "hard") + " FROM conversations WHERE conv_id % 10 < 9 GROUP BY conv_id")
def a1(v):
    docs = A.read_traces(v.spark, _documents(v, "traces"), multiline=False)
    return docs.select(F.col("id").alias("trace_id"), F.col("scenario.id").alias("scenario_id"), F.round(F.col("score_report.hard_score") + 1e-9, 6).alias("hard"))


@query("a2_read_scenarios", "SELECT concat('s', CAST(c_custkey % 100 AS VARCHAR)) AS id, 'base' AS difficulty FROM customer GROUP BY 1 UNION ALL SELECT concat('s', CAST(c_custkey % 100 + 100 AS VARCHAR)), 'more' FROM customer GROUP BY 1")
def a2(v):
    ids = v.table("customer").select((F.col("c_custkey") % 100).alias("n")).distinct()
    paths = []
    for name, shifts in (("base", (0,)), ("more", (0, 100))):
        rows = ids.select(F.explode(F.array(*(F.concat(F.lit("s"), F.col("n") + s) for s in shifts))).alias("id"), F.lit(name).alias("difficulty"))
        paths.append(shared_path(v.spark, f"scenarios-{name}"))
        rows.write.json(paths[-1])
    return A.read_scenarios(v.spark, paths, "id string, difficulty string", multiline=False)


@query("a3_read_jsonl", "SELECT o_orderkey AS trace_id, o_orderpriority AS model FROM orders")
def a3(v):
    path = shared_path(v.spark, "manifest")
    v.runs.select("trace_id", "model").write.json(path)
    return A.read_jsonl(v.spark, path, "trace_id long, model string")


@query("a4_read_rating_sheet", "SELECT c_custkey AS trace_id, concat('B', CAST(c_custkey AS VARCHAR)) AS blind_id, concat('r', CAST(c_custkey % 3 AS VARCHAR)) AS rater, CASE WHEN c_custkey % 6 <> 5 THEN CAST(c_custkey % 6 AS INTEGER) END AS overall FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 4 > 0")
def a4(v):
    key, path = F.col("c_custkey"), shared_path(v.spark, "sheet")
    sheet = v.table("customer").select(F.concat(F.lit("B"), key).alias("blind_id"), F.when(key % 3 > 0, F.concat(F.lit("r"), key % 3)).otherwise("").alias("rater"), F.when(key % 6 == 5, "n/a").otherwise((key % 6).cast("string")).alias("overall"))
    sheet.write.csv(path, header=True)
    mapping = v.table("customer").where(key % 4 > 0).select(F.concat(F.lit("B"), key).alias("blind_id"), key.alias("trace_id"))
    return A.read_rating_sheet(v.spark, path, mapping, ["overall"])


@query("a5_flatten_messages", "SELECT concat('t', CAST(conv_id AS VARCHAR)) AS trace_id, CAST(turn AS INTEGER) AS turn, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text AS content FROM conversations WHERE conv_id % 10 < 9")
def a5(v):
    return A.messages(A.read_traces(v.spark, _documents(v, "flat"), multiline=False)).select("trace_id", "turn", "role", "content")


@query("a6_write_locked", "SELECT o_orderkey AS trace_id, o_orderstatus AS scenario FROM orders")
def a6(v):
    path = shared_path(v.spark, "locked")
    A.write_locked(v.runs.select("trace_id", "scenario"), path, "trace_id")
    return A.read_jsonl(v.spark, path, "trace_id long, scenario string")


@query("a6_fingerprint", """WITH h AS (SELECT sha256(concat('{"scenario":"', o_orderstatus, '","trace_id":', CAST(o_orderkey AS VARCHAR), '}')) AS h FROM orders), a AS (SELECT left(h, 6) AS p, h FROM h),
    b AS (SELECT left(p, 4) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM a GROUP BY left(p, 4)), c AS (SELECT left(p, 2) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM b GROUP BY left(p, 2))
    SELECT sha256(string_agg(h, '' ORDER BY p, h)) AS fingerprint, true AS refused FROM c""")
def a6_fingerprint(v):
    """The fingerprint, and whether a second write of the same predictions is refused."""
    path, rows = shared_path(v.spark, "locked"), v.runs.select("trace_id", "scenario")
    first = A.write_locked(rows, path, "trace_id")
    try:
        A.write_locked(rows, path, "trace_id")
        refused = False
    except AnalysisException:
        refused = True
    return A.fingerprint(A.read_jsonl(v.spark, path, "trace_id long, scenario string"), "trace_id").where(F.col("fingerprint") == first).withColumn("refused", F.lit(refused))


@query("a7_rescore_in_place", "SELECT concat('t', CAST(conv_id AS VARCHAR)) AS trace_id, concat('s', CAST(any_value(conv_id % 7) AS VARCHAR)) AS scenario_id, " + rd("CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE count(*) / 10.0 END", "hard") + " FROM conversations WHERE conv_id % 10 < 9 GROUP BY conv_id")
def a7(v):
    docs = A.read_traces(v.spark, _documents(v, "rescored"), multiline=False)
    scores = v.table("conversations").where("conv_id % 2 = 0").select(F.concat(F.lit("t"), "conv_id").alias("trace_id"), F.lit(0.5).alias("hard"), F.lit(None).cast("double").alias("soft"), F.lit(0.5).alias("overall")).distinct()
    return A.rescore_in_place(docs, scores).select(F.col("id").alias("trace_id"), F.col("scenario.id").alias("scenario_id"), F.round(F.col("score_report.hard_score") + 1e-9, 6).alias("hard"))


@query("a8_merge_sheets", "SELECT c_custkey AS blind_id, 'a' AS rater, c_nationkey AS overall, NULL AS notes FROM customer UNION ALL SELECT s_suppkey, 'b', s_nationkey, s_name FROM supplier")
def a8(v):
    a = v.table("customer").select(F.col("c_custkey").alias("blind_id"), F.lit("a").alias("rater"), F.col("c_nationkey").alias("overall"))
    b = v.table("supplier").select(F.col("s_suppkey").alias("blind_id"), F.lit("b").alias("rater"), F.col("s_nationkey").alias("overall"), F.col("s_name").alias("notes"))
    return A.merge_rater_sheets([a, b])


def _stream(v, name: str):
    return A.read_event_stream(v.spark, f"{v.sf_dir}/{name}.parque[t]", v.table(name).schema)  # a pattern: a table may be a file or a folder


def _said(v):
    """Messages as a stream."""
    role = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return _stream(v, "conversations").select(F.col("conv_id").alias("trace_id"), "turn", role.alias("role"), F.col("text").alias("content"))


#: The events' clock as instants, whatever the session's time zone.
UTC_SQL = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))"


def _events(v):
    """Ledger events as a stream; order within a trace is (ts, event_id)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return _stream(v, "events").select(F.col("user_id").alias("trace_id"), "event_id", F.expr(UTC_SQL).alias("ts"), F.col("event_type").alias("tool_name"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("amount"), k.alias("k"),
                                       F.when(F.col("event_type") == "error", "failed").alias("error"))


@query("a9_event_stream", "SELECT event_type AS tool_name, user_id AS trace_id, event_id FROM events")
def a9(v):
    return N.drained(_events(v).select("tool_name", "trace_id", "event_id"), "events")


@query("n1_forbidden_alerts", duck("messages") + f"SELECT trace_id, turn, CASE WHEN contains(content, 'ingre') THEN 'ingre' ELSE 'keit' END AS keyword FROM messages WHERE role = 'agent' AND {has(['ingre', 'keit'])}")
def n1(v):
    return N.drained(N.forbidden_alerts(_said(v), ["ingre", "keit"]), "alerts")


NUMBERED = f"e AS (SELECT user_id AS trace_id, event_id, event_type AS tool_name, value AS amount, {DUCK['k']} AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@query("n2_tool_gate", f"""WITH {NUMBERED}, m AS (SELECT trace_id, min(seq) FILTER (WHERE tool_name = 'click') AS c, min(seq) FILTER (WHERE tool_name = 'signup') AS s FROM e GROUP BY trace_id)
    SELECT e.trace_id, event_id, tool_name, concat_ws(',', CASE WHEN c IS NULL OR c > seq THEN 'click' END, CASE WHEN s IS NULL OR s > seq THEN 'signup' END) AS missing FROM e JOIN m ON m.trace_id = e.trace_id WHERE tool_name = 'purchase' AND (c IS NULL OR c > seq OR s IS NULL OR s > seq)""")
def n2(v):
    return N.drained(N.stateful(_events(v), N.tool_gate({"purchase": ["click", "signup"]}), "ts", "365 days"), "gate")


@query("n3_premature_end", duck("messages said policy_must", f"""{NUMBERED}, need AS (SELECT scenario_id, pos, tool_name FROM policy_must),
    c AS (SELECT trace_id, turn, scenario_id FROM said WHERE role = 'agent' AND contains(content, 'tion')),
    x AS (SELECT c.trace_id, c.turn, string_agg(q.tool_name, ',' ORDER BY pos) FILTER (WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.trace_id = c.trace_id AND e.tool_name = q.tool_name AND e.seq <= c.turn)) AS missing
      FROM c JOIN need q ON q.scenario_id = c.scenario_id GROUP BY ALL),
    y AS (SELECT x.trace_id, x.turn, coalesce(missing, '') AS missing, (SELECT max(u.turn) FROM messages u WHERE u.trace_id = x.trace_id AND u.role = 'user' AND u.turn < x.turn AND u.turn >= x.turn - 2 AND contains(u.content, 'th')) AS negative_turn FROM x)""")
    + "SELECT trace_id, turn, missing, negative_turn FROM y WHERE missing <> '' OR negative_turn IS NOT NULL")
def n3(v):
    """Event number `seq` of a trace's ledger stands before its message of that turn. The three tools of the policy are required before the end."""
    needs = v.policy_must.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tool_name"))).alias("all")).select("scenario_id", F.col("all.tool_name").alias("required"))
    said = v.said.join(needs, "scenario_id", "left").select(
        "trace_id", "turn", F.lit(1).alias("place"), "role", T.any_of(F.col("content"), ["th"]).alias("negative"), T.any_of(F.col("content"), ["tion"]).alias("ending"), "required", F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("boolean").alias("ok"))
    calls = v.ledger.select("trace_id", F.col("seq").alias("turn"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(False).alias("negative"), F.lit(False).alias("ending"), F.lit(None).cast("array<string>").alias("required"),
                            "tool_name", (F.col("event_type") != "tool_failed").alias("ok"))
    both = said.unionByName(calls.join(said.select("trace_id").distinct(), "trace_id", "left_semi")).withColumn("clock", F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000))
    path = shared_path(v.spark, "dialogue")
    both.write.parquet(path)
    return N.drained(N.stateful(A.read_event_stream(v.spark, path, both.schema), N.premature_end(2), "clock", "30 days"), "ends")


@query("n4_guard_budget", f"""WITH {NUMBERED}, x AS (SELECT *, amount > 70 AS violation, k % 5 = 0 AS safety, sum(CASE WHEN amount > 70 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS nth FROM e)
    SELECT trace_id, event_id, CASE WHEN NOT violation THEN 'pass' WHEN nth > 6 AND NOT safety THEN 'skip' ELSE 'block' END AS action FROM x""")
def n4(v):
    rows = _events(v).withColumns({"violation": F.col("amount") > 70, "safety": F.col("k") % 5 == 0})
    return N.drained(N.stateful(rows, N.guard_budget(), "ts", "365 days"), "budget").drop("level")


@query("n5_chain_check", f"""WITH {NUMBERED}, h AS (SELECT trace_id, event_id, seq, md5(CAST(event_id AS VARCHAR)) AS own, CASE WHEN k = 13 THEN 'x' ELSE '' END AS broken FROM e) SELECT trace_id, min(event_id) FILTER (WHERE broken = 'x' AND seq = f) AS bad_seq
    FROM (SELECT *, min(seq) FILTER (WHERE broken = 'x') OVER (PARTITION BY trace_id) AS f FROM h) GROUP BY trace_id HAVING min(f) IS NOT NULL""")
def n5(v):
    from pyspark.sql.window import Window

    k = F.get_json_object("props", "$.k").cast("long")
    before = F.coalesce(F.lag(F.md5(F.col("event_id").cast("string"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("0" * 64))
    chained = v.table("events").select(F.col("user_id").alias("trace_id"), F.expr(UTC_SQL).alias("ts"), F.col("event_id").alias("seq"), F.md5(F.col("event_id").cast("string")).alias("own_hash"), F.when(k == 13, "x").otherwise(before).alias("prev_hash"))
    path = shared_path(v.spark, "ledger")
    chained.write.parquet(path)
    rows = A.read_event_stream(v.spark, path, chained.schema)
    return N.drained(N.stateful(rows, N.chain_check(), "ts", "365 days"), "chain")


@query("n6_session_scores", f"""WITH g AS (SELECT user_id AS trace_id, ts, event_type, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT trace_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, {rd('sum(value)', 'total')} FROM s GROUP BY trace_id, n""")
def n6(v):
    e = v.table("events").select(F.col("user_id").alias("trace_id"), F.expr(UTC_SQL).alias("ts"), F.col("value").alias("amount"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    rows = N.session_scores(e, "6 hours").select("trace_id", F.expr("unix_micros(session_start)").alias("start_us"), "events", "errors", "total")
    return rounded(rows, "trace_id", "start_us", "events", "errors")


@query("n6_stream_session_scores", f"""WITH g AS (SELECT user_id AS trace_id, ts, event_type, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT trace_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, {rd('sum(value)', 'total')} FROM s GROUP BY trace_id, n
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def n6_stream(v):
    """As a stream: a session is given once the watermark has passed its end."""
    rows = N.drained(N.session_scores(_events(v), "6 hours"), "sessions").select("trace_id", F.expr("unix_micros(session_start)").alias("start_us"), "events", "errors", "total")
    return rounded(rows, "trace_id", "start_us", "events", "errors")


@query("n7_violation_rate", f"SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, event_type AS tool_name, count(*) AS events, {rd('avg(CASE WHEN value > 70 THEN 1.0 ELSE 0.0 END)', 'rate')} FROM events GROUP BY ALL")
def n7(v):
    made = N.drained(N.violation_rate(_events(v), F.col("amount") > 70), "rates", "complete")
    return rounded(made.select(F.expr("unix_micros(window_start)").alias("start_us"), "tool_name", "events", "rate"), "start_us", "tool_name", "events")


@query("n8_dedup_events", "SELECT user_id AS trace_id, event_id FROM events")
def n8(v):
    twice = _events(v).select("trace_id", "event_id", "ts").union(_events(v).select("trace_id", "event_id", "ts"))
    return N.drained(N.dedup_events(twice, ["trace_id", "event_id"]), "dedup").select("trace_id", "event_id")


@query("n9_intervention_summary", f"""WITH {NUMBERED}, x AS (SELECT *, amount > 70 AS violation, k % 5 = 0 AS safety, sum(CASE WHEN amount > 70 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS nth FROM e),
    a AS (SELECT CASE WHEN NOT violation THEN 'pass' WHEN nth > 6 AND NOT safety THEN 'skip' ELSE 'block' END AS action FROM x) SELECT action, count(*) AS n, {rd('count(*) * 100.0 / (SELECT count(*) FROM a)', 'per_100')} FROM a GROUP BY action""")
def n9(v):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = v.table("events").select(F.col("user_id").alias("trace_id"), "event_id", "ts", (F.col("value") > 70).alias("violation"), (k % 5 == 0).alias("safety"))
    return rounded(N.intervention_summary(N.guard_actions(rows)), "action", "n")
