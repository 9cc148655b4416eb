"""Queries of the source-level filters, joins and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import fuzzy
from colloquy.functions import text as T
from colloquy.functions.semantic import Concept, SemanticPredicate, semantic_match
from colloquy.operators import filters as B
from colloquy.operators import joins as C
from colloquy.operators import verify as V
from colloquy.plans.analytics_queries import TAKEN, rd, rounded, taken_branches
from colloquy.plans.registry import query
from colloquy.plans.scoring_queries import near
from colloquy.plans.views import duck

#: Lists of words that really occur in the given tables; the defaults are Chinese.
NO = ["nicht", "pas ", "not "]
BUT = ["aber", "mais", "with"]
WORDS = ["the", "und", "que", "ción"]


@query("b1_scored_messages", duck("messages") + "SELECT trace_id, turn, role FROM messages WHERE NOT (turn >= 3 AND trace_id % 4 = 0)")
def b1(v):
    return B.scored_messages(v.messages.withColumn("post_call", F.expr("turn >= 3 and trace_id % 4 = 0"))).select("trace_id", "turn", "role")


@query("b2_agent_safe_view", duck("runs") + "SELECT trace_id, model, scenario FROM runs")
def b2(v):
    rows = v.runs.select("trace_id", "model", "scenario", F.col("overall").alias("expected_call_result"), F.col("hard").alias("must_call_tools"))
    return B.agent_safe_view(rows)


BACK = "b AS (SELECT DISTINCT trace_id, call_id FROM ledger WHERE event_type = 'tool_rollback')"


@query("b3_successful_tool_events", duck("ledger", BACK) + """SELECT trace_id, seq, tool_name FROM ledger l WHERE event_type = 'tool_executed' AND error IS NULL AND source <> 'guard'
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.trace_id = l.trace_id AND b.call_id = l.call_id) AND (order_id IS NULL OR order_id = 'MT' || CAST(trace_id % 4 AS VARCHAR))""")
def b3(v):
    own = v.ledger.select("trace_id").distinct().withColumn("order_id", F.concat(F.lit("MT"), (F.col("trace_id") % 4).cast("string")))
    return B.successful_tool_events(v.ledger, own).select("trace_id", "seq", "tool_name")


@query("b4_successful_calls", duck("ledger") + "SELECT trace_id, seq, tool_name FROM ledger WHERE error IS NULL AND (tool_name NOT IN ('signup', 'purchase') OR order_id IS NOT NULL)")
def b4(v):
    return B.successful_calls(v.ledger, ["signup", "purchase"]).select("trace_id", "seq", "tool_name")


@query("b5_eligible_runs", duck("runs") + "SELECT trace_id, model FROM runs WHERE overall IS NOT NULL AND NOT regexp_matches(model, '^(1|5)-') AND trace_id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)")
def b5(v):
    return B.eligible_runs(v.runs, v.runs.where("cust % 3 = 0"), "^(1|5)-").select("trace_id", "model")


@query("b6_tool_markup_leaks", duck("messages") + "SELECT trace_id, turn FROM messages WHERE role = 'agent' AND regexp_matches(content, 'tion[a-z]*\\. The|\\| ') AND NOT (trace_id % 3 = 0 AND turn % 2 = 1)")
def b6(v):
    return B.tool_markup_leaks(v.messages, v.messages.where("trace_id % 3 = 0 and turn % 2 = 1"), r"tion[a-z]*\. The|\| ")


@query("b7_find_traces", duck("runs") + "SELECT trace_id FROM runs WHERE contains(CAST(trace_id AS VARCHAR), '123') OR contains(CAST(trace_id AS VARCHAR), '77')")
def b7(v):
    return B.find_traces(v.runs.select("trace_id"), v.values("wanted string", [("123",), ("77",)]))


@query("b8_validate_tool_calls", duck("ledger", """c AS (SELECT *, concat('MT', CAST(trace_id % 3 AS VARCHAR)) AS own, repeat('x', CAST(k * 6 AS INTEGER)) AS note, concat(lpad(CAST(k % 27 AS VARCHAR), 2, '0'), ':', lpad(CAST(k % 70 AS VARCHAR), 2, '0')) AS slot FROM ledger),
    f AS (SELECT trace_id, seq, CASE WHEN order_id IS NULL THEN 'missing_order' WHEN order_id <> own THEN 'wrong_order' WHEN length(note) > 500 THEN 'long_text' WHEN amount IS NULL OR amount <= 0 THEN 'bad_amount' WHEN amount > 90 THEN 'too_much'
      WHEN NOT regexp_matches(slot, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN 'bad_time' WHEN error IS NOT NULL THEN 'failed' END AS fault FROM c)""") + "SELECT trace_id, seq, fault FROM f WHERE fault IS NOT NULL")
def b8(v):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    calls = v.ledger.withColumns({"own_order": F.concat(F.lit("MT"), (F.col("trace_id") % 3).cast("string")), "note": F.expr("repeat('x', cast(k * 6 as int))"),
                                  "slot": F.concat(two(F.col("k") % 27), F.lit(":"), two(F.col("k") % 70))})
    return B.validate_tool_calls(calls, most=90)


#: Policies with faults: some customers have no steps, no name, a branch to nowhere, or nothing forbidden.
LINTED = """sc AS (SELECT c_custkey AS scenario_id, CASE c_custkey % 4 WHEN 0 THEN 'bought' WHEN 1 THEN 'viewed' ELSE 'other' END AS outcome, CASE WHEN c_custkey % 9 = 0 THEN 'An AI calls' ELSE 'Hello' END AS opening,
      CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS customer_name FROM customer), st AS (SELECT * FROM policies WHERE scenario_id % 11 > 0), fb AS (SELECT DISTINCT scenario_id FROM policies WHERE scenario_id % 6 > 0),
    br AS (SELECT scenario_id, step_id, CASE WHEN scenario_id % 10 = 1 AND cond = 'away' THEN 'nowhere' ELSE next_step END AS next_step FROM policy_branches WHERE scenario_id % 11 > 0),
    mu AS (SELECT scenario_id, CASE WHEN scenario_id % 7 = 0 AND pos = 2 THEN 'ghost' ELSE tool_name END AS tool_name FROM policy_must), tools AS (SELECT DISTINCT tool_name FROM traced WHERE tool_name <> 'view'),
    f AS (SELECT *, row_number() OVER w AS r, lead(step_id) OVER w AS nxt FROM st WINDOW w AS (PARTITION BY scenario_id ORDER BY ord)),
    rc AS (SELECT scenario_id, step_id FROM f WHERE r = 1 UNION SELECT scenario_id, nxt FROM f WHERE NOT is_optional UNION SELECT b.scenario_id, b.next_step FROM br b JOIN f ON f.scenario_id = b.scenario_id AND f.step_id = b.step_id AND NOT is_optional)"""


@query("b9_lint_policies", duck("policies policy_branches policy_must traced", LINTED) + """SELECT scenario_id, 'S001' AS rule, 'error' AS severity, CAST(NULL AS VARCHAR) AS subject FROM sc WHERE scenario_id NOT IN (SELECT scenario_id FROM st)
    UNION ALL SELECT scenario_id, 'S002', 'warning', step_id FROM f WHERE NOT is_optional AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.scenario_id = f.scenario_id AND rc.step_id = f.step_id)
    UNION ALL SELECT DISTINCT scenario_id, 'B001', 'error', next_step FROM br WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.scenario_id = br.scenario_id AND st.step_id = br.next_step)
    UNION ALL SELECT DISTINCT scenario_id, 'T001', 'error', tool_name FROM mu WHERE tool_name NOT IN (SELECT tool_name FROM tools)
    UNION ALL SELECT DISTINCT scenario_id, 'T002', 'info', action FROM st WHERE action NOT IN (SELECT tool_name FROM tools) AND NOT starts_with(action, 'sign')
    UNION ALL SELECT scenario_id, 'I001', 'warning', NULL FROM sc WHERE customer_name = '' AND scenario_id IN (SELECT scenario_id FROM st WHERE action = 'click')
    UNION ALL SELECT scenario_id, 'O001', 'warning', outcome FROM sc WHERE outcome <> 'other' AND NOT EXISTS (SELECT 1 FROM mu WHERE mu.scenario_id = sc.scenario_id AND mu.tool_name = CASE sc.outcome WHEN 'bought' THEN 'purchase' ELSE 'view' END)
    UNION ALL SELECT DISTINCT scenario_id, 'O002', 'info', NULL FROM mu WHERE scenario_id NOT IN (SELECT scenario_id FROM mu WHERE tool_name = 'signup')
    UNION ALL SELECT scenario_id, 'R001', 'info', NULL FROM sc WHERE contains(opening, 'AI') UNION ALL SELECT scenario_id, 'R002', 'info', NULL FROM sc WHERE scenario_id NOT IN (SELECT scenario_id FROM fb)""")
def b9(v):
    sid = F.col("scenario_id")
    scenarios = v.table("customer").selectExpr("c_custkey AS scenario_id", "CASE c_custkey % 4 WHEN 0 THEN 'bought' WHEN 1 THEN 'viewed' ELSE 'other' END AS outcome",
                                               "if(c_custkey % 9 = 0, 'An AI calls', 'Hello') AS opening", "if(c_custkey % 5 = 0, '', c_name) AS customer_name", "cast(null as string) AS role")
    steps, forbidden = v.policies.where(sid % 11 > 0), v.policies.where(sid % 6 > 0).select("scenario_id")
    branches = v.policy_branches.where(sid % 11 > 0).withColumn("next_step", F.when((sid % 10 == 1) & (F.col("cond") == "away"), "nowhere").otherwise(F.col("next_step")))
    must = v.policy_must.withColumn("tool_name", F.when((sid % 7 == 0) & (F.col("pos") == 2), "ghost").otherwise(F.col("tool_name")))
    tools = v.ledger.where("tool_name <> 'view'").select("tool_name")
    return B.lint_policies(scenarios, steps, branches, must, forbidden, tools, speech=["sign"], outcome_tools={"bought": "purchase", "viewed": "view"}, identity=["click"], log_tool="signup")


@query("b10_validate_policies", duck("checks", "s AS (SELECT trace_id, check_id FROM checks GROUP BY ALL HAVING count(*) > 1)") + "SELECT DISTINCT 'repeated_step' AS rule, check_id AS subject FROM s UNION ALL SELECT DISTINCT 'weight', check_id FROM checks WHERE qty - 2 <= 0 UNION ALL SELECT DISTINCT 'self_branch', check_id FROM checks WHERE part % 7 = supp % 7")
def b10(v):
    steps = v.checks.select(F.col("trace_id").alias("scenario_id"), F.col("check_id").alias("step_id"), F.xxhash64("part", "supp", "qty", "check_id").alias("ord"), (F.col("qty") - 2).alias("weight"))
    branches = v.checks.select(F.col("check_id").alias("step_id"), F.when(F.expr("part % 7 = supp % 7"), F.col("check_id")).alias("next_step"))
    return B.validate_policies(steps, branches)


@query("b11_feasible_slots", """WITH n AS (SELECT c_custkey AS scenario_id, c_nationkey AS kind, c_custkey % 30 AS day, c_acctbal / 5 + 900 AS budget, c_custkey % 8 + 1 AS heads FROM customer),
    s AS (SELECT s_suppkey AS place_id, s_nationkey AS kind, s_acctbal AS price FROM supplier), t AS (SELECT place_id, kind, d AS day, (place_id * 7 + d) % 10 AS seats FROM s, range(30) r(d)),
    f AS (SELECT scenario_id, count(*) AS c FROM n JOIN t USING (kind, day) JOIN s ON s.place_id = t.place_id WHERE seats >= heads AND price <= budget GROUP BY 1)
    SELECT n.scenario_id, coalesce(c, 0) AS n_slots FROM n LEFT JOIN f ON n.scenario_id = f.scenario_id""")
def b11(v):
    c, s = v.table("customer"), v.table("supplier")
    needs = c.select(F.col("c_custkey").alias("scenario_id"), F.col("c_nationkey").alias("kind"), (F.col("c_custkey") % 30).alias("day"), (F.col("c_acctbal") / 5 + 900).alias("budget"), (F.col("c_custkey") % 8 + 1).alias("heads"))
    places = s.select(F.col("s_suppkey").alias("place_id"), F.col("s_acctbal").alias("price"))
    slots = s.select(F.col("s_suppkey").alias("place_id"), F.col("s_nationkey").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day"))
    return B.feasible_slots(needs, places, slots.withColumn("seats", (F.col("place_id") * 7 + F.col("day")) % 10))


@query("c1_attach_scenario", duck("runs") + "SELECT trace_id, CASE scenario WHEN 'F' THEN 12 WHEN 'O' THEN 20 END AS max_turns FROM runs")
def c1(v):
    known, unknown = C.attach_scenario(v.runs, F.broadcast(v.values("scenario string, max_turns int", [("F", 12), ("O", 20)])))
    return known.select("trace_id", "max_turns").unionByName(unknown.select("trace_id", F.lit(None).cast("int").alias("max_turns")))


@query("c2_drop_rolled_back", duck("ledger", BACK) + "SELECT trace_id, seq FROM ledger l WHERE event_type = 'tool_executed' AND NOT EXISTS (SELECT 1 FROM b WHERE b.trace_id = l.trace_id AND b.call_id = l.call_id)")
def c2(v):
    return B.drop_rolled_back(v.ledger).select("trace_id", "seq")


@query("c3_fabricated_calls", duck("ledger") + "SELECT trace_id, seq FROM ledger a WHERE error IS NULL AND NOT EXISTS (SELECT 1 FROM ledger b WHERE b.trace_id = a.trace_id AND b.call_id = a.call_id AND b.amount > 50)")
def c3(v):
    return C.fabricated_calls(v.ledger, v.ledger.where("amount > 50")).select("trace_id", "seq")


#: Each customer forbids two behaviours by words of its own; delivered texts are shorter than raw ones in some turns.
FORBIDDEN = """fb AS (SELECT c_custkey AS scenario_id, 'promise' AS behavior_id, 'critical' AS severity, CASE c_custkey % 2 WHEN 0 THEN ['ingre', 'keit'] ELSE ['pas', 'thth'] END AS kw FROM customer
      UNION ALL SELECT c_custkey, 'leak', 'minor', CASE c_custkey % 3 WHEN 0 THEN ['tion', 'ment'] ELSE ['der', 'la'] END FROM customer),
    m AS (SELECT trace_id, scenario_id, turn, lower(content) AS raw, lower(CASE WHEN turn % 2 = 0 THEN content ELSE split_part(content, '. ', 1) END) AS norm FROM said WHERE role = 'agent'),
    h AS (SELECT trace_id, behavior_id, turn, severity, list_filter(list_concat(list_slice(kw, 1, 1), CASE WHEN kw[1] = 'ingre' THEN ['ngin'] ELSE [] END, list_slice(kw, 2, 2)), lambda w: contains(norm, w))[1] AS k1,
        list_filter(list_concat(list_slice(kw, 1, 1), CASE WHEN kw[1] = 'ingre' THEN ['ngin'] ELSE [] END, list_slice(kw, 2, 2)), lambda w: contains(raw, w))[1] AS k2 FROM m JOIN fb USING (scenario_id))"""


@query("c4_forbidden_hits", duck("said", FORBIDDEN) + "SELECT trace_id, behavior_id, turn, CASE WHEN k1 IS NULL THEN 'major' ELSE severity END AS severity, coalesce(k1, k2) AS keyword FROM h WHERE k2 IS NOT NULL OR k1 IS NOT NULL")
def c4(v):
    own = v.table("customer").select(F.col("c_custkey").alias("scenario_id"), F.expr("""inline(array(struct('promise', 'critical', if(c_custkey % 2 = 0, array('ingre', 'keit'), array('pas', 'thth'))),
        struct('leak', 'minor', if(c_custkey % 3 = 0, array('tion', 'ment'), array('der', 'la'))))) AS (behavior_id, severity, keywords)"""))
    shown = F.when(F.col("turn") % 2 == 0, F.col("content")).otherwise(F.split_part("content", F.lit(". "), F.lit(1)))
    rows = v.said.withColumns({"norm": fuzzy.normalize_text(shown), "norm_raw": fuzzy.normalize_text(F.col("content"))})
    return C.forbidden_hits(rows, own, {"ingre": ["ngin"]})


@query("c5_branch_evidence", duck("messages", "b AS (SELECT DISTINCT trace_id, trace_id % 5 AS bt FROM messages)")
       + """SELECT m.trace_id, 's' AS step_id, turn, c AS cond FROM (SELECT trace_id, turn, unnest(list_filter([CASE WHEN contains(content, 'the') OR contains(content, 'und') THEN 'home' END, CASE WHEN contains(content, 'que') THEN 'away' END], lambda x: x IS NOT NULL)) AS c
    FROM messages WHERE role = 'user') m JOIN b ON b.trace_id = m.trace_id WHERE turn BETWEEN bt - 1 AND bt + 2""")
def c5(v):
    turns = v.messages.select("trace_id", F.lit("s").alias("step_id"), (F.col("trace_id") % 5).alias("branch_turn")).distinct()
    return C.branch_evidence(v.users, turns, {"home": ["the", "und"], "away": ["que"]})


@query("c6_first_response", duck("messages") + "SELECT a.trace_id, a.turn, (SELECT min(u.turn) FROM messages u WHERE u.role = 'user' AND u.trace_id = a.trace_id AND u.turn >= a.turn) AS response_turn FROM messages a WHERE a.role = 'agent'")
def c6(v):
    return C.first_response_after(v.agents, v.users)


@query("c7_state_match", duck("checks", """e AS (SELECT trace_id, line AS row_id, status AS table_name, unnest(['a', 'b']) AS key, unnest([CAST(qty % 3 AS VARCHAR), CAST(part % 2 AS VARCHAR)]) AS value FROM (SELECT trace_id, line, min(status) AS status, min(qty) AS qty, min(part) AS part FROM checks GROUP BY ALL)),
    a AS (SELECT trace_id, status AS table_name, part * 1000 + supp AS row_idx, unnest(['a', 'b']) AS key, unnest([CAST(qty % 3 AS VARCHAR), CAST(supp % 2 AS VARCHAR)]) AS value FROM checks),
    h AS (SELECT trace_id, row_id, row_idx, count(*) AS n FROM e JOIN a USING (trace_id, table_name, key, value) GROUP BY ALL), b AS (SELECT trace_id, row_id, max(n) AS n FROM h GROUP BY ALL),
    w AS (SELECT trace_id, row_id, count(*) AS need FROM e GROUP BY ALL), r AS (SELECT w.trace_id, CASE WHEN coalesce(n, 0) >= need THEN 1 ELSE 0 END AS ok FROM w LEFT JOIN b ON b.trace_id = w.trace_id AND b.row_id = w.row_id)""")
       + f"SELECT trace_id, CAST(sum(ok) AS BIGINT) AS matched, count(*) AS total, {rd('avg(ok)', 'score')} FROM r GROUP BY trace_id")
def c7(v):
    pairs = lambda x: F.explode(F.array(F.struct(F.lit("a").alias("key"), (F.col("qty") % 3).cast("string").alias("value")), F.struct(F.lit("b").alias("key"), (F.col(x) % 2).cast("string").alias("value"))))
    one = v.checks.groupBy("trace_id", "line").agg(F.min("status").alias("table_name"), F.min("qty").alias("qty"), F.min("part").alias("part"))
    expected = one.select("trace_id", F.col("line").alias("row_id"), "table_name", pairs("part").alias("p")).select("trace_id", "row_id", "table_name", "p.*")
    actual = v.checks.select("trace_id", F.col("status").alias("table_name"), (F.col("part") * 1000 + F.col("supp")).alias("row_idx"), pairs("supp").alias("p")).select("trace_id", "table_name", "row_idx", "p.*")
    return rounded(C.state_match(actual, expected), "trace_id", "matched", "total")


@query("c9_coverage_gaps", duck("traced policy_branches", TAKEN) + "SELECT scenario_id, step_id, next_step FROM policy_branches EXCEPT SELECT * FROM taken")
def c9(v):
    return C.coverage_gaps(v.policy_branches, taken_branches(v)).select("scenario_id", "step_id", "next_step")


@query("c11_validated_outcome", duck("ledger") + """SELECT trace_id, coalesce(max(seq) FILTER (WHERE tool_name = 'signup') <= min(seq) FILTER (WHERE tool_name = 'purchase'), false) AND coalesce(bool_or(amount > 60 AND k > 10), false) AS valid
    FROM ledger GROUP BY trace_id""")
def c11(v):
    return C.validated_outcome(v.ledger, "signup", "purchase", F.expr("amount > 60 and k > 10"))


GRID = "[" + ", ".join("struct_pack(config := '{}', score := {})".format("full" if x is None else f"no_{x}", " + ".join(f"coalesce({k}, 0) * {w}" for k, w in
        (("hard", 0.30), ("step", 0.24), ("branch", 0.14), ("temporal", 0.12), ("path", 0.08)) if k != x)) for x in (None, "hard", "step", "branch", "temporal", "path")) + "]"


@query("c12_replay_grid", duck("runs") + f"SELECT trace_id, g.config AS config, {rd('g.score', 'score')} FROM (SELECT trace_id, unnest({GRID}) AS g FROM runs)")
def c12(v):
    return rounded(C.replay_grid(v.runs), "trace_id", "config")


@query("d1_normalize_text", duck("messages") + "SELECT trace_id, turn, lower(content) AS norm FROM messages")
def d1(v):
    return v.messages.select("trace_id", "turn", fuzzy.normalize_text(F.col("content")).alias("norm"))


def has_(c: str, words: list[str]) -> str:
    return has(words, c)


def has(words: list[str], c: str = "content") -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


NEGATION = f"CASE WHEN contains(content, 'zz') THEN 'negated' WHEN {has(['not the'])} THEN 'ambiguous' WHEN {has(NO)} THEN CASE WHEN {has(BUT)} THEN 'ambiguous' ELSE 'negated' END WHEN ends_with(content, 'on.') THEN 'negated' ELSE 'clear' END"
LISTS = {"prefix": NO, "suffix": ["on."], "double": ["not the"], "contrast": BUT}


@query("d2_negation_status", duck("messages") + f"SELECT trace_id, turn, {NEGATION} AS status FROM messages")
def d2(v):
    return v.messages.select("trace_id", "turn", T.negation_status(F.col("content"), ["zz"], **LISTS).alias("status"))


@query("d3_unnegated_keyword", duck("messages", """p AS (SELECT trace_id, turn, content AS t FROM messages),
    o AS (SELECT trace_id, turn, t, unnest(range(1, length(t) + 1)) AS i FROM p), h AS (SELECT trace_id, turn, bool_or(length(regexp_extract(substr(t, greatest(i - 6, 1), least(i - 1, 6)), '[^.]*$')) - length(replace(regexp_extract(substr(t, greatest(i - 6, 1), least(i - 1, 6)), '[^.]*$'), 'e', '')) IN (0, 2, 4, 6)) AS ok
      FROM o WHERE substr(t, i, 2) = 'th' GROUP BY ALL)""") + "SELECT p.trace_id, p.turn, coalesce(ok, false) AS found FROM p LEFT JOIN h ON h.trace_id = p.trace_id AND h.turn = p.turn")
def d3(v):
    return v.messages.select("trace_id", "turn", T.unnegated_keyword(F.col("content"), F.lit("th"), ["e"], 6, ".").alias("found"))


GRAMS = "list_distinct(list_concat(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)), list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))))"


@query("d4_dice", "WITH p AS (SELECT p_partkey, p_name AS a, concat(p_type, p_brand) AS b FROM part), g AS (SELECT p_partkey, " + GRAMS.format("lower(a)") + " AS x, " + GRAMS.format("lower(b)") + f" AS y FROM p) SELECT p_partkey, {rd('2.0 * len(list_intersect(x, y)) / (len(x) + len(y))', 'dice')}, CAST(len(x) AS INTEGER) AS n FROM g")
def d4(v):
    a, b = F.lower("p_name"), F.lower(F.concat("p_type", "p_brand"))
    return v.table("part").select("p_partkey", near(T.dice(a, b), "dice"), F.size(T.char_ngrams(a)).alias("n"))


@query("d5_alias_match")
def d5(v):
    """No SQL: windows are scored by difflib."""
    return v.messages.select("trace_id", "turn", fuzzy.alias_match_score(F.lit("thention"), F.col("content")).alias("score"))


#: Aliases of one letter class each, so that the score of an alias that isn't contained is 0 and SQL can tell.
MEANT = SemanticPredicate(positive=["the th"], negative=["zz", "qu"], concepts=[Concept(["un", "de"], 2.0), Concept(["en"], 1.0, required=False)], keywords=["tion", "keit", "ing", "er"], ratio=0.5, negation_terms=["zz"])
COVERED = f"((CASE WHEN {has_('lower(content)', ['un', 'de'])} THEN 2.0 ELSE 0.7 END) + (CASE WHEN contains(lower(content), 'en') THEN 1.0 ELSE 0.0 END)) / 3.0 >= 0.86"


@query("d6_semantic_predicate", duck("messages") + f"""SELECT trace_id, turn, NOT {has_('lower(content)', ['zz', 'qu'])} AND ({NEGATION.replace('content', 'lower(content)')}) = 'clear' AND (contains(lower(content), 'the th') OR {COVERED}
    OR ({" + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in MEANT.keywords)}) >= 2) AS hit FROM messages""")
def d6(v):
    return v.messages.select("trace_id", "turn", semantic_match(F.col("content"), MEANT, **LISTS).alias("hit"))


@query("d7_extract_keywords", """SELECT doc_id, array_to_string(list_distinct(list_concat(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?%?)'), list_transform(regexp_extract_all(text, '([A-Za-z]{2,})'), lambda x: lower(x)))), ',') IS NOT NULL AS ok,
    CAST(len(list_distinct(list_concat(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?%?)'), list_transform(regexp_extract_all(text, '([A-Za-z]{2,})'), lambda x: lower(x))))) AS INTEGER) AS n FROM documents""")
def d7(v):
    return v.table("documents").select("doc_id", T.extract_keywords(F.col("text")).alias("k")).select("doc_id", F.col("k").isNotNull().alias("ok"), F.size("k").alias("n"))


@query("d8_template_elements", "SELECT item_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[,.!?;:\\n]+'), lambda x: trim(x)), lambda x: length(x) >= 2)) AS INTEGER) AS n FROM benchmark")
def d8(v):
    return v.table("benchmark").select("item_id", F.size(T.template_elements(F.col("text"))).alias("n"))


WANTED = [("click", {"amount": "50.5", "k": "7"}), ("view", {"k": "3.0", "odd": "TRUE"}), ("signup", {"order_id": "MT1", "odd": "false", "none": "1"}), ("purchase", {})]


@query("d9_tool_call_match", duck("ledger", """a AS (SELECT trace_id, seq, tool_name, CASE tool_name WHEN 'click' THEN (amount = 50.5)::INT + (k = 7)::INT WHEN 'view' THEN (k = 3)::INT + (k % 2 = 1)::INT
      WHEN 'signup' THEN coalesce(order_id = 'MT1', false)::INT + (k % 2 = 0)::INT ELSE 0 END AS n, CASE tool_name WHEN 'purchase' THEN 0 WHEN 'signup' THEN 3 ELSE 2 END AS need FROM ledger)""")
       + f"SELECT trace_id, seq, n = need AS matched, {rd('CASE WHEN need = 0 THEN 1.0 ELSE n / need END', 'confidence')} FROM a WHERE tool_name IN ('click', 'view', 'signup', 'purchase')")
def d9(v):
    """Arguments are VARIANT objects, as they are in ledgers."""
    made = F.parse_json(F.to_json(F.struct("amount", "k", "order_id", (F.col("k") % 2 == 1).alias("odd"))))
    calls = v.ledger.select("trace_id", "seq", "tool_name", V.variant_arguments(made).alias("arguments"))
    return rounded(V.tool_call_match(calls, v.values("tool_name string, args map<string,string>", WANTED)), "trace_id", "seq", "matched")


@query("d10_parse_bool", duck("ledger") + "SELECT trace_id, seq, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS flag FROM ledger")
def d10(v):
    said = F.element_at(F.array(*map(F.lit, (" Yes", "是", "no", "maybe"))), (F.col("k") % 4 + 1).cast("int"))
    return v.ledger.select("trace_id", "seq", T.parse_bool(said).alias("flag"))


@query("d11_fuzzy_quote")
def d11(v):
    """No SQL: positional windows. Quotes are the next messages of the trace."""
    from pyspark.sql.window import Window

    follow = F.lead("content").over(Window.partitionBy("trace_id").orderBy("msg_idx"))
    return v.messages.select("trace_id", "turn", fuzzy.fuzzy_quote_found(follow, F.col("content")).alias("found"))


@query("d11_altered_quote", duck("messages", """p AS (SELECT trace_id, turn, translate(lower(substr(content, 31, 50)), 'aeä', 'oxö') AS quote, content FROM messages WHERE length(content) > 80),
    x AS (SELECT trace_id, turn, regexp_replace(quote, '\\s', '', 'g') AS q, regexp_replace(lower(content), '\\s', '', 'g') AS s FROM p)""") + """SELECT trace_id, turn, contains(s, q) OR len(list_filter(range(1, length(s) - length(q) + 2),
      lambda i: len(list_filter(range(length(q)), lambda j: s[i + j] = q[1 + j])) >= 0.82 * length(q))) > 0 AS found FROM x""")
def d11_altered(v):
    """Passages of a message with some letters changed, in their message."""
    quote = F.translate(F.lower(F.substring("content", 31, 50)), "aeä", "oxö")
    return v.messages.where("length(content) > 80").select("trace_id", "turn", fuzzy.fuzzy_quote_found(quote, F.col("content")).alias("found"))


LEAKS = {"a": "(?i)tion[a-z]* of", "b": "(keit|heit)\\w*", "c": "qu(e|i).{0,10}le"}


@query("d12_internal_leaks", duck("messages") + "SELECT trace_id, turn, concat_ws(',', CASE WHEN regexp_matches(content, '(?i)tion[a-z]* of') THEN 'a' END, CASE WHEN regexp_matches(content, '(keit|heit)') THEN 'b' END, CASE WHEN regexp_matches(content, 'qu(e|i).{0,10}le') THEN 'c' END) AS leaks FROM messages WHERE role = 'agent'")
def d12(v):
    return v.agents.select("trace_id", "turn", F.array_join(T.internal_info_leaks(F.col("content"), LEAKS), ",").alias("leaks"))


@query("d13_canaries", duck("messages", "f AS (SELECT trace_id, turn, lower(regexp_replace(content, '\\s', '', 'g')) AS x FROM messages)") + "SELECT trace_id, turn, concat_ws(',', CASE WHEN contains(x, 'ofthe') THEN 'of the' END, CASE WHEN contains(x, 'dela') THEN 'de la' END) AS found, contains(x, 'undder') AS coerced FROM f")
def d13(v):
    return v.messages.select("trace_id", "turn", F.array_join(T.canary_injection(F.col("content"), ["of the", "de la"]), ",").alias("found"), T.coercive_closure(F.col("content"), ["undder"]).alias("coerced"))


FLOOD = "(" + " + ".join(f"CASE WHEN contains(content, '{w}') THEN 1 ELSE 0 END" for w in WORDS + ["tion"]) + ")"


@query("d14_keyword_flooding", duck("messages") + f'SELECT trace_id, turn, length(content) > 80 AS "long", {FLOOD} >= 3 AS many, {FLOOD} >= 3 AND length(content) < 120 AS stuffed FROM messages')
def d14(v):
    return v.messages.select("trace_id", "turn", T.keyword_flooding(F.col("content"), [*WORDS, "tion"]).alias("f")).select("trace_id", "turn", "f.*")


@query("d15_negated_claim", duck("messages") + f"SELECT trace_id, turn, {has(WORDS)} AND {NEGATION.replace(chr(39) + 'zz' + chr(39), chr(39) + '#none#' + chr(39))} = 'negated' AS claim FROM messages")
def d15(v):
    return v.messages.select("trace_id", "turn", T.negated_claim(F.col("content"), WORDS, **LISTS).alias("claim"))


@query("d16_masking", duck("messages") + "SELECT trace_id, turn, replace(replace(content, 'the', '***'), 'und', '***') AS masked FROM messages")
def d16(v):
    return v.messages.select("trace_id", "turn", T.mask_forbidden(F.col("content"), ["the", "und"]).alias("masked"))


@query("d17_call_ending", duck("messages") + f"SELECT trace_id, turn, {has(['###STOP###', 'thention'])} OR ((ends_with(trim(content), 'on.') OR ends_with(trim(content), 'en.')) AND NOT {has(['thon.', 'ion.'])}) AS ending FROM messages")
def d17(v):
    return v.messages.select("trace_id", "turn", T.is_call_ending(F.col("content"), ["###STOP###"], ["thention"], ["on.", "en."], ["th", "i"]).alias("ending"))


@query("d18_negative_emotion", duck("messages") + "SELECT trace_id, turn, (contains(content, 'blee') AND NOT (contains(content, 'bleea') OR contains(content, 'eblee'))) OR (contains(content, 'ßt') AND contains(replace(content, 'ßt', ''), 'der')) AS negative FROM messages")
def d18(v):
    return v.messages.select("trace_id", "turn", T.negative_emotion(F.col("content"), ["blee"], ["bleea", "eblee"], {"ßt": ["der"]}).alias("negative"))


@query("d19_phrase_families", duck("messages") + "SELECT trace_id, turn, regexp_matches(content, 're.{0,5}ing') OR regexp_matches(content, 'ver(be|ge)') AS pressure, regexp_matches(content, '(nicht|pas) ') AS refusal FROM messages")
def d19(v):
    return v.messages.select("trace_id", "turn", T.matches_any(F.col("content"), ["re.{0,5}ing", "ver(be|ge)"]).alias("pressure"), T.matches_any(F.col("content"), ["(nicht|pas) "]).alias("refusal"))


@query("d20_infer_archetype", """SELECT c_custkey, CASE WHEN c_custkey % 10 + 1 >= 8 THEN 'busy' WHEN c_custkey // 10 % 10 + 1 >= 8 THEN 'angry' WHEN c_custkey // 100 % 10 + 1 <= 3 THEN 'suspicious' WHEN c_nationkey % 10 + 1 <= 3 THEN 'confused'
    WHEN c_custkey % 7 + 1 <= 3 THEN 'refusing' WHEN c_custkey % 7 + 1 >= 8 THEN 'cooperative' ELSE 'neutral' END AS archetype FROM customer""")
def d20(v):
    k = F.col("c_custkey")
    p = F.struct((k % 10 + 1).alias("busy_level"), (F.floor(k / 10) % 10 + 1).alias("emotional"), (F.floor(k / 100) % 10 + 1).alias("trust_level"), (F.col("c_nationkey") % 10 + 1).alias("comprehension"), (k % 7 + 1).alias("cooperativeness"))
    return v.table("customer").select("c_custkey", p.alias("p")).select("c_custkey", T.infer_archetype("p").alias("archetype"))


@query("d21_identity", duck("messages", "a AS (SELECT trace_id, string_agg(content, ' ' ORDER BY turn) AS t FROM messages WHERE role = 'agent' GROUP BY trace_id)")
       + "SELECT trace_id, CAST(CASE WHEN trace_id % 4 = 0 AND contains(t, 'der') THEN 1.0 WHEN trace_id % 4 > 0 AND contains(t, 'thin') THEN 1.0 WHEN contains(t, 'tion') THEN 0.8 ELSE 0.0 END AS DOUBLE) AS score FROM a")
def d21(v):
    text = v.agents.groupBy("trace_id").agg(F.listagg("content", F.lit(" ")).alias("t"))
    return text.select("trace_id", T.identity_confirmed(F.col("t"), F.when(F.col("trace_id") % 4 > 0, "thin"), F.lit("tion"), ["der"]).alias("score"))


@query("d22_ai_rejection", duck("messages") + f"SELECT trace_id, min(turn) AS turn FROM messages WHERE role = 'user' AND {has(['tion', 'keit'])} GROUP BY trace_id")
def d22(v):
    return v.users.where(T.any_of(F.col("content"), ["tion", "keit"])).groupBy("trace_id").agg(F.min("turn").alias("turn"))


@query("d23_extract_json", "SELECT event_id, concat('{\"k\": ', json_extract_string(props, '$.k'), '}') AS j FROM events")
def d23(v):
    return v.table("events").select("event_id", T.extract_json(F.concat(F.lit("Sure: "), "props", F.lit(" done"))).alias("j"))


@query("d24_parse_instructions", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
    SELECT doc_id, n - 1 AS pos, CASE WHEN regexp_matches(line, '^\\s*\\S+( \\| \\S+)+') THEN 'list' WHEN length(line) <= 30 THEN 'section' ELSE 'step' END AS kind FROM l WHERE trim(line) <> ''""")
def d24(v):
    from colloquy.functions.instructions import parse_lines

    return parse_lines(v.table("documents"), "doc_id", "text", {"list": r"^\s*\S+( \| \S+)+"}, short=30)


#: Documents as instructions: sentences are steps, what follows a comma an item or a branch, and some words begin a section.
WRITTEN = "concat('# Call Flow:', chr(10), replace(replace(replace(text, '. ', concat(chr(10), '3. ')), ', the ', concat(chr(10), '- if the -> ')), ' of ', concat(chr(10), '## Part: ', chr(10), '* ')))"


@query("d24_instruction_items", f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM (SELECT doc_id, {WRITTEN} AS t FROM documents)),
    h AS (SELECT doc_id, pos, line, nullif(regexp_extract(line, '^#{{1,2}}\\s+(.+)', 1), '') AS head, TRY_CAST(nullif(regexp_extract(line, '^(\\d+)\\.\\s*(.+)', 1), '') AS BIGINT) AS number FROM l),
    n AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM h),
    s AS (SELECT doc_id, pos, line, head, number, first_value(lower(rtrim(trim(head), ':'))) OVER w AS section, last_value(number IGNORE NULLS) OVER w AS step FROM n WHERE nth > 0 WINDOW w AS (PARTITION BY doc_id, nth ORDER BY pos)),
    k AS (SELECT *, CASE WHEN number IS NOT NULL THEN 'step' WHEN starts_with(line, '- if') THEN 'branch' WHEN regexp_matches(trim(line), '^[-*]\\s+(.+)') THEN 'item' END AS kind FROM s WHERE head IS NULL)
    SELECT doc_id, section, pos, step, kind, length(trim(CASE kind WHEN 'step' THEN regexp_extract(line, '^(\\d+)\\.\\s*(.+)', 2) WHEN 'branch' THEN regexp_extract(line, '- if(.+?)->\\s*(.+)', 2) ELSE regexp_extract(trim(line), '^[-*]\\s+(.+)', 1) END)) AS n_chars,
      CASE WHEN kind = 'branch' THEN 'the' END AS condition FROM k WHERE kind IS NOT NULL""")
def d24_items(v):
    from colloquy.functions.instructions import instruction_items

    docs = v.table("documents").select("doc_id", F.expr(WRITTEN.replace("chr(10)", "'\\n'")).alias("t"))
    return instruction_items(docs, "doc_id", "t", branch=r"- if(.+?)->\s*(.*)").select("doc_id", "section", "pos", "step", "kind", F.length("text").cast("long").alias("n_chars"), "condition")


@query("d25_dialogue_fingerprint", duck("messages") + "SELECT trace_id, sha256(string_agg(concat(role, chr(31), content, chr(30)), '' ORDER BY msg_idx)) AS fingerprint FROM messages GROUP BY trace_id")
def d25(v):
    from colloquy.functions.instructions import dialogue_fingerprint

    return dialogue_fingerprint(v.messages)


@query("d26_config_hash", duck("runs") + "SELECT trace_id, substr(sha256(concat('{\"model\":\"', model, '\",\"scenario\":\"', scenario, '\"}')), 1, 16) AS hash FROM runs")
def d26(v):
    return v.runs.select("trace_id", T.config_hash("scenario", "model").alias("hash"))


@query("d27_transcript", duck("messages") + "SELECT trace_id, substr(string_agg(concat('[', CAST(turn AS VARCHAR), '] ', role, ': ', substr(content, 1, 200)), chr(10) ORDER BY msg_idx), 1, 30000) AS transcript FROM messages GROUP BY trace_id")
def d27(v):
    from colloquy.functions.instructions import transcript_text

    return transcript_text(v.messages, 200, 30000)


@query("d28_sequence_ratio")
def d28(v):
    """No SQL: difflib's matching blocks, between names and types of parts."""
    return v.table("part").select("p_partkey", fuzzy.sequence_ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


