"""Queries of the policy, verification, sequence, diagnosis and mutation operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import fuzzy
from colloquy.functions import text as T
from colloquy.operators import diagnosis as I
from colloquy.operators import mutations as M
from colloquy.operators import policy as E
from colloquy.operators import sequence as G
from colloquy.operators import verify as V
from colloquy.plans.analytics_queries import rd, rounded
from colloquy.plans.registry import query
from colloquy.plans.scoring_queries import near
from colloquy.plans.text_queries import has
from colloquy.plans.views import POLICY_EDGES, duck

#: Many policies: each customer has the steps of the literal policy with an order of its own.
MANY = """many AS (SELECT c_custkey AS scenario_id, step_id, CAST((ord * (c_custkey % 5 + 1)) % 7 AS BIGINT) AS ord, action, is_optional, weight FROM customer CROSS JOIN steps),
    mb AS (SELECT c_custkey AS scenario_id, step_id, next_step, cond FROM customer CROSS JOIN branches),
    lead_ AS (SELECT *, lead(step_id) OVER w AS nxt, lead(is_optional) OVER w AS nxt_optional FROM many WINDOW w AS (PARTITION BY scenario_id ORDER BY ord)),
    edges AS (SELECT scenario_id, step_id AS src, nxt AS dst, CASE WHEN step_id <> 'inform' AND nxt IN ('complete', 'reschedule') AND nxt_optional THEN 'skip' ELSE 'sequential' END AS kind, CAST(NULL AS VARCHAR) AS cond
      FROM lead_ WHERE nxt IS NOT NULL AND NOT (step_id = 'inform' AND nxt IN ('complete', 'reschedule')) UNION ALL SELECT scenario_id, step_id, next_step, 'branch', cond FROM mb)"""


def _many(v):
    cust = v.table("customer").select(F.col("c_custkey").alias("scenario_id"))
    steps = cust.join(F.broadcast(v.steps.drop("scenario_id"))).withColumn("ord", ((F.col("ord") * (F.col("scenario_id") % 5 + 1)) % 7).cast("long"))
    branches = cust.join(F.broadcast(v.branches.drop("scenario_id", "branch_idx")))
    return steps, branches


@query("e1_compile_nodes", duck("steps branches", MANY) + """SELECT scenario_id, step_id, ord, CAST(weight AS DOUBLE) AS weight, is_optional, step_id IN ('complete', 'reschedule') AS is_branch_target,
    CASE WHEN action IN ('click', 'view') THEN 'tool' ELSE 'words' END AS predicate FROM many""")
def e1(v):
    steps, branches = _many(v)
    return E.compile_nodes(steps, branches, v.values("tool_name string", [("click",), ("view",)]))


@query("e2_compile_edges", duck("steps branches", MANY) + "SELECT * FROM edges")
def e2(v):
    return E.compile_edges(*_many(v))


@query("e3_pre_post_conditions", duck("steps branches", MANY + """, u AS (SELECT scenario_id, dst AS step_id, src AS pre, NULL AS post FROM edges WHERE kind <> 'skip' UNION ALL SELECT scenario_id, src, NULL, dst FROM edges WHERE kind <> 'skip')""")
       + "SELECT scenario_id, step_id, coalesce(string_agg(DISTINCT pre, ',' ORDER BY pre), '') AS pre, coalesce(string_agg(DISTINCT post, ',' ORDER BY post), '') AS post FROM u GROUP BY ALL")
def e3(v):
    return E.pre_post_conditions(E.compile_edges(*_many(v)))


@query("e4_expected_path", duck("policies policy_branches", """e AS (SELECT scenario_id, array_agg(step_id ORDER BY ord) AS path FROM policies WHERE NOT is_optional GROUP BY 1),
    t AS (SELECT scenario_id, step_id, next_step FROM policy_branches WHERE step_id = 'inform' AND cond = CASE WHEN scenario_id % 3 = 0 THEN 'away' ELSE 'home' END),
    p AS (SELECT scenario_id, path, next_step, coalesce(nullif(list_position(path, step_id), 0), len(path)) AS n FROM e JOIN t USING (scenario_id))""")
       + "SELECT scenario_id, array_to_string(CASE WHEN list_contains(path, next_step) THEN path ELSE list_concat(path[1:n], [next_step], path[n + 1:len(path)]) END, ',') AS path FROM p")
def e4(v):
    cond = F.when(F.col("scenario_id") % 3 == 0, "away").otherwise("home")
    taken = v.policy_branches.where((F.col("step_id") == "inform") & (F.col("cond") == cond)).select("scenario_id", F.lit(0).alias("ord"), "step_id", "next_step")
    return E.expected_path(v.policy_expected, taken).select("scenario_id", F.array_join("path", ",").alias("path"))


TEMPORAL = """n AS (SELECT scenario_id, step_id, lead(step_id) OVER (PARTITION BY scenario_id ORDER BY ord) AS dst FROM many WHERE NOT is_optional),
    tc AS (SELECT scenario_id, 'before' AS kind, step_id AS src, dst, 0.8 AS penalty FROM n WHERE dst IS NOT NULL
      UNION ALL SELECT c_custkey, 'before_tool', a, b, 1.0 FROM customer CROSS JOIN (VALUES ('click', 'signup'), ('signup', 'purchase')) t(a, b)
      UNION ALL SELECT c_custkey, 'requires', 'signup', 'purchase', 2.0 FROM customer WHERE c_custkey % 2 = 0)"""


def _temporal(v, steps):
    cust = v.table("customer").select(F.col("c_custkey").alias("scenario_id"))
    must = cust.join(F.broadcast(v.must_call.drop("scenario_id")))
    outcomes = cust.select("scenario_id", F.when(F.col("scenario_id") % 2 == 0, "confirmed").otherwise("none").alias("outcome"))
    causal = F.broadcast(v.values("outcome string, tool_name string, dst string", [("confirmed", "signup", "purchase")]))
    return must, E.temporal_constraints(steps, must, outcomes, causal)


@query("e5_temporal_constraints", duck("steps branches", MANY + ", " + TEMPORAL) + "SELECT scenario_id, kind, src, dst, CAST(penalty AS DOUBLE) AS penalty FROM tc")
def e5(v):
    return _temporal(v, _many(v)[0])[1]


@query("e6_scoring_atoms", duck("steps branches must_call", MANY + ", " + TEMPORAL) + """SELECT scenario_id, 'step' AS kind, step_id AS atom, CAST(CASE WHEN is_optional THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM many
    UNION ALL SELECT scenario_id, 'branch', concat(step_id, '>', next_step), 1.5 FROM mb UNION ALL SELECT c_custkey, 'tool', tool_name, 1.0 FROM customer CROSS JOIN must_call
    UNION ALL SELECT scenario_id, 'temporal', concat(src, '>', dst), CAST(penalty AS DOUBLE) * 0.5 FROM tc""")
def e6(v):
    steps, branches = _many(v)
    must, constraints = _temporal(v, steps)
    return E.scoring_atoms(steps, branches, must, constraints)


#: Kahn's order turn by turn: of the steps whose predecessors all have a place, the first in step order is next.
KAHN = """pre AS (SELECT scenario_id, dst, list(DISTINCT src) AS before FROM edges GROUP BY ALL),
    own AS (SELECT n.scenario_id, list(struct_pack(step_id := n.step_id, before := coalesce(before, [])) ORDER BY ord, step_id) AS steps FROM nodes n LEFT JOIN pre ON pre.scenario_id = n.scenario_id AND pre.dst = n.step_id GROUP BY ALL),
    k AS (SELECT scenario_id, steps, CAST([] AS VARCHAR[]) AS done, CAST([] AS INTEGER[]) AS depths FROM own
      UNION ALL SELECT scenario_id, steps, list_append(done, x.step_id), list_append(depths, CASE WHEN len(x.before) = 0 THEN 0 ELSE 1 + list_max(list_transform(x.before, lambda b: depths[list_position(done, b)])) END)
      FROM (SELECT *, list_filter(steps, lambda s: NOT list_contains(done, s.step_id) AND list_has_all(done, s.before))[1] AS x FROM k) WHERE x IS NOT NULL),
    placed AS (SELECT scenario_id, unnest(done) AS step_id, unnest(depths) AS depth, unnest(range(1, len(done) + 1)) AS pos FROM (SELECT scenario_id, arg_max(done, len(done)) AS done, arg_max(depths, len(done)) AS depths FROM k GROUP BY scenario_id))"""
KAHN_ROWS = "SELECT n.scenario_id, n.step_id, CAST(depth AS INTEGER) AS depth, CAST(pos AS INTEGER) AS pos FROM nodes n LEFT JOIN placed p ON p.scenario_id = n.scenario_id AND p.step_id = n.step_id"


@query("e7_topological_order", duck("policies policy_branches", POLICY_EDGES + ", nodes AS (SELECT scenario_id, step_id, ord FROM policies), " + KAHN).replace("WITH", "WITH RECURSIVE", 1) + KAHN_ROWS)
def e7(v):
    return E.topological_order(E.compile_edges(v.policies, v.policy_branches), v.policies)


#: Policies of some fifty steps: the orders of five customers, one after the other. Some steps are skipped on a branch, a step order that isn't the
#: edges' decides ties, and in one policy of seven an edge leads back.
LONG = """o AS (SELECT o_custkey // 5 AS scenario_id, CAST(o_orderkey AS VARCHAR) AS step_id, o_orderkey * 7 % 101 AS ord, row_number() OVER (PARTITION BY o_custkey // 5 ORDER BY o_orderkey) AS r FROM orders),
    nodes AS (SELECT scenario_id, step_id, ord, r FROM o),
    edges AS (SELECT a.scenario_id, a.step_id AS src, b.step_id AS dst, CASE WHEN b.r = a.r + 3 THEN 'branch' ELSE 'sequential' END AS kind, CASE WHEN b.r = a.r + 3 THEN concat('c', CAST(a.r % 2 AS VARCHAR)) END AS cond
      FROM o a JOIN o b ON b.scenario_id = a.scenario_id AND (b.r = a.r + 1 AND a.r % 5 > 0 OR b.r = a.r + 3 OR b.r = 31 AND a.r = 40 AND a.scenario_id % 7 = 0))"""


def _long(v):
    """Nodes and edges of long policies."""
    nodes = v.spark.sql("""SELECT o_custkey div 5 AS scenario_id, CAST(o_orderkey AS STRING) AS step_id, o_orderkey * 7 % 101 AS ord, row_number() OVER (PARTITION BY o_custkey div 5 ORDER BY o_orderkey) AS r FROM {orders}""", orders=v.table("orders"))
    ahead = "filter(array(if(r % 5 > 0, r + 1, null), r + 3, if(r = 40 and scenario_id % 7 = 0, 31, null)), x -> x is not null)"
    out = nodes.select("scenario_id", F.col("step_id").alias("src"), F.col("r").alias("a"), F.explode(F.expr(ahead)).alias("r"))
    edges = out.join(nodes.select("scenario_id", "r", F.col("step_id").alias("dst")), ["scenario_id", "r"])
    branch = F.col("r") == F.col("a") + 3
    return nodes, edges.select("scenario_id", "src", "dst", F.when(branch, "branch").otherwise("sequential").alias("kind"), F.when(branch, F.concat(F.lit("c"), (F.col("a") % 2).cast("string"))).alias("cond"))


@query("e7_long_policies", "WITH RECURSIVE " + LONG + ", " + KAHN + KAHN_ROWS)
def e7_long(v):
    """Steps on a cycle and behind it have no place."""
    nodes, edges = _long(v)
    return E.topological_order(edges, nodes)


@query("e8_reachable", duck("steps branches", MANY) + """, r AS (WITH RECURSIVE t(scenario_id, step_id) AS (SELECT DISTINCT scenario_id, 'confirm' FROM many UNION SELECT t.scenario_id, e.dst FROM t JOIN edges e ON e.scenario_id = t.scenario_id AND e.src = t.step_id
      WHERE e.kind <> 'branch' OR e.cond = 'home') SELECT DISTINCT scenario_id, step_id FROM t) SELECT * FROM r""")
def e8(v):
    steps, branches = _many(v)
    taken = branches.where("cond = 'home'").select("scenario_id", "step_id", "cond")
    return E.reachable_from(E.compile_edges(steps, branches), steps.where("step_id = 'confirm'"), taken)


@query("e8_long_policies", "WITH RECURSIVE " + LONG + """, t AS (SELECT scenario_id, step_id FROM nodes WHERE r = 6 UNION SELECT t.scenario_id, e.dst FROM t JOIN edges e ON e.scenario_id = t.scenario_id AND e.src = t.step_id
    WHERE e.kind <> 'branch' OR e.cond = 'c1') SELECT scenario_id, step_id FROM t""")
def e8_long(v):
    """From the sixth step on, where odd steps take their branch."""
    nodes, edges = _long(v)
    taken = edges.where("cond = 'c1'").select("scenario_id", F.col("src").alias("step_id"), "cond")
    return E.reachable_from(edges, nodes.where("r = 6"), taken)


@query("e9_branches", duck("steps branches", MANY) + "SELECT e.scenario_id, src, e.cond, dst, a.ord AS src_ord, b.ord AS dst_ord FROM edges e JOIN many a ON a.scenario_id = e.scenario_id AND a.step_id = src JOIN many b ON b.scenario_id = e.scenario_id AND b.step_id = dst WHERE kind = 'branch'")
def e9(v):
    steps, branches = _many(v)
    return E.enumerate_branches(E.compile_edges(steps, branches), steps)


@query("f1_normalize_events", duck("messages ledger", """b AS (SELECT DISTINCT trace_id, call_id, true AS back FROM ledger WHERE event_type = 'tool_rollback'),
    u AS (SELECT trace_id, turn, 0 AS side, msg_idx AS n, concat('say_', role) AS kind, NULL AS name FROM messages UNION ALL SELECT l.trace_id, turn, 1, seq, CASE WHEN back THEN 'blocked' WHEN error IS NOT NULL THEN 'failed' ELSE 'tool' END, tool_name
      FROM ledger l LEFT JOIN b ON b.trace_id = l.trace_id AND b.call_id = l.call_id WHERE event_type <> 'tool_rollback')""")
       + "SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY turn, side, n) AS INTEGER) AS pos, turn, kind, name FROM u")
def f1(v):
    return V.normalize_events(v.messages, v.ledger)


@query("f13_overall_verification", duck("runs") + f"SELECT trace_id, {rd('(0.40*step + 0.25*path + 0.15*temporal + coalesce(0.20*branch, 0)) / (0.80 + CASE WHEN branch IS NULL THEN 0 ELSE 0.20 END)', 'score')} FROM runs")
def f13(v):
    return v.runs.select("trace_id", near(V.overall_verification(F.col("step"), F.col("path"), F.col("temporal"), F.col("branch")), "score"))


CHAIN = """h AS (SELECT trace_id, seq, sha256(concat('{"seq":', CAST(seq AS VARCHAR), ',"tool_name":"', tool_name, '"}')) AS own_hash FROM ledger),
    c AS (SELECT trace_id, seq, own_hash, CASE WHEN seq % 97 = 5 AND trace_id % 3 = 0 THEN 'x' ELSE coalesce(lag(own_hash) OVER w, repeat('0', 64)) END AS prev_hash, coalesce(lag(own_hash) OVER w, repeat('0', 64)) AS want FROM h WINDOW w AS (PARTITION BY trace_id ORDER BY seq))"""


@query("f15_verify_hash_chain", duck("ledger", CHAIN) + "SELECT trace_id, min(CASE WHEN prev_hash <> want THEN seq END) AS first_bad, count(*) AS events, arg_max(own_hash, seq) AS tip FROM c GROUP BY trace_id")
def f15(v):
    from pyspark.sql.window import Window

    rows = v.ledger.select("trace_id", "seq", V.event_hash("seq", "tool_name").alias("own_hash"))
    before = F.coalesce(F.lag("own_hash").over(Window.partitionBy("trace_id").orderBy("seq")), F.lit(V.GENESIS))
    return V.verify_hash_chain(rows.withColumn("prev_hash", F.when(F.expr("seq % 97 = 5 and trace_id % 3 = 0"), "x").otherwise(before)))


@query("f16_reconstruct_ledger", duck("ledger") + """SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY turn) AS seq, CASE WHEN k % 5 = 0 THEN 'tool_fabricated' WHEN k % 5 = 1 THEN 'tool_blocked' ELSE 'tool_executed' END AS event_type, tool_name
    FROM ledger WHERE source <> 'guard'""")
def f16(v):
    error = F.when(F.expr("k % 5 = 0"), "[FABRICATED] none").when(F.expr("k % 5 = 1"), "[BLOCKED] by rule")
    return V.reconstruct_ledger(v.ledger.withColumns({"error": error, "call_idx": F.lit(0)}))


FACTS = """f AS (SELECT c_custkey AS scenario_id, 'a' AS fact_id, c_custkey % 3 AS check_turn, CASE WHEN c_custkey % 2 = 0 THEN ['The', 'der'] ELSE ['que', 'la'] END AS words FROM customer WHERE c_custkey % 7 > 0
      UNION ALL SELECT c_custkey, 'b', 3, ['tion', 'keit'] FROM customer WHERE c_custkey % 5 > 0),
    h AS (SELECT trace_id, fact_id, bool_or(role = 'agent' AND turn >= check_turn AND len(list_filter(words, lambda w: contains(lower(content), lower(w)))) > 0) AS held FROM said s LEFT JOIN f ON f.scenario_id = s.scenario_id GROUP BY ALL),
    g AS (SELECT trace_id, coalesce(avg(CASE WHEN fact_id IS NULL THEN NULL WHEN held THEN 1.0 ELSE 0.0 END), 1.0) AS score FROM h GROUP BY trace_id)"""


@query("f18_context_retention", duck("said", FACTS) + f"SELECT trace_id, {rd('score', 'score')}, score >= 0.6 AS passed FROM g")
def f18(v):
    """Facts differ from policy to policy; some have one or none."""
    both = v.table("customer").join(F.broadcast(v.values("fact_id string, every int", [("a", 7), ("b", 5)]))).where("c_custkey % every > 0")
    facts = both.selectExpr("c_custkey AS scenario_id", "fact_id", "if(fact_id = 'a', c_custkey % 3, 3L) AS check_turn",
                            "if(fact_id = 'b', array('tion', 'keit'), if(c_custkey % 2 = 0, array('The', 'der'), array('que', 'la'))) AS words")
    return rounded(V.context_retention(v.said, facts), "trace_id", "passed")


POINTS = """p AS (SELECT c_custkey AS scenario_id, 'p' AS point_id, CASE WHEN c_custkey % 2 = 0 THEN ['the', 'with'] ELSE ['und', 'die'] END AS words, CAST([] AS VARCHAR[]) AS numbers FROM customer WHERE c_custkey % 7 > 0
      UNION ALL SELECT c_custkey, 'q', ['und', 'que'], [CAST(c_custkey % 10 AS VARCHAR)] FROM customer WHERE c_custkey % 3 > 0),
    m AS (SELECT s.trace_id, s.turn, point_id, len(list_filter(words, lambda w: contains(content, w))) AS w, len(list_filter(numbers, lambda w: contains(content, w))) AS m, len(words) AS nw, len(numbers) AS nn, regexp_matches(content, '[0-9]') AS d
      FROM said s JOIN p ON p.scenario_id = s.scenario_id WHERE role = 'agent'),
    b AS (SELECT trace_id, point_id, nw, nn, max(struct_pack(n := w + m, t := -turn, w := w, m := m, d := d)) AS x FROM m GROUP BY ALL),
    g AS (SELECT trace_id, sum(CASE WHEN 2 * x.n >= nw + nn THEN 1 ELSE 0 END - CASE WHEN x.w > 0 AND nn > 0 AND x.m < nn AND x.d THEN 1 ELSE 0 END) AS s FROM b GROUP BY trace_id),
    t AS (SELECT scenario_id, count(*) AS n FROM p GROUP BY scenario_id), e AS (SELECT DISTINCT trace_id, scenario_id FROM said)"""


@query("f19_knowledge_accuracy", duck("said", POINTS) + f"SELECT e.trace_id, {rd('CASE WHEN n IS NULL THEN 100.0 ELSE greatest(0.0, least(100.0, coalesce(s, 0) * 100.0 / n)) END', 'score')} FROM e LEFT JOIN t ON t.scenario_id = e.scenario_id LEFT JOIN g ON g.trace_id = e.trace_id")
def f19(v):
    both = v.table("customer").join(F.broadcast(v.values("point_id string, every int", [("p", 7), ("q", 3)]))).where("c_custkey % every > 0")
    points = both.selectExpr("c_custkey AS scenario_id", "point_id", "if(point_id = 'q', array('und', 'que'), if(c_custkey % 2 = 0, array('the', 'with'), array('und', 'die'))) AS words",
                             "if(point_id = 'q', array(cast(c_custkey % 10 AS string)), cast(array() AS array<string>)) AS numbers")
    return rounded(V.knowledge_accuracy(v.said, points), "trace_id")


@query("f20_judge_evidence")
def f20(v):
    """No SQL: similarity is difflib's. Citations quote the message one turn later."""
    from pyspark.sql.window import Window

    later = F.lead("content").over(Window.partitionBy("trace_id").orderBy("msg_idx"))
    cited = v.messages.withColumn("quote", later).where("quote is not null").select("trace_id", (F.col("turn") + F.col("trace_id") % 2).alias("turn"), "quote")
    return V.judge_evidence(cited, v.messages, fuzzy.similar(F.col("quote"), F.col("content"), 0.3))


@query("f21_missing_event_ids", duck("ledger") + "SELECT trace_id, seq + k % 40 AS seq FROM ledger a WHERE NOT EXISTS (SELECT 1 FROM ledger b WHERE b.trace_id = a.trace_id AND b.seq = a.seq + a.k % 40)")
def f21(v):
    return V.missing_event_ids(v.ledger.select("trace_id", (F.col("seq") + F.col("k") % 40).alias("seq")), v.ledger)


@query("g1_verbatim_repetition")
def g1(v):
    """No SQL: similarity is difflib's, 0.9 of whole messages. Tests compare with a plain loop."""
    return G.verbatim_repetition(v.messages, lambda a, b: fuzzy.similar(a, b, 0.9))


def _stuck(v):
    """Messages of agents that get stuck: every second one is the one before, in every other trace with a new ending, or with letters changed."""
    w = G.in_trace()
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy("msg_idx"))
    last = F.lag("content").over(w)
    again = F.when(F.col("trace_id") % 3 == 0, last).when(F.col("trace_id") % 3 == 1, F.concat(last, F.lit(" "), F.substring("content", 1, 20))).otherwise(F.translate(last, "aei", "oxu"))
    return v.messages.where("role = 'agent'").withColumns({"n": n, "again": again}).withColumn("content", F.when(F.col("n") % 2 == 0, F.col("again")).otherwise(F.col("content")))


@query("g1_stuck_agents")
def g1_stuck(v):
    """No SQL, as above; here agents do repeat themselves, word by word or nearly so."""
    return G.verbatim_repetition(_stuck(v), lambda a, b: fuzzy.similar(a, b, 0.9))


@query("g2_opening_closing", duck("messages", "g AS (SELECT trace_id, arg_min(content, msg_idx) AS f, arg_max(content, msg_idx) AS l FROM messages WHERE role = 'agent' GROUP BY trace_id)") + """SELECT q.trace_id,
    coalesce(CASE WHEN contains(f, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(f, 'und') THEN 1 ELSE 0 END + CASE WHEN contains(f, 'tion') THEN 1 ELSE 0 END >= 1.8, false) AS opening_ok,
    coalesce(CASE WHEN contains(l, 'er') THEN 1 ELSE 0 END + CASE WHEN contains(l, 'keit') THEN 1 ELSE 0 END >= 1, false) AS closing_ok FROM (SELECT DISTINCT trace_id FROM messages) q LEFT JOIN g ON g.trace_id = q.trace_id""")
def g2(v):
    rows = G.opening_closing(v.messages, "the, und. tion!", "er; keit")
    return rows.select("trace_id", F.coalesce("opening_ok", F.lit(False)).alias("opening_ok"), F.coalesce("closing_ok", F.lit(False)).alias("closing_ok"))


@query("g3_mechanical_openings", duck("messages") + "SELECT trace_id, count(*) >= 3 AND count(DISTINCT left(content, 2)) < count(*) AS mechanical FROM messages WHERE role = 'agent' GROUP BY trace_id")
def g3(v):
    return G.mechanical_openings(v.messages, prefix=2)


PRESSURED = "CASE WHEN role = 'agent' AND (regexp_matches(content, 're.{0,5}ing') OR regexp_matches(content, 'ver(be|ge)')) THEN 1 ELSE 0 END"


@query("g4_pressure_floor", duck("messages", f"p AS (SELECT trace_id, turn, CAST(sum({PRESSURED}) OVER (PARTITION BY trace_id ORDER BY msg_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pressure FROM messages)")
       + "SELECT trace_id, turn, pressure, CASE WHEN pressure >= 3 THEN 5 WHEN pressure >= 1 THEN 2 ELSE 0 END AS floor FROM p")
def g4(v):
    return G.pressure_floor(v.messages, ["re.{0,5}ing", "ver(be|ge)"], [(1, 2), (3, 5)])


@query("g5_escalation", duck("messages", "p AS (SELECT trace_id, turn, CAST(least(sum(CASE WHEN role = 'agent' AND regexp_matches(content, 'tion') THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY msg_idx ROWS UNBOUNDED PRECEDING), 4) AS INTEGER) AS level FROM messages)")
       + "SELECT trace_id, turn, level, CASE level WHEN 0 THEN 'calm' WHEN 1 THEN 'insistent' WHEN 2 THEN 'annoyed' WHEN 3 THEN 'angry' ELSE 'threatening' END AS strategy FROM p")
def g5(v):
    return G.escalation_level(v.messages, ["tion"])


@query("g6_emotion_resolution", duck("messages", """s AS (SELECT trace_id, msg_idx, CASE length(content) % 4 WHEN 0 THEN 'angry' WHEN 1 THEN 'neutral' WHEN 2 THEN 'satisfied' ELSE 'upset' END AS st FROM messages WHERE role = 'user'),
    g AS (SELECT trace_id, bool_or(st IN ('angry', 'upset')) AS ever, arg_max(st, msg_idx) AS last, string_agg(st, '>' ORDER BY msg_idx) AS trajectory FROM s GROUP BY trace_id)""")
       + "SELECT trace_id, trajectory, CAST(CASE WHEN last IN ('satisfied', 'neutral') THEN 1.0 ELSE 0.3 END AS DOUBLE) AS score FROM g WHERE ever")
def g6(v):
    n = F.length("content") % 4
    states = v.users.withColumn("state", F.when(n == 0, "angry").when(n == 1, "neutral").when(n == 2, "satisfied").otherwise("upset"))
    return G.emotion_resolution(states, ["angry", "upset"], ["satisfied", "neutral"])


@query("g7_tool_frequency", duck("ledger", "g AS (SELECT trace_id, tool_name, count(*) AS n FROM ledger GROUP BY ALL HAVING count(*) >= 18), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, tool_name) AS r FROM g)") + "SELECT trace_id, tool_name, n FROM r WHERE r = 1")
def g7(v):
    return G.tool_frequency_anomaly(v.ledger, 18)


@query("g8_first_tool_turn", duck("ledger") + "SELECT trace_id, tool_name, min(turn) AS turn FROM ledger WHERE event_type = 'tool_executed' GROUP BY ALL")
def g8(v):
    return G.first_tool_turn(v.ledger)


@query("g9_fault_recovery", duck("ledger", "g AS (SELECT trace_id, tool_name, min(seq) FILTER (WHERE k > 90) AS f, max(seq) FILTER (WHERE error IS NULL AND k <= 90) AS ok FROM ledger GROUP BY ALL)") + "SELECT trace_id, tool_name, coalesce(ok > f, false) AS recovered FROM g WHERE f IS NOT NULL")
def g9(v):
    return G.fault_recovery(v.ledger, F.col("k") > 90)


@query("g10_constraint_lifecycle", duck("ledger", """e AS (SELECT trace_id, k % 4 AS c, CASE seq % 5 WHEN 0 THEN 'violated' WHEN 1 THEN 'satisfied' WHEN 2 THEN 'acknowledged' WHEN 3 THEN 'revealed' ELSE 'introduced' END AS ev FROM ledger),
    g AS (SELECT trace_id, c, bool_or(ev = 'violated') AS v, bool_or(ev = 'satisfied') AS s, bool_or(ev = 'acknowledged') AS a, bool_or(ev = 'revealed') AS r FROM e GROUP BY ALL)""")
       + "SELECT trace_id, c AS constraint_id, CASE WHEN v AND s THEN 'recovered' WHEN v THEN 'violated' WHEN s THEN 'satisfied' WHEN a THEN 'acknowledged' WHEN r THEN 'revealed' ELSE 'introduced' END AS status FROM g")
def g10(v):
    event = F.element_at(F.array(*map(F.lit, ("violated", "satisfied", "acknowledged", "revealed", "introduced"))), (F.col("seq") % 5 + 1).cast("int"))
    return G.constraint_lifecycle(v.ledger.select("trace_id", (F.col("k") % 4).alias("constraint_id"), event.alias("event")))


@query("g11_final_state", duck("ledger") + "SELECT trace_id, count(*) >= 60 AS enough, arg_max(event_type, seq) AS status, sum(amount) <= 3400 AS within_budget FROM ledger GROUP BY trace_id")
def g11(v):
    return G.final_state(v.ledger.withColumn("status", F.col("event_type")), 60, 3400.0)


@query("g12_constraint_tools", duck("traced policy_must") + """SELECT q.trace_id, m.pos AS constraint_id, EXISTS (SELECT 1 FROM traced c WHERE c.trace_id = q.trace_id AND c.tool_name = m.tool_name) AS used
    FROM (SELECT DISTINCT trace_id, scenario_id FROM traced) q JOIN policy_must m USING (scenario_id)""")
def g12(v):
    return G.constraint_tool_usage(v.policy_must.withColumnRenamed("pos", "constraint_id"), v.traced)


@query("g13_state_snapshots", duck("ledger") + f"SELECT trace_id, seq, count(*) OVER w AS n_changes, {rd('sum(amount) OVER w', 'total')} FROM ledger WHERE tool_name IN ('purchase', 'signup') AND event_type = 'tool_executed' WINDOW w AS (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def g13(v):
    return rounded(G.state_snapshots(v.ledger, ["purchase", "signup"]), "trace_id", "seq", "n_changes")


@query("g14_step_progress", duck("traced policies") + "SELECT trace_id, step_id, min(turn) AS turn FROM traced t JOIN policies p ON p.scenario_id = t.scenario_id AND action = tool_name WHERE event_type = 'tool_executed' GROUP BY ALL")
def g14(v):
    return G.step_progress(v.traced, v.policies)


@query("i1_deviation_point", duck("runs") + """SELECT trace_id, CASE WHEN cust % 8 < 2 THEN 'too_short' WHEN cust % 3 = 0 THEN 'missing_tool' WHEN cust % 5 = 0 THEN 'bad_closing' ELSE 'skipped_step' END AS kind,
    CASE WHEN cust % 8 < 2 THEN cust % 11 WHEN cust % 3 = 0 THEN cust % 6 WHEN cust % 5 = 0 THEN cust % 11 ELSE cust % 9 END AS turn FROM runs WHERE cust % 8 < 2 OR cust % 3 = 0 OR cust % 5 = 0 OR cust % 7 = 0""")
def i1(v):
    facts = v.runs.select("trace_id", F.expr("cust % 8").alias("agent_turns"), F.expr("case when cust % 3 = 0 then cust % 6 end").alias("missing_tool_turn"), F.expr("cust % 5 <> 0").alias("closing_ok"),
                          F.expr("cust % 11").alias("last_turn"), F.expr("case when cust % 7 = 0 then cust % 9 end").alias("skipped_turn"))
    return I.deviation_point(facts)


MODE_SQL = "list_filter([CASE WHEN step < 0.4 THEN 'step_skipping' END, CASE WHEN hard < 0.3 THEN 'tool_avoidance' END, CASE WHEN branch < 0.5 THEN 'branch_error' END, CASE WHEN cust % 13 = 0 THEN 'safety_violation' END, CASE WHEN path < 0.2 THEN 'repetition' END], lambda x: x IS NOT NULL)"


def _modes(v):
    return v.runs.withColumn("modes", I.failure_modes({"step_skipping": F.col("step") < 0.4, "tool_avoidance": F.col("hard") < 0.3, "branch_error": F.col("branch") < 0.5, "safety_violation": F.expr("cust % 13 = 0"), "repetition": F.col("path") < 0.2}))


@query("i2_failure_modes", duck("runs") + f"SELECT trace_id, array_to_string({MODE_SQL}, ',') AS modes FROM runs")
def i2(v):
    return _modes(v).select("trace_id", F.array_join("modes", ",").alias("modes"))


@query("i3_severity", duck("runs", f"m AS (SELECT trace_id, {MODE_SQL} AS m FROM runs)") + """SELECT trace_id, CASE WHEN list_contains(m, 'safety_violation') THEN 'critical' WHEN list_has_any(m, ['branch_error', 'tool_avoidance']) THEN 'high' WHEN list_has_any(m, ['step_skipping', 'repetition']) THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN list_contains(m, 'safety_violation') THEN 'safety_violation' WHEN list_contains(m, 'tool_avoidance') THEN 'tool_avoidance' WHEN list_contains(m, 'branch_error') THEN 'branch_error' WHEN list_contains(m, 'step_skipping') THEN 'step_skipping' WHEN list_contains(m, 'repetition') THEN 'repetition' END AS cause,
    CAST(len(list_filter(m, lambda x: x <> 'repetition')) AS INTEGER) AS n_advice FROM m""")
def i3(v):
    rows = _modes(v).select("trace_id", I.severity_and_cause(F.col("modes")).alias("s"), F.size(I.recommendations(F.col("modes"))).alias("n_advice"))
    return rows.select("trace_id", "s.*", "n_advice")


@query("i6_dialogue_side_quality", duck("messages", f"""g AS (SELECT trace_id, CAST(sum(CASE WHEN contains(content, 'thth') THEN 1 ELSE 0 END) AS BIGINT) AS leaks, avg(CASE WHEN length(content) > 100 THEN 1.0 ELSE 0.0 END) AS long_share,
    CAST(sum(CASE WHEN {has(['nicht', 'not'])} THEN 1 ELSE 0 END) AS BIGINT) AS refusals, CAST(sum(CASE WHEN {has(['und', 'and'])} THEN 1 ELSE 0 END) AS BIGINT) AS agreements FROM messages WHERE role = 'user' GROUP BY trace_id)""")
       + f"SELECT trace_id, leaks, {rd('long_share', 'long_share')}, refusals, agreements, leaks = 0 AND long_share <= 0.2 AS ok FROM g")
def i6(v):
    c = F.col("content")
    return rounded(I.dialogue_side_quality(v.messages, c.contains("thth"), T.any_of(c, ["nicht", "not"]), T.any_of(c, ["und", "and"])), "trace_id", "leaks", "refusals", "agreements", "ok")


#: A quality of over 95 stands for a violation that a reviewer should see.
@query("i7_review_checklist", duck("checks ledger") + "SELECT trace_id, check_id AS item, CAST(line AS BIGINT) AS turn, 'check' AS source FROM checks WHERE NOT passed UNION ALL SELECT trace_id, tool_name, turn, 'violation' FROM ledger WHERE k > 95")
def i7(v):
    return I.review_checklist(v.checks.where("not passed"), v.ledger.where("k > 95").withColumn("behavior_id", F.col("tool_name")))


@query("m1_remove_consent", duck("messages") + """SELECT trace_id, turn, CASE WHEN role = 'user' THEN CASE WHEN contains(content, 'the') THEN concat(split_part(content, 'the', 1), 'hmm', substr(content, strpos(content, 'the') + 3))
    WHEN contains(content, 'und') THEN concat(split_part(content, 'und', 1), 'hmm', substr(content, strpos(content, 'und') + 3)) ELSE content END ELSE content END AS content FROM messages""")
def m1(v):
    return M.remove_consent(v.messages, ["the", "und"], "hmm").select("trace_id", "turn", "content")


@query("m2_flip_branch", duck("messages") + "SELECT trace_id, turn, CASE WHEN role = 'user' THEN replace(replace(content, 'the', 'not'), 'und', 'kein') ELSE content END AS content FROM messages")
def m2(v):
    return M.flip_branch(v.messages, {"the": "not", "und": "kein"}).select("trace_id", "turn", "content")


@query("m3_verbose_filler", duck("messages") + f"SELECT trace_id, turn, CASE WHEN role = 'agent' THEN concat('{M.FILLER}', content) ELSE content END AS content FROM messages")
def m3(v):
    return M.verbose_filler(v.messages).select("trace_id", "turn", "content")


FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY trace_id, role ORDER BY msg_idx) AS r FROM messages)"


@query("m4_prompt_injection", duck("messages", FIRST) + f"SELECT trace_id, turn, CASE WHEN role = 'user' AND r = 1 THEN concat(content, '{M.INJECTION}') ELSE content END AS content FROM f")
def m4(v):
    return M.prompt_injection(v.messages).select("trace_id", "turn", "content")


@query("m5_forbidden_paraphrase", duck("messages", FIRST) + "SELECT trace_id, turn, CASE WHEN role = 'agent' AND r = 1 THEN concat(content, ' money back') ELSE content END AS content FROM f")
def m5(v):
    said = v.messages.select("trace_id", F.lit(" money back").alias("paraphrase")).distinct()
    return M.forbidden_paraphrase(v.messages, said).select("trace_id", "turn", "content")


@query("m6_drop_state", duck("checks") + "SELECT trace_id, status AS table_name, count(*) AS n FROM checks WHERE status <> 'F' GROUP BY ALL")
def m6(v):
    return M.drop_state(v.checks.withColumnRenamed("status", "table_name"), "F").groupBy("trace_id", "table_name").agg(F.count("*").alias("n"))


@query("m7_remove_evidence", duck("ledger") + "SELECT trace_id, seq, '[FABRICATED] no such execution' AS error FROM ledger")
def m7(v):
    return M.remove_evidence(v.ledger).select("trace_id", "seq", "error")


@query("m8_entity_swap")
def m8(v):
    """No SQL: the order is Spark's hash. Tests check that values are permuted."""
    return M.entity_swap(v.table("customer").select("c_custkey", "c_name"), ["c_name"])
