"""Queries that check every trace against its own policy: customers have one each, and traces follow one of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import diagnosis as I
from colloquy.operators import policy as E
from colloquy.operators import verify as V
from colloquy.plans.analytics_queries import rd, rounded
from colloquy.plans.registry import query
from colloquy.plans.scoring_queries import near
from colloquy.plans.text_queries import LISTS, NEGATION
from colloquy.plans.views import POLICY_EDGES, duck

VIEWS = "traced said predicates policies policy_branches policy_must"
WORDS = "string_split(words, ',')"
#: Events that count, first events per predicate, and the steps that they show.
TOOLS = """ev AS (SELECT * FROM traced WHERE event_type = 'tool_executed' AND error IS NULL AND source <> 'guard'),
    tm AS (SELECT trace_id, scenario_id, step_id, ord, pred, 'tool' AS kind, CAST(NULL AS VARCHAR) AS key, min(seq) AS event, arg_min(turn, seq) AS turn FROM ev JOIN predicates p USING (scenario_id, tool_name)
      WHERE p.kind = 'tool' AND (own_order IS NULL OR order_id IS NULL OR order_id = own_order) AND (level IS NULL OR CAST(level AS DOUBLE) = CAST(level_arg AS DOUBLE)) GROUP BY ALL)"""
SPOKEN = f"""um AS (SELECT trace_id, scenario_id, step_id, ord, pred, 'words' AS kind, words AS key, min(msg_idx) AS event, arg_min(turn, msg_idx) AS turn FROM said JOIN predicates p USING (scenario_id)
      WHERE role = 'agent' AND p.kind = 'words' AND len(list_filter({WORDS}, lambda w: contains(lower(content), w))) >= greatest(1, 0.4 * len({WORDS})) AND ({NEGATION}) <> 'negated' GROUP BY ALL)"""
OBSERVED = f"""{TOOLS}, {SPOKEN}, mm AS (SELECT * FROM tm UNION ALL SELECT * FROM um),
    used AS (SELECT *, row_number() OVER (PARTITION BY trace_id, kind, event, key ORDER BY ord, step_id, pred) AS r FROM mm),
    need AS (SELECT scenario_id, step_id, count(*) AS n, count(*) FILTER (WHERE kind = 'words') AS words FROM predicates GROUP BY ALL),
    seen AS (SELECT trace_id, scenario_id, step_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS evidence, bool_or(kind = 'tool') AS tool, count(*) FILTER (WHERE kind = 'words') AS spoken FROM used WHERE r = 1 GROUP BY ALL),
    obs AS (SELECT trace_id, scenario_id, step_id, first_turn, last_turn, evidence, least(1.0, evidence / n) AS confidence FROM seen JOIN need USING (scenario_id, step_id) WHERE tool OR words < 2 OR 2 * spoken >= words)"""


def _tools(v):
    return V.match_tools(v.traced, v.predicates)


def _spoken(v):
    return V.match_words(v.said, v.predicates, T.negation_status(F.col("content"), ["zz"], **LISTS))


def _observed(v):
    return V.observed_steps(_tools(v).unionByName(_spoken(v)), v.predicates)


def _edges(v):
    return E.compile_edges(v.policies, v.policy_branches)


@query("f2_match_predicates", duck(VIEWS, TOOLS) + "SELECT trace_id, step_id, event AS seq, turn FROM tm")
def f2(v):
    return _tools(v).select("trace_id", "step_id", F.col("event").alias("seq"), "turn")


@query("f2_match_utterances", duck(VIEWS, SPOKEN) + "SELECT trace_id, step_id, pred, turn FROM um")
def f2_words(v):
    return _spoken(v).select("trace_id", "step_id", "pred", "turn")


@query("f3_observed_steps", duck(VIEWS, OBSERVED) + f"SELECT trace_id, step_id, first_turn, last_turn, evidence, {rd('confidence', 'confidence')} FROM obs")
def f3(v):
    return rounded(_observed(v).drop("scenario_id"), "trace_id", "step_id", "first_turn", "last_turn", "evidence")


PATHS = f"""{OBSERVED}, seen_ AS (SELECT trace_id, scenario_id, array_agg(step_id ORDER BY first_turn, ord) AS o FROM obs JOIN policies USING (scenario_id, step_id) GROUP BY ALL),
    plan AS (SELECT scenario_id, array_agg(step_id ORDER BY ord) AS e FROM policies WHERE step_id <> 'reschedule' GROUP BY 1), free AS (SELECT scenario_id, array_agg(step_id) AS opt FROM policies WHERE is_optional GROUP BY 1),
    p AS (SELECT trace_id, o, e, opt FROM seen_ JOIN plan USING (scenario_id) JOIN free USING (scenario_id))"""
GONE = "CASE WHEN list_contains(opt, x) THEN 0.5 ELSE 3.0 END"
UNORDERED = f"list_sum(list_concat([0.0], list_transform(list_filter(e, lambda x: NOT list_contains(o, x)), lambda x: {GONE}))) + 0.2 * len(list_filter(o, lambda x: NOT list_contains(e, x)))"


def _paths(v):
    expected = v.policies.where("step_id <> 'reschedule'").select("scenario_id", F.col("ord").alias("pos"), "step_id")
    return V.paths(_observed(v), v.policies, _edges(v), expected)


@query("f4_align_ordered")
def f4(v):
    """No SQL: the trace-back is a table walk. Tests compare costs with a brute-force search."""
    return V.align_ordered(_paths(v))


@query("f5_align_strict", duck(VIEWS, PATHS + ", z AS (SELECT trace_id, unnest(range(1, greatest(len(o), len(e)) + 1)) AS i, o, e, opt FROM p)") + "SELECT trace_id, "
       + rd("sum(CASE WHEN i > len(e) THEN 0.2 WHEN i > len(o) THEN CASE WHEN list_contains(opt, e[i]) THEN 0.5 ELSE 3.0 END WHEN e[i] = o[i] THEN 0.0 ELSE 2.0 END)", "cost") + " FROM z GROUP BY trace_id")
def f5(v):
    return rounded(V.align_strict(_paths(v)), "trace_id")


@query("f6_align_unordered", duck(VIEWS, PATHS) + f"SELECT trace_id, {rd(UNORDERED, 'cost')} FROM p")
def f6(v):
    return rounded(V.align_unordered(_paths(v)), "trace_id")


@query("f7_alignment_score", duck(VIEWS, PATHS) + f"SELECT trace_id, {rd(f'greatest(0.0, 1 - ({UNORDERED}) / list_sum(list_transform(e, lambda x: {GONE})))', 'score')} FROM p")
def f7(v):
    paths = _paths(v)
    return paths.join(V.align_unordered(paths), "trace_id").select("trace_id", near(V.alignment_score(F.col("cost"), F.col("expected"), F.col("optional")), "score"))


#: Neighbouring required steps, consecutive tools, and for half of the policies a tool that another one requires.
CONSTRAINTS = """cons AS (SELECT * FROM (SELECT scenario_id, 'before' AS kind, step_id AS src, lead(step_id) OVER (PARTITION BY scenario_id ORDER BY ord) AS dst, 0.8 AS penalty FROM policies WHERE NOT is_optional
      UNION ALL SELECT scenario_id, 'before_tool', tool_name, lead(tool_name) OVER (PARTITION BY scenario_id ORDER BY pos), 1.0 FROM policy_must) WHERE dst IS NOT NULL
      UNION ALL SELECT DISTINCT scenario_id, 'requires', 'signup', 'purchase', 2.0 FROM policies WHERE scenario_id % 2 = 0)"""
VIOLATED = f"""{OBSERVED}, {CONSTRAINTS}, named AS (SELECT trace_id, scenario_id, step_id AS name, first_turn AS turn, 0 AS side FROM obs UNION ALL SELECT trace_id, scenario_id, tool_name, min(turn), 1 FROM ev GROUP BY ALL),
    t AS (SELECT trace_id, scenario_id, name, arg_min(turn, side) AS turn FROM named GROUP BY ALL), q AS (SELECT DISTINCT trace_id, scenario_id FROM t),
    pairs AS (SELECT q.trace_id, c.src, c.dst, c.kind, coalesce(a.turn > b.turn, false) OR (c.kind = 'requires' AND b.turn IS NOT NULL AND a.turn IS NULL) AS bad FROM q JOIN cons c USING (scenario_id)
      LEFT JOIN t a ON a.trace_id = q.trace_id AND a.name = c.src LEFT JOIN t b ON b.trace_id = q.trace_id AND b.name = c.dst), viol AS (SELECT trace_id, src, dst, kind FROM pairs WHERE bad)"""


def _constraints(v):
    outcomes = v.policies.select("scenario_id", F.when(F.col("scenario_id") % 2 == 0, "confirmed").otherwise("none").alias("outcome")).distinct()
    return E.temporal_constraints(v.policies, v.policy_must, outcomes, F.broadcast(v.values("outcome string, tool_name string, dst string", [("confirmed", "signup", "purchase")])))


def _turns(v):
    return V.first_turns(_observed(v), v.traced)


@query("f8_temporal_violations", duck(VIEWS, VIOLATED) + "SELECT * FROM viol")
def f8(v):
    return V.temporal_violations(_turns(v), _constraints(v))


@query("f8_temporal_score", duck(VIEWS, VIOLATED) + f"SELECT trace_id, {rd('avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END)', 'temporal')} FROM pairs GROUP BY trace_id")
def f8_score(v):
    turns, constraints = _turns(v), _constraints(v)
    return rounded(V.temporal_score(V.temporal_violations(turns, constraints), turns, constraints), "trace_id")


BRANCHED = f"""{OBSERVED}, want AS (SELECT scenario_id, 'inform' AS step_id, CASE WHEN scenario_id % 3 = 0 THEN 'away' ELSE 'home' END AS want FROM policy_must WHERE pos = 0 AND scenario_id % 7 > 0
      UNION ALL SELECT scenario_id, 'confirm', 'known' FROM policy_must WHERE pos = 0 AND scenario_id % 2 = 0),
    g AS (SELECT trace_id, b.step_id, count(DISTINCT b.next_step) AS n, max(cond) AS cond FROM obs o JOIN policy_branches b ON b.scenario_id = o.scenario_id AND b.next_step = o.step_id GROUP BY ALL),
    verdicts AS (SELECT q.trace_id, w.step_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN cond = want THEN 'correct' ELSE 'wrong' END AS verdict
      FROM (SELECT DISTINCT trace_id, scenario_id FROM obs) q JOIN want w USING (scenario_id) LEFT JOIN g ON g.trace_id = q.trace_id AND g.step_id = w.step_id)"""


def _branches(v):
    own = v.policy_must.where("pos = 0").select("scenario_id")
    want = own.where("scenario_id % 7 > 0").select("scenario_id", F.lit("inform").alias("step_id"), F.when(F.col("scenario_id") % 3 == 0, "away").otherwise("home").alias("cond"))
    want = want.unionByName(own.where("scenario_id % 2 = 0").select("scenario_id", F.lit("confirm").alias("step_id"), F.lit("known").alias("cond")))
    observed = _observed(v)
    return observed, V.verify_branches(observed, v.policy_branches, want)


@query("f9_verify_branches", duck(VIEWS, BRANCHED) + "SELECT * FROM verdicts")
def f9(v):
    return _branches(v)[1]


@query("f9_branch_score", duck(VIEWS, BRANCHED) + "SELECT q.trace_id, " + rd("avg(CASE WHEN verdict = 'correct' THEN 1.0 WHEN verdict IS NOT NULL THEN 0.0 END)", "branch")
       + " FROM (SELECT DISTINCT trace_id FROM obs) q LEFT JOIN verdicts w ON w.trace_id = q.trace_id GROUP BY q.trace_id")
def f9_score(v):
    observed, verdicts = _branches(v)
    return rounded(V.branch_score(verdicts, observed, v.policy_branches), "trace_id")


VERDICTS = f"""{VIOLATED}, atoms AS (SELECT scenario_id, 'step' AS kind, step_id AS atom, CASE WHEN is_optional THEN 0.5 ELSE 1.0 END AS weight FROM policies UNION ALL SELECT scenario_id, 'tool', tool_name, 1.0 FROM policy_must
      UNION ALL SELECT scenario_id, 'temporal', concat(src, '>', dst), penalty * 0.5 FROM cons),
    facts AS (SELECT DISTINCT trace_id, 'step' AS kind, step_id AS atom, true AS ok FROM obs UNION ALL SELECT DISTINCT trace_id, 'tool', tool_name, true FROM ev UNION ALL SELECT trace_id, 'temporal', concat(src, '>', dst), NOT bool_or(bad) FROM pairs GROUP BY ALL),
    v AS (SELECT q.trace_id, a.kind, a.atom, a.weight, CASE WHEN coalesce(ok, false) THEN 'satisfied' WHEN a.kind = 'step' AND a.weight < 1 THEN 'not_applicable' ELSE 'unsatisfied' END AS verdict
      FROM (SELECT DISTINCT trace_id, scenario_id FROM ev) q JOIN atoms a USING (scenario_id) LEFT JOIN facts f ON f.trace_id = q.trace_id AND f.kind = a.kind AND f.atom = a.atom)"""


def _verdicts(v):
    observed, constraints = _observed(v), _constraints(v)
    turns = V.first_turns(observed, v.traced)
    bad = V.temporal_violations(turns, constraints).withColumn("bad", F.lit(True))
    ok = v.traced.where("event_type = 'tool_executed' and error is null and source <> 'guard'")
    held = turns.select("trace_id", "scenario_id").join(constraints, "scenario_id").join(bad, ["trace_id", "src", "dst", "kind"], "left").groupBy("trace_id", F.concat_ws(">", "src", "dst").alias("atom")).agg((F.count("bad") == 0).alias("ok"))
    fact = lambda df, kind, atom: df.select("trace_id", F.lit(kind).alias("kind"), F.col(atom).alias("atom"), F.lit(True).alias("ok")).distinct()
    facts = fact(observed, "step", "step_id").unionByName(fact(ok, "tool", "tool_name")).unionByName(held.select("trace_id", F.lit("temporal").alias("kind"), "atom", "ok"))
    atoms = E.scoring_atoms(v.policies, v.policy_branches, v.policy_must, constraints).where("kind <> 'branch'")
    return V.atom_verdicts(atoms, ok, facts)


@query("f10_atom_verdicts", duck(VIEWS, VERDICTS) + "SELECT trace_id, kind, atom, verdict, CAST(CASE verdict WHEN 'satisfied' THEN weight WHEN 'unsatisfied' THEN -weight ELSE 0.0 END AS DOUBLE) AS delta FROM v")
def f10(v):
    return _verdicts(v)


COMPLIANCE = "coalesce(avg(CASE WHEN kind = 'step' AND verdict <> 'not_applicable' THEN CASE WHEN verdict = 'satisfied' THEN 1.0 ELSE 0.0 END END), 1.0)"


@query("f11_step_compliance", duck(VIEWS, VERDICTS) + f"SELECT trace_id, {rd(COMPLIANCE, 'compliance')} FROM v GROUP BY trace_id")
def f11(v):
    return rounded(V.step_compliance(_verdicts(v)), "trace_id")


@query("f12_illegal_transitions", duck(VIEWS, f"""{OBSERVED}, {POLICY_EDGES}, n AS (SELECT trace_id, o.scenario_id, step_id AS src, lead(step_id) OVER w AS dst, ord, lead(ord) OVER w AS nxt FROM obs o JOIN policies USING (scenario_id, step_id)
      WINDOW w AS (PARTITION BY trace_id ORDER BY first_turn, ord))""") + "SELECT trace_id, src, dst FROM n WHERE nxt < ord AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.scenario_id = n.scenario_id AND e.src = n.src AND e.dst = n.dst)")
def f12(v):
    return V.illegal_transitions(_observed(v).select("trace_id", "scenario_id", "step_id", "first_turn"), _edges(v), v.policies)


@query("f14_rule_step_entries", duck(VIEWS, f"{TOOLS}, {SPOKEN}, t AS (SELECT trace_id, step_id, min(turn) AS t FROM tm GROUP BY ALL), u AS (SELECT trace_id, step_id, min(turn) AS u FROM um GROUP BY ALL)")
       + """SELECT q.trace_id, s.step_id, CASE WHEN t IS NOT NULL THEN 'tool' WHEN u IS NOT NULL THEN 'words' ELSE 'none' END AS "by", coalesce(t, u) AS turn
    FROM (SELECT DISTINCT trace_id, scenario_id FROM traced) q JOIN policies s USING (scenario_id) LEFT JOIN t ON t.trace_id = q.trace_id AND t.step_id = s.step_id LEFT JOIN u ON u.trace_id = q.trace_id AND u.step_id = s.step_id""")
def f14(v):
    return V.rule_step_entries(v.policies, _tools(v).unionByName(_spoken(v)), v.traced)


#: A call of over 85 stands for a turn that states one of the policy's three requirements.
INTENT = """req AS (SELECT scenario_id, concat('r', CAST(pos AS VARCHAR)) AS req_id, (scenario_id + pos) % 2 = 0 AS mutable FROM policy_must),
    mention AS (SELECT trace_id, concat('r', CAST(turn % 4 AS VARCHAR)) AS req_id, turn, CASE WHEN k % 3 > 0 THEN turn + 1 END AS rt, k % 4 AS pressure FROM traced WHERE amount > 85),
    g AS (SELECT trace_id, req_id, arg_min(coalesce(rt, -1), turn) AS rt, arg_min(pressure, turn) AS pressure FROM mention GROUP BY ALL),
    x AS (SELECT q.trace_id, req.req_id, mutable, CASE WHEN g.req_id IS NULL THEN 'missing' WHEN rt = -1 THEN 'satisfied_no_user_response' WHEN pressure >= 2 THEN 'induced_skip' ELSE 'satisfied' END AS verdict
      FROM (SELECT DISTINCT trace_id, scenario_id FROM traced) q JOIN req USING (scenario_id) LEFT JOIN g ON g.trace_id = q.trace_id AND g.req_id = req.req_id)"""


@query("f17_canonical_intent", duck(VIEWS, INTENT) + "SELECT trace_id, req_id, verdict, NOT mutable AND verdict IN ('missing', 'induced_skip') AS critical FROM x")
def f17(v):
    mentions = v.traced.where("amount > 85").select("trace_id", F.concat(F.lit("r"), (F.col("turn") % 4).cast("string")).alias("req_id"), "turn", F.expr("case when k % 3 > 0 then turn + 1 end").alias("response_turn"), (F.col("k") % 4).alias("pressure"))
    requirements = v.policy_must.select("scenario_id", F.concat(F.lit("r"), F.col("pos").cast("string")).alias("req_id"), ((F.col("scenario_id") + F.col("pos")) % 2 == 0).alias("mutable"))
    return V.canonical_intent(mentions, requirements, v.traced)


#: What may cause what: each policy has five of these six, so causes differ from one to the next.
CAUSES = [("greet", "inform"), ("click", "inform"), ("purchase", "click>signup"), ("inform", "purchase"), ("confirm", "farewell"), ("signup>purchase", "purchase")]
EDGES = "e AS (SELECT c_custkey AS scenario_id, src, dst FROM customer CROSS JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(CAUSES)) + """) t(i, src, dst) WHERE c_custkey % 6 <> i),
    own AS (SELECT DISTINCT trace_id, scenario_id FROM traced), bad AS MATERIALIZED (SELECT scenario_id, trace_id, atom, max(abs(CASE verdict WHEN 'unsatisfied' THEN -weight ELSE 0.0 END)) AS weight FROM v JOIN own USING (trace_id) WHERE verdict = 'unsatisfied' GROUP BY ALL)"""


def _causes(v):
    pairs = v.values("i int, src string, dst string", [(i, a, b) for i, (a, b) in enumerate(CAUSES)])
    return v.table("customer").join(F.broadcast(pairs)).where("c_custkey % 6 <> i").select(F.col("c_custkey").alias("scenario_id"), "src", "dst")


def _own_verdicts(v):
    return _verdicts(v).join(v.traced.select("trace_id", "scenario_id").distinct(), "trace_id")


@query("i4_causal_roots", duck(VIEWS, VERDICTS + ", " + EDGES) + "SELECT trace_id, atom FROM bad b WHERE NOT EXISTS (SELECT 1 FROM e JOIN bad p ON p.atom = e.src AND p.trace_id = b.trace_id WHERE e.dst = b.atom AND e.scenario_id = b.scenario_id)")
def i4(v):
    return I.causal_roots(_own_verdicts(v), _causes(v))


@query("i4_failure_kind", duck(VIEWS, VERDICTS) + "SELECT trace_id, arg_min(kind, CASE kind WHEN 'tool' THEN 1 WHEN 'branch' THEN 2 WHEN 'temporal' THEN 3 ELSE 4 END) AS kind FROM v WHERE verdict = 'unsatisfied' GROUP BY trace_id")
def i4_kind(v):
    return I.failure_kind(_verdicts(v))


REPAIR = """cs AS (SELECT b.trace_id, b.atom, b.weight, list(DISTINCT p.atom) FILTER (WHERE p.atom IS NOT NULL) AS causes FROM bad b LEFT JOIN e ON e.scenario_id = b.scenario_id AND e.dst = b.atom LEFT JOIN bad p ON p.trace_id = b.trace_id AND p.atom = e.src GROUP BY ALL),
    al AS MATERIALIZED (SELECT trace_id, list(struct_pack(atom := atom, weight := weight, causes := coalesce(causes, []))) AS atoms FROM cs GROUP BY trace_id),
    g AS (SELECT trace_id, atoms, x.atom AS root, [x.atom] AS good, 1 AS more FROM (SELECT *, unnest(atoms) AS x FROM al)
      UNION ALL SELECT trace_id, atoms, root, list_concat(good, list_transform(fresh, lambda a: a.atom)), len(fresh) FROM (SELECT *, list_filter(atoms, lambda a: NOT list_contains(good, a.atom) AND len(a.causes) > 0 AND list_has_all(good, a.causes)) AS fresh FROM g WHERE more > 0)),
    done AS (SELECT * FROM g WHERE more = 0)"""


@query("i5_counterfactual_repair", duck(VIEWS, VERDICTS + ", " + EDGES + ", " + REPAIR).replace("WITH", "WITH RECURSIVE", 1) + f"""SELECT trace_id, root AS atom, len(good) AS recovers,
    {rd("list_sum(list_transform(list_filter(atoms, lambda a: list_contains(good, a.atom)), lambda a: a.weight)) / greatest(list_sum(list_transform(atoms, lambda a: a.weight)), 1.0) * 0.25", "gain")} FROM done""")
def i5(v):
    return rounded(I.counterfactual_repair(_own_verdicts(v), _causes(v)), "trace_id", "atom", "recovers")
