"""Queries without SQL look at whole traces and whole texts."""

import difflib

import pytest

from colloquy import plans
from colloquy.functions import fuzzy
from colloquy.plans import trace_queries as P
from colloquy.plans.views import Views


def test_steps_and_paths_of_whole_traces(spark, small):
    """First events by a plain loop over each trace's whole ledger, under its own policy."""
    v = Views(spark, small)
    tools = {}
    for p in v.predicates.where("kind = 'tool'").collect():
        tools.setdefault(p.scenario_id, []).append(p)
    want, late = set(), 0
    events = {}
    for r in sorted(v.traced.where("event_type = 'tool_executed' and error is null and source <> 'guard'").collect(), key=lambda r: r.seq):
        events.setdefault((r.trace_id, r.scenario_id), []).append(r)
    for (trace, scenario), own in events.items():
        for p in tools.get(scenario, []):
            fit = lambda r, p=p: r.tool_name == p.tool_name and (not p.args or float(p.args["level"]) == float(r.level_arg)) and (r.own_order is None or r.order_id in (None, r.own_order))
            at = next((r.seq for r in own if fit(r)), None)
            if at is not None:
                want.add((trace, p.step_id, at))
                late += at > 12
    assert {(r.trace_id, r.step_id, r.seq) for r in plans.QUERIES["f2_match_predicates"](spark, small).collect()} == want and late
    observed = {}
    for r in plans.QUERIES["f3_observed_steps"](spark, small).collect():
        observed.setdefault(r.trace_id, set()).add(r.step_id)
    paths = {r.trace_id: set(r.observed) for r in P._paths(v).collect()}
    assert paths == observed and {r.trace_id for r in plans.QUERIES["f4_align_ordered"](spark, small).collect()} == set(paths)


def test_repetition_of_whole_texts(spark, small):
    said = {}
    for m in sorted(Views(spark, small).agents.collect(), key=lambda m: (m.trace_id, m.msg_idx)):
        said.setdefault(m.trace_id, []).append((m.turn, m.content or ""))
    want = {(t, b[0]) for t, own in said.items() for a, b in zip(own, own[1:]) if a[1] and b[1] and max(len(a[1]), len(b[1])) > 5 and difflib.SequenceMatcher(None, a[1], b[1]).ratio() >= 0.9}
    assert {(r.trace_id, r.turn) for r in plans.QUERIES["g1_verbatim_repetition"](spark, small).collect()} == want
    stuck = set()
    for t, own in said.items():
        texts = [b[1] if i % 2 == 0 else [a[1], f"{a[1]} {b[1][:20]}", a[1].translate(str.maketrans("aei", "oxu"))][t % 3] for i, (a, b) in enumerate(zip([(0, ""), *own], own))]
        pairs = [(own[i + 1][0], a.strip(), b.strip()) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
        stuck |= {(t, turn) for turn, a, b in pairs if a and b and max(len(a), len(b)) > 5 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert {(r.trace_id, r.turn) for r in plans.QUERIES["g1_stuck_agents"](spark, small).collect()} == stuck and len(stuck) > 5


def test_evidence_of_whole_texts(spark, small):
    by_trace = {}
    for m in sorted(Views(spark, small).messages.collect(), key=lambda m: (m.trace_id, m.msg_idx)):
        by_trace.setdefault(m.trace_id, []).append(m)
    got, checked = {r.trace_id: r.rate for r in plans.QUERIES["f20_judge_evidence"](spark, small).collect()}, 0
    for trace, own in list(by_trace.items())[:60]:
        agent = {m.turn: m.content for m in own if m.role == "agent"}
        cited = [(m.turn + trace % 2, n.content) for m, n in zip(own, own[1:])]
        good = [t in agent and difflib.SequenceMatcher(None, q, agent[t]).ratio() >= 0.3 for t, q in cited]
        if cited:
            assert got[trace] == pytest.approx(sum(good) / len(good))
            checked += 1
    assert checked


def test_alias_of_whole_texts(spark, small):
    texts = {(m.trace_id, m.turn): m.content for m in Views(spark, small).messages.collect()}
    got = {(r.trace_id, r.turn): r.score for r in plans.QUERIES["d5_alias_match"](spark, small).collect()}
    late = {k: t for k, t in texts.items() if fuzzy.alias_score("thention", t) > fuzzy.alias_score("thention", t[:80])}
    assert late and got.keys() == texts.keys() and all(got[k] == fuzzy.alias_score("thention", t) for k, t in late.items())
