"""Repair of conversations against a plain table of costs and against trying all edits."""

import hashlib
import itertools
import random
import re

from colloquy.llm import turn_repair
from colloquy.llm.turn_repair import Repair, crossings, ending, fold, step

GOOD = re.compile("(s?(ua)+)?")


def try_all(kinds, most=2):
    """Least (cost, edits) of all that keep, rename or delete each turn, with up to `most` insertions before each and at the end."""
    best = None
    ways = [[(3, "D", "")] + ([] if k == "x" else [(k.isupper(), "K", k.lower())] + [(2 + k.isupper(), "R", to) for to in "ua"]) for k in kinds]
    puts = [p for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    for own in itertools.product(*ways):
        for put in itertools.product(puts, repeat=len(kinds) + 1):
            roles = "".join("".join(p) + w[2] for p, w in zip(put, [*own, (0, "", "")]))
            if GOOD.fullmatch(roles):
                audit = "".join("I" * len(p) + w[1] for p, w in zip(put, [*own, (0, "", "")]))
                best = min(best or (99, ""), (sum(w[0] for w in own) + 2 * sum(map(len, put)), audit))
    return best


def plain(rows):
    """One conversation by a forward table that carries the edits and the text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, kinds = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        kinds.append((fault in (0, 1), fault == 2))
    table = {"": (0, "", "")}  # by the roles' end: s, u, a
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def opened(t):
        out = dict(t)
        for _ in range(2):
            for p, (c, a, r) in list(out.items()):
                q = after[p]
                out[q] = min(out.get(q, (9e9,)), (c + 2, a + "I", r + f"{full[q]}:\n"))
        return out

    for (_, role, text), (gone, cut) in zip(rows, kinds):
        new = {}
        for p, (c, a, r) in opened(table).items():
            ways = [(p, 3, "D", "")]
            if not gone:
                q = role[:1]
                if q and (after[p] == q or p == "" and q == "s"):
                    ways.append((q, cut, "K", f"{role}:{text}\n"))
                ways.append((after[p], 2 + cut, "R", f"{full[after[p]]}:{text}\n"))
            for q, cost, letter, line in ways:
                new[q] = min(new.get(q, (9e9,)), (c + cost, a + letter, r + line))
        table = new
    cost, audit, text = min(v for p, v in opened(table).items() if p in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *faults, wrong, cost, audit, hashlib.sha256(text[:-1].encode()).hexdigest(), text[:-1]


def test_edits_are_the_least_of_all():
    for n in range(4):
        for kinds in itertools.product("suaoUx", repeat=n):
            steps = list(map(step, kinds))
            cost, last = ending(fold(steps))
            at = crossings(steps, 0, last)
            audit = "".join(one.edits[at[i]][at[i + 1]] for i, one in enumerate(steps)) + turn_repair.CLOSING[last]
            assert (cost, audit) == try_all(kinds), kinds


def test_folds_agree_in_any_grouping():
    r = random.Random(5)
    for _ in range(200):
        steps = [step(r.choice("suaoSUAx")) for _ in range(r.randrange(1, 12))]
        cut = r.randrange(len(steps) + 1)
        assert fold([fold(steps[:cut]), fold(steps[cut:])]) == fold(steps) if 0 < cut < len(steps) else True


def conversations(seed, count, most):
    r, rows = random.Random(seed), []
    for c in range(count):
        for t in range(r.randrange(1, most)):
            for _ in range(r.choice([1, 1, 1, 2])):
                text = r.choice(["", " \n", "Yes.", "No", f"t{r.randrange(30)}?", f"ü {t} ", "x" * 100 + str(t % 3)])
                rows.append((c, r.choice([t, t, t + 7, None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), text))
    return rows


def test_tables_against_a_plain_version(spark):
    """Short and long conversations, in whole and in blocks of three turns over many parts."""
    rows = conversations(1, 40, 9) + [(99, t, role, text) for _, t, role, text in conversations(2, 30, 12)] + [(98, 1, "user", "again.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS part", "1 AS block", "2 AS cost").repartition(4)
    want = {c: plain([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    for given in (Repair(df), Repair(df, rows=3)):
        got = {x[0]: tuple(x)[1:] for x in given.audits().collect()}
        assert got == {c: w[:-1] for c, w in want.items()}
        turns = given.turns().orderBy("conv_id", "part", "block", "pos").collect()
        assert all("\n".join(f"{x.role}:{x.text}" for x in turns if x.conv_id == c) == w[-1] for c, w in want.items())


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 2, "user", "Hi."), (1, None, "user", "A?"), (1, 5, "assistant", "b " * 400_000 + "."), (1, 5, "assistant", "b " * 400_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for given in (Repair(df), Repair(df, rows=1)):
        got = {r.conv_id: r for r in given.audits().collect()}
        assert (got[None].blank, got[None].cost, got[None].audit) == (1, 5, "DKI") and (got[1].duplicate, got[1].cost, got[1].audit, got[1].gaps) == (1, 3, "KKD", 0)
        assert given.turns().count() == 4
    none = Repair(df.limit(0))
    assert none.audits().count() == none.turns().count() == 0
