"""Reworked, short and boilerplate items, and the whole result against a plain version on made-up texts."""

import random
import re

from colloquy.llm import decontaminate as D


def found(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string, hash int"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.kind, r.n_covered, r.n_words) for r in D.contaminated(a, b).collect()}


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 3 pens. Tom buys 4 pens. Tom sells 2 pens. How many pens has Tom now?"
    docs = [(1, f"Heading {item.replace('Tom', 'Anna').replace('4', '7')}"), (2, "quiz: " + item[0].lower() + item[1:]), (3, item.replace("Tom sells", "Ben sells")), (4, "Tom has pens. How many?")]
    got = found(spark, [(*d, "x", 1) for d in docs], [(0, item)])
    assert {k: v[0] for k, v in got.items() if k[0] != 3} == {(1, 0): "reworked", (2, 0): "copy"}


def test_names_and_numbers_of_several_words(spark):
    """A name or number of other length is still one slot, at the start of sentences too."""
    item = "Tom has 3 pens. Tom buys 4 pens. Tom sells 2 pens. How many pens has Tom now?"
    long_ = "Yesterday the farmer Peter Miller from Berlin sold three hundred apples to old Anna and kept seven for his brother Jim in the city of Rome today."
    docs = [(1, item.replace("Tom", "Mary Ann")), (2, item.replace("Tom", "Mary Ann Lee").replace("3", "three hundred")), (3, "So. " + item.replace("Tom", "Mary Ann").replace("Mary Ann sells", "Ben sells")),
            (4, long_.replace("Peter Miller", "Karl").replace("three hundred", "9").replace("Anna", "Maria del Mar").replace("Rome", "New York")), (5, item), (6, "Mary Ann has pens. Mary Ann buys pens.")]
    got = found(spark, [(*d, "x", 1) for d in docs], [(0, item), (9, long_)])
    assert {k: v[0] for k, v in got.items() if k[0] != 3} == {(1, 0): "reworked", (2, 0): "reworked", (4, 9): "reworked", (5, 0): "copy"} and got[1, 0][1:] == (18, 18)


def test_items_with_few_plain_words(spark):
    item = "12 + 7 * 3 - 40 / 2 + 9 - 1 = ?"
    docs = [(1, f"See {item} here"), (2, item.replace("40", "41")), (3, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (4, None), (4, ""), (None, item)]
    got = found(spark, [(*d, "x", 1) for d in docs], [(5, item), (6, None), (7, "")])
    assert got == {(1, 5): ("copy", 7, 7)}


def test_sentence_that_all_items_share(spark):
    """Documents with the common sentence meet no item by it alone."""
    common = "Answer the following question with one of the letters given below."
    r = random.Random(1)
    items = [(i, common + " " + " ".join(f"w{r.randrange(3000)}" for _ in range(20))) for i in range(60)]
    docs = [(i, f"x {common} y") for i in range(60)] + [(100 + i, f"before {t} after") for i, t in items[:5]] + [(200, items[7][1]), (200, items[7][1])]
    got = found(spark, [(*d, "x", 1) for d in docs], items)
    assert {k: v[0] for k, v in got.items()} == {(100 + i, i): "copy" for i in range(5)} | {(200, 7): "copy"}
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.matches(a, b).count() == 6


def plain(docs, items, window=D.WINDOW, cover=D.COVER):
    """All windows of all pairs, by lists of words, for texts in lower case without units and names."""
    def words(t):
        return [w for w in (re.sub(r"[^\w]", "", x) for x in t.split()) if w]

    def template(ws):
        number = [w.isdigit() for w in ws]
        return tuple(ws) if len(ws) - sum(number) < min(D.PLAIN, len(ws)) else tuple("#" if n else w for w, n in zip(ws, number))

    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = words(t), words(u)
            size = min(window, len(b))
            by_shift = {}
            for p in range(len(b) - size + 1 if b else 0):
                for q in range(len(a) - size + 1):
                    if template(a[q : q + size]) == template(b[p : p + size]):
                        by_shift.setdefault(q - p, set()).update(range(p, p + size))
            good = set()
            for shift, at in by_shift.items():
                pairs = {(b[k], a[k + shift]) for k in at if b[k].isdigit()}
                if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                    good |= at
            if b and len(good) >= cover * len(b):
                out[d, i] = (len(good), len(b))
    return out


def test_against_a_plain_version(spark):
    r = random.Random(5)
    some = lambda n: [str(r.randrange(40)) if r.random() < 0.25 else r.choice("abcdefgh") * r.randrange(2, 4) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([2, 5, 8, 12, 25])))) for i in range(25)]
    docs = []
    for d in range(80):
        own = some(r.randrange(30))
        for _ in range(r.randrange(3)):
            ws = r.choice(items)[1].split()
            other = {w: str(r.randrange(40)) if r.random() < 0.3 else w for w in ws if w.isdigit()}
            ws = [other.get(w, w) for w in ws][r.choice([0, 0, 0, 2, 5]) :]
            own += ws + some(r.randrange(6))
        docs.append((d, " ".join(own)))
    want = plain(docs, items)
    got = found(spark, [(*d, "x", 1) for d in docs], items)
    assert {k: v[1:] for k, v in got.items()} == want and len(want) > 30
