"""Benchmark decontamination by templates.

Words become a template: numbers, names and units are replaced by typed placeholders, so a question with other
numbers or names has the same template. Windows of templates are joined by hash, and the slots of the windows are
checked: one value in the item must always meet one value in the document. A capital at the start of a sentence may stand for a name
or not, so windows with one have both templates. Names of several words, and numbers written in several, are one slot. Windows with few plain words go by their
own words instead of placeholders.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import arrow_schema, map_columns, rows_batch, slices
from colloquy.llm.bpe import Memo, claim
from colloquy.llm.shared import written

#: Words in a template window, and how many of them must be plain words.
WINDOW, PLAIN = 8, 4
#: Share of an item's words that a document must hold.
COVER = 0.6
#: Bits of the filter that tells tasks which windows no item has; its size doesn't depend on the items.
FILTER = 1 << 25
#: Fixed list of units.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram "
    "kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years percent % usd eur dollar dollars euro euros cent cents k °c °f degree degrees hz khz mhz ghz w kw v kb mb gb tb".split()
)
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve hundred thousand million".split()
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d,.:/]*(?:st|nd|rd|th|%)?|" + "|".join(NUMBER_WORDS))
COUNTED = frozenset(NUMBER_WORDS)
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")
STOPS = (".", "!", "?", ":", "\"", "”", ")", "]")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Before the value of a slot whose first word may not belong to it.
LOOSE = "\1"
#: Low bits of a word's code: it may be a name; the next word starts a sentence; it is a number or a unit; it is empty; it is a number's word.
MAYBE_NAME, STOP, SLOT, EMPTY, SPOKEN = 1, 2, 4, 8, 16
ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def bare(raw: str) -> str:
    """The word without punctuation around it."""
    word = raw.rstrip(".,;:!?")  # most words need no more than this
    return word if word.isalpha() else EDGE.sub("", raw)


def kind(word: str) -> str:
    """The template of a word that is no name."""
    low = word.lower()
    number = low in COUNTED if low.isalpha() else NUMBER.fullmatch(low)
    return NUM if number else UNIT if low in UNITS else low


def digest(template: str) -> int:
    return xxhash.xxh64_intdigest(template.encode("utf-8", "surrogatepass")) & ~0xFF & 0xFFFFFFFFFFFFFFFF


def code(raw: str) -> int:
    """Hash of a word's template with its flags."""
    word = bare(raw)
    template = kind(word)
    flags = (MAYBE_NAME if word[:1].isupper() and template not in (NUM, UNIT) else 0) | (STOP if raw.endswith(STOPS) else 0)
    return digest(template) | flags | (SLOT if template in (NUM, UNIT) else 0) | (0 if word else EMPTY) | (SPOKEN if word.lower() in COUNTED else 0)


def own_code(raw: str) -> int:
    """Hash of a word itself."""
    return digest("=" + bare(raw).lower())


NAME_HASH = np.uint64(digest(NAME))
CODES, OWN = Memo(code, 250_000), Memo(own_code, 30_000)


class Templates:
    """Template hashes of the words of several texts in a row; words without letters or digits fall away."""

    def __init__(self, texts: list[str | None]):
        self.words, sizes = [], []
        for t in texts:
            own = (t or "").split()
            self.words += own
            sizes.append(len(own))
        codes = np.fromiter(map(CODES.__getitem__, self.words), np.uint64, len(self.words))
        doc = np.repeat(np.arange(len(texts)), sizes)
        keep = (codes & np.uint64(EMPTY)) == 0
        stop = (codes & np.uint64(STOP)) != 0
        start = np.ones(len(codes), bool)  # of a sentence: the first word of a text, and each after a stop
        start[1:] = stop[:-1] | (doc[1:] != doc[:-1])
        capital = (codes & np.uint64(MAYBE_NAME)) != 0
        at, names, either, spoken = np.flatnonzero(keep), (capital & ~start)[keep], (capital & start)[keep], ((codes & np.uint64(SPOKEN)) != 0)[keep]
        # a name goes on with the next word if that is one too, whatever the first is; so does a number in words
        on = np.zeros(len(at), bool)
        on[1:] = (at[1:] == at[:-1] + 1) & ~start[at[1:]] & (names[1:] & (names | either)[:-1] | (spoken[1:] & spoken[:-1]))
        head = np.flatnonzero(~on)
        self.at, self.end = at[head], at[np.append(head[1:], len(at))[: len(head)] - 1] + 1
        self.doc, names, self.either = doc[self.at], names[head], either[head]  # either: a name or not
        self.fixed = ((codes & np.uint64(SLOT)) != 0)[self.at]  # a number or a unit
        self.begun = self.either & (self.end > self.at + 1)  # a word that may be part of the name after it
        self.names = (names, names | self.either)
        plain = (codes & ~np.uint64(0xFF))[self.at]
        plain[self.begun] += NAME_HASH
        self.hashes = tuple(np.where(n, NAME_HASH, plain) for n in self.names)
        self.own = plain.copy()
        some = np.flatnonzero(self.names[1] | self.fixed)
        self.own[some] = np.fromiter((OWN[self.words[a]] if b == a + 1 else own_code(" ".join(map(bare, self.words[a:b]))) for a, b in zip(self.at[some].tolist(), self.end[some].tolist())), np.uint64, len(some))
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, kind) of all windows of this many words in one text. Kind 0: capitals at the start of a sentence are no names;
        1: they are, if there are any; 2: too few plain words, so the window's own words count."""
        n = len(self.own) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
        whole = self.doc[:n] == self.doc[size - 1 :]

        def count(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask)))
            return sums[size:] - sums[:-size]

        def total(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Hashes of the windows there; of most windows, or of a few."""
            mixed = hashes ^ (hashes >> np.uint64(29))
            if 3 * len(at) < n:
                return sum((mixed[at + i] * ODD[i % 64] for i in range(1, size)), mixed[at] * ODD[0])
            out = mixed[:n] * ODD[0]
            for i in range(1, size):
                out += mixed[i : i + n] * ODD[i % 64]
            return out[at]

        fit = [size - count(names | self.fixed) >= min(PLAIN, size) for names in self.names]
        parts = [(whole & fit[0], self.hashes[0]), (whole & fit[1] & (count(self.either) > 0), self.hashes[1]), (whole & ~fit[0], self.own)]
        found = [np.flatnonzero(mask) for mask, _ in parts]
        hashes = [total(h, at) if len(at) else np.zeros(0, np.uint64) for at, (_, h) in zip(found, parts)]
        return np.concatenate(found), np.concatenate(hashes), np.repeat(np.arange(3, dtype=np.int8), [len(at) for at in found])

    def text(self, i: int, skip: int = 0) -> str:
        return " ".join(map(bare, self.words[self.at[i] + skip : self.end[i]]))

    def template(self, start: int, size: int, kind_: int) -> str:
        if kind_ == 2:
            return "= " + " ".join(self.text(i) for i in range(start, start + size)).lower()
        word = lambda i: kind(bare(self.words[self.at[i]])) + (" " + NAME if self.begun[i] else "")
        return " ".join(NAME if self.names[kind_][i] else word(i) for i in range(start, start + size))

    def slots(self, start: int, size: int, kind_: int) -> list[str]:
        """Values of the slots. Where the first word of a name may be none, the rest of it is the value, or all of it with `LOOSE` ahead."""
        own = slice(start, start + size)
        slot = self.names[kind_ % 2][own] | self.fixed[own] | self.begun[own]
        begun = self.begun[own].tolist()
        return [(self.text(start + i, 1) if kind_ != 1 else LOOSE + self.text(start + i)).lower() if begun[i] else self.text(start + i).lower() for i in np.flatnonzero(slot).tolist()]


def windows(df: DataFrame, id_col: str, text_col: str, sizes: list[int], bits: np.ndarray | None, whole: bool = False) -> DataFrame:
    """(id, pos, n_words, size, hash, template, slots) of template windows.

    `whole`: of texts shorter than the window, the whole text is one window. `bits`: a filter (`item_bits`); windows that it doesn't
    let through are left out.
    """
    kind_ = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind_}, pos int, n_words int, size int, hash long, template string, slots array<string>"
    out = arrow_schema(schema)

    def run(batches):
        claim(__name__)
        for part in slices(batches, 2 << 20):
            ids, t = part.column(0).to_pylist(), Templates(part.column(1).to_pylist())
            first = np.concatenate(([0], np.cumsum(t.counts)))
            rows = []
            for size in sizes:
                at, h, kinds = t.windows(size)
                some = np.ones(len(at), bool)
                if whole and size < WINDOW:
                    some &= t.counts[t.doc[at]] == size
                if bits is not None:
                    for place in places(h):
                        some[some] &= bits[place[some] >> 3] >> (place[some] & 7).astype(np.uint8) & 1 == 1
                for a, x, k in zip(at[some].tolist(), h[some].view(np.int64).tolist(), kinds[some].tolist()):
                    d = t.doc[a]
                    rows.append((ids[d], int(a - first[d]), int(t.counts[d]), size, x, t.template(a, size, k), t.slots(a, size, k)))
            yield rows_batch(rows, out)

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return tuple(((hashes >> np.uint64(shift)) & np.uint64(FILTER - 1)).astype(np.int64) for shift in (8, 36))


def item_bits(of_items: DataFrame) -> np.ndarray:
    """The filter's bytes with the bits of all item windows. Spark puts them together in words of 64 bits, of which there are
    `FILTER / 64` however many items there are."""
    bit = lambda shift: F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit(FILTER - 1))
    set_ = of_items.select(F.explode(F.array(bit(8), bit(36))).alias("bit"))
    words = set_.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def rarest(of_items: DataFrame, cover: float) -> DataFrame:
    """item_id, hash, template of windows of which every document with that cover of the item has one.

    The windows that most items share are left out as long as they alone don't cover so much of the item. A sentence that stands in
    many items thus makes no pairs of all of them with all documents that have it.
    """
    shared = of_items.groupBy("hash", "template").agg(F.count("*").alias("items"))
    rows = of_items.join(shared, ["hash", "template"]).groupBy("item_id", "n_words").agg(F.collect_list(F.struct("items", "pos", "size", "hash", "template")).alias("windows"))
    kind_ = of_items.schema["item_id"].dataType.simpleString()

    def run(ids, n_words, windows_):
        made = {"item_id": [], "hash": [], "template": []}
        for i, n, own in zip(ids, n_words, windows_):
            own.sort(key=lambda w: (-w["items"], w["pos"], w["hash"], w["template"]))
            covered: set[int] = set()
            for k, w in enumerate(own):
                covered.update(range(w["pos"], w["pos"] + w["size"]))
                if len(covered) >= cover * n or k == len(own) - 1:
                    break
            for w in own[k:]:
                made["item_id"].append(i)
                made["hash"].append(w["hash"])
                made["template"].append(w["template"])
        return made

    return map_columns(rows, {"item_id": "item_id", "n_words": "n_words", "windows": "windows"}, run, f"item_id {kind_}, hash long, template string").distinct()


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_covered and n_words (of the item), consistent, same (all slots have the item's own values).

    One row for each document and item that may have that cover: they share one of the item's rarest windows. Slots are checked along
    each alignment of item and document: values must map one to one. Null and empty texts have no windows; repeated items are
    items of their own; rows that repeat a document count once, and rows with a null id are left out. Without documents or items there are no rows.
    """
    of_items = written(windows(items, item_col, item_text_col, list(range(1, window + 1)), None, whole=True), "item-windows")
    sizes = sorted(r["size"] for r in of_items.select("size").distinct().collect())  # up to `window` numbers
    ours = of_items.select(F.col("id").alias("item_id"), "pos", "n_words", "size", "hash", "template", "slots")
    theirs = windows(docs, id_col, text_col, sizes, item_bits(of_items))
    theirs = written(theirs.select(F.col("id").alias("doc_id"), F.col("pos").alias("at"), "hash", "template", F.col("slots").alias("values")), "document-windows")
    candidates = theirs.join(rarest(ours, cover), ["hash", "template"]).select("doc_id", "item_id").distinct()
    met = theirs.join(candidates.join(ours, "item_id"), ["doc_id", "hash", "template"])
    pairs = F.transform(F.arrays_zip("slots", "values"), lambda x: F.struct(x["slots"].alias("s"), x["values"].alias("v")))
    aligned = met.groupBy("doc_id", "item_id", "n_words", (F.col("at") - F.col("pos")).alias("shift")).agg(
        F.collect_set(F.struct("pos", "size")).alias("found"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    # a loose value is what another slot holds, or the one that it meets, if it ends with that; else all of itself
    for side, other, on in (("s", "v", "true"), ("v", "s", "q.s = p.s")):
        same = f"get(filter(pairs, q -> {on} and not startswith(q.{side}, '{LOOSE}') and endswith(p.{side}, concat(' ', q.{side}))), 0).{side}"
        met_ = f"if(endswith(p.{side}, concat(' ', p.{other})), p.{other}, null)"
        new = {"s": "p.s", "v": "p.v", side: f"if(startswith(p.{side}, '{LOOSE}'), coalesce({same}, {met_}, substring(p.{side}, 2)), p.{side})"}
        aligned = aligned.withColumn("pairs", F.expr(f"if(exists(pairs, p -> startswith(p.{side}, '{LOOSE}')), array_distinct(transform(pairs, p -> struct({new['s']} as s, {new['v']} as v))), pairs)"))
    one_to_one = "size(pairs) = size(array_distinct(pairs.s)) and size(pairs) = size(array_distinct(pairs.v))"
    aligned = aligned.select(
        "doc_id", "item_id", "n_words", F.expr("flatten(transform(found, f -> sequence(f.pos, f.pos + f.size - 1)))").alias("covered"),
        F.expr(one_to_one).alias("consistent"), F.expr("forall(pairs, p -> p.s = p.v)").alias("same"),
    )
    return aligned.groupBy("doc_id", "item_id", "n_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("consistent"), F.col("covered")).otherwise(F.array().cast("array<int>")))))).alias("n_covered"),
        F.bool_or("consistent").alias("consistent"), F.bool_and("same").alias("same"),
    )


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 cover: float = COVER) -> DataFrame:
    """doc_id and item_id of leaks, with n_covered, n_words and kind: `copy`, or `reworked` where slots have other values.

    A leak covers at least `cover` of the item's words by windows whose slots are consistent. Nulls, repeats and empty tables are as in `matches`.
    """
    found = matches(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, cover=cover)
    leaks = found.where(F.col("consistent") & (F.col("n_covered") >= cover * F.col("n_words")))
    return leaks.select("doc_id", "item_id", "n_covered", "n_words", F.when(F.col("same"), "copy").otherwise("reworked").alias("kind"))
