"""Many words in many texts: one pass over each text with an automaton of its policy's words, however many there are."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, IntegerType

#: Word lists of up to so many characters in all are sent to every task; larger ones travel with their policy's texts.
SENT = 8 << 20
#: Texts of one policy that a task reads at least before the policy is split over several.
SPLIT = 50_000
#: Automata that a task remembers, where policies take turns.
KEPT = 64


class Lists:
    """Word lists of one policy. `found(text)`: for each list that has a word in the text, the places of all such words in it."""

    def __init__(self, lists: tuple[tuple[str, ...], ...]):
        import ahocorasick

        self.always, of = {}, {}
        for i, words in enumerate(lists):
            for place, word in enumerate(words):
                if word == "":
                    self.always.setdefault(i, []).append(place)
                elif word is not None:
                    of.setdefault(word, []).append((i, place))
        self.words = ahocorasick.Automaton()
        for word, places in of.items():
            self.words.add_word(word, (word, places))
        if of:
            self.words.make_automaton()
        self.some = bool(of)

    def found(self, text: str | None) -> dict[int, list[int]]:
        if text is None:
            return {}
        out, seen = {i: list(places) for i, places in self.always.items()}, set()
        if self.some:
            for _, (word, places) in self.words.iter(text):
                if word not in seen:
                    seen.add(word)
                    for i, place in places:
                        out.setdefault(i, []).append(place)
        return out


def first_words(texts: DataFrame, policies: DataFrame, columns: list[str], keep: list[str], **sizes: int) -> DataFrame:
    """The `keep` columns of texts, list_id, and for each of the text columns the first word of the list that it contains (or null).

    A row per text and list of its policy with a word in some column; see `matched`."""
    return matched(texts, policies, columns, keep, policies.schema["words"].dataType.elementType, lambda words, places: words[min(places)], **sizes)


def all_places(texts: DataFrame, policies: DataFrame, columns: list[str], keep: list[str], **sizes: int) -> DataFrame:
    """As `first_words`, with the places (from 0, in order) of all words of the list that a text contains."""
    return matched(texts, policies, columns, keep, ArrayType(IntegerType()), lambda words, places: sorted(places), **sizes)


def matched(texts: DataFrame, policies: DataFrame, columns: list[str], keep: list[str], kind: DataType, of: Callable[[list, list], object], *, sent: int = SENT, split: int = SPLIT) -> DataFrame:
    """The `keep` columns of texts, list_id, and for each of the text columns `of(words, places)`, where the list's words at these places are in it (or null).

    `texts` (scenario_id, `keep`, `columns`); `policies` (scenario_id, list_id, words: an array in order of declaration). Null words and texts are never found,
    the empty word in every text; a list_id that a policy repeats counts for each of its rows. Short word lists are sent to all tasks and texts stay where
    they are. Longer ones are sorted to the head of their policy's texts, which are split over tasks by their number; a task holds one automaton at a time.
    """
    lists = policies.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("list_id", "words"))).alias("lists"))
    rows = texts.where("scenario_id is not null").select("scenario_id", *keep, *columns)
    names = [f"_word{i}" for i in range(len(columns))]
    schema = rows.select(*keep).schema
    for name, type_ in [("list_id", policies.schema["list_id"].dataType), *((n, kind) for n in names)]:
        schema = schema.add(name, type_)
    out = to_arrow_schema(schema)
    own = len(keep)

    def found(batch: pa.RecordBatch, at: list[int], lists_of: list) -> pa.RecordBatch:
        """`at`: the rows that are texts; `lists_of`: the word lists and automaton of each."""
        said = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        source, more = [], []
        for i, known in zip(at, lists_of):
            if known is None:
                continue
            lists, automaton = known
            each = [automaton.found(c[i]) for c in said]
            for k in sorted(set().union(*each)):
                source.append(i)
                more.append((lists[k]["list_id"], *(of(lists[k]["words"], f[k]) if k in f else None for f in each)))
        taken = batch.take(pa.array(source, pa.int64()))
        kept = [taken.column(taken.schema.get_field_index(c)).cast(out.field(j).type) for j, c in enumerate(keep)]
        added = list(zip(*more)) if more else [()] * (1 + len(columns))
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), out.field(own + j).type) for j, c in enumerate(added))], schema=out)

    size = policies.agg(F.sum(F.expr("aggregate(words, 0L, (n, w) -> n + 16 + coalesce(length(w), 0))")), F.count("*")).first()
    if (size[0] or 0) + 16 * size[1] <= sent:
        table = texts.sparkSession.sparkContext.broadcast({r.scenario_id: [x.asDict() for x in r.lists] for r in lists.toLocalIterator()})

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = functools.lru_cache(KEPT)(Lists)  # policies with the same words share one
            known = functools.lru_cache(1024)(lambda s: (p, automaton(tuple(tuple(x["words"] or ()) for x in p))) if (p := table.value.get(s)) else None)
            for batch in batches:
                policy = batch.column(0).to_pylist()
                yield found(batch, range(batch.num_rows), [known(s) for s in policy])

        return rows.mapInArrow(here, schema).withColumnsRenamed(dict(zip(names, columns)))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            policy, heads = batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("_lists"))
            at, own_of, head = [], [], heads.is_valid().to_pylist()
            for i, scenario in enumerate(policy):
                if head[i]:
                    p = heads[i].as_py()
                    now, known = scenario, (p, Lists(tuple(tuple(x["words"] or ()) for x in p)))
                else:
                    at.append(i)
                    own_of.append(known if scenario == now else None)
            yield found(batch, at, own_of)

    parts = rows.groupBy("scenario_id").agg(F.ceil(F.count("*") / split).cast("int").alias("parts"))
    heads = lists.join(parts, "scenario_id").select("scenario_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), F.lit(0).alias("_turn"), F.col("lists").alias("_lists"))
    split_rows = rows.join(parts, "scenario_id").withColumns({"_part": F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int"), "_turn": F.lit(1)}).drop("parts")
    both = split_rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("scenario_id", "_part").sortWithinPartitions("scenario_id", "_part", "_turn").mapInArrow(along, schema).withColumnsRenamed(dict(zip(names, columns)))
