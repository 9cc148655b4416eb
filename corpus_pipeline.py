"""A corpus pipeline of five stages; each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import toxicity
from colloquy.llm.circulant import near_groups
from colloquy.llm.decontaminate import contaminated
from colloquy.llm.piece_codec import encode_pieces
from colloquy.llm.queries import PIECE_MODEL, table
from colloquy.llm.shared import written
from colloquy.llm.simhash import DISTANCE
from colloquy.llm.word_windows import remove_windows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the document with the smallest id. Rows with a null id stay.

    SimHash with multi-index hashing links the nearly equal texts, bands of MinHash the others; either link is made only if the whole sets are as similar.
    Of the pairs at a similarity of 0.8 five in ten million share no band, of more similar ones fewer; they are lost unless their fingerprints are near."""
    others = near_groups(docs, shingle=5, percent=80, blank_alike=True, simhash=DISTANCE).where("not kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that repeated windows cover; n_chars follows the text."""
    return remove_windows(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts that are left, checked by decoding them."""
    return encode_pieces(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated windows", cut_repeats), ("benchmark leaks", drop_leaks), ("piece ids", encode)]

#: No stage but the joins can be put in SQL; tests compare a run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table of documents, one after the other.

    Null and empty texts are no insults, are near copies of each other, lose nothing and have no ids. Rows with a null id are judged for toxicity only
    and stay otherwise. Rows that repeat a row are the same document and stay or go together. Further columns are carried along. Empty tables give
    no rows; without labels the fixed word lists judge.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
