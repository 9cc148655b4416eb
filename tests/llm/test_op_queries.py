"""Every registered query of the subpackage, column by column, against the given tables."""

import base64
import hashlib
import html
import re
import zlib

import duckdb
import public_tokenizers
import pytest

import __spark_entry__
from colloquy.llm import queries


@pytest.fixture(scope="module")
def run(spark, small):
    made = {}

    def rows(name):
        if name not in made:
            df = __spark_entry__.queries()[name](spark, small)
            made[name] = df.dtypes, df.collect()
        return made[name]

    return rows


@pytest.fixture(scope="module")
def texts(spark, small):
    return {d.doc_id: d.text or "" for d in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark, small):
    return {p.page_id: p for p in spark.read.parquet(f"{small}/pages.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, run, small):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    kinds, rows = run(name)
    assert sorted(names) == sorted(n for n, _ in kinds)
    assert sorted(str([r[n] for n in names]) for r in rows) == sorted(str(list(r)) for r in cursor.fetchall())


def has(kinds, **wanted):
    assert {k: v for k, v in kinds if k in wanted} == wanted


def test_op1(run, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    kinds, rows = run("op1_sentencepiece")
    assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode(t) for i, t in texts.items()}
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.round_trip) == (len(t.encode()), len(r.ids), library.decode(list(r.ids)) == t) and r.text_sha256 == hashlib.sha256(library.decode(list(r.ids)).encode()).hexdigest()


def test_op2(run, texts, spark, small):
    kinds, rows = run("op2_decontamination")
    has(kinds, doc_id="bigint", item_id="bigint", kind="string")
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(i, b.item_id) for i, t in texts.items() for b in items if b.text in t} != set()


def test_op3(run, texts):
    kinds, rows = run("op3_simhash")
    has(kinds, doc_id="bigint", fingerprint="string", component_id="bigint")
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert fp.keys() == texts.keys() and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    near = {a: min(b for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3) for a in fp}
    assert all(r.component_id <= near[r.doc_id] for r in rows) and all(r.component_id == r.doc_id for r in rows if sum((fp[r.doc_id] ^ x).bit_count() <= 3 for x in fp.values()) == 1)


def test_op4(run, texts):
    kinds, rows = run("op4_media")
    has(kinds, doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    same = {}
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and same.setdefault(raw, r[5:]) == r[5:]


def test_op6(run, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_MODEL))
    kinds, rows = run("op6_token_counts")
    has(kinds, doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean", prefix_counts="binary")
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(texts[i].encode()), n, n > 1024) for i, n in want.items()}


def test_op7(run, texts):
    kinds, rows = run("op7_toxicity")
    has(kinds, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert {r.doc_id for r in rows} == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op8(run, pages):
    kinds, rows = run("op8_warc")
    has(kinds, page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint")
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows} == {i: (len(p.html.encode()), base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode()) for i, p in pages.items()}


def test_op9(run, pages):
    kinds, rows = run("op9_main_text")
    has(kinds, page_id="bigint", url="string", text="string", n_chars="bigint")
    assert {r.page_id: r.url for r in rows} == {i: p.url for i, p in pages.items()} and all(r.n_chars == len(r.text) > 0 for r in rows)
    inner = {i: re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1].replace("<br>", " ") for i, p in pages.items()}
    blocks = {i: [" ".join(html.unescape(re.sub(r"<[^<>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", x)] for i, x in inner.items()}
    assert {r.page_id: r.text for r in rows} == {i: "\n\n".join(filter(None, b)) for i, b in blocks.items()}


def test_op10(run, texts):
    from test_training_text import bytes_by_force

    kinds, rows = run("op10_byte_dedup")
    has(kinds, doc_id="bigint", n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept_sha256="string")
    want = bytes_by_force(list(texts.items()), 400)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in want.items()}


def test_pipeline_edges(spark, tmp_path):
    """Null, empty and repeated rows, further columns, and empty tables."""
    rows = [(1, None, "x"), (2, "", "x"), (3, "one word", "x"), (3, "one word", "x"), (4, "é ü " * 3000, "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("doc_id", "text", "key AS lang", "key AS source", "length(text) AS n_chars", "key AS found", "1 AS own")
    labels = spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, "not in any text of these")], "item_id long, text string")
    for name, full in (("full", True), ("none", False)):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            (df if full else df.limit(0)).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    got = __spark_entry__.queries()["pipeline"](spark, f"{tmp_path}/full").collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, 3, 4, None] and all(r.round_trip for r in got)
    assert __spark_entry__.queries()["pipeline"](spark, f"{tmp_path}/none").count() == 0


def test_pages_with_clashing_columns_and_long_ones(spark):
    """Rows of pages with columns named like the operators' own, and a page of several megabytes."""
    from colloquy.llm import html_text, warc

    long_ = "<article><p>" + "word " * 800_000 + "</p></article>"
    rows = [(1, "u", long_, "x", 5), (2, "u", long_, "y", 6), (3, None, "", "z", 7), (3, None, "", "z", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, size int").withColumnsRenamed({"size": "sha1"})
    read = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted((r.record_id, r.payload_bytes, r.record_type, r.refers_to) for r in read) == [("1", len(long_), "revisit", "2"), ("2", len(long_), "response", None), ("3", 0, "response", None), ("3", 0, "response", None)]
    assert sorted(r.n_chars for r in html_text.extract(pages).collect()) == [0, 0, 3_999_999, 3_999_999]


def test_pages_without_ids(spark, tmp_path):
    """The query itself over null ids, urls and pages; and over no pages."""
    rows = [(1, "u", "<p>a"), (7, None, "<p>a"), (None, "u", "<p>a"), (None, "v", "b"), (None, None, None), (2, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/full/pages.parquet")
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    got = __spark_entry__.queries()["op8_warc"](spark, f"{tmp_path}/full").collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == [("1", 4, "revisit", 7), ("2", 0, "response", None), ("7", 4, "response", None), ("None", 0, "revisit", 2), ("None", 1, "response", None), ("None", 4, "revisit", 7)]
    assert __spark_entry__.queries()["op8_warc"](spark, f"{tmp_path}/none").count() == 0


def test_member_that_inflates_without_bound():
    """A small member of gigabytes is refused by the length that its record states, after little more than that."""
    from colloquy.llm import warc

    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    zeros = bytes(1 << 20)
    bomb = packer.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n") + b"".join(packer.compress(zeros) for _ in range(300)) + packer.flush()
    for bad in (bomb, (p := zlib.compressobj(9, zlib.DEFLATED, 31)).compress(zeros * 3) + p.flush()):
        taken = 0

        def chunks(data=bad):
            nonlocal taken
            for i in range(0, len(data), 512):
                taken += 1
                yield data[i : i + 512]

        with pytest.raises(warc.WarcError):
            list(warc.records(chunks()))
        assert taken <= 8
