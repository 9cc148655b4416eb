"""Operators of the subpackage against libraries, brute force and round trips."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.llm import byte_index, decontaminate, html_text, ogg, simhash, toxicity, warc, word_windows
from colloquy.llm.bpe import Search
from colloquy.llm.components import components
from colloquy.llm.piece_codec import PieceCodec, decode_pieces, encode_pieces
from colloquy.llm.shared import written
from colloquy.llm.token_counts import PrefixCounter, counts_at, token_counts, unpack

ODD = ["", " ", "  a", "a  ", "a <|endoftext|> b's they're  'r x\n\n\n y \t z", "aaaaaaaaaaaaaaa" * 50, "日本語のテキスト😀😀 é" + "́", "x" * 3000, "don't we've   hi   ", "0123 4567890 123,456", "\x00 a", "ab" * 700, " " * 300, "a \x00 b\x00  c", "\n\nb\n\n 'll  're", "a  <|endoftext|>  <|endoftext|>b\t\tc", " \x1c\x1d a \x1f"]
EDGES = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "word two"), (4, "é ü " * 2000)]


def texts(spark, small, n=60):
    return [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(n).collect()]


def edges(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with clashing names."""
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in EDGES], "doc_id long, text string, id string, key int, found string")


def empty(spark):
    return edges(spark).limit(0)


def test_token_counts_as_the_library(spark, small):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), PrefixCounter(path)
    sample = ODD + texts(spark, small)
    assert own.totals(sample) == [len(e.ids) for e in library.encode_batch(sample, add_special_tokens=False)]
    for t in [x[:300] for x in sample if len(x) < 700 or x in ODD[-7:]] + [x[:200] for x in sample[-20:]]:
        table = own.table(t)
        assert len(table) == len(t.encode()) + 1
        for k in range(len(t) + 1):
            assert table[len(t[:k].encode())] == len(library.encode(t[:k], add_special_tokens=False).ids), (t[:k],)
        cut = own.fit(t, 7)
        assert len(library.encode(t.encode()[:cut].decode(), add_special_tokens=False).ids) <= 7 or cut == len(t.encode())


def test_token_count_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts(edges(spark), path, tables=True).collect()
    assert len(rows) == len(EDGES) and all(unpack(r.prefix_counts)[-1] == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0} and token_counts(empty(spark), path).count() == 0


def test_questions_to_stored_tables(spark, small):
    """Counts of prefixes and cuts by budget come from the stored table alone."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    stored = written(token_counts(docs, path, budget=40).withColumn("at", F.lit(50)), "tables")
    text = {d.doc_id: d.text or "" for d in docs.collect()}
    for r in counts_at(stored, at_col="at").collect():
        raw = text[r.doc_id].encode()
        if len(raw) < 50:
            assert r.n_tokens is None
        elif len(raw[:50].decode("utf-8", "ignore").encode()) == 50:
            assert r.n_tokens == n(raw[:50].decode())
    for r in stored.collect():
        t, cut = text[r.doc_id], text[r.doc_id].encode()[: r.fit_bytes].decode()
        assert r.over_limit == (n(t) > 40) and n(cut) <= 40 and (not r.over_limit or n(t[: len(cut) + 1]) > 40 or len(cut) == len(t))


def test_other_kinds_of_files_are_refused(tmp_path):
    from colloquy.llm import piece_codec

    with pytest.raises(ValueError, match="pre_tokenizer"):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    varint = lambda i, v: bytes([i << 3, v])
    part = lambda i, b: bytes([i << 3 | 2, len(b)]) + b
    good = part(2, varint(3, 2)) + part(3, varint(3, 1) + varint(4, 0) + varint(5, 1))
    piece_codec.checked(good)
    for bad in (part(2, varint(3, 1)) + good[4:], part(2, varint(3, 2)) + part(3, varint(3, 0) + varint(4, 0)), part(2, varint(3, 2)) + part(3, part(2, b"xy") + varint(4, 0))):
        with pytest.raises(ValueError):
            piece_codec.checked(bad)


def test_pieces_as_the_library(spark, small):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceCodec(path)
    sample = ODD + ["▁ ▁▁a"] + texts(spark, small)
    assert [own.encode(t) for t in sample] == library.encode(sample)
    assert all(own.decode(own.encode(t)) == t for t in sample if "▁" not in t)
    assert [own.decode(i) for i in library.encode(sample)] == [library.decode(i) for i in library.encode(sample)]


def test_streaming_commits_the_same_pieces():
    own = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    for _ in range(20):
        run = "".join(r.choice("thesanreo") for _ in range(500))
        assert list(own.pieces.stream(run)) == own.pieces.merged(run)


def test_the_window_is_bounded():
    """The search holds no more back pointers than two windows, however long the text; pieces come out before its end."""
    own = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    search, held, first = Search(own.pieces), 0, None
    for piece in search.pieces("▁" + "thesanreo" * 5000):
        held = max(held, len(search.last))
        first = first or (piece, search.done)
    assert held <= 2 * own.pieces.longest + 1 and first[1] <= 2 * own.pieces.longest


def test_piece_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_pieces(edges(spark), path)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows.collect()) and encode_pieces(empty(spark), path).count() == 0
    assert sorted(r.text for r in decode_pieces(rows, path).collect()) == sorted(t or "" for _, t in EDGES)


def connected(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("batch,crowd", [(10000, 4096), (7, 5)])
def test_simhash_links(spark, batch, crowd):
    r = np.random.default_rng(0)
    fps = set()
    for base in r.integers(-(2**63), 2**63 - 1, 25):
        for _ in range(40):
            x = int(base) & (2**64 - 1)
            for k in r.integers(0, 64, r.integers(0, 5)):
                x ^= 1 << int(k)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = [(e.a, e.b) for e in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd=crowd).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a = np.array(fps).view(np.uint64)
    pairs = [(fps[i], fps[j]) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3))]
    assert connected(fps, found) == connected(fps, pairs)


def test_simhash_rows(spark, small):
    import xxhash

    rows = simhash.simhash_groups(spark.read.parquet(f"{small}/documents.parquet")).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fp = {}
    for i, t in docs.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]).encode(), 42) for k in range(max(1, len(ws) - 2))] if ws else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fp
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in rows} == connected(fp, pairs)
    odd = simhash.simhash_groups(edges(spark)).collect()
    assert len(odd) == len(EDGES) and {r.component_id for r in odd if r.doc_id in (1, 2)} == {1} and simhash.simhash_groups(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg():
    for n in (0, 1, 300):
        x = os.urandom(n)
        assert ogg.checksum(x) == slow_crc(x)
    for n in (0, 1, 575, 576, 577, 48960, 48961, 300001):
        size, media = ogg.stored("x" * n)
        payload, n2, times = ogg.loaded(media)
        assert size == n2 == n and payload == b"x" * n + b"\xff" * (len(payload) - n) and len(payload) % 576 == 0 and times == sorted(times)
    w = ogg.Writer(7)
    big = [os.urandom(k) for k in (100000, 255, 0, 65025, 130050, 3)]
    out = []
    for i, b in enumerate(big):
        out += w.packet(b, i)
    out.append(w.flush(ogg.LAST))
    assert ogg.read_streams(b"".join(out))[7].packets == big
    serials = [int.from_bytes(media[at + 14 : at + 18], "little") for at in (m.start() for m in re.finditer(b"OggS\\0", media))]
    assert sum(a != b for a, b in zip(serials, serials[1:])) >= 4  # the pages of two streams in turns
    broken = bytearray(media)
    broken[-5] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read_streams(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.read_streams(media[:-1])


def test_media_rows(spark):
    rows = ogg.read_media(ogg.write_media(edges(spark)), keep_payload=True).collect()
    assert len(rows) == len(EDGES) and ogg.read_media(ogg.write_media(empty(spark))).count() == 0
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and r.tail_crc32 == zlib.crc32(r.payload[-32:]) and r.payload_bytes % 576 == 0


def windows_by_force(rows, k=20):
    first = {}
    for i, t in sorted(rows):
        ws = (t or "").encode().split()
        for a in range(len(ws) - k + 1):
            first.setdefault(tuple(ws[a : a + k]), (i, a))
    out = {}
    for i, t in rows:
        ws, gone = (t or "").encode().split(), set()
        for a in range(len(ws) - k + 1):
            if first[tuple(ws[a : a + k])] != (i, a):
                gone |= set(range(a, a + k))
        out[i] = (len(ws), len(gone), b" ".join(w for n, w in enumerate(ws) if n not in gone).decode())
    return out


def made_up(r, letters, sep, n):
    base, rows = [r.choice(letters) for _ in range(n)], []
    noise = lambda: [r.choice(letters) for _ in range(r.randrange(n // 3))]
    for i in range(60):
        a = r.randrange(n // 2)
        rows.append((i, sep.join(noise() + base[a : a + r.randrange(n // 8, n)] + noise() if r.random() < 0.6 else ["x"] * r.randrange(n))))
    return [*rows, (100, None), (101, ""), (102, "é ü b")]


def test_word_windows(spark, small):
    for seed in range(2):
        rows = made_up(random.Random(seed), [f"w{x}" for x in range(6)], "\n ", 80)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in word_windows.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert got == windows_by_force(rows)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = windows_by_force([(d.doc_id, d.text) for d in docs.collect()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in word_windows.dedup_windows(docs).collect()} == want
    kept = {r.doc_id: r.text for r in word_windows.remove_windows(docs).collect()}
    assert all(kept[i] == w[2] for i, w in want.items() if w[1])


def with_a_line(r, n=60, length=18):
    """Texts that all hold the same line with other words around it, and copies of a few of them."""
    line = " ".join(f"l{k}" for k in range(length))
    rows = [(i, " ".join([*(f"w{r.randrange(400)}" for _ in range(r.randrange(5, 60))), line, *(f"w{r.randrange(400)}" for _ in range(r.randrange(5, 60)))])) for i in range(n)]
    return rows + [(n + i, rows[i][1] + " end") for i in range(6)]


@pytest.mark.parametrize("hot", [0.0, 4.0])
def test_a_line_that_all_share(spark, hot):
    """Minimisers that all documents have are dealt apart; the results stay those of brute force."""
    rows = with_a_line(random.Random(9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = word_windows.dedup_windows(docs, hot=hot)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got.collect()} == windows_by_force(rows)
    for window in (60, 120):
        got = byte_index.dedup_bytes(docs, window=window, gram=8, wide=window // 2, hot=hot, index_bytes=2000)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == bytes_by_force(rows, window)


def test_hot_keys(spark):
    from colloquy.llm import buckets

    rows = with_a_line(random.Random(2), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = buckets.text_bytes(docs, "text")
    assert size == sum(len(t.encode()) for _, t in rows) and buckets.bucket_count(100 << 30, 3.2) > buckets.bucket_count(1 << 30, 3.2) >= buckets.LEAST
    keys_of = lambda texts: word_windows.window_keys(texts, 20, 5)
    every = collections.Counter(keys_of([t for _, t in rows]).tolist())
    found = buckets.hot_keys(docs, keys_of, id_col="doc_id", text_col="text", size=size, buckets=200).tolist()
    share = 4 / 200 * sum(every.values())
    assert found and {k for k, n in every.items() if n >= share} <= set(found) <= {k for k, n in every.items() if n >= 0.7 * share}


def test_word_window_edges(spark):
    rows = word_windows.dedup_windows(edges(spark)).collect()
    assert len(rows) == len(EDGES) and {r.n_removed for r in rows if r.doc_id != 4} == {0}
    assert [r.kept for r in rows if r.doc_id == 4] == [windows_by_force(EDGES[-1:])[4][2]]
    assert word_windows.dedup_windows(empty(spark)).count() == 0 and word_windows.remove_windows(edges(spark)).columns == edges(spark).columns


def bytes_by_force(rows, k):
    places = collections.defaultdict(set)
    for i, t in rows:
        raw = (t or "").encode()
        for a in range(len(raw) - k + 1):
            places[raw[a : a + k]].add((i, a))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - k + 1):
            if len(places[raw[a : a + k]]) > 1:
                gone[a : a + k] = b"\1" * k
        out[i] = (len(raw), gone.count(1), len([x for x in bytes(gone).split(b"\0") if x]), bytes(c for c, m in zip(raw, gone) if not m))
    return out


def test_run_index():
    r = random.Random(5)
    for _ in range(150):
        k = r.choice([3, 8, 20])
        strings = list({bytes(r.choice(b"ab") for _ in range(r.randrange(k, k * 4))) for _ in range(r.randrange(1, 6))})
        seen = collections.Counter(s[a : a + k] for s in strings for a in range(len(s) - k + 1))
        many = [r.random() < 0.2 for _ in strings]
        more = {s[a : a + k] for s, m in zip(strings, many) if m for a in range(len(s) - k + 1)}
        want = [[a for a in range(len(s) - k + 1) if seen[s[a : a + k]] > 1 or s[a : a + k] in more] for s in strings]
        assert [g.tolist() for g in byte_index.repeated_starts(strings, many, k)] == want
        assert [g.tolist() for g in byte_index.starts_of_group(strings, many, k, 1, 10)] == want


def test_match_lengths():
    """The samples of the runs give every match of a window or more its length."""
    r = random.Random(6)
    for _ in range(60):
        text = bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcd") for _ in range(r.randrange(2, 300))) * r.choice([1, 1, 2, 3])
        own = np.frombuffer(text, np.uint8)
        for window in (3, 12, 40):
            index = byte_index.RunIndex(own, window)
            best = [max((len(os.path.commonprefix([text[a:], text[b:]])) for b in range(len(text)) if b != a), default=0) for a in range(len(text))]
            assert [int(x) if x >= window else 0 for x in index.matches()] == [x if x >= window else 0 for x in best]
            assert len(index.runs) == len(index.heads) == len(index.up) <= len(text)


@pytest.mark.parametrize("window,limit", [(40, 2 << 20), (40, 300), (100, 2 << 20)])
def test_byte_strings(spark, window, limit):
    rows = made_up(random.Random(window + limit), "abcdé", "", window * 4)
    got = byte_index.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=window, gram=8, index_bytes=limit).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == bytes_by_force(rows, window)


def test_byte_strings_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in byte_index.dedup_bytes(docs).collect()}
    assert got == bytes_by_force([(d.doc_id, d.text) for d in docs.collect()], 400)
    rows = byte_index.dedup_bytes(edges(spark)).collect()
    assert len(rows) == len(EDGES) and byte_index.dedup_bytes(empty(spark)).count() == 0


def test_decontamination(spark):
    docs = spark.createDataFrame([
        (1, "Intro words here. Alice has 5 apples and gives 2 apples to Bob in the garden today, how many kilograms of apples remain? Then more text."),
        (3, "so Maria has 17 apples and gives 9 apples to Peter in the garden today, how many pounds of apples remain?"),
        (5, None), (6, ""), (7, "intro Dora has 5 apples and gives 5 apples to Dora in the garden today, how many pounds of apples remain?"), (9, "a tiny item inside"),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(0, "So Alice has 5 apples and gives 2 apples to Bob in the garden today, how many kilograms of apples remain?"), (1, "tiny item"), (2, None)], "item_id long, text string")
    met = {(r.doc_id, r.item_id): r.consistent for r in decontaminate.matches(docs, items).collect()}
    assert met == {(1, 0): True, (3, 0): True, (7, 0): False, (9, 1): True}
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 0, "copy"), (3, 0, "reworked"), (9, 1, "copy")}
    assert decontaminate.contaminated(empty(spark), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_leaks_of_documents(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    own = {d.doc_id: d.text for d in docs.collect()}
    want = {(i, b.item_id) for i, t in own.items() for b in items.collect() if b.text in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want


def test_grammar_patterns():
    g = toxicity.Grammar(toxicity.Lexicon({"moron": 5.0}))
    only = lambda t: [p for p, _ in g.clause(toxicity.WORD.findall(t))]
    assert only("you moron") == [(1, 1, 0, 0)] and only("not a moron") == [(1, 0, 1, 0)] and only("somebody said moron") == [(1, 0, 0, 1)] and only("kill") == [(2, 0, 0, 0)]
    assert g.patterns("all is well") is None and g.patterns(None) is None


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert hit > 0.98 and sum(caught) / len(caught) >= 0.9
    odd = toxicity.score(edges(spark), model).collect()
    assert len(odd) == len(EDGES) and all(0 <= r.score <= 1 for r in odd) and toxicity.score(empty(spark), model).count() == 0
    bare = toxicity.learn(docs.limit(0), labels.limit(0))
    assert bare.score(toxicity.Grammar(bare.lexicon).patterns("you moron")) > 0.5


def test_warc(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    twice = pages.unionByName(pages.limit(20).selectExpr("page_id + 100000 AS page_id", "url", "html")).unionByName(spark.createDataFrame([(-1, None, None), (-2, "a b\n", "")], "page_id long, url string, html string"))
    archives = written(warc.write_archives(twice, archive_bytes=50_000), "archives")
    rows, src = warc.read_archives(archives, payloads=True).collect(), {p.page_id: p for p in twice.collect()}
    same = collections.defaultdict(list)
    for p in src.values():
        same[p.html or ""].append(p.page_id)
    assert len(rows) == len(src) and archives.count() > 1
    for r in rows:
        raw = (src[int(r.record_id)].html or "").encode()
        top = max(same[raw.decode()])
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if int(r.record_id) == top else ("revisit", str(top)))
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    data = bytearray(warc.info("a"))
    with pytest.raises((warc.WarcError, zlib.error)):
        list(warc.records(iter([bytes(data[:-1])])))


def test_main_text(spark, small):
    import html as entities

    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^<>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(p.html) == "\n\n".join(b for b in blocks if b)
    page = """<html><body><header><p>Site</p></header><nav><a>x</a></nav><div class="cookie-notice"><p>We use cookies a lot of them really</p></div><div id="main"><h1>T &amp; x</h1>
      <p>Long text here that is content of the page and goes on for a while.<p>Second<br>line &copy; <b>bold</b> here.</div><aside>side</aside><section class="comments"><p>great post!! with a long comment
      text which is longer than the article</p></section><form>q<input></form><footer>f</footer></body></html>"""
    assert html_text.main_text(page) == "T & x\n\nLong text here that is content of the page and goes on for a while.\n\nSecond line © bold here."
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p")], "page_id long, url string, html string")
    assert len(html_text.extract(odd).collect()) == 3 and html_text.extract(odd.limit(0)).count() == 0


def test_pipeline_against_force(spark, small):
    import sentencepiece

    import corpus_pipeline

    docs, labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.learn(docs, labels)
    grammar = toxicity.Grammar(model.lexicon)
    left = {d.doc_id: d.text for d in docs.collect() if model.score(grammar.patterns(d.text)) < 0.5}
    words = {i: t.lower().split() for i, t in left.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = connected(left, [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))])
    left = {i: t for i, t in left.items() if root[i] == i}
    cut = windows_by_force(list(left.items()))
    left = {i: cut[i][2] if cut[i][1] else t for i, t in left.items()}
    benchmark = [re.sub(r"\s+", " ", b.text) for b in items.collect()]
    left = {i: t for i, t in left.items() if not any(b in re.sub(r"\s+", " ", t) for b in benchmark)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, small).collect()} == {i: library.encode(t) for i, t in left.items()}


def test_one_piece_in_many_blocks():
    """Places of a piece are held as a set: sixteen thousand blocks that all hold it take no longer than their number says."""
    import time

    window = 40
    piece = bytes(random.Random(1).randrange(97, 123) for _ in range(60))
    a, b, key, _ = next(iter(byte_index.pieces(piece, window, 8)))

    def took(n):
        blocks = [byte_index.pack([(key, 0, doc, 0, piece[a:b])]) for doc in range(n)]
        began = time.perf_counter()
        out = byte_index.count_bucket(blocks, window, 8, 1 << 20)
        return time.perf_counter() - began, out

    few, many = took(2000), took(16_000)
    assert len(many[1]) == 16_000 and {x[0] for x in many[1]} == set(range(16_000)) and many[0] < 16 * few[0] + 0.5 and many[0] < 2
