"""The operators of this subpackage over the given tables, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import html_text, toxicity, warc
from colloquy.llm.byte_index import dedup_bytes
from colloquy.llm.circulant import near_groups
from colloquy.llm.decontaminate import contaminated
from colloquy.llm.divergence import divergences
from colloquy.llm.ogg import read_media, write_media
from colloquy.llm.piece_codec import encode_pieces
from colloquy.llm.shared import written
from colloquy.llm.simhash import simhash_groups
from colloquy.llm.token_counts import token_counts
from colloquy.llm.turn_repair import Repair
from colloquy.llm.word_windows import dedup_windows

#: Paths of public vocabulary files; any file of the same format serves.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = read_media(write_media(table(spark, sf_dir, "documents")))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL), budget=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id have a score, but are neither held out nor not."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0), "warc")
    read = warc.read_archives(archives)
    ids = {c: F.col(c).cast("long") for c in ("record_id", "refers_to")}
    return read.select(ids["record_id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", ids["refers_to"].alias("refers_to"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the checksum of conversation and turn: some are lost, emptied, cut off, repeated or another's."""

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(text("role"))
    left = turns.withColumn("fate", fate).where("fate <> 0")
    return left.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    audits = Repair(damaged(turns)).audits().withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    rows = every.join(audits, every.conv_id.eqNullSafe(F.col("c")), "left").drop("c")
    return rows.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_media": op4_media,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_main_text": op9_main_text,
    "op10_byte_dedup": op10_byte_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_minhash": op12_minhash,
    "op13_source_divergence": op13_source_divergence,
}

#: Words of every text, windows of 20 in a row, and which words a window covers that also starts earlier.
OP5_SQL = r"""WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM split),
    starts AS (SELECT doc_id, i, word, count(*) OVER w AS n, string_agg(word, ' ') OVER w AS run FROM words
      WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    again AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY run, n ORDER BY doc_id, i) > 1 AS later FROM starts),
    covered AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM again),
    kept AS (SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id"""

#: Digests of whole payloads in base 32 (five bits a letter), and the largest page of each payload.
OP8_SQL = """WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    hashed AS (SELECT page_id, payload, list_aggregate(list_transform(string_split(sha1(payload), ''),
      lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), 'string_agg', '') AS bits FROM own),
    named AS (SELECT page_id, strlen(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS last, list_aggregate(list_transform(range(32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER)
        + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM hashed)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM named"""

#: The checksum that plants faults, bit by bit; then a table of costs and edits turn by turn, one row a conversation.
OP11_SQL = r"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    hit AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS fate FROM given),
    damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE fate <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
      regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM damaged),
    turns AS (SELECT *, final = '' AS is_blank, final <> '' AND again AS is_again, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS is_cut,
      pos > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong FROM placed),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again) AS duplicate, count(*) FILTER (is_cut) AS truncated,
      count(*) FILTER (wrong) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
    dp AS (SELECT conv_id, 0 AS pos, {'c': 0, 'a': '', 'r': ''} AS s0, {'c': 99999, 'a': '', 'r': ''} AS s1, {'c': 99999, 'a': '', 'r': ''} AS s2, {'c': 99999, 'a': '', 'r': ''} AS s3 FROM counts
      UNION ALL SELECT conv_id, pos + 1,
        {'c': s0.c + 3, 'a': s0.a || 'D', 'r': s0.r},
        list_min([{'c': s1.c + 3, 'a': s1.a || 'D', 'r': s1.r}, {'c': s0.c + keep_s, 'a': s0.a || 'K', 'r': s0.r || line}]),
        list_min([{'c': e2.c + 3, 'a': e2.a || 'D', 'r': e2.r}, {'c': s0.c + keep_u, 'a': s0.a || 'K', 'r': s0.r || line}, {'c': s1.c + keep_u, 'a': s1.a || 'K', 'r': s1.r || line}, {'c': e3.c + keep_u, 'a': e3.a || 'K', 'r': e3.r || line},
          {'c': s0.c + rename, 'a': s0.a || 'R', 'r': s0.r || as_user}, {'c': s1.c + rename, 'a': s1.a || 'R', 'r': s1.r || as_user}, {'c': e3.c + rename, 'a': e3.a || 'R', 'r': e3.r || as_user}]),
        list_min([{'c': e3.c + 3, 'a': e3.a || 'D', 'r': e3.r}, {'c': e2.c + keep_a, 'a': e2.a || 'K', 'r': e2.r || line}, {'c': e2.c + rename, 'a': e2.a || 'R', 'r': e2.r || as_assistant}])
      FROM (SELECT d.conv_id, d.pos, s0, s1, list_min([s2, {'c': s0.c + 2, 'a': s0.a || 'I', 'r': s0.r || E'\nuser:'}, {'c': s1.c + 2, 'a': s1.a || 'I', 'r': s1.r || E'\nuser:'}, {'c': s3.c + 2, 'a': s3.a || 'I', 'r': s3.r || E'\nuser:'}]) AS e2,
          list_min([s3, {'c': s2.c + 2, 'a': s2.a || 'I', 'r': s2.r || E'\nassistant:'}, {'c': s0.c + 4, 'a': s0.a || 'II', 'r': s0.r || E'\nuser:\nassistant:'}, {'c': s1.c + 4, 'a': s1.a || 'II', 'r': s1.r || E'\nuser:\nassistant:'}]) AS e3,
          CASE WHEN is_blank OR is_again THEN 99999 WHEN is_cut THEN 1 ELSE 0 END AS extra, extra + 2 AS rename, extra + CASE WHEN left(role, 1) = 's' THEN 0 ELSE 99999 END AS keep_s, extra + CASE WHEN left(role, 1) = 'u' THEN 0 ELSE 99999 END AS keep_u,
          extra + CASE WHEN left(role, 1) = 'a' THEN 0 ELSE 99999 END AS keep_a, chr(10) || role || ':' || text AS line, E'\nuser:' || text AS as_user, E'\nassistant:' || text AS as_assistant
        FROM dp d JOIN turns t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.pos = d.pos + 1) x),
    best AS (SELECT d.conv_id, list_min([s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I', 'r': s2.r || E'\nassistant:'}, {'c': s1.c + 4, 'a': s1.a || 'II', 'r': s1.r || E'\nuser:\nassistant:'}]) AS b
      FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.pos),
    every AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
      coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
    FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id"""

#: Two sets of that similarity share one of their rarest shingles; whole sets are compared, and links followed.
OP12_SQL = r"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM split),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
    ranked AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS r FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM items)),
    rare AS (SELECT doc_id, n, t FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
    pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total FROM rare a JOIN rare b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    links AS (SELECT a, b FROM pairs JOIN items i ON i.doc_id = a JOIN items j ON j.doc_id = b AND j.t = i.t GROUP BY a, b, total HAVING 100 * count(*) >= 80 * (total - count(*))),
    edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b),
    least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ ON a = doc_id"""

#: Every kept term in every group, whether it occurs there or not.
OP13_SQL = r"""WITH own AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    groups AS (SELECT DISTINCT lang, source FROM own),
    kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM own) GROUP BY ALL HAVING count(*) >= 3),
    said AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM own) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    sizes AS (SELECT lang, count(*) AS size FROM kept GROUP BY lang),
    grid AS (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n,
      sum(coalesce(n, 0)) OVER (PARTITION BY g.lang) AS lang_total, size
      FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang LEFT JOIN said s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
    chances AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (total + size) AS p, 1 + (1000000000 * (lang_n + 1)) // (lang_total + size) AS q FROM grid),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source AS g, y.source AS h, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM chances x JOIN chances y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
        ON v.lang = a.lang AND v.g = a.source AND v.h = b.source),
    marks AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM chances WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

#: SQL has no way to say the rest: hashes, tokens, media, learned scores, alignments, page structure and byte strings.
ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op11_turn_repair": OP11_SQL, "op12_minhash": OP12_SQL, "op13_source_divergence": OP13_SQL}
