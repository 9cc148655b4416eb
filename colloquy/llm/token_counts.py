"""Token counts by prefix dynamic programming.

For every prefix of a text the exact number of tokens of that prefix is known, so counts, truncation and budget
questions are answered from the table and need no second encoding. The vocabulary is a byte-level BPE file of the `tokenizers`
library; the file's path is a parameter.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
import zstandard
from pyspark.sql import DataFrame

from colloquy.llm.arrow import map_columns
from colloquy.llm.bpe import Memo, Pieces

#: Fixed values of the format: how the byte-level pre-tokeniser splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Endings of which a proper prefix splits in another way.
LONG_ENDINGS = ("'re", "'ve", "'ll")
#: Bytes of text that are split at a time.
SLICE = 4 << 20
#: Words whose tables each generation of a worker's memo keeps.
WORDS = 250_000
#: Before a cluster of the split (white space that it cuts, with the word after it) in the memo. No word has white space after it.
CLUSTER = "\0"
BLANK, BLANKS = regex.compile(r"\s"), regex.compile(r"\s\s")


def checked(spec: dict) -> dict:
    """Raises for a vocabulary file that isn't of the kind that is read here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for k in ("normalizer",) if spec.get(k)]
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", ()) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if wrong:
        raise ValueError(f"this vocabulary file isn't supported, because of its {', '.join(wrong)}")
    return spec


def byte_letters() -> dict[str, str]:
    """The format's letter of each byte, mapped back to the byte as a Latin-1 character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): chr(b) for b in printable} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables of texts under one vocabulary file.

    A table is kept as steps: by how much each byte changes the number of tokens of the prefix that ends with it. The steps of a text
    are those of its words in a row. White space that the split cuts is one word as long as nothing follows it, so it has common
    steps with the word that follows.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        back = str.maketrans(byte_letters())
        vocabulary = {k.translate(back) for k in spec["model"]["vocab"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(a.translate(back), b.translate(back)): i for i, (a, b) in enumerate(pairs)}
        self.pieces = Pieces(vocabulary, lambda a, b: ranks.get((a, b)))
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.around = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.known = Memo(lambda word: self.learn([word])[word], WORDS)

    def learn(self, keys: list[str]) -> dict[str, bytes]:
        """Steps of words and clusters, worked out together and in order."""
        parts = {k: self.split.findall(k[1:]) if k[:1] == CLUSTER and BLANK.match(k[1:2]) else [k] for k in keys}
        words = {w for own in parts.values() for w in own} | {"".join(own[:-1]) + own[-1][:1] * bool(BLANK.match(own[-1])) for own in parts.values() if len(own) > 1}
        order = sorted((w.encode("utf-8", "surrogatepass").decode("latin-1"), w) for w in words)
        counts = {w: own[:] for (_, w), (_, own) in zip(order, self.pieces.walk([u for u, _ in order]))}
        counts |= {w: [0, 1, 2, 1] for w in words.intersection(LONG_ENDINGS)}
        made = {}
        for k, own in parts.items():
            table = counts[own[-1]]
            if len(own) > 1:
                blank = counts["".join(own[:-1]) + own[-1][:1] * bool(BLANK.match(own[-1]))]
                before, start = sum(counts[w][-1] for w in own[:-1]), sum(len(counts[w]) - 1 for w in own[:-1])
                table = blank + [before + n for n in table[len(blank) - start :]]
            made[k] = np.diff(np.array(table)).astype(np.int8).tobytes()
        return made

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special tokens in turns; the first and last are ordinary."""
        if self.around is None or not any(s in text for s in self.special):
            return [text]
        at, out = 0, []
        for m in self.around.finditer(text):
            out += [text[at : m.start()], m[0]]
            at = m.end()
        return [*out, text[at:]]

    def keys(self, part: str) -> list[str]:
        """Words and clusters of ordinary text."""
        words = self.split.findall(part)
        if not BLANKS.search(part):
            return words
        out, open_ = [], ""
        for w, after in zip(words, [*words[1:], ""]):
            if open_ or (BLANK.match(w) and w.isspace() and BLANK.match(after)):
                open_ += w
                if not w.isspace():
                    out.append(CLUSTER + open_)
                    open_ = ""
            else:
                out.append(w)
        return out + [open_] * bool(open_)

    def steps_of(self, texts: list[str]) -> list[bytes]:
        """Steps of whole texts. Words that the memo doesn't have are worked out together, in order."""
        split = []
        for text in texts:
            parts = self.parts(text)
            # a special token is ordinary text until it is complete
            split.append([self.keys(p) for p in parts] if len(parts) == 1 else [self.keys(p if i % 2 == 0 else parts[i - 1] + p[:-1]) for i, p in enumerate(parts)] + [parts])
        known, new = self.known.found({k for own in split for keys in (own if len(own) == 1 else own[:-1]) for k in keys})
        fresh = self.learn(new)
        self.known.take(fresh)
        known |= fresh
        get = known.__getitem__
        return [b"".join(map(get, own[0])) if len(own) == 1 else self.with_specials(own[-1], [b"".join(map(get, keys)) for keys in own[:-1]]) for own in split]

    def with_specials(self, parts: list[str], steps: list[bytes]) -> bytes:
        """Steps of a text whose odd parts are special tokens; of those, `steps` has the ordinary text with them but their last letter."""
        out = [steps[0]]
        for i in range(1, len(parts), 2):
            plain, whole, last = steps[i - 1], counted(steps[i]), len(parts[i][-1].encode())
            now = total(plain)
            ends = [now, *whole[len(plain) + 1 :].tolist(), *[now + 1] * last]
            out += [np.diff(np.array(ends)).astype(np.int8).tobytes(), steps[i + 1]]
        return b"".join(out)

    def table(self, text: str) -> np.ndarray:
        """Number of tokens of every prefix, by its length in bytes; inside a character, of its bytes."""
        return counted(self.steps_of([text])[0])

    def totals(self, texts: list[str]) -> list[int]:
        return [total(s) for s in self.steps_of(texts)]

    def fit(self, text: str, budget: int) -> int:
        return fitting(self.steps_of([text])[0], text.encode("utf-8", "surrogatepass"), budget)


def counted(steps: bytes) -> np.ndarray:
    """The table that steps stand for: entry n is the number of tokens of the first n bytes."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)))


def total(steps: bytes) -> int:
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


def fitting(steps: bytes, raw: bytes, budget: int) -> int:
    """Bytes of the longest prefix of whole characters such that neither it nor any shorter one has more tokens than the budget."""
    over = counted(steps) > budget
    if not over.any():
        return len(raw)
    at = max(0, int(over.argmax()) - 1)
    while at and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack(steps: bytes) -> bytes:
    return zstandard.compress(steps, 1)


def unpack(table: bytes) -> list[int]:
    """The counts that a stored table holds: entry n is the count of the first n bytes."""
    return counted(zstandard.decompress(table)).tolist()


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", budget: int = 1024, tables: bool = True) -> DataFrame:
    """Exact token counts of whole texts, from the tables of their prefixes.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget), fit_bytes (bytes of the longest prefix that fits the budget, as all
    shorter ones do) and, with `tables`, prefix_counts, the packed count of every prefix (`unpack`; `counts_at` answers from
    it). A null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows and null ids
    each give their own row; an empty table gives none.
    """

    def run(ids, texts):
        c = counter(path)
        texts = [t or "" for t in texts]
        steps = c.steps_of(texts)
        totals = [total(s) for s in steps]
        made = {"doc_id": ids, "n_bytes": [len(s) for s in steps], "n_tokens": totals, "over_limit": [n > budget for n in totals]}
        made["fit_bytes"] = [fitting(s, t.encode("utf-8", "surrogatepass"), budget) if n > budget else len(s) for t, n, s in zip(texts, totals, steps)]
        if tables:
            made["prefix_counts"] = [pack(s) for s in steps]
        return made

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long" + ", prefix_counts binary" * tables
    return map_columns(docs, {"doc_id": id_col, "text": text_col}, run, schema, SLICE)


def counts_at(stored: DataFrame, *, at_col: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens of the first `at_col` bytes, from stored tables (prefix_counts); null beyond the text and for nulls. An empty table gives no rows."""

    def run(ids, tables, places):
        made = [None if t is None else unpack(t) for t in tables]
        return {"doc_id": ids, "n_tokens": [None if m is None or a is None or not 0 <= a < len(m) else m[a] for m, a in zip(made, places)]}

    kind = stored.schema[id_col].dataType.simpleString()
    return map_columns(stored, {"doc_id": id_col, "table": "prefix_counts", "at": at_col}, run, f"doc_id {kind}, n_tokens long", SLICE)
