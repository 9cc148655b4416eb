"""SentencePiece encoding and decoding by a streaming path search.

The model file's path is a parameter; its pieces, their order and its settings are read from it. Encoding follows
the model's own rules (a space before the text, spaces as U+2581, bytes for unknown characters) and finds the
pieces of every segment with `bpe.Search`, whose window is bounded by the longest piece and which commits pieces where all
surviving paths meet. A memo of short segments stands in front of it.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from colloquy.llm.arrow import map_columns
from colloquy.llm.bpe import Memo, Pieces, Search

#: Fixed value of the format: the visible space.
SPACE = "▁"
LETTER = regex.compile(r"[\p{L}\p{M}]")
#: Bytes of text that are split at a time.
SLICE = 4 << 20
#: Segments whose ids each generation of a worker's memo keeps.
SEGMENTS = 250_000
#: Fixed values of the model format: places of fields, the kind of model, and what is asked of its normaliser.
TRAINER, NORMALIZER, MODEL_TYPE, BPE = 2, 3, 3, 2
CHARSMAP, SETTINGS = 2, {3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}


def fields(message: bytes) -> dict[int, int | bytes]:
    """Fields of a protocol buffer message; of repeated ones the last."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            out[key >> 3] = message[at : at + size]
            at += size
    return out


def checked(model: bytes) -> None:
    """Raises for a model that isn't of the kind that is read here."""
    spec = fields(model)
    if fields(spec[TRAINER]).get(MODEL_TYPE, 1) != BPE:
        raise ValueError("only byte-pair models are read")
    own = fields(spec.get(NORMALIZER, b""))
    wrong = [name for i, name in SETTINGS.items() if bool(own.get(i, 1)) != (name != "remove_extra_whitespaces")]
    if own.get(CHARSMAP) or wrong:
        raise ValueError(f"this model's normaliser isn't supported: {', '.join(wrong) or 'it maps characters'}")


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        checked(model.serialized_model_proto())
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.bytes = {int(self.names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.values = {v: k for k, v in self.bytes.items()}
        self.unknown = model.unk_id()
        order = {self.names[i]: n for n, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        known = {c for name in self.ids for c in name}
        self.pieces = Pieces(self.ids.keys() | known, lambda a, b: order.get(a + b))
        self.known = frozenset(known)
        # Pieces never cross the end of a word or an unknown character. Where the model has no piece
        # with both letters and other characters, runs of each are segments of their own, so that a word and the
        # same word with a comma are looked up once.
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("a piece of this model has a space inside")
        apart = not any(a != SPACE and (LETTER.match(a) is None) != (LETTER.match(b) is None) for a, b in self.pieces.joints)
        self.segments = regex.compile(f"{SPACE}*(?:{LETTER.pattern}+|[^{SPACE}\\p{{L}}\\p{{M}}]+)|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.short = Memo(self.segment, SEGMENTS)

    def spelled(self, run: str) -> list[int]:
        """Byte ids of characters that are no pieces."""
        return [self.bytes[b] for b in run.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def runs(self, segment: str) -> list[str]:
        """Parts of a segment that no piece joins: unknown characters one by one, and what stands between them."""
        if self.known.issuperset(segment):
            return [segment]
        out, run = [], ""
        for c in [*segment, ""]:
            if c and c in self.known:
                run += c
                continue
            if run:
                out.append(run)
            out += [c] if c else []
            run = ""
        return out

    def segment(self, text: str) -> bytes:
        return self.learn([text])[text]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Packed ids of segments of any length, one streaming search over all of them in order."""
        ids, made, search = self.ids, {}, Search(self.pieces)
        mixed = {s: self.runs(s) for s in new if not self.known.issuperset(s)}
        for run in sorted({*(s for s in new if s not in mixed), *(r for rs in mixed.values() for r in rs)}):
            if run in ids:
                found = [ids[run]]
            elif len(run) == 1:
                found = self.spelled(run)
            else:
                found = []
                for piece in search.pieces(run):
                    if piece in ids:
                        found.append(ids[piece])
                    else:
                        found += self.spelled(piece)
            made[run] = array("i", found).tobytes()
        out = {s: made[s] for s in new if s not in mixed}
        return out | {s: b"".join([made[r] for r in rs]) for s, rs in mixed.items()}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids (32 bits each) of each text; segments that the memo doesn't have are searched together."""
        cut = self.segments.findall
        parts = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, new = self.short.found(set().union(*parts))
        fresh = self.learn(new)
        self.short.take(fresh)
        known |= fresh
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_all([text])[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: runs of byte pieces become characters, one space at the start goes."""
        out, raw, names, values = [], bytearray(), self.names, self.values
        for i in ids:
            if i in values:
                raw.append(values[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(names[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of whole texts, and whether they decode to the text again.

    Returns doc_id, n_bytes, n_tokens, ids array<int>, text_sha256 (of the text that the ids decode to) and
    round_trip. A null or empty text has no ids. U+2581 in a text is a space to the format, so only texts
    without it round-trip. Rows are independent; an empty table gives an empty result.
    """

    def run(keys, texts):
        c = codec(path)
        texts = [t or "" for t in texts]
        packed = c.encode_all(texts)
        back = [c.decode(array("i", p).tolist()) for p in packed]
        sizes = [len(p) // 4 for p in packed]
        ids = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return {
            "doc_id": keys, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": sizes, "ids": ids,
            "text_sha256": [sha(t) for t in back], "round_trip": [a == b for a, b in zip(texts, back)],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, {"doc_id": id_col, "text": text_col}, run, f"doc_id {kind}, n_bytes long, n_tokens long, ids array<int>, text_sha256 string, round_trip boolean", SLICE)


def decode_pieces(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of encoded rows; null ids give an empty text, an empty table no rows."""

    def run(keys, ids):
        c = codec(path)
        return {"doc_id": keys, "text": [c.decode(i or []) for i in ids]}

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_columns(encoded, {"doc_id": id_col, "ids": ids_col}, run, f"doc_id {kind}, text string")
