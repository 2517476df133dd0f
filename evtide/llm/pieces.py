"""SentencePiece encoding and decoding with original byte spans.

A text is normalised by the model's compiled character map: at each place the
longest entry that is a prefix of the rest is replaced, otherwise one character
is copied, and every normalised byte records the original byte it came from.
Pieces are formed on the normalised text and projected through that record to
spans of the original bytes.

Where no piece of the vocabulary runs from a letter into the word mark (checked
when the model is loaded), merges cannot cross the start of a word, so words
are encoded once and looked up afterwards; otherwise the whole text is one
word. Unseen words are given to the installed library with normalising
switched off. Decoding turns ids back into bytes through the piece table.

Defined results: a null or empty text has no ids and decodes to the empty
string. Rows are encoded whole and one by one; an empty table gives no rows.
Models with user-defined symbols, suffix word marks or types other than
byte-pair merges are refused (``ValueError``).
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evtide.llm.common import WordCache, map_batches

MARK = "▁"
#: Words a worker keeps in each of two generations (about 250 bytes each).
CACHE_WORDS = 200_000
_UNKNOWN, _CONTROL, _USER, _BYTE = 2, 3, 4, 6
_BPE = 2


class CharMap:
    """The compiled character map: a double array over UTF-8 bytes whose leaves
    point into a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.text = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that ``raw`` has at ``at``."""
        units, best = self.units, None
        unit = units[0]
        node = self._offset(unit)
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = units[node] & 0x7FFFFFFF, k + 1 - at
        if best is None:
            return None
        start, n = best
        return self.text[start:self.text.index(b"\0", start)], n

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    """``apply(text)`` -> normalised text and its byte alignment."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, with word marks, and for each of its bytes and
        its end the original byte it comes from."""
        if not text:
            return "", np.zeros(1, np.int64)
        raw = text.encode()
        mark = MARK.encode() if self.escape else b" "
        out, came = bytearray(), []
        at = 0

        def next_part(k: int) -> tuple[bytes, int]:
            hit = self.map.longest(raw, k) if self.map else None
            if hit:
                return hit
            n = 1
            while k + n < len(raw) and raw[k + n] & 0xC0 == 0x80:
                n += 1
            return raw[k:k + n], n
        if self.squeeze:
            while at < len(raw):
                part, n = next_part(at)
                if part != b" ":
                    break
                at += n
            if at == len(raw):
                return "", np.full(1, at, np.int64)
        if self.prefix:
            out += mark
            came += [at] * len(mark)
        space_before = self.squeeze
        while at < len(raw):
            part, n = next_part(at)
            while space_before and part.startswith(b" "):
                part = part[1:]
            if part:
                shown = part.replace(b" ", mark)
                out += shown
                came += [at] * len(shown)
                space_before = part.endswith(b" ")
            at += n
            if not self.squeeze:
                space_before = False
        if self.squeeze:
            while out.endswith(mark):
                at = came[len(out) - len(mark)]
                del out[len(out) - len(mark):], came[len(came) - len(mark):]
        return out.decode(), np.array([*came, at], np.int64)


def _blob(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings end to end, their starts and their sizes."""
    size = np.array([len(t) for t in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size


def _gather(blob: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The strings of ``ids`` end to end."""
    text, start, size = blob
    n = size[ids]
    before = np.cumsum(n) - n
    return text[np.repeat(start[ids] - before, n) + np.arange(int(n.sum()))].tobytes()


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema
        with open(path, "rb") as f:
            model = schema.ModelProto.FromString(f.read())
        if model.trainer_spec.model_type != _BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with leading word marks")
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("user-defined symbols are not supported")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.table = []
        for p in model.pieces:
            if p.type == _BYTE:
                self.table.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == _CONTROL:
                self.table.append(b"")
            elif p.type == _UNKNOWN:
                self.table.append(" ⁇ ".encode())
            else:
                self.table.append(p.piece.replace(MARK, " ").encode())
        self.wordwise = not any(MARK in p.piece.lstrip(MARK) or " " in p.piece
                                for p in model.pieces if p.type not in (_BYTE, _CONTROL, _UNKNOWN))
        self.newline_apart = self.wordwise and not any("\n" in p.piece for p in model.pieces)
        # a text that only the prefix and the word mark change is its own normal form
        self.plain = (not self.normaliser.map and not self.normaliser.squeeze
                      and self.normaliser.escape and self.normaliser.prefix)
        model.normalizer_spec.Clear()
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        model.normalizer_spec.escape_whitespaces = True
        self.library = sentencepiece.SentencePieceProcessor(
            model_proto=model.SerializeToString())
        self.dtype = np.dtype("<u2" if len(self.table) <= 1 << 16 else "<u4")
        self.table_text = _blob(self.table)
        self.size = self.table_text[2]
        self.digits = _blob([b"%d," % k for k in range(len(self.table))])
        self.marked = np.array([p.piece.startswith(MARK) for p in model.pieces])
        self.words = WordCache(CACHE_WORDS)
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+" if self.newline_apart
                              else f"{MARK}*[^{MARK}]+|{MARK}+")

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Words that hold one mark, in front, are encoded in
        one string: the next word's ids begin at the next piece with a mark."""
        known = self.words.young
        single = [w for w in words if w.startswith(MARK) and MARK not in w[1:]] \
            if self.wordwise else []
        for i in range(0, len(single), 2_000):
            part = single[i:i + 2_000]
            ids = np.array(self.library.encode("".join(part)), self.dtype)
            starts = np.flatnonzero(self.marked[ids])
            if len(starts) == len(part):
                raw = ids.tobytes()
                cuts = [*(starts * self.dtype.itemsize).tolist(), len(raw)]
                for k, w in enumerate(part):
                    known[w] = raw[cuts[k]:cuts[k + 1]]
        rest = [w for w in words if w not in known]
        for i in range(0, len(rest), 20_000):
            part = rest[i:i + 20_000]
            for w, ids in zip(part, self.library.encode(part, num_threads=1)):
                known[w] = np.array(ids, self.dtype).tobytes()

    def cut_words(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """Words of the normal form; its alignment, None where it is the text
        itself behind one mark."""
        if self.plain and MARK not in text:
            normal, came = (MARK + text.replace(" ", MARK)) if text else "", None
        else:
            normal, came = self.normaliser.apply(text)
        if not normal:
            return [], came
        if not self.wordwise:
            return [normal], came
        if came is None and "  " not in text and text[0] != " " and text[-1] != " ":
            return normal.replace(MARK, f" {MARK}").split(" ")[1:], came
        return self.cut.findall(normal), came

    def encode(self, texts: list[str]) -> list[tuple]:
        """(number of ids, ids joined by commas, span ends, decoded) per text;
        span ends are the original byte ends of the pieces, each of which
        starts where the one before ends (the first at 0)."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            cut = [self.cut_words(t) for t in texts]
            self.words.turn()
            new = self.words.missing(
                set().union(*[w for w, _ in cut]) - self.words.young.keys())
            if new:
                self._learn(list(new))
            return [self._join(*c) for c in cut]
        finally:
            if collecting:
                gc.enable()

    def _join(self, words: list[str], came: np.ndarray | None) -> tuple:
        if not words:
            return 0, "", np.zeros(0, np.int64), b""
        ids = np.frombuffer(b"".join(map(self.words.young.__getitem__, words)), self.dtype)
        ends = np.cumsum(self.size[ids])
        text = _gather(self.table_text, ids)
        prefix = self.normaliser.prefix and text.startswith(b" ")
        if came is None:
            spans = np.maximum(ends - 1, 0)
        else:       # the alignment counts a mark's bytes
            spans = came[ends + self._mark_bytes(words, ends)]
        return (len(ids), _gather(self.digits, ids)[:-1].decode(), spans,
                text[1:] if prefix else text)

    @staticmethod
    def _mark_bytes(words: list[str], ends: np.ndarray) -> np.ndarray:
        """Bytes that marks before each end have beyond the one counted."""
        raw = np.frombuffer("".join(words).replace(MARK, " ").encode(), np.uint8)
        return (len(MARK.encode()) - 1) * np.cumsum(np.concatenate([[0], raw == 32]))[ends]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encode_batch(model: str, b: pa.RecordBatch) -> list[tuple]:
    enc = encoder(model)
    texts = [t or "" for t in b.column(1).to_pylist()]
    return [e for i in range(0, len(texts), 500) for e in enc.encode(texts[i:i + 500])]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, span_ends, decoded): whole-text ids, the original byte end
    of every piece, and the text that the ids decode to."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = _encode_batch(model, b)
        return pa.RecordBatch.from_arrays(
            [b.column(0),
             pa.array([np.array(e[1].split(","), np.int32) if e[0] else [] for e in got],
                      pa.list_(pa.int32())),
             pa.array([e[2] for e in got], pa.list_(pa.int64())),
             pa.array([e[3].decode(errors="replace") for e in got], pa.string())],
            names=["doc_id", "ids", "span_ends", "decoded"])
    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, ids array<int>, span_ends array<bigint>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32): the same
    encoding, digested in the task that makes it. spans_crc32 is over the span
    ends as little-endian 64-bit numbers."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = _encode_batch(model, b)
        sha = [hashlib.sha256(e[1].encode()).hexdigest() for e in got]
        back = [hashlib.sha256(e[3].decode(errors="replace").encode()).hexdigest() for e in got]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([e[0] for e in got], pa.int64()), pa.array(sha),
             pa.array(back), pa.array([zlib.crc32(e[2].tobytes()) for e in got], pa.int64())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])
    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, "
                       "decoded_sha256 string, spans_crc32 bigint")
