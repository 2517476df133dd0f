"""Word-piece ids of whole texts, with a cache of words already seen.

The tokenizer (lower-casing BPE that drops white space and cuts words at
letter, digit and symbol boundaries) treats the parts of a text between two
such boundaries independently. A text is therefore cut into words at ASCII
white space, and a word not seen before into chunks where Latin letters or
digits meet ASCII punctuation; where an apostrophe, a combining mark or any
other character follows, the rest of the word stays one chunk. Distinct words
and chunks are encoded once and looked up afterwards. The ids equal those of
encoding the whole text.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

from evtide.llm.common import WordCache

#: Words and chunks a worker keeps in each of two generations (about 200 bytes each).
CACHE_WORDS = 350_000
_ALNUM = r"0-9A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PUNCT = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_OTHER = rf"[^{_ALNUM}{_PUNCT}]"
_CHUNK = re.compile(rf"[{_ALNUM}]++(?!{_OTHER})|[{_PUNCT}]++(?!{_OTHER})|(?s:.+)")
_STOPS = b".,"
#: One run of letters in lower case that no normalisation changes.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_symbols() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return table | {32: " "}


class WordEncoder:
    """``encode(texts)`` -> ids of each text as bytes of ``dtype`` (little-endian,
    16 bits where the vocabulary allows it)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same merges for words that need neither normalising nor cutting
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.word_end[i] = piece.endswith("</w>")
        self.dtype = np.dtype("<u2" if len(self.word_end) <= 1 << 16 else "<u4")
        self.symbols = _byte_symbols()
        self.words = WordCache(CACHE_WORDS)

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of new words in the young generation."""
        known = self.words.young
        plain: list[bytes] = []
        cut: dict[bytes, list[bytes]] = {}
        for w in words:
            if w.isalpha():                                 # ASCII letters, in lower case
                plain.append(w)
            elif w[-1] in _STOPS and w[:-1].isalpha():
                cut[w] = [w[:-1], w[-1:]]
            elif _PLAIN.fullmatch(t := w.decode()):
                plain.append(w)
            else:
                cut[w] = [c.encode() for c in _CHUNK.findall(t)]
        chunks = {c for parts in cut.values() for c in parts if c not in known}
        odd: list[bytes] = []
        for c in self.words.missing(chunks):
            (plain if c.isalpha() or _PLAIN.fullmatch(c.decode()) else odd).append(c)
        for i in range(0, len(plain), 5_000):
            part = plain[i:i + 5_000]
            text = b" ".join(part).decode("latin-1").translate(self.symbols)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                           self.dtype)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                odd += part
                continue
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, (ends * self.dtype.itemsize).tolist()):
                known[w] = raw[at:e]
                at = e
        for i in range(0, len(odd), 5_000):
            part = odd[i:i + 5_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(
                    [c.decode() for c in part], add_special_tokens=False)):
                known[c] = np.array(e.ids, self.dtype).tobytes()
        for w, parts in cut.items():
            known[w] = b"".join([known[c] for c in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        # no cycles are made here, and millions of small objects are
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        # bytes.lower and bytes.split touch ASCII only; the tokenizer lowers the rest
        self.words.turn()
        known = self.words.young
        cut = [t.encode().lower().split() for t in texts]
        found = [list(map(known.get, words)) for words in cut]
        new = {w for words, ids in zip(cut, found) if None in ids
               for w, v in zip(words, ids) if v is None}
        new = self.words.missing(new) if new else new
        if new:
            self._learn(list(new))
        return [b"".join(ids) if None not in ids else
                b"".join([known[w] if v is None else v for w, v in zip(words, ids)])
                for words, ids in zip(cut, found)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
