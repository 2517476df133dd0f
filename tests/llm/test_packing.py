import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from fixtures import docs, empty, rows
from tokenizers import Tokenizer

from evtide.llm import packing
from evtide.llm.word_tokens import WordEncoder

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_round_trip_and_padding(spark):
    df = docs(spark)
    pieces = packing.pack(df, VOCAB, 64).collect()
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        at = 0
        for p in seq:
            assert p.offset == at
            at += p.length
        assert at <= 64 and at & (at - 1) == 0       # full, or a power of two: no padding
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.doc_id].append(whole(r.text) + [1])
    for doc_id, want in texts.items():
        own = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in own) == sum(map(len, want))
        if len(want) == 1:
            own.sort(key=lambda p: p.start)
            ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
            assert ids == want[0] and {p.doc_tokens for p in own} == {len(ids)}
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]


def test_empty_table(spark):
    assert rows(packing.pack(empty(spark), VOCAB)) == []


def test_words_equal_whole_texts():
    texts = ["", "don't we'll 's'", "A..B,,c--d", "É´é é. ΑΣ ΣΑΣ. İstanbul", ".́ á.",
             "\x1c\x1d a\x0bb\x0cc x\x85y", "12 3.4 1a ½ ²", "<|endoftext|>", "日本語。テキスト 😀!!",
             "ß ẞ ſ K Å ﬁ ŉ", "a_b __ c *** &&&", "x" * 5000]
    enc = WordEncoder(VOCAB)
    got = [np.frombuffer(r, enc.dtype).tolist() for r in enc.encode(texts)]
    assert got == [whole(t) for t in texts]


def test_hilbert_curve_visits_neighbours():
    for d, b in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << b)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = packing.hilbert_keys(grid / ((1 << b) - 1) * 8 - 4 + 1e-9, bits=b)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert set(np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)) == {1}


def test_like_documents_are_neighbours(spark):
    a, b = "the cat sat on the mat " * 30, "stock prices fell sharply again today " * 30
    df = docs(spark, [(i, (a if i % 2 else b) + f" {i}") for i in range(40)])
    first = {}
    for p in packing.pack(df, VOCAB, 128).collect():
        key = (p.sequence_id, p.offset)
        first[p.doc_id] = min(first.get(p.doc_id, key), key)
    order = [i % 2 for i, _ in sorted(first.items(), key=lambda x: x[1])]
    assert sum(x != y for x, y in zip(order, order[1:])) <= 8
