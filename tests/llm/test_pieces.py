import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from fixtures import LONG, ODD_TEXTS, SF, docs, empty, rows
from sentencepiece import sentencepiece_model_pb2 as schema

from evtide.llm import pieces as pc
from evtide.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd():
    rng = random.Random(4)
    parts = ["a", "the", "B", "é", " ", "  ", "\n", "\t", "▁", "日", "😀", "'", ".", " the", "\x00",
             "￿", "́"]
    return ["", " ", "  a  b ", "\n", "▁", "▁a ▁", "a▁b", "x" * 3000, LONG[:5000]] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(1500)]


def test_equals_the_library(library):
    enc = pc.PieceEncoder(MODEL)
    texts = odd()
    for t, (n, ids, ends, decoded) in zip(texts, enc.encode(texts)):
        want = library.encode(t)
        assert (n, ids) == (len(want), ",".join(map(str, want)))
        assert decoded.decode(errors="replace") == library.decode(want)
        if t and not set(t) & set("\x00￿\n\t"):     # no piece is part of a character
            assert ends.tolist() == [p.end for p in library.encode(t, return_type="proto").pieces]
        assert not len(ends) or ends[-1] == len(t.encode())


def test_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pc, "CACHE_WORDS", 5)
    enc = pc.PieceEncoder(MODEL)
    for t in odd()[:300]:
        assert enc.encode([t])[0][1] == ",".join(map(str, library.encode(t)))


def test_character_map_equals_the_library():
    rng = random.Random(6)
    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = schema.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
        own = pc.Normaliser(spec)
        texts = ["ｱ①  x ﬁ", "  a ", "", "   ", "ガガが́́e", "A B㌔ "] + [
            "".join(rng.choice("aAé ①ｶﾞﾊﾟ㌔ﬁǺ　\tx가각́") for _ in range(rng.randint(1, 12)))
            for _ in range(1500)]
        for t in texts:
            normal, came = own.apply(t)
            assert normal == lib.normalize(t)
            assert len(came) == len(normal.encode()) + 1
            assert all(a <= b for a, b in zip(came, came[1:]))


def test_documents(spark, library):
    df = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pc.encode_digests(df, MODEL).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, library):
    got = pc.encode_documents(docs(spark), MODEL).collect()
    assert sorted((r.doc_id or -1, r.decoded, r.ids) for r in got) == sorted(
        (i or -1, t or "", library.encode(t or "")) for i, t in ODD_TEXTS)
    assert rows(pc.encode_documents(empty(spark), MODEL)) == []
    assert rows(pc.encode_digests(empty(spark), MODEL)) == []
