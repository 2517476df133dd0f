"""Token alignment against a loop over one document at a time."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evtide.llm import alignment
from evtide.llm.queries import QUERIES

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string"
PARTS = ["a", "b ", " ", "  ", "\n", "\t", "é", "日本", "😀", "the quick", "'s", "<s>", "<unk>",
         "<|endoftext|>", " x ", "1234", " ", "\x1c", "...", "​", "ﬁ", "\x00", "word "]


@pytest.fixture(scope="module")
def pair():
    return alignment.tokenizers_of(A, B)


def brute(rows, pair):
    per, counts = [], collections.Counter()
    for doc_id, text in rows:
        text = text or ""
        a = pair.a.encode(" " + text, add_special_tokens=False).ids
        b = pair.b.encode(text)
        bytes_a = [pair.bytes_a[i] for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [pair.b.id_to_piece(i)]]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            per.append((doc_id, 0, 0, [], []))
            continue
        ends, end = {}, 0
        for k, x in enumerate(bytes_a):
            end += len(x)
            ends[end] = k
        links, groups, end, i, j = [], [], 0, 0, 0
        for k, x in enumerate(bytes_b):
            end += len(x)
            if end in ends:
                links.append((a[ends[end]], b[k]))
                groups.append((a[i:ends[end] + 1], b[j:k + 1]))
                i, j = ends[end] + 1, k + 1
        counts.update(links)
        per.append((doc_id, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, n_a, n_b, groups, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links),
                    sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


def odd_rows(seed, n=250):
    rng = random.Random(seed)
    rows = [(i if i % 7 else None, "".join(rng.choices(PARTS + ["▁"] * (i % 3 == 0),
                                                       k=rng.randrange(50)))) for i in range(n)]
    long = " ".join(rng.choices(["foo", "barbaz", "x y", "q\n", "é"], k=40_000))
    return rows + [(1, None), (2, ""), (2, ""), (3, long), (3, long), (4, "é" * 3000),
                   (5, " " * 3000), (6, "▁")]


@pytest.mark.parametrize("block", [500, 1 << 22])
def test_equals_brute_force(spark, pair, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = odd_rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("block", "pairs", "known", "n_a", "PAIR", "digests", "count"):
        df = df.withColumn(name, F.lit("clash"))
    out = alignment.align(df, A, B)
    assert out.columns == [f.split()[0] for f in alignment.ALIGNED.split(", ")]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, pair)


def test_pieces_encode_as_the_whole(pair):
    cut = 0
    for _, text in odd_rows(2, 600):
        if text:
            ps = alignment.pieces(text[:4000])
            cut += len(ps) - 1
            assert " ".join(ps) == text[:4000]
            assert [i for p in ps for i in pair.a.encode(" " + p, add_special_tokens=False).ids] \
                == pair.a.encode(" " + text[:4000], add_special_tokens=False).ids
            assert [i for p in ps for i in pair.b.encode(p)] == pair.b.encode(text[:4000])
    assert cut > 500


@pytest.mark.parametrize("stretch", [1, 2, 7, 512])
def test_lockstep_finds_all_common_ends(monkeypatch, stretch):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    end_a, end_b, first, base = [], [], [0], 0
    for _ in range(60):
        n = int(rng.integers(0, 60))        # documents without tokens, too
        if n:
            for ends in (end_a, end_b):
                inner = rng.choice(np.arange(1, n + 1), rng.integers(0, n), replace=False)
                ends += sorted({*(base + inner), base + n})
            base += n
        first.append(len(end_a))
    a, b = alignment.lockstep(np.array(end_a), np.array(end_b), np.array(first))
    want = sorted(set(end_a) & set(end_b))
    assert [end_a[i] for i in a] == want == [end_b[j] for j in b]


def test_long_words_are_not_kept_and_generations_turn(monkeypatch):
    pair = alignment.Pair(A, B)
    pair.words.size = 40
    for k in range(6):
        texts = [" ".join(f"w{k}x{i}" for i in range(30)), "y" * 500 + f" {k}", "same old words"]
        got = pair.encode(texts)
        for t, (a, b) in zip(texts, got):
            assert np.frombuffer(a, pair.dtype).tolist() == pair.a.encode(
                " " + t, add_special_tokens=False).ids
            assert np.frombuffer(b, pair.dtype).tolist() == pair.b.encode(t)
        assert all(len(w) <= alignment.CACHE_CHARS for w in pair.words.young)
    assert len(pair.words.young) + len(pair.words.old) < 150


def test_empty_table_and_no_tokens(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    got = alignment.align(spark.createDataFrame([(1, None), (None, "▁")], SCHEMA), A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_query_equals_brute_force(spark, pair):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = QUERIES["op12_token_alignment"](spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, pair)
