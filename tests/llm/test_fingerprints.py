import hashlib
import random

from fixtures import ODD_TEXTS, SF, docs, empty, rows

from evtide.llm import fingerprints as fi
from evtide.llm.common import table


def edited(data):
    """doc -> edited text, straight from the definition, for unique ids."""
    order = sorted(data, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = t[:len(t) - cut] + n[:cut]
    return out


def test_edited_texts(spark):
    df = table(spark, SF, "documents")
    data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want, got = edited(data), {r.doc_id: r for r in fi.edited_fingerprints(df).collect()}
    assert len(got) == len(data)
    for i, t in data:
        assert got[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert got[i].n_chars == len(t or "")
    order = sorted(got, reverse=True)
    for k, i in enumerate(order):
        a, b = got[i], got[order[(k + 1) % len(order)]]
        mask = (1 << 64) - 1
        assert a.near_next == 1 - ((a.fp ^ b.fp) & mask).bit_count() / 64
        assert a.near_edited == 1 - ((a.fp ^ a.edited_fp) & mask).bit_count() / 64
    n = len(got)
    assert sum(r.near_edited for r in got.values()) / n > 0.1 + sum(
        r.near_next for r in got.values()) / n


def test_equal_texts_have_equal_fingerprints(spark):
    data = [(1, "a b c a"), (2, "a b c a"), (3, "c b a"), (4, ""), (5, None), (6, " "), (7, "a")]
    got = {r.i: r.fp for r in fi.fingerprints(
        spark.createDataFrame(data, "i long, t string"), ["i"], "t").collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] == got[6] == 0 != got[7]


def test_votes_by_weight(spark):
    import xxhash

    def h(a, b):
        seed = xxhash.xxh64_intdigest(a.encode(), 42)
        return xxhash.xxh64_intdigest(b.encode(), seed) if b else seed
    words = "one fish two fish red fish blue fish one fish".split()
    terms = list(zip(words, words[1:] + [None]))
    weight = [len(a) + len(b or "") for a, b in terms]
    want = sum(1 << k for k in range(64)
               if 2 * sum(w for (a, b), w in zip(terms, weight) if h(a, b) >> k & 1) > sum(weight))
    got = fi.fingerprints(spark.createDataFrame([(1, "  " + "\t".join(words) + "\n")],
                                                "i long, t string"), ["i"], "t").first().fp
    assert got & (1 << 64) - 1 == want


def test_odd_rows(spark):
    got = fi.edited_fingerprints(docs(spark)).collect()
    assert len(got) == len(ODD_TEXTS)
    twins = [r for r in got if r.doc_id == 7 and r.n_chars == 25]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert sorted({r.pos for r in got}) == list(range(len(set(ODD_TEXTS))))
    assert [r.pos for r in got if r.doc_id is None] == [len(set(ODD_TEXTS)) - 1]
    assert rows(fi.edited_fingerprints(empty(spark))) == []
    one = fi.edited_fingerprints(docs(spark, [(1, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(30):
        c = rng.getrandbits(64)
        for _ in range(10):
            p = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                p ^= 1 << b
            prints.add(p - (1 << 64) if p >> 63 else p)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for radius in (0, 1, 3, 5):
        got = rows(fi.within_radius(df, df, radius))
        want = {(a, b) for a in prints for b in prints
                if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert set(got) == want and len(got) == len(want)


def test_main_path_runs_no_python(spark):
    plan = fi.edited_fingerprints(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_counts_near_fingerprints(spark):
    from evtide.llm.queries import QUERIES
    got = QUERIES["op4_document_fingerprints"](spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert len(got) == table(spark, SF, "documents").count()
    for r in got:
        want = (len({p for p in prints.values() if p != prints[r.doc_id]
                     and (p ^ prints[r.doc_id]).bit_count() <= 3})
                if r.doc_id % 50 == 0 else None)
        assert r.n_near == want
