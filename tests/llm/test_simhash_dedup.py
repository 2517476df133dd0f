import random

import xxhash
from fixtures import ODD_TEXTS, SF, docs, empty, rows

from evtide.llm import simhash_dedup as sd
from evtide.llm.common import table
from evtide.llm.components import components


def brute_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=3):
    """Smallest fingerprint reachable, by all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def brute_groups(data):
    prints = [brute_print(t) for _, t in data]
    comp = brute_components(set(prints))
    least = {}
    for (i, _), p in zip(data, prints):
        if i is not None:
            least[comp[p]] = min(least.get(comp[p], i), i)
    return sorted(((i, p, least.get(comp[p])) for (i, _), p in zip(data, prints)), key=repr)


def got_groups(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)
                   for r in sd.near_duplicates(df).collect()), key=repr)


def test_odd_texts(spark):
    assert got_groups(docs(spark)) == brute_groups(ODD_TEXTS)


def test_documents(spark):
    df = table(spark, SF, "documents")
    data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got_groups(df) == brute_groups(data)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_match_all_pairs(spark):
    rng = random.Random(5)
    for bits in (1, 2, 3, 5, 7):
        prints = set()
        for _ in range(25):       # balls of different width around random centres
            c = rng.getrandbits(64)
            for _ in range(12):
                p = c
                for b in rng.sample(range(64), rng.randint(0, bits + 2)):
                    p ^= 1 << b
                prints.add(signed(p))
        df = spark.createDataFrame([(p,) for p in prints], "fp long")
        got = {r.fp: r.comp for r in sd.link_fingerprints(df, bits).collect()}
        want = brute_components(prints, bits)
        groups = {}
        for p in prints:
            groups.setdefault(want[p], set()).add(p)
        assert set(got) == prints
        for g in groups.values():
            assert {got[p] for p in g} == {min(g)}


def test_dense_ball(spark):
    rng = random.Random(9)
    c = rng.getrandbits(63)
    prints = {c}
    for _ in range(1500):
        p = c
        for b in rng.sample(range(14), rng.randint(0, 6)):
            p ^= 1 << (4 * b)
        prints.add(p)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.fp: r.comp for r in sd.link_fingerprints(df).collect()}
    assert got == brute_components(prints)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    got = dict(rows(components(spark.createDataFrame(links + links[:9], "u long, v long"))))
    root = {n: n for e in links for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {n: find(n) for n in root if find(n) != n}
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []


def test_keep_one(spark):
    df = docs(spark)
    out = sd.keep_one(df)
    assert out.columns == df.columns
    prints = {signed(brute_print(t)) for _, t in ODD_TEXTS}
    assert out.count() == len(set(brute_components(prints).values()))
    kept = {r.doc_id for r in out.collect()}
    assert kept >= {1, 2, 7, None} and 5 not in kept and 3 not in kept


def test_empty_table(spark):
    assert rows(sd.near_duplicates(empty(spark))) == []
    assert rows(sd.keep_one(empty(spark))) == []
