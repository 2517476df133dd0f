"""Prefix trie against a plain dictionary of prefixes."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evtide.llm import prefix_trie
from evtide.llm.queries import ORACLES, QUERIES
from oracle_harness import compare

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def turn_hash(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: (t[0], t[1], turn_hash(t[2], t[3])))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = convs.get(c - int(math.fmod(c, 20)), [])[:h]
        rebuilt[c] = tuple((t[2], t[3]) for t in head + turns[h:])
    members = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, ms in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(ms) - 1) * words
    out = []
    for n, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if rebuilt[c] == n)
        out.append((min(ms), len(n), min(members[n[:-1]]) if n else None, len(ms), kids[n],
                    leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "depth", "rep", "k1", "N", "words", "tie", "a"):
        df = df.withColumn(name, F.lit("clash"))
    out = prefix_trie.trie(df)
    assert out.columns == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    # nulls in every column, ties, repeated rows, absent bases, negative and large ids
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 60), *range(10**12, 10**12 + 25), None]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "user", None, ""]),
                         rng.choice(["a b", "a b", " \t", None, "c d 　e"])))
    check(spark, rows)


def test_one_hot_sequence_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 20) for t in range(3)]
    rows += [(100_000, t, "user", f"long {t % 5} of words") for t in range(1500)]
    check(spark, rows)


def test_empty_table_and_no_ids(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)).collect() == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    check(spark, [(c, 0, "user", "goes away, its head is absent")])


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    import duckdb
    rng = random.Random(9)
    rows = [(c, rng.choice([None, t, 1]), rng.choice(["user", None]),
             rng.choice(["a b", " ", None, "c d é"])) for c in [*range(70), None]
            for t in range(rng.choice([1, 2, 5]))]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_prefix_trie']})")
    assert sorted(want.fetchall(), key=str) == brute(rows)


def test_query_matches_its_sql(spark):
    got, want, *_ = compare(spark, "op11_prefix_trie", "/root/testdata/sf0.001", QUERIES, ORACLES)
    assert got == want
