import random
import zlib

import numpy as np
from fixtures import LONG, ODD_TEXTS, docs, empty, rows

from evtide.llm import quality as q
from evtide.llm.common import table

SF01 = "/root/testdata/sf0.01"


def brute_features(text):
    """Bucket counts from the definition, word by word."""
    base, out = int(q._BASE), []

    def bucket(h, salt):
        return int(q._bucket(np.array([h % (1 << 64)], np.uint64), salt)[0])
    words = text.encode().split()
    for k, w in enumerate(words):
        out.append(bucket(sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)), 1))
        if k and words[k - 1] == w:
            out.append(q._REPEATED)
        marked = b" " + w + b" "
        for n in q.GRAMS:
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i:i + n]:
                    h = h * base + c + 1
                out.append(bucket(h, n))
    return sorted(out)


def test_features_match_definition():
    for t in ["", " ", "a", "the the cat\nsat  on é😀 x", "ab" * 40, "\t tab\x0bvt\x0cff\rcr "]:
        assert sorted(q.features(t.encode()).tolist()) == brute_features(t)


def test_features_do_not_depend_on_where_pieces_end(monkeypatch):
    rng = random.Random(5)
    parts = ["a", "ab", "word word", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "日本", "x" * 9]
    texts = ["", " ", "same same same", "nowhitespaceatall" * 3, "one\tone\ttwo"] + [
        "".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(60)]
    for t in texts:
        raw = t.encode()
        monkeypatch.setattr(q, "_PIECE", 1 << 20)
        whole, score = brute_features(t), q.Model(MARGIN, 0.1).score(t)
        assert sorted(q.features(raw).tolist()) == whole
        for size in range(1, len(raw) + 2):
            monkeypatch.setattr(q, "_PIECE", size)
            assert sorted(q.features(raw).tolist()) == whole
            assert q.Model(MARGIN, 0.1).score(t) == score


MARGIN = np.random.default_rng(2).normal(size=q.BUCKETS).astype(np.float32)


def test_long_texts_are_read_whole(monkeypatch):
    for text in (LONG + "!! end", LONG.replace(" ", "\t"), LONG.replace(" ", ""), "word " * 50_000):
        whole, score = np.sort(q.features(text.encode())), q.Model(MARGIN, 0.0).score(text)
        for size in (5000, 4999, 77_777):
            monkeypatch.setattr(q, "_PIECE", size)
            assert (np.sort(q.features(text.encode())) == whole).all()
            assert q.Model(MARGIN, 0.0).score(text) == score
        monkeypatch.setattr(q, "_PIECE", 1 << 20)


def test_held_out_accuracy(spark):
    docs_, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = {r.doc_id: r for r in q.classify(docs_, labels).collect()}
    assert len(got) == docs_.count()
    right = total = 0
    for r in labels.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3)
        if g.held_out:
            total += 1
            right += g.predicted == r.quality
    assert total > 30 and right / total > 0.93


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (7, 0, 0), (None, 1, 0), (9, None, 0), (99, 0, 0), (8, 1, 1)],
        "doc_id long, quality int, toxic int")
    got = q.classify(docs(spark), labels).collect()
    assert len(got) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in q.classify(docs(spark), none).collect()} == {0.5}
    assert rows(q.classify(empty(spark), labels)) == []


def test_keep_good_keeps_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark)
    out = q.keep_good(df, labels)
    assert out.columns == df.columns and out.count() == df.count()


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)],
                                   "doc_id long, quality int, toxic int")
    df = docs(spark, [(i, f"text {i}") for i in range(60)])
    texts, y = q.training_rows(df, labels, 20)
    assert len(texts) == len(y) == 20
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t in texts)


def test_long_labelled_texts_are_learnt_from(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)],
                                   "doc_id long, quality int, toxic int")
    df = docs(spark, [(i, ("calm even prose " if i % 2 else "CLICK buy!! now ") * (1100 + i))
                      for i in range(60)])
    texts, y = q.training_rows(df, labels)
    assert len(texts) == len(y) > 40 and min(map(len, texts)) > 16_000
    got = {r.doc_id: r.score for r in q.classify(df, labels).collect()}
    assert all((s > 0.5) == bool(i % 2) and s != 0.5 for i, s in got.items())


def test_sample_is_taken_from_labelled_texts_in_order_of_a_hash(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4000)],
                                   "doc_id long, quality int, toxic int")
    data = [(i, f"text {i} " + "x" * (1000 if i % 3 else 30_000)) for i in range(0, 4000, 100)]
    df = docs(spark, data + [(100, "text 100 again"), (None, "no id"), (200, None)])
    # ids that are not in docs use nothing up
    texts, y = q.training_rows(df, labels, 10)
    assert len(texts) == len(y) == 10
    every, _ = q.training_rows(df, labels, 100)
    known = [t for i, t in data if zlib.crc32(str(i).encode()) % 5]
    again = ["text 100 again"] if zlib.crc32(b"100") % 5 else []
    assert sorted(every) == sorted(known + again)
    for budget in (1, 20_000, 200_000):
        part, y = q.training_rows(df, labels, 100, budget)
        assert part == every[:len(part)] and len(y) == len(part)
        assert sum(map(len, part[:-1])) < budget <= sum(map(len, part))


def test_counts_of_a_long_text(monkeypatch):
    text = LONG.encode()
    for size in (q._PIECE, 5000):
        monkeypatch.setattr(q, "_PIECE", size)
        f, n = np.unique(q.features(text), return_counts=True)
        assert (f == q.counted(text)[0]).all() and (n == q.counted(text)[1]).all()
    assert not len(q.counted(b"")[0])
