from collections import defaultdict

from fixtures import LONG, ODD_TEXTS, docs, empty, rows

from evtide.llm import line_dedup as ld


def brute(rows_, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for i, t in rows_:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= min_chars and i is not None:
                holders[key].add(i)
    out = []
    for i, t in rows_:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            d = holders.get(key, ())
            if not (len(key) >= min_chars and len(d) >= min_docs and max(d) != i):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def norm(r):
    return sorted(r, key=repr)


MORE = [(20, "A shared line of text, long enough"), (None, "A shared line of text, long enough\nown"),
        (21, "ÉÉÉ shared by all of these"), (22, "ÉÉÉ Shared by all of these\r"),
        (23, "ÉÉÉ shared BY all of these"), (24, "éÉÉ shared by all of these"),
        (20, "A shared line of text, long enough\nagain 20")]


def test_matches_brute_force(spark):
    for data in (ODD_TEXTS, ODD_TEXTS + MORE):
        assert norm(rows(ld.dedup_lines(docs(spark, data)))) == norm(brute(data))


def test_empty_table(spark):
    assert rows(ld.dedup_lines(empty(spark))) == []
    assert rows(ld.rewrite_documents(empty(spark))) == []


def test_rewrite_keeps_columns(spark):
    df = docs(spark, ODD_TEXTS + MORE)
    out = ld.rewrite_documents(df)
    assert out.columns == df.columns and out.count() == df.count()
    want = {r[3] for r in brute(ODD_TEXTS + MORE)}
    for r in out.collect():
        assert (r.text or "") in want
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_hot_line(spark):
    data = [(i, f"this very common line is everywhere\nown line {i}") for i in range(500)]
    got = rows(ld.dedup_lines(docs(spark, data)))
    assert sum(r[2] for r in got) == 499 and LONG


def test_rows_without_an_own_id_get_only_their_own_hashes(spark):
    line = "line {} that some of the documents share".format
    data = [(i, "\n".join(map(line, range(100)))) for i in range(3)]
    data += [(i, f"{line(k)}\nown words of row {k}") for k in range(100) for i in (None, 7)]
    got = ld.with_lost(docs(spark, data)).where("doc_id is null or doc_id = 7").collect()
    assert len(got) == 200 and all(r.doc_id == 7 or len(r["__lost"]) == 1 for r in got)
    assert all(not r["__lost"] for r in got if r.doc_id == 7)       # 7 keeps them
    data += [(8, line(k)) for k in range(100)]
    got = ld.with_lost(docs(spark, data)).where("doc_id is null or doc_id = 7").collect()
    assert len(got) == 200 and all(len(r["__lost"]) == 1 for r in got)
    assert norm(rows(ld.dedup_lines(docs(spark, data)))) == norm(brute(data))
