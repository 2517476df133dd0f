import pytest
from pyspark.sql import functions as F
from oracle_harness import compare, duck, type_diffs
from test_line_dedup import brute as brute_lines
from test_scans import brute_spans
from test_simhash_dedup import brute_components, brute_print

import corpus_pipeline
from evtide.llm import quality, secret_scan
from evtide.llm.common import materialise, table
from evtide.llm.queries import ORACLES, QUERIES
from evtide.session import delete_path, hadoop_path, scratch_path
from fixtures import SF, docs, empty


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want, _, _ = compare(spark, name, SF, QUERIES, ORACLES)
    assert got == want
    con = duck(SF)
    assert not type_diffs(QUERIES[name](spark, SF), con.sql(ORACLES[name]))


def test_stages_match_brute_force(spark):
    df = table(spark, SF, "documents")
    columns, data = df.columns, {r.doc_id: r.text for r in df.collect()}
    model = quality.fit(df, table(spark, SF, "labels"))
    want = {i: t for i, t in data.items() if model.score(t) >= 0.3}
    assert 0 < len(want) < len(data)

    def check(stage, df):
        out = materialise(stage(spark, df, SF), "test-stage")
        assert out.columns == columns
        assert {r.doc_id: r.text for r in out.collect()} == want
        assert out.count() == len(want)
        assert all(r.n_chars == len(r.text) for r in out.collect())
        return out
    stages = dict(corpus_pipeline.STAGES)
    df = check(stages["quality_classifier"], df)
    want = {i: t for i, _, _, t in brute_lines(sorted(want.items()))}
    df = check(stages["line_dedup"], df)
    prints = {i: brute_print(t) for i, t in want.items()}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints.values()}
    comp = brute_components(set(signed.values()))
    first = {}
    for i in sorted(want):
        first.setdefault(comp[signed[prints[i]]], i)
    assert len(first) < len(want)
    want = {i: want[i] for i in first.values()}
    df = check(stages["simhash_near_dedup"], df)
    want = {i: secret_scan.redact(t, brute_spans(t)) for i, t in want.items()}
    df = check(stages["secret_scan"], df)
    pieces = stages["packing"](spark, df, SF).collect()
    assert {p.doc_id for p in pieces} == set(want)
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(p.ids for p in run) == sorted(p.ids for p in pieces)


def test_odd_and_empty_documents(spark):
    for df in (docs(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            assert n > 0 or not df.count()


CLASHES = ("__score", "score", "SCORE2", "__row", "__lost", "lost", "lost_row", "row", "__fp", "fp",
           "__kept", "kept", "__n", "n", "comp", "first", "key", "keeper", "spans", "column_2",
           "column_7", "label", "quality", "bytes", "hash", "u", "v", "m", "salt", "posting")


@pytest.mark.parametrize("upper", [False, True])
def test_every_inner_name_may_be_a_column(spark, upper):
    df = docs(spark, extra=False)
    for c in CLASHES:
        df = df.withColumn(c.upper() if upper else c, F.concat(F.lit(c), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        for r in out.collect():
            for c in CLASHES:
                value = r[c.upper() if upper else c]
                assert value == (None if r.doc_id is None else f"{c}{r.doc_id}"), (name, c)
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() > 0


def test_finished_stages_leave_nothing(spark):
    folder = scratch_path(spark, "x").rsplit("/", 1)[0]

    def held():
        fs, p = hadoop_path(spark, folder)
        return {str(f.getPath().getName()).rsplit("-", 1)[0] for f in fs.listStatus(p)}
    for f in hadoop_path(spark, folder)[0].listStatus(hadoop_path(spark, folder)[1]):
        if not f.getPath().getName().startswith("package"):
            delete_path(spark, f.getPath().toString())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert held() - {"package"} == {"stage-secret_scan", "tokens"}


def test_private_keys_leave_no_trace(spark):
    # with keys in many documents, their banners are shared lines
    body = ["\n".join(f"MIIEpAIBAAKCAQEA{i}x{k}{'bQ+/zX9kLmN4' * 3}" for k in range(3))
            for i in range(5)]
    df = docs(spark, [(i, f"words of {i}\n-----BEGIN RSA PRIVATE KEY-----\n{b}\n"
                          f"-----END RSA PRIVATE KEY-----\nend of {i}")
                      for i, b in enumerate(body)])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "secret_scan"):
        df = materialise(stages[name](spark, df, SF), "test-keys")
    assert {r.doc_id: r.text for r in df.collect()} == {
        i: f"words of {i}\n<SECRET>\nend of {i}" for i in range(5)}
