import random
import re
import textwrap

import pytest

from fixtures import ODD_TEXTS, SF, docs, empty, rows

from evtide.llm import license_scan as ls
from evtide.llm import secret_scan as ss
from evtide.llm.common import table
from evtide.llm.trigrams import Postings, query

SECRETS = [
    (100, 'PassWord = "abcdefghijkl" and token:short then api_key: ABCDEFGHIJKLMNOP'),
    (101, "token=token=abcdefghijklm passwd:secret:abcdefghijkl"),
    (102, "AKIAAKIAAKIAAKIA12 AKIA123 0123456789abcdef0123 0123456789ABCDEF"),
    (103, "é😀 secret : 'x-y_z/+=.12345' deadbeefdeadbeefdeadbeef"),
    (104, "-----BEGIN RSA PRIVATE KEY----- xoxb-1234567890ab ghp_" + "a" * 36),
    (105, "paſſword=abcdefghijklmno toKen=abcdefghijklm"),
]


def brute_spans(text):
    out = []
    for k, r in enumerate(ss.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((m.start(), k, m.end()))
    return [(ss.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def test_secrets_match_a_full_scan(spark):
    data = ODD_TEXTS + SECRETS
    got = sorted((r.doc_id or -1, [tuple(s) for s in r.spans])
                 for r in ss.scan_secrets(docs(spark, data)).collect())
    assert got == sorted((i or -1, brute_spans(t)) for i, t in data)
    assert sum(len(s) for _, s in got) > 8


def test_secrets_in_the_documents(spark):
    df = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in ss.scan_secrets(df).collect()}
    assert got == {i: brute_spans(t) for i, t in texts.items()}


def test_hex_rule_equals_its_contract():
    text = "abcdef0123456789 " + "f" * 15 + " " + "0" * 40 + "g1234567890abcdefA"
    want = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    assert [(a, b) for k, a, b in ss.Scanner(ss.RULES).scan([text])[0] if k == "hex"] == want


def test_trigram_queries():
    assert query("[0-9a-f]+") == []
    assert query("ab") == []
    assert query("abcd") == [[frozenset({b"abc", b"bcd"})]]
    assert query("(?:foo|barn)x?") == [[frozenset({b"bar", b"arn"}), frozenset({b"foo"})]]
    assert query("abc.*xyz") == [[frozenset({b"abc"})], [frozenset({b"xyz"})]]
    assert query("(?:abc)?") == []
    assert query("a[0-9]+") == []


def test_postings_keep_every_match():
    texts = ["xxabcxx", "", "ab", "c" + "abc", "ABC".lower(), "bca"]
    index = Postings([t.encode() for t in texts], [b"abc"])
    assert index.candidates(query("abc")).tolist() == [0, 3, 4]
    assert index.candidates([]).tolist() == list(range(6))


def test_redaction(spark):
    df = docs(spark, SECRETS + [(1, None), (2, "clean")])
    out = ss.redact_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "clean" and got[1].text is None
    assert "abcdefghijkl" not in got[100].text and got[100].text.count("<SECRET>") == 2
    assert got[100].n_chars == len(got[100].text)


def test_empty_tables(spark):
    assert rows(ss.scan_secrets(empty(spark))) == []
    assert rows(ls.scan_licenses(empty(spark))) == []


LICENSES = [
    (200, "Released under the MIT License."), (201, "the mit\nlicense MIT-License mit  licenses"),
    (202, "This work is licensed under the GNU General Public License, version 3."),
    (203, "Licensed under CC BY-NC 4.0."), (204, "word " * 300 + "licensed under cc by nc 4 0"),
    (205, "license mit license mit license"), (206, "Apache\x00License"),
    (207, "redistribution and use in source and binary forms with or without modification are "
          "permitted provided that the following conditions"),
]


def brute_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = ls._WORD.findall(low)
    places = [(i, label) for phrase, label in ls.PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    more, best = set(), 0.0
    for line in low.split("\n"):
        w = ls._WORD.findall(line)
        for k in range(0, max(1, len(w) - ls.BLOCK_WORDS // 2), ls.BLOCK_WORDS // 2):
            block = set(w[k:k + ls.BLOCK_WORDS])
            for label, t in ls.TEMPLATES:
                own = set(ls.words_of(t))
                share = len(own & block) / len(own)
                if share >= ls.THRESHOLD:
                    more.add(label)
                    best = max(best, share)
    kinds = {label for _, label in places}
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None),
            ",".join(sorted(kinds)), ",".join(sorted(kinds | more)), 1.0 if at else best)


def test_licenses_match_brute_force(spark):
    data = ODD_TEXTS + LICENSES
    got = sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels,
                   r.labels, r.score) for r in ls.scan_licenses(docs(spark, data)).collect()),
                 key=repr)
    assert got == sorted(((i or -1, *brute_licenses(t)) for i, t in data), key=repr)
    labels = {g[0]: g[6] for g in got}
    assert labels[203] == "cc-by-nc" and labels[204] == "cc-by-nc" and labels[207] == "bsd"
    assert labels[202] == "gpl" and labels[206] == "apache"


def test_licenses_in_the_documents(spark):
    df = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in ls.scan_licenses(df).collect():
        assert tuple(r)[1:8] == brute_licenses(texts[r.doc_id])


def test_positional_and_prefix_filters_lose_nothing():
    import random
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    templates = [(str(k), " ".join(rng.sample(words, rng.randint(2, 12)))) for k in range(15)]
    for threshold in (0.5, 0.85, 1.0):
        joiner = ls.Joiner(templates, threshold, {w: rng.randint(0, 9) for w in words})
        for _ in range(300):
            block = frozenset(rng.sample(words, rng.randint(0, 25)))
            want = {k for k, (_, t) in enumerate(templates)
                    if len(block & set(t.split())) >= threshold * len(t.split()) - 1e-9}
            assert set(joiner.block(block)) == want


WRAPPED = {
    "lgpl": "you can redistribute it and/or modify it under the terms of the GNU Lesser\n"
            "General Public License as published by the Free Software Foundation",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n"
           " * modification, are permitted provided that the following conditions\n * are met:",
    "mit": "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of\n"
           "# this software and associated\n# documentation files",
    "mpl": "This Source Code Form is subject\r\nto the terms of the\r\nMozilla Public License",
    "cc-by": "Licensed under a Creative Commons\nAttribution 4.0 International License",
}


def brute_passages(words, templates, size):
    """Labels of all blocks of ``size`` words, at every word of the text."""
    return {label for k in range(max(1, len(words) - size + 1)) for label, t in templates
            if len(set(ls.words_of(t)) & set(words[k:k + size]))
            >= ls.THRESHOLD * len(set(ls.words_of(t))) - 1e-9}


def test_wrapped_notices_are_found(spark):
    data = list(enumerate(WRAPPED.values()))
    data += [(100 + i, "some words\n" * 70 + t + "\nmore of them" * 70) for i, t in data]
    got = {r.doc_id: r for r in ls.scan_licenses(docs(spark, data)).collect()}
    for i, label in enumerate(WRAPPED):
        for r in (got[i], got[100 + i]):
            assert label in r.labels.split(",")
            assert [b.first_word // 140 for b in r.blocks if b.label == label] == [r.doc_id // 100]


def test_blocks_at_every_word():
    import random
    rng = random.Random(5)
    templates = [(str(k), " ".join(f"w{rng.randint(0, 40)}" for _ in range(12))) for k in range(9)]
    joiner = ls.Joiner(templates, ls.THRESHOLD, {})
    seen = 0
    for _ in range(200):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 300))]
        got = {joiner.templates[k].label for _, _, k, _ in joiner.document(words, 60)}
        assert got == brute_passages(words, templates, 60)
        seen += len(got)
    assert seen > 50


_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU {}General Public License as published by the Free Software Foundation")
_CC = "licensed under a Creative Commons Attribution{} 4.0 International License"
SIBLINGS = [
    ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("Licensed under CC BY-ND 4.0", "cc-by-nd"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("Work by A. Uthor, licensed under CC BY-SA 4.0 by its owner. " * 2, "cc-by-sa"),
    ("Licensed under CC BY 4.0, the data licensed under CC BY-ND 4.0", "cc-by,cc-by-nd"),
    (_CC.format(""), "cc-by"), (_CC.format("-NonCommercial"), "cc-by-nc"),
    (_CC.format("-Noncommercial-Share\nAlike"), "cc-by-nc-sa"),
    (_CC.format("-ShareAlike"), "cc-by-sa"), (_CC.format("-NonCommercial-NoDerivatives"),
                                              "cc-by-nc-nd"),
    (_GNU.format(""), "gpl"), (_GNU.format("Lesser "), "gpl,lgpl"),
    (_GNU.format("Affero "), "agpl,gpl"),
    (_GNU.replace("General Public License", "GPL").format(""), "gpl"),
    (_GNU.replace("General Public License", "GPL").format("Lesser "), "lgpl"),
    ("Licensed under the Mozilla Public License, Version 2.0", ""),
    ("Licensed under the Educational Community License, Version 2.0", ""),
    ("Licensed under the Apache Software License, Version 2.0", "apache"),
    ("This Source Code Form is subject to the terms of the Eclipse Public License", ""),
]


def test_sibling_licenses_keep_their_own_labels(spark):
    data = [(i, t) for i, (t, _) in enumerate(SIBLINGS)]
    got = {r.doc_id: r.labels for r in ls.scan_licenses(docs(spark, data)).collect()}
    assert [(t, got[i]) for i, t in data] == SIBLINGS


_B64 = ["MIIEpAIBAAKCAQEA7" + "bQ+/zX9kLmN4" * 3 + f"{k}aZ" for k in range(4)] + ["Qw3rTy=="]
_PEM = "-----BEGIN {0}-----\n{1}\n-----END {0}-----"
KEYS = [
    _PEM.format("RSA PRIVATE KEY", "\n".join(_B64)), _PEM.format("PRIVATE KEY", "\r\n".join(_B64)),
    _PEM.format("ENCRYPTED PRIVATE KEY", "\n".join(_B64)),
    _PEM.format("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n"
                + "\n".join(_B64)),
    _PEM.format("PGP PRIVATE KEY BLOCK", "Version: a-b -- c\n\n" + "\n".join(_B64) + "\n=aB3d"),
    _PEM.format("EC PRIVATE KEY", "\n".join(_B64)).replace("\n", "\\n"),
    _PEM.format("OPENSSH PRIVATE KEY", "\n".join(_B64)).replace("\n", " "),
    "---- BEGIN SSH2 ENCRYPTED PRIVATE KEY ----\n" + "\n".join(_B64)
    + "\n---- END SSH2 ENCRYPTED PRIVATE KEY ----",
    # no END
    "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(_B64),
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + "\n".join(_B64),
    "-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n" + "\n".join(_B64) + "\n=aB3d",
    "-----BEGIN PRIVATE KEY-----\\n" + "\\n".join(_B64),
]


def test_private_keys_are_covered_whole(spark):
    data = [(i, f"before it\n{k}\nAfter this, more.") for i, k in enumerate(KEYS)]
    data += [(50, KEYS[8] + "\n" + KEYS[0] + " and " + KEYS[3] + "\nlast words here")]
    data += [(51, "the banner -----BEGIN RSA PRIVATE KEY----- alone, no key")]
    got = {r.doc_id: r for r in ss.scan_secrets(docs(spark, data)).collect()}
    for i, k in enumerate(KEYS):
        assert ("private_key", 10, 10 + len(k)) in [tuple(s) for s in got[i].spans]
    text = {r.doc_id: r.text for r in ss.redact_documents(docs(spark, data)).collect()}
    for i in range(len(KEYS)):
        assert text[i] == "before it\n<SECRET>\nAfter this, more."
    assert text[50] == "<SECRET>\n<SECRET> and <SECRET>\nlast words here"
    assert text[51] == "the banner <SECRET> alone, no key"


def test_many_unfinished_keys_take_linear_time():
    import time
    at = time.perf_counter()
    for part in ("-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\nA: b\n" + "x" * 15,
                 "-----BEGIN PRIVATE KEY-----" + "- a" * 50):
        assert len(ss.Scanner(ss.EXTRA_RULES).scan([part * 20_000])[0]) == 20_000
    assert time.perf_counter() - at < 20


def test_long_templates_match_at_any_place(spark):
    long = " ".join(f"term{i}" for i in range(300))
    eighty = " ".join(f"word{i}" for i in range(80))
    templates = (("long", long), ("eighty", eighty))
    data = [(i, "x " * i + long.replace(" ", "\n" if i % 2 else " ") + " y" * i)
            for i in range(0, 200, 35)]
    data += [(1000 + i, "x " * i + eighty + " y" * 50) for i in range(0, 200, 35)]
    got = ls.scan_licenses(docs(spark, data), templates).collect()
    assert {(r.doc_id, r.labels, r.score) for r in got} == {
        (i, "long" if i < 1000 else "eighty", 1.0) for i, _ in data}


NOTICED = {**{text: label for label, text in ls.NOTICES},
           **{text: label for label, text in ls.TEMPLATES}}


@pytest.mark.parametrize("width", [30, 60, 76])
def test_every_notice_is_found_however_it_is_wrapped(spark, width):
    data = []
    for k, text in enumerate(NOTICED):
        wrapped = "\n * ".join(textwrap.wrap(text, width))
        data.append((k, f"/* some file\n * {wrapped}\n */ int main() {{ return {k}; }}"))
    got = {r.doc_id: r for r in ls.scan_licenses(docs(spark, data)).collect()}
    for k, label in enumerate(NOTICED.values()):
        # beside the phrases of the contract, which a lgpl notice holds too
        own = set(got[k].labels.split(",")) - (set(got[k].base_labels.split(",")) - {label})
        assert own == {label}, (label, got[k])


def test_identifiers_and_addresses(spark):
    cases = [("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: ISC\n", "isc"),
             ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
             ("# spdx-license-identifier: LGPL-2.1-only", "lgpl"),
             ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc-sa"),
             ("see https://creativecommons.org/licenses/by-sa/3.0/ for it", "cc-by-sa"),
             ("http://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
             ("SPDX-License-Identifier: EPL-2.0 OR Apache-2.0", "epl"),
             ("identifier of the license: SPDX is not MIT", ""),
             ("creativecommons org licenses are by nc and 4 0 in no order", "")]
    got = {r.doc_id: r for r in ls.scan_licenses(docs(spark, [
        (i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert [got[i].labels for i in range(len(cases))] == [want for _, want in cases]
    assert got[0].blocks[0].words == 4 and got[0].score == 1.0 and got[0].n_base == 0


def test_templates_from_a_table(spark):
    # whole texts, far longer than a block, with their labels
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    texts = {f"license-{k}": " ".join(rng.sample(words, 400)) for k in range(10)}
    table_ = spark.createDataFrame([*texts.items(), (None, "x"), ("none", None), ("empty", " ")],
                                   "label string, text string")
    templates = ls.templates_of(table_)
    assert dict(templates) == texts
    with pytest.raises(ValueError):
        ls.templates_of(table_, most=5)
    data = []
    for k, text in enumerate(texts.values()):
        w = text.split()
        for i in rng.sample(range(400), 40):        # a tenth of the words are others
            w[i] = "other"
        data.append((k, "before it\n" + "\n".join(textwrap.wrap(" ".join(w), 70)) + "\nafter"))
    data.append((99, " ".join(words[:300])))
    got = {r.doc_id: r.labels for r in ls.scan_licenses(docs(spark, data), templates).collect()}
    assert got == {**{k: f"license-{k}" for k in range(10)}, 99: ""}
