"""op11 to op13 against brute force, through the registered queries where a table can be written: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinsieve.llm import alignment, licenses, queries, whitening

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, groups string, n_a int, spans string, word string, pair int"


def rows_of(texts):
    return [(None if i % 9 == 8 else i // 2 * 2, t, "x", 1, "y", "z", 2) for i, t in enumerate(texts)]


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts():
    g = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "foo", "Bar", "é", "\xa0", "\u3000", "1234", "'s", ".", ", ", "<s>", "<|endoftext|>", "漢字", "🙂", "\r\n", "\x85", "e\u0301", "—", "Wort"]
    return [None, "", " ", "\n", "one", "one", "a▁b", "a▁b c. d", *["".join(g.choice(bits) for _ in range(g.randint(1, 60))) for _ in range(150)], "word, " * 4000, "x" * 5000]


def expected_alignment(texts):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    out, links = [], Counter()
    for t in texts:
        row = None
        if t and "▁" not in t:  # elsewhere both vocabularies give every byte back
            whole = f" {t}"
            ids = a.encode(whole, add_special_tokens=False)
            # byte ends of A from one more token at a time, of B from the pieces' own bytes
            ends_a = np.cumsum([len(alignment_bytes(a.id_to_token(i))) for i in ids.ids])
            bs = b.encode(t)
            ends_b = np.cumsum([1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in bs])
            assert ends_a[-1] == ends_b[-1] == len(whole.encode())
            starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
            pairs = [(x, y) for x, s, e in zip(ids.ids, starts_a, ends_a) for y, p, q in zip(bs, starts_b, ends_b) if s < q and p < e] if len(ids.ids) < 3000 else None
            if pairs is None:  # the long texts: a merge of the two lists
                pairs, i, j = [], 0, 0
                while i < len(ids.ids):
                    pairs.append((ids.ids[i], bs[j]))
                    i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
            cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
            spelt = ";".join(
                ",".join(str(x) for x, e in zip(ids.ids, ends_a) if p < e <= c) + "|" + ",".join(str(x) for x, e in zip(bs, ends_b) if p < e <= c) for p, c in zip([0, *cuts[:-1]], cuts)
            ) if len(cuts) < 500 else None
            row = (len(ids.ids), len(bs), len(cuts), pairs, spelt)
            links.update(pairs)
        out.append(row)
    return out, links


def alignment_bytes(token):
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [i for i in range(256) if i not in own]
    codes = {chr(i): i for i in own} | {chr(256 + k): i for k, i in enumerate(other)}
    return bytes(codes[c] for c in token)


def test_alignment_query(spark, tmp_path, texts):
    folder = table(spark, tmp_path, "documents", rows_of(texts), DOCS)
    got = queries.op11_token_alignment(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    said, links = expected_alignment(texts)
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    want = Counter()
    for (doc_id, *_), x in zip(rows_of(texts), said, strict=True):
        if x is None:
            want[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            sha = hashlib.sha256(x[4].encode()).hexdigest() if x[4] is not None else None
            want[doc_id, x[0], x[1], x[2], len(x[3]), sum(links[p] == most[p[1]] for p in x[3]), sum(links[p] for p in x[3]), sha] += 1
    long_ones = {k[:7] for k in want if k[7] is None}
    assert Counter((*r[:7], None) if tuple(r[:7]) in long_ones else tuple(r) for r in got.collect()) == want


def test_alignment_keeps_groups(spark):
    docs = spark.createDataFrame([(1, "Hello, worlds"), (2, None)], "doc_id long, text string")
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    rows = {r.doc_id: r for r in alignment.align_documents(docs, A_PATH, B_PATH).collect()}
    sides = [g.split("|") for g in rows[1].groups.split(";")]
    assert [int(i) for s, _ in sides for i in s.split(",")] == a.encode(" Hello, worlds").ids
    assert [int(i) for _, s in sides for i in s.split(",")] == b.encode("Hello, worlds")
    assert rows[2].groups == "" and rows[2].n_links == 0
    assert alignment.align_documents(docs.filter("doc_id > 5"), A_PATH, B_PATH).count() == 0


def test_overlaps_brute():
    g = np.random.default_rng(4)
    for _ in range(200):
        n = int(g.integers(1, 30))
        a, b = (np.append(np.flatnonzero(g.random(n - 1) < 0.4) + 1, n) for _ in range(2))
        first, last, spanned = alignment.overlaps(a, b)
        s, p = np.append(0, a[:-1]), np.append(0, b[:-1])
        for i in range(len(a)):
            assert list(range(first[i], last[i])) == [j for j in range(len(b)) if s[i] < b[j] and p[j] < a[i]]
        assert spanned.tolist() == [any(s[i] < p[j] < a[i] for i in range(len(a))) for j in range(len(b))]


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(8)
    x = (g.standard_normal((300, 20)) * np.linspace(0.05, 1, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist()), (900, x[3].tolist()), (None, x[5].tolist())] + [(1000 + i, x[0].tolist()) for i in range(150)]
    bad = [(2000, None), (2001, [*x[0, :19].tolist(), None]), (2002, [*x[0, :19].tolist(), float("nan")]), (2003, [*x[0, :19].tolist(), float("-inf")])]
    other = [(2004, [1.0, 2.0]), (2005, []), (2006, [0.5])]
    return rows, bad + other


SCHEMA = "vec_id long, embedding array<float>, x int, n string, whitened double, node int, dim int"


def test_whitening_query(spark, tmp_path, vectors):
    good, other = vectors
    folder = table(spark, tmp_path, "embeddings", [(*r, 1, "n", 0.5, 2, 3) for r in good + other], SCHEMA)
    out = queries.op12_whitening(spark, folder)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    x = np.floor(64 * np.array([r[1] for r in good], np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / n) @ (axes / np.sqrt(values))
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    deviation = {}
    for (i, _), d in zip(good, ((n * x - sums) ** 2).sum(axis=1).tolist(), strict=True):
        deviation.setdefault(i, set()).add(d)
    assert all(r.deviation in deviation[r.vec_id] for r in got)
    for k in range(16):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in got if r.component == k + 1)
        theirs = [(i is None, i or 0) for i, _ in good]
        best = min(max(abs(a[2] - b[2]) for a, b in zip(mine, sorted((*t, s * w) for t, w in zip(theirs, want[:, k], strict=True)), strict=True)) for s in (1, -1))
        assert best < 1e-8
        assert next(r.explained for r in got if r.component == k + 1) == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_whitening_edges(spark, vectors):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.fit_whitening(df([])) is None and whitening.fit_whitening(df(vectors[1][:4])) is None
    one = whitening.fit_whitening(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert one.n == 1 and len(one.values) == 0
    flat = df([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)])
    model = whitening.fit_whitening(flat)
    assert len(model.values) == 1 and model.explained[0] == pytest.approx(1)
    assert sorted(round(r.whitened[0] ** 2, 6) for r in whitening.whiten(flat, model).collect()) == sorted(round((i - 4.5) ** 2 / 8.25, 6) for i in range(10))
    huge = df([(i, [3e38 * (-1) ** i, float(i)]) for i in range(3)])
    assert {r.deviation for r in whitening.whiten(huge, whitening.fit_whitening(huge)).collect()} == {None}


def test_merged_states_equal_one_state():
    x = np.random.default_rng(2).integers(-50, 50, (200, 7))
    whole, parts = whitening.Moments(7), [whitening.Moments(7) for _ in range(4)]
    whole.add(x)
    whole.count(x)
    merged = whitening.Moments(7)
    for i, p in enumerate(parts):
        p.add(x[i * 50 : i * 50 + 50])
        p.count(x[i * 50 : i * 50 + 50])
        merged.merge(whitening.Moments.of(p.row()))
    assert merged.sums == x.sum(axis=0).tolist() and merged.n == 200
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-12) and np.allclose(whole.scatter / 200, np.cov(x.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 40])
def test_symmetric_qr(n):
    g = np.random.default_rng(n)
    for m in (np.cov(g.standard_normal((3 * n, n)).T, bias=True).reshape(n, n), np.zeros((n, n)), np.diag(np.arange(n) % 3.0), np.ones((n, n))):
        values, axes = whitening.symmetric_qr(m)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * max(1, n))
        assert np.allclose(m @ axes, axes * values, atol=1e-12 * max(1, n)) and np.allclose(axes.T @ axes, np.eye(n), atol=1e-12)


LICENSE_TEXTS = [
    None, "", " .,;\n", "All rights reserved.", "CC BY CC BY cc-by", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "mit license", "der Hund mit dem Ball",
    "This work is licensed under the GNU General Public License, version 3.", "GPLv2 or later", "SPDX-License-Identifier: MPL-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later", "İ all rıghts K reserved Straße 日本 all rights\u3000reserved",
    "Copyright (c) 2019 2020 by A. All rights reserved. All Rights Reserved", "see https://creativecommons.org/licenses/by-sa/4.0/ for CC BY-SA 4.0", "Released under the MIT license. Released under the MIT license.", "dual licensed: BSD 3-clause or Apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "license " * 3000, "copyright 2001 " * 800 + "all rights reserved", "x " * 20000 + "under the LGPL version 2.1",
]


def expected_license(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    spaced = "  " + "".join(f"{w}  " for w in words)
    begins, at = {}, 1
    for i, w in enumerate(words):
        begins[at] = i
        at += len(w) + 2
    ends = {b + len(words[i]) + 2: i for b, i in begins.items()}
    spans = [(begins[m.start()], ends[m.end()], r.tier, r.order, r.label) for r in licenses.rules() for m in re.finditer(f" (?:{licenses.words_pattern(r.pattern)}) ", spaced)]
    within = lambda x, y: y[0] <= x[0] and x[1] <= y[1]

    def gone(x):
        for y in spans:
            if y[2] and ((y[2] < x[2] and (within(x, y) or within(y, x))) or (y[2] == x[2] and within(x, y) and (not within(y, x) or y[3] < x[3]))):
                return True
        return False

    kept = [x for x in spans if not x[2] or not gone(x)] if len(spans) < 4000 else None
    return len(words), kept


def test_license_query(spark, tmp_path):
    folder = table(spark, tmp_path, "documents", rows_of(LICENSE_TEXTS), DOCS)
    got = queries.op13_license_rules(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = []
    for doc_id, text, *_ in rows_of(LICENSE_TEXTS):
        n, kept = expected_license(text)
        if kept is None:
            continue
        base = [x[0] for x in kept if not x[2]]
        names = lambda some: ",".join(sorted({x[4] for x in some}))
        want.append((doc_id, n, len(base), min(base, default=None), max(base, default=None), names([x for x in kept if not x[2]]), names(kept), max((licenses.WEIGHTS[x[2]] for x in kept), default=0.0)))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(LICENSE_TEXTS) and not Counter(want) - Counter(rows)
    labels = {r[6] for r in rows}
    assert {"cc-by,cc-by-nc-4.0", "apache-2.0", "gpl,gpl-3.0", "mpl-2.0", "mit", "gpl-2.0-or-later"} <= labels
    assert licenses.license_spans(spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")).count() == 0


def test_every_match_holds_a_keyword():
    """The prefilter loses nothing: strings made from a rule's pattern hold one of its keywords."""
    g = random.Random(1)

    def example(p):
        p = re.sub(r"\[cs\]", lambda _: g.choice("cs"), p).replace("~", "one two").replace("[a-z]+", "word")
        p = re.sub(r"\\d(\{4\})?\+?", lambda m: "2001" if m[1] else "1", p)
        inner = re.compile(r"\(([^()]*)\)([?+]|\{1,2\})?")
        while m := inner.search(p):
            p = p[: m.start()] + ("" if m[2] == "?" and g.random() < 0.5 else g.choice(m[1].split("|"))) + p[m.end() :]
        return re.sub(r"(.)\?", lambda m: g.choice((m[1], "")), p)

    for r in licenses.rules():
        assert r.keywords and all(r.keywords)
        for _ in range(8):
            text = example(r.pattern)
            assert re.fullmatch(licenses.words_pattern(r.pattern), text.replace(" ", "  ")), (r.pattern, text)
            assert any(k in text for k in r.keywords), (r.pattern, text, r.keywords)


def test_twin(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    folder = table(spark, tmp_path, "documents", rows_of([t for t in LICENSE_TEXTS if len(t or "") < 5000]), DOCS)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    said = db.execute(queries.oracle_sql()["op13_license_rules"]).fetchall()
    assert Counter(map(tuple, queries.op13_license_rules(spark, folder).collect())) == Counter(said)


def test_hot_copies_spread(spark):
    """Copies of one text share one row per pair and block, not per copy."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same words. in every row").alias("text"))
    rows = alignment.align_documents(docs, A_PATH, B_PATH).collect()
    assert len(rows) == 2000 and len({tuple(r[1:]) for r in rows}) == 1
