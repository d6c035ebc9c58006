"""Repeated and null ids through the registered queries and stages: nothing is lost, doubled or chosen anew on a second run."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import language, lines, mixing, queries, setjoin, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_neighbours_of_repeated_rows(spark, tmp_path):
    g = np.random.default_rng(5)
    x = g.standard_normal((120, 6)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [rows[7]] * 3 + [(8, x[9].tolist(), 0), (None, x[3].tolist(), 0)] + [(50, x[50].tolist(), 0)] * 2 + [(200 + i, x[11].tolist(), 0) for i in range(30)]
    folder = table(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    got = queries.op3_collision_counting(spark, folder).collect()
    for q in (0, 50, 100, 200):
        v = np.array(next(r[1] for r in rows if r[0] == q))
        near = sorted(((float(-(v @ np.array(u)) / (np.linalg.norm(v) * np.linalg.norm(u))), i is None, i or 0) for i, u, _ in rows if i != q))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert [m[2] for m in mine] == pytest.approx([-n[0] for n in near], abs=1e-9)
    assert sorted(map(str, got)) == sorted(map(str, queries.op3_collision_counting(spark, folder).collect()))


def test_rejected_rows_take_no_other_along(spark):
    plain = "the people of the town went to the market and the river "
    rows = [(i, plain * 3, "en", "s", 1) for i in range(20)] + [(50, "zzqx 99 --", None, "en", 1), (50, "zzqx 99 --", "en", None, 1), (None, plain, None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = Counter(map(tuple, language.keep_known(docs).collect()))
    key = lambda r: r
    assert all(kept[key(r)] in (0, Counter(rows)[r]) for r in rows) and kept[rows[0]] == 1
    told = docs.select(*[F.xxhash64(*[c for n in ("doc_id", "text", "lang", "source") for c in (F.col(n).isNull(), F.col(n))])]).distinct().count()
    assert told == len(set(rows))


def test_mix_of_ids_that_repeat(spark):
    rows = [(1, f"w{i} x y", "en", "a", 0) for i in range(30)] + [(None, f"v{i} x", "en", "b", 0) for i in range(30)] + [(2, "same text", "en", None, 0)] * 10
    docs = spark.createDataFrame(rows, DOCS)
    rates = mixing.mix_rates(docs).collect()
    assert Counter(r.doc_id for r in rates) == {1: 30, None: 30, 2: 10}
    one, two = (Counter(map(tuple, mixing.mix_documents(docs.repartition(n)).collect())) for n in (3, 7))
    assert one == two and sum(one.values()) == sum(r.copies for r in rates)
    assert all(n <= 2 * Counter(rows)[r] for r, n in one.items())


def test_toxicity_query_on_hard_labels(spark, tmp_path):
    bad, good = "you are a rotten awful fool ", "the quiet garden was lovely today "
    rows = [(i, (bad if i % 3 == 0 else good) * 3, "en", "s", 1) for i in range(60)] + [(0, good, "en", "s", 1)] * 5 + [(61, None, "en", "s", 1), (62, "", "en", "s", 1), (None, bad, "en", "s", 1)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(1, 1, 1), (1, 1, 0), (2, None, None), (999, 1, 1)]
    folder = table(spark, tmp_path, "documents", rows, DOCS)
    table(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    got = queries.op2_toxicity(spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one_class = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    flat = toxicity.train(docs, one_class)
    assert flat.base < 0.5 and all(r.score == pytest.approx(flat.base, abs=1e-6) for r in toxicity.score_documents(docs, flat).collect())
    assert toxicity.score_documents(docs.filter("doc_id > 5000"), toxicity.train(docs.filter("doc_id > 5000"), one_class)).count() == 0


def test_lines_join_a_large_component_without_pairs(spark, monkeypatch):
    """Lines that are like many of a large component, found by their common pivot: the join makes few pairs, and no link is lost."""
    import random

    g, made, cut = random.Random(8), [], lines.Scratch.cut
    word = lambda: "".join(g.choice("abcdefghijklmnopqrst") for _ in range(g.randint(3, 8)))
    base, rows = [word() for _ in range(80)], []
    for k in range(400):
        v = list(base)
        for _ in range(g.randint(1, 3) if k < 250 else 8):
            v[g.randrange(len(v))] = word()
        rows.append(" ".join(v))
    n = lines.SHINGLE
    sets = [{x[k : k + n] for k in range(len(x) - n + 1)} for x in rows]
    of = list(range(len(rows)))
    root = lambda i: i if of[i] == i else root(of[i])
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 180 * shared >= 80 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root(i), root(j)))
                of[b] = a

    def counted(self, df, label, release=False):
        out = cut(self, df, label, release)
        if label == "line-crossing":
            made.append(out.count())
        return out

    monkeypatch.setattr(lines.Scratch, "cut", counted)
    got = {r.doc_id: r.first_doc_id for r in lines.line_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    wrong = [i for i in got if root(got[i]) != root(i)]
    assert not wrong and sum(got[i] == root(i) for i in got) >= 0.97 * len(got)
    assert not made or made[0] < 400


def test_sets_are_kept_as_texts(spark, monkeypatch):
    """The table of sets that are compared takes less than their shingles, eight bytes each, and the components are right."""
    import pathlib
    import random

    g, cut, sizes = random.Random(4), setjoin.Scratch.cut, []
    vocabulary = ["".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = []
    for i in range(60):
        texts.append(" ".join(g.choice(vocabulary) for _ in range(3000)) if i % 3 == 0 else texts[-1] + f" end{i}")

    def counted(self, df, label, release=False):
        out = cut(self, df, label, release)
        if label == "sets":
            bytes_ = sum(pathlib.Path(f.split("://")[-1].removeprefix("file:")).stat().st_size for f in out.inputFiles())
            sizes.append((bytes_, 8 * out.agg(F.sum("n")).first()[0]))
        return out

    monkeypatch.setattr(setjoin.Scratch, "cut", counted)
    got = setjoin.similarity_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 3 for i in range(60)}
    assert sizes and sum(s for s, _ in sizes) < 0.25 * sum(n for _, n in sizes)
