"""The ten operators against brute force, on hard small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import binary, chat, language, lines, mixing, neighbours, packing, setjoin, syncmers, toxicity
from twinsieve.llm.tokens import ChunkEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ord long, token string"


def words(g, n):
    return " ".join("".join(g.choice(["ba", "ko", "ri", "te", "mu", "sol", "ven"]) for _ in range(g.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    g = random.Random(7)
    base = [words(g, g.randint(20, 120)) for _ in range(12)]
    texts = [None, "", "   \n ", "one", "one", "a b c d", *base, *base[:4]]
    for t in base:
        w = t.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(g.randint(1, 3)):
                v[g.randrange(len(v))] = words(g, 1)
            texts.append(" ".join(v))
    texts += ["\n".join([base[0], base[1], "", words(g, 30)]), "\n".join([base[1], base[2].upper(), words(g, 5)]), words(g, 6000), "İ Σας\t　x\x1c\ny é"]
    rows = [(i, t, "xx" if i % 5 else None, None if i % 7 == 0 else f"s{i % 3}" if i % 2 else "s0", len(t or ""), 1, 2, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(docs):
    return docs.filter("doc_id < 0")


def test_mix(docs):
    out = mixing.mix_rates(docs)
    rows = out.collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size
    total = sum(size.values())
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 2 * r["size"]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    left, cap = dict(zip(names, [5, 2, 1] * 9, strict=False)), {s: 2 * sum(r["size"] for r in by[s]) for s in names}
    target, rest = {}, 1.5 * total
    while left:
        over = [s for s in left if left[s] * rest / sum(left.values()) > cap[s]]
        if not over:
            target |= {s: left[s] * rest / sum(left.values()) for s in left}
            break
        for s in over:
            target[s] = cap[s]
        rest = 1.5 * total - sum(target.values())
        left = {s: w for s, w in left.items() if s not in target}
    for s in names:
        assert by[s][0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r["size"] for r in by[s])
    assert sorted(map(tuple, mixing.mix_rates(docs).collect())) == sorted(map(tuple, rows))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mix_rates(empty(docs)).count() == 0


@pytest.mark.parametrize("share", [0.4, 1.8])
def test_mix_with_a_very_long_document(spark, share):
    short = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source"))
    long = spark.range(30000, 30001).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 5000).alias("text"), F.lit("s").alias("source"))
    both = short.unionByName(long)
    got = mixing.mix_rates(both, weights=(1,), share=share).agg(F.sum("taken"), F.sum(F.col("rate") * F.col("size"))).first()
    assert got[1] == pytest.approx(share * 35000, rel=1e-6) and abs(got[0] - share * 35000) <= 1
    with pytest.raises(RuntimeError, match="no mix"):
        mixing.mix_rates(both, weights=(1,), share=share, newton_steps=2)


def _components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("most", "block"), [(2, 3), (4, 2048), (1000, 2048)])
def test_set_join(docs, monkeypatch, most, block):
    monkeypatch.setattr(setjoin, "LIST", most)
    monkeypatch.setattr(setjoin, "BLOCK", block)
    sets = {}
    for r in docs.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similarity_classes(docs).collect()}
    of = _components(sets, 80)
    assert got == {i: (len(sets[i]), of[i]) for i in sets}
    kept = setjoin.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in of if of[i] == i}
    assert setjoin.similarity_classes(empty(docs)).count() == 0


def test_lines(docs):
    at = {(r.doc_id, k): x for r in docs.collect() for k, x in enumerate((r.text or "").split("\n")) if r.text and x.strip(" \t\n\x0b\x0c\r")}
    n = lines.SHINGLE
    distinct = sorted(set(at.values()))
    sets = {i: {x.lower()[k : k + n] for k in range(max(1, len(x) - n + 1))} for i, x in enumerate(distinct)}
    of = _components(sets, 80)
    number = {x: of[i] for i, x in enumerate(distinct)}
    first = {}
    for p in sorted(at):
        first.setdefault(number[at[p]], p)
    got = {(r.doc_id, r.line_no): ((r.first_doc_id, r.first_line_no), r.kept) for r in lines.line_classes(docs).collect()}
    assert set(got) == set(at) and all((got[p][0] == p) == got[p][1] for p in at)
    assert all(number[at[got[p][0]]] == number[x] for p, x in at.items())  # nothing joined that is not alike
    assert sum(got[p][0] == first[number[x]] for p, x in at.items()) >= 0.98 * len(at)
    out = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    for r in docs.collect():
        keep = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in got or got[r.doc_id, k][1])
        assert out[r.doc_id].text == keep and out[r.doc_id].source == r.source
    assert lines.line_classes(empty(docs)).count() == 0


def test_blank_lines_stay(spark):
    t = spark.createDataFrame([(1, "a line\n\t\n \n\t"), (2, "\t\nA LINE\n")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(t).collect()} == {1: "a line\n\t\n \n\t", 2: "\t\n"}


def test_many_variants_of_a_line(spark):
    """Groups whose lines are about as alike as the threshold: pivots rule pairs out, no link is lost."""
    g = random.Random(12)
    rows = []
    for _ in range(3):
        base = words(g, 40).split(" ")
        for _ in range(60):
            v = list(base)
            for _ in range(g.randint(1, 8)):
                v[g.randrange(len(v))] = words(g, 1)
            rows.append(" ".join(v))
    n = lines.SHINGLE
    sets = {i: {x[k : k + n] for k in range(len(x) - n + 1)} for i, x in enumerate(rows)}
    of = _components(sets, 80)
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in lines.line_classes(table).collect()}
    assert all(of[got[i]] == of[i] for i in of) and sum(got[i] == of[i] for i in of) >= 0.97 * len(of)


def test_lines_with_one_changed_character(spark):
    g = random.Random(5)
    rows, like = [("Ab", 0), ("aB", 0)], {0}
    for k in range(1, 150):
        x = "".join(g.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(g.randint(20, 100))).strip().ljust(20, "z")
        at = g.choice([0, len(x) - 1, g.randrange(len(x))])
        y = x[:at] + "7" + x[at + 1 :]
        a, b = ({z[i : i + 5] for i in range(len(z) - 4)} for z in (x, y))
        like |= {k} if 100 * len(a & b) >= 80 * len(a | b) else set()
        assert k in like or len(x) < 49
        rows += [(x, k), (y, k)]
    table = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    got = {rows[r.doc_id][1] for r in lines.line_classes(table).filter("not kept").collect()}
    assert got <= like and len(got) >= 0.98 * len(like)


def test_bands_of_short_lines(spark):
    g = random.Random(6)
    rows = []
    for k in range(4000):  # 5 shingles in the union, 4 shared
        x = "".join(chr(0x4E00 + g.randrange(20000)) for _ in range(9))
        rows += [(k, 2 * k, x), (k, 2 * k + 1, x[:8])]
    table = spark.createDataFrame(rows, "pair long, line_id long, line string")
    signs = lines.signatures(table)
    keys = signs.select(F.floor(F.col("line_id") / 2).alias("pair"), F.explode(F.array(*[f"k{b}" for b in range(lines.BANDS)])).alias("key"))
    met = keys.groupBy("pair", "key").count().filter("count > 1").select("pair").distinct().count()
    assert met >= 0.98 * 4000


def test_rows_without_an_id_of_their_own(spark):
    x, p, q, z, y, r, w, v = (c * 12 + f" line {c}" for c in "xpqzyrwv")
    a, b = "\n".join([x, p, q, z]), "\n".join([y, z, r, w])
    table = spark.createDataFrame([(None, a), (None, b), (7, v), (7, v), (7, x + "\n" + q + "!")], "doc_id long, text string").repartition(3)
    out = [t.text for t in lines.dedup_lines(table).collect()]
    assert len(out) == 5 and sorted(t for d in out for t in d.split("\n") if t) in (sorted([*(x, p, q, z, y, r, w, v)]), sorted([*(x, p, z, y, r, w, v), q + "!"]))
    assert lines.line_classes(table).filter("kept").count() == 8
    g = random.Random(8)
    c = words(g, 80)
    rows = [(None, c), (None, c + " ba"), (None, words(g, 60)), (None, words(g, 60)), (3, words(g, 50)), (3, words(g, 50)), (4, c + " ko"), (5, "one"), (5, "one")]
    rows += [(None, d := words(g, 70)), (None, d + " sol")]
    got = [tuple(t) for t in setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == 7 and set(got) - set(rows[9:]) == set(rows[2:8]) and len(set(got) & set(rows[9:])) == 1


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_equal_the_library(name, spaced):
    g = random.Random(1)
    alphabet = list("ab cE1  \n\n'.,!?~s\tté漢😀́İΣς$%　\x1c") + ["<|endoftext|>", "the ", "word, "]
    texts = ["".join(g.choice(alphabet) for _ in range(g.randint(0, 40))) for _ in range(3000)]
    encoder = ChunkEncoder(public_tokenizers.path(name), keeps_space=spaced, entries=500)
    for i in range(0, len(texts), 300):
        assert encoder.encode_many(texts[i : i + 300]) == [encoder.whole(t) for t in texts[i : i + 300]]


def test_binary(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = binary.write_packed(docs, path, f"file://{tmp_path}/out", block_ids=64)
    start = 0
    rows = {r.doc_id: r for r in binary.read_packed(manifest).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (rows[r.doc_id].start, rows[r.doc_id].ids) == (start, bytearray(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert binary.read_packed(binary.write_packed(empty(docs), path, f"file://{tmp_path}/none")).count() == 0
    for bits in (1, 5, 16, 17):
        ids = np.random.default_rng(0).integers(0, 1 << bits, 1001).astype(np.uint32)
        assert (binary.unpack_bits(binary.pack_bits(ids, bits), bits, 1001) == ids).all()


def test_pack(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, pieces = Tokenizer.from_file(path), packing.pack_documents(docs, path, length=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in sorted(by_doc[r.doc_id], key=lambda p: p.start)) == ids
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == list(np.cumsum([0] + [p.length for p in s])[:-1])
        n = sum(p.length for p in s)
        assert n == 256 or n & (n - 1) == 0 and n < 256
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_neighbours(spark):
    g = np.random.default_rng(4)
    v = g.standard_normal((400, 12)).round(2)
    v[100:130] = v[50]
    rows = [(i, x.tolist(), "t") for i, x in enumerate(v)] + [(900, None, ""), (950, [0.0] * 12, ""), (1000, [float("nan")] * 12, ""), (1050, [None] * 12, "")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    got = defaultdict(list)
    for r in neighbours.nearest(t, t.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 50))
    hit = 0
    for q, found in got.items():
        c = (v * v[q]).sum(1) / np.sqrt((v * v).sum(1) * (v[q] ** 2).sum())
        best = [i for i in np.lexsort((np.arange(400), -c.round(12))) if i != q][:5]
        hit += len({i for i, _ in found} & set(best))
        assert len(found) == 5 and all(abs(s - c[i]) < 1e-12 for i, s in found)
    assert hit >= 0.9 * 5 * len(got)
    assert neighbours.nearest(t.filter("vec_id < 0"), t.filter("vec_id < 0")).count() == 0
    q = t.filter("vec_id = 50")
    again = neighbours.nearest(t.unionByName(q), q.unionByName(q).unionByName(t.filter("vec_id = 0").withColumn("vec_id", F.lit(50).cast("long")))).collect()
    assert len(again) == 10 and len({(r["rank"], r.vec_id) for r in again}) == 10  # one query repeated, and another one of its id


def test_syncmers(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = [r.text or "" for r in rows]
    got = {r.doc_id: r for r in syncmers.fingerprint_pairs(docs).collect()}
    for i, r in enumerate(rows):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        out = got[r.doc_id]
        assert (out.n_chars, out.edited_sha256, out.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.fingerprints([t])[0])
        assert out.edited_fingerprint == syncmers.fingerprints([edited])[0] and 0 <= out.near_next <= 1
    for s, k in ((4, 8), (3, 9)):
        code = np.random.default_rng(1).integers(0, 4, 200).astype(np.uint64)
        h = [int(x) for x in syncmers._rolling(code + np.uint64(1), s)]
        want = [i for i in range(200 - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]
        text = "".join(map(chr, code.tolist()))
        f = syncmers.fingerprints([text], None, k, s)[0]
        whole = syncmers._rolling(code + np.uint64(1), k) >> np.uint64(24)
        assert {e.split(":")[0] for e in f.split(",")} == {f"{int(whole[i]):010x}" for i in want}
    assert syncmers.fingerprint_pairs(empty(docs)).count() == 0
    g = random.Random(4)
    for n in (200, 255, 257, 300):  # near copies on both sides of any length
        a = "".join(g.choice("abcdefghij ") for _ in range(n))
        b = a[: n // 2] + a[n // 2 + 2 :]
        x, y = syncmers.fingerprints([a, b])
        assert syncmers.likeness(x, y, len(a), len(b)) > 0.5


def test_syncmers_of_repeated_and_null_ids(spark):
    rows = [(None, "one two three " * 9), (None, ""), (3, "four five six " * 9), (3, "four five six " * 9), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = syncmers.fingerprint_pairs(table).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)


def test_chat(spark):
    g = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\", "a", "\n", "é"]
    rows = []
    for c in range(60):
        first = "hello" if c % 3 else "".join(g.choice(bits) for _ in range(4))
        for t in range(g.randint(1, 5)):
            rows.append((c, t, "assistant" if t % 2 else "user", first if t == 0 else None if g.random() < 0.1 else "".join(g.choice(bits) for _ in range(6)), 0))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path int").repartition(5)
    trees = chat.format_trees(table, sequence_chars=200).cache()
    got = {r.conv_id: r for r in chat.read_trees(trees).collect()}
    assert set(got) == set(range(60))
    for c in range(60):
        said = [(r[2], r[3] or "") for r in rows if r[0] == c]
        answers = "".join(x for role, x in said if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(said), len(answers), hashlib.sha256(answers.encode()).hexdigest())
    for r in trees.collect():
        for n in r.nodes:
            assert n.position == sum(a.end - a.start for a in n.ancestors)
        assert len(r.nodes) == len({(n.parent, r.text[n.start : n.end]) for n in r.nodes})
    assert trees.selectExpr("sum(length(text))").first()[0] < sum(r.formatted_chars for r in got.values())
    assert chat.format_trees(table.filter("conv_id < 0")).count() == 0


def test_toxicity(spark):
    g = random.Random(2)
    texts, y = [], []
    for i in range(240):
        t = words(g, g.randint(3, 150)).split(" ")
        if i % 3 == 0:
            t[g.randrange(len(t))] = g.choice(["grumble", "snarl"]) + g.choice(["", "ing", "s"])
        texts.append(" ".join(t))
        y.append(int(i % 3 == 0))
    rows = [(i, t, 0.0) for i, t in enumerate(texts)] + [(900, None, 0.0), (901, "", 0.0), (902, " ?! ", 0.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(list(enumerate(y)) + [(5000, 1), (5001, None)], "doc_id long, toxic int")
    net = toxicity.train(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(table, net).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(y[i]) for i in held]) >= 0.9
    assert got[900] == got[901] == got[902] == net.base < 0.5
    long = " ".join([words(g, 3000), "snarling", words(g, 3000)])
    assert net.score([long])[0] == max(net.score([long, ""])) and net.score([long])[0] >= 0.5
    w = toxicity.Words(["x y z " * 30])
    index, _ = w.windows()
    assert index.shape[1] == toxicity.SPAN and (index >= 0).any(axis=1).all() and sum((index >= 0).sum(axis=1)) >= 90


def test_gradients():
    """Each weight's gradient against a central difference, through both directions and the attention."""
    g = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    said = toxicity.Words(["one two three four five", "six seven one"])
    index, _ = said.windows()
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        logit = net.forward(net.inputs(said)[0], index)
        return float((np.logaddexp(0, logit) - y * logit).mean())

    grad = net.gradients(said, index, y, weight)
    for k, d in grad.items():
        flat, seen = net.p[k].reshape(-1), np.flatnonzero(np.abs(d.reshape(-1)) > 1e-6)
        for i in g.choice(seen, min(4, len(seen)), replace=False):
            old, step = flat[i], 1e-4
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(d.reshape(-1)[i], rel=0.02, abs=2e-6), k


def test_language(spark, docs):
    g = random.Random(9)
    make = {"en": "the of and to in is that it was for".split(), "de": "der die und zu den das nicht von sie ist".split()}
    say = lambda k, n: " ".join(g.choice(make[k]) for _ in range(n))
    known = spark.createDataFrame([(i, say(k, 60), k, f"h{i % 4}", 0) for i, k in enumerate(["en", "de"] * 40)], "doc_id long, text string, lang string, source string, n_trigrams int")
    rows = [(i, f"http://{k}{i % 3}.site.{'de' if k == 'de' else 'com'}/p", f"<html lang='{k}'><p>{say(k, 40)}</p>") for i, k in enumerate(["en", "de"] * 20)]
    rows += [(100, None, None), (101, "http://de1.site.de/x", "<html lang=de><p>der die</p>"), (102, "x", "<p>12345</p>")]
    got = {r.page_id: r for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), known).collect()}
    assert all(got[i].lang == k and not got[i].rejected for i, k in enumerate(["en", "de"] * 20))
    assert got[100].rejected and got[102].rejected and got[101].lang == "de" and len(got) == 43
    kept = language.keep_known(known.unionByName(known.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(999).cast("long"))))
    assert kept.columns == known.columns and {r.doc_id for r in kept.collect()} == set(range(80))
    assert language.keep_known(known.filter("doc_id < 0")).count() == 0
    plain = [(0, "a", "alone"), (1, "a", None), *[(i, say("de", 12), None if i % 2 else "busy") for i in range(2, 20)]]
    model = language.fit(known)
    scored = language.text_evidence(spark.createDataFrame(plain, "id long, text string, host string"), "text", model, ["id", "host"])
    fused = language.fuse(scored, model[0], declared=None, suffix=None, host="host", domain=None).collect()
    told = {r.id: (r.detected, round(r.score, 9)) for r in fused}
    assert told[0] == told[1]  # a host that no other row has is evidence of nothing, and so is none
    many = spark.createDataFrame([(i, f"{chr(0x100 + i)}{chr(0x180 + i)}{chr(0x200 + i)} " * 30, f"l{i:02d}") for i in range(70)], "doc_id long, text string, lang string")
    assert len(language.fit(many)[0]) == 70
    assert language.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), known).count() == 0
    assert language.keep_known(docs).count() <= docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mix_sources", "pack"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() and "sequence_id" in out.columns


def test_pairs_that_a_pivot_rules_out_are_not_made(spark, monkeypatch):
    """Variants of a line that are seldom alike: the join makes few of the pairs of a bucket, and no link is lost."""
    g = random.Random(21)
    base, rows = words(g, 120).split(" "), []
    for _ in range(120):
        v = list(base)
        for _ in range(g.randint(2, 22)):
            v[g.randrange(len(v))] = words(g, 1)
        rows.append(" ".join(v))
    n = lines.SHINGLE
    sets = {i: {x[k : k + n] for k in range(len(x) - n + 1)} for i, x in enumerate(rows)}
    of, made, cut = _components(sets, 80), [], lines.Scratch.cut

    def counted(self, df, label, release=False):
        out = cut(self, df, label, release)
        if label == "line-crossing":
            made.append(out.count())
        return out

    monkeypatch.setattr(lines.Scratch, "cut", counted)
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in lines.line_classes(table).collect()}
    assert all(of[got[i]] == of[i] for i in of) and sum(got[i] == of[i] for i in of) >= 0.97 * len(of)
    assert made[0] < 120 * 4


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_a_met_run_is_not_cut_again_and_tasks_share_an_encoder(name, spaced):
    import public_tokenizers

    from twinsieve.llm.tokens import encoder_of

    encoder = encoder_of(public_tokenizers.path(name), spaced)
    assert encoder is encoder_of(public_tokenizers.path(name), spaced)
    texts = ["One, two... three\n\n four  (five) x1 a.b,", " Été, naïve.\nà la carte ", "\n", "", "a <|endoftext|> b", "tab\there", "a\x1cb", "don't Stop."]
    assert encoder.encode_many(texts) == [encoder.whole(t) for t in texts]
    cut, encoder.chunks = encoder.chunks, None  # nothing of these texts is cut into chunks a second time
    try:
        assert encoder.encode_many(texts[:2] * 3) == [encoder.whole(t) for t in texts[:2] * 3]
    finally:
        encoder.chunks = cut


def test_cells_count_no_trigram_over_two_texts():
    from twinsieve.llm.packing import document_cells

    texts = [b"", b"a", b"ab", b"abc", b"", b"hello world, hello", b"x", b"yz", b"the end of it all"]
    assert document_cells(texts).tolist() == [document_cells([t])[0].tolist() for t in texts]


def test_sets_are_fetched_in_slices(spark, monkeypatch):
    """Many slices give the components of one; no table of sets or overlaps holds more than its slice."""
    from twinsieve.llm import setjoin

    g = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(12):
        base = g.choices(words, k=60)
        for j in range(4):
            text = base[:]
            text[g.randrange(60)] = "new"
            docs.append((i * 10 + j, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, setjoin.similarity_classes(df).collect()))
    sizes, cut = [], setjoin.Scratch.cut
    monkeypatch.setattr(setjoin, "SLICE", 12)
    monkeypatch.setattr(setjoin.Scratch, "cut", lambda self, t, label, release=False: (out := cut(self, t, label, release), label == "sets" and sizes.append(out.count()))[0])
    assert sorted(map(tuple, setjoin.similarity_classes(df).collect())) == want
    assert len(sizes) > 2 and sum(sizes) == len({t for _, t in docs}) > max(sizes)
