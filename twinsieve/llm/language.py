"""Language identification by Bayesian fusion of evidence.

Per row: the text's log-likelihood under each language (hashed character trigrams, multinomial,
tempered to at most `EVIDENCE` trigrams' worth because neighbouring trigrams are not
independent), the language its markup declares, its address suffix, and its host. How far a
declaration or a suffix can be trusted, and which languages a host serves, is learned from the
rows themselves: grouped sums of the text-only posteriors, over all rows. Host priors are
smoothed towards their domain's, and these towards the global one, by pseudo-counts; a row's own
posterior is left out of its host's and domain's sums.

Besides the languages of the labelled documents there is `und`, uniform over trigrams, for
text of no known language. A row is rejected if it has no letters, if `und` wins, or if the
winner's posterior is under one half.

The trigram tables are fitted on a bounded sample of labelled documents (`sample` a language,
those with the least hashes of doc_id by a threshold), for every language that occurs: languages *
SLOTS numbers. Everything else covers all rows.

Defined cases: null or empty text or host or declaration is evidence of nothing; rows without
any letters are rejected with score of their prior; repeated rows are scored alike; an empty
table gives no rows; further columns are kept (`keep_known`) or ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bound
from ..runtime import Scratch
from .tokens import in_batches

SLOTS, EVIDENCE, SAMPLE = 8192, 60, 1500
UND = "und"


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, lower-cased letters with one gap between words, and the row of each."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xDF) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x303F))
    flat = np.where(letter, codes, 32).astype(np.uint32)
    if len(flat) > 1:
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (row[1:] != row[:-1])
        flat, row = flat[keep], row[keep]
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = flat[:-2] * np.uint32(0x9E3779B1) ^ flat[1:-1] * np.uint32(0x85EBCA6B) ^ flat[2:] * np.uint32(0xC2B2AE35)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(19)
    inside = (row[:-2] == row[2:]) & ((flat[:-2] != 32) | (flat[1:-1] != 32)) & ((flat[2:] != 32) | (flat[1:-1] != 32))
    return h[inside].astype(np.int64), row[:-2][inside]


def fit(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages + und, SLOTS), from documents(doc_id, text, lang)."""
    known = documents.filter("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1, SLOTS))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = known.filter(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        total = np.zeros((len(langs), SLOTS), np.int64)
        for batch in batches:
            lang, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in in_batches(texts):
                h, row = _trigrams(texts[a:b])
                of = np.array([langs.index(x) for x in lang[a:b]], np.int64)
                total += np.bincount(of[row] * SLOTS + h, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    table = np.zeros(len(langs) * SLOTS)
    for r in chosen.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most languages * SLOTS rows
        table[r[0]] = r[1]
    table = table.reshape(-1, SLOTS) + 0.1
    p = np.vstack([table / table.sum(axis=1, keepdims=True), np.full((1, SLOTS), 1 / SLOTS)])
    return langs, np.log(p)


def text_evidence(rows: DataFrame, text: str, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns keep, n_trigrams, and ll: tempered log-likelihood of each language and und."""
    langs, logp = model
    table = np.ascontiguousarray(logp.T)  # one row a slot
    fields = {f.name: f for f in rows.schema.fields}
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    schema = StructType([*(fields[c] for c in keep), StructField("n_trigrams", LongType()), StructField("ll", ArrayType(DoubleType()))])

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in in_batches(texts):
                h, row = _trigrams(texts[a:b])
                n = np.bincount(row, minlength=b - a)
                ll = np.stack([np.bincount(row, table[h, j], minlength=b - a) for j in range(table.shape[1])], axis=1)
                ll = ll * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                part = batch.slice(a, b - a)
                kinds = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kinds, pa.array(n), pa.array(list(ll), pa.list_(pa.float64()))], names=[*keep, "n_trigrams", "ll"])

    return rows.select(*dict.fromkeys([*keep, text])).mapInArrow(score, schema)


def _posterior(ll: Column) -> Column:
    """Normalised exp of an array of log weights; each step is bound, so that it is computed once wherever this stands."""
    above = lambda v: bound(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda t: F.transform(e, lambda x: x / t))
    return bound(bound(ll, above), shares)


def fuse(
    scored: DataFrame, langs: list[str], *, declared: str | None, suffix: str | None, host: str | None, domain: str | None,
    host_weight: float = 8.0, domain_weight: float = 20.0, trust: float = 2.0,
) -> DataFrame:
    """Adds lang, score and rejected to rows of text_evidence."""
    names = [*langs, UND]
    n = len(names)
    # uniform prior but for und, which the language of a web text rarely is
    start = F.array(*[F.lit(float(np.log(0.02 if x == UND else 0.98 / max(1, n - 1)))) for x in names])
    soft = scored.filter("n_trigrams > 0").withColumn("_p", _posterior(F.zip_with("ll", start, lambda a, b: a + b)))
    sums = [F.sum(F.col("_p")[i]).alias(f"s{i}") for i in range(n)]
    cells = [F.col(f"s{i}") for i in range(n)]
    total = soft.agg(*sums, F.sum(F.lit(1.0)).alias("_rows"))
    t = total.first()  # one row
    rows = float(t["_rows"] or 0)
    base = [((t[i] or 0.0) + 1.0) / (rows + n) for i in range(n)]
    out = scored
    evidence = [F.col("ll"), F.array(*[F.lit(float(np.log(b))) for b in base])]

    def joined(left: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
        right = table.withColumnRenamed(key, f"_{column}_key")
        return left.join(right, F.col(key).eqNullSafe(F.col(f"_{column}_key")), "left").drop(f"_{column}_key")

    for key in (k for k in (declared, suffix) if k):
        # P(value | language), smoothed by the value's overall share
        counts = soft.groupBy(key).agg(*sums)
        share = reduce(lambda a, b: a + b, cells) / max(rows, 1.0)
        logs = F.array(*[F.log((cells[i] + trust * share) / (F.lit(base[i] * rows + trust)) / share) for i in range(n)])
        table = counts.filter(F.col(key).isNotNull() & (share > 0)).select(key, logs.alias(f"_{key}_ll"))
        out = joined(out, table, key, key)
        evidence.append(F.coalesce(F.col(f"_{key}_ll"), F.array(*[F.lit(0.0)] * n)))
    if host:
        # sums of the other rows of the host and of its domain: a row is no evidence of itself
        table = soft.filter(F.col(host).isNotNull()).groupBy(*dict.fromkeys([host, *([domain] if domain else [])])).agg(*sums)
        columns = [F.array(*cells).alias("_host_n")]
        if domain:
            up = table.groupBy(domain).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
            up = up.select(F.col(domain).alias("_up"), F.array(*cells).alias("_domain_n"))
            table = table.join(up, F.col(domain).eqNullSafe(F.col("_up")), "left").drop("_up")
            columns.append(F.col("_domain_n"))
        out = joined(out, table.select(host, *columns), host, "host")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        others = lambda c: F.zip_with(c, "_own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
        smooth = lambda c, p, w: bound(c, lambda v: bound(total(v), lambda t: F.zip_with(v, p, lambda x, y: (x + w * y) / (t + w))))
        base_array, flat = F.array(*[F.lit(float(b)) for b in base]), F.array(*[F.lit(0.0)] * n)
        own = F.when(F.col("n_trigrams") > 0, _posterior(F.zip_with("ll", start, lambda a, b: a + b))).otherwise(flat)
        out = out.withColumn("_own", own).withColumn("_host_n", others("_host_n"))
        prior = base_array
        if domain:
            out = out.withColumn("_domain_n", others("_domain_n"))
            prior = F.coalesce(smooth(F.col("_domain_n"), base_array, domain_weight), base_array)
        out = out.withColumn("_host_prior", smooth(F.col("_host_n"), prior, host_weight))
        logs = F.zip_with("_host_prior", base_array, lambda a, b: F.log(a) - F.log(b))
        evidence.append(F.when(F.col("_host_n").isNull(), flat).otherwise(logs))
    ll = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), evidence)
    best = lambda p, m: F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(p, m).cast("int"))
    told = bound(_posterior(ll), lambda p: bound(F.array_max(p), lambda m: F.struct(m.alias("score"), best(p, m).alias("detected"))))
    out = out.withColumn("_told", told).withColumn("score", F.col("_told.score")).withColumn("detected", F.col("_told.detected"))
    rejected = (F.col("n_trigrams") == 0) | (F.col("detected") == UND) | (F.col("score") < 0.5)
    return out.withColumn("rejected", rejected).drop("_told", "_own", "_host_n", "_domain_n", "_host_prior", *[f"_{k}_ll" for k in (declared, suffix) if k])


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, suffix, host, domain of pages(page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    text = html
    for pattern in (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"<[^>]*>", r"&\w+;"):
        text = F.regexp_replace(text, pattern, " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    full = F.when(host != "", host)
    return pages.select(
        "page_id", text.alias("text"), F.when(declared != "", declared).alias("declared"),
        F.when(host != "", F.substring_index(host, ".", -1)).alias("suffix"), full.alias("host"), F.substring_index(full, ".", -2).alias("domain"),
    )


def identify_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, host, declared, suffix, n_trigrams, lang, score, rejected of every page."""
    model = fit(documents)
    keep = ["page_id", "declared", "suffix", "host", "domain"]
    scored = Scratch(pages.sparkSession).cut(text_evidence(page_fields(pages), "text", model, keep), "page-evidence")
    out = fuse(scored, model[0], declared="declared", suffix="suffix", host="host", domain="domain")
    return out.select("page_id", "host", "declared", "suffix", "n_trigrams", F.col("detected").alias("lang"), "score", "rejected")


def keep_known(documents: DataFrame) -> DataFrame:
    """The documents that are not rejected: text, declared language `lang` and host `source` as evidence.

    The evidence is scored once into narrow rows; what is rejected leaves by an anti join on the
    rows' hashes, which needs no shuffle of texts while few are rejected.
    """
    columns = documents.columns
    model = fit(documents)
    row = documents.select(F.struct(*[documents[c] for c in columns]).alias("row"), "doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    told = ("doc_id", "text", "declared", "host")
    row = row.withColumn("key", F.xxhash64(*[c for n in told for c in (F.col(n).isNull(), F.col(n))]))  # a hash passes over nulls
    narrow = text_evidence(row, "text", model, ["key", "declared", "host"])
    scored = Scratch(documents.sparkSession).cut(narrow, "document-evidence")
    fused = fuse(scored, model[0], declared="declared", suffix=None, host="host", domain=None)
    gone = fused.filter("rejected").select(F.col("key").alias("_gone")).distinct()
    return row.join(gone, F.col("key") == F.col("_gone"), "left_anti").select("row.*")
