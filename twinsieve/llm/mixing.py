"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Every document gets a rate, the expected number of its copies in the mix. Among all rates
between 0 and `cap` that give each source its target number of words, entropy balancing takes
those that stray least from equal rates (Fermi-Dirac entropy, which keeps the bound `cap`):
an exponential tilt, rate = cap * e^z / (1 + e^z) with z = lambda[source] * size / scale[source].
The lambdas solve the convex dual, one equation a source, by Newton steps kept inside a bracket:
a step that leaves it, or gains too little, bisects it, and an open side is searched by doubling.
A step is one grouped aggregation of a histogram (source, size, documents), which is all the dual
depends on; documents are not read again. A source that misses its target after all steps raises.

Rates become whole copies by systematic rounding along the sizes of a source, a distributed
running sum, so that a source's words miss the target by about one document at most; two
passes then move one document a source to the other neighbour of its rate where that comes
closer to the target.

Defined cases: null or blank text has size 0 and gets no copies; a null source is a source of
its own, after all others; repeated rows are documents of their own; an empty table gives an
empty result; further columns of the input are ignored (`mix_rates`) or kept (`mix_documents`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, has_rows

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one task ranks at a time; more of one source and size are dealt to buckets.
BUCKET_ROWS = 1024


def word_count(text: Column) -> Column:
    """Number of words: the leading white space goes, then every word start follows a gap."""
    gaps = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), "  +", " ")
    trimmed = F.trim(gaps)
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources(source, source_size): adds weight and target.

    Sources by code point, null last, take the weights in turn. Targets are weight * theta up to
    cap * source_size; theta makes them add up to share * all sizes. In order of cap / weight the
    first source that theta does not reach settles theta, so resharing needs no loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(listed, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("rank", F.row_number().over(up))
        .withColumn("filled", F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("theta", (F.col("total") - F.coalesce("filled", F.lit(0.0))) / F.col("open"))
        .withColumn("settled", F.col("theta") <= F.col("level"))
        .withColumn("theta", F.min(F.when(F.col("settled"), F.struct("rank", "theta"))).over(everything)["theta"])
    )
    target = F.least("most", F.coalesce(F.col("theta") * F.col("weight"), F.col("most")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _solve(state: DataFrame, hist: DataFrame, cap: float, scratch: Scratch, most: int, tolerance: float) -> DataFrame:
    """Safeguarded Newton steps until every source meets its target; state(source, ..., scale, lam).

    The words got grow with lam, so each step closes the bracket (lo, hi) from one side.
    """
    state = state.withColumns({c: F.lit(None).cast("double") for c in ("lo", "hi", "last")})
    for _ in range(most):
        z = F.col("lam") * F.col("size") / F.col("scale")
        r = F.lit(cap) / (1 + F.exp(-z))
        words = F.col("n") * F.col("size")
        s = (
            hist.join(state.filter("open").select("source", "lam", "scale"), hist["source"].eqNullSafe(state["source"]))
            .groupBy(hist["source"].alias("of"))
            .agg(F.sum(words * r).alias("got"), F.sum(words * r * (1 - r / cap) * F.col("size") / F.col("scale")).alias("slope"))
        )
        miss = F.col("target") - F.col("got")
        live = F.col("open") & F.col("got").isNotNull() & (F.abs(miss) > F.greatest(F.col("target") * tolerance, F.lit(1e-9)))
        lo, hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss < 0, F.col("lam")).otherwise(F.col("hi"))
        far = F.greatest(F.lit(3.0), F.abs("lam"))
        step = F.greatest(-far, F.least(far, miss / F.greatest("slope", F.lit(1e-300))))
        newton, closed = F.col("lam") + step, lo.isNotNull() & hi.isNotNull()
        poor = (newton <= lo) | (newton >= hi) | F.coalesce(F.abs(miss) > F.col("last") / 2, F.lit(False))
        lam = F.when(closed & poor, (lo + hi) / 2).otherwise(newton)
        new = scratch.cut(
            state.join(s, state["source"].eqNullSafe(s["of"]), "left").select(
                "source", "source_size", "target", "scale", "full", F.when(live, lam).otherwise(F.col("lam")).alias("lam"), live.alias("open"),
                lo.alias("lo"), hi.alias("hi"), F.abs(miss).alias("last"),
            ),
            "mix-state",
        )
        scratch.drop(state)
        state = new
        if not has_rows(state.filter("open")):
            return state
    missed = [tuple(x) for x in state.filter("open").select("source", "target", "last").take(5)]
    raise RuntimeError(f"no mix within {most} steps; (source, target, words missed): {missed}")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").isNull(), "text").alias("h")


def _ordinal() -> Column:
    """Tells rows of a doc_id apart by the hash of their text, and exact repeats, which may stand for each other, by number."""
    return F.xxhash64("h", F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy("h")))


def mix_rates(
    docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2,
    newton_steps: int = 300, tolerance: float = 1e-9, repairs: int = 2,
) -> DataFrame:
    """docs(doc_id, text, source): doc_id, ord, source, size, source_size, target, rate, copies, taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_hash())
    sized = scratch.cut(sized.withColumn("ord", _ordinal()).drop("h"), "mix-sizes")
    hist = scratch.cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    sources = hist.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).alias("squares")
    )
    aimed = source_targets(sources, weights, share, cap)
    scale = F.greatest(F.lit(1.0), F.col("squares") / F.greatest(F.col("source_size"), F.lit(1)))
    ratio = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("target") / F.greatest(F.col("source_size") * F.lit(float(cap)), F.lit(1e-9))))
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12)
    a, b = aimed.alias("a"), sources.select(F.col("source").alias("of"), "squares").alias("b")
    state = scratch.cut(
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.of"))).select(
            "source", "source_size", "target", scale.alias("scale"), full.alias("full"), F.log(ratio / (1 - ratio)).alias("lam"), (~full).alias("open")
        ),
        "mix-state",
    )
    state = _solve(state, hist, float(cap), scratch, newton_steps, tolerance)

    # A rounded lambda: the sums above may differ in their last bits from run to run.
    z = F.round("lam", 7) * F.col("size") / F.col("scale")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(float(cap))).otherwise(F.lit(float(cap)) / (1 + F.exp(-z)))
    h, st = hist.alias("h"), state.alias("s")
    lots = (
        h.join(st, F.col("h.source").eqNullSafe(F.col("s.source")))
        .select("h.source", "size", "n", "source_size", "target", rate.alias("rate"))
        .withColumn("base", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("base"))
        .withColumn("before", F.sum(F.col("n") * F.col("part")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("before", F.coalesce("before", F.lit(0.0)))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    )
    lots = scratch.cut(lots, "mix-lots")
    d, g = sized.alias("d"), lots.alias("g")
    rows = d.join(g, F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.size") == F.col("g.size"))).select(
        "doc_id", "ord", "d.source", "d.size", "source_size", "target", "rate", "base", "part", "before", "buckets",
        F.xxhash64("doc_id", "ord").alias("draw"),
    )
    rows = rows.withColumn("bucket", F.pmod("draw", "buckets"))
    counts = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("skip", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    c = counts.alias("c")
    r = rows.alias("r")
    ranked = r.join(
        c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")) & (F.col("r.bucket") == F.col("c.bucket"))
    ).select("r.*", "skip")
    rank = F.col("skip") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id", "ord"))
    at = lambda k: F.floor(F.col("before") + k * F.col("part") + 0.5)
    ranked = ranked.withColumn("rank", rank)
    rounded = ranked.select(
        "doc_id", "ord", "source", "size", "source_size", "target", "rate", "base", "draw", (F.col("part") > 0).alias("free"),
        F.greatest(F.lit(0), F.least(F.lit(1), at(F.col("rank")) - at(F.col("rank") - 1))).cast("long").alias("extra"),
    )
    rounded = scratch.cut(rounded, "mix-rounded")
    scratch.drop(hist, lots, sized)
    for _ in range(repairs):
        new = scratch.cut(_repair(rounded), "mix-rounded")
        scratch.drop(rounded)
        rounded = new
    copies = F.col("base") + F.col("extra")
    return rounded.select(
        "doc_id", "ord", "source", "size", "source_size", F.col("target").cast("double"), "rate",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def _repair(rounded: DataFrame) -> DataFrame:
    """Move one document a source to the other whole neighbour of its rate, if that comes closer."""
    taken = (F.col("base") + F.col("extra")) * F.col("size")
    lots = rounded.groupBy("source", "size", "extra", "free").agg(
        F.min("target").alias("target"), F.sum(taken).alias("taken"), F.min("draw").alias("draw")
    )
    by_source = Window.partitionBy("source")
    lots = lots.withColumn("miss", F.col("target") - F.sum("taken").over(by_source))
    after = F.abs(F.col("miss") - F.when(F.col("extra") == 0, F.col("size")).otherwise(-F.col("size")))
    best = (
        lots.withColumn("after", after)
        .filter(F.col("free") & (F.col("after") < F.abs("miss")))
        .groupBy(F.col("source").alias("of"))
        .agg(F.min(F.struct("after", "size", "extra", "draw")).alias("move"))
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    hit = F.coalesce((F.col("size") == F.col("move.size")) & (F.col("extra") == F.col("move.extra")) & (F.col("draw") == F.col("move.draw")) & F.col("free"), F.lit(False))
    return (
        rounded.join(best, same, "left")
        .withColumn("extra", F.when(hit, 1 - F.col("extra")).otherwise(F.col("extra")))
        .select(*rounded.columns)
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of docs."""
    plan = mix_rates(docs, **options).filter("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("ord").alias("_ord"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    )
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    full = docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size"), _text_hash()).withColumn("_n", _ordinal())
    on = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("size") == F.col("_size")) & (F.col("_n") == F.col("_ord"))
    )
    return full.join(plan, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
