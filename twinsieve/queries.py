"""The reference operators as queries over the graded tables, each with its SQL twin in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import catalogue as C
from .operators import changes as D
from .operators import grouping as G
from .operators import listings as L
from .operators import matching as M
from .operators import tables as T
from .operators.components import connected_components
from .operators.decoding import decode_frames, probe_files
from .operators.numbering import dispatch_order, lane_tasks
from .operators.probe import parse_probe
from .plans import actions as P
from .runtime import Scratch, scratch_path
from .sinks import exports as E
from .sinks.versions import Catalogue
from .sources.assets import assets, items, pick
from .sources import schemas as H
from .sources.listing import list_files
from .sources.samples import file_digests, write_files
from .streaming import progress as S
from .streaming.microbatch import deduped_events
from .streaming.state import failure_stream, incremental_stream, ordered_stream, run_to_table

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing frames is the only costly projection, so its result is a table."""
    return Scratch(spark).cut(items(_t(spark, sf_dir, "documents")), "items")


def _members(spark: SparkSession, sf_dir: str, strategy: str = "best") -> DataFrame:
    i = _items(spark, sf_dir)
    return G.group_met(i, Scratch(spark).cut(M.met_items(i), "met"), strategy)


@query
def dup_groups_report(s, d):
    return G.group_report(_members(s, d))


@query
def block_buckets(s, d):
    return M.bucketed(assets(_t(s, d, "documents"))).groupBy("bucket", "aspect").agg(F.count("*").alias("n"))


@query
def block_pairs_off(s, d):
    return M.block_pairs(assets(_t(s, d, "documents")), 8.0, "off")


@query
def block_pairs_any(s, d):
    return M.block_pairs(assets(_t(s, d, "documents")), 8.0, "any_aspect")


def _gated(mode: str) -> Query:
    def f(s, d):
        return M.block_pairs(assets(_t(s, d, "documents")), 8.0, mode, gated=True)

    return f


def _edges(**options) -> Query:
    return lambda s, d: M.edges(_items(s, d), **options).select("file_a", "file_b", "score", "match_reason")


for _mode in ("off", "same_aspect", "any_aspect"):
    _found[f"candidate_gate_{_mode}"] = _gated(_mode)
for _profile in ("conservative", "balanced", "aggressive"):
    _found[f"edges_{_profile}"] = _edges(profile=_profile)
_found["edges_custom"] = _edges(profile="custom", custom=0.29)
_found["edges_no_audio_any_aspect"] = _edges(audio=False, mode="any_aspect")


@query
def edges_trimmed(s, d):
    return M.close_edges(_items(s, d)).filter("match_reason = 'trimmed_match'").select("file_a", "file_b", "score", "gap_s")


@query
def edges_audio_rescue(s, d):
    return M.audio_edges(_items(s, d)).select("file_a", "file_b", "score")


@query
def pair_distances(s, d):
    return M.pair_distances(_items(s, d), 5.0, "off")


@query
def match_stats(s, d):
    return M.match_stats(_items(s, d))


@query
def frame_hashes(s, d):
    return assets(_t(s, d, "documents")).select("file_id", "hashes", X.encode_hashes(F.col("hashes")).alias("encoded"), (X.decode_hashes(X.encode_hashes(F.col("hashes"))) == F.col("hashes")).alias("round_trip"))


@query
def components(s, d):
    return connected_components(Scratch(s).cut(M.met_items(_items(s, d)), "met"), "file_id", "root")


@query
def lane_components(s, d):
    """Roots (suppliers) that share a disk token (nation or balance band) are one lane."""
    sup = _t(s, d, "supplier")
    tokens = sup.select("s_suppkey", F.explode(F.array(-(F.col("s_nationkey").cast("bigint") * 10 + 1), -(F.floor(F.col("s_acctbal") / 100) * 10 + 100_005))).alias("token"))
    c = connected_components(tokens.select(F.col("s_suppkey").alias("src"), F.col("token").alias("dst")))
    lanes = c.join(sup.select(F.col("s_suppkey").alias("node")), "node")
    first = lanes.groupBy("component").agg(F.min("node").alias("lane"))
    return lanes.join(first, "component").select(F.col("node").alias("root"), "lane")


@query
def group_items(s, d):
    return _members(s, d).select("group_id", "file_id", F.round("similarity_score", 6).alias("similarity_score"), "match_reason", F.round("match_duration_delta_s", 6).alias("match_duration_delta_s"), "keep_default", "selected_action")


@query
def group_metrics(s, d):
    return G.group_metrics(_members(s, d)).select("group_id", "members", "total_size_bytes", "reclaimable_bytes", F.round("average_confidence", 6).alias("average_confidence"))


@query
def quality_score(s, d):
    return G.with_quality(assets(_t(s, d, "documents"))).select("file_id", F.floor(F.col("quality") * 1000 + 0.123).alias("quality"), "level")


for _name in ("best", "worst", "larger", "smaller", "newer", "older"):
    _found[f"keep_{_name}"] = lambda s, d, n=_name: _members(s, d, n).filter("keep_default").select("group_id", "file_id")
for _by in ("total", "count", "spread"):
    for _way in ("down", "up"):
        _found[f"sort_group_{_by}_{_way}"] = lambda s, d, m=f"{_by}_{_way}": G.sorted_groups(_members(s, d), m)
for _way in ("down", "up"):
    _found[f"sort_row_size_{_way}"] = lambda s, d, w=_way: G.sorted_rows(_members(s, d), w == "down")


@query
def filter_text(s, d):
    return G.filtered(_members(s, d), include=G.has_term(F.col("path"), " /EN/ | doc_1"), exclude=G.has_term(G.file_name(F.col("path")), ".webm")).select("group_id", "file_id")


@query
def filter_match_all(s, d):
    return G.filtered(_members(s, d), include=G.has_term(F.col("path"), "/en/"), match_all=True).select("group_id", "file_id")


@query
def filter_structured(s, d):
    wanted = (F.col("size") >= 500) & (F.col("duration_s") >= 60) & (F.col("similarity_score") >= 0.95) & (F.col("width") >= 1280) & F.col("ext").isin("mp4", "mkv", "avi") & F.col("codec").isin("hevc", "h264", "vp9")
    return G.filtered(_members(s, d), include=wanted).select("group_id", "file_id")


@query
def filter_hdr(s, d):
    return G.filtered(_members(s, d), include=F.col("hdr_format") != "").select("group_id", "file_id")


@query
def filter_options(s, d):
    return _members(s, d).select("ext", "codec").distinct()


@query
def dup_stats(s, d):
    return G.summary(_members(s, d))


@query
def export_duplicates(s, d):
    """Written as CSV and read back."""
    rows = E.duplicate_rows(_members(s, d))
    folder = scratch_path(s, "duplicates.csv")
    E.write_csv(rows, folder)
    back = s.read.option("header", True).schema(rows.schema).csv(folder)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else c for c, t in back.dtypes])


@query
def export_nested_json(s, d):
    """The sums and the items' order that each group's JSON holds."""
    scan = {"scan_id": 7, "created_at": "2024-01-01T00:00:00", "profile": "balanced"}
    kind = "struct<scan_id:long,profile:string,group_id:long,total_size_bytes:long,average_confidence:double,reclaimable_bytes:long,items:array<struct<file_id:long,file_path:string,is_keep_default:boolean,fps:double>>>"
    j = E.duplicate_documents(_members(s, d), scan).select(F.from_json("json", kind).alias("j")).select("j.*")
    return j.select(
        "scan_id", "profile", "group_id", "total_size_bytes", F.round("average_confidence", 6).alias("average_confidence"), "reclaimable_bytes",
        F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["file_id"].cast("string"), x["is_keep_default"].cast("string"), x["file_path"])), ",").alias("items"),
    )


@query
def exact_clusters(s, d):
    docs = _t(s, d, "documents").withColumn("path", F.concat(F.lit("/lib/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string")))
    return T.exact_clusters(docs.select((F.col("n_chars") % 2).alias("group_id"), "path", F.col("n_chars").alias("size"), F.sha2("text", 256).alias("digest")), "path")


@query
def sampled_digest(s, d):
    rows = T.sampled_digest(_t(s, d, "pages").select("page_id", "html", F.length("html").alias("size")), "html", "size", 64)
    return rows.select("page_id", "size", F.array_join(F.transform("offsets", lambda o: o.cast("string")), ",").alias("offsets"), "digest")


def _page_decoders() -> dict:
    """Decoders by rule over a page's bytes: of each kind some pages fail, some take too long, some end the process."""

    def frames(row, step):
        raw = row["html"] or b""
        runs = [raw[int(len(raw) * t) :][: 72 * step : step] for t in row["times"]]
        return [list(r) if len(r) == 72 else None for r in runs]

    def opencv(row):
        i = row["page_id"]
        if i % 3 == 0:
            raise OSError(f"cannot open {i}")
        if i % 89 == 5:
            import time

            time.sleep(60)
        return frames(row, 1)

    def pyav(row):
        if row["page_id"] % 97 == 6:
            import os

            os._exit(3)
        if row["page_id"] % 2 == 0:
            raise ValueError("no stream")
        return frames(row, 2)

    def ffmpeg(row):
        if row["page_id"] % 4 == 1:
            raise RuntimeError("bad exit")
        return frames(row, 1)

    return {"opencv": opencv, "pyav": pyav, "ffmpeg": ffmpeg}


def _page_files(s, d) -> DataFrame:
    i = F.col("page_id")
    return _t(s, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"), F.concat(F.lit("/v/"), i.cast("string"), F.when(i % 5 == 0, ".AVI").otherwise(".mkv")).alias("path"), F.lit(1.0).alias("duration_s"))


@query
def decoded_frames(s, d):
    """Pages decoded by the first back-end that can, every attempt told."""
    from functools import partial

    def with_id(f, row):  # the page's number is in its path
        return f(row | {"page_id": int(row["path"][3:-4])})

    decoders = {k: partial(with_id, f) for k, f in _page_decoders().items()}
    out = decode_frames(_page_files(s, d), decoders, content="html", limit_s=0.5)
    tries = F.array_join(F.transform("attempts", lambda t: F.concat_ws(":", t["backend"], t["status"], t["message"])), "; ")
    return out.select("page_id", tries.alias("attempts"), "backend", "fallback", X.encode_hashes(F.col("hashes")).alias("hashes"), "provenance", "error")


@query
def probed_files(s, d):
    """Of two probes the one that each row names, its document parsed."""

    def size_of(row):
        if row["page_id"] % 7 == 3:
            raise OSError("cannot probe")
        return {"format": {"duration": str(len(row["html"] or b"") / 8)}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": len(row["url"] or ""), "height": 10}]}

    i = F.col("page_id")
    rows = _t(s, d, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("html"), pick(i % 3, "PyAV ", "ffprobe", "none").alias("wanted"))
    probes = {"pyav": size_of, "ffprobe": lambda row: size_of(row) | {"streams": []}}
    out = parse_probe(probe_files(rows, probes, F.col("wanted"), ["page_id", "url", "html"]), "probe_json")
    return out.select("page_id", "backend", F.array_join(F.transform("attempts", lambda t: F.concat_ws(":", t["backend"], t["status"], t["message"])), ";").alias("attempts"), "duration_s", "width", "probe_error")


@query
def byte_digests(s, d):
    """Digests of sampled bytes of files, which are written first; every ninth is said to be longer than it is."""
    i = F.col("page_id")
    folder = scratch_path(s, "pages")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    rows = _t(s, d, "pages").select("page_id", F.concat(i.cast("string"), F.lit(".html")).alias("name"), "html")
    files = Scratch(s).cut(write_files(rows, folder, "name", "html"), "files").withColumn("size", F.when(i % 9 == 4, F.col("size") + 1).otherwise(F.col("size")))
    out = file_digests(files, block=64)
    return out.select("page_id", "size", F.array_join(F.transform("offsets", lambda o: o.cast("string")), ",").alias("offsets"), "digest", F.when(F.col("error").isNotNull(), "failed").alias("error"))


@query
def sample_times(s, d):
    return assets(_t(s, d, "documents")).select("file_id", F.array_join(F.transform(X.sample_times(F.col("duration_s")), lambda t: X.fixed(t, 4)), ",").alias("times"))


@query
def hardlink_canonical(s, d):
    identity = F.when(F.col("doc_id") % 10 == 0, "0").when(F.col("doc_id") % 11 > 0, F.sha2("text", 256))
    docs = _t(s, d, "documents").select(identity.alias("identity"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return T.hardlinks(docs, ["identity"], "path").select("path", "kind", "target")


def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    e = _t(s, d, "events")
    last = lambda x: T.latest(x, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return last(e.filter("ts < timestamp'2024-01-16'")), last(e.filter("ts >= timestamp'2024-01-16' and user_id % 5 <> 3"))


@query
def incremental_diff(s, d):
    old, new = _halves(s, d)
    value = F.floor(F.col("value") / 40).alias("version")
    return T.incremental(old.select("user_id", "event_type", value), new.select("user_id", "event_type", value), ["user_id", "event_type"], ["version"])


@query
def deleted_keys(s, d):
    old, new = _halves(s, d)
    return T.missing(old, new, ["user_id", "event_type"]).select("user_id", "event_type")


@query
def upsert_latest(s, d):
    old, new = _halves(s, d)
    return T.upsert(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@query
def issue_dedupe(s, d):
    return T.latest(_t(s, d, "events"), ["event_type", "user_id"], F.asc("ts"), F.asc("event_id")).select("event_type", "user_id", "event_id")


@query
def cache_lookup(s, d):
    e = _t(s, d, "events")
    asked = e.filter("ts >= timestamp'2024-01-16'").select("user_id", "event_type").distinct()
    kind = lambda n, c: F.when(F.col("event_id") % n == 0, c)
    cache = e.filter("ts < timestamp'2024-01-16'").select(
        "user_id", "event_type", F.floor(F.col("event_id") / 100).alias("scan_id"), F.col("event_id").alias("row_id"),
        kind(2, F.col("value")).alias("meta"), kind(3, F.col("event_id")).alias("fingerprint"), kind(5, F.col("event_id")).alias("audio"),
    )
    return T.cache_lookup(asked, cache, ["user_id", "event_type"])


def _scans(s, d) -> DataFrame:
    return _t(s, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("scan_set"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "paused").otherwise("running").alias("status"))


@query
def latest_by_set(s, d):
    return T.latest(_scans(s, d), ["scan_set"], F.desc("scan_id"))


@query
def latest_done_by_set(s, d):
    return T.latest(_scans(s, d).filter("status = 'done'"), ["scan_set"], F.desc("scan_id"))


@query
def latest_scan(s, d):
    return _scans(s, d).orderBy(F.desc("scan_id")).limit(1)  # the feature is one row


def _files(s, d) -> DataFrame:
    """(scan, file) of lineitem, one row each; a file is there if anything of it shipped before 1998."""
    return _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id"), F.col("l_partkey").alias("file_id")).agg(F.sum("l_quantity").cast("bigint").alias("size"), F.bool_or(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("alive"))


@query
def scan_summary(s, d):
    f = _files(s, d).groupBy("scan_id").agg(F.count("*").alias("files"), F.count_if("alive").alias("live_files"), F.sum("size").alias("bytes"))
    return _scans(s, d).join(f, "scan_id", "left").select("scan_id", "status", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("live_files", F.lit(0)).alias("live_files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query
def match_ready(s, d):
    """files in scans with metadata (part), not failed (anti join), with optional supplier rows (left join)."""
    failed = _t(s, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("file_id"))
    meta = _t(s, d, "part").select(F.col("p_partkey").alias("file_id"), "p_size", "p_brand")
    audio = _t(s, d, "supplier").select(F.col("s_suppkey").alias("file_id"), "s_name")
    f = _files(s, d).filter("alive").join(_scans(s, d), "scan_id").join(meta, "file_id").join(failed, "file_id", "left_anti").join(audio, "file_id", "left")
    return f.select("scan_id", "file_id", "size", "p_brand", F.coalesce("s_name", F.lit("")).alias("audio"))


def _catalogue(s, d) -> dict[str, DataFrame]:
    """scans, files with paths, stored groups with items, and action runs, out of orders and lineitem."""
    files = _files(s, d).withColumn("path", F.concat(F.lit("/Lib/R"), (F.col("file_id") % 37).cast("string"), F.lit("/f"), F.col("file_id").cast("string")))
    scans = _scans(s, d).withColumn("scan_set", F.concat(F.lit("set"), (F.col("scan_set") % 50).cast("string")))
    groups = scans.filter("scan_id % 4 <> 1").select("scan_id", F.col("scan_id").alias("group_id"))
    return {"scans": scans, "files": files, "groups": groups, "actions": scans.filter("scan_id % 9 = 2").select("scan_id")}


@query
def purge_counts(s, d):
    c = _catalogue(s, d)
    return C.purge_counts(C.purged_scans(c["scans"], c["files"], "set3", ["/lib/r5/", "/nowhere"]), c)


@query
def prune_groups(s, d):
    c = _catalogue(s, d)
    items = c["files"].filter("file_id % 3 > 0").select(F.col("scan_id").alias("group_id"), F.concat_ws("-", "scan_id", "file_id").alias("file_id"))
    there = c["files"].select(F.concat_ws("-", "scan_id", "file_id").alias("file_id"), "alive")
    return C.pruned(c["groups"], items, there).select("group_id", "alive")


@query
def load_groups(s, d):
    """Stored members in load order; of every fifth file nothing is left."""
    m = _members(s, d)
    items = m.select("group_id", "file_id", "keep_default")
    files = m.select("file_id", "width", "height", "bitrate", (F.col("file_id") % 5 > 0).alias("alive"))
    return C.stored_groups(m.select("group_id").distinct(), items, files).select("group_id", "file_id", "position")


def _stored(s, tables: dict[str, tuple[DataFrame, str]]) -> Catalogue:
    c = Catalogue(s, scratch_path(s, "catalogue"), buckets=4)
    tx = c.begin()
    for name, (rows, by) in tables.items():
        tx.create(name, rows, by)
    tx.commit()
    return c


def _meta(rows: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return rows.select(k.alias("file_id"), pick(k % 2, "pyav", "ffprobe").alias("probe_backend"), F.lit("t1").alias("probed_at"), (k * 10).alias("source_size"), (k * 7).alias("source_mtime_ns"),
                       (k % 90 + 1.0).alias("duration_s"), F.col("p_size").cast("int").alias("width"), F.lit(10).alias("bit_depth"), F.col("p_brand").alias("codec"), F.lit(None).cast("string").alias("probe_error"))


@query
def meta_after_probes(s, d):
    """Good probes, then failed ones of some files and of new ones, then good ones again: the stored table."""
    part = _t(s, d, "part")
    k = F.col("p_partkey")
    c = _stored(s, {"video_meta": (_meta(part.filter(k % 4 > 0)), "file_id")})
    tx = c.begin()
    failed = part.filter(k % 3 == 0).select(k.alias("file_id"), pick(k % 2, "pyav", "ffprobe").alias("probe_backend"), F.lit("t2").alias("probed_at"), (k * 11).alias("source_size"), (k * 7).alias("source_mtime_ns"), F.repeat(F.lit("no stream "), 60).alias("probe_error"))
    D.save_probe_errors(tx, failed)
    tx.commit()
    tx = c.begin()
    D.save_meta(tx, _meta(part.filter(k % 9 == 0)).withColumn("probed_at", F.lit("t3")).withColumn("codec", F.lit("new")))
    tx.commit()
    return c.read("video_meta").withColumn("probe_error", F.length("probe_error"))


@query
def tables_after_purge(s, d):
    """What the tables hold after scans of one set and of one root went, in one version."""
    t = _catalogue(s, d)
    c = _stored(s, {n: (rows, "scan_id") for n, rows in t.items()})
    tx = c.begin()
    D.purge(tx, "set3", ["/lib/r5/", "/nowhere"], ["files", "groups", "actions"])
    tx.commit()
    rest = [c.read(n).groupBy("scan_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n in t]
    return rest[0].unionByName(rest[1]).unionByName(rest[2]).unionByName(rest[3])


@query
def tables_after_prune(s, d):
    """Members removed and files marked missing, then groups under two live files pruned: the items left, and whether the version before still has all."""
    t = _catalogue(s, d)
    items = t["files"].filter("file_id % 3 > 0").select(F.col("scan_id").alias("group_id"), F.concat_ws("-", "scan_id", "file_id").alias("file_id"))
    files = t["files"].select("scan_id", F.concat_ws("-", "scan_id", "file_id").alias("file_id"), "alive", F.col("file_id").alias("number"), "path", "size")
    c = _stored(s, {"groups": (t["groups"], "group_id"), "group_items": (items, "group_id"), "files": (files, "scan_id")})
    tx = c.begin()
    D.mark_missing(tx, files.filter("number % 7 = 1"))
    D.remove_members(tx, files.filter("number % 11 = 2"))
    D.prune(tx)
    tx.commit()
    before = c.read("group_items", version=1).groupBy("group_id").agg(F.count("*").alias("before"))
    return c.read("group_items").groupBy("group_id").agg(F.count("*").alias("items")).join(before, "group_id").join(c.read("groups").select("group_id"), "group_id", "left_semi")


@query
def scan_rows(s, d):
    """Scans added and their states set, version by version; a state of an unknown scan adds none."""
    o = _scans(s, d)
    c = _stored(s, {"scans": (o.filter("scan_id % 3 = 0"), "scan_id")})
    tx = c.begin()
    D.add_scans(tx, o.filter("scan_id % 3 <= 1").withColumn("status", F.lit("added")))
    D.set_status(tx, o.filter("scan_id % 5 = 0").select("scan_id", F.lit("cancelled").alias("status")))
    tx.commit()
    return c.read("scans")


@query
def files_after_renames(s, d):
    a = _t(s, d, "part").select(F.lit(1).alias("scan_id"), F.col("p_partkey").alias("file_id"), F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"), F.lit("mp4").alias("ext"), F.col("p_size").cast("long").alias("size"), F.lit(5).cast("long").alias("mtime_ns"), (F.col("p_partkey") % 4 > 0).alias("alive"))
    c = _stored(s, {"files": (a, "file_id")})
    tx = c.begin()
    D.rename_files(tx, a.filter("file_id % 6 = 0").select("scan_id", (F.col("file_id") * F.when(F.col("file_id") % 5 == 0, -1).otherwise(1)).alias("file_id"), F.concat("path", F.lit(".Z_dele")).alias("path"), (F.col("size") + 1).alias("size"), F.lit(9).cast("long").alias("mtime_ns")))
    tx.commit()
    return c.read("files")


@query
def clone_artifacts(s, d):
    """Metadata of one scan's files carried over to the next scan's unchanged ones, of one back-end."""
    k = F.col("p_partkey")
    meta = _meta(_t(s, d, "part")).drop("probe_error")
    path = lambda root: F.concat(F.lit(root), k.cast("string"), F.lit(".mp4")).alias("path")
    source = _t(s, d, "part").select(k.alias("file_id"), path("D:\\Lib\\"), (k * 10).alias("size"), F.when(k % 5 == 0, k).otherwise(k * 7).alias("mtime_ns"))
    target = _t(s, d, "part").filter(k % 4 > 0).select((k + 1_000_000).alias("file_id"), path("d:/lib/"), F.when(k % 7 == 0, k).otherwise(k * 10).alias("size"), F.when(k % 5 == 0, k).otherwise(k * 7).alias("mtime_ns"))
    return D.clone_artifacts(source, meta, target, "pyav")


@query
def bench_quota(s, d):
    f = assets(_t(s, d, "documents")).select("path", F.col("source").alias("root"))
    return T.quota_sample(f, "root", "path", 6, 4, 150).select("path", "root", "risky", "tier", "position")


def _lanes(s, d) -> DataFrame:
    e = _t(s, d, "events").select(F.pmod("user_id", F.lit(7)).cast("bigint").alias("lane"), "event_type", "value", "event_id")
    return e.select("lane", F.when(F.col("event_id") % 11 == 0, "failed").otherwise("success").alias("status"), F.col("value").alias("elapsed_s"), (F.col("event_id") % 5 == 0).cast("bigint").alias("fallback_count"), (F.col("event_id") % 97 == 0).cast("bigint").alias("timeout_count"))


@query
def lane_metrics(s, d):
    return T.lane_metrics(_lanes(s, d))


@query
def guidance(s, d):
    return T.guidance(T.lane_metrics(_lanes(s, d)), 16)


@query
def lane_plan(s, d):
    return P.worker_plan(_t(s, d, "supplier").select(F.col("s_nationkey").alias("lane"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 5).alias("override")), 16)


@query
def path_parts(s, d):
    p = _t(s, d, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, "/Clip.MKV").otherwise("/.hidden")).alias("path"))
    return p.select("page_id", X.path_key(F.col("path")).alias("key"), G.file_name(F.col("path")).alias("name"), X.suffix(F.col("path")).alias("suffix"), X.suffix(F.col("path")).isin(*X.RISKY_SUFFIXES).alias("risky"))


@query
def filter_terms(s, d):
    return _t(s, d, "benchmark").select("item_id", F.array_join(X.terms(F.concat(F.lit(" A |"), F.replace("text", F.lit(","), F.lit("|")), F.lit("| |B"))), "#").alias("terms"))


@query
def scan_set_key(s, d):
    i = F.col("doc_id")
    roots = F.array(F.lit("/Lib/B"), F.concat(F.lit("/lib/"), "source"), F.lit(" /lib/b "))
    ext = F.split(F.concat("source", F.lit(",MKV, .mp4 ,mkv,"), "lang"), ",")
    key = X.scan_set_key(roots, ext, pick(i % 3, " Balanced", "custom", "none"), pick(i % 3, "0.5", "x", "0.2"), i % 2 == 0, i % 3 == 0, pick(i % 3, "any_aspect", "OFF", ""))
    return _t(s, d, "documents").select("doc_id", key.alias("scan_set_key"))


@query
def scalar_functions(s, d):
    o = _t(s, d, "orders")
    n = F.col("o_orderkey")
    return o.select(
        n.alias("id"), X.duration_bucket(n / 2.0).alias("bucket"), X.aspect_bin(n % 50 + 1, n % 7).alias("aspect"), X.level_text((n % 60).cast("string")).alias("level"),
        X.rational(F.concat((n % 9).cast("string"), F.lit("/"), (n % 3).cast("string"))).alias("fps"), X.alpha_label(n).alias("alpha"), X.bytes_text(n * 977 * (n % 13 + 1)).alias("size_text"),
        X.bit_depth(F.lit(None).cast("string"), F.concat(F.lit("yuv420p"), F.when(n % 4 == 0, "10le").when(n % 4 == 1, "12be").otherwise(""))).alias("bit_depth"),
    )


@query
def thumb_key(s, d):
    return assets(_t(s, d, "documents")).select("file_id", F.sha1(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime_ns").cast("string"), F.lit("160x90"), F.lit("50"), F.lit("left"), F.lit("v2"))).alias("key"))


@query
def probe_parse(s, d):
    n = F.col("p_partkey")
    of = lambda m, *values: pick(n % m, *values)
    side = F.array(F.when(n % 11 == 0, F.to_json(F.struct(F.lit("DOVI configuration record").alias("side_data_type"), F.lit(8).alias("dv_profile")))), F.when(n % 11 == 1, F.lit('{"side_data_type":"HDR Dynamic Metadata HDR10+"}')), F.when(n % 11 == 2, F.lit('{"side_data_type":"Mastering display metadata"}')), F.when(n % 11 == 3, F.lit('{"side_data_type":"DV"}')))
    video = F.struct(
        F.lit("video").alias("codec_type"), of(2, "H264", "hevc").alias("codec_name"), of(13, 0, *[1920] * 12).alias("width"), F.lit(1080).alias("height"), of(4, "30000/1001", "25", "0/0", "24/1").alias("r_frame_rate"),
        of(5, "yuv420p10le", "yuv420p", "gray10le", "yuv422p12be", "").alias("pix_fmt"), of(4, "0", "8", None, "16").alias("bits_per_raw_sample"), of(5, "unknown", "High", "-99", " Main ", "N/A").alias("profile"),
        of(5, "41", "5", "0", "4.1", "x").alias("level"), of(6, "tt", "progressive", "top_field_first", "Interlaced", "unknown", "").alias("field_order"),
        of(5, "SMPTE2084", "arib-std-b67", "bt709", "bt2020-10", "").alias("color_transfer"), of(3, "bt2020nc", "bt709", "bt2020").alias("color_primaries"),
    )
    sound = lambda lang, rate: F.to_json(F.struct(F.lit("audio").alias("codec_type"), F.lit("AAC").alias("codec_name"), F.lit(rate).alias("bit_rate"), F.struct(F.lit(lang).alias("language")).alias("tags")))
    picture = F.concat(F.regexp_replace(F.to_json(video), "}$", ""), F.lit(',"side_data_list":['), F.concat_ws(",", side), F.lit("]}"))
    sounds = F.when(n % 3 > 0, F.concat_ws(",", sound("ENG", "64000"), F.when(n % 3 == 2, sound("deu ", "32000.5"))))
    streams = F.concat(F.lit("["), F.concat_ws(",", picture, sounds, F.when(n % 4 == 0, F.lit('{"codec_type":"subtitle","tags":{"language":"pol"}}'))), F.lit("]"))
    text = F.concat(F.lit('{"format":{"duration":"'), (n % 17 / 4.0).cast("string"), F.lit('","bit_rate":123456,"format_name":"MOV,mp4"},"streams":'), streams, F.lit("}"))
    out = parse_probe(_t(s, d, "part").select("p_partkey", text.alias("probe_json")), "probe_json").drop("probe_json")
    return out.withColumn("fps", F.round("fps", 6))


@query
def median_distances(s, d):
    """Arrays of 0 to 12 hashes, of equal and unequal length."""
    n = F.col("p_partkey")
    twelve = F.sequence(F.lit(1), F.lit(12))
    a = F.slice(F.transform(twelve, lambda i: n * i * 2654435761), F.lit(1), (n % 13).cast("int"))
    b = F.slice(F.transform(twelve, lambda i: (n + 7) * i * 2654404609), F.lit(1), F.when(n % 3 == 0, n % 13).otherwise(n % 11).cast("int"))
    rows = _t(s, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    x, y = F.col("a"), F.col("b")
    return rows.select("p_partkey", X.full_distance(x, y).alias("full_distance"), X.inner_distance(x, y).alias("inner_distance"), X.prefilter_full(x, y).alias("prefilter_full"), X.prefilter_inner(x, y).alias("prefilter_inner"))


@query
def setting_names(s, d):
    n = F.col("o_orderkey")
    raw = pick(n % 7, " Balanced ", "CUSTOM", "none", "any_aspect", "Rename", "trimmed_match", "FFPROBE")
    return _t(s, d, "orders").select(
        n.alias("id"), *[X.setting(kind, raw).alias(kind) for kind in X.SETTINGS], X.custom_threshold(pick(n % 4, "0.5", "x", " 0.2 ", "0")).alias("threshold"),
        F.array_join(F.transform(X.normal_pair((n % 130 - 10).cast("string"), (n % 103).cast("string")), lambda v: v.cast("string")), ",").alias("pair"),
        F.coalesce(X.eta_seconds(n % 9, F.lit(20), (n % 31).cast("double")), F.lit(-1.0)).alias("eta"), X.mib_rate(n * 1048576, n % 4).alias("rate"),
    )


@query
def scene_samples(s, d):
    """Times told by a log, and four of them spread evenly."""
    n = F.col("event_id")
    log = F.array_join(F.transform(F.sequence(F.lit(0), (n % 9).cast("int")), lambda i: F.concat(F.lit("n:0 pts_time:"), (i * (n % 3)).cast("string"), F.lit(".5 x"))), " ")
    times = X.scene_times(log, (n % 13).cast("double"))
    text = lambda a: F.coalesce(F.array_join(F.transform(a, lambda t: t.cast("string")), ","), F.lit("none"))
    return _t(s, d, "events").select("event_id", text(times).alias("times"), text(X.even_pick(times, 4)).alias("picked"), F.coalesce(X.audio_text(pick(n % 3, '{"fingerprint":" AQ "}', '{"fingerprint":" "}', "x")), F.lit("none")).alias("audio"))


@query
def frame_grids(s, d):
    """Hashes of 9 by 8 pixels taken from frames of other sizes."""
    n = F.col("p_partkey")
    w, h = (n % 5 + 9).cast("int"), (n % 3 + 8).cast("int")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(139)), lambda i: ((n * 31 + i * i * 7 + i * n) % 251).cast("int"))
    small = X.nearest_grid(pixels, w, h, 9, 8)
    return _t(s, d, "part").select("p_partkey", X.grid_hash(small).alias("hash"), F.aggregate(small, F.lit(0), lambda a, b: a + b).alias("sum"), X.hashes_valid(F.array(F.lit(None).cast("bigint"), (n % 4).cast("bigint"))).alias("valid"))


@query
def valid_artifacts(s, d):
    i = F.col("event_id")
    size, at = i % 50, i % 70
    kinds = {"meta": (2, 7, 9), "hashes": (3, 11, 5), "audio": (4, 6, 8)}
    cols = [c for k, (m, a, b) in kinds.items() for c in (F.when(i % m > 0, "x").alias(k), F.when(i % a > 0, size).otherwise(size + 1).alias(f"{k}_size"), F.when(i % b > 0, at).alias(f"{k}_mtime_ns"))]
    rows = _t(s, d, "events").select("event_id", size.alias("size"), at.alias("mtime_ns"), *cols, F.when(i % 13 == 0, " broken ").alias("probe_error"))
    return C.valid_artifacts(rows).select("event_id", "meta_ok", "hashes_ok", "audio_ok", "decision")


def _failed(s, d) -> DataFrame:
    i = F.col("event_id")
    return _t(s, d, "events").select((i % 4).alias("scan_id"), F.concat(pick(i % 2, "D:\\Lib/", "d:/lib\\"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"), pick(i % 4, "probe", "enumerate", "fingerprint", "analyze").alias("stage"), "event_id")


@query
def clone_failed(s, d):
    """Marks of scan 1 carried over to scan 2 for the files that are unchanged."""
    marks = _failed(s, d).groupBy("scan_id", X.path_key(F.col("path")).alias("path")).agg(F.max("event_id").alias("event_id"))
    same = _t(s, d, "events").filter("event_id % 3 = 0").select(F.concat(F.lit("d:/LIB/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"))
    return C.cloned(marks, same, 1, 2)


@query
def to_analyze(s, d):
    files = _failed(s, d).select("scan_id", "path", "event_id").filter("event_id % 5 > 0")
    return C.to_analyze(files, C.retryable(_failed(s, d).filter("event_id % 97 = 0")), retry=False).select("event_id")


@query
def failed_files(s, d):
    """Marks that no later success cleared, the newest of each file."""
    f = _failed(s, d).withColumnRenamed("event_id", "at")
    return C.failed_state(f.filter("at % 3 = 0"), f.filter("at % 3 > 0 and at % 2 = 0")).select("scan_id", X.path_key(F.col("path")).alias("key"), "at")


@query
def provenance_metrics(s, d):
    i = F.col("event_id")
    tries = F.concat(F.lit('{"attempts":['), F.concat_ws(",", F.when(i % 5 > 0, F.concat(F.lit('{"decoder_backend":"'), pick(i % 3, "PyAV", "ffmpeg", " opencv"), F.lit('","status":"'), pick(i % 4, "TIMEOUT ", "success", "error", "timeout"), F.lit('"}'))), F.when(i % 2 == 0, F.lit('{"decoder_backend":"ffmpeg","status":"timeout"}'))), F.lit("]}"))
    rows = _t(s, d, "events").select("event_id", F.when(i % 17 == 0, "broken").otherwise(tries).alias("provenance"), pick(i % 2, "ffmpeg", "pyav").alias("used"))
    return C.provenance(rows, "provenance", "used").select("event_id", "fallbacks", "timeouts")


@query
def decoder_mix(s, d):
    return C.decoder_mix(_lanes(s, d).withColumn("decoder", pick(F.floor("elapsed_s") % 3, "pyav", "ffmpeg", None)))


@query
def run_summary(s, d):
    return C.run_summary(_lanes(s, d))


@query
def named_sample(s, d):
    return C.named_sample(assets(_t(s, d, "documents")).select("path", F.col("source").alias("root")), "doc_1", 24)


@query
def incomplete_sample(s, d):
    return C.named_sample(assets(_t(s, d, "documents")).select("path", F.col("source").alias("root")), "incomplete", 120, else_all=True)


@query
def display_rows(s, d):
    return C.display_rows(_members(s, d))


@query
def profile_status(s, d):
    sets = _scans(s, d).select("scan_set").distinct().filter("scan_set % 3 = 0").unionByName(s.sql("SELECT -1L AS scan_set"))
    return C.profile_status(sets.withColumn("name", F.concat(F.lit("p"), F.col("scan_set").cast("string"))), _scans(s, d))


@query
def may_resume(s, d):
    k = F.col("c_custkey")
    paused = _t(s, d, "customer").select(k.alias("scan_set"), F.array(F.lit("/A"), F.concat(F.lit("/b"), (k % 3).cast("string"))).alias("roots"), (k % 5).alias("definition"))
    now = _t(s, d, "customer").filter(k % 7 > 0).select(k.alias("scan_set"), F.array(F.lit("/a "), F.lit("/B1"), F.lit("/b2")).alias("roots"), F.when(k % 2 == 0, k % 5).otherwise(k % 4).alias("definition"))
    return C.may_resume(paused, now)


@query
def progress(s, d):
    return C.progress(_t(s, d, "events").select((F.col("event_id") % 3 == 0).alias("cached"), (F.col("event_id") * 1000).alias("size"), (F.col("event_id") / 10.0).alias("elapsed_s")))


@query
def delete_plan(s, d):
    """Renames beside names that are taken; every 50th target has no id."""
    a = assets(_t(s, d, "documents")).select("file_id", "path")
    taken = a.filter("file_id % 2 = 0").select(F.concat("path", F.lit(".z_dele")).alias("path")).unionByName(a.filter("file_id % 6 = 0").select(F.concat("path", F.lit(".z_dele.1")).alias("path")))
    return P.delete_plan(a.withColumn("file_id", F.when(F.col("file_id") % 50 == 0, -F.col("file_id")).otherwise(F.col("file_id"))), taken, "rename")


@query
def scan_links(s, d):
    """Symlinks and further names of one file together, in order of path."""
    docs = _t(s, d, "documents").select(F.sha2("text", 256).alias("identity"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    hard = T.hardlinks(docs, ["identity"], "path").filter("kind = 'hardlink'").select(F.col("kind").alias("link_kind"), F.col("path").alias("link_path"), F.col("target").alias("target_original_path"), F.lit(True).alias("target_exists"))
    soft = docs.filter("doc_id % 9 = 4").select(F.lit("symlink").alias("link_kind"), F.concat("path", F.lit(".lnk")).alias("link_path"), F.col("path").alias("target_original_path"), (F.col("doc_id") % 2 == 0).alias("target_exists"))
    return E.link_rows(soft.unionByName(hard).withColumn("scan_id", F.lit(7)).withColumn("source_root", F.lit("/lib"))).orderBy("link_path")


@query
def json_lists(s, d):
    i = F.col("page_id")
    text = pick(i % 5, '[" a ","","B"]', "[]", "broken", '{"a":1}', None)
    return _t(s, d, "pages").select("page_id", F.array_join(X.text_list(text), "|").alias("items"), X.first_chars(F.col("html"), 50).alias("head"), X.last_chars(F.col("html"), 40).alias("tail"), X.parent(F.col("url")).alias("parent"), X.stem(F.concat("url", pick(i % 3, "/a.b.mkv", "/.hidden", "/c"))).alias("stem"))


@query
def stream_microbatch(s, d):
    return deduped_events(s, d)


def _library(s, d) -> dict[str, DataFrame]:
    """The stored tables of five scans of the assets, typed; some metadata, hashes and sounds are missing, some marks and flags set."""
    a = assets(_t(s, d, "documents"))
    i, scan = F.col("file_id"), F.col("file_id") % 5
    key = X.path_key(F.col("path"))
    own = lambda b: a.filter(i % 3 > 0) if b == "ffprobe" else a
    meta = [
        own(b).select("*", F.lit(b).alias("probe_backend")).withColumn("duration_s", F.when(i % 31 == 0, 0.0).otherwise(F.col("duration_s"))).withColumn("bit_depth", F.when(i % 6 > 0, F.col("bit_depth")))
        .withColumn("hdr_format", F.when(F.col("hdr_format") != "", F.col("hdr_format"))).withColumn("audio_languages", F.when(i % 4 == 1, "eng")) for b in ("pyav", "ffprobe")
    ]
    made = a.filter(i % 19 > 0)
    prints = [made.select("file_id", F.lit(b).alias("probe_backend"), F.lit(v).alias("algo_version"), F.unhex(X.encode_hashes(F.col("hashes"))).alias("hash_blob")) for b, v in (("pyav", 1), ("ffprobe", 1), ("pyav", 2))]
    scans = a.select(scan.alias("id")).distinct().select(
        "id", F.lit("t").alias("created_at"), F.lit("balanced").alias("profile"), F.lit('[" /Lib/A ","","/Lib/A","/b"]').alias("roots_json"), F.lit('[".MP4","mkv","mp4"]').alias("extensions_json"),
        (F.col("id") / 10).alias("custom_similarity_threshold"), F.when(F.col("id") > 0, F.col("id") % 2 == 0).alias("scene_aware_sampling"), pick(F.col("id") % 3, " Any_Aspect", "x", None).alias("cross_resolution_mode"),
        pick(F.col("id") % 3, "pyav", "ffprobe", "").alias("probe_backend"), F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("scan_set_key"), pick(F.col("id") % 2, "done", "paused").alias("status"),
    )
    rows = {
        "scans": scans,
        "files": a.select(i.alias("id"), "path", key.alias("normalized_path"), "size", "mtime_ns", (F.col("mtime_ns") + 1).alias("ctime_ns"), "ext", scan.alias("scan_id"), (i % 23 > 0).alias("exists_flag")),
        "video_meta": meta[0].unionByName(meta[1]), "fingerprints": prints[0].unionByName(prints[1]).unionByName(prints[2]),
        "audio_fingerprints": a.filter(i % 2 == 0).select("file_id", F.col("audio_fingerprint").alias("fingerprint_text")),
        "scan_failed_files": a.filter(i % 17 == 0).select(scan.alias("scan_id"), key.alias("normalized_path"), F.col("path").alias("display_path"), pick(i % 2, "probe", None).alias("stage")),
        "scan_issues": a.filter(i % 13 == 0).select((1_000_000 - i).alias("id"), scan.alias("scan_id"), F.lit("enumerate").alias("stage"), "path"),
        "scan_links": a.filter(i % 12 == 0).select(scan.alias("scan_id"), pick(i % 3, " SymLink", "hard", "x").alias("link_kind"), F.concat("path", F.lit(".lnk")).alias("link_path"), F.col("path").alias("target_original_path"), (i % 8 == 0).alias("target_exists_flag")),
        "duplicate_groups": a.filter(i % 10 == 0).select(i.alias("id"), scan.alias("scan_id"), F.lit("balanced").alias("profile")),
        "duplicate_group_items": a.select((i - i % 10).alias("group_id"), i.alias("file_id")),
        "action_runs": scans.select((F.col("id") + 100).alias("id"), F.col("id").alias("scan_id"), F.lit("rename").alias("mode"), F.lit("done").alias("status")),
        "action_items": a.filter(i % 5 < 4).select(i.alias("id"), (scan + 100).alias("run_id"), i.alias("file_id"), F.col("path").alias("source_path"), F.when(i % 7 > 0, "ok").otherwise("error").alias("result"), F.when(i % 7 == 0, F.concat(F.lit("busy "), i.cast("string"))).alias("error_text")),
    }
    return {name: H.typed(name, r) for name, r in rows.items()}


@query
def match_items(s, d):
    """The files of each scan that can be matched, from tables in buckets of the file."""
    import uuid

    t = _library(s, d)
    run = uuid.uuid4().hex[:12]
    for name in ("files", "video_meta", "fingerprints", "audio_fingerprints"):
        t[name] = H.store_bucketed(s, name, t[name], f"{name}_{run}", scratch_path(s, name), buckets=8)
    out = L.match_items(t, algo_version=1)
    return out.withColumn("hashes", X.encode_hashes(F.col("hashes")))


@query
def scan_infos(s, d):
    out = L.scan_info(_library(s, d)["scans"])
    return out.withColumn("roots", F.array_join("roots", "|")).withColumn("extensions", F.array_join("extensions", "|"))


@query
def listed_issues(s, d):
    return L.issue_rows(_library(s, d))


@query
def listed_failures(s, d):
    return L.failed_rows(_library(s, d))


@query
def listed_links(s, d):
    return L.link_rows(_library(s, d))


@query
def file_snapshot(s, d):
    return L.snapshot(_library(s, d))


@query
def group_paths(s, d):
    return L.group_paths(_library(s, d))


@query
def scan_counts(s, d):
    return L.scan_counts(_library(s, d))


@query
def newest_scans(s, d):
    """The newest scan of all, of a set, of a set's that are done, and of a blank set, which has none."""
    t = _library(s, d)["scans"]
    asked = {"all": {}, "set": {"key": " k1 "}, "done": {"key": "k0", "status": "done"}, "blank": {"key": " "}}
    rows = [L.newest(t, **o).select(F.lit(n).alias("asked"), "id") for n, o in asked.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query
def path_order(s, d):
    """Files numbered in order of path, letter case and kind of slash aside."""
    from .operators.numbering import numbered

    a = assets(_t(s, d, "documents")).select("file_id", F.when(F.col("file_id") % 2 == 0, F.upper("path")).otherwise(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    return numbered(a.withColumn("key", X.path_key(F.col("path"))), "key", "path").select("file_id", "position")


@query
def filter_lists(s, d):
    return L.filter_lists(_members(s, d).withColumn("codec", F.when(F.col("file_id") % 2 == 0, F.upper("codec")).otherwise(F.col("codec"))))


@query
def filter_ranges(s, d):
    wanted = L.structured(min_mib=0.0005, max_mib=0.004, min_s=60, max_s=400, similarity=0.9, width=640, height=480, hdr="exclude")
    return G.filtered(_members(s, d), include=wanted).select("group_id", "file_id")


@query
def recent_roots(s, d):
    e = _t(s, d, "events")
    i = F.col("event_id")
    rows = e.select(F.col("user_id").alias("owner"), i.alias("at"), F.when(i % 9 > 0, F.concat(pick(i % 2, " /Lib/", "/LIB/"), (i % 37).cast("string"))).otherwise(" ").alias("root"))
    return L.recent_roots(rows)


@query
def run_document(s, d):
    """The numbers that a run's document holds."""
    rows = _lanes(s, d)
    lanes = T.lane_metrics(rows)
    mix = C.decoder_mix(rows.withColumn("decoder", pick(F.floor("elapsed_s") % 3, "pyav", "ffmpeg", None)))
    doc = L.run_document(C.run_summary(rows), lanes, mix, T.guidance(lanes, 16), {"set_id": "mixed", "worker_limit": 16})
    kind = "struct<analyzed_files:long,success_count:long,failure_count:long,fallback_count:long,decoder_timeout_count:long,set_id:string,worker_limit:int,guidance:struct<reason:string,recommended_workers:int>,lane_metrics:array<struct<lane:long,files:long,decoder_mix:map<string,long>>>>"
    j = doc.select(F.from_json("json", kind).alias("j")).select("j.*")
    mixed = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x["decoder_mix"])), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "+")
    return j.select(
        "analyzed_files", "success_count", "failure_count", "fallback_count", "decoder_timeout_count", "set_id", "worker_limit", F.col("guidance.reason").alias("reason"), F.col("guidance.recommended_workers").alias("workers"),
        F.array_join(F.transform("lane_metrics", lambda x: F.concat_ws(":", x["lane"].cast("string"), x["files"].cast("string"), mixed(x))), ",").alias("lanes"),
    )


@query
def action_history(s, d):
    t = _library(s, d)
    return L.action_history(t["action_runs"], t["action_items"]).select("id", "scan_id", "mode", "status", "items", "done", "failed", "first_error")


@query
def run_counters(s, d):
    """Files by decision, groups and issues of a scan in one row."""
    t = _library(s, d)
    rows = t["files"].select(pick(F.col("id") % 4, "cache_hit", "fingerprint_only", "probe_and_fingerprint", "cache_hit").alias("decision"))
    return L.run_counters(rows, t["duplicate_groups"], t["scan_issues"], {"probe": 1.5, "matching": 0.25})


@query
def cached_artifacts(s, d):
    """What of each file need not be made again, from the newest row that is still true of it."""
    i = F.col("event_id")
    e = _t(s, d, "events")
    now = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("n")).select("user_id", "event_type", (F.col("n") % 3).alias("size"), (F.col("n") % 2).alias("mtime_ns"))
    kinds = {"meta": (2, 3), "hashes": (3, 2), "audio": (5, 4)}
    cols = [c for k, (m, z) in kinds.items() for c in (F.when(i % m > 0, i).alias(k), (i % 3).alias(f"{k}_size"), F.when(i % z > 0, i % 2).alias(f"{k}_mtime_ns"))]
    cache = e.select("user_id", "event_type", F.floor(i / 100).alias("scan_id"), i.alias("row_id"), *cols, F.when(i % 7 == 0, "broken").alias("probe_error"))
    return C.cached_artifacts(now, cache, ["user_id", "event_type"])


@query
def media_durations(s, d):
    n = F.col("p_partkey")
    container = F.when(n % 5 > 0, n * 1000.0)
    units, stream, base = F.when(n % 3 == 0, 1000.0).when(n % 3 == 1, 0.001), F.when(n % 4 > 0, n * 90.0), F.when(n % 7 > 0, 1 / 90000.0).otherwise(0.0)
    return _t(s, d, "part").select("p_partkey", F.round(X.media_duration(container, units, stream, base), 6).alias("duration_s"))


@query
def listed_files(s, d):
    """Files written under three roots, listed again by extension and size; a root that is missing and a network path are issues."""
    folder = scratch_path(s, "roots")
    local = folder.removeprefix("file://").removeprefix("file:")
    i = F.col("page_id")
    rows = _t(s, d, "pages").select("page_id", F.concat(F.lit("r"), (i % 3).cast("string"), F.lit("-"), i.cast("string"), pick(i % 4, ".MP4", ".mkv", ".txt", ".mp4")).alias("name"), "html")
    Scratch(s).cut(write_files(rows, local, "name", "html"), "written")
    files, links, issues = list_files(s, [local, f"{local}/none", "//server/share"], [" .MP4", "mkv"], 0.0005, 0.005)
    name = F.element_at(F.split("path", "/"), -1)
    told = files.select(F.lit("file").alias("kind"), name.alias("name"), "size").unionByName(links.select(F.col("link_kind").alias("kind"), F.element_at(F.split("link_path", "/"), -1).alias("name"), F.lit(0).cast("long").alias("size")))
    return told.unionByName(issues.select(F.lit("issue").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.length("message").cast("long").alias("size")))


def _feed(s, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append", per_batch: int = 0) -> tuple[DataFrame, str]:
    """A stream over a folder that parts are added to one by one, stopped and started again after each; what its batches wrote."""
    folder, out, checkpoint = (scratch_path(s, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    for rows in parts:
        rows.write.mode("append").parquet(folder)
        feed = s.readStream.schema(rows.schema)
        feed = feed.option("maxFilesPerTrigger", per_batch) if per_batch else feed
        run_to_table(make(feed.parquet(folder)), out, checkpoint, mode)
    return s.read.parquet(out), checkpoint


@query
def stream_incremental(s, d):
    """Two scans' files as a stream that is stopped in between: the second scan against the first."""
    parts = [
        h.select(F.lit(n).cast("long").alias("scan_id"), F.lit(f"2024-01-{15 * n:02d} 00:00:00").cast("timestamp").alias("at"), F.floor(F.col("value") / 40).cast("string").alias("version"), "user_id", "event_type")
        for n, h in enumerate(_halves(s, d), 1)
    ]
    out, _ = _feed(s, parts, lambda f: incremental_stream(f, ["user_id", "event_type"]))
    return out.filter("scan_id = 2").select("user_id", "event_type", "state")


@query
def stream_failed_files(s, d):
    """Failure marks and successes as a stream stopped in between: files whose newest mark is a failure."""
    marks = _failed(s, d).select("scan_id", X.path_key(F.col("path")).alias("key"), F.col("event_id").alias("at"), (F.col("event_id") % 3 == 0).cast("int").alias("bad")).filter("bad = 1 or at % 2 = 0")
    out, _ = _feed(s, [marks.filter("at % 5 > 1"), marks.filter("at % 5 <= 1")], lambda f: failure_stream(f, ["scan_id", "key"]), mode="update")
    return T.latest(out, ["scan_id", "key"], F.desc("batch")).filter("bad = 1").select("scan_id", "key", "at")


def _sequenced(s, d) -> DataFrame:
    from pyspark.sql import Window

    lane = F.pmod("user_id", F.lit(11)).cast("long").alias("lane")
    e = _t(s, d, "events").select(lane, "event_id", "ts")
    return e.select("lane", (F.row_number().over(Window.partitionBy("lane").orderBy("ts", "event_id")) - 1).cast("long").alias("seq"), F.col("event_id").cast("string").alias("payload"))


@query
def stream_ordered(s, d):
    """Rows that come in another order, a bounded number of files a batch, released in sequence: lane, seq, row, and whether its batch is not before its predecessor's."""
    from pyspark.sql import Window

    mixed = _sequenced(s, d).repartition(6, F.xxhash64("payload"))
    out, _ = _feed(s, [mixed], lambda f: ordered_stream(f, "lane"), per_batch=2)
    w = Window.partitionBy("lane").orderBy("seq")
    return out.withColumn("in_order", F.coalesce(F.lag("batch").over(w) <= F.col("batch"), F.lit(True))).select("lane", "seq", "payload", "in_order")


@query
def stream_progress(s, d):
    """What a listener was told of a stream of bounded batches: rows in all, whether all batches told their stages."""
    rows = _t(s, d, "events").select("user_id", "event_type")
    folder, out, checkpoint = (scratch_path(s, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    rows.repartition(5).write.parquet(folder)
    with S.ProgressLog.on(s) as log:
        feed = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
        q = feed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
        log.wait(q.id)
    told = log.table(s)
    stages = S.stage_seconds(told).filter("stage = 'addBatch'").select("batches")
    return told.agg(F.sum("rows").cast("long").alias("rows"), F.count_if(F.col("rows") > 0).alias("full_batches")).join(stages.agg((F.sum("batches") > 0).alias("timed")))  # one row each


@query
def progress_shown(s, d):
    """The progress events that a display shows, by run."""
    e = _t(s, d, "events")
    i = F.col("event_id")
    rows = e.select(F.col("user_id").alias("run"), i.alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), pick(F.floor(i / 500) % 3, "enumerate", "probe", "match").alias("stage"), i.alias("counter"), (i % 41 == 0).alias("forced"))
    rows = rows.select("run", "seq", (F.col("us") / 1e6).alias("at"), "stage", "counter", "forced")
    return S.emitted(rows, 400, 3600.0 * 24 * 5).select("run", "seq")


@query
def lane_dispatch(s, d):
    """Files in the order of a round-robin over drives, some of which give several a turn."""
    f = assets(_t(s, d, "documents")).select("file_id", (F.col("file_id") % 7).alias("lane"), "path", (F.col("file_id") % 7 % 3).cast("int").alias("cap"))
    return dispatch_order(f, "lane", [F.lower("path"), "path"], "cap").select("file_id", "lane", "turn", F.col("dispatched").cast("long").alias("dispatched"))


@query
def lane_assignment(s, d):
    """Each file's task, as the tasks themselves saw it: a drive has as many as its cap."""
    f = assets(_t(s, d, "documents")).select("file_id", (F.col("file_id") % 7).alias("lane"), "path")
    caps = s.range(5).select(F.col("id").alias("lane"), (F.col("id") % 3).cast("int").alias("cap"))
    return lane_tasks(f, "lane", [F.lower("path"), "path"], caps).select("file_id", "lane", "task", (F.spark_partition_id() == F.col("task")).alias("in_its_task"))


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in _found}
