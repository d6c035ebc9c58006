"""The stored catalogue: groups, artifacts, failed files, purges, listings and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def stored_groups(groups: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """Live members of stored groups(group_id), in load order: keeper, pixels, bit rate; position is within the group."""
    from pyspark.sql import Window

    rows = groups.select("group_id").join(items, "group_id").join(files.filter("alive"), "file_id")
    order = Window.partitionBy("group_id").orderBy(F.desc("keep_default"), F.desc(F.col("width") * F.col("height")), F.desc("bitrate"), "file_id")
    return rows.withColumn("position", F.row_number().over(order))


def pruned(groups: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """groups with alive, the number of members that are there, of those that keep fewer than two; one without items has 0."""
    held = items.join(files.select("file_id", "alive"), "file_id", "left").groupBy("group_id").agg(F.count_if("alive").alias("alive"))
    return groups.join(held, "group_id", "left").withColumn("alive", F.coalesce("alive", F.lit(0))).filter("alive < 2")


def under(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies under it; letter case and kind of slash do not count."""
    p, r = X.path_key(path), F.rtrim(X.path_key(root), F.lit("/"))
    return (r != "") & ((p == r) | F.startswith(p, F.concat(r, F.lit("/"))))


def purged_scans(scans: DataFrame, files: DataFrame, key: str, roots: list[str]) -> DataFrame:
    """scan_id of the scans of a set, and of those with a file under any of the roots."""
    of = scans.filter((F.col("scan_set") == F.lit(key)) & F.lit(bool(key.strip()))).select("scan_id")
    hit = F.lit(False)
    for root in roots:
        hit = hit | under(F.col("path"), F.lit(root))
    return of.unionByName(files.filter(hit).select("scan_id")).distinct()


def purge_counts(gone: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: deleted_<name>, the rows of each table that go with the scans."""
    out = None
    for name, t in tables.items():
        n = t.join(gone, "scan_id", "left_semi").agg(F.count("*").alias(f"deleted_{name}"))  # one row each
        out = n if out is None else out.join(n)
    return out


def valid_artifacts(files: DataFrame) -> DataFrame:
    """files with meta_ok, hashes_ok, audio_ok: whether an artifact was made of the file as it is now, and the decision.

    files: size, mtime_ns, and of each kind meta, hashes, audio its value and <kind>_size, <kind>_mtime_ns; probe_error.
    """
    made = lambda k: F.col(k).isNotNull() & (F.col(f"{k}_size") == F.col("size")) & (F.col(f"{k}_mtime_ns") == F.col("mtime_ns"))
    clean = F.trim(F.coalesce("probe_error", F.lit(""))) == ""
    told = lambda c: F.coalesce(c, F.lit(False))
    out = files.withColumn("meta_ok", told(made("meta") & clean)).withColumn("hashes_ok", told(made("hashes"))).withColumn("audio_ok", told(made("audio")))
    decision = F.when(F.col("meta_ok") & F.col("hashes_ok"), "cache_hit").when(F.col("meta_ok"), "fingerprint_only").otherwise("probe_and_fingerprint")
    return out.withColumn("decision", decision)


def cached_artifacts(requested: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """requested(keys, size, mtime_ns) with meta, hashes, audio and the decision: each artifact from the newest cache row that made it of the file as it is now.

    cache: keys, scan_id, row_id, probe_error and each artifact with its <kind>_size and <kind>_mtime_ns.
    """
    from .tables import latest

    now = requested.select(*keys, "size", "mtime_ns")
    valid = valid_artifacts(cache.drop("size", "mtime_ns").join(now.distinct(), keys))
    out = requested
    for kind in ("meta", "hashes", "audio"):
        newest = latest(valid.filter(f"{kind}_ok"), keys, F.desc("scan_id"), F.desc("row_id"))
        out = out.join(newest.select(*keys, kind), keys, "left")
    told = F.when(F.col("meta").isNotNull() & F.col("hashes").isNotNull(), "cache_hit").when(F.col("meta").isNotNull(), "fingerprint_only")
    return out.withColumn("decision", told.otherwise("probe_and_fingerprint"))


def cloned(rows: DataFrame, paths: DataFrame, source: int, target: int, key: str = "path") -> DataFrame:
    """rows(scan_id, path, ...) with those of scan source whose path key is among paths' carried over to scan target.

    A row that target has of the same key is replaced.
    """
    wanted = paths.select(X.path_key(F.col(key)).alias("_key")).distinct()
    keyed = rows.withColumn("_key", X.path_key(F.col(key)))
    new = keyed.filter(F.col("scan_id") == source).join(wanted, "_key", "left_semi").withColumn("scan_id", F.lit(target).cast(rows.schema["scan_id"].dataType))
    old = keyed.join(new.select("scan_id", "_key"), ["scan_id", "_key"], "left_anti")
    return old.select(*rows.columns).unionByName(new.select(*rows.columns))


def to_analyze(files: DataFrame, failed: DataFrame, retry: bool) -> DataFrame:
    """files(scan_id, path) without those marked failed in their scan, unless failed ones are tried again."""
    if retry:
        return files
    marks = failed.select("scan_id", X.path_key(F.col("path")).alias("_key")).distinct()
    return files.withColumn("_key", X.path_key(F.col("path"))).join(marks, ["scan_id", "_key"], "left_anti").drop("_key")


def retryable(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("stage").isin("probe", "fingerprint", "analyze") & (F.coalesce("path", F.lit("")) != ""))


def failed_state(marks: DataFrame, done: DataFrame) -> DataFrame:
    """marks(scan_id, path, at) that no later success done(scan_id, path, at) of the file has cleared; the newest of each file."""
    from .tables import latest

    both = marks.select("scan_id", "path", "at", F.lit(1).alias("bad")).unionByName(done.select("scan_id", "path", "at", F.lit(0).alias("bad")))
    last = latest(both.withColumn("_key", X.path_key(F.col("path"))), ["scan_id", "_key"], F.desc("at"), F.asc("bad"))
    return last.filter("bad = 1").select("scan_id", "path", "at")


def provenance(rows: DataFrame, column: str, used: str) -> DataFrame:
    """rows with fallbacks (1 if the first decoder tried is not the one used) and timeouts of a provenance JSON."""
    tries = F.from_json(column, "struct<attempts:array<struct<decoder_backend:string,status:string>>>")["attempts"]
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = rows.withColumn("_tries", F.filter(F.coalesce(tries, F.array().cast("array<struct<decoder_backend:string,status:string>>")), lambda t: t.isNotNull()))
    first = low(F.try_element_at("_tries", F.lit(1))["decoder_backend"])
    fell = ((first != "") & (first != F.col(used))).cast("bigint")
    return out.withColumn("fallbacks", fell).withColumn("timeouts", F.size(F.filter("_tries", lambda t: low(t["status"]) == "timeout")).cast("bigint")).drop("_tries")


def decoder_mix(results: DataFrame) -> DataFrame:
    """lane, decoder, files of the successful results."""
    return results.filter("status = 'success' and decoder is not null").groupBy("lane", "decoder").agg(F.count("*").alias("files"))


def run_summary(results: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return results.agg(
        F.count("*").alias("analyzed"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        F.coalesce(F.sum("fallback_count"), F.lit(0)).alias("fallbacks"), F.coalesce(F.sum("timeout_count"), F.lit(0)).alias("timeouts"),
    )


def named_sample(files: DataFrame, word: str, most: int, else_all: bool = False) -> DataFrame:
    """The first files in order of (root, path) whose path has the word; else_all: of all files where none has it."""
    has = F.contains(F.lower("path"), F.lit(word))
    if else_all:
        any_has = files.agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("_any"))  # one row
        chosen = files.join(F.broadcast(any_has)).filter(has | ~F.col("_any")).drop("_any")
    else:
        chosen = files.filter(has)
    return chosen.orderBy(F.lower("root"), F.lower("path"), "path").limit(most)  # the sample is the feature


def display_rows(members: DataFrame) -> DataFrame:
    """The texts that a results table shows."""
    name = F.element_at(F.split("path", "/"), -1)
    label = F.when(F.col("match_reason") == "trimmed_match", "Trimmed").when(F.col("match_reason") == "audio_match", "Audio").otherwise("Perceptual")
    return members.select(
        "group_id", "file_id", name.alias("name"), F.regexp_replace(X.suffix(F.col("path")), r"^\.", "").alias("extension"), F.format_string("%,d", F.col("size").cast("bigint")).alias("size"),
        F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("resolution"), F.when(F.col("fps") > 0, X.fixed(F.col("fps"), 3)).otherwise("").alias("fps"),
        F.when(F.col("is_interlaced"), "Yes").otherwise("").alias("interlaced"), F.when(F.col("bit_depth") > 0, F.concat(F.col("bit_depth").cast("string"), F.lit("-bit"))).otherwise("").alias("bit_depth"),
        F.concat(X.fixed(F.col("duration_s"), 1), F.lit("s")).alias("duration"), X.fixed(F.col("similarity_score"), 3).alias("similarity"), label.alias("match"), X.parent(F.col("path")).alias("parent"),
    )


def profile_status(profiles: DataFrame, scans: DataFrame) -> DataFrame:
    """Named profiles(scan_set, name) with their newest scan, then the newest scans of sets without a name; kind tells which."""
    from .tables import latest

    last = latest(scans, ["scan_set"], F.desc("scan_id"))
    named = profiles.join(last, "scan_set", "left").withColumn("kind", F.lit("named"))
    auto = last.join(profiles.select("scan_set"), "scan_set", "left_anti").withColumn("kind", F.lit("auto")).withColumn("name", F.lit("").cast("string"))
    return named.select("kind", "scan_set", "name", "scan_id", "status").unionByName(auto.select("kind", "scan_set", "name", "scan_id", "status"))


def may_resume(paused: DataFrame, current: DataFrame) -> DataFrame:
    """scan_set, may_resume: the paused roots are among the current ones and the rest of the definition is the same."""
    c = current.select("scan_set", F.col("roots").alias("now"), F.col("definition").alias("now_definition"))
    j = paused.join(c, "scan_set", "left")
    ok = (F.size(F.array_except(X.root_list(F.col("roots")), X.root_list(F.col("now")))) == 0) & F.col("definition").eqNullSafe(F.col("now_definition"))
    return j.select("scan_set", F.coalesce(ok, F.lit(False)).alias("may_resume"))


def progress(done: DataFrame) -> DataFrame:
    """One row of done(cached, size, elapsed_s): files, cache-hit share, MiB and MiB a second."""
    return done.agg(
        F.count("*").alias("files"), F.round(F.avg(F.col("cached").cast("int")), 6).alias("hit_share"), F.round(F.sum("size") / F.lit(1048576.0), 6).alias("mib"),
        F.round(X.mib_rate(F.sum("size"), F.max("elapsed_s")), 6).alias("mib_per_s"),
    )
