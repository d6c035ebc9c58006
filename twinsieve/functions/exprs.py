"""Scalar expressions, Column -> Column. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published behaviour for results to match.
SAMPLE_PERCENTS = (0.05, 0.13, 0.21, 0.29, 0.37, 0.45, 0.53, 0.61, 0.69, 0.77, 0.85, 0.93)
PROFILE_THRESHOLDS = {"aggressive": 0.24, "balanced": 0.18, "conservative": 0.12}
RISKY_SUFFIXES = (".wmv", ".asf", ".avi", ".mov", ".mpg", ".mpeg", ".flv")
CODEC_RANKS = {"hevc": 1.0, "h265": 1.0, "av1": 1.0, "h264": 0.9, "vp9": 0.85}
H264_PROFILES = {"baseline": 1.000, "main": 1.006, "high": 1.012, "high 10": 1.018, "high 4:2:2": 1.022, "high 4:4:4": 1.026}
HEVC_PROFILES = {"main": 1.000, "main 10": 1.014, "main 12": 1.020, "main 4:2:2 10": 1.024, "main 4:2:2 12": 1.028, "main 4:4:4": 1.030}
PREFILTER_BITS, BUCKET_SECONDS, INNER_GAP, INNER_FACTOR = 22.0, 5.0, 3.0, 0.90
ASPECT_OFF, ASPECT_SAME = 0.2, 0.5


def choose(value: Column, table: dict, other) -> Column:
    """table[value], else other."""
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def median_of(bits: Column) -> Column:
    """Median of an array that is not empty; of an even number the mean of the two in the middle."""
    s, n = F.sort_array(bits), F.size(bits)
    at = lambda i: F.try_element_at(s, F.floor(i).cast("int") + 1)
    return (at((n - 1) / 2) + at(n / 2)) / F.lit(2.0)


def _distances(a: Column, b: Column) -> Column:
    """Bits that differ, frame by frame; one array, which keeps the generated code small."""
    return F.zip_with(a, b, hamming)


def inner_part(hashes: Column) -> Column:
    """The elements 2 to 9, as many as there are."""
    return F.slice(hashes, 3, 8)


def full_distance(a: Column, b: Column) -> Column:
    """Median of differing bits over 64; 1 for arrays of unequal length or none."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), median_of(_distances(a, b)) / 64.0).otherwise(F.lit(1.0))


def inner_distance(a: Column, b: Column) -> Column:
    return full_distance(inner_part(a), inner_part(b))


def prefilter_places(hashes: Column) -> list[Column]:
    """The hashes at the first, the middle and the last place."""
    n = F.size(hashes)
    return [F.get(hashes, i) for i in (F.lit(0), F.floor(n / 2).cast("int"), n - 1)]


def prefilter_bits(n: Column, a: list[Column], b: list[Column]) -> Column:
    """Median of the differing bits at three places of n common ones; 64 if there is none."""
    x, y, z = (hamming(p, q) for p, q in zip(a, b, strict=True))
    three = F.greatest(F.least(x, y), F.least(F.greatest(x, y), z)).cast("double")
    return F.when(n > 2, three).when(n == 2, (x + z) / F.lit(2.0)).when(n == 1, x.cast("double")).otherwise(F.lit(64.0))


def prefilter_full(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    cut = lambda h: prefilter_places(F.slice(h, F.lit(1), n))
    return prefilter_bits(n, cut(a), cut(b))


def prefilter_inner(a: Column, b: Column) -> Column:
    return prefilter_full(inner_part(a), inner_part(b))


def duration_bucket(seconds: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), seconds) / BUCKET_SECONDS).cast("int")


def aspect_bin(width: Column, height: Column) -> Column:
    return F.when(height <= 0, F.lit(0.0)).otherwise(F.bround(width / height * 4) / 4)


def threshold(profile: str, custom: float = 0.18) -> float:
    if profile.strip().lower() == "custom":
        return min(0.30, max(0.01, custom))
    return PROFILE_THRESHOLDS.get(profile, PROFILE_THRESHOLDS["balanced"])


def adjacent_hash(frame: Column) -> Column:
    """64 bits, most significant first: character i + 1 above character i."""
    codes = F.transform(F.regexp_extract_all(frame, F.lit("(?s)."), F.lit(0)), F.ascii)
    bit = lambda c, i: F.coalesce(F.get(c, i) > F.get(c, i - 1), F.lit(False)).cast("bigint")
    places = F.sequence(F.lit(1), F.lit(64))
    return bound(codes, lambda c: F.aggregate(places, F.lit(0).cast("bigint"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(bit(c, i))))


def encode_hashes(hashes: Column) -> Column:
    """Big-endian bytes of each 64-bit hash, as hexadecimal text."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def decode_hashes(text: Column) -> Column:
    n = (F.length(text) / 16).cast("int")
    one = lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    return F.when((F.length(text) % 16 == 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def codec_level(text: Column) -> Column:
    return F.coalesce(F.expr("try_cast(trim(codec_level) as double)") if text is None else F.trim(text).try_cast("double"), F.lit(0.0))


def quality_score(w: Column, h: Column, bitrate: Column, codec: Column, depth: Column, profile: Column, interlaced: Column) -> Column:
    """((65 % pixels + 25 % bit rate + 10 % codec rank) * depth) * profile) * progressive."""
    low = F.lower(codec)
    base = F.lit(0.65) * (w * h) + F.lit(0.25) * bitrate + F.lit(0.10) * choose(low, CODEC_RANKS, 0.7)
    bits = F.when(depth >= 12, 1.10).when(depth >= 10, 1.05).otherwise(1.0)
    family, p = F.trim(low), F.lower(F.trim(profile))
    named = F.when(family == "h264", choose(p, H264_PROFILES, 1.0)).when(family.isin("hevc", "h265"), choose(p, HEVC_PROFILES, 1.0)).otherwise(1.0)
    return base * bits * named * F.when(interlaced, 1.0).otherwise(1.01)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; a name of a leading dot alone has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def path_key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def terms(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[|]"), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def sample_offsets(size: Column, block: int, a: int, b: int) -> Column:
    span = F.greatest(F.lit(0).cast("bigint"), size - block)
    at = lambda p: F.bround(span * (p / 100.0)).cast("bigint")
    return F.array_sort(F.array_distinct(F.array(F.lit(0).cast("bigint"), span, at(a), at(b))))


def alpha_label(index: Column, letters: int = 13) -> Column:
    """Bijective base 26 of an index from 0: a .. z, aa .. zz, aaa ..; 13 letters name more than 2^61 indexes."""
    out, below = F.lit(None).cast("string"), lambda n: (26**n - 26) // 25  # noqa: E731  labels of fewer than n letters
    for n in range(letters, 0, -1):
        rest = index - below(n)
        digit = lambda k, r=rest: F.char(F.call_function("div", r, F.lit(26**k)) % 26 + 97)
        out = F.when(index < below(n + 1), F.concat(*[digit(k) for k in range(n - 1, -1, -1)])).otherwise(out)
    return out


def rational(text: Column) -> Column:
    parts = F.split(text, "/")
    a, b = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, F.coalesce(a, F.lit(0.0))).otherwise(F.coalesce(F.try_divide(a, b), F.lit(0.0)))


def positive(text: Column) -> Column:
    """A number of 0 or more; 0 where there is none."""
    return F.greatest(F.lit(0.0), F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0)))


def bit_depth(raw: Column, pix_fmt: Column) -> Column:
    """From the sample's bits if they are told, else from the pixel format's name; 8, 10, 12, 14 or 16."""
    own, name = positive(raw).cast("int"), F.lower(F.trim(pix_fmt))
    told = [F.regexp_extract(name, p, 1).try_cast("int") for p in (r"p0?(10|12|14|16)(?:le|be)?$", r"(10|12|14|16)(?:le|be)?$")]
    n = F.when(own > 0, own).otherwise(F.coalesce(*told, F.lit(8)))
    return F.when(n >= 16, 16).when(n >= 14, 14).when(n >= 12, 12).when(n >= 10, 10).otherwise(8)


def level_text(level: Column) -> Column:
    """41 as 4.1, 5 as 5, 0 as nothing; text that is no whole number stays."""
    text = F.trim(F.coalesce(level, F.lit("")))
    n = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    spelt = F.when(n <= 0, "").when(n < 10, n.cast("string")).otherwise(F.concat_ws(".", F.floor(n / 10).cast("string"), (n % 10).cast("string")))
    return F.when(n.isNull(), text).otherwise(spelt)


def languages(values: Column) -> Column:
    clean = F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != "")
    return F.array_join(F.array_sort(F.array_distinct(clean)), ",")


def fixed(value: Column, digits: int) -> Column:
    """A double with so many digits as printf writes it: its exact value is rounded, a tie to the even digit.

    Java's formatter rounds the shortest decimal and ties up. Twice the scaled value is compared with the
    odd number in the middle; halves of 24 and 29 bits keep the products, and so the sign, exact.
    """
    scale = 10**digits

    def text(x):
        floor = F.floor(x * scale)
        high = x.cast("float").cast("double")
        apart = (high * (2.0 * scale) - (floor * 2 + 1)) + (x - high) * (2.0 * scale)
        n = floor + F.when((apart > 0) | ((apart == 0) & (floor % 2 == 1)), 1).otherwise(0)
        return F.format_string(f"%d.%0{digits}d", F.call_function("div", n, F.lit(scale)), n % scale)

    value = value.cast("double")
    small = F.abs(value) < float(2**52 // scale)  # beyond, the formatter's own rounding stays
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(small, F.concat(sign, bound(F.abs(value), text))).when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def bytes_text(size: Column) -> Column:
    out = F.concat(fixed(size / 1024.0**5, 1), F.lit(" PB"))
    for unit, p in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        out = F.when(size < 1024.0 ** (p + 1), F.concat(fixed(size / 1024.0**p, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("bigint"))).otherwise(out)


def normal_pair(a: Column, b: Column, default_a: int = 23, default_b: int = 78) -> Column:
    """Two percentages within 0 to 100, distinct and in order, as an array."""
    clamp = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c.try_cast("int"), F.lit(d))))
    x, y = clamp(a, default_a), clamp(b, default_b)
    same = x == y
    x, y = F.when(same & (y >= 100), F.greatest(F.lit(0), x - 1)).otherwise(x), F.when(same & (y < 100), y + 1).otherwise(y)
    return F.array(F.least(x, y), F.greatest(x, y))


def even_pick(values: Column, count: int) -> Column:
    """count values spread evenly over an array; null where it has fewer."""
    n = F.size(values)
    at = lambda i: F.try_element_at(values, F.floor(i * (n - 1) / F.lit(max(1, count - 1))).cast("int") + 1)
    return F.when(n >= count, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at))


def scene_times(log: Column, duration: Column) -> Column:
    """The distinct times that a scene filter's log tells, within the duration, in order of appearance."""
    found = F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda t: t.cast("double"))
    return F.filter(F.array_distinct(found), lambda t: (t > 0) & (t < F.greatest(F.lit(0.0), duration)))


def sample_times(duration: Column) -> Column:
    return F.transform(F.array(*[F.lit(p) for p in SAMPLE_PERCENTS]), lambda p: p * F.greatest(F.lit(0.0), duration))


def media_duration(container: Column, units: Column, stream: Column, base: Column) -> Column:
    """Seconds from a container's duration and units a second (or seconds a unit; millionths where neither is told), else from a stream's and its time base."""
    whole = F.when(units > 1, container / units).when(units > 0, container * units).otherwise(container / 1_000_000.0)
    part = F.when(base > 0, stream * base)
    first, second = (F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0))) for v in (whole, part))
    return F.when(first > 0, first).otherwise(second)


def audio_text(output: Column) -> Column:
    """The fingerprint that an audio tool's JSON output holds; null where it is missing or blank."""
    text = F.trim(F.get_json_object(output, "$.fingerprint"))
    return F.when(text != "", text)


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grid_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits, row by row: whether a pixel is brighter than the one to its left; pixels row by row."""
    i = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    place = lambda k: F.floor(k / (width - 1)).cast("int") * width + k % (width - 1)
    bit = lambda p, k: (F.get(p, place(k) + 1) > F.get(p, place(k))).cast("bigint")
    return bound(pixels, lambda p: F.aggregate(i, F.lit(0).cast("bigint"), lambda h, k: F.shiftleft(h, 1).bitwiseOR(bit(p, k))))


def nearest_grid(pixels: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Pixels of a smaller or larger frame, each the one at the evenly spaced place; zeros of an empty frame."""
    at = lambda i, size, to: F.floor(i * (size - 1) / F.lit(max(1, to - 1))).cast("int")
    cell = lambda p, k: F.get(p, at(F.floor(k / to_width), height, to_height) * width + at(k % to_width, width, to_width))
    zero = F.lit(0).cast("int")
    cells = F.sequence(F.lit(0), F.lit(to_width * to_height - 1))
    return bound(pixels, lambda p: F.transform(cells, lambda k: F.when((width > 0) & (height > 0), cell(p, k).cast("int")).otherwise(zero)))


def hashes_valid(hashes: Column) -> Column:
    """Whether any frame was decoded: a missing frame counts as 0, and all zeros is an error."""
    return F.exists(F.coalesce(hashes, F.array().cast("array<bigint>")), lambda h: F.coalesce(h, F.lit(0)) != 0)


def text_list(json: Column) -> Column:
    """The trimmed texts of a JSON list, blank ones left out; no list gives none."""
    parsed = F.from_json(json, "array<string>")
    trimmed = F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit(""))))
    return F.filter(trimmed, lambda t: t != "")


def extension_list(values: Column) -> Column:
    """Trimmed, lower-cased, without leading dots, each once, in order of appearance."""
    clean = F.transform(values, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"^\.+", ""))
    return F.array_distinct(F.filter(clean, lambda e: e != ""))


def root_list(values: Column) -> Column:
    """Roots for comparison: trimmed, lower-cased, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda r: F.lower(F.trim(r))), lambda r: r != "")))


# The names each kind of setting may have, the default first.
SETTINGS = {
    "profile": ("balanced", "conservative", "aggressive", "custom"),
    "mode": ("off", "same_aspect", "any_aspect"),
    "action": ("keep", "rename", "delete"),
    "reason": ("perceptual", "trimmed_match", "audio_match"),
    "backend": ("pyav", "ffprobe"),
}


def setting(kind: str, value: Column) -> Column:
    """The value, trimmed and lower-cased, if the kind has it; else the kind's default."""
    low = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(low.isin(*SETTINGS[kind]), low).otherwise(F.lit(SETTINGS[kind][0]))


def custom_threshold(value: Column) -> Column:
    n = F.trim(value.cast("string")).try_cast("double")
    return F.when(n.isNull(), F.lit(0.18)).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(0.30), n)))


def scan_set_key(roots: Column, extensions: Column, profile: Column, threshold: Column, scenes: Column, audio: Column, mode: Column) -> Column:
    """The identity of a set of scans: its normalised definition as JSON with keys in order."""
    return F.to_json(F.struct(
        audio.alias("audio_fingerprint_enabled"), setting("mode", mode).alias("cross_resolution_mode"), custom_threshold(threshold).alias("custom_similarity_threshold"),
        F.array_sort(extension_list(extensions)).alias("extensions"), root_list(roots).alias("roots"), scenes.alias("scene_aware_sampling"), setting("profile", profile).alias("similarity_profile"),
    ))


def mib_rate(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.greatest(F.lit(0), size) / F.lit(1048576.0) / seconds).otherwise(F.lit(0.0))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the rate so far; null before three are done or five seconds are over."""
    return F.when((done >= 3) & (elapsed >= 5), F.greatest(F.lit(0), total - done) * elapsed / done)


def first_chars(text: Column, n: int = 500) -> Column:
    return F.left(text, F.lit(n))


def last_chars(text: Column, n: int = 400) -> Column:
    return F.right(text, F.lit(n))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a name of a leading dot alone stays whole."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]+$", "")
