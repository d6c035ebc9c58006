"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from .functions.exprs import CODEC_RANKS, H264_PROFILES, HEVC_PROFILES, RISKY_SUFFIXES, SAMPLE_PERCENTS

_PCTS = ", ".join(map(repr, SAMPLE_PERCENTS))
_BIT = "CASE WHEN ascii(substr(f, i + 1, 1)) > ascii(substr(f, i, 1)) THEN '1' ELSE '0' END"
ASSETS = f"""assets AS (
  SELECT doc_id AS file_id, '/lib/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext AS path, n_chars AS size, n_chars / 10.0::DOUBLE AS duration_s,
    ext, source, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE [1920, 1280, 1920, 640][doc_id % 4 + 1] END AS width, [1080, 720, 800, 480][doc_id % 4 + 1] AS height,
    ['hevc', 'h264', 'vp9', 'mpeg4'][(doc_id // 4) % 4 + 1] AS codec, ['Main', 'High', 'Main 10', ''][(doc_id // 16) % 4 + 1] AS codec_profile,
    ['4.1', '5.1', '', 'x'][(doc_id // 2) % 4 + 1] AS codec_level, [8, 10, 12][doc_id % 3 + 1] AS bit_depth, doc_id % 13 = 0 AS is_interlaced,
    ['', 'HDR10', '', 'HLG', 'DV'][(doc_id // 3) % 5 + 1] AS hdr_format, 500000 + (doc_id * 7919 % 7500) * 1000 AS bitrate,
    1700000000000000000 + (doc_id * 104729 % 1000003) * 1000 AS mtime_ns, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE '' END AS audio_fingerprint,
    list_transform(list_transform([{_PCTS}]::DOUBLE[], lambda p: substr(text, floor(n_chars * p)::INT + 1, 65)),
      lambda f: CAST(CAST(array_to_string(list_transform(range(1, 65), lambda i: {_BIT}), '') AS BIT) AS BIGINT)) AS hashes,
    [24.0, 25.0, 29.97][doc_id % 3 + 1]::DOUBLE AS fps, ['mov', 'matroska', 'avi', 'mov', 'matroska'][doc_id % 5 + 1] AS container, (doc_id % 3)::INT AS audio_stream_count,
    CASE WHEN doc_id % 3 > 0 THEN ['aac', 'opus'][doc_id % 2 + 1] ELSE '' END AS audio_codec, doc_id % 3 * 96000 AS audio_bitrate
  FROM (SELECT * REPLACE (coalesce(text, '') AS text, coalesce(n_chars, 0) AS n_chars), ['mp4', 'mkv', 'avi', 'mov', 'webm'][doc_id % 5 + 1] AS ext FROM documents))"""
ITEMS = f"""{ASSETS}, decoded AS (SELECT * FROM assets WHERE len(list_filter(hashes, lambda h: h <> 0)) > 0), items AS (
  SELECT * FROM decoded
  UNION ALL SELECT * REPLACE (file_id + 10000000 AS file_id, duration_s + 5 AS duration_s, list_transform(hashes, lambda h, k: CASE WHEN k IN (1, 2, 11, 12) THEN ~h ELSE h END) AS hashes)
    FROM decoded WHERE file_id % 7 = 3
  UNION ALL SELECT * REPLACE (file_id + 20000000 AS file_id, list_transform(hashes, lambda h: ~h) AS hashes) FROM decoded WHERE file_id % 11 = 5
  UNION ALL SELECT * REPLACE (file_id + 30000000 AS file_id, '' AS audio_fingerprint, list_transform(hashes, lambda h: xor(h, (1::BIGINT << (file_id % 17 + 4)::INT) - 1)) AS hashes) FROM decoded WHERE file_id % 5 = 2)"""


def blocked(of: str, reach: int, mode: str) -> str:
    asp = "AND x.aspect = y.aspect" if mode == "off" else ""
    occ = "AND o.aspect = d.aspect" if mode == "off" else ""
    return f"""bucketed AS (SELECT file_id, CAST(round_even(greatest(0, duration_s) / 5, 0) AS INT) AS bucket,
    CASE WHEN height <= 0 THEN 0 ELSE round_even(width / height * 4, 0) / 4 END::DOUBLE AS aspect FROM {of}),
  dealt AS (SELECT file_id, aspect, unnest(range(bucket - {reach}, bucket + {reach} + 1)) AS centre FROM bucketed),
  met AS (SELECT * FROM dealt d WHERE EXISTS (SELECT 1 FROM bucketed o WHERE o.bucket = d.centre {occ})),
  pairs AS (SELECT DISTINCT x.file_id AS file_a, y.file_id AS file_b FROM met x JOIN met y ON x.centre = y.centre AND x.file_id < y.file_id {asp})"""


def _gate(mode: str) -> str:
    aspect = {"off": 0.2, "same_aspect": 0.5}.get(mode)
    return f"""abs(a.duration_s - b.duration_s) <= 8 AND greatest(a.duration_s, b.duration_s) > 0
    AND least(a.duration_s, b.duration_s) / greatest(a.duration_s, b.duration_s) >= greatest(0.7, 1 - 8 / greatest(1, greatest(a.duration_s, b.duration_s)))
    AND a.height > 0 AND b.height > 0 AND a.width > 0 AND b.width > 0""" + (f" AND CASE WHEN a.width > 0 AND b.width > 0 AND a.height > 0 AND b.height > 0 THEN abs(log2((a.width / a.height) / (b.width / b.height))) <= {aspect} ELSE false END" if aspect else "")


def _median(positions) -> str:
    return "list_median([" + ", ".join(f"bit_count(xor(a.hashes[{i + 1}], b.hashes[{i + 1}]))::DOUBLE" for i in positions) + "])"


def cascade(limit: float = 0.18, mode: str = "off", audio: bool = True) -> str:
    full, inner = _median(range(12)), _median(range(2, 10))
    return f"""{ITEMS}, {blocked("items", 1, mode)},
  judged AS (SELECT *, CASE WHEN NOT gated THEN NULL WHEN NOT rejected AND distance <= CASE WHEN inner_mode THEN {limit!r}::DOUBLE * 0.9::DOUBLE ELSE {limit!r}::DOUBLE END
        THEN CASE WHEN inner_mode THEN 'trimmed_match' ELSE 'perceptual' END WHEN same_audio THEN 'audio_match' END AS match_reason FROM (
    SELECT file_a, file_b, {_gate(mode)} AS gated, abs(a.duration_s - b.duration_s) > 3 AS inner_mode, abs(a.duration_s - b.duration_s) AS gap_s,
      {str(audio).lower()} AND a.audio_fingerprint <> '' AND a.audio_fingerprint = b.audio_fingerprint AS same_audio,
      CASE WHEN abs(a.duration_s - b.duration_s) > 3 THEN {_median((2, 6, 9))} ELSE {_median((0, 6, 11))} END > 22 AS rejected,
      CASE WHEN abs(a.duration_s - b.duration_s) > 3 THEN {inner} ELSE {full} END / 64 AS distance
    FROM pairs JOIN items a ON a.file_id = file_a JOIN items b ON b.file_id = file_b)),
  edges AS (SELECT file_a, file_b, CASE WHEN match_reason = 'audio_match' THEN 1.0::DOUBLE ELSE 1 - distance END AS score, match_reason, gap_s FROM judged WHERE match_reason IS NOT NULL)"""


def _table(value: str, table: dict, other: float) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in table.items()) + f" ELSE {other}::DOUBLE END"


QUALITY = f"""(((0.65::DOUBLE * (width * height) + 0.25::DOUBLE * bitrate + 0.10::DOUBLE * {_table("lower(codec)", CODEC_RANKS, 0.7)})
    * CASE WHEN bit_depth >= 12 THEN 1.10::DOUBLE WHEN bit_depth >= 10 THEN 1.05::DOUBLE ELSE 1 END)
    * CASE trim(lower(codec)) WHEN 'h264' THEN {_table("lower(trim(codec_profile))", H264_PROFILES, 1.0)}
        WHEN 'hevc' THEN {_table("lower(trim(codec_profile))", HEVC_PROFILES, 1.0)} WHEN 'h265' THEN {_table("lower(trim(codec_profile))", HEVC_PROFILES, 1.0)} ELSE 1 END)
    * CASE WHEN is_interlaced THEN 1.0::DOUBLE ELSE 1.01::DOUBLE END"""
LEVEL = "coalesce(try_cast(trim(codec_level) AS DOUBLE), 0)"
_ORDERS = {
    "best": "quality DESC, level DESC, is_interlaced::INT, mtime_ns, lower(path)", "worst": "quality, level, is_interlaced::INT DESC, mtime_ns, lower(path)",
    "larger": "size DESC, quality DESC, lower(path)", "smaller": "size, quality DESC, lower(path)",
    "newer": "mtime_ns DESC, quality DESC, lower(path)", "older": "mtime_ns, quality DESC, lower(path)",
}


def members(strategy: str = "best") -> str:
    return f"""WITH RECURSIVE {cascade()},
  sides AS (SELECT file_a AS file_id, file_b AS other, score, match_reason, gap_s FROM edges UNION ALL SELECT file_b, file_a, score, match_reason, gap_s FROM edges),
  reach(node, seen) AS (SELECT DISTINCT file_id, file_id FROM sides UNION SELECT r.node, s.other FROM reach r JOIN sides s ON s.file_id = r.seen),
  comps AS (SELECT node AS file_id, min(seen) AS group_id FROM reach GROUP BY node),
  scored AS (SELECT file_id, avg(score) AS similarity_score, max(CASE match_reason WHEN 'trimmed_match' THEN 3 WHEN 'audio_match' THEN 2 ELSE 1 END) AS rank,
      coalesce(min(CASE WHEN match_reason = 'trimmed_match' THEN gap_s END), 0) AS match_duration_delta_s FROM sides GROUP BY file_id),
  graded AS (SELECT *, {QUALITY} AS quality, {LEVEL} AS level FROM items),
  members AS (SELECT g.* EXCLUDE (hashes), group_id, similarity_score, ['perceptual', 'audio_match', 'trimmed_match'][rank] AS match_reason, match_duration_delta_s,
      row_number() OVER (PARTITION BY group_id ORDER BY {_ORDERS[strategy]}, g.file_id) = 1 AS keep_default
    FROM graded g JOIN comps USING (file_id) JOIN scored USING (file_id)),
  metrics AS (SELECT group_id, count(*) AS members, sum(size)::BIGINT AS total_size_bytes, greatest(0, sum(size) - sum(CASE WHEN keep_default THEN size ELSE 0 END))::BIGINT AS reclaimable_bytes,
      avg(similarity_score) AS average_confidence, max(size) AS largest, min(size) AS smallest, min(lower(path)) AS tie FROM members GROUP BY group_id)"""


def filtered(include: str, exclude: str = "false", match_all: bool = False) -> str:
    return f"""{members()}, kept AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM members WHERE NOT ({exclude})),
  hit AS (SELECT *, bool_{"and" if match_all else "or"}({include}) OVER (PARTITION BY group_id) AS hit FROM kept WHERE n >= 2)
SELECT group_id, file_id FROM hit WHERE hit"""


def alpha(index: str, letters: int = 13) -> str:
    """Bijective base 26 of an index from 0: a .. z, aa .. zz, aaa ..; below: labels of fewer letters."""
    below, powers = [(26**n - 26) // 25 for n in range(1, letters + 1)], [26**n for n in range(letters)]
    n = f"len(list_filter({below}, lambda b: b <= {index}))"
    return f"array_to_string(list_transform(range({n}, 0, -1), lambda k: chr((({index} - {below}[{n}]) // {powers}[k] % 26 + 97)::INT)), '')"


_NAME = "list_last(string_split(path, '/'))"
ORACLES: dict[str, str] = {
    "dup_groups_report": f"""{members()} SELECT row_number() OVER (ORDER BY members DESC, reclaimable_bytes DESC, m.group_id)::INT AS position,
      printf('G%04d', row_number() OVER (ORDER BY members DESC, reclaimable_bytes DESC, m.group_id)) AS label, m.group_id, members, total_size_bytes, reclaimable_bytes,
      round(average_confidence, 6) AS average_confidence, k.file_id AS keep_file_id, k.path AS keep_path FROM metrics m JOIN (SELECT * FROM members WHERE keep_default) k USING (group_id)""",
    "block_buckets": f"WITH {ASSETS}, {blocked('assets', 1, 'off')} SELECT bucket, aspect, count(*) AS n FROM bucketed GROUP BY ALL",
    "block_pairs_off": f"WITH {ASSETS}, {blocked('assets', 1, 'off')} SELECT * FROM pairs",
    "block_pairs_any": f"WITH {ASSETS}, {blocked('assets', 1, 'any')} SELECT * FROM pairs",
    "edges_trimmed": f"WITH {cascade()} SELECT file_a, file_b, score, gap_s FROM edges WHERE match_reason = 'trimmed_match'",
    "edges_audio_rescue": f"WITH {cascade()} SELECT file_a, file_b, score FROM edges WHERE match_reason = 'audio_match'",
    "pair_distances": f"""WITH {ITEMS}, {blocked("items", 0, "off")} SELECT file_a, file_b, bit_count(xor(a.hashes[1], b.hashes[1]))::INT AS first_bits, {_median(range(12))} / 64 AS full_distance,
      {_median(range(2, 10))} / 64 AS inner_distance, {_median((0, 6, 11))} AS prefilter_full, {_median((2, 6, 9))} AS prefilter_inner
      FROM pairs JOIN items a ON a.file_id = file_a JOIN items b ON b.file_id = file_b""",
    "match_stats": f"""WITH {cascade()} SELECT count(*) AS candidate_pairs, count_if(gated)::BIGINT AS prefilter_pairs, count_if(gated AND rejected)::BIGINT AS prefilter_rejected,
      count_if(gated AND NOT rejected)::BIGINT AS full_distance_pairs, count_if(gated AND inner_mode)::BIGINT AS inner_mode_pairs, count_if(match_reason = 'trimmed_match')::BIGINT AS inner_mode_accepted,
      count(match_reason) AS accepted_pairs, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM (SELECT DISTINCT bucket, aspect FROM bucketed)) AS buckets FROM judged""",
    "frame_hashes": f"WITH {ASSETS} SELECT file_id, hashes, array_to_string(list_transform(hashes, lambda h: upper(printf('%016x', h))), '') AS encoded, true AS round_trip FROM assets",
    "components": f"{members()} SELECT file_id AS node, group_id AS component FROM comps",
    "lane_components": """WITH RECURSIVE tok AS (SELECT s_suppkey, unnest([-(s_nationkey::BIGINT * 10 + 1), -(floor(s_acctbal / 100)::BIGINT * 10 + 100005)]) AS t FROM supplier),
      sides AS (SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM tok x JOIN tok y USING (t)),
      reach(node, seen) AS (SELECT DISTINCT a, a FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON s.a = r.seen)
      SELECT node AS root, min(seen) AS lane FROM reach GROUP BY node""",
    "group_items": f"""{members()} SELECT group_id, file_id, round(similarity_score, 6) AS similarity_score, match_reason, round(match_duration_delta_s, 6) AS match_duration_delta_s, keep_default,
      CASE WHEN keep_default THEN 'keep' ELSE 'rename' END AS selected_action FROM members""",
    "group_metrics": f"{members()} SELECT group_id, members, total_size_bytes, reclaimable_bytes, round(average_confidence, 6) AS average_confidence FROM metrics",
    "quality_score": f"WITH {ASSETS} SELECT file_id, floor({QUALITY} * 1000 + 0.123)::BIGINT AS quality, {LEVEL} AS level FROM assets",
    "filter_text": filtered("contains(lower(path), '/en/') OR contains(lower(path), 'doc_1')", f"contains(lower({_NAME}), '.webm')"),
    "filter_match_all": filtered("contains(lower(path), '/en/')", match_all=True),
    "filter_structured": filtered("size >= 500 AND duration_s >= 60 AND similarity_score >= 0.95 AND width >= 1280 AND ext IN ('mp4', 'mkv', 'avi') AND codec IN ('hevc', 'h264', 'vp9')"),
    "filter_hdr": filtered("hdr_format <> ''"),
    "filter_options": f"{members()} SELECT DISTINCT ext, codec FROM members",
    "dup_stats": f"""{members()} SELECT count(*) AS groups, sum(members)::BIGINT AS files, sum(total_size_bytes)::BIGINT AS total_bytes, sum(total_size_bytes - smallest)::BIGINT AS save_max,
      sum(total_size_bytes - largest)::BIGINT AS save_min, max(members) AS largest_group, round(avg(members), 6) AS mean_group, median(members)::DOUBLE AS median_group, sum(members - 1)::BIGINT AS extra_files FROM metrics""",
    "export_duplicates": f"""{members()} SELECT group_id, path AS file_path, duration_s AS duration, container, width, height, fps, is_interlaced::INT AS interlaced, bit_depth, hdr_format, bitrate, codec,
      codec_profile, codec_level, audio_stream_count, audio_codec, audio_bitrate, round(similarity_score, 6) AS similarity_score, keep_default::INT AS is_keep_default,
      CASE WHEN keep_default THEN 'keep' ELSE 'rename' END AS selected_action FROM members""",
    "export_nested_json": f"""{members()} SELECT 7::BIGINT AS scan_id, 'balanced' AS profile, group_id, sum(size)::BIGINT AS total_size_bytes, round(avg(similarity_score), 6) AS average_confidence,
      greatest(0, sum(size) - sum(CASE WHEN keep_default THEN size ELSE 0 END))::BIGINT AS reclaimable_bytes,
      string_agg(file_id || ':' || keep_default || ':' || path, ',' ORDER BY keep_default DESC, width * height DESC, bitrate DESC, file_id) AS items FROM members GROUP BY group_id""",
    "load_groups": f"""{members()} SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY keep_default DESC, width * height DESC, bitrate DESC, file_id)::INT AS position
      FROM members WHERE file_id % 5 > 0""",
    "display_rows": f"""{members()} SELECT group_id, file_id, list_last(string_split(path, '/')) AS name, ext AS extension, format('{{:,}}', size) AS size, width || 'x' || height AS resolution, printf('%.3f', fps) AS fps,
      CASE WHEN is_interlaced THEN 'Yes' ELSE '' END AS interlaced, bit_depth || '-bit' AS bit_depth, printf('%.1fs', duration_s) AS duration, printf('%.3f', similarity_score) AS similarity,
      CASE match_reason WHEN 'trimmed_match' THEN 'Trimmed' WHEN 'audio_match' THEN 'Audio' ELSE 'Perceptual' END AS match, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM members""",
    "exact_clusters": f"""WITH r AS (SELECT n_chars % 2 AS group_id, '/lib/' || source || '/doc_' || doc_id AS path, n_chars AS size, sha256(text) AS digest FROM documents),
      c AS (SELECT group_id, size, digest, count(*) AS members, min(lower(path)) AS first_path FROM r GROUP BY ALL HAVING count(*) >= 2),
      n AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY first_path NULLS FIRST, digest NULLS FIRST, size) - 1)::INT AS cluster FROM c)
      SELECT *, CASE WHEN cluster < 4 THEN ['●', '■', '♥', '♦'][cluster + 1] ELSE {alpha("cluster - 4")} END AS label FROM n""",
    "sampled_digest": """WITH s AS (SELECT page_id, html, length(html) AS size, greatest(0, length(html) - 64) AS span FROM pages),
      o AS (SELECT *, list_sort(list_distinct([0, span, round_even(span * (23 / 100), 0)::BIGINT, round_even(span * (78 / 100), 0)::BIGINT])) AS offs FROM s)
      SELECT page_id, size::INT AS size, array_to_string(offs, ',') AS offsets, sha256(unhex(upper(printf('%016x', size)) || array_to_string(list_transform(offs, lambda p:
        upper(printf('%016x', p)) || upper(printf('%016x', length(substr(html, p + 1, 64)))) || hex(encode(substr(html, p + 1, 64)))), ''))) AS digest FROM o""",
    "decoded_frames": f"""WITH p AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n, page_id % 5 = 0 AS risky FROM pages),
      b AS (SELECT *, unnest([1, 2]) AS step FROM p),
      f AS (SELECT page_id, step, list_transform([{_PCTS}]::DOUBLE[], lambda t: floor(n * t)::BIGINT) AS starts, h, n FROM b),
      k AS (SELECT page_id, step, list_transform(starts, lambda o: CASE WHEN o + 71 * step < n THEN list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, 64), lambda q:
        (('0x' || substr(h, 2 * (o + step * (q // 8 * 9 + q % 8 + 1)) + 1, 2))::INT > ('0x' || substr(h, 2 * (o + step * (q // 8 * 9 + q % 8)) + 1, 2))::INT)::HUGEINT)), lambda x, y: x * 2 + y) ELSE 0 END) AS bits FROM f),
      e AS (SELECT page_id, step, list_sum(list_transform(bits, lambda x: (x > 0)::INT)) > 0 AS any_bit, array_to_string(list_transform(bits, lambda x: upper(printf('%016x', x::UBIGINT))), '') AS hashes FROM k),
      w AS (SELECT p.page_id, risky, x.any_bit AS one_ok, x.hashes AS one, y.any_bit AS two_ok, y.hashes AS two FROM p JOIN e x ON x.page_id = p.page_id AND x.step = 1 JOIN e y ON y.page_id = p.page_id AND y.step = 2),
      t AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'opencv:error:cannot open ' || page_id WHEN page_id % 89 = 5 THEN 'opencv:timeout:opencv took more than 0.5 s' WHEN NOT one_ok THEN 'opencv:error:no sample frame could be decoded' ELSE 'opencv:success:' END AS o,
        CASE WHEN page_id % 97 = 6 THEN 'pyav:error:pyav ended its process' WHEN page_id % 2 = 0 THEN 'pyav:error:no stream' WHEN NOT two_ok THEN 'pyav:error:no sample frame could be decoded' ELSE 'pyav:success:' END AS a,
        CASE WHEN page_id % 4 = 1 THEN 'ffmpeg:error:bad exit' WHEN NOT one_ok THEN 'ffmpeg:error:no sample frame could be decoded' ELSE 'ffmpeg:success:' END AS g FROM w),
      c AS (SELECT *, CASE WHEN risky THEN [g, a] ELSE [o, a, g] END AS every FROM t),
      r AS (SELECT *, coalesce(list_position(list_transform(every, lambda x: x LIKE '%:success:'), true), 0) AS hit FROM c),
      m AS (SELECT *, CASE WHEN hit > 0 THEN every[1:hit] ELSE every END AS made, CASE WHEN hit > 0 THEN split_part(every[hit], ':', 1) END AS backend FROM r)
      SELECT page_id, array_to_string(made, '; ') AS attempts, backend, CASE WHEN hit > 1 THEN backend END AS fallback, CASE backend WHEN 'pyav' THEN two WHEN 'opencv' THEN one WHEN 'ffmpeg' THEN one END AS hashes,
        CASE WHEN hit > 0 THEN '{{"attempts":[' || array_to_string(list_transform(made, lambda x: '{{"decoder_backend":"' || split_part(x, ':', 1) || '","message":"' || split_part(x, ':', 3) || '","status":"' || split_part(x, ':', 2) || '"}}'), ',')
          || '],"decoder_backend":"' || backend || '","risky_format_bypass":' || risky || '}}' END AS provenance,
        CASE WHEN hit = 0 THEN array_to_string(list_transform(made, lambda x: split_part(x, ':', 3)), ' | ') END AS error FROM m""",
    "probed_files": """SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN b END AS backend, b || CASE WHEN page_id % 7 = 3 THEN ':error:cannot probe' ELSE ':success:' END AS attempts,
      CASE WHEN page_id % 7 <> 3 THEN octet_length(encode(html)) / 8.0::DOUBLE ELSE 0 END AS duration_s, CASE WHEN ok THEN length(url) ELSE 0 END::INT AS width, CASE WHEN ok THEN '' ELSE 'Invalid video metadata' END AS probe_error
      FROM (SELECT *, b = 'pyav' AND page_id % 7 <> 3 AND octet_length(encode(html)) > 0 AS ok FROM (SELECT *, CASE page_id % 3 WHEN 1 THEN 'ffprobe' ELSE 'pyav' END AS b FROM pages))""",
    "byte_digests": """WITH s AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) + CASE WHEN page_id % 9 = 4 THEN 1 ELSE 0 END AS size FROM pages), p AS (SELECT *, greatest(0, size - 64) AS span FROM s),
      o AS (SELECT *, list_sort(list_distinct([0, span, round_even(span * (23 / 100), 0)::BIGINT, round_even(span * (78 / 100), 0)::BIGINT])) AS offs FROM p)
      SELECT page_id, size, array_to_string(offs, ',') AS offsets, CASE WHEN page_id % 9 <> 4 THEN sha256(unhex(upper(printf('%016x', size)) || array_to_string(list_transform(offs, lambda q:
        upper(printf('%016x', q)) || upper(printf('%016x', least(64, size - q))) || substr(h, 2 * q + 1, 128)), ''))) END AS digest, CASE WHEN page_id % 9 = 4 THEN 'failed' END AS error FROM o""",
    "sample_times": f"""WITH {ASSETS} SELECT file_id, array_to_string(list_transform([{_PCTS}]::DOUBLE[], lambda p: printf('%.4f', p * duration_s)), ',') AS times FROM assets""",
    "hardlink_canonical": """WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 OR doc_id % 11 = 0 THEN 'only ' || doc_id ELSE sha256(text) END AS i, source || '/' || doc_id AS path FROM documents)
      SELECT path, CASE WHEN row_number() OVER w = 1 THEN 'canonical' ELSE 'hardlink' END AS kind, first_value(path) OVER w AS target FROM d WINDOW w AS (PARTITION BY i ORDER BY lower(path), path)""",
    "scan_links": """WITH d AS (SELECT doc_id, sha256(text) AS i, source || '/' || doc_id AS path FROM documents),
      h AS (SELECT path, row_number() OVER w AS n, first_value(path) OVER w AS target FROM d WINDOW w AS (PARTITION BY i ORDER BY lower(path), path))
      SELECT 7 AS scan_id, 'hardlink' AS link_kind, path AS link_path, target AS target_original_path, 1 AS target_exists, '/lib' AS source_root FROM h WHERE n > 1
      UNION ALL SELECT 7, 'symlink', path || '.lnk', path, (doc_id % 2 = 0)::INT, '/lib' FROM d WHERE doc_id % 9 = 4""",
    "latest_scan": "SELECT o_orderkey AS scan_id, o_custkey AS scan_set, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'paused' ELSE 'running' END AS status FROM orders ORDER BY scan_id DESC LIMIT 1",
    "lane_plan": """WITH l AS (SELECT s_nationkey AS lane, count(*) AS roots, greatest(1, coalesce(min(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 5 END), 1)) AS cap FROM supplier GROUP BY ALL)
      SELECT *, (SELECT sum(cap) FROM l)::BIGINT AS effective, greatest(16, (SELECT sum(cap) FROM l))::BIGINT AS requested FROM l""",
    "filter_terms": """SELECT item_id, array_to_string(list_filter(list_transform(string_split(' A |' || replace(text, ',', '|') || '| |B', '|'), lambda t: lower(trim(t))), lambda t: t <> ''), '#') AS terms FROM benchmark""",
    "scan_set_key": """WITH k AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(source || ',MKV, .mp4 ,mkv,' || lang, ','), lambda e: regexp_replace(lower(trim(e)), '^\\.+', '')), lambda e: e <> ''))) AS e,
      list_sort(list_distinct(['/lib/b', lower(trim('/lib/' || source))])) AS r FROM documents)
      SELECT doc_id, '{"audio_fingerprint_enabled":' || (doc_id % 3 = 0) || ',"cross_resolution_mode":"' || ['any_aspect', 'off', 'off'][doc_id % 3 + 1] || '","custom_similarity_threshold":' || ['0.3', '0.18', '0.2'][doc_id % 3 + 1]
      || ',"extensions":["' || array_to_string(e, '","') || '"],"roots":["' || array_to_string(r, '","') || '"],"scene_aware_sampling":' || (doc_id % 2 = 0)
      || ',"similarity_profile":"' || ['balanced', 'custom', 'balanced'][doc_id % 3 + 1] || '"}' AS scan_set_key FROM k""",
    "thumb_key": f"WITH {ASSETS} SELECT file_id, sha1(concat_ws('|', path, size, mtime_ns, '160x90', '50', 'left', 'v2')) AS key FROM assets",
    "bench_quota": f"""WITH {ASSETS}, f AS (SELECT path, source AS root, regexp_extract(lower(path), '(\\.[^./]+)$', 1) IN {RISKY_SUFFIXES} AS risky FROM assets),
      n AS (SELECT *, row_number() OVER (PARTITION BY root, risky ORDER BY lower(path), path) AS k FROM f),
      t AS (SELECT *, CASE WHEN risky AND k <= 6 THEN 0 WHEN NOT risky AND k <= 4 THEN 1 ELSE 2 END AS tier FROM n),
      p AS (SELECT path, root, risky, tier, row_number() OVER (ORDER BY tier, lower(root), lower(path), path)::INT AS position FROM t) SELECT * FROM p WHERE position <= 150""",
    "stream_microbatch": "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
}
for _mode in ("off", "same_aspect", "any_aspect"):
    ORACLES[f"candidate_gate_{_mode}"] = (
        f"WITH {ASSETS}, {blocked('assets', 1, _mode)} SELECT file_a, file_b FROM pairs JOIN assets a ON a.file_id = file_a JOIN assets b ON b.file_id = file_b WHERE {_gate(_mode)}"
    )
for _key, _options in {"conservative": {"limit": 0.12}, "balanced": {}, "aggressive": {"limit": 0.24}, "custom": {"limit": 0.29}, "no_audio_any_aspect": {"audio": False, "mode": "any_aspect"}}.items():
    ORACLES[f"edges_{_key}"] = f"WITH {cascade(**_options)} SELECT file_a, file_b, score, match_reason FROM edges"
for _key in _ORDERS:
    ORACLES[f"keep_{_key}"] = f"{members(_key)} SELECT group_id, file_id FROM members WHERE keep_default"
for _by, _cols in {"total": ("total_size_bytes", "members"), "count": ("members", "total_size_bytes"), "spread": ("spread", "members", "total_size_bytes")}.items():
    for _way, _sign in (("down", " DESC"), ("up", "")):
        ORACLES[f"sort_group_{_by}_{_way}"] = (
            f"{members()} SELECT group_id, row_number() OVER (ORDER BY {', '.join(c + _sign for c in _cols)}, tie, group_id)::INT AS position, members, total_size_bytes, spread FROM (SELECT *, largest - smallest AS spread FROM metrics)"
        )
for _way, _sign in (("down", " DESC"), ("up", "")):
    ORACLES[f"sort_row_size_{_way}"] = (
        f"{members()} SELECT group_id, file_id, size, row_number() OVER (PARTITION BY group_id ORDER BY size{_sign}, quality DESC, mtime_ns, lower(path), file_id)::INT AS row_position FROM members"
    )

_SCANS = "scans AS (SELECT o_orderkey AS scan_id, o_custkey AS scan_set, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'paused' ELSE 'running' END AS status FROM orders)"
_FILES = "files AS (SELECT l_orderkey AS scan_id, l_partkey AS file_id, sum(l_quantity)::BIGINT AS size, bool_or(l_shipdate < TIMESTAMP '1998-01-01') AS alive FROM lineitem GROUP BY ALL)"
_HALF = """old AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
  new AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 5 <> 3 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"""
_LANES = """lanes AS (SELECT user_id % 7 AS lane, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, value AS elapsed_s, (event_id % 5 = 0)::BIGINT AS f, (event_id % 97 = 0)::BIGINT AS t FROM events),
  m AS (SELECT lane, count(*) AS files, count_if(status = 'success')::BIGINT AS successes, count_if(status <> 'success')::BIGINT AS failures, sum(f)::BIGINT AS fallbacks, sum(t)::BIGINT AS timeouts,
    round(avg(elapsed_s), 6) AS avg_service_s, max(elapsed_s) AS peak_service_s FROM lanes GROUP BY lane)"""


def _pick(kind: str, n: int, value: str) -> str:
    return f"""(SELECT user_id, event_type, {value} AS {kind} FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_id % {n} = 0 AND {value} IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id // 100 DESC, event_id DESC) = 1)"""


ORACLES |= {
    "incremental_diff": f"""WITH {_HALF} SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type,
      CASE WHEN o.event_id IS NULL THEN 'new' WHEN n.event_id IS NULL THEN 'deleted' WHEN floor(o.value / 40) IS NOT DISTINCT FROM floor(n.value / 40) THEN 'unchanged' ELSE 'modified' END AS state
      FROM new n FULL JOIN old o ON n.user_id = o.user_id AND n.event_type = o.event_type""",
    "deleted_keys": f"WITH {_HALF} SELECT user_id, event_type FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)",
    "stream_ordered": """SELECT user_id % 11 AS lane, row_number() OVER (PARTITION BY user_id % 11 ORDER BY ts, event_id) - 1 AS seq, event_id::VARCHAR AS payload, true AS in_order FROM events""",
    "stream_progress": "SELECT count(*) AS rows, 3 AS full_batches, true AS timed FROM events",
    "progress_shown": """WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS at_s, ['enumerate', 'probe', 'match'][(event_id // 500) % 3 + 1] AS stage, event_id % 41 = 0 AS forced,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      w AS (SELECT run, seq, k, stage AS l_stage, seq AS l_counter, at_s AS l_at, true AS shown FROM e WHERE k = 1
        UNION ALL SELECT run, seq, k, CASE WHEN told THEN stage ELSE l_stage END, CASE WHEN told THEN seq ELSE l_counter END, CASE WHEN told THEN at_s ELSE l_at END, told FROM (
          SELECT e.run, e.seq, e.k, stage, at_s, l_stage, l_counter, l_at, forced OR stage <> l_stage OR e.seq - l_counter >= 400 OR at_s - l_at >= 3600.0::DOUBLE * 24 * 5 AS told FROM w JOIN e ON e.run = w.run AND e.k = w.k + 1))
      SELECT run, seq FROM w WHERE shown""",
    "lane_dispatch": f"""WITH {ASSETS}, f AS (SELECT file_id, file_id % 7 AS lane, greatest(1, file_id % 7 % 3) AS cap, row_number() OVER (PARTITION BY file_id % 7 ORDER BY lower(path), path) AS k FROM assets)
      SELECT file_id, lane, (k - 1) // cap AS turn, row_number() OVER (ORDER BY (k - 1) // cap, lane, k) - 1 AS dispatched FROM f""",
    "lane_assignment": f"""WITH {ASSETS}, c AS (SELECT unnest(range(7)) AS lane), l AS (SELECT lane, CASE WHEN lane < 5 AND lane % 3 > 0 THEN lane % 3 ELSE 1 END AS cap FROM c),
      o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM l),
      x AS (SELECT file_id, file_id % 7 AS lane, row_number() OVER (PARTITION BY file_id % 7 ORDER BY lower(path), path) AS k FROM assets)
      SELECT file_id, x.lane, (f + (k - 1) % cap)::INT AS task, true AS in_its_task FROM x JOIN o ON o.lane = x.lane""",
    "upsert_latest": f"""WITH {_HALF} SELECT user_id, event_type, event_id, value FROM new UNION ALL
      SELECT user_id, event_type, event_id, value FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""",
    "issue_dedupe": "SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1",
    "cache_lookup": f"""SELECT *, CASE WHEN meta IS NOT NULL AND fingerprint IS NOT NULL THEN 'cache_hit' WHEN meta IS NOT NULL THEN 'fingerprint_only' ELSE 'probe_and_fingerprint' END AS decision
      FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16') LEFT JOIN {_pick("meta", 2, "value")} USING (user_id, event_type)
      LEFT JOIN {_pick("fingerprint", 3, "event_id")} USING (user_id, event_type) LEFT JOIN {_pick("audio", 5, "event_id")} USING (user_id, event_type)""",
    "latest_by_set": f"WITH {_SCANS} SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY scan_set ORDER BY scan_id DESC) = 1",
    "latest_done_by_set": f"WITH {_SCANS} SELECT * FROM scans WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY scan_set ORDER BY scan_id DESC) = 1",
    "scan_summary": f"""WITH {_SCANS}, {_FILES} SELECT s.scan_id, s.status, count(file_id) AS files, coalesce(count_if(alive), 0)::BIGINT AS live_files, coalesce(sum(size), 0)::BIGINT AS bytes
      FROM scans s LEFT JOIN files f ON f.scan_id = s.scan_id GROUP BY s.scan_id, s.status""",
    "match_ready": f"""WITH {_SCANS}, {_FILES} SELECT f.scan_id, f.file_id, f.size, p.p_brand, coalesce(a.s_name, '') AS audio FROM files f JOIN scans USING (scan_id) JOIN part p ON p.p_partkey = f.file_id
      LEFT JOIN supplier a ON a.s_suppkey = f.file_id WHERE f.alive AND NOT EXISTS (SELECT 1 FROM part x WHERE x.p_size > 40 AND x.p_partkey = f.file_id)""",
    "purge_counts": f"""WITH {_SCANS}, {_FILES}, gone AS (SELECT scan_id FROM scans WHERE scan_set % 50 = 3 UNION SELECT scan_id FROM files WHERE file_id % 37 = 5)
      SELECT (SELECT count(*) FROM scans WHERE scan_id IN (FROM gone)) AS deleted_scans, (SELECT count(*) FROM files WHERE scan_id IN (FROM gone)) AS deleted_files,
      (SELECT count(*) FROM scans WHERE scan_id % 4 <> 1 AND scan_id IN (FROM gone)) AS deleted_groups, (SELECT count(*) FROM scans WHERE scan_id % 9 = 2 AND scan_id IN (FROM gone)) AS deleted_actions""",
    "meta_after_probes": """WITH p AS (SELECT p_partkey AS k, * FROM part) SELECT k AS file_id, ['pyav', 'ffprobe'][k % 2 + 1] AS probe_backend, CASE WHEN k % 9 = 0 THEN 't3' WHEN k % 3 = 0 THEN 't2' ELSE 't1' END AS probed_at,
      k * CASE WHEN k % 9 = 0 OR k % 3 > 0 THEN 10 ELSE 11 END AS source_size, k * 7 AS source_mtime_ns, CASE WHEN k % 9 = 0 OR k % 4 > 0 THEN k % 90 + 1.0::DOUBLE ELSE 0 END AS duration_s,
      CASE WHEN k % 9 = 0 OR k % 4 > 0 THEN p_size ELSE 0 END::INT AS width, CASE WHEN k % 9 = 0 OR k % 4 > 0 THEN 10 ELSE 8 END::INT AS bit_depth,
      CASE WHEN k % 9 = 0 THEN 'new' WHEN k % 4 > 0 THEN p_brand ELSE '' END AS codec, CASE WHEN k % 9 > 0 AND k % 3 = 0 THEN 500 END::INT AS probe_error FROM p WHERE k % 4 > 0 OR k % 3 = 0""",
    "tables_after_purge": f"""WITH {_SCANS}, {_FILES}, gone AS (SELECT scan_id FROM scans WHERE scan_set % 50 = 3 UNION SELECT scan_id FROM files WHERE file_id % 37 = 5), rest AS (
      SELECT scan_id, 'scans' AS name FROM scans UNION ALL SELECT scan_id, 'files' FROM files UNION ALL SELECT scan_id, 'groups' FROM scans WHERE scan_id % 4 <> 1 UNION ALL SELECT scan_id, 'actions' FROM scans WHERE scan_id % 9 = 2)
      SELECT scan_id, count(*) AS n, name FROM rest WHERE scan_id NOT IN (FROM gone) GROUP BY ALL""",
    "tables_after_prune": f"""WITH {_SCANS}, {_FILES}, i AS (SELECT scan_id AS group_id, file_id, file_id % 11 <> 2 AS kept, alive AND file_id % 7 <> 1 AS there FROM files WHERE file_id % 3 > 0),
      g AS (SELECT group_id, count_if(kept)::BIGINT AS items, count(*) AS before, count_if(kept AND there) AS live FROM i GROUP BY group_id)
      SELECT group_id, items, before FROM g WHERE live >= 2 AND group_id % 4 <> 1""",
    "scan_rows": f"""WITH {_SCANS} SELECT scan_id, scan_set, CASE WHEN scan_id % 5 = 0 THEN 'cancelled' WHEN scan_id % 3 = 1 THEN 'added' ELSE status END AS status FROM scans WHERE scan_id % 3 <= 1""",
    "files_after_renames": """WITH p AS (SELECT *, p_partkey % 6 = 0 AND (p_partkey % 5 > 0 OR p_partkey = 0) AS r FROM part) SELECT 1 AS scan_id, p_partkey AS file_id, '/a/' || p_partkey || '.mp4' || CASE WHEN r THEN '.Z_dele' ELSE '' END AS path,
      CASE WHEN r THEN 'z_dele' ELSE 'mp4' END AS ext, p_size::BIGINT + r::BIGINT AS size, CASE WHEN r THEN 9 ELSE 5 END::BIGINT AS mtime_ns, r OR p_partkey % 4 > 0 AS alive FROM p""",
    "clone_artifacts": """SELECT p_partkey + 1000000 AS file_id, 'pyav' AS probe_backend, 't1' AS probed_at, p_partkey * 10 AS source_size, p_partkey * 7 AS source_mtime_ns, p_partkey % 90 + 1.0::DOUBLE AS duration_s, p_size::INT AS width, 10::INT AS bit_depth, p_brand AS codec
      FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 4 > 0 AND p_partkey % 7 > 0 AND p_partkey % 5 > 0""",
    "prune_groups": f"""WITH {_SCANS}, {_FILES} SELECT s.scan_id AS group_id, coalesce(count_if(f.alive), 0)::BIGINT AS alive FROM scans s LEFT JOIN files f ON f.scan_id = s.scan_id AND f.file_id % 3 > 0
      WHERE s.scan_id % 4 <> 1 GROUP BY s.scan_id HAVING coalesce(count_if(f.alive), 0) < 2""",
    "lane_metrics": f"WITH {_LANES} SELECT * FROM m",
    "guidance": f"""WITH {_LANES}, g AS (SELECT greatest(1, count(*)) AS lanes, sum(failures)::BIGINT AS failures, sum(timeouts)::BIGINT AS timeouts, sum(fallbacks)::BIGINT AS fallbacks FROM m)
      SELECT *, CASE WHEN failures > 0 OR timeouts > 0 OR fallbacks >= lanes THEN least(16, lanes) ELSE 16 END AS workers, CASE WHEN failures > 0 THEN 'failures' WHEN timeouts > 0 OR fallbacks >= lanes THEN 'pressure' ELSE 'healthy' END AS reason FROM g""",
    "path_parts": f"""WITH p AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/Clip.MKV' ELSE '/.hidden' END AS path FROM pages)
      SELECT page_id, lower(replace(path, chr(92), '/')) AS key, {_NAME} AS name, lower(regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1)) AS suffix,
      lower(regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1)) IN {RISKY_SUFFIXES} AS risky FROM p""",
    "scalar_functions": f"""WITH o AS (SELECT o_orderkey AS n, (o_orderkey * 977 * (o_orderkey % 13 + 1))::DOUBLE AS z FROM orders)
      SELECT n AS id, round_even(n / 2 / 5, 0)::INT AS bucket, CASE WHEN n % 7 <= 0 THEN 0 ELSE round_even((n % 50 + 1) / (n % 7) * 4, 0) / 4 END::DOUBLE AS aspect,
      CASE WHEN n % 60 <= 0 THEN '' WHEN n % 60 < 10 THEN (n % 60)::VARCHAR ELSE ((n % 60) // 10) || '.' || ((n % 60) % 10) END AS level,
      CASE WHEN n % 3 = 0 THEN 0 ELSE (n % 9) / (n % 3) END::DOUBLE AS fps,
      {alpha("n")} AS alpha,
      CASE WHEN z < 1024 THEN printf('%d B', z::BIGINT) WHEN z < 1048576 THEN printf('%.1f KB', z / 1024) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576)
        WHEN z < 1099511627776 THEN printf('%.1f GB', z / 1073741824) WHEN z < 1125899906842624 THEN printf('%.1f TB', z / 1099511627776) ELSE printf('%.1f PB', z / 1125899906842624) END AS size_text,
      CASE n % 4 WHEN 0 THEN 10 WHEN 1 THEN 12 ELSE 8 END::INT AS bit_depth FROM o""",
    "probe_parse": """WITH p AS (SELECT p_partkey, p_partkey % 3 AS m3, p_partkey % 4 AS m4, p_partkey % 5 AS m5, p_partkey % 6 AS m6, p_partkey % 11 AS m11, p_partkey % 13 AS m13, p_partkey % 17 AS m17 FROM part)
      SELECT p_partkey, m17 / 4 AS duration_s, CASE WHEN m13 = 0 THEN 0 ELSE 1920 END AS width, 1080 AS height, round([30000 / 1001, 25, 0, 24][m4 + 1], 6)::DOUBLE AS fps,
      CASE WHEN p_partkey % 2 = 0 THEN 'h264' ELSE 'hevc' END AS codec, 123456::BIGINT AS bitrate, m3::INT AS audio_stream_count, CASE WHEN m3 > 0 THEN 'aac' ELSE '' END AS audio_codec,
      [0, 64000, 96000][m3 + 1]::BIGINT AS audio_bitrate, ['', 'eng', 'deu,eng'][m3 + 1] AS audio_languages, CASE WHEN m4 = 0 THEN 'pol' ELSE '' END AS subtitle_languages,
      CASE m4 WHEN 1 THEN 8 WHEN 3 THEN 16 ELSE [10, 8, 10, 12, 8][m5 + 1] END::INT AS bit_depth,
      CASE WHEN m11 IN (0, 3) THEN 'DV' WHEN m11 = 1 THEN 'HDR10+' WHEN m5 IN (0, 3) THEN 'HDR10' WHEN m5 = 1 THEN 'HLG' WHEN m11 = 2 AND m3 IN (0, 2) THEN 'HDR10' ELSE '' END AS hdr_format,
      'mov' AS container, ['', 'High', '-99', 'Main', ''][m5 + 1] AS codec_profile, ['4.1', '5', '', '4.1', 'x'][m5 + 1] AS codec_level, m6 IN (0, 2, 3) AS is_interlaced,
      CASE WHEN m17 = 0 OR m13 = 0 THEN 'Invalid video metadata' ELSE '' END AS probe_error FROM p""",
}


def _bits(a: str, b: str, at: str) -> str:
    return f"list_transform({at}, lambda i: bit_count(xor({a}[i], {b}[i]))::DOUBLE)"


def _distance(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = len({b}) AND len({a}) > 0 THEN list_median({_bits(a, b, f'range(1, len({a}) + 1)')}) / 64 ELSE 1 END::DOUBLE"


def _prefilter(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    return f"CASE WHEN {n} > 0 THEN list_median({_bits(a, b, f'list_distinct([1, {n} // 2 + 1, {n}])')}) ELSE 64 END::DOUBLE"


def _named(kind: str, default: str, names: tuple[str, ...]) -> str:
    return f"CASE WHEN v IN {names} THEN v ELSE '{default}' END AS {kind}"


_FAILED = """fail AS (SELECT event_id % 4 AS scan_id, 'd:/lib/' || event_type || '/' || user_id AS key, ['probe', 'enumerate', 'fingerprint', 'analyze'][event_id % 4 + 1] AS stage, event_id FROM events)"""
ORACLES |= {
    "median_distances": f"""WITH p AS (SELECT p_partkey, list_transform(range(1, p_partkey % 13 + 1), lambda i: p_partkey * i * 2654435761) AS a,
      list_transform(range(1, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 13 ELSE p_partkey % 11 END + 1), lambda i: (p_partkey + 7) * i * 2654404609) AS b FROM part),
      q AS (SELECT *, a[3:10] AS ia, b[3:10] AS ib FROM p) SELECT p_partkey, {_distance("a", "b")} AS full_distance, {_distance("ia", "ib")} AS inner_distance,
      {_prefilter("a", "b")} AS prefilter_full, {_prefilter("ia", "ib")} AS prefilter_inner FROM q""",
    "setting_names": f"""WITH o AS (SELECT o_orderkey AS n, ['balanced', 'custom', 'none', 'any_aspect', 'rename', 'trimmed_match', 'ffprobe'][o_orderkey % 7 + 1] AS v, greatest(0, least(100, o_orderkey % 130 - 10)) AS a, o_orderkey % 103 AS b FROM orders),
      q AS (SELECT *, least(100, b) AS c FROM o), r AS (SELECT *, CASE WHEN a = c AND c >= 100 THEN a - 1 ELSE a END AS x, CASE WHEN a = c AND c < 100 THEN c + 1 ELSE c END AS y FROM q)
      SELECT n AS id, {_named("profile", "balanced", ("balanced", "conservative", "aggressive", "custom"))}, {_named("mode", "off", ("off", "same_aspect", "any_aspect"))}, {_named("action", "keep", ("keep", "rename", "delete"))},
      {_named("reason", "perceptual", ("perceptual", "trimmed_match", "audio_match"))}, {_named("backend", "pyav", ("pyav", "ffprobe"))}, [0.3, 0.18, 0.2, 0.01][n % 4 + 1]::DOUBLE AS threshold,
      least(x, y) || ',' || greatest(x, y) AS pair, CASE WHEN n % 9 >= 3 AND n % 31 >= 5 THEN (20 - n % 9) * (n % 31)::DOUBLE / (n % 9) ELSE -1 END::DOUBLE AS eta, CASE WHEN n % 4 > 0 THEN n / (n % 4) ELSE 0 END::DOUBLE AS rate FROM r""",
    "scene_samples": """WITH e AS (SELECT event_id, list_filter(list_transform(range(0, event_id % 9 + 1), lambda i: i * (event_id % 3) + 0.5), lambda t: t < event_id % 13) AS raw FROM events),
      t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN raw[1:1] ELSE raw END AS ts FROM e), x AS (SELECT event_id, ts, len(ts) AS n FROM t)
      SELECT event_id, array_to_string(list_transform(ts, lambda t: t::DOUBLE::VARCHAR), ',') AS times,
      CASE WHEN n >= 4 THEN array_to_string(list_transform([0, 1, 2, 3], lambda i: ts[(i * (n - 1)) // 3 + 1]::DOUBLE::VARCHAR), ',') ELSE 'none' END AS picked, CASE WHEN event_id % 3 = 0 THEN 'AQ' ELSE 'none' END AS audio FROM x""",
    "frame_grids": """WITH p AS (SELECT p_partkey AS n, (p_partkey % 5 + 9)::INT AS w, (p_partkey % 3 + 8)::INT AS h, list_transform(range(0, 140), lambda i: (p_partkey * 31 + i * i * 7 + i * p_partkey) % 251) AS px FROM part),
      g AS (SELECT n, list_transform(range(0, 72), lambda k: px[((k // 9) * (h - 1)) // 7 * w + ((k % 9) * (w - 1)) // 8 + 1]) AS s FROM p)
      SELECT n AS p_partkey, CAST(CAST(array_to_string(list_transform(range(0, 64), lambda k: CASE WHEN s[k // 8 * 9 + k % 8 + 2] > s[k // 8 * 9 + k % 8 + 1] THEN '1' ELSE '0' END), '') AS BIT) AS BIGINT) AS hash,
      list_sum(s)::INT AS sum, n % 4 <> 0 AS valid FROM g""",
    "valid_artifacts": """WITH e AS (SELECT event_id AS i FROM events), f AS (SELECT i, i % 2 > 0 AND i % 7 > 0 AND i % 9 > 0 AND i % 13 <> 0 AS meta_ok, i % 3 > 0 AND i % 11 > 0 AND i % 5 > 0 AS hashes_ok, i % 4 > 0 AND i % 6 > 0 AND i % 8 > 0 AS audio_ok FROM e)
      SELECT i AS event_id, meta_ok, hashes_ok, audio_ok, CASE WHEN meta_ok AND hashes_ok THEN 'cache_hit' WHEN meta_ok THEN 'fingerprint_only' ELSE 'probe_and_fingerprint' END AS decision FROM f""",
    "clone_failed": f"""WITH {_FAILED}, m AS (SELECT scan_id, key AS path, max(event_id) AS event_id FROM fail GROUP BY ALL), w AS (SELECT DISTINCT 'd:/lib/' || event_type || '/' || user_id AS path FROM events WHERE event_id % 3 = 0),
      c AS (SELECT 2::BIGINT AS scan_id, path, event_id FROM m WHERE scan_id = 1 AND path IN (FROM w))
      SELECT * FROM c UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.scan_id = m.scan_id AND c.path = m.path)""",
    "to_analyze": f"""WITH {_FAILED}, b AS (SELECT scan_id, key FROM fail WHERE event_id % 97 = 0 AND stage <> 'enumerate')
      SELECT event_id FROM fail f WHERE event_id % 5 > 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.scan_id = f.scan_id AND b.key = f.key)""",
    "failed_files": f"""WITH {_FAILED}, x AS (SELECT scan_id, key, event_id AS "at", event_id % 3 = 0 AS bad FROM fail WHERE event_id % 3 = 0 OR event_id % 2 = 0)
      SELECT scan_id, key, "at" FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY scan_id, key ORDER BY "at" DESC) = 1) WHERE bad""",
    "provenance_metrics": """WITH e AS (SELECT event_id AS i, ['pyav', 'ffmpeg', 'opencv'][event_id % 3 + 1] AS one, ['ffmpeg', 'pyav'][event_id % 2 + 1] AS used, event_id % 17 = 0 AS broken FROM events)
      SELECT i AS event_id, CASE WHEN broken THEN 0 WHEN i % 5 > 0 THEN (one <> used)::INT WHEN i % 2 = 0 THEN ('ffmpeg' <> used)::INT ELSE 0 END::BIGINT AS fallbacks,
      CASE WHEN broken THEN 0 ELSE (i % 5 > 0 AND i % 4 IN (0, 3))::INT + (i % 2 = 0)::INT END::BIGINT AS timeouts FROM e""",
    "decoder_mix": """SELECT user_id % 7 AS lane, ['pyav', 'ffmpeg'][floor(value)::BIGINT % 3 + 1] AS decoder, count(*) AS files FROM events WHERE event_id % 11 <> 0 AND floor(value)::BIGINT % 3 IN (0, 1) GROUP BY ALL""",
    "run_summary": """SELECT count(*) AS analyzed, count_if(event_id % 11 <> 0)::BIGINT AS successes, count_if(event_id % 11 = 0)::BIGINT AS failures, count_if(event_id % 5 = 0)::BIGINT AS fallbacks, count_if(event_id % 97 = 0)::BIGINT AS timeouts FROM events""",
    "named_sample": f"WITH {ASSETS} SELECT path, source AS root FROM assets WHERE contains(lower(path), 'doc_1') ORDER BY lower(source), lower(path), path LIMIT 24",
    "incomplete_sample": f"WITH {ASSETS} SELECT path, source AS root FROM assets ORDER BY lower(source), lower(path), path LIMIT 120",
    "profile_status": f"""WITH {_SCANS}, l AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY scan_set ORDER BY scan_id DESC) = 1), n AS (SELECT DISTINCT scan_set FROM scans WHERE scan_set % 3 = 0 UNION ALL SELECT -1)
      SELECT 'named' AS kind, n.scan_set, 'p' || n.scan_set AS name, scan_id, status FROM n LEFT JOIN l ON l.scan_set = n.scan_set UNION ALL SELECT 'auto', scan_set, '', scan_id, status FROM l WHERE scan_set % 3 <> 0""",
    "may_resume": """SELECT c_custkey AS scan_set, c_custkey % 7 > 0 AND c_custkey % 3 > 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 = c_custkey % 4) AS may_resume FROM customer""",
    "progress": """SELECT count(*) AS files, round(avg((event_id % 3 = 0)::INT), 6) AS hit_share, round(sum(event_id * 1000) / 1048576, 6)::DOUBLE AS mib, round(sum(event_id * 1000) / 1048576 / max(event_id / 10), 6)::DOUBLE AS mib_per_s FROM events""",
    "delete_plan": f"""WITH {ASSETS} SELECT CASE WHEN file_id % 50 = 0 THEN -file_id ELSE file_id END AS file_id, 'rename' AS mode, path AS source, CASE WHEN file_id % 50 = 0 THEN NULL
      ELSE path || '.z_dele' || CASE WHEN file_id % 6 = 0 THEN '.2' WHEN file_id % 2 = 0 THEN '.1' ELSE '' END END AS target,
      CASE WHEN file_id % 50 = 0 THEN 'Delete target is missing a valid file_id' ELSE '' END AS error FROM assets""",
    "json_lists": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'a|B' ELSE '' END AS items, left(html, 50) AS head, right(html, 40) AS tail, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, ['a.b', '.hidden', 'c'][page_id % 3 + 1] AS stem FROM pages""",
}
_HEX = "array_to_string(list_transform(hashes, lambda h: upper(printf('%016x', h))), '')"
ORACLES |= {
    "match_items": f"""WITH {ASSETS}, m AS (SELECT *, file_id % 5 AS scan_id, ['pyav', 'ffprobe', ''][file_id % 5 % 3 + 1] AS backend FROM assets)
      SELECT scan_id, file_id, path, size, mtime_ns, mtime_ns + 1 AS ctime_ns, duration_s, width::INT AS width, height::INT AS height, fps, CASE WHEN file_id % 6 > 0 THEN bit_depth ELSE 8 END::INT AS bit_depth, hdr_format, container, codec_profile, codec_level,
      is_interlaced, codec, bitrate, audio_stream_count, audio_codec, audio_bitrate, CASE WHEN file_id % 4 = 1 THEN 'eng' ELSE '' END AS audio_languages, '' AS subtitle_languages, {_HEX} AS hashes, audio_fingerprint
      FROM m WHERE file_id % 23 > 0 AND file_id % 31 > 0 AND duration_s > 0 AND file_id % 19 > 0 AND file_id % 17 > 0 AND (backend = 'pyav' OR (backend = 'ffprobe' AND file_id % 3 > 0))""",
    "scan_infos": """SELECT DISTINCT doc_id % 5 AS id, 't' AS created_at, 'balanced' AS profile, '/Lib/A|/b' AS roots, 'mp4|mkv' AS extensions, greatest(0.01, least(0.30, doc_id % 5 / 10))::DOUBLE AS custom_similarity_threshold,
      doc_id % 5 > 0 AND doc_id % 5 % 2 = 0 AS scene_aware_sampling, false AS audio_fingerprint_enabled, CASE doc_id % 5 % 3 WHEN 0 THEN 'any_aspect' ELSE 'off' END AS cross_resolution_mode,
      CASE doc_id % 5 % 3 WHEN 1 THEN 'ffprobe' ELSE 'pyav' END AS probe_backend, 'k' || doc_id % 5 % 2 AS scan_set_key, CASE doc_id % 5 % 2 WHEN 0 THEN 'done' ELSE 'paused' END AS status FROM documents""",
    "listed_issues": f"""WITH {ASSETS} SELECT file_id % 5 AS scan_id, 'enumerate' AS stage, path, '' AS message, row_number() OVER (PARTITION BY file_id % 5 ORDER BY file_id DESC) AS position FROM assets WHERE file_id % 13 = 0""",
    "listed_failures": f"""WITH {ASSETS} SELECT file_id % 5 AS scan_id, lower(path) AS normalized_path, path AS display_path, CASE file_id % 2 WHEN 0 THEN 'probe' ELSE '' END AS stage, '' AS message, '' AS created_at, '' AS updated_at,
      row_number() OVER (PARTITION BY file_id % 5 ORDER BY lower(path)) AS position FROM assets WHERE file_id % 17 = 0""",
    "listed_links": f"""WITH {ASSETS} SELECT file_id % 5 AS scan_id, CASE file_id % 3 WHEN 0 THEN 'symlink' ELSE 'hardlink' END AS link_kind, path || '.lnk' AS link_path, path AS target_original_path, file_id % 8 = 0 AS target_exists, '' AS source_root,
      row_number() OVER (PARTITION BY file_id % 5 ORDER BY path || '.lnk') AS position FROM assets WHERE file_id % 12 = 0""",
    "file_snapshot": f"""WITH {ASSETS} SELECT file_id % 5 AS scan_id, file_id, path, lower(path) AS normalized_path, size, mtime_ns, mtime_ns + 1 AS ctime_ns, ext, row_number() OVER (PARTITION BY file_id % 5 ORDER BY lower(path), file_id) AS position FROM assets WHERE file_id % 23 > 0""",
    "group_paths": f"WITH {ASSETS} SELECT file_id - file_id % 10 AS group_id, file_id, path FROM assets",
    "scan_counts": """WITH d AS (SELECT doc_id AS i, doc_id % 5 AS scan_id FROM documents), g AS (SELECT i AS group_id, scan_id FROM d WHERE i % 10 = 0)
      SELECT s.scan_id, CASE s.scan_id % 2 WHEN 0 THEN 'done' ELSE 'paused' END AS status, (SELECT count(*) FROM g WHERE g.scan_id = s.scan_id) AS groups,
      (SELECT count(*) FROM d JOIN g ON g.group_id = d.i - d.i % 10 WHERE g.scan_id = s.scan_id AND d.i % 23 > 0) AS files, (SELECT count(*) FROM d WHERE d.scan_id = s.scan_id AND i % 17 = 0) AS failed FROM (SELECT DISTINCT scan_id FROM d) s""",
    "newest_scans": """WITH s AS (SELECT DISTINCT doc_id % 5 AS id FROM documents) SELECT 'all' AS asked, max(id) AS id FROM s UNION ALL SELECT 'set', max(id) FROM s WHERE id % 2 = 1 UNION ALL SELECT 'done', max(id) FROM s WHERE id % 2 = 0""",
    "path_order": f"""WITH {ASSETS}, p AS (SELECT file_id, lower(path) AS key, CASE WHEN file_id % 2 = 0 THEN upper(path) ELSE replace(path, '/', chr(92)) END AS shown FROM assets) SELECT file_id, row_number() OVER (ORDER BY key, shown) AS position FROM p""",
    "filter_lists": f"""{members()}, c AS (SELECT DISTINCT 'ext' AS kind, ext AS value FROM members UNION ALL SELECT DISTINCT 'codec', CASE WHEN file_id % 2 = 0 THEN upper(codec) ELSE codec END FROM members)
      SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY lower(value), value)::INT AS position, value FROM c WHERE value <> ''""",
    "filter_ranges": filtered("size >= 524 AND size <= 4194 AND duration_s >= 60 AND duration_s <= 400 AND similarity_score >= 0.9 AND width >= 640 AND height >= 480 AND hdr_format = ''"),
    "recent_roots": """WITH e AS (SELECT user_id AS owner, event_id AS i, ['/Lib/', '/LIB/'][event_id % 2 + 1] || event_id % 37 AS root FROM events WHERE event_id % 9 > 0),
      f AS (SELECT owner, lower(root) AS k, min(i) AS i, arg_min(root, i) AS root FROM e GROUP BY owner, lower(root))
      SELECT owner, root, row_number() OVER (PARTITION BY owner ORDER BY i)::INT AS position FROM f QUALIFY position <= 20""",
    "run_document": f"""WITH {_LANES}, x AS (SELECT lane, ['pyav', 'ffmpeg'][floor(elapsed_s)::BIGINT % 3 + 1] AS decoder FROM lanes WHERE status = 'success'), c AS (SELECT lane, decoder, count(*) AS n FROM x WHERE decoder IS NOT NULL GROUP BY ALL),
      k AS (SELECT lane, string_agg(decoder || '=' || n, '+' ORDER BY decoder) AS mix FROM c GROUP BY lane), g AS (SELECT greatest(1, count(*)) AS lanes, sum(failures) AS f, sum(timeouts) AS t, sum(fallbacks) AS b FROM m)
      SELECT (SELECT count(*) FROM lanes) AS analyzed_files, (SELECT sum(successes) FROM m)::BIGINT AS success_count, f::BIGINT AS failure_count, b::BIGINT AS fallback_count, t::BIGINT AS decoder_timeout_count, 'mixed' AS set_id, 16 AS worker_limit,
      CASE WHEN f > 0 THEN 'failures' WHEN t > 0 OR b >= lanes THEN 'pressure' ELSE 'healthy' END AS reason, CASE WHEN f > 0 OR t > 0 OR b >= lanes THEN least(16, lanes) ELSE 16 END::INT AS workers,
      (SELECT string_agg(lane || ':' || files || ':' || coalesce(mix, ''), ',' ORDER BY lane) FROM m LEFT JOIN k USING (lane)) AS lanes FROM g""",
    "run_counters": """SELECT count(*) AS scanned_files, count_if(doc_id % 4 IN (0, 3))::BIGINT AS cached_files, count_if(doc_id % 4 IN (1, 2))::BIGINT AS fingerprinted_files, count_if(doc_id % 4 = 1)::BIGINT AS fingerprint_only_files,
      count_if(doc_id % 10 = 0)::BIGINT AS duplicate_groups, count_if(doc_id % 13 = 0)::BIGINT AS issues, 'probe:1.500,matching:0.250' AS timings_s FROM documents""",
    "cached_artifacts": """WITH n AS (SELECT user_id, event_type, max(event_id) % 3 AS size, max(event_id) % 2 AS mtime_ns FROM events GROUP BY ALL),
      v AS (SELECT n.*, event_id AS i, event_id % 2 > 0 AND event_id % 3 > 0 AND event_id % 7 > 0 AS meta_ok, event_id % 3 > 0 AND event_id % 2 > 0 AS hashes_ok, event_id % 5 > 0 AND event_id % 4 > 0 AS audio_ok
        FROM n JOIN events e ON e.user_id = n.user_id AND e.event_type = n.event_type AND e.event_id % 3 = size AND e.event_id % 2 = mtime_ns),
      p AS (SELECT user_id, event_type, size, mtime_ns, max(CASE WHEN meta_ok THEN i END) AS meta, max(CASE WHEN hashes_ok THEN i END) AS hashes, max(CASE WHEN audio_ok THEN i END) AS audio FROM n LEFT JOIN v USING (user_id, event_type, size, mtime_ns) GROUP BY ALL)
      SELECT *, CASE WHEN meta IS NOT NULL AND hashes IS NOT NULL THEN 'cache_hit' WHEN meta IS NOT NULL THEN 'fingerprint_only' ELSE 'probe_and_fingerprint' END AS decision FROM p""",
    "media_durations": """WITH p AS (SELECT p_partkey, p_partkey::DOUBLE AS n, p_partkey % 3 AS k FROM part), q AS (SELECT *, CASE WHEN p_partkey % 5 > 0 THEN CASE k WHEN 0 THEN n * 1000 / 1000 WHEN 1 THEN n * 1000 * 0.001::DOUBLE ELSE n * 1000 / 1000000 END ELSE 0 END AS c,
      CASE WHEN p_partkey % 4 > 0 AND p_partkey % 7 > 0 THEN n * 90 * (1 / 90000.0::DOUBLE) ELSE 0 END AS s FROM p) SELECT p_partkey, round(CASE WHEN c > 0 THEN c ELSE s END, 6) AS duration_s FROM q""",
    "listed_files": """WITH p AS (SELECT 'r' || page_id % 3 || '-' || page_id || ['.MP4', '.mkv', '.txt', '.mp4'][page_id % 4 + 1] AS name, octet_length(encode(html)) AS size, page_id FROM pages)
      SELECT 'file' AS kind, name, size FROM p WHERE page_id % 4 <> 2 AND size >= 0.0005 * 1048576 AND size <= 0.005 * 1048576 UNION ALL VALUES ('issue', 'none', 19), ('issue', 'share', 29)""",
    "action_history": """WITH d AS (SELECT doc_id AS i, doc_id % 5 AS s FROM documents), n AS (SELECT s, count(*) AS items, count_if(i % 7 > 0)::BIGINT AS done, count_if(i % 7 = 0)::BIGINT AS failed, 'busy ' || min(CASE WHEN i % 7 = 0 THEN i END) AS first_error FROM d WHERE s < 4 GROUP BY s)
      SELECT r.s + 100 AS id, r.s AS scan_id, 'rename' AS mode, 'done' AS status, coalesce(items, 0) AS items, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, first_error FROM (SELECT DISTINCT s FROM d) r LEFT JOIN n USING (s)""",
}
ORACLES["stream_incremental"], ORACLES["stream_failed_files"] = ORACLES["incremental_diff"], ORACLES["failed_files"]
