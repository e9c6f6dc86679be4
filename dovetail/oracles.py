"""The registered queries once more, as SQL that DuckDB runs on the same tables, written apart from the operators."""

from __future__ import annotations

from dovetail.sources.instances import duckdb_select

_INST = f"inst AS MATERIALIZED ({duckdb_select()})"
#: The dates of folders and names, from how the inventory was made and not from the names.
_DATED = """dated AS (
  SELECT *,
    CASE id % 7 WHEN 0 THEN substr(od, 1, 4) || '-01-01' WHEN 1 THEN substr(od, 1, 7) || '-01' WHEN 2 THEN od WHEN 4 THEN substr(od, 1, 4) || '-01-01' WHEN 5 THEN od WHEN 6 THEN substr(od, 1, 4) || '-01-01' END AS fd,
    CASE id % 7 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 4 THEN 'year' WHEN 5 THEN 'day' WHEN 6 THEN 'year' END AS fp,
    CASE id % 5 WHEN 0 THEN ts WHEN 2 THEN od WHEN 3 THEN substr(od, 1, 7) || '-01' END AS nd,
    CASE id % 5 WHEN 0 THEN 'second' WHEN 2 THEN 'day' WHEN 3 THEN 'month' END AS np
  FROM inst)"""
_RULED = (
    _DATED
    + """, massed AS (
  SELECT *, exif_dto IS NOT NULL AND count(exif_dto) OVER (PARTITION BY source, dir, exif_dto) > 25 AS mass FROM dated WHERE kind IN ('image', 'video')
), trusted AS (
  SELECT *, source = 'LOCAL' AS cur, exif_dto IS NOT NULL AND NOT (substr(exif_dto, 1, 10) IN ('1970-01-01', '1980-01-01', '2000-01-01') OR mass
    OR (coalesce(fp, '') IN ('day', 'month') AND CAST(substr(exif_dto, 1, 4) AS INT) - CAST(substr(fd, 1, 4) AS INT) >= 2)) AS ok FROM massed
), near AS (
  SELECT *, CASE WHEN fp IN ('day', 'month') THEN substr(exif_dto, 1, 7) = substr(fd, 1, 7) ELSE substr(exif_dto, 1, 4) = substr(fd, 1, 4) END AS e_in,
    CASE WHEN fp IN ('day', 'month') THEN substr(nd, 1, 7) = substr(fd, 1, 7) ELSE substr(nd, 1, 4) = substr(fd, 1, 4) END AS n_in FROM trusted
), ruled AS (
  SELECT *, CASE WHEN ok AND cur AND fd IS NOT NULL AND e_in THEN 'R1' WHEN ok AND cur AND fd IS NOT NULL THEN 'R6' WHEN ok THEN 'R2'
    WHEN cur AND fd IS NOT NULL AND nd IS NULL THEN 'R3' WHEN cur AND fd IS NOT NULL AND n_in THEN 'R3f' WHEN cur AND fd IS NOT NULL THEN 'R3c'
    WHEN taken IS NOT NULL AND NOT artifact THEN 'R4' WHEN fd IS NOT NULL AND nd IS NULL THEN 'R4b' WHEN fd IS NOT NULL THEN 'R4bf' WHEN nd IS NOT NULL THEN 'R5' ELSE 'R7' END AS rule FROM near
), resolved AS (
  SELECT *, CASE WHEN rule IN ('R1', 'R2') THEN exif_dto WHEN rule IN ('R3', 'R4b') THEN fd WHEN rule IN ('R3f', 'R4bf', 'R5') THEN nd WHEN rule = 'R4' THEN taken END AS rd,
    CASE WHEN rule IN ('R1', 'R2', 'R4') THEN 'second' WHEN rule IN ('R3', 'R4b') THEN fp WHEN rule IN ('R3f', 'R4bf', 'R5') THEN np END AS rp,
    CASE WHEN rule IN ('R1', 'R2') THEN 'exif' WHEN rule IN ('R3', 'R4b') THEN 'folder' WHEN rule IN ('R3f', 'R4bf', 'R5') THEN 'filename' WHEN rule = 'R4' THEN 'takeout_json' END AS rs,
    CASE WHEN rule IN ('R6', 'R3c', 'R7') THEN 'conflict' ELSE 'auto' END AS st FROM ruled)"""
)
_MEDIA = "media AS (SELECT * FROM inst WHERE kind IN ('image', 'video'))"
_SCORE = """(3.0::DOUBLE * log2(greatest(width::DOUBLE * height / 1e6, 0.01)) + 1.5::DOUBLE * (CASE WHEN kind = 'image' AND id % 4 = 0 THEN 2.0 WHEN recompressed THEN 0.0 ELSE 1.0 END)::DOUBLE
  + least(tags, 60)::DOUBLE / 60 + (CASE WHEN {trusted} THEN 1.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN trust = 'curated' THEN 0.75 ELSE 0.0 END)::DOUBLE
  + 0.5::DOUBLE * log10(greatest(size_bytes, 1)::DOUBLE) + (CASE WHEN recompressed THEN -2.0 ELSE 0.0 END)::DOUBLE)"""
_DATED_SCORE = _SCORE.format(trusted="exif_dto IS NOT NULL")
_ORDER = "score DESC, CASE WHEN archived THEN 0 ELSE 1 END, CASE WHEN trust = 'curated' THEN 0 ELSE 1 END, source, rel_path, id"
_ORDER_I = "i.score DESC, CASE WHEN i.archived THEN 0 ELSE 1 END, CASE WHEN i.trust = 'curated' THEN 0 ELSE 1 END, i.source, i.rel_path, i.id"
_NAME = "regexp_extract(rel_path, '[^/]*$')"
_FAULTS = """book AS (
  SELECT id, disposition, CASE WHEN id % 37 = 11 THEN NULL WHEN disposition = 'archive' THEN 'a/' || id WHEN disposition = 'quarantine' THEN substr(sha256, 1, 2) || '/' || sha256 || '__' || regexp_extract(rel_path, '[^/]*$') END AS dest,
    CASE WHEN id % 29 = 5 THEN 'other' ELSE sha256 END AS dsha
  FROM (SELECT *, CASE WHEN id % 31 = 7 THEN 'lost' WHEN kind IN ('image', 'video') THEN CASE WHEN id % 5 = 2 THEN 'quarantine' ELSE 'archive' END ELSE 'excluded' END AS disposition FROM inst WHERE id % 17 <> 3) x
), disk AS (
  SELECT DISTINCT disposition AS base, CASE WHEN id % 43 = 4 THEN 'b/' || id ELSE dest END AS rel, CASE WHEN id % 47 = 6 THEN 'changed' ELSE dsha END AS sha FROM book WHERE dest IS NOT NULL AND id % 41 <> 9
), known AS (
  SELECT 'archive' AS base, dest AS rel FROM book WHERE disposition = 'archive' AND dest IS NOT NULL UNION SELECT 'archive', dest || '.xmp' FROM book WHERE disposition = 'archive' AND dest IS NOT NULL
  UNION SELECT 'quarantine', dest FROM book WHERE disposition = 'quarantine' AND dest IS NOT NULL)"""
_MOVED = """placed AS (SELECT id, '2001/' || id || '.jpg' AS rel, exif_dto AS date FROM media),
  disk AS (SELECT id, CASE id % 6 WHEN 0 THEN '2001' WHEN 1 THEN 'caves/2024' WHEN 2 THEN '2004-2006' WHEN 3 THEN 'undated' ELSE 'topical/2024-01' END || '/' || id || '.jpg' AS rel FROM media WHERE id % 6 < 5)"""
_PLANNED = (
    _RULED
    + f""", cl AS (SELECT sha256, min(id) AS cluster_id FROM resolved GROUP BY sha256 HAVING count(*) > 1),
  roled AS (SELECT i.*, r.rd, r.rp, c.cluster_id, CASE WHEN c.cluster_id IS NOT NULL THEN CASE WHEN row_number() OVER (PARTITION BY i.kind IN ('image', 'video'), c.cluster_id ORDER BY {_ORDER_I}) = 1 THEN 'winner' ELSE 'loser' END END AS role
    FROM (SELECT *, round({_SCORE.format(trusted="coalesce((SELECT ok FROM trusted t WHERE t.id = inst.id), false)")}, 4) AS score FROM inst) i
    LEFT JOIN resolved r ON r.id = i.id LEFT JOIN cl c ON c.sha256 = i.sha256 AND i.kind IN ('image', 'video')),
  reasoned AS (SELECT *, CASE WHEN kind = 'sidecar_json' THEN 'takeout_sidecar' WHEN kind = 'other' THEN 'non_media' WHEN kind = 'sidecar_xmp' THEN 'prior_xmp_sidecar' WHEN size_bytes = 0 THEN 'corrupt' WHEN role = 'loser' THEN 'cluster_loser' ELSE coalesce(role, 'singleton') END AS reason FROM roled),
  disposed AS (SELECT *, CASE WHEN reason IN ('takeout_sidecar', 'non_media') THEN 'excluded' WHEN reason IN ('prior_xmp_sidecar', 'corrupt', 'cluster_loser') THEN 'quarantine' ELSE 'archive' END AS disposition,
    regexp_extract({_NAME}, '^(.*)\\.[^.]*$', 1) AS stem, regexp_extract({_NAME}, '\\.[^.]*$') AS ext FROM reasoned),
  planned AS (SELECT *, CASE disposition WHEN 'quarantine' THEN substr(sha256, 1, 2) || '/' || sha256 || '__' || {_NAME} WHEN 'archive' THEN
      CASE WHEN rd IS NULL THEN 'undated/' WHEN rp = 'year' THEN substr(rd, 1, 4) || '/' ELSE substr(rd, 1, 4) || '/' || substr(rd, 1, 7) || '/' END || stem || '__' || substr(sha256, 1, 8) || lower(ext) END AS dest FROM disposed),
  won AS (SELECT p.*, CASE WHEN p.reason = 'cluster_loser' THEN w.dest END AS winner_dest FROM planned p LEFT JOIN planned w ON w.cluster_id = p.cluster_id AND w.role = 'winner' AND w.disposition = 'archive')"""
)


_TOPICS = "CASE id % 7 WHEN 3 THEN ['topical', 'vac' || (id % 13)] WHEN 5 THEN ['card_' || replace(od, '-', '')] WHEN 6 THEN ['misc'] ELSE [] END"
_PAIRS = """bands AS (SELECT id, phash, dhash, width, height, i, substr(phash, 13 - 4 * i, 4) AS v FROM inst, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE kind = 'image' {rep}),
  pairs AS (SELECT DISTINCT a.id AS a, b.id AS b, bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT))::BIGINT AS d_phash, bit_count(xor(('0x' || a.dhash)::UBIGINT, ('0x' || b.dhash)::UBIGINT))::BIGINT AS d_dhash
    FROM bands a JOIN bands b ON a.i = b.i AND a.v = b.v AND a.id < b.id AND abs(a.width / a.height::DOUBLE - b.width / b.height::DOUBLE) / greatest(a.width / a.height::DOUBLE, b.width / b.height::DOUBLE) <= 0.01)"""
_CLIPS = """clips AS (SELECT id, string_split(video_sig, ':') AS p FROM inst WHERE kind = 'video' {rep}),
  clip_pairs AS (SELECT a.id AS a, b.id AS b FROM clips a JOIN clips b ON a.id < b.id AND abs(CAST(replace(a.p[1], 's', '') AS INT) - CAST(replace(b.p[1], 's', '') AS INT)) <= 1
    AND bit_count(xor(('0x' || a.p[3])::UBIGINT, ('0x' || b.p[3])::UBIGINT)) <= 6 AND bit_count(xor(('0x' || a.p[4])::UBIGINT, ('0x' || b.p[4])::UBIGINT)) <= 6)"""
#: The inventory with RAW and JPEG pairs, and its duplicate clusters: pairs, what they take in, and components over the rest.
_RAW = "kind = 'image' AND id % 20 IN (4, 5)"
_RAWS = (
    f"inst0 AS MATERIALIZED ({duckdb_select()})",
    f"""inst AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {_RAW} THEN 'raws/b' || (id // 20) ELSE dir END AS dir, CASE WHEN {_RAW} THEN 'raws/b' || (id // 20) || CASE WHEN id % 20 = 4 THEN '/shot.DNG' ELSE '/shot.jpg' END ELSE rel_path END AS rel_path,
      CASE WHEN id % 4 <> 0 THEN exif_dto END AS exif_dto) FROM inst0)""",
)
_RAW_RULED = _RULED.replace("dated AS (", "dated0 AS (", 1).replace(
    ", massed AS (",
    f", dated AS (SELECT * REPLACE (CASE WHEN NOT ({_RAW}) THEN fd END AS fd, CASE WHEN NOT ({_RAW}) THEN fp END AS fp, CASE WHEN NOT ({_RAW}) THEN nd END AS nd, CASE WHEN NOT ({_RAW}) THEN np END AS np) FROM dated0), massed AS (",
    1,
)
_CLUSTERS = (
    f"""pr AS (SELECT a.id AS w, a.source, a.rel_path, b.id AS c, 'pair_raw_jpeg' AS k, 0 AS o FROM resolved a JOIN resolved b ON b.id = a.id - 1 WHERE a.id % 20 = 5
      UNION ALL SELECT a.id, a.source, a.rel_path, b.id, 'pair_live', 1 FROM resolved a JOIN resolved b ON a.content_id = b.content_id AND a.kind = 'image' AND b.kind = 'video'),
  hv AS (SELECT *, w AS id, 'winner' AS fr FROM pr UNION ALL SELECT *, c, 'companion' FROM pr),
  ab AS (SELECT m.id, arg_min(h.w, (h.o, h.source, h.rel_path, h.w)) AS w, arg_min(h.k, (h.o, h.source, h.rel_path, h.w)) AS k FROM resolved m JOIN resolved x ON x.sha256 = m.sha256 JOIN hv h ON h.id = x.id WHERE m.id NOT IN (SELECT id FROM hv) GROUP BY m.id),
  pm AS (SELECT w, k, id, fr FROM hv UNION ALL SELECT w, k, id, 'loser' FROM ab),
  rest AS MATERIALIZED (SELECT * FROM resolved WHERE id NOT IN (SELECT id FROM pm))""",
    _PAIRS.format(rep="AND id IN (SELECT arg_min(id, (source, rel_path, id)) FROM rest GROUP BY sha256)"),
    _CLIPS.format(rep="AND id IN (SELECT arg_min(id, (source, rel_path, id)) FROM rest GROUP BY sha256)"),
    f"""links AS (SELECT a, b, d_phash > 6 AS weak FROM pairs WHERE d_phash <= 10 AND d_dhash <= 8 UNION ALL SELECT a, b, true FROM clip_pairs),
  copies AS (SELECT first_value(id) OVER (PARTITION BY sha256 ORDER BY source, rel_path, id) AS a, id AS b FROM rest),
  e AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, b FROM copies WHERE a <> b UNION SELECT b, a FROM copies WHERE a <> b),
  cc(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, cc.label FROM cc JOIN e ON e.a = cc.node),
  cm AS (SELECT node AS id, min(label) AS cid FROM cc GROUP BY node),
  ck AS (SELECT cid, CASE WHEN count(DISTINCT sha256) = 1 THEN 'exact' WHEN bool_or(kind = 'video') THEN 'near_video' ELSE 'near_image' END AS k, bool_or(id IN (SELECT a FROM links WHERE weak UNION SELECT b FROM links WHERE weak)) AS weak FROM cm JOIN rest USING (id) GROUP BY cid),
  mem AS (SELECT min(id) OVER (PARTITION BY w) AS cid, k, false AS weak, id, fr FROM pm UNION ALL SELECT cid, k, weak, id, NULL FROM cm JOIN ck USING (cid)),
  sc AS (SELECT r.*, m.cid, m.k, m.weak, m.fr, round({_SCORE.format(trusted="ok")}, 4) AS score FROM resolved r JOIN mem m USING (id)),
  rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY {_ORDER}) AS rk, lead(score) OVER (PARTITION BY cid ORDER BY {_ORDER}) AS nxt FROM sc),
  peo AS MATERIALIZED (SELECT *, coalesce(fr, CASE WHEN rk = 1 THEN 'winner' ELSE 'loser' END) AS role FROM rk),
  best AS (SELECT * FROM rk WHERE rk = 1),
  gr AS (SELECT b.cid, CASE WHEN b.k LIKE 'pair%' THEN '' ELSE array_to_string(list_filter([CASE WHEN b.k = 'near_video' AND b.score - b.nxt < 0.5 THEN 'score_margin' END,
      CASE WHEN b.k <> 'exact' AND bool_or(m.id <> b.id AND m.kind = b.kind AND abs(m.width / m.height::DOUBLE - b.width / b.height::DOUBLE) / greatest(m.width / m.height::DOUBLE, b.width / b.height::DOUBLE) > 0.01) THEN 'aspect_mismatch' END,
      CASE WHEN b.trust = 'takeout' AND bool_or(m.id <> b.id AND m.trust = 'curated' AND m.width = b.width AND m.height = b.height) THEN 'takeout_winner_over_curated' END,
      CASE WHEN b.weak THEN 'possible_duplicate_band' END, CASE WHEN b.k = 'near_video' THEN 'video_never_auto' END], lambda x: x IS NOT NULL), ';') END AS guardrails
      FROM best b JOIN rk m USING (cid) GROUP BY b.cid, b.k, b.score, b.nxt, b.trust, b.id, b.kind, b.width, b.height, b.weak),
  dq0 AS (SELECT *, rd IS NOT NULL AS has, rd IS NOT NULL AND kind <> 'video' AND NOT (rs = 'folder' AND trust <> 'curated') AS rel FROM rk),
  dq AS (SELECT *, CASE WHEN max(rel) OVER (PARTITION BY cid) THEN rel ELSE has END AS pool, CASE rp WHEN 'second' THEN 19 WHEN 'day' THEN 10 WHEN 'month' THEN 7 ELSE 4 END AS chars,
    CASE WHEN rs = 'folder' AND trust <> 'curated' THEN 1.5 WHEN rs = 'folder' THEN 4 WHEN rs = 'exif' THEN 3 WHEN rs = 'takeout_json' THEN 2 WHEN rs = 'filename' THEN 1 ELSE 0 END AS pri FROM dq0),
  dw AS (SELECT cid, arg_max(id, (pri, chars, rel_path)) FILTER (WHERE pool) AS wid, bool_and(has) AS all_has, bool_or(has) AS any_has FROM dq GROUP BY cid),
  dx AS (SELECT dw.*, b.rd, b.rp, b.rs, coalesce((SELECT bool_or(substr(q.rd, 1, least(10, q.chars, b.chars)) <> substr(b.rd, 1, least(10, q.chars, b.chars))) FROM dq q WHERE q.cid = dw.cid AND q.pool), false) AS differs FROM dw LEFT JOIN dq b ON b.id = dw.wid),
  clu AS MATERIALIZED (SELECT g.cid, b.k, g.guardrails, x.rd AS date, x.rp AS precision, x.rs AS date_source, CASE WHEN NOT any_has THEN 'date_unresolved' ELSE array_to_string(list_filter([CASE WHEN differs THEN 'date_disagreement' END, CASE WHEN NOT all_has THEN 'date_unresolved_members' END], lambda f: f IS NOT NULL), ';') END AS date_flags,
    CASE WHEN g.guardrails = '' AND NOT (NOT any_has OR differs) THEN 'auto' ELSE 'pending' END AS status, (SELECT p.id FROM peo p WHERE p.cid = g.cid AND p.role = 'winner') AS winner_id FROM gr g JOIN best b USING (cid) JOIN dx x USING (cid))""",
)
_PLACED = (
    f"""roled AS (SELECT i.* , CASE WHEN p.role = 'winner' AND c.date IS NOT NULL THEN c.date ELSE r.rd END AS rd, CASE WHEN p.role = 'winner' AND c.date IS NOT NULL THEN c.precision ELSE r.rp END AS rp, p.cid AS cluster_id, p.role
    FROM inst i LEFT JOIN resolved r ON r.id = i.id LEFT JOIN peo p ON p.id = i.id LEFT JOIN clu c ON c.cid = p.cid)""",
    _PLANNED[_PLANNED.index("reasoned AS (") :],
)


def _with_clusters(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join((*_RAWS, _RAW_RULED, *_CLUSTERS, *parts)) + " "


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join((_INST, *parts)) + " "


_REP = "AND id IN (SELECT arg_min(id, (source, rel_path, id)) FROM inst WHERE kind IN ('image', 'video') GROUP BY sha256)"

SQL: dict[str, str] = {
    "cluster_winner_rank": _with(_MEDIA, f"s AS (SELECT *, round({_DATED_SCORE}, 4) AS score, min(id) OVER (PARTITION BY sha256) AS cluster_id, count(*) OVER (PARTITION BY sha256) AS n FROM media)") + f"SELECT cluster_id, id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {_ORDER}) AS INT) AS rank FROM s WHERE n > 1",
    "exact_clusters": _with(_MEDIA) + "SELECT min(id) AS cluster_id, count(*) AS n, max(id) AS last_id FROM media GROUP BY sha256 HAVING count(*) > 1",
    "cluster_size_histogram": _with(_MEDIA) + "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM media GROUP BY sha256 HAVING count(*) > 1) x GROUP BY size",
    "counts_by_kind": _with() + "SELECT kind, count(*) AS n FROM inst GROUP BY kind",
    "counts_by_source": _with() + "SELECT source, count(*) AS n FROM inst GROUP BY source",
    "counts_by_rule": _with(_RULED) + "SELECT rule, st AS status, count(*) AS n, count(*) FILTER (WHERE rp = 'second') AS to_the_second FROM resolved GROUP BY rule, st",
    "single_side_hashes": _with(_MEDIA) + "SELECT sha256, count(*) AS n FROM media GROUP BY sha256 HAVING sum(CASE WHEN source LIKE 'TAKEOUT:%' THEN 0 ELSE 1 END) = 0",
    "latest_run_per_stage": "SELECT event_type, event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY event_type)",
    "keyword_histogram": _with() + f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOPICS}) AS word FROM inst) x GROUP BY word",
    "date_range_summary": _with("d AS (SELECT camera_model, min(substr(exif_dto, 1, 10)) AS first_day, max(substr(exif_dto, 1, 10)) AS last_day, count(DISTINCT substr(exif_dto, 1, 10)) AS days FROM inst WHERE exif_dto IS NOT NULL GROUP BY camera_model)") + "SELECT *, CASE WHEN days = 1 THEN first_day ELSE first_day || ' ... ' || last_day || ' (' || days || ' distinct)' END AS summary FROM d",
    "first_camera_date": _with() + "SELECT dir, arg_min(exif_dto, (rel_path, id)) FILTER (WHERE exif_dto IS NOT NULL) AS exif_dto FROM inst GROUP BY dir",
    "missing_placement": _with() + "SELECT id, source, rel_path FROM inst WHERE id % 17 = 3",
    "orphan_paths": _with(_FAULTS) + "SELECT base, rel FROM (SELECT DISTINCT base, rel FROM disk) d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.base = d.base AND k.rel = d.rel)",
    "bytes_by_disposition": _with(_FAULTS) + "SELECT disposition, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM book JOIN inst USING (id) GROUP BY disposition",
    "discrepancy_union": _with(
        _FAULTS,
        """p AS (SELECT b.*, i.source || ':' || i.rel_path AS subject, i.sha256 FROM book b JOIN inst i USING (id)), k AS (SELECT * FROM p WHERE disposition IN ('archive', 'quarantine')),
  j AS (SELECT k.*, d.sha AS actual, d.base IS NOT NULL AS there FROM k LEFT JOIN disk d ON d.base = k.disposition AND d.rel = k.dest WHERE k.dest IS NOT NULL),
  u AS (SELECT 'invalid_disposition' AS kind, subject FROM p WHERE disposition = 'lost' UNION ALL SELECT 'missing_dest_record', subject FROM k WHERE dest IS NULL
    UNION ALL SELECT 'quarantine_not_byte_identical', subject FROM k WHERE dest IS NOT NULL AND disposition = 'quarantine' AND dsha <> sha256 UNION ALL SELECT 'missing_dest_file', subject FROM j WHERE NOT there
    UNION ALL SELECT 'hash_mismatch', disposition || '/' || dest FROM j WHERE there AND actual <> dsha
    UNION ALL SELECT 'orphan_in_' || base, rel FROM disk d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.base = d.base AND k.rel = d.rel)
    UNION ALL SELECT 'missing_placement', source || ':' || rel_path FROM inst WHERE id % 17 = 3)""",
    )
    + "SELECT kind, count(*) AS n, min(subject) AS first_subject FROM u GROUP BY kind",
    "incremental_scan_diff": _with() + "SELECT source, rel_path, size_bytes FROM inst WHERE length(rel_path) % 5 = 0 OR length(rel_path) % 7 = 0",
    "keyed_merge": _with() + "SELECT id, CASE WHEN id % 6 = 0 THEN size_bytes * 2 ELSE size_bytes END AS size_bytes, tags FROM inst UNION ALL SELECT id + 1000000, size_bytes * 2, NULL FROM inst WHERE id % 6 = 3",
    "changed_rows": _with() + "SELECT id, 0::BIGINT AS size_bytes, 'new' AS side FROM inst WHERE id % 10 <> 1 AND id % 9 = 0 AND size_bytes <> 0 UNION ALL SELECT id, size_bytes, 'old' FROM inst WHERE id % 10 = 1 OR (id % 9 = 0 AND size_bytes <> 0)",
    "path_parts": _with() + f"SELECT id, dir, {_NAME} AS name, regexp_extract({_NAME}, '^(.*)\\.[^.]*$', 1) AS stem, regexp_extract({_NAME}, '\\.[^.]*$') AS ext FROM inst",
    "folder_date": _with(_DATED) + "SELECT id, fd AS date, fp AS precision FROM dated",
    "filename_date": _with(_DATED) + "SELECT id, nd AS date, np AS precision FROM dated",
    "exif_iso": _with() + "SELECT id, CASE WHEN id % 13 < 2 THEN NULL ELSE ts || CASE id % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN '.25' ELSE '' END END AS iso, CASE WHEN id % 13 < 2 THEN NULL ELSE replace(substr(ts, 1, 10), '-', ':') || ' ' || substr(ts, 12, 8) END AS padded FROM inst",
    "keyword_components": _with() + f"SELECT id, array_to_string({_TOPICS}, ';') AS keywords FROM inst",
    "exif_flags": _with(_DATED, "m AS (SELECT *, count(exif_dto) OVER (PARTITION BY source, dir, exif_dto) > 1 AS mass FROM dated WHERE kind IN ('image', 'video'))")
    + """SELECT id, CASE WHEN exif_dto IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN substr(exif_dto, 1, 10) IN ('1970-01-01', '1980-01-01', '2000-01-01') THEN 'epoch_default' END, CASE WHEN mass THEN 'mass_identical' END,
      CASE WHEN camera_model = 'Canon' AND CAST(substr(exif_dto, 1, 4) AS INT) < 2030 THEN 'predates_camera' END, CASE WHEN fp IN ('day', 'month') AND CAST(substr(exif_dto, 1, 4) AS INT) - CAST(substr(fd, 1, 4) AS INT) >= 2 THEN 'scanner_date' END], lambda x: x IS NOT NULL), ';') END AS flags FROM m""",
    "mass_identical": _with(_MEDIA) + "SELECT source, substr(exif_dto, 1, 10) AS exif_dto, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, substr(rel_path, 1, 1) AS d, substr(exif_dto, 1, 10) AS exif_dto, count(*) AS n FROM media WHERE exif_dto IS NOT NULL GROUP BY ALL) x WHERE n > 5 GROUP BY source, exif_dto",
    "resolve_dates": _with(_RULED) + "SELECT id, rd AS resolved_date, rp AS resolved_precision, rs AS resolved_source, st AS status, CASE rule WHEN 'R1' THEN 0.95 WHEN 'R2' THEN 0.85 WHEN 'R3' THEN 0.8 WHEN 'R3f' THEN 0.82 WHEN 'R4' THEN 0.7 WHEN 'R4b' THEN 0.6 WHEN 'R4bf' THEN 0.68 WHEN 'R5' THEN 0.5 END::DOUBLE AS confidence, rule FROM resolved",
    "date_merge": _with(
        _RULED,
        """c AS (SELECT *, min(id) OVER (PARTITION BY sha256) AS cid, count(*) OVER (PARTITION BY sha256) AS n, rd IS NOT NULL AS has, rd IS NOT NULL AND kind <> 'video' AND NOT (rs = 'folder' AND trust <> 'curated') AS rel FROM resolved),
  q AS (SELECT *, CASE WHEN max(rel) OVER (PARTITION BY cid) THEN rel ELSE has END AS pool, CASE rp WHEN 'second' THEN 19 WHEN 'day' THEN 10 WHEN 'month' THEN 7 ELSE 4 END AS chars,
    CASE WHEN rs = 'folder' AND trust <> 'curated' THEN 1.5 WHEN rs = 'folder' THEN 4 WHEN rs = 'exif' THEN 3 WHEN rs = 'takeout_json' THEN 2 WHEN rs = 'filename' THEN 1 ELSE 0 END AS pri FROM c WHERE n > 1),
  w AS (SELECT cid, arg_max(id, (pri, chars, rel_path)) FILTER (WHERE pool) AS wid, bool_and(has) AS all_has, bool_or(has) AS any_has FROM q GROUP BY cid),
  x AS (SELECT w.*, b.rd, b.rp, b.rs, coalesce((SELECT bool_or(substr(q.rd, 1, least(10, q.chars, b.chars)) <> substr(b.rd, 1, least(10, q.chars, b.chars))) FROM q WHERE q.cid = w.cid AND q.pool), false) AS differs FROM w LEFT JOIN q b ON b.id = w.wid)""",
    )
    + "SELECT cid AS cluster_id, rd AS date, rp AS precision, rs AS source, CASE WHEN NOT any_has THEN 'date_unresolved' ELSE array_to_string(list_filter([CASE WHEN differs THEN 'date_disagreement' END, CASE WHEN NOT all_has THEN 'date_unresolved_members' END], lambda f: f IS NOT NULL), ';') END AS flags, (NOT any_has OR differs) AS disagrees FROM x",
    "score_components": _with(_MEDIA)
    + "SELECT id, CAST(round(3000.0::DOUBLE * log2(greatest(width::DOUBLE * height / 1e6, 0.01))) AS BIGINT) AS s_resolution, CAST(round(1500 * CASE WHEN kind = 'image' AND id % 4 = 0 THEN 2.0 WHEN recompressed THEN 0.0 ELSE 1.0 END) AS BIGINT) AS s_format, CAST(round(least(tags, 60)::DOUBLE / 60 * 1000) AS BIGINT) AS s_richness, CAST(CASE WHEN exif_dto IS NOT NULL THEN 1000 ELSE 0 END AS BIGINT) AS s_trusted_date, CAST(CASE WHEN trust = 'curated' THEN 750 ELSE 0 END AS BIGINT) AS s_source_trust, CAST(round(0.5::DOUBLE * log10(greatest(size_bytes, 1)::DOUBLE) * 1000) AS BIGINT) AS s_size, CAST(CASE WHEN recompressed THEN -2000 ELSE 0 END AS BIGINT) AS s_recompression FROM media",
    "guardrails": _with(
        _MEDIA,
        f"s AS (SELECT *, id % 97 AS cid, round({_DATED_SCORE}, 4) AS score FROM media), r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY {_ORDER}) AS rk, lead(score) OVER (PARTITION BY cid ORDER BY {_ORDER}) AS nxt FROM s), w AS (SELECT * FROM r WHERE rk = 1)",
    )
    + """SELECT w.cid AS cluster_id, array_to_string(list_filter([CASE WHEN w.cid % 3 = 2 AND w.score - w.nxt < 0.5 THEN 'score_margin' END,
      CASE WHEN w.cid % 3 <> 0 AND bool_or(m.id <> w.id AND m.kind = w.kind AND abs(m.width / m.height::DOUBLE - w.width / w.height::DOUBLE) / greatest(m.width / m.height::DOUBLE, w.width / w.height::DOUBLE) > 0.01) THEN 'aspect_mismatch' END,
      CASE WHEN w.trust = 'takeout' AND bool_or(m.id <> w.id AND m.trust = 'curated' AND m.width = w.width AND m.height = w.height) THEN 'takeout_winner_over_curated' END,
      CASE WHEN w.cid % 2 = 0 THEN 'possible_duplicate_band' END, CASE WHEN w.cid % 3 = 2 THEN 'video_never_auto' END], lambda x: x IS NOT NULL), ';') AS guardrails
      FROM w JOIN r m USING (cid) GROUP BY w.cid, w.score, w.nxt, w.trust, w.id, w.kind, w.width, w.height""",
    "score_gap": _with(_MEDIA, f"s AS (SELECT *, id % 97 AS cid, round({_DATED_SCORE}, 4) AS score FROM media), r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY {_ORDER}) AS rk, lead(score) OVER (PARTITION BY cid ORDER BY {_ORDER}) AS nxt FROM s)") + "SELECT cid AS cluster_id, id, CAST(round((score - nxt) * 100) AS BIGINT) AS gap_hundredths FROM r WHERE rk = 1",
    "merged_facts": _with(_MEDIA, f"s AS (SELECT *, id % 97 AS cid, round({_DATED_SCORE}, 4) AS score, CASE WHEN taken IS NOT NULL THEN id / 100.0::DOUBLE END AS side, CASE WHEN id % 6 = 0 THEN 'd' || id % 4 END AS said FROM media), r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY {_ORDER}) AS rk FROM s)")
    + """SELECT cid AS cluster_id, arg_min(coalesce(gps_lat, side), (CASE WHEN gps_lat IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN rk = 1 THEN 0 ELSE 1 END, id)) FILTER (WHERE gps_lat IS NOT NULL OR side IS NOT NULL) AS lat,
      arg_min(CASE WHEN gps_lat IS NOT NULL THEN gps_lon ELSE 1.0 END, (CASE WHEN gps_lat IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN rk = 1 THEN 0 ELSE 1 END, id)) FILTER (WHERE gps_lat IS NOT NULL OR side IS NOT NULL) AS lon,
      arg_min(CASE WHEN gps_lat IS NOT NULL THEN 'exif' ELSE 'takeout' END, (CASE WHEN gps_lat IS NOT NULL THEN 0 ELSE 1 END, id)) FILTER (WHERE gps_lat IS NOT NULL OR side IS NOT NULL) AS gps_source,
      coalesce(array_to_string(list_sort(list(DISTINCT said) FILTER (WHERE said IS NOT NULL)), ';'), '') AS descriptions, count(*) AS n FROM r GROUP BY cid""",
    "banded_pairs": _with(_PAIRS.format(rep=""), "met AS (SELECT a, b, d_phash > 6 AS weak FROM pairs WHERE d_phash <= 10 AND d_dhash <= 8)", "ends AS (SELECT a AS id, weak FROM met UNION ALL SELECT b, weak FROM met)")
    + "SELECT i.id, min(i.id) OVER (PARTITION BY phash, dhash, width, height) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_weak, 0) AS n_weak FROM inst i LEFT JOIN (SELECT id, count(*) AS n_links, count(*) FILTER (WHERE weak) AS n_weak FROM ends GROUP BY id) e USING (id) WHERE kind = 'image'",
    "video_pairs": _with(_CLIPS.format(rep=""), "ends AS (SELECT a AS id FROM clip_pairs UNION ALL SELECT b FROM clip_pairs)")
    + "SELECT i.id, min(i.id) OVER (PARTITION BY video_sig) AS class_id, coalesce(n_links, 0) AS n_links FROM inst i LEFT JOIN (SELECT id, count(*) AS n_links FROM ends GROUP BY id) e USING (id) WHERE kind = 'video'",
    "near_clusters": _with(
        _MEDIA,
        _PAIRS.format(rep=_REP),
        _CLIPS.format(rep=_REP),
        """near AS (SELECT a, b, d_phash > 6 AS weak FROM pairs WHERE d_phash <= 10 AND d_dhash <= 8 UNION ALL SELECT a, b, true FROM clip_pairs),
  copies AS (SELECT first_value(id) OVER (PARTITION BY sha256 ORDER BY source, rel_path, id) AS a, id AS b FROM media),
  e AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT a, b FROM copies WHERE a <> b UNION SELECT b, a FROM copies WHERE a <> b),
  cc(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, cc.label FROM cc JOIN e ON e.a = cc.node),
  m AS (SELECT node, min(label) AS cid FROM cc GROUP BY node), k AS (SELECT m.cid, m.node, i.sha256, i.kind, EXISTS (SELECT 1 FROM near WHERE weak AND (a = m.node OR b = m.node)) AS weak FROM m JOIN media i ON i.id = m.node)""",
    )
    + "SELECT cid AS cluster_id, CASE WHEN count(DISTINCT sha256) = 1 THEN 'exact' WHEN bool_or(kind = 'video') THEN 'near_video' ELSE 'near_image' END AS cluster_kind, bool_or(weak) AS weak, count(*) AS n, max(node) AS last_id FROM k GROUP BY cid",
    "edited_pairs": _with(_MEDIA) + "SELECT id + 1000000 AS edited_id, id AS original_id FROM media WHERE id % 6 = 1",
    "raw_jpeg_pairs": _with() + "SELECT a.id AS raw_id, a.id + 1 AS jpeg_id FROM inst a JOIN inst b ON b.id = a.id + 1 WHERE a.id % 4 = 0 AND a.kind = 'image' AND b.kind = 'image'",
    "live_pairs": _with() + "SELECT a.id AS image_id, b.id AS video_id FROM inst a JOIN inst b ON a.content_id = b.content_id WHERE a.kind = 'image' AND b.kind = 'video'",
    "absorbed_copies": _with(_MEDIA, "h AS (SELECT a.id AS w, x.id FROM inst a JOIN inst b ON a.content_id = b.content_id AND a.kind = 'image' AND b.kind = 'video', media x WHERE x.id IN (a.id, b.id))") + "SELECT min(h.w) AS winner_id, m.id FROM media m JOIN media k ON k.sha256 = m.sha256 JOIN h ON h.id = k.id WHERE m.id NOT IN (SELECT id FROM h) GROUP BY m.id",
    "placement_plan": _with_clusters(*_PLACED) + "SELECT id, disposition, reason, dest AS dest_rel_path, disposition = 'archive' AND mime NOT IN ('image/jpeg', 'image/png', 'image/tiff', 'image/heic', 'image/heif') AS use_sidecar, winner_dest FROM won",
    "quarantine_index": _with_clusters(*_PLACED) + "SELECT sha256, arg_min(dest, (source, rel_path, id)) AS dest_rel_path, array_to_string(list_sort(list(source || ':' || rel_path)), ';') AS sources, arg_min(reason, (source, rel_path, id)) AS reason, (list(winner_dest ORDER BY source, rel_path, id))[1] AS winner_dest FROM won WHERE disposition = 'quarantine' GROUP BY sha256",
    "space_needed": _with_clusters(*_PLACED, "a AS (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n FROM won WHERE disposition = 'archive'), q AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT arg_min(size_bytes, (source, rel_path, id)) AS n FROM won WHERE disposition = 'quarantine' GROUP BY sha256) x)") + "SELECT a.n AS archive_bytes, q.n AS quarantine_bytes, CAST(floor((a.n + q.n) * 1.15::DOUBLE) AS BIGINT) AS required_bytes FROM a, q",
    "keyword_map_apply": _with() + "SELECT id, CASE id % 7 WHEN 3 THEN CASE id % 13 WHEN 1 THEN 'subject' WHEN 2 THEN 'holiday;subject' ELSE 'subject;vac' || (id % 13) END WHEN 5 THEN 'card_' || replace(od, '-', '') WHEN 6 THEN 'misc' ELSE '' END AS keywords FROM inst",
    "reconcile_moves": _with(_MEDIA, _MOVED)
    + "SELECT p.id, d.rel AS new_rel, CASE p.id % 6 WHEN 1 THEN '2024-01-01' WHEN 4 THEN '2024-01-01' END AS folder_date, CASE p.id % 6 WHEN 2 THEN '2004-2006' WHEN 3 THEN 'undated' END AS bucket, CASE p.id % 6 WHEN 1 THEN 'caves' WHEN 4 THEN 'topical' ELSE '' END AS keywords, CASE WHEN p.id % 6 IN (2, 3) THEN CASE WHEN p.date IS NULL THEN 'keep' ELSE 'demote' END WHEN p.date IS NULL THEN 'correct' WHEN p.id % 6 = 1 THEN CASE WHEN substr(p.date, 1, 4) = '2024' THEN 'keep' ELSE 'correct' END ELSE CASE WHEN substr(p.date, 1, 7) = '2024-01' THEN 'keep' ELSE 'correct' END END AS action FROM placed p JOIN disk d USING (id) WHERE p.id % 6 <> 0",
    "reconcile_losses": _with(_MEDIA, _MOVED) + "SELECT id, rel, CASE WHEN id % 4 = 1 THEN 'removed' WHEN id % 4 = 3 AND id % 3 = 2 THEN 'exported' ELSE 'unaccounted' END AS state FROM placed WHERE id % 6 = 5",
    "restorations": _with(_FAULTS) + "SELECT id, dest AS rel FROM book WHERE dest IN (SELECT rel FROM disk)",
    "unknown_files": _with(_MEDIA, _MOVED) + "SELECT rel || '.new' AS rel, 'media' AS kind FROM disk",
    "camera_window": _with("t AS (SELECT id, camera_model, CAST(epoch(CAST(exif_dto AS TIMESTAMP)) AS BIGINT) AS at FROM inst WHERE exif_dto IS NOT NULL), n AS (SELECT a.id, b.id AS other_id, abs(a.at - b.at) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.at - b.at), b.id) AS rn FROM t a JOIN t b ON a.camera_model = b.camera_model AND a.id <> b.id AND abs(a.at - b.at) <= 3600)") + "SELECT id, other_id, gap FROM n WHERE rn <= 3",
    "queue_view": _with(_PLANNED) + "SELECT r.id, r.source, r.rel_path FROM resolved r JOIN won w ON w.id = r.id WHERE r.st = 'conflict' AND NOT (w.cluster_id IS NOT NULL AND (w.role = 'loser' OR w.cluster_id % 2 = 0))",
    "bulk_prefer_curated": _with(_MEDIA) + "SELECT m.id % 211 AS cluster_id, m.id % 211 AS old_winner, min(m.id) AS new_winner FROM media m JOIN media w ON w.id = m.id % 211 WHERE w.id % 4 <> 0 AND w.trust <> 'curated' AND m.trust = 'curated' AND m.width = w.width AND m.height = w.height GROUP BY m.id % 211",
    "bulk_accept": _with(_MEDIA) + "SELECT id AS cluster_id, CASE WHEN id % 4 = 0 THEN 'auto' WHEN id % 3 = 0 THEN 'pending' ELSE 'reviewed' END AS status FROM media WHERE id < 211",
    "swapped_members": _with(_MEDIA, "s AS (SELECT m.id % 211 AS cid, min(m.id) AS nw FROM media m JOIN media w ON w.id = m.id % 211 WHERE w.id % 4 <> 0 AND w.trust <> 'curated' AND m.trust = 'curated' AND m.width = w.width AND m.height = w.height GROUP BY m.id % 211)") + "SELECT m.id % 211 AS cluster_id, m.id, CASE WHEN s.nw = m.id THEN 'winner' WHEN m.id < 211 AND s.nw IS NULL THEN 'winner' ELSE 'loser' END AS role FROM media m LEFT JOIN s ON s.cid = m.id % 211",
    "manual_dates": _with() + "SELECT id, CASE id % 5 WHEN 0 THEN substr(od, 1, 4) || '-01-01' WHEN 1 THEN substr(od, 1, 7) || '-01' WHEN 2 THEN od WHEN 3 THEN od || 'T21:34:13' END AS date, CASE id % 5 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'second' END AS precision FROM inst",
    "classified_kinds": _with() + "SELECT id, kind AS kind_found FROM inst",
    "sidecar_bodies": _with() + "SELECT id, CASE WHEN id % 10 <> 9 THEN 't' || id END AS title, NULL::VARCHAR AS description, CASE WHEN id % 10 <> 9 THEN od || 'T00:00:00+00:00' END AS taken, CASE WHEN id % 10 <> 9 AND id % 2 = 1 THEN 1.5::DOUBLE END AS lat, CASE WHEN id % 10 <> 9 AND id % 2 = 1 THEN 2.5::DOUBLE END AS lon FROM inst",
    "sidecar_args": _with()
    + "SELECT id, CASE WHEN id % 2 = 0 THEN '-DateTimeOriginal=' || replace(od, '-', ':') || ' 00:00:00' || chr(10) || '-CreateDate=' || replace(od, '-', ':') || ' 00:00:00' || chr(10) || '-ModifyDate=' || replace(od, '-', ':') || ' 00:00:00' || chr(10) || '-XMP-pipeline:DatePrecision=day' ELSE '-XMP-pipeline:DatePrecision=bucket:undated' END || chr(10) || '-XMP-dc:Subject-=caves' || chr(10) || '-XMP-dc:Subject+=caves' || CASE WHEN id % 2 = 1 THEN chr(10) || '-XMP-dc:Subject-=undated' || chr(10) || '-XMP-dc:Subject+=undated' ELSE '' END || chr(10) || '-XMP-pipeline:DateSource=folder_move' AS args FROM inst",
    "metadata_args": _with(_RULED, "z AS (SELECT *, replace(substr(rd, 1, 10), '-', ':') || ' ' || CASE WHEN length(rd) >= 19 THEN substr(rd, 12, 8) ELSE '00:00:00' END AS stamp FROM resolved)")
    + "SELECT id, array_to_string(list_filter(['-DateTimeOriginal=' || stamp, '-CreateDate=' || stamp, '-ModifyDate=' || stamp, '-GPSLatitude=' || CAST(abs(gps_lat) AS VARCHAR), CASE WHEN gps_lat IS NOT NULL THEN '-GPSLatitudeRef=N' END, '-GPSLongitude=' || CAST(gps_lon AS VARCHAR), CASE WHEN gps_lat IS NOT NULL THEN '-GPSLongitudeRef=W' END, '-XMP-dc:Subject+=k', CASE WHEN id % 5 = 0 THEN '-XMP:Rating=4' END, '-XMP-pipeline:DateSource=' || rs, '-XMP-pipeline:DatePrecision=' || rp, '-XMP-pipeline:SourcePath=' || source || ':' || rel_path], lambda x: x IS NOT NULL), chr(10)) AS args FROM z",
    "sidecar_match": _with(
        _MEDIA,
        f"""f AS (SELECT source || '|' || dir AS dir, {_NAME} AS media_name, id FROM media), sc AS (SELECT DISTINCT dir, CASE id % 5 WHEN 0 THEN media_name || '.json' WHEN 1 THEN media_name || '.supplemental-meta.json' WHEN 2 THEN substr(media_name, 1, length(media_name) - 5) || '.json' WHEN 3 THEN media_name || '(1).json' END AS json_name,
      CASE id % 5 WHEN 2 THEN substr(media_name, 1, length(media_name) - 5) ELSE media_name END AS base, id % 5 AS k FROM f WHERE id % 5 <> 4),
      p AS (SELECT sc.*, (SELECT count(*) FROM f WHERE f.dir = sc.dir AND f.media_name = sc.base) AS same, (SELECT count(*) FROM f WHERE f.dir = sc.dir AND starts_with(f.media_name, sc.base)) AS n, (SELECT min(f.media_name) FROM f WHERE f.dir = sc.dir AND starts_with(f.media_name, sc.base)) AS first_name FROM sc)""",
    )
    + "SELECT dir, json_name, CASE WHEN k = 3 THEN NULL WHEN same > 0 THEN base WHEN n = 1 THEN first_name END AS media_name, CASE WHEN k = 3 THEN 'unmatched' WHEN same > 0 THEN 'exact' WHEN n = 1 THEN 'truncation' ELSE 'unmatched' END AS method, CASE WHEN k = 3 THEN 'no_media_match' WHEN same > 0 OR n = 1 THEN NULL WHEN n > 1 THEN 'ambiguous_truncation' ELSE 'no_media_match' END AS reason FROM p",
    "dir_provenance": _with(
        _MEDIA,
        f"""f AS (SELECT source, dir, {_NAME} AS name, id, recompressed FROM media), d AS (SELECT source, dir, count(*) AS media_count, sum(CASE WHEN recompressed THEN 1 ELSE 0 END) AS rec, count(*) FILTER (WHERE id % 5 <> 4) AS sidecar_count, bool_or(id % 5 = 4) AS descriptor, min(id % 7) AS k FROM f GROUP BY source, dir),
      m AS (SELECT source, dir, count(*) AS matched FROM f WHERE id % 5 IN (0, 1) OR (id % 5 = 2 AND (SELECT count(*) FROM f g WHERE g.source = f.source AND g.dir = f.dir AND starts_with(g.name, substr(f.name, 1, length(f.name) - 5))) = 1) GROUP BY source, dir),
      s AS (SELECT d.*, k = 4 AS named, least(1.0, 0.6 * coalesce(matched, 0) / media_count::DOUBLE + CASE WHEN k = 4 THEN 0.5 ELSE 0 END + CASE WHEN descriptor THEN 0.3 ELSE 0 END + 0.2 * rec / media_count::DOUBLE) AS signal FROM d LEFT JOIN m USING (source, dir))""",
    )
    + "SELECT source, dir, media_count, sidecar_count, named AS name_signature, descriptor, CASE WHEN k = 3 THEN 'curated' WHEN k = 6 OR round(signal, 4) >= 0.5 THEN 'takeout_derived' ELSE 'curated' END AS classification, CASE k WHEN 3 THEN 'config:curated' WHEN 6 THEN 'config:takeout_derived' END AS override FROM s",
    "dedup_plan": _with_clusters() + "SELECT p.cid AS cluster_id, p.id, p.role, c.k AS cluster_kind, c.status, c.guardrails, c.date, c.precision, c.date_source, c.date_flags FROM peo p JOIN clu c USING (cid)",
    "dedup_facts": _with_clusters(
        "w AS (SELECT *, CASE WHEN taken IS NOT NULL THEN id / 100.0::DOUBLE END AS side, CASE WHEN id % 6 = 0 THEN 'd' || id % 4 END AS said FROM rk)",
        f"words AS (SELECT cid, unnest(CASE WHEN {_RAW} THEN ['raws', 'b' || (id // 20)] ELSE {_TOPICS} END) AS word FROM rk UNION SELECT cid, 'album' || id % 3 FROM rk WHERE id % 10 = 7)",
        "g AS (SELECT cid, arg_min(coalesce(gps_lat, side), (CASE WHEN gps_lat IS NOT NULL THEN 0 ELSE 1 END, CASE coalesce(fr, '') WHEN 'winner' THEN 0 WHEN 'companion' THEN 1 WHEN 'loser' THEN 2 ELSE CASE WHEN rk = 1 THEN 0 ELSE 1 END END, id)) FILTER (WHERE gps_lat IS NOT NULL OR side IS NOT NULL) AS lat, CASE WHEN bool_or(gps_lat IS NOT NULL) THEN 'exif' WHEN bool_or(side IS NOT NULL) THEN 'takeout' END AS gps_source, coalesce(array_to_string(list_sort(list(DISTINCT said) FILTER (WHERE said IS NOT NULL)), ';'), '') AS descriptions, count(*) AS n FROM w GROUP BY cid)",
    )
    + "SELECT g.cid AS cluster_id, c.winner_id, g.lat, g.gps_source, g.descriptions, coalesce((SELECT string_agg(DISTINCT word, ';' ORDER BY word) FROM words WHERE words.cid = g.cid), '') AS keywords, g.n FROM g JOIN clu c USING (cid)",
    "cluster_audit": _with_clusters() + "SELECT c.cid AS cluster_id, c.k AS cluster_kind, c.status, i.rel_path AS winner FROM clu c JOIN inst i ON i.id = c.winner_id ORDER BY CASE WHEN c.status = 'pending' THEN 0 ELSE 1 END, c.k, i.rel_path, c.cid LIMIT 200",
    "pending_clusters": _with_clusters() + "SELECT c.cid AS cluster_id, c.k AS cluster_kind, c.winner_id, i.rel_path AS winner_path, (SELECT count(*) FROM peo WHERE peo.cid = c.cid) AS members FROM clu c JOIN inst i ON i.id = c.winner_id WHERE c.status = 'pending'",
    "cluster_member_places": _with_clusters() + "SELECT cid AS cluster_id, id, CAST(row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN id % 9 <> 0 THEN score END DESC NULLS LAST, id) AS INT) AS place, source, size_bytes FROM peo",
    "replaced_clusters": _with_clusters() + "SELECT cid AS cluster_id, id, cid % 3 = 0 AS reviewed FROM peo",
    "locked_dates": _with(
        "m AS (SELECT id, taken, artifact FROM inst WHERE kind IN ('image', 'video') AND source <> 'LOCAL')",
        "r AS (SELECT id, taken, artifact FROM m UNION ALL SELECT id + 1000000, taken, artifact FROM m WHERE id % 3 = 0)",
    )
    + "SELECT id, CASE WHEN id % 10 = 0 THEN '1999-01-01' WHEN NOT artifact THEN taken END AS resolved_date, CASE WHEN id % 10 = 0 THEN 'review' WHEN NOT artifact AND taken IS NOT NULL THEN 'takeout_json' END AS resolved_source, CASE WHEN id % 10 = 0 THEN 'reviewed' WHEN NOT artifact AND taken IS NOT NULL THEN 'auto' ELSE 'conflict' END AS status FROM r",
    "raw_fields": _with()
    + """SELECT id, CASE WHEN id % 19 <> 0 THEN mime END AS mime, CASE WHEN id % 19 <> 0 AND id % 3 = 0 THEN od || 'T10:11:12' END AS exif_dto, CASE WHEN id % 19 <> 0 THEN id / 4.0::DOUBLE END AS gps_lat, CASE WHEN id % 19 <> 0 AND id % 5 <> 0 THEN 'Acme' END AS camera_make,
      CASE WHEN id % 19 <> 0 THEN CAST(2 + CASE WHEN id % 3 <> 2 THEN 1 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 4 <> 3 THEN 1 ELSE 0 END + CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS tags,
      CASE WHEN id % 19 <> 0 THEN width END AS width, CASE WHEN id % 19 <> 0 THEN height END AS height, CASE WHEN id % 19 <> 0 AND id % 17 = 0 THEN 'broken' END AS error FROM inst""",
    "exif_candidates": _with() + "SELECT id, CASE WHEN id % 3 = 0 THEN '2001-02-03T04:05:06' WHEN id % 19 <> 0 AND id % 4 <> 3 THEN od || 'T10:11:12' END AS date, id % 3 <> 0 AND id % 19 <> 0 AND id % 4 <> 3 AS from_create_date FROM inst",
    "ingest_stage": _with("s AS (SELECT *, id % 13 <> 0 AND (id % 5 = 0 OR id % 7 = 0) AS fresh, id % 19 <> 0 AND id % 29 <> 0 AS dumped FROM inst)")
    + """SELECT source, rel_path, CASE WHEN NOT fresh THEN 'known' WHEN id % 23 <> 0 THEN sha256 END AS sha256, CASE WHEN fresh AND dumped THEN mime END AS mime, CASE WHEN fresh THEN kind END AS kind,
      CASE WHEN fresh AND dumped THEN CAST(2 + CASE WHEN id % 3 <> 2 THEN 1 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 4 <> 3 THEN 1 ELSE 0 END + CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS tags,
      CASE WHEN fresh THEN array_to_string(list_filter([CASE WHEN NOT dumped AND kind <> 'other' THEN 'mime_from_extension' END, CASE WHEN id % 29 = 0 OR (id % 17 = 0 AND id % 19 <> 0) THEN 'unreadable_metadata' END, CASE WHEN size_bytes = 0 THEN 'zero_byte' END], lambda x: x IS NOT NULL), ';') END AS flags,
      CASE WHEN fresh AND dumped AND (id % 3 = 0 OR id % 4 <> 3) THEN od || 'T10:11:12' END AS dated, CASE WHEN fresh THEN dumped AND id % 3 <> 0 AND id % 4 <> 3 END AS from_create_date
      FROM s WHERE fresh OR id % 5 <> 0""",
    "ingest_summary": _with() + "SELECT source, count(*) FILTER (WHERE id % 13 <> 0) AS discovered, count(*) FILTER (WHERE id % 13 <> 0 AND (id % 5 = 0 OR id % 7 = 0)) AS processed, count(*) FILTER (WHERE id % 13 <> 0 AND id % 5 <> 0 AND id % 7 <> 0) AS unchanged, count(*) FILTER (WHERE id % 13 = 0 AND id % 5 <> 0) AS missing FROM inst GROUP BY source",
    "run_states": "SELECT event_type AS stage, max(CAST(event_id AS VARCHAR)) AS run_id, arg_max(CASE WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ok' END, CAST(event_id AS VARCHAR)) AS status, nullif(arg_max(CASE WHEN event_id % 5 <> 0 THEN '01:00' ELSE '' END, CAST(event_id AS VARCHAR)), '') AS finished FROM events GROUP BY event_type",
    "locked_members": _with(_MEDIA) + "SELECT id, id % 3 <> 0 AND id % 2 = 0 AND id % 5 <> 0 AS archived FROM media WHERE id % 211 IN (SELECT id FROM media WHERE id < 211 AND id % 4 <> 0 AND id % 3 <> 0)",
    "batch_reviews": _with(_RULED, "b AS (SELECT *, st = 'conflict' AND source = 'LOCAL' AND id % 2 = 0 AND nd IS NOT NULL AS hit FROM resolved)")
    + "SELECT id, CASE WHEN hit THEN nd ELSE rd END AS resolved_date, CASE WHEN NOT hit THEN rp WHEN contains(nd, 'T') THEN 'second' ELSE 'day' END AS resolved_precision, CASE WHEN hit THEN 'filename' ELSE rs END AS resolved_source, CASE WHEN hit THEN 'reviewed' ELSE st END AS status FROM b",
    "direct_children": _with() + "SELECT id, rel_path FROM inst WHERE source = 'LOCAL' AND dir = 'topical/vac3'",
    "pending_sidecars": _with() + "SELECT id, CASE WHEN id % 2 = 0 THEN 'date' ELSE 'keywords' END AS reason, 'a/' || id AS rel, CASE WHEN id % 2 = 0 THEN od END AS date, CASE WHEN id % 6 = 0 THEN 'a;b' ELSE '' END AS keywords FROM inst WHERE id % 3 = 0 AND id % 5 <> 0 AND id % 11 <> 0 AND id % 4 <> 1 AND id % 7 <> 0",
    "manifests": _with(_FAULTS) + "SELECT i.source, i.rel_path, b.dest AS dest_rel_path, 'a;' || i.source AS keywords FROM book b JOIN inst i USING (id) WHERE b.disposition = 'archive'",
    "tag_facts": _with()
    + """SELECT id, array_to_string(list_filter([CASE WHEN id % 5 = 0 AND kind <> 'other' THEN 'mime_from_extension' END, CASE WHEN id % 6 = 0 THEN 'unreadable_metadata' END, CASE WHEN size_bytes = 0 THEN 'zero_byte' END, CASE WHEN kind = 'image' AND id % 2 <> 0 THEN 'corrupt' END, CASE WHEN id % 13 = 0 THEN 'no_video' END], lambda x: x IS NOT NULL), ';') AS flags,
      CAST(CASE WHEN id % 4 = 0 THEN 3 ELSE 2 END AS BIGINT) AS richness, 'c' || id AS identifier, mime = 'image/jpeg' AND id % 4 <> 0 AND id % 3 = 0 AS recompressed,
      CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'Trip' ELSE regexp_extract(dir, '[^/]*$') END WHEN id % 7 <> 4 THEN regexp_extract(dir, '[^/]*$') END AS album FROM inst""",
    "stored_rows": _with() + "SELECT id, source, size_bytes FROM inst WHERE CASE WHEN source = 'LOCAL' THEN id % 8 = 0 ELSE id % 4 <= 2 END",
    "reviewed_dates": _with(_RULED)
    + """SELECT id, CASE WHEN typed THEN '1987-06-01' WHEN got IS NOT NULL THEN got ELSE rd END AS resolved_date, CASE WHEN typed THEN 'month' WHEN got IS NULL THEN rp WHEN which = 'folder' THEN 'year' WHEN which = 'filename' THEN 'day' ELSE 'second' END AS resolved_precision,
      CASE WHEN typed THEN 'review' WHEN got IS NULL THEN rs ELSE which END AS resolved_source, CASE WHEN typed OR got IS NOT NULL THEN 'reviewed' ELSE st END AS status, CASE WHEN id % 10 = 4 THEN 'pre-2000' END AS bucket
      FROM (SELECT *, id % 7 = 1 AND id % 2 = 0 AS typed, CASE which WHEN 'exif' THEN exif_dto WHEN 'folder' THEN '2001-01-01' WHEN 'takeout_json' THEN taken WHEN 'filename' THEN '2002-02-02' END AS got
      FROM (SELECT *, CASE id % 12 WHEN 0 THEN 'exif' WHEN 3 THEN 'folder' WHEN 6 THEN 'takeout_json' WHEN 9 THEN 'filename' END AS which FROM resolved) x) y""",
    "match_rates": _with(_MEDIA) + "SELECT source, count(taken) AS matched, CAST(floor(1000.0 * count(taken) / count(*)) AS BIGINT) AS per_mille, (SELECT greatest(count(*) - 10, 0) FROM media WHERE taken IS NULL) AS not_shown FROM media GROUP BY source",
    "audit_sample": _with() + "SELECT id, dir FROM (SELECT id, dir, row_number() OVER (PARTITION BY dir ORDER BY md5('42:' || id), id) AS k, count(*) OVER (PARTITION BY dir) AS n FROM inst) x WHERE k <= greatest(5, ceil(n * 0.01))",
    "states_at_errors": """WITH log AS (SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error'), f AS (SELECT user_id, arg_min(event_type, event_id) AS first_type FROM log GROUP BY user_id)
SELECT a.event_id, a.user_id, l.event_type AS last_type, l.event_id AS last_id, f.first_type FROM (SELECT * FROM events WHERE event_type = 'error') a
  ASOF LEFT JOIN log l ON a.user_id = l.user_id AND a.event_id >= l.event_id LEFT JOIN f ON f.user_id = a.user_id""",
}

SQL["verify_json"] = (
    "WITH c AS (" + SQL["bytes_by_disposition"] + "), f AS (" + SQL["discrepancy_union"] + """)
SELECT to_json({'passed': false, 'counts': (SELECT list({'disposition': disposition, 'n': n, 'bytes': bytes} ORDER BY disposition) FROM c), 'discrepancies': (SELECT list({'kind': kind, 'subject': CAST(n AS VARCHAR)} ORDER BY kind) FROM f)})::VARCHAR AS report"""
)

SQL["catalog_merge"] = SQL["keyed_merge"]
SQL["catalog_changes"] = SQL["changed_rows"]
SQL["imported_clusters"] = SQL["near_clusters"]


def _provenance_dates() -> str:
    """The dates, with what ``dir_provenance`` says of a directory in place of the trust that the inventory has."""
    inst0 = _INST.replace("inst AS", "inst0 AS", 1)
    chain = SQL["dir_provenance"].removeprefix("WITH RECURSIVE ").replace(_INST + ", ", "", 1).replace("FROM inst ", "FROM inst0 ")
    parts, _, last = chain.rpartition(" SELECT source, dir, media_count")
    given = "given AS (SELECT source, dir, media_count" + last + ")"
    inst = "inst AS MATERIALIZED (SELECT i.*, coalesce(g.classification, 'curated') AS prov FROM inst0 i LEFT JOIN given g USING (source, dir))"
    ruled = _RULED.replace("source = 'LOCAL' AS cur", "prov = 'curated' AS cur")
    tail = " SELECT id, CASE WHEN cur THEN 'curated' ELSE 'takeout' END AS trust, rd AS resolved_date, rp AS resolved_precision, rs AS resolved_source, st AS status, rule FROM resolved"
    return "WITH RECURSIVE " + ", ".join((inst0, parts.strip(), given, inst, ruled)) + tail


SQL["provenance_dates"] = _provenance_dates()
SQL["ledger_by_layout"] = (
    _with()
    + """SELECT 'missing' AS disposition, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inst WHERE id % 17 = 3 HAVING count(*) > 0
UNION ALL SELECT CASE WHEN id % 31 = 7 THEN 'lost' WHEN kind IN ('image', 'video') THEN CASE WHEN id % 5 = 2 THEN 'quarantine' ELSE 'archive' END ELSE 'excluded' END AS disposition, count(*), CAST(sum(size_bytes) AS BIGINT)
FROM inst WHERE id % 17 <> 3 GROUP BY 1"""
)
SQL["normalised_export"] = f"""WITH found AS ({SQL["sidecar_match"]}), m AS (SELECT source, dir, {_NAME} AS name, recompressed FROM ({duckdb_select()}) i WHERE kind IN ('image', 'video')),
  s AS (SELECT split_part(dir, '|', 1) AS source, count(*) FILTER (WHERE method = 'exact') AS exact, count(*) FILTER (WHERE method = 'numbered') AS numbered, count(*) FILTER (WHERE method = 'truncation') AS truncation FROM found GROUP BY 1),
  n AS (SELECT source, count(*) AS media, count(*) FILTER (WHERE recompressed) AS recompressed, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.dir = m.source || '|' || m.dir AND f.media_name = m.name)) AS unmatched_media FROM m GROUP BY source)
SELECT source, media, exact, numbered, truncation, unmatched_media, recompressed, 0::BIGINT AS not_stored FROM n JOIN s USING (source)"""
