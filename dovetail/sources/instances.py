"""The inventory that the registered queries run on: one row for each file, derived from the driver's star-schema tables.

The same SELECT, in two dialects, makes the inventory in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SELECT = """
SELECT id, source, kind, rel_path, dir, sha256, size_bytes, mime, width, height, phash, dhash, exif_dto, tags, camera_model,
       gps_lat, gps_lat * 2 AS gps_lon, CASE WHEN source = 'LOCAL' THEN 'curated' ELSE 'takeout' END AS trust,
       id % 11 = 0 AS archived, source <> 'LOCAL' AND id % 6 = 1 AS recompressed,
       CASE WHEN source <> 'LOCAL' AND id % 4 <> 0 THEN od || 'T12:00:00+00:00' END AS taken, id % 8 = 1 AS artifact,
       video_sig, content_id, od, ts, quality
FROM (
  SELECT *, dir || '/' || stem || '_x' || CAST(id AS STRING) || CASE kind WHEN 'video' THEN '.mp4' WHEN 'other' THEN '.txt' WHEN 'sidecar_json' THEN '.jpg.json'
           WHEN 'sidecar_xmp' THEN '.xmp' ELSE CASE WHEN id % 4 = 0 THEN '.DNG' ELSE '.jpg' END END AS rel_path,
         CASE kind WHEN 'video' THEN 'video/mp4' WHEN 'other' THEN 'text/plain' WHEN 'sidecar_json' THEN 'application/json' WHEN 'sidecar_xmp' THEN 'application/rdf+xml'
           ELSE CASE WHEN id % 4 = 0 THEN 'image/x-adobe-dng' WHEN id % 9 = 0 THEN 'image/png' ELSE 'image/jpeg' END END AS mime,
         CASE WHEN id % 10 = 0 THEN width ELSE width / 4 * 3 END AS height0,
         CAST(CASE WHEN id % 10 = 0 THEN width ELSE CASE width WHEN 4000 THEN 3000 WHEN 2000 THEN 1500 ELSE 750 END END AS INT) AS height,
         CASE WHEN kind = 'video' THEN CAST(10 + id % 3 AS STRING) || 's:1920x1080:' || substr({sha}('v' || CAST(block % 5 AS STRING){end}, 1, 15) || substr({sha}('w' || CAST(id AS STRING){end}, 1, 1)
           || ':' || substr({sha}('y' || CAST(block % 5 AS STRING){end}, 1, 16) || ':?' END AS video_sig,
         CASE WHEN id % 20 IN (0, 19) THEN 'c' || CAST(block AS STRING) END AS content_id
  FROM (
    SELECT d.doc_id AS id, CAST(floor(d.doc_id / 20.0) AS BIGINT) AS block, d.od, d.ts, d.quality,
           CASE WHEN CAST(substr(d.source, 4) AS INT) % 2 = 0 THEN 'LOCAL' ELSE 'TAKEOUT:t' END AS source,
           CASE d.doc_id % 20 WHEN 19 THEN 'video' WHEN 18 THEN 'other' WHEN 17 THEN 'sidecar_json' WHEN 16 THEN 'sidecar_xmp' ELSE 'image' END AS kind,
           CASE d.doc_id % 7 WHEN 0 THEN substr(d.od, 1, 4) WHEN 1 THEN substr(d.od, 1, 7) WHEN 2 THEN d.od || '_trip' WHEN 3 THEN 'topical/vac' || CAST(d.doc_id % 13 AS STRING)
             WHEN 4 THEN 'Photos from ' || substr(d.od, 1, 4) WHEN 5 THEN 'card_' || replace(d.od, '-', '') ELSE 'misc/' || substr(d.od, 1, 4) || '?' END AS dir,
           CASE d.doc_id % 5 WHEN 0 THEN 'IMG_' || replace(substr(d.ts, 1, 10), '-', '') || '_' || replace(substr(d.ts, 12, 8), ':', '') WHEN 1 THEN 'scan'
             WHEN 2 THEN d.od || ' pic' WHEN 3 THEN 'a_' || replace(substr(d.od, 1, 7), '-', '') || '_b' ELSE 'DSC' END AS stem,
           {content} AS sha256, d.n_chars AS size_bytes, d.n_chars % 61 AS tags,
           CAST(CASE d.doc_id % 3 WHEN 0 THEN 4000 WHEN 1 THEN 2000 ELSE 1000 END AS INT) AS width,
           substr({sha}(CAST(d.doc_id % 100 AS STRING){end}, 1, 12) || substr({sha}('m' || CAST(d.doc_id AS STRING){end}, 1, 4) AS phash,
           substr({sha}('d' || CAST(d.doc_id % 100 AS STRING){end}, 1, 13) || substr({sha}('n' || CAST(d.doc_id AS STRING){end}, 1, 3) AS dhash,
           CASE WHEN d.doc_id % 3 <> 0 THEN d.ts END AS exif_dto, CASE WHEN d.doc_id % 2 = 0 THEN 'Pixel' ELSE 'Canon' END AS camera_model,
           CASE WHEN d.doc_id % 4 = 1 THEN CAST(d.doc_id % 90 AS DOUBLE) + 0.5 END AS gps_lat
    FROM {joined} d
  ) b
) c
"""
_JOINED = """(SELECT t.doc_id, t.text, t.source, t.n_chars, coalesce(o.od, '2001-02-03') AS od, coalesce(e.ts, '2001-02-03T04:05:06') AS ts, l.quality
      FROM documents t LEFT JOIN (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS od FROM orders) o ON o.o_orderkey = t.doc_id
        LEFT JOIN (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events) e ON e.event_id = t.doc_id LEFT JOIN labels l ON l.doc_id = t.doc_id)"""


def duckdb_select() -> str:
    return _SELECT.format(sha="sha256", end=")", content="sha256(d.text)", joined=_JOINED)


def _joined(spark: SparkSession, sf_dir: str, hashed: bool) -> DataFrame:
    """The join within the SELECT. Texts are hashed before it, so they do not travel; days and times are
    written out after it, for the documents only. ``hashed``: each join hashes the documents, and the longer
    tables are read past them, neither sorted nor held; many such inventories in one stage do not fit a task."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = table("documents").select("doc_id", F.sha2("text", 256).alias("content"), "source", "n_chars")
    days = table("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("od"))
    times = table("events").select(F.col("event_id").alias("doc_id"), "ts")
    for other in (days, times, table("labels").select("doc_id", "quality")):
        rows = (rows.hint("shuffle_hash") if hashed else rows).join(other, "doc_id", "left")
    day, time = F.date_format("od", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumns({"od": F.coalesce(day, F.lit("2001-02-03")), "ts": F.coalesce(time, F.lit("2001-02-03T04:05:06"))})


def instances(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    """The inventory: id, source, kind, rel_path, hashes, sizes, metadata and trust of every file."""
    return spark.sql(_SELECT.format(sha="sha2", end=", 256)", content="d.content", joined="{joined}"), joined=_joined(spark, sf_dir, hashed))
