"""Queries on accelerometer calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import calibration
from .registry import Tables, query

TODO = """todo AS (SELECT tag_id, cal_start_local, cal_end_local, utc_offset,
    cal_start_local - utc_offset * INTERVAL 1 HOUR AS start_utc,
    cal_end_local - utc_offset * INTERVAL 1 HOUR AS end_utc
  FROM {calib_index} WHERE calprocessed_yn = 'n')"""
ROWS = (
    TODO
    + """,
calrows AS (SELECT r.foid, r.tag_id, t.start_utc, r.datetime, r.acc_x, r.acc_y, r.acc_z,
    sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) AS vectoral_sum
  FROM {tag_records} r JOIN todo t ON t.tag_id = r.tag_id
    AND r.datetime > t.start_utc - INTERVAL 860000 SECOND
    AND r.datetime < t.end_utc + INTERVAL 36000 SECOND)"""
)
USABLE = (
    ROWS
    + """,
gate AS (SELECT tag_id, start_utc, count(*) FILTER (WHERE vectoral_sum > 0.8e0) AS n_rows,
    count(*) FILTER (WHERE vectoral_sum > 0.8e0) >= 10 AS enough FROM calrows GROUP BY tag_id, start_utc),
usable AS (SELECT c.*, row_number() OVER (PARTITION BY c.tag_id, c.start_utc ORDER BY datetime, foid) AS row_no
  FROM calrows c JOIN gate g ON g.tag_id = c.tag_id AND g.start_utc = c.start_utc AND g.enough WHERE c.vectoral_sum > 0.8e0)"""
)
LABELLED = (
    USABLE
    + """,
labelled AS (SELECT u.*, u.row_no - k.beg_pt + 1 AS x, s.seg AS calib_seg
  FROM usable u JOIN {calib_chunks} k ON k.tag_id = u.tag_id AND k.start_utc = u.start_utc
    AND abs(k.end_pt - k.beg_pt) < 300 AND u.row_no BETWEEN k.beg_pt AND k.end_pt
  LEFT JOIN {calib_segments} s ON s.tag_id = u.tag_id AND s.start_utc = u.start_utc
    AND u.row_no - k.beg_pt + 1 BETWEEN s.beg AND s.fin)"""
)


def _todo(t: Tables) -> DataFrame:
    return calibration.open_calibrations(t.calib_index)


def _rows(t: Tables) -> DataFrame:
    records = t.tag_records.select("foid", "tag_id", "datetime", "acc_x", "acc_y", "acc_z")
    return calibration.calibration_rows(records, _todo(t))


def _labelled(t: Tables) -> DataFrame:
    usable = calibration.passing_rows(_rows(t))
    return calibration.label_segments(
        usable, t.calib_chunks, t.calib_segments, slice_s=t.slice_s
    )


@query("calib_index", "WITH " + TODO + "\nSELECT * FROM todo")
def calib_index(t: Tables) -> DataFrame:
    return _todo(t)


@query(
    "calib_file_match",
    "WITH "
    + TODO
    + """,
days AS (SELECT tag_id, start_utc, unnest([0, 1]) AS day_offset FROM todo),
tokens AS (SELECT tag_id, start_utc, day_offset, CAST(tag_id AS string) || '_GPRS_' ||
    strftime(CAST(start_utc AS date) + day_offset, '%Y%m%d') AS token FROM days),
found AS (SELECT k.tag_id, k.start_utc, k.token, k.day_offset, f.file_name
  FROM tokens k JOIN {files} f ON starts_with(f.file_name, k.token))
SELECT * FROM found
UNION ALL SELECT tag_id, start_utc, token, day_offset, NULL FROM tokens k
WHERE day_offset = 0 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.tag_id = k.tag_id AND f.start_utc = k.start_utc)""",
)
def calib_file_match(t: Tables) -> DataFrame:
    return calibration.match_files(_todo(t), t.files)


@query("calib_window_join", "WITH " + ROWS + "\nSELECT * FROM calrows")
def calib_window_join(t: Tables) -> DataFrame:
    return _rows(t)


@query("calib_gate", "WITH " + USABLE + "\nSELECT * FROM gate")
def calib_gate(t: Tables) -> DataFrame:
    return calibration.calibration_gate(_rows(t))


@query("calib_segment_label", "WITH " + LABELLED + "\nSELECT * FROM labelled")
def calib_segment_label(t: Tables) -> DataFrame:
    return _labelled(t)


@query(
    "calib_long_chunks",
    "SELECT tag_id, start_utc, beg_pt, end_pt FROM {calib_chunks} WHERE abs(end_pt - beg_pt) >= 300",
)
def calib_long_chunks(t: Tables) -> DataFrame:
    return calibration.long_chunks(t.calib_chunks)


@query(
    "calib_corrections",
    "WITH "
    + LABELLED
    + """
SELECT tag_id, start_utc, calib_seg, regexp_replace(calib_seg, '[12]', '') AS axis,
  regexp_replace(calib_seg, '[XYZ]', '') AS seg, count(*) AS n_values,
  round(avg(vectoral_sum), 6) AS u_vec_sum, min(acc_x) AS min, max(acc_x) AS max,
  min(CASE calib_seg[1] WHEN 'X' THEN acc_x WHEN 'Y' THEN acc_y ELSE acc_z END) AS axis_min,
  max(CASE calib_seg[1] WHEN 'X' THEN acc_x WHEN 'Y' THEN acc_y ELSE acc_z END) AS axis_max
FROM labelled WHERE calib_seg IS NOT NULL GROUP BY tag_id, start_utc, calib_seg""",
)
def calib_corrections(t: Tables) -> DataFrame:
    return calibration.corrections(_labelled(t))
