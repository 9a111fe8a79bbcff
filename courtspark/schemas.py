"""Schemas of the records read and written. Nothing is inferred."""

from __future__ import annotations

FRAME_RECORD = (
    "match_id BIGINT, frame BIGINT, t_sec DOUBLE, ball_x DOUBLE, ball_y DOUBLE, "
    "players ARRAY<STRUCT<slot: INT, raw_id: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE, court_x: DOUBLE, court_y: DOUBLE, outside_court: BOOLEAN>>, "
    "shots ARRAY<STRUCT<slot: INT, shot_type: STRING>>, actions ARRAY<STRING>"
)
RESULT_LINE = (
    "frame BIGINT, players ARRAY<STRUCT<slot: INT, box: ARRAY<DOUBLE>, court_xy: ARRAY<DOUBLE>>>, shots ARRAY<STRUCT<slot: INT, type: STRING>>, n INT, _corrupt STRING"
)
ANALYSIS_DOCUMENT = (
    "video STRING, duration_s DOUBLE, fps DOUBLE, frames_analyzed BIGINT, stride INT, "
    "results ARRAY<STRUCT<frame: BIGINT, timestamp_s: DOUBLE, detections: MAP<STRING, ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, confidence: DOUBLE, class_id: INT, x: DOUBLE, y: DOUBLE, conf: DOUBLE, idx: INT>>>, "
    "stats: MAP<STRING, STRUCT<count: BIGINT, avg_conf: DOUBLE>>>>"
)
MATCH_REPORT = (
    "meta STRUCT<match_id: STRING, source: STRING, source_id: STRING, generated_at: STRING, duration_frames: BIGINT, duration_sec: DOUBLE, fps: DOUBLE, model: STRING>, "
    "score ARRAY<BIGINT>, rallies BIGINT, total_shots BIGINT, "
    "per_player ARRAY<STRUCT<slot: INT, name: STRING, team: INT, active: BOOLEAN, time_on_court: DOUBLE, distance_m: DOUBLE, shots: BIGINT, shots_by_type: MAP<STRING, BIGINT>>>, "
    "per_team MAP<STRING, STRUCT<players: BIGINT, shots: BIGINT, points: BIGINT>>, shot_log ARRAY<STRUCT<slot: INT, team: INT, type: STRING, frame: BIGINT>>, _corrupt STRING"
)
CALIBRATION = "source_id STRING, image_corners ARRAY<ARRAY<DOUBLE>>, frame_width INT, frame_height INT"
REID_MAPPING = "mapping MAP<STRING, INT>, canonical_order ARRAY<STRUCT<canonical_id: INT, raw_ids: ARRAY<BIGINT>>>, config MAP<STRING, STRING>"
COCO = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>>, "
    "annotations ARRAY<STRUCT<image_id: BIGINT, category_id: INT, bbox: ARRAY<DOUBLE>, keypoints: ARRAY<DOUBLE>>>, categories ARRAY<STRUCT<id: INT, name: STRING>>"
)
