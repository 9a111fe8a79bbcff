"""Training-set preparation (B1-B9 and their parts).

Label files become tables of label rows: (split, image name, line). Images are named, not copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.blocks import DEFAULT_SPAN, Lane, LastSeen, Prev, RowNumber, scan
from courtspark.functions import geometry as G
from courtspark.functions import labels as L
from courtspark.functions import text as X
from courtspark.operators.detections import temporal_split
from courtspark.operators.matching import best_by

N_LANDMARKS = 26

# Limbs of the 17-point body, as pairs of keypoint numbers.
SKELETON = [
    (0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16),
]


def image_name(prefix, frame_no) -> Column:
    return F.concat(G.as_col(prefix), F.lit("_frame_"), F.format_string("%06d", G.as_col(frame_no)))


def join_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations with their image; images without annotations drop out."""
    return images.withColumn("frame_no", X.frame_index("file_name", "image_id")).join(annotations, "image_id")


def video_split(images: DataFrame, fraction: float = 0.85, span: int = DEFAULT_SPAN) -> DataFrame:
    """T9 over all images of each video in frame order."""
    named = images.withColumn("frame_no", X.frame_index("file_name", "image_id"))
    return temporal_split(named, Lane(("video",), "frame_no", (), span), fraction)


def player_boxes(images: DataFrame, annotations: DataFrame, match_split: DataFrame, stride: int = 6, span: int = DEFAULT_SPAN) -> DataFrame:
    """B1: every ``stride``-th annotated frame of each match; the whole match goes to one split."""
    named = images.withColumn("frame_no", X.frame_index("file_name", "image_id"))
    annotated = named.join(annotations.select("image_id").distinct(), "image_id", "left_semi")
    picked = scan(annotated, Lane(("video",), "frame_no", (), span), _i=RowNumber()).filter((F.col("_i") - 1) % stride == 0)
    rows = picked.select("image_id", "video", "frame_no", "width", "height").join(annotations.select("image_id", "bbox"), "image_id")
    b = F.col("bbox")
    rows = rows.join(match_split, "video").select("split", "video", "frame_no", *L.yolo_box(b[0], b[1], b[2], b[3], "width", "height"))
    kept = rows.filter("w > 0.002 AND h > 0.002")
    name = F.concat("video", F.lit("_f"), F.format_string("%06d", "frame_no"))
    return kept.select("split", name.alias("image"), L.label_line(F.lit(0), "cx", "cy", "w", "h").alias("line"))


def pose_labels(images: DataFrame, annotations: DataFrame, fraction: float = 0.85) -> DataFrame:
    """B2: boxes with 17 keypoints; annotations with another number of values drop out.

    Annotations are shuffled once, to their images, which also spreads the text work. They are many times the size of the
    images, so these are the side that is hashed: annotations are not sorted for the join. Keypoints that are whole
    numbers, as pixels mostly are, travel as short ones, others as they are.
    """
    found = annotations.select("image_id", "bbox", F.col("keypoints").cast("array<double>").alias("keypoints")).filter(F.size("keypoints") == 51)
    short = F.col("keypoints").try_cast("array<smallint>")
    whole = short.cast("array<double>") == F.col("keypoints")
    found = found.select("image_id", "bbox", F.when(whole, short).alias("_short"), F.when(~whole, F.col("keypoints")).alias("_long"))
    named = video_split(images.select("image_id", "video", "file_name", "width", "height"), fraction)
    rows = named.hint("shuffle_hash").join(found, "image_id")
    b = F.col("bbox")
    keypoints = F.coalesce(F.col("_short").cast("array<double>"), F.col("_long"))
    rows = rows.withColumn("_t", L.keypoint_triples(keypoints, "width", "height"))
    rows = rows.select("split", "video", "frame_no", "_t", *L.yolo_box(b[0], b[1], b[2], b[3], "width", "height", clamp=False))
    return rows.select("split", image_name("video", "frame_no").alias("image"), L.label_line(F.lit(0), "cx", "cy", "w", "h", F.col("_t")).alias("line"))


def parse_labels(lines: DataFrame, min_fields: int = 5) -> DataFrame:
    """Label text to numbers; lines with fewer fields drop out."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.withColumn("_p", parts).filter(F.size("_p") >= min_fields).withColumn("fields", F.col("_p").cast("array<double>")).drop("_p")


def external_labels(lines: DataFrame, splits: dict[str, str], mapping: dict[int, int] | None = None, prefix: str = "rf_") -> DataFrame:
    """Labels of an outside set with renamed splits and remapped classes (class 0 for all when there is no map)."""
    parsed = parse_labels(lines)
    old = F.element_at("fields", 1).cast("int")
    new = F.lit(0) if mapping is None else L.map_class(old, mapping)
    split = L.map_class(F.col("split"), splits)
    rest = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\S+\s+", ""), r"\s+", " ")
    out = parsed.select(split.alias("split"), F.concat(F.lit(prefix), F.col("stem")).alias("image"), F.concat_ws(" ", new.cast("string"), rest).alias("line"), new.alias("_c"))
    return out.filter("_c IS NOT NULL AND split IS NOT NULL").drop("_c")


def ball_labels(images: DataFrame, annotations: DataFrame, outside: DataFrame, ball_category: int = 1, stride: int = 5, fraction: float = 0.85) -> DataFrame:
    """Frames whose number the stride divides and that show a ball; the split counts all frames."""
    rows = video_split(images, fraction).filter(F.col("frame_no") % stride == 0)
    balls = annotations.filter(F.col("category_id") == ball_category).select("image_id", "bbox")
    b = F.col("bbox")
    rows = rows.join(balls, "image_id").select("split", "video", "frame_no", *L.yolo_box(b[0], b[1], b[2], b[3], "width", "height", clamp=False))
    own = rows.select("split", image_name("video", "frame_no").alias("image"), L.label_line(F.lit(0), "cx", "cy", "w", "h").alias("line"))
    return own.unionByName(external_labels(outside, {"train": "train", "valid": "val", "test": "train"}))


def complete_frames(points: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Frames 0..max of each video, with visibility 0 where no ball was annotated.

    The axis is generated block by block, so no row ever holds a whole video's frames.
    ``points``: video, frame_no, x, y, one row per frame.
    """
    top = points.groupBy("video").agg(F.max("frame_no").alias("top"))
    blocks = top.select("video", "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("top") / span))).alias("_b"))
    axis = blocks.select("video", F.explode(F.sequence(F.col("_b") * span, F.least(F.col("_b") * span + span - 1, F.col("top")))).alias("frame_no"))
    full = axis.join(points, ["video", "frame_no"], "left")
    return full.select("video", "frame_no", F.col("x").isNotNull().cast("int").alias("visible"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def rally_chunks(frames: DataFrame, length: int = 256, val_fraction: float = 0.15, min_ratio: float = 0.05, min_length: int = 8) -> DataFrame:
    """Chunks of consecutive frames that show the ball often enough; the last ones are for validation."""
    rows = frames.withColumn("chunk", F.floor(F.col("frame_no") / length))
    top = frames.groupBy("video").agg((F.floor(F.max("frame_no") / length) + 1).alias("n_chunks"))
    stats = rows.groupBy("video", "chunk").agg(F.count("*").alias("frames"), F.sum("visible").alias("visible"))
    n_val = F.greatest(F.lit(1), F.bround(F.col("n_chunks") * val_fraction, 0))
    kept = stats.filter((F.col("frames") >= min_length) & (F.col("visible") / F.col("frames") >= min_ratio)).join(top, "video")
    return kept.select("video", "chunk", "frames", "visible", F.when(F.col("chunk") >= F.col("n_chunks") - n_val, "val").otherwise("train").alias("split"))


def trajectory_rows(points: DataFrame, length: int = 256, **chunk_args) -> DataFrame:
    """Trajectory label rows of every kept chunk."""
    frames = complete_frames(points)
    chunks = rally_chunks(frames, length, **chunk_args)
    rows = frames.withColumn("chunk", F.floor(F.col("frame_no") / length)).join(chunks.select("video", "chunk", "split"), ["video", "chunk"])
    two = lambda c: F.when(F.col("visible") == 1, L.fixed(F.col(c), 2)).otherwise("0")
    return rows.select(
        "split", F.concat("video", F.lit("_r"), F.format_string("%04d", "chunk")).alias("rally_id"),
        (F.col("frame_no") - F.col("chunk") * length).cast("int").alias("Frame"), F.col("visible").alias("Visibility"), two("x").alias("X"), two("y").alias("Y"),
    )


def sliding_windows(rows: DataFrame, key: str, index: str, length: int = 8, step: int = 1) -> DataFrame:
    """Full windows of ``length`` rows, ``step`` apart. A row lists the windows it is in by arithmetic, so nothing is joined by range."""
    sizes = rows.groupBy(key).agg((F.max(index) + 1).alias("_n"))
    i = F.col(index)
    low = F.greatest(F.ceil((i - length + 1) / step), F.lit(0))
    high = F.least(F.floor(i / step), F.floor((F.col("_n") - length) / step))
    j = rows.join(sizes, key).filter(F.col("_n") >= length).withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    j = j.select(*rows.columns, F.explode(F.sequence("_low", "_high")).alias("_w"))
    start = F.col("_w") * step
    return j.select(*rows.columns, start.alias("window_start"), (i - start).alias("window_pos"))


def shot_rows(csv: DataFrame) -> DataFrame:
    """Labelled shot frames."""
    return csv.filter("has_shot = '1'").select("video", X.frame_index("file_name").alias("frame_no"), "category")


def shot_sequences(shots: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Runs of consecutive frames of one category; ``seq_start`` names the run, ``seq_pos`` counts from 0."""
    lane = Lane(("video",), "frame_no", (), span)
    s = scan(shots, lane, _p=Prev(F.struct("frame_no", "category")))
    joined = (F.col("frame_no") == F.col("_p.frame_no") + 1) & (F.col("category") == F.col("_p.category"))
    s = s.withColumn("_first", F.when(~F.coalesce(joined, F.lit(False)), F.col("frame_no")))
    s = scan(s, lane, seq_start=LastSeen(F.col("_first")))
    return s.select("video", "frame_no", "category", "seq_start", (F.col("frame_no") - F.col("seq_start")).alias("seq_pos"))


def subsample(sequences: DataFrame, step: int = 3, keep_all: tuple[str, ...] = ("Dropshot",)) -> DataFrame:
    """Every ``step``-th frame of a run; rare categories whole."""
    return sequences.filter(F.col("category").isin(*keep_all) | (F.col("seq_pos") % step == 0))


def hitters(annotations: DataFrame, keys: list[str], position: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Who swings. Highest wrist above the shoulder, if by more than 5 px; otherwise the person seen best.

    Each annotation is scored from its own keypoints, then two map-side combined arg-max
    aggregates pick per frame; earlier annotations (by ``position``) win ties.
    With ``frames`` (image_id and ``keys``), only their annotations count; the scores are joined to them, not the keypoints.
    """
    a = annotations.filter(F.size("keypoints") >= 51)
    # one by one, not by a lambda, which Spark doesn't compile
    point = lambda i, part: F.get("keypoints", F.lit(i * 3 + part))
    best_y = lambda ids: F.least(*[F.when(point(i, 2) >= 2, point(i, 1)) for i in ids])
    visible = sum((F.when(point(i, 2) >= 2, 1).otherwise(0) for i in range(1, 17)), F.when(point(0, 2) >= 2, 1).otherwise(0))
    a = a.withColumn("_swing", best_y((5, 6)) - best_y((9, 10))).withColumn("_vis", visible)
    first = [-F.col(p) for p in position]
    row = F.struct("bbox", *position)
    if frames is not None:
        a = frames.join(a.select("image_id", "bbox", *position, "_swing", "_vis"), "image_id")  # J2
    best = a.groupBy(*keys).agg(
        F.max_by(row, F.when(F.col("_swing").isNotNull(), F.struct("_swing", *first))).alias("_s"), F.max("_swing").alias("swing"),
        F.max_by(row, F.struct("_vis", *first)).alias("_f"),
    )
    pick = F.when(F.col("swing") > 5, F.col("_s")).otherwise(F.col("_f"))
    return best.select(*keys, "swing", pick.alias("_r")).select(*keys, "swing", "_r.*")


def shot_labels(csv: DataFrame, images: DataFrame, annotations: DataFrame, outside: DataFrame, position: list[str], fraction: float = 0.85) -> DataFrame:
    """Shot frames, thinned, labelled with the hitter's box, split in time, merged with the outside set."""
    picks = subsample(shot_sequences(shot_rows(csv)))
    picks = picks.withColumn("class_id", L.map_class(F.col("category"), L.CATEGORY_TO_CLASS)).filter("class_id IS NOT NULL")
    wanted = images.withColumn("frame_no", X.frame_index("file_name", "image_id")).select("image_id", "video", "frame_no").join(picks.select("video", "frame_no", "class_id"), ["video", "frame_no"])
    found = hitters(annotations, ["video", "frame_no", "class_id"], position, wanted)
    b = F.col("bbox")
    boxed = found.select("video", "frame_no", "class_id", *L.yolo_box(b[0], b[1], b[2], b[3], 1920, 1080))
    floor = lambda c: F.greatest(F.lit(0.001), F.col(c)).alias(c)
    boxed = boxed.select("video", "frame_no", "class_id", "cx", "cy", floor("w"), floor("h"))
    split = temporal_split(boxed, Lane(("video",), "frame_no"), fraction)
    own = split.select("split", image_name("video", "frame_no").alias("image"), L.label_line("class_id", "cx", "cy", "w", "h").alias("line"))
    return own.unionByName(external_labels(outside, {"train": "train", "valid": "val"}, L.EXTERNAL_TO_CLASS))


def landmarks(lines: DataFrame) -> DataFrame:
    """Landmark lines to one box and a 26-slot keypoint array per image; missing slots are zero, the last line wins."""
    p = parse_labels(lines, 8)
    f = lambda i: F.element_at("fields", i)
    p = p.select("split", "stem", "line_no", f(1).cast("int").alias("kpt"), f(2).alias("cx"), f(3).alias("cy"), f(4).alias("w"), f(5).alias("h"),
                 F.struct(f(6).alias("x"), f(7).alias("y"), f(8).cast("int").alias("v")).alias("point")).filter(F.col("kpt").between(0, N_LANDMARKS - 1))
    edge = [F.min(F.col("cx") - F.col("w") / 2).alias("l"), F.max(F.col("cx") + F.col("w") / 2).alias("r"), F.min(F.col("cy") - F.col("h") / 2).alias("t"), F.max(F.col("cy") + F.col("h") / 2).alias("b")]
    per = p.groupBy("split", "stem", "kpt").agg(F.max_by("point", "line_no").alias("point"), *edge)
    per = per.groupBy("split", "stem").agg(
        F.map_from_entries(F.collect_list(F.struct("kpt", "point"))).alias("points"), F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b")
    )
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("v"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(N_LANDMARKS - 1)), lambda i: F.coalesce(F.try_element_at("points", i), none))
    l, r, t, b = (F.col(c) for c in "lrtb")
    return per.select("split", "stem", ((l + r) / 2).alias("cx"), ((t + b) / 2).alias("cy"), (r - l).alias("w"), (b - t).alias("h"), slots.alias("keypoints"))


def court_labels(lines: DataFrame) -> DataFrame:
    """B6."""
    rows = landmarks(lines).withColumn("split", L.map_class(F.col("split"), {"train": "train", "valid": "val", "test": "val"})).filter("split IS NOT NULL")
    return rows.select("split", F.col("stem").alias("image"), L.label_line(F.lit(0), "cx", "cy", "w", "h", F.col("keypoints")).alias("line"))


def pseudo_labels(predictions: DataFrame, base: DataFrame, ties: list[str], min_conf: float = 0.5, fraction: float = 0.9) -> DataFrame:
    """The best sure prediction per image, split 90/10 in image order, merged with the first labels.

    ``predictions``: video, frame_no, conf, cx, cy, w, h and tie columns.
    """
    best = best_by(predictions, ["video", "frame_no"], "conf", ties, min_conf)
    split = temporal_split(best, Lane(("video",), "frame_no"), fraction)
    new = split.select("split", F.concat(F.lit("pseudo_"), image_name("video", "frame_no")).alias("image"), L.label_line(F.lit(0), "cx", "cy", "w", "h").alias("line"))
    old = base.select("split", F.concat(F.lit("v1_"), F.col("image")).alias("image"), "line")
    return new.unionByName(old)


def combined_set(sources: list[tuple[str, DataFrame, DataFrame]], splits: dict[str, str]) -> DataFrame:
    """Image lists of several sources under prefixed names with their labels, if any (J12, left by split and stem)."""
    parts = []
    for prefix, images, labels in sources:
        j = images.join(labels.select("split", "stem", "line"), ["split", "stem"], "left")
        parts.append(j.select(L.map_class(F.col("split"), splits).alias("split"), F.concat(F.lit(prefix), F.lit("_"), F.col("stem")).alias("image"), "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("split IS NOT NULL")


def labelled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images that have a label file."""
    return images.join(labels.select("split", "stem"), ["split", "stem"], "left_semi")


def class_counts(labels: DataFrame) -> DataFrame:
    """Labels per class and split, with totals (null class or split)."""
    cls = F.split("line", " ")[0].cast("int").alias("class_id")
    return labels.select("split", cls).rollup("split", "class_id").agg(F.count("*").alias("labels"))


def seen_limbs():
    """Limbs in whole pixels, truncated toward zero, for a batch of keypoint triples and picture sizes."""
    ends = list(zip(*SKELETON, strict=True))

    def made(points, width, height):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = points.value_lengths().fill_null(0).to_numpy()
        known = points.is_valid().to_numpy(zero_copy_only=False)
        if (size[known] <= max(map(max, ends))).any():
            raise ValueError("too few keypoints")
        rows, flat = np.flatnonzero(known), points.flatten()
        start = (np.cumsum(size) - size)[rows]
        a, b = (start[:, None] + np.array(e) for e in ends)
        visible = pc.struct_field(flat, "v").fill_null(0).to_numpy() > 0
        row, limb = np.nonzero(visible[a] & visible[b])

        def pixels(axis, end, picture):
            at, of = pa.array(end[row, limb]), pa.array(rows[row])
            return pc.trunc(pc.multiply(pc.struct_field(flat, axis).take(at), picture.take(of))).cast(pa.int32())

        sides = [pixels("x", a, width), pixels("y", a, height), pixels("x", b, width), pixels("y", b, height)]
        n = np.bincount(rows[row], minlength=len(points))
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype("int32"), pa.StructArray.from_arrays(sides, ["x1", "y1", "x2", "y2"]))

    return F.arrow_udf(made, "array<struct<x1:int,y1:int,x2:int,y2:int>>")


def sample_geometry(rows: DataFrame, img_w, img_h) -> DataFrame:
    """Pixel box of a label, and the limbs whose two ends are visible. Needs cx, cy, w, h and keypoint triples ``kp``."""
    limbs = seen_limbs()("kp", *[G.as_col(c).cast("double") for c in (img_w, img_h)])
    keep = [c for c in rows.columns if c not in ("cx", "cy", "w", "h", "kp")]
    return rows.select(*keep, *L.pixel_corners("cx", "cy", "w", "h", img_w, img_h), limbs.alias("limbs"))
