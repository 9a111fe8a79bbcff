"""Detector decoding and label arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtspark.functions.geometry import as_col

# Shot classes of the combined set, and how the two sources map onto them.
SHOT_CLASSES = ["Forehand", "Backhand", "Smash", "Serve", "Volley", "Lob", "Wall shot", "Other", "Dropshot"]
CATEGORY_TO_CLASS = {"Forehand": 0, "Backhand": 1, "Smash": 2, "Serve": 3, "Other": 7, "Dropshot": 8}
EXTERNAL_TO_CLASS = {0: 7, 2: 6, 3: 5, 4: 0, 5: 1, 6: 2, 7: 6, 8: 3, 9: 4, 10: 4}  # class 1 is dropped

# Display names and colours of the four player slots.
SLOTS = [(1, "Player 1", "#3fb950"), (2, "Player 2", "#a371f7"), (3, "Player 3", "#f778ba"), (4, "Player 4", "#79c0ff")]


def clamp01(c: Column, floor: float = 0.0) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), c))


def yolo_box(x, y, w, h, img_w, img_h, clamp: bool = True, floor: float = 0.0) -> list[Column]:
    """Absolute top-left box to normalised centre box ``cx, cy, w, h``."""
    x, y, w, h, img_w, img_h = map(as_col, (x, y, w, h, img_w, img_h))
    cx, cy, nw, nh = (x + w / 2) / img_w, (y + h / 2) / img_h, w / img_w, h / img_h
    if clamp:
        cx, cy, nw, nh = clamp01(cx), clamp01(cy), clamp01(nw, floor), clamp01(nh, floor)
    return [cx.alias("cx"), cy.alias("cy"), nw.alias("w"), nh.alias("h")]


def pixel_corners(cx, cy, w, h, img_w, img_h) -> list[Column]:
    """Normalised centre box to whole pixel corners, truncated toward zero."""
    cx, cy, w, h, img_w, img_h = map(as_col, (cx, cy, w, h, img_w, img_h))
    edges = {"x1": (cx - w / 2) * img_w, "y1": (cy - h / 2) * img_h, "x2": (cx + w / 2) * img_w, "y2": (cy + h / 2) * img_h}
    return [e.cast("int").alias(n) for n, e in edges.items()]


def decode_class(scores: Column, objectness) -> list[Column]:
    """Best class (first on ties) and its score times objectness."""
    best = F.array_max(scores)
    return [(F.array_position(scores, best) - 1).cast("int").alias("class_id"), (best * as_col(objectness)).alias("conf")]


def heatmap_peak(cells: Column, width: int, height: int, threshold: float = 0.1) -> Column:
    """Normalised position of the first maximum of a flattened map; null below the threshold."""
    peak = F.array_max(cells)
    at = F.array_position(cells, peak) - 1
    point = F.struct(
        ((at % width) / F.lit(float(width))).alias("x"), (F.floor(at / width) / F.lit(float(height))).alias("y"), F.bround(peak.cast("double"), 4).alias("conf")
    )
    return F.when(peak >= threshold, point)


def keypoint_triples(flat: Column, img_w, img_h, n: int = 17) -> Column:
    """Flat x,y,v array to normalised triples, a batch of rows at a time; null unless it has exactly 3n numbers."""

    def made(values, width, height):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = values.value_lengths().fill_null(0).to_numpy()
        fits, flat = size == 3 * n, values.flatten()
        first = (np.cumsum(size) - size)[fits][:, None] + np.arange(0, 3 * n, 3)
        row = pa.array(np.repeat(np.flatnonzero(fits), n))
        part = lambda k: flat.take(pa.array((first + k).ravel()))
        x, y = (pc.divide_checked(part(k), picture.take(row)) for k, picture in ((0, width), (1, height)))
        points = pa.StructArray.from_arrays([x, y, pc.trunc(part(2)).cast(pa.int32())], ["x", "y", "v"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(fits * n)), pa.int32()), points, mask=pa.array(~fits))

    triples = F.arrow_udf(made, "array<struct<x:double,y:double,v:int>>")
    return triples(flat.cast("array<double>"), as_col(img_w).cast("double"), as_col(img_h).cast("double"))


def fixed(c: Column, places: int) -> Column:
    """Fixed-point text of a double, rounded from its exact binary value with ties to even, as C and Python print it.

    Java rounds the shortest decimal form instead, which differs for values such as 0.5046875.
    ``hi + lo`` is the exact product of the value and ``10**places`` (Dekker's split), so the
    comparison with one half is exact.
    """
    unit = 10**places
    times = F.lit(float(unit))

    def whole(x: Column) -> Column:
        hi = x * times
        big = x * F.lit(134217729.0)
        head = big - (big - x)
        lo = (head * times - hi) + (x - head) * times
        # off a half, rounding the product is already right; the exact rest is looked at on a half only
        at_half = F.when(lo > 0, F.ceil(hi)).when(lo < 0, F.floor(hi)).otherwise(F.rint(hi).cast("bigint"))
        return F.when(hi - F.floor(hi) == 0.5, at_half).otherwise(F.rint(hi).cast("bigint"))

    def text(n: Column) -> Column:
        return F.concat(F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), places, "0"))

    # one-element arrays name intermediate values, so that each is computed once
    x = F.transform(F.array(F.abs(c.cast("double"))), whole)
    digits = F.element_at(F.transform(x, text), 1)
    return F.when(c < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def six(c: Column) -> Column:
    """Label text has six decimals."""
    return fixed(c, 6)


def pose_text():
    """Label text of a batch of boxes with keypoint triples; nulls are left out. Both ways round the exact binary value, as ``fixed`` does."""

    def made(head, cx, cy, w, h, points):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        box, flat, size = (cx, cy, w, h), points.flatten(), points.value_lengths()
        point = [pc.struct_field(flat, f) for f in "xyv"]
        n = size[0].as_py() if len(size) and not any(a.null_count for a in (head, *box, points, *point)) else 0
        if n and pc.all(pc.equal(size, n)).as_py():
            x, y, v = (p.to_numpy().reshape(-1, n) for p in point)
            numbers = np.hstack([*[b.to_numpy()[:, None] for b in box], np.stack([x, y], 2).reshape(-1, 2 * n)])
            if ((numbers >= 0) & (numbers < 9)).all() and ((v >= 0) & (v < 10)).all():
                # one digit before the point: all lines are of one length. The product is rounded as in ``fixed``
                hi, big = numbers * 1e6, numbers * 134217729.0
                part = big - (big - numbers)
                lo = (part * 1e6 - hi) + (numbers - part) * 1e6
                at_half = np.where(lo > 0, np.ceil(hi), np.where(lo < 0, np.floor(hi), np.rint(hi)))
                whole = np.where(hi - np.floor(hi) == 0.5, at_half, np.rint(hi)).astype("int64")
                three = np.array([f"{k:03d}".encode() for k in range(1000)], "S3").view("uint8").reshape(1000, 3)
                text = np.full((*whole.shape, 9), ord(" "), "uint8")
                text[:, :, 0], text[:, :, 1] = whole // 1_000_000 + ord("0"), ord(".")
                text[:, :, 2:5], text[:, :, 5:8] = three[whole // 1000 % 1000], three[whole % 1000]
                seen = np.stack([v + ord("0"), np.full_like(v, ord(" "))], 2).astype("uint8")
                triples = np.concatenate([text[:, 4:].reshape(-1, n, 18), seen], 2).reshape(-1, 20 * n)
                lines = np.hstack([text[:, :4].reshape(-1, 36), triples])[:, :-1]
                ends = np.arange(len(lines) + 1, dtype="int32") * lines.shape[1]
                rest = pa.StringArray.from_buffers(len(lines), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(lines)))
                return pc.binary_join_element_wise(head, rest, " ")

        def joined(values):  # adding zero turns a negative zero, which is not below zero, into a plain one
            return " ".join(v if isinstance(v, str) else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in values if v is not None)

        lines = []
        for *front, triples in zip(head.to_pylist(), *[c.to_pylist() for c in box], points.to_pylist(), strict=True):
            lines.append(joined([*front, triples if triples is None else " ".join(joined(k.values()) if k else "" for k in triples)]))
        return pa.array(lines, pa.string())

    return F.arrow_udf(made, "string")


def label_line(class_id, cx, cy, w, h, triples: Column | None = None) -> Column:
    """K5: ``class cx cy w h [x y v]*``."""
    head = as_col(class_id).cast("string")
    if triples is not None:
        return pose_text()(head, *[as_col(c).cast("double") for c in (cx, cy, w, h)], triples)
    return F.concat_ws(" ", head, *[six(as_col(c)) for c in (cx, cy, w, h)])


def map_class(c: Column, mapping: dict) -> Column:
    """Fixed class map; classes outside it become null, which callers drop."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def normal_score(score) -> Column:
    """Missing scores count as certain, others are clipped to [0, 1]."""
    return clamp01(F.coalesce(as_col(score), F.lit(1.0)))


def hex_channel(colour: Column, channel: str) -> Column:
    start = {"r": 2, "g": 4, "b": 6}[channel]
    return F.conv(F.substring(colour, start, 2), 16, 10).cast("int")


def slot_dimension(spark):
    """Four rows, slot to name and colours."""
    dim = spark.createDataFrame(SLOTS, "slot int, name string, colour string")
    c = F.col("colour")
    return dim.withColumn("bgr", F.array(hex_channel(c, "b"), hex_channel(c, "g"), hex_channel(c, "r")))
