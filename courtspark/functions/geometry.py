"""Court geometry as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Court dimensions in metres.
COURT_LENGTH = 20.0
COURT_WIDTH = 10.0
SERVICE_LINE = 6.95
SERVICE_LINE_FAR = 13.05
NET_Y = 10.0


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def project_x(h: Column, x: Column, y: Column) -> Column:
    """Court X of an image point under a row-major 3x3 homography; null when h is null or the point is at infinity."""
    return _project(h, 0, x, y)


def project_y(h: Column, x: Column, y: Column) -> Column:
    return _project(h, 3, x, y)


def _project(h: Column, row: int, x: Column, y: Column) -> Column:
    scale = h[6] * x + h[7] * y + h[8]
    return F.when(scale != 0, (h[row] * x + h[row + 1] * y + h[row + 2]) / scale)


def feet_x(x1, x2) -> Column:
    """The point where a player touches the ground is the middle of the box's bottom edge."""
    return (as_col(x1) + as_col(x2)) / 2


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, clamp: bool = False) -> Column:
    """Box overlap; 0 when disjoint. ``clamp`` treats inverted boxes as empty."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = map(as_col, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    w = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    h = F.least(ay2, by2) - F.greatest(ay1, by1)
    zero = F.lit(0.0)
    if clamp:
        area_a = F.greatest(ax2 - ax1, zero) * F.greatest(ay2 - ay1, zero)
        area_b = F.greatest(bx2 - bx1, zero) * F.greatest(by2 - by1, zero)
    else:
        area_a = (ax2 - ax1) * (ay2 - ay1)
        area_b = (bx2 - bx1) * (by2 - by1)
    inter = w * h
    union = area_a + area_b - inter
    return F.when((w > 0) & (h > 0) & (union > 0), inter / union).otherwise(zero)


def in_play(x, y, tolerance: float = 0.5) -> Column:
    """Inside the court, with a grace margin; unknown positions are not in play."""
    x, y = as_col(x), as_col(y)
    inside = x.between(-tolerance, COURT_WIDTH + tolerance) & y.between(-tolerance, COURT_LENGTH + tolerance)
    return F.coalesce(inside, F.lit(False))


def is_out(x, y, tolerance: float = 0.5) -> Column:
    """P5."""
    return ~in_play(x, y, tolerance)


def court_half(x, y) -> Column:
    """0 near, 1 far (the net line counts as far); null when unknown."""
    x, y = as_col(x), as_col(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(y < NET_Y, 0).otherwise(1))


def in_service_box(y, half) -> Column:
    """Between the net and the service line of the given half; x is not looked at."""
    y, half = as_col(y), as_col(half)
    near = y.between(SERVICE_LINE, NET_Y)
    far = y.between(NET_Y, SERVICE_LINE_FAR)
    return F.coalesce(F.when(half == 0, near).otherwise(far), F.lit(False))


def near_net(y, threshold: float = 1.0) -> Column:
    """P8."""
    return F.coalesce(F.abs(as_col(y) - NET_Y) <= threshold, F.lit(False))


def valid_position(x, y) -> Column:
    """Finite and at most one metre off the court; the only points a heat grid uses."""
    x, y = as_col(x), as_col(y)
    finite = ~F.isnan(x) & ~F.isnan(y)
    return F.coalesce(finite & x.between(-1.0, COURT_WIDTH + 1) & y.between(-1.0, COURT_LENGTH + 1), F.lit(False))


def good_height(y1, y2, low: float = 40.0, high: float = 300.0) -> Column:
    """P10."""
    return (as_col(y2) - as_col(y1)).between(low, high)


def inside_polygon(x, y, polygon: Column) -> Column:
    """Point in a convex polygon given as an array of ``{x, y}``; an edge counts as inside, no polygon lets all pass."""
    x, y = as_col(x), as_col(y)
    n = F.size(polygon)
    sides = F.transform(
        polygon,
        lambda p, i: (
            (F.element_at(polygon, ((i + 1) % n) + 1)["x"] - p["x"]) * (y - p["y"])
            - (F.element_at(polygon, ((i + 1) % n) + 1)["y"] - p["y"]) * (x - p["x"])
        ),
    )
    one_side = F.forall(sides, lambda s: s >= 0) | F.forall(sides, lambda s: s <= 0)
    return F.when(polygon.isNull() | (n == 0), F.lit(True)).otherwise(one_side)


def in_hitting_zone(bx, by, x1, y1, x2, y2, margin: float = 60.0, top_extra: float = 40.0) -> Column:
    bx, by = as_col(bx), as_col(by)
    return bx.between(as_col(x1) - margin, as_col(x2) + margin) & by.between(as_col(y1) - margin - top_extra, as_col(y2) + margin)


def is_contact(bx, by, x1, y1, x2, y2, keypoints: Column | None = None, wrist_px: float = 80.0, min_vis: float = 0.3, margin: float = 60.0, top_extra: float = 40.0) -> Column:
    """The ball is near a visible wrist; the box rule decides only when no wrist is visible."""
    bx, by = as_col(bx), as_col(by)
    box = in_hitting_zone(bx, by, x1, y1, x2, y2, margin, top_extra)
    if keypoints is not None:
        wrists = F.filter(F.slice(keypoints, 10, 2), lambda k: k["v"] >= min_vis)
        gaps = F.transform(wrists, lambda k: F.sqrt((k["x"] - bx) * (k["x"] - bx) + (k["y"] - by) * (k["y"] - by)))
        usable = F.coalesce(F.size(keypoints) > 10, F.lit(False)) & (F.size(wrists) > 0)
        box = F.when(usable, F.array_min(gaps) <= wrist_px).otherwise(box)
    return F.coalesce(box, F.lit(False))


def undo_letterbox(v, pad, ratio) -> Column:
    """Model pixel to source pixel."""
    return (as_col(v) - as_col(pad)) / as_col(ratio)


def undo_letterbox_keypoints(keypoints: Column, pad_x, pad_y, ratio) -> Column:
    return F.transform(
        keypoints,
        lambda k: F.struct(undo_letterbox(k["x"], pad_x, ratio).alias("x"), undo_letterbox(k["y"], pad_y, ratio).alias("y"), k["v"].alias("v")),
    )
