"""Stable player identities from tracklets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtspark.blocks import FOLD_SPAN, Lane, RowNumber, ema, greedy_spacing, scan
from courtspark.session import materialise

TILE = 512


# --- tracklets -----------------------------------------------------------------------------------
def sample_boxes(players: DataFrame, stride: int = 12, most: int = 16, span: int = FOLD_SPAN) -> DataFrame:
    """The first box of a raw id, then one at least ``stride`` frames after the last kept, at most ``most``."""
    rows = players.select("match_id", "raw_id", "frame", "x1", "y1", "x2", "y2")
    return greedy_spacing(rows, Lane(("match_id", "raw_id"), "frame", (), span), stride, most)


def build_tracklets(players: DataFrame, width: float, height: float, stride: int = 12, most: int = 16, min_length: int = 8) -> DataFrame:
    """Frame range per raw id and mean normalised feet over the sampled boxes; short ones drop out."""
    keys = ["match_id", "raw_id"]
    ranges = players.groupBy(*keys).agg(F.min("frame").alias("frame_min"), F.max("frame").alias("frame_max"))
    ranges = ranges.withColumn("length", F.col("frame_max") - F.col("frame_min") + 1).filter(F.col("length") >= min_length)
    feet = sample_boxes(players, stride, most).groupBy(*keys).agg(
        F.avg((F.col("x1") + F.col("x2")) / (2.0 * width)).alias("mean_fx"), F.avg(F.col("y2") / height).alias("mean_fy"), F.count("*").alias("samples")
    )
    return ranges.join(feet, keys)


def embed(crops: DataFrame, fn: Callable[[pd.Series], np.ndarray] | None = None, column: str = "crop") -> DataFrame:
    """crops to vectors. ``fn`` takes a series of crops and returns an (n, d) array; without it ``embedding`` is already there."""
    if fn is None:
        return crops
    schema = T.StructType([f for f in crops.schema.fields if f.name not in (column, "embedding")] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = np.asarray(fn(pdf[column]), dtype="float32")
            yield pdf.drop(columns=[column]).assign(embedding=list(vectors))

    return crops.mapInPandas(run, schema)


def register_embedder(spark: SparkSession, name: str, load: Callable[[], Callable[[list], np.ndarray]]) -> None:
    """F1 for SQL: ``name(crop)`` gives the L2-normalised vector of a crop (a zero vector stays zero, a null crop gives null).

    ``load`` runs in the worker, once per task, and returns the model: a function from a list of crops to an (n, d) array.
    Crops come in Arrow batches, so a task holds one batch and one model.
    """

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for crops in batches:
            out = pd.Series([None] * len(crops), dtype=object)
            known = np.flatnonzero(crops.notna().to_numpy())
            if len(known):
                v = np.asarray(model(list(crops.iloc[known])), dtype="float64")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for i, row in zip(known, v / np.where(norm > 0, norm, 1.0)):
                    out.iat[i] = row
            yield out

    spark.udf.register(name, vectors)


def colour_histogram(bins: int = 16, top: int = 256) -> Callable[[list], np.ndarray]:
    """A plain appearance model: the share of pixel values in each of ``bins`` equal ranges below ``top``; no pixel gives zeros."""

    def model(crops: list) -> np.ndarray:
        out = np.zeros((len(crops), bins))
        for i, crop in enumerate(crops):
            values = np.asarray(crop, dtype="float64").ravel()
            values = values[(values >= 0) & (values < top)]
            if len(values):
                out[i] = np.bincount((values * bins // top).astype(int), minlength=bins) / len(values)
        return out

    return model


def tracklet_parts(players: DataFrame, width: float, height: float, before: DataFrame | None = None, stride: int = 12, most: int = 16, span: int = FOLD_SPAN) -> DataFrame:
    """A13 as mergeable parts: frame range, sampled boxes and the sums of their feet per raw id.

    ``before``: parts of earlier rows, which are carried on; without new rows they stay as they are. Frame ranges merge
    in any order; sampling goes on behind the last box sampled, so a box older than that one isn't sampled.
    """
    keys = ["match_id", "raw_id"]
    rows = players.select(*keys, "frame", ((F.col("x1") + F.col("x2")) / (2.0 * width)).alias("fx"), (F.col("y2") / height).alias("fy"))
    ranges = rows.groupBy(*keys).agg(F.min("frame").alias("frame_min"), F.max("frame").alias("frame_max"))
    lane = Lane(("match_id", "raw_id"), "frame", (), span)
    if before is not None:
        # the last box sampled stands at the head of its lane, so the next one keeps its distance to it
        open_ids = before.select(*keys, "last_kept", "samples")
        rows = rows.join(open_ids, keys, "left").filter((F.coalesce("samples", F.lit(0)) < most) & (F.col("last_kept").isNull() | (F.col("frame") > F.col("last_kept"))))
        rows = rows.select(*keys, "frame", "fx", "fy", F.coalesce("samples", F.lit(0)).alias("had"), F.lit(False).alias("head"))
        heads = open_ids.filter(F.col("samples") < most).join(ranges.select(*keys), keys, "left_semi")
        heads = heads.select(*keys, F.col("last_kept").alias("frame"), F.lit(None).cast("double").alias("fx"), F.lit(None).cast("double").alias("fy"), F.col("samples").alias("had"), F.lit(True).alias("head"))
        rows = rows.unionByName(heads)
    else:
        rows = rows.withColumn("had", F.lit(0).cast("bigint")).withColumn("head", F.lit(False))
    kept = greedy_spacing(rows, lane, stride, most).filter("NOT head")  # at most ``most`` rows a raw id
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    kept = kept.withColumn("_nth", nth).filter(F.col("had") + F.col("_nth") <= most)
    feet = kept.groupBy(*keys).agg(F.count("*").alias("samples"), F.max("frame").alias("last_kept"), F.count("fx").alias("n_fx"), F.sum("fx").alias("sum_fx"), F.count("fy").alias("n_fy"), F.sum("fy").alias("sum_fy"))
    parts = ranges.join(feet, keys, "left")
    if before is not None:
        parts = parts.unionByName(before.select(*parts.columns))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return parts.groupBy(*keys).agg(
        F.min("frame_min").alias("frame_min"), F.max("frame_max").alias("frame_max"), total("samples"), F.max("last_kept").alias("last_kept"),
        total("n_fx"), F.coalesce(F.sum("sum_fx"), F.lit(0.0)).alias("sum_fx"), total("n_fy"), F.coalesce(F.sum("sum_fy"), F.lit(0.0)).alias("sum_fy"),
    )


def finished_tracklets(parts: DataFrame, min_length: int = 8) -> DataFrame:
    """A13 from parts: the columns of :func:`build_tracklets`."""
    mean = lambda c: F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}") / F.col(f"n_{c}")).alias(f"mean_{c}")
    length = F.col("frame_max") - F.col("frame_min") + 1
    return parts.filter((length >= min_length) & (F.col("samples") > 0)).select("match_id", "raw_id", "frame_min", "frame_max", length.alias("length"), mean("fx"), mean("fy"), "samples")


def vector_sums(crops: DataFrame, keys: list[str], before: DataFrame | None = None) -> DataFrame:
    """A14 as mergeable sums: one row per key and dimension; sums combine before the shuffle. ``before``: earlier sums, carried on."""
    dims = crops.select(*keys, F.posexplode("embedding").alias("dim", "_v")).select(*keys, "dim", F.col("_v").cast("double").alias("total"), F.when(F.col("_v").isNotNull(), 1).otherwise(0).cast("bigint").alias("n"))
    if before is not None:
        dims = dims.unionByName(before.select(*keys, "dim", "total", "n"))
    return dims.groupBy(*keys, "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def unit_means(sums: DataFrame, keys: list[str]) -> DataFrame:
    """A14 from sums: the L2-normalised mean vector of each key."""
    item = F.struct("dim", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("m"))
    vec = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s")).select(*keys, F.transform("_s", lambda s: s["m"]).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v)) + 1e-8
    return vec.withColumn("_n", norm).select(*keys, F.transform("_v", lambda v: v / F.col("_n")).alias("embedding"))


def mean_embedding(crops: DataFrame, keys: list[str]) -> DataFrame:
    """L2-normalised mean of the crop vectors of each tracklet."""
    return unit_means(vector_sums(crops, keys), keys)


def with_embeddings(tracklets: DataFrame, vectors: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Tracklets without any crop get a fixed unit vector."""
    unit = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    return tracklets.join(vectors, keys, "left").withColumn("embedding", F.coalesce("embedding", unit))


# --- pairwise relations --------------------------------------------------------------------------
def cannot_link(tracklets: DataFrame, bucket: int = 256) -> DataFrame:
    """Pairs of tracklets seen at the same time.

    A tracklet is listed under each frame bucket it touches; only tracklets of one bucket meet,
    and a pair is reported by the bucket its overlap starts in, so no pair appears twice.
    """
    t = tracklets.select("match_id", "track_id", "frame_min", "frame_max")
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("frame_min") / bucket), F.floor(F.col("frame_max") / bucket))))
    a, b = t.alias("a"), t.alias("b")
    start = F.greatest(F.col("a.frame_min"), F.col("b.frame_min"))
    on = (
        (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.track_id") < F.col("b.track_id"))
        & (F.col("a.frame_min") <= F.col("b.frame_max")) & (F.col("b.frame_min") <= F.col("a.frame_max")) & (F.floor(start / bucket) == F.col("a._b"))
    )
    return a.join(b, on).select(F.col("a.match_id").alias("match_id"), F.col("a.track_id").alias("track_a"), F.col("b.track_id").alias("track_b"))


def _distances(emb_a, pos_a, emb_b, pos_b, pos_weight):
    """Cosine distance plus weighted feet distance, the latter clipped to 1."""
    d = 1.0 - emb_a @ emb_b.T
    if pos_weight > 0:
        gap = np.hypot(pos_a[:, None, 0] - pos_b[None, :, 0], pos_a[:, None, 1] - pos_b[None, :, 1])
        d += pos_weight * np.minimum(gap, 1.0, out=gap)
    return d


def _unpack(pdf: pd.DataFrame):
    emb = np.stack(pdf["embedding"].to_numpy()).astype("float64") if len(pdf) else np.zeros((0, 1))
    emb = emb / (np.linalg.norm(emb, axis=1, keepdims=True) + 1e-8)
    return emb, pdf[["mean_fx", "mean_fy"]].to_numpy(dtype="float64")


def _together(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which rows of a and b share a frame; each row holds the frame ranges of its members, sorted and apart."""
    lens = [len(spans) for spans in b["spans"]]
    owner = np.repeat(np.arange(len(b)), lens)
    lo, hi = (np.array([s[end] for spans in b["spans"] for s in spans], dtype="int64") for end in ("lo", "hi"))
    out = np.zeros((len(a), len(b)), dtype=bool)
    for i, spans in enumerate(a["spans"]):
        starts, ends = (np.array([s[end] for s in spans], dtype="int64") for end in ("lo", "hi"))
        last = np.searchsorted(starts, hi, side="right") - 1  # the last range that begins before the other one ends
        out[i, owner[(last >= 0) & (ends[last] >= lo)]] = True
    return out


def nearest_links(items: DataFrame, pos_weight: float = 0.15, tile: int = TILE) -> DataFrame:
    """J7 with J6: for each item the closest one it may be merged with (null when there is none).

    Input: match_id, rank (order within the match), spans, mean_fx, mean_fy, embedding. A match is
    cut into tiles of about ``tile`` items; a task sees two tiles, compares them as matrices and
    emits one best partner per row, never the pairs. Ties go to the lower rank, as in a scan.
    """
    sizes = items.groupBy("match_id").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    t = items.join(sizes, "match_id").withColumn("_t", F.pmod(F.xxhash64("rank"), F.col("_tiles")).cast("int"))
    pairs = t.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    pairs = pairs.withColumn("_i", F.least("_t", "_u")).withColumn("_j", F.greatest("_t", "_u"))
    match_type = items.schema["match_id"].dataType.simpleString()
    schema = f"match_id {match_type}, rank bigint, partner bigint, distance double"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, match = pdf["_i"].iloc[0], pdf["_j"].iloc[0], pdf["match_id"].iloc[0]
        a = pdf[pdf["_t"] == i].sort_values("rank").reset_index(drop=True)
        b = a if i == j else pdf[pdf["_t"] == j].sort_values("rank").reset_index(drop=True)
        if not len(a) or not len(b):
            return pd.DataFrame({"match_id": [], "rank": [], "partner": [], "distance": []})
        (ea, pa), (eb, pb) = _unpack(a), _unpack(b)
        d = _distances(ea, pa, eb, pb, pos_weight)
        d[_together(a, b)] = np.inf
        if i == j:
            np.fill_diagonal(d, np.inf)
        sides = [(a, b, d)] if i == j else [(a, b, d), (b, a, d.T)]
        out = []
        for rows, cols, m in sides:
            best = m.argmin(axis=1)
            value = m[np.arange(len(rows)), best]
            ok = np.isfinite(value)
            out.append(pd.DataFrame({"match_id": match, "rank": rows["rank"][ok], "partner": cols["rank"].to_numpy()[best][ok], "distance": value[ok]}))
        return pd.concat(out)

    found = pairs.select("match_id", "rank", "spans", "mean_fx", "mean_fy", "embedding", "_t", "_i", "_j").groupBy("match_id", "_i", "_j").applyInPandas(compare, schema)
    best = found.groupBy("match_id", "rank").agg(F.min(F.struct("distance", "partner")).alias("_b"))
    return items.select("match_id", "rank").join(best, ["match_id", "rank"], "left").select("match_id", "rank", F.col("_b.partner").alias("partner"), F.col("_b.distance").alias("distance"))


def ranked_items(tracklets: DataFrame) -> DataFrame:
    """Tracklets in order of first appearance, as single-member clusters."""
    # tracklets, not frames: numbered in blocks of frames, so no task sees a whole match
    tracklets = scan(tracklets, Lane(("match_id",), "frame_min", ("track_id",)), rank=RowNumber())
    rank = F.col("rank") - 1
    return tracklets.select(
        "match_id", "track_id", rank.alias("rank"), F.array(F.struct(F.col("frame_min").alias("lo"), F.col("frame_max").alias("hi"))).alias("spans"),
        F.coalesce("mean_fx", F.lit(0.5)).alias("mean_fx"), F.coalesce("mean_fy", F.lit(0.5)).alias("mean_fy"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


# --- clustering ----------------------------------------------------------------------------------
def _union(spans: list) -> list[tuple[int, int]]:
    """Frame ranges in order, those that touch joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((int(s["lo"]), int(s["hi"])) for s in spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _outside(theta: float, total: np.ndarray, where: np.ndarray, centre: np.ndarray, pos_weight: float) -> float:
    """A lower bound of the distance between a merged cluster and any cluster at least ``theta`` away from all its parts.

    ``total`` and ``where`` are the parts' vector sums and positions, ``centre`` the merged position. The merged cosine is
    the parts' mean cosine divided by the length that the mean of their unit vectors has; positions move by their
    distance from the centre.
    """
    size = np.linalg.norm(total, axis=1) + 1e-8
    length = (np.linalg.norm(total.sum(axis=0)) + 1e-8) / size.sum()
    shift = pos_weight * float(size @ np.linalg.norm(where - centre, axis=1)) / size.sum()
    return min(1.0 + pos_weight - (1.0 - theta + shift + pos_weight) / length, theta - shift)


def _merge_closest(pdf: pd.DataFrame, most: int, pos_weight: float) -> pd.DataFrame:
    """Merges among a match's ``most`` clusters of nearest links, as long as nothing outside can come between.

    Rows after the first ``most`` only tell how near the others come to anything. The first merge is the match's closest
    pair; a later one needs a distance below what the others reach, to old clusters or (by the bound) to merged ones.
    """
    left, beyond = int(pdf["_left"].iloc[0]), pdf.loc[pdf["_order"] > most, "distance"]
    theta = float(beyond.min()) if len(beyond) else np.inf
    rows = pdf[pdf["_order"] <= most].sort_values("rank").reset_index(drop=True)
    n = len(rows)
    unit, start = _unpack(rows)
    total, place, count = np.stack(rows["embedding"].to_numpy()).astype("float64"), start.copy(), rows["n"].to_numpy("int64").copy()
    sums, blocked, alive, parts = total.copy(), _together(rows, rows), np.ones(n, dtype=bool), [[i] for i in range(n)]
    bound = np.full(n, np.inf)
    d = _distances(unit, start, unit, start, pos_weight)
    d[blocked] = np.inf
    d[np.tril_indices(n)] = np.inf  # the pair is (lower, higher); the first minimum wins
    best = d.argmin(axis=1)
    least = d[np.arange(n), best]
    merges = 0
    while merges < left:
        a = int(least.argmin())
        b = int(best[a])
        if not np.isfinite(least[a]):
            break
        if merges and least[a] >= min(theta, bound.min()) - 1e-9:
            break
        merges += 1
        place[a] = (place[a] * count[a] + place[b] * count[b]) / (count[a] + count[b])
        count[a] += count[b]
        sums[a] += sums[b]
        parts[a] += parts[b]
        alive[b] = False
        d[b, :] = d[:, b] = bound[b] = np.inf
        blocked[a] |= blocked[b]
        blocked[:, a] |= blocked[:, b]
        unit[a] = sums[a] / (np.linalg.norm(sums[a]) + 1e-8)
        row = _distances(unit[a : a + 1], place[a : a + 1], unit, place, pos_weight)[0]
        row[blocked[a] | ~alive] = np.inf
        d[a, a + 1 :] = row[a + 1 :]
        d[:a, a] = row[:a]
        # rows whose closest partner was one of the two look again; for others only column a can have come closer
        stale = np.nonzero((best == a) | (best == b))[0]
        stale = np.append(stale, [a, b])
        nearer = np.nonzero((row[:a] < least[:a]) | ((row[:a] == least[:a]) & (a < best[:a])))[0]
        best[nearer], least[nearer] = a, row[nearer]
        best[stale] = d[stale].argmin(axis=1)
        least[stale] = d[stale, best[stale]]
        if np.isfinite(theta):
            bound[a] = _outside(theta, total[parts[a]], start[parts[a]], place[a], max(pos_weight, 0.0))
    done = merges == left or not np.isfinite(theta)
    out = []
    for root in np.nonzero(alive)[0]:
        spans = _union([s for i in parts[root] for s in rows["spans"][i]])
        merged = ([{"lo": lo, "hi": hi} for lo, hi in spans], float(place[root, 0]), float(place[root, 1]), list(sums[root]), int(count[root]))
        out += [(rows["match_id"][0], rows["rank"][i], rows["rank"][root], *(merged if i == root else (None, None, None, None, None)), done) for i in parts[root]]
    return pd.DataFrame(out, columns=["match_id", "rank", "root", "spans", "mean_fx", "mean_fy", "embedding", "n", "done"]).astype({"n": "Int64"})


def cluster_tracklets(tracklets: DataFrame, k: int = 4, pos_weight: float = 0.15, most: int = 4096, tile: int = TILE) -> DataFrame:
    """Merge tracklets of each match down to k players, never two that were seen together.

    Every match goes the same way, whatever its size. A round finds the nearest link of each cluster tile by tile; one
    task a match then takes the ``most`` clusters with the closest links and makes all those merges that provably come
    next in the order of distances (see ``_merge_closest``). A match whose clusters with links are no more than
    ``most`` needs one round. Clusters and members are tables in the shared folder; only emptiness reaches the driver.
    """
    items = materialise(ranked_items(tracklets), "tracklets")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)) + 1e-8
    state = items.withColumn("_n", norm).withColumn("embedding", F.transform("embedding", lambda v: v / F.col("_n"))).withColumn("n", F.lit(1).cast("bigint")).drop("_n", "track_id")
    members = items.select("match_id", "track_id", "rank", F.col("rank").alias("root"))
    types = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = f"match_id {types['match_id']}, rank bigint, root bigint, spans {types['spans']}, mean_fx double, mean_fy double, embedding array<double>, n bigint, done boolean"
    while True:
        sizes = state.groupBy("match_id").agg((F.count("*") - k).alias("_left")).filter("_left > 0")
        links = nearest_links(state.join(sizes.select("match_id"), "match_id", "left_semi"), pos_weight, tile).filter("partner IS NOT NULL")
        closest = Window.partitionBy("match_id").orderBy("distance", F.least("rank", "partner"), F.greatest("rank", "partner"), "rank")
        # one row beyond ``most``: its distance bounds what all the others can do
        picked = links.withColumn("_order", F.row_number().over(closest)).filter(F.col("_order") <= most + 1).select("match_id", "rank", "distance", "_order")
        work = picked.join(state, ["match_id", "rank"]).join(sizes, "match_id")
        moved = materialise(work.groupBy("match_id").applyInPandas(lambda pdf: _merge_closest(pdf, most, pos_weight), schema), "merges")
        steps = moved.select("match_id", F.col("rank").alias("root"), F.col("root").alias("_to"))
        members = members.join(steps, ["match_id", "root"], "left").select("match_id", "track_id", "rank", F.coalesce("_to", "root").alias("root"))
        going = moved.filter("NOT done").select("match_id").distinct()
        if going.isEmpty():
            break
        members = materialise(members, "members")
        untouched = state.join(moved.select("match_id", "rank"), ["match_id", "rank"], "left_anti")
        merged = moved.filter("rank = root").select(*state.columns)
        state = materialise(untouched.unionByName(merged).join(going, "match_id", "left_semi"), "clusters")
    roots = scan(members.filter("rank = root").select("match_id", "rank"), Lane(("match_id",), "rank"), label=RowNumber())
    return members.select("match_id", "track_id", "root").join(roots.select("match_id", F.col("rank").alias("root"), (F.col("label") - 1).cast("bigint").alias("cluster")), ["match_id", "root"]).select("match_id", "track_id", "cluster")


def canonical_ids(clusters: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Clusters numbered from 1 by mean feet position, far to near then left to right."""
    rows = clusters.join(tracklets.select("match_id", "track_id", "mean_fx", "mean_fy"), ["match_id", "track_id"])
    pos = rows.groupBy("match_id", "cluster").agg(F.coalesce(F.avg("mean_fy"), F.lit(0.5)).alias("_y"), F.coalesce(F.avg("mean_fx"), F.lit(0.5)).alias("_x"))
    canon = F.row_number().over(Window.partitionBy("match_id").orderBy("_y", "_x", "cluster"))
    return rows.select("match_id", "track_id", "cluster").join(pos.select("match_id", "cluster", canon.alias("canonical_id")), ["match_id", "cluster"])


def position_fallback(tracklets: DataFrame, k: int = 4) -> DataFrame:
    """Without clusters, the first k tracklets by position take the slots (limited before the shuffle)."""
    w = Window.partitionBy("match_id").orderBy("mean_fy", "mean_fx", "track_id")
    return tracklets.filter("mean_fx IS NOT NULL").withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= k).select("match_id", "track_id", "slot")


def resolve_identities(players: DataFrame, vectors: DataFrame, width: float, height: float, dim: int, k: int = 4) -> DataFrame:
    """C4: raw id to canonical id. ``vectors``: match_id, raw_id, embedding (one row per crop)."""
    t = build_tracklets(players, width, height)
    t = with_embeddings(t, mean_embedding(vectors, ["match_id", "raw_id"]), ["match_id", "raw_id"], dim).withColumnRenamed("raw_id", "track_id")
    t = materialise(t, "tracklets")
    return canonical_ids(cluster_tracklets(t, k), t).withColumnRenamed("track_id", "raw_id")


def apply_mapping(players: DataFrame, mapping: DataFrame, fallback: Column) -> DataFrame:
    """Canonical id where the raw id is known, else the fallback."""
    j = players.join(mapping.select("match_id", "raw_id", "canonical_id"), ["match_id", "raw_id"], "left")
    return j.withColumn("player_id", F.coalesce("canonical_id", fallback)).drop("canonical_id")


def slot_positions(players: DataFrame, width: float, height: float, alpha: float = 0.1, span: int = FOLD_SPAN, ties: tuple[str, ...] = (), before: DataFrame | None = None) -> DataFrame:
    """Smoothed feet position of each slot after each box; ``ties`` order the boxes a slot has in one frame.

    ``before``: match_id, slot, frame, pos_x, pos_y and the ties of each slot's last row so far. Smoothing goes on from
    there, a row not newer than that one counts as the next frame's, and the last rows so far are returned too.
    """
    feet = players.select("match_id", "slot", "frame", *ties, ((F.col("x1") + F.col("x2")) / (2.0 * width)).alias("fx"), (F.col("y2") / height).alias("fy"))
    if before is not None:
        feet = feet.join(before.select("match_id", "slot", (F.col("frame") + 1).alias("_next")), ["match_id", "slot"], "left")
        feet = feet.withColumn("frame", F.greatest("frame", "_next")).drop("_next")
        feet = feet.unionByName(before.select("match_id", "slot", "frame", *ties, F.col("pos_x").alias("fx"), F.col("pos_y").alias("fy")))
    return ema(feet, Lane(("match_id", "slot"), "frame", ties, span), alpha, pos_x=F.col("fx"), pos_y=F.col("fy"))


def nearest_slot(newcomers: DataFrame, slots: DataFrame, k: int = 4, used: DataFrame | None = None) -> DataFrame:
    """The slot whose position is nearest to a new raw id; without any position, a free slot, then the first.

    ``newcomers``: match_id, raw_id, fx, fy; ``slots``: match_id, slot, pos_x, pos_y (at most k rows per match);
    ``used``: match_id, slot of ids that have one. Free slots go to the lowest raw ids.
    """
    near = F.pow(F.col("fx") - F.col("pos_x"), 2) + F.pow(F.col("fy") - F.col("pos_y"), 2)
    j = newcomers.join(slots.select("match_id", "slot", "pos_x", "pos_y"), "match_id", "left")
    best = j.groupBy("match_id", "raw_id").agg(F.min(F.when(near.isNotNull(), F.struct(near.alias("d"), F.col("slot")))).alias("_b"))
    best = best.select("match_id", "raw_id", F.col("_b.slot").alias("slot"))
    if used is None:
        return best.select("match_id", "raw_id", F.coalesce("slot", F.lit(1)).alias("slot"))
    taken = used.groupBy("match_id").agg(F.collect_set(F.col("slot").cast("int")).alias("_taken"))  # k values
    order = F.row_number().over(Window.partitionBy("match_id").orderBy("raw_id"))
    first = best.filter("slot IS NULL").withColumn("_n", order).filter(F.col("_n") <= k).join(taken, "match_id", "left")
    free = F.array_except(F.sequence(F.lit(1), F.lit(k)), F.coalesce("_taken", F.array().cast("array<int>")))
    first = first.select("match_id", "raw_id", F.get(free, F.col("_n") - 1).alias("_free"))
    return best.join(first, ["match_id", "raw_id"], "left").select("match_id", "raw_id", F.coalesce("slot", "_free", F.lit(1)).alias("slot"))
