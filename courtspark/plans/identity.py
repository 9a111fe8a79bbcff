"""Identity, tracking and court-fitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.blocks import FOLD_SPAN, Lane, Prev, ema, scan
from courtspark.functions import geometry as G
from courtspark.operators import court, identity, tracking
from courtspark.plans import domain as D

QUERIES, ORACLE = {}, {}
W, H = 1280.0, 720.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


PIXELS = "[(event_id * 7 + k * i * i) % 256 for i in range(1, 41)]"


@query(D.with_sql(D.PF, f"""
px AS (SELECT event_id, CASE WHEN event_type <> 'signup' THEN {PIXELS} END AS crop FROM pf),
hs AS (SELECT event_id, crop, [len([1 for p in crop if p // 16 = b]) * 1e0 for b in range(0, 16)] AS h FROM px)""") + """
SELECT event_id, CASE WHEN crop IS NOT NULL THEN [round(x / sqrt(list_sum([y * y for y in h])), 6) for x in h] END AS look FROM hs""")
def sql_embedding(spark, sf_dir):
    """crops of forty pixel values embedded in a SQL statement by a registered model; sign-up frames have no crop."""
    identity.register_embedder(spark, "look_of", identity.colour_histogram)
    pixels = F.expr("CASE WHEN event_type <> 'signup' THEN transform(sequence(1, 40), i -> (event_id * 7 + k * i * i) % 256) END")
    pf = D.player_frames(spark, sf_dir)
    return spark.sql("SELECT event_id, transform(look, v -> round(v, 6)) AS look FROM (SELECT event_id, look_of(crop) AS look FROM {crops})", crops=pf.select("event_id", pixels.alias("crop")))


SAMPLED = """
nr AS (SELECT match_id, raw_id, frame, x1, x2, y2, row_number() OVER (PARTITION BY match_id, raw_id ORDER BY frame) AS n FROM pf),
gr AS (
  SELECT match_id, raw_id, n, frame AS last, true AS ok FROM nr WHERE n = 1
  UNION ALL
  SELECT c.match_id, c.raw_id, c.n, CASE WHEN c.frame - g.last >= 12 THEN c.frame ELSE g.last END, c.frame - g.last >= 12
  FROM gr g JOIN nr c ON c.match_id = g.match_id AND c.raw_id = g.raw_id AND c.n = g.n + 1),
sm AS (SELECT nr.*, row_number() OVER (PARTITION BY match_id, raw_id ORDER BY frame) AS kept FROM nr JOIN gr USING (match_id, raw_id, n) WHERE ok)"""
TRACKS = """
tk AS (SELECT p.match_id, p.raw_id, p.frame_min, p.frame_max, p.frame_max - p.frame_min + 1 AS length, mean_fx, mean_fy, samples
  FROM (SELECT match_id, raw_id, min(frame) AS frame_min, max(frame) AS frame_max FROM pf GROUP BY ALL) p
  JOIN (SELECT match_id, raw_id, avg((x1 + x2) / 2560e0) AS mean_fx, avg(y2 / 720e0) AS mean_fy, count(*) AS samples FROM sm WHERE kept <= 16 GROUP BY ALL) USING (match_id, raw_id)
  WHERE p.frame_max - p.frame_min + 1 >= 8)"""


@query(D.with_sql(D.PF, SAMPLED, recursive=True) + " SELECT match_id, raw_id, frame FROM sm WHERE kept <= 16")
def sampled_boxes(spark, sf_dir):
    """W7."""
    return identity.sample_boxes(D.player_frames(spark, sf_dir)).select("match_id", "raw_id", "frame")


@query(D.with_sql(D.PF, SAMPLED, TRACKS, recursive=True) + " SELECT match_id, raw_id, frame_min, frame_max, length, samples, round(mean_fx, 6) AS mean_fx, round(mean_fy, 6) AS mean_fy FROM tk")
def tracklets(spark, sf_dir):
    """A13."""
    t = identity.build_tracklets(D.player_frames(spark, sf_dir), W, H)
    return t.withColumn("mean_fx", F.round("mean_fx", 6)).withColumn("mean_fy", F.round("mean_fy", 6))


@query("""
WITH d AS (SELECT vec_id // 5 AS track_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
v AS (SELECT track_id, list(m ORDER BY i) AS v, sqrt(sum(m * m)) + 1e-8 AS n FROM d GROUP BY track_id)
SELECT track_id, [round(x / n, 6) for x in v] AS embedding FROM v""")
def tracklet_embedding(spark, sf_dir):
    """Five crops per tracklet, through F1's pass-through embedder."""
    crops = identity.embed(D.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("track_id"), "embedding"))
    return identity.mean_embedding(crops, ["track_id"]).select("track_id", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


@query(D.with_sql(D.TRACKLETS) + """
SELECT a.match_id, a.track_id AS track_a, b.track_id AS track_b FROM tr a JOIN tr b
ON a.match_id = b.match_id AND a.track_id < b.track_id AND a.frame_min <= b.frame_max AND b.frame_min <= a.frame_max""")
def cannot_link(spark, sf_dir):
    """J6."""
    return identity.cannot_link(D.tracklets(spark, sf_dir))


@query(D.with_sql(D.TRACKLETS, """
nm AS (SELECT *, sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) for v in embedding])) + 1e-8 AS n FROM tr),
un AS (SELECT match_id, track_id, frame_min, frame_max, mean_fx, mean_fy, [CAST(v AS DOUBLE) / n for v in embedding] AS e FROM nm),
pr AS (SELECT a.match_id, a.track_id, b.track_id AS partner, 1 - list_inner_product(a.e, b.e) + 15e-2 * least(1, sqrt(pow(a.mean_fx - b.mean_fx, 2) + pow(a.mean_fy - b.mean_fy, 2))) AS d
       FROM un a JOIN un b ON a.match_id = b.match_id AND a.track_id <> b.track_id AND NOT (a.frame_min <= b.frame_max AND b.frame_min <= a.frame_max))""") + """
SELECT un.match_id, un.track_id, q.partner, round(q.d, 6) AS distance FROM un
LEFT JOIN (SELECT match_id, track_id, arg_min(partner, d) AS partner, min(d) AS d FROM pr GROUP BY ALL) q USING (match_id, track_id)""")
def tracklet_distance(spark, sf_dir):
    """J7 with J6: the closest tracklet each one may be merged with."""
    items = identity.ranked_items(D.tracklets(spark, sf_dir))
    names = items.select("match_id", "rank", "track_id")
    links = identity.nearest_links(items).join(names, ["match_id", "rank"])
    other = names.select("match_id", F.col("rank").alias("partner"), F.col("track_id").alias("_p"))
    return links.join(other, ["match_id", "partner"], "left").select("match_id", "track_id", F.col("_p").alias("partner"), F.round("distance", 6).alias("distance"))


@query(D.with_sql(D.TRACKLETS, """
cl AS (SELECT tr.*, label % 5 AS cluster FROM tr JOIN embeddings ON vec_id = track_id),
cp AS (SELECT match_id, cluster, avg(mean_fy) AS y, avg(mean_fx) AS x FROM cl GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY y, x, cluster) AS canonical_id FROM cp)""") + """
SELECT cl.match_id, cl.track_id, cl.cluster, canonical_id FROM cl JOIN cn USING (match_id, cluster)""")
def canonical_ids(spark, sf_dir):
    """C2 over five given clusters."""
    t = D.tracklets(spark, sf_dir)
    clusters = D.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 64 AS match_id", "vec_id AS track_id", "label % 5 AS cluster")
    return identity.canonical_ids(clusters, t)


@query(D.with_sql(D.TRACKLETS, "r AS (SELECT match_id, track_id, row_number() OVER (PARTITION BY match_id ORDER BY mean_fy, mean_fx, track_id) AS slot FROM tr)") + " SELECT * FROM r WHERE slot <= 4")
def position_fallback(spark, sf_dir):
    """C3."""
    return identity.position_fallback(D.tracklets(spark, sf_dir))


@query(D.with_sql(D.PF, """
mp AS (SELECT DISTINCT match_id, raw_id, 5 - raw_id // 1000 AS canonical_id FROM pf WHERE frame < 160)""") + """
SELECT event_id, coalesce(canonical_id, slot) AS player_id FROM pf LEFT JOIN mp USING (match_id, raw_id)""")
def reid_mapping_join(spark, sf_dir):
    """J4."""
    pf = D.player_frames(spark, sf_dir)
    mapping = pf.filter("frame < 160").select("match_id", "raw_id", F.expr("5 - raw_id div 1000").alias("canonical_id")).distinct()
    return identity.apply_mapping(pf, mapping, F.col("slot")).select("event_id", "player_id")


EMA_POS = """
nf AS (SELECT match_id, slot, frame, (x1 + x2) / 2560e0 AS fx, y2 / 720e0 AS fy, row_number() OVER (PARTITION BY match_id, slot ORDER BY frame) AS n FROM pf),
em AS (
  SELECT match_id, slot, n, frame, fx AS px, fy AS py FROM nf WHERE n = 1
  UNION ALL
  SELECT c.match_id, c.slot, c.n, c.frame, 9e-1 * e.px + 1e-1 * c.fx, 9e-1 * e.py + 1e-1 * c.fy
  FROM em e JOIN nf c ON c.match_id = e.match_id AND c.slot = e.slot AND c.n = e.n + 1)"""


@query(D.with_sql(D.PF, EMA_POS, recursive=True) + " SELECT match_id, slot, frame, round(px * 1280, 6) AS pos_x, round(py * 720, 6) AS pos_y FROM em")
def slot_position_ema(spark, sf_dir):
    """W17, in pixels."""
    s = identity.slot_positions(D.player_frames(spark, sf_dir), W, H)
    return s.select("match_id", "slot", "frame", F.round(F.col("pos_x") * W, 6).alias("pos_x"), F.round(F.col("pos_y") * H, 6).alias("pos_y"))


@query(D.with_sql(D.PF, D.FRAMES, """
gp AS (SELECT match_id, frame, t_sec - lag(t_sec) OVER (PARTITION BY match_id ORDER BY frame) AS dt, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS n FROM fr),
fe AS (
  SELECT match_id, frame, n, CAST(0 AS DOUBLE) AS fps FROM gp WHERE n = 1
  UNION ALL
  SELECT g.match_id, g.frame, g.n, 1e-1 * CASE WHEN dt > 0 THEN 1 / dt ELSE 0 END + 9e-1 * fps FROM fe e JOIN gp g ON g.match_id = e.match_id AND g.n = e.n + 1)""", recursive=True) + """
SELECT match_id, frame, round(fps, 8) AS fps FROM fe""")
def fps_ema(spark, sf_dir):
    """Smoothed frame rate, starting from 0."""
    lane = Lane(("match_id",), "frame", (), FOLD_SPAN)
    gaps = scan(D.frames(spark, sf_dir).select("match_id", "frame", "t_sec"), lane, _t=Prev(F.col("t_sec")))
    dt = F.col("t_sec") - F.col("_t")
    inst = F.when(dt > 0, 1.0 / dt).otherwise(0.0)
    return ema(gaps.withColumn("inst", inst), lane, 0.1, initial=0.0, fps=F.col("inst")).select("match_id", "frame", F.round("fps", 8).alias("fps"))


@query(D.with_sql(D.PF, """
nw AS (SELECT match_id, raw_id, arg_min((x1 + x2) / 2560e0, frame) AS fx, arg_min(y2 / 720e0, frame) AS fy FROM pf WHERE frame >= 160 GROUP BY ALL),
sp AS (SELECT match_id, slot, avg((x1 + x2) / 2560e0) AS pos_x, avg(y2 / 720e0) AS pos_y FROM pf WHERE frame < 160 GROUP BY ALL),
d AS (SELECT nw.match_id, raw_id, slot, row_number() OVER (PARTITION BY nw.match_id, raw_id ORDER BY pow(fx - pos_x, 2) + pow(fy - pos_y, 2), slot) AS r FROM nw JOIN sp ON sp.match_id = nw.match_id)""") + """
SELECT match_id, raw_id, slot FROM d WHERE r = 1""")
def nearest_slot(spark, sf_dir):
    """Raw ids first seen late take the slot nearest to their first feet position."""
    pf = D.player_frames(spark, sf_dir).withColumn("fx", G.feet_x("x1", "x2") / W).withColumn("fy", F.col("y2") / H)
    fresh = pf.filter("frame >= 160").groupBy("match_id", "raw_id").agg(F.min_by("fx", "frame").alias("fx"), F.min_by("fy", "frame").alias("fy"))
    slots = pf.filter("frame < 160").groupBy("match_id", "slot").agg(F.avg("fx").alias("pos_x"), F.avg("fy").alias("pos_y"))
    return identity.nearest_slot(fresh, slots)


# one merge a step: the legal pair of least distance, ties by order of appearance; ``tr`` holds the tracklets
MERGED = """
it AS (SELECT match_id, track_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_min, track_id) - 1 AS pos, frame_min, frame_max,
  coalesce(mean_fx, 5e-1) AS fx, coalesce(mean_fy, 5e-1) AS fy, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])])) + 1e-8 AS norm FROM tr),
st AS (
  SELECT 0 AS step, match_id, pos, fx, fy, 1 AS n, [x / norm FOR x IN v] AS v, [{'lo': frame_min, 'hi': frame_max}] AS spans, [track_id] AS ids FROM it
  UNION ALL
  SELECT s.step + 1, s.match_id, s.pos, CASE WHEN o.pos IS NULL THEN s.fx ELSE (s.fx * s.n + o.fx * o.n) / (s.n + o.n) END, CASE WHEN o.pos IS NULL THEN s.fy ELSE (s.fy * s.n + o.fy * o.n) / (s.n + o.n) END,
    s.n + coalesce(o.n, 0), CASE WHEN o.pos IS NULL THEN s.v ELSE [x[1] + x[2] FOR x IN list_zip(s.v, o.v)] END, list_concat(s.spans, o.spans), list_concat(s.ids, o.ids)
  FROM st s
  JOIN (SELECT match_id, min({'d': d, 'a': a, 'b': b}) AS p FROM (
    SELECT a.match_id, a.pos AS a, b.pos AS b, 1 - list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-8) * (sqrt(list_dot_product(b.v, b.v)) + 1e-8))
      + 15e-2 * least(1e0, sqrt(pow(a.fx - b.fx, 2) + pow(a.fy - b.fy, 2))) AS d
    FROM st a JOIN st b ON a.match_id = b.match_id AND a.pos < b.pos
    WHERE len(list_filter(a.spans, lambda x: len(list_filter(b.spans, lambda y: x.lo <= y.hi AND y.lo <= x.hi)) > 0)) = 0
      AND a.match_id IN (SELECT match_id FROM st GROUP BY match_id HAVING count(*) > 4)) GROUP BY match_id) m ON m.match_id = s.match_id
  LEFT JOIN st o ON o.match_id = s.match_id AND o.pos = m.p.b AND s.pos = m.p.a
  WHERE s.pos <> m.p.b),
fin AS (SELECT match_id, ids, row_number() OVER (PARTITION BY match_id ORDER BY pos) - 1 AS cluster FROM (SELECT *, max(step) OVER (PARTITION BY match_id) AS top FROM st) WHERE step = top),
cl AS (SELECT match_id, unnest(ids) AS track_id, cluster FROM fin)"""


@query(D.with_sql(D.TRACKLETS, MERGED, recursive=True) + " SELECT match_id, track_id, cluster FROM cl")
def reid_clusters(spark, sf_dir):
    """C1."""
    return identity.cluster_tracklets(D.tracklets(spark, sf_dir))


@query(D.with_sql(D.PF, SAMPLED, TRACKS, """
cv AS (SELECT match_id, raw_id, i, avg(CAST(CAST(cos(slot * i * 1e0) + (k % 10) * 2e-2 * i % 3 AS FLOAT) AS DOUBLE)) AS m FROM pf, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL),
ce AS (SELECT match_id, raw_id, list(m ORDER BY i) AS embedding FROM cv GROUP BY ALL),
tr AS (SELECT match_id, raw_id AS track_id, frame_min, frame_max, mean_fx, mean_fy, embedding FROM tk JOIN ce USING (match_id, raw_id))""", MERGED, """
cp AS (SELECT match_id, cluster, coalesce(avg(mean_fy), 5e-1) AS y, coalesce(avg(mean_fx), 5e-1) AS x FROM cl JOIN tr USING (match_id, track_id) GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY y, x, cluster) AS canonical_id FROM cp)""", recursive=True) + """
SELECT match_id, cluster, track_id AS raw_id, canonical_id FROM cl JOIN cn USING (match_id, cluster)""")
def reid_offline(spark, sf_dir):
    """C4: boxes and crop vectors to canonical ids."""
    pf = D.player_frames(spark, sf_dir)
    vectors = pf.select("match_id", "raw_id", F.expr("transform(sequence(1, 16), i -> CAST(cos(slot * i * 1D) + (k % 10) * 0.02D * i % 3 AS FLOAT))").alias("embedding"))
    return identity.resolve_identities(pf, vectors, W, H, 16)


# --- tracking rules ------------------------------------------------------------------------------
@query(D.with_sql(D.PF) + """
SELECT match_id, frame, arg_max(slot, r) AS track_id, arg_max(k % 3 <> 0, r) AS matched, arg_max(k % 11, r) AS hits, arg_max(conf, r) AS score FROM (
  SELECT *, CASE WHEN k % 3 <> 0 THEN {'m': 1, 'u': 0, 'h': k % 11, 's': conf, 'i': -slot} ELSE {'m': 0, 'u': -(k % 5), 'h': k % 11, 's': 0e0, 'i': -slot} END AS r FROM pf)
GROUP BY match_id, frame""")
def primary_ball(spark, sf_dir):
    """T4 over tracks of every frame (slots stand for tracks)."""
    t = D.player_frames(spark, sf_dir).selectExpr("match_id", "frame", "slot AS track_id", "k % 3 <> 0 AS matched", "k % 11 AS hits", "conf AS score", "k % 5 AS unseen")
    return tracking.primary_ball(t).drop("unseen")


def gate_rows(spark, sf_dir):
    return D.player_frames(spark, sf_dir).select("match_id", "raw_id", "frame", F.expr("k % 25 <> 0").alias("inside"), G.good_height("y1", "y2").alias("good_height"), "conf")


GATE = """
g AS (SELECT match_id, raw_id, frame, k % 25 <> 0 AS inside, y2 - y1 BETWEEN 40 AND 300 AS good, conf FROM pf),
gi AS (SELECT *, frame - row_number() OVER (PARTITION BY match_id, raw_id ORDER BY frame) AS isl FROM g),
gn AS (SELECT *, row_number() OVER (PARTITION BY match_id, raw_id, isl ORDER BY frame) AS n, min(frame) OVER (PARTITION BY match_id, raw_id, isl) AS since,
  avg(conf) OVER (PARTITION BY match_id, raw_id, isl ORDER BY frame) AS mean FROM gi),
st AS (
  SELECT match_id, raw_id, since, n, frame, CASE WHEN inside AND good THEN 1 ELSE 0 END AS run, 0 AS away, {need} <= 1 AND inside AND good AND mean >= 4e-1 AS est, false AS lost FROM gn WHERE n = 1
  UNION ALL
  SELECT c.match_id, c.raw_id, c.since, c.n, c.frame,
    CASE WHEN s.est THEN s.run WHEN c.inside AND c.good THEN s.run + 1 ELSE 0 END,
    CASE WHEN s.est AND NOT c.inside THEN s.away + 1 WHEN s.est OR c.inside AND c.good THEN 0 ELSE s.away END,
    CASE WHEN s.est THEN c.inside OR s.away + 1 <= {limit} ELSE c.n >= {need} AND c.inside AND c.good AND s.run + 1 >= {need} AND c.mean >= 4e-1 END,
    s.est AND NOT c.inside AND s.away + 1 > {limit}
  FROM st s JOIN gn c ON c.match_id = s.match_id AND c.raw_id = s.raw_id AND c.since = s.since AND c.n = s.n + 1)"""


def gate_sql(need: int, limit: int) -> str:
    return D.with_sql(D.PF, GATE.replace("{need}", str(need)).replace("{limit}", str(limit)), recursive=True) + """
    SELECT match_id, raw_id, since, frame, est AS valid, lost OR est AND NOT inside AS outside, est AS established FROM st JOIN g USING (match_id, raw_id, frame)"""


@query(gate_sql(15, 300))
def court_filter(spark, sf_dir):
    """D3."""
    return tracking.court_filter(gate_rows(spark, sf_dir))


@query(gate_sql(3, 1))
def court_filter_short(spark, sf_dir):
    """D3 with short limits, so that tracks are lost and found again in small tables."""
    return tracking.court_filter(gate_rows(spark, sf_dir), establish=3, outside=1)


@query(D.with_sql(D.PF, """
g AS (SELECT match_id, raw_id, frame, k % 25 <> 0 AND y2 - y1 BETWEEN 40 AND 300 AS ok, conf FROM pf),
p AS (SELECT *, frame - row_number() OVER (PARTITION BY match_id, raw_id ORDER BY frame) AS isl FROM g),
q AS (SELECT *, min(frame) OVER (PARTITION BY match_id, raw_id, isl) AS since, avg(conf) OVER (PARTITION BY match_id, raw_id, isl ORDER BY frame) AS mean,
        sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, raw_id, isl ORDER BY frame ROWS 14 PRECEDING) AS run FROM p)""") + """
SELECT match_id, raw_id, since, min(frame) AS established_at FROM q WHERE run = 15 AND mean >= 0.4 GROUP BY ALL""")
def court_establishment(spark, sf_dir):
    """D3 (first establishment) over J15."""
    return tracking.first_established(gate_rows(spark, sf_dir))


# --- court fitting -------------------------------------------------------------------------------
@query("""
SELECT s_suppkey, CAST(4 - s_suppkey % 2 * 0 AS INT) AS corners, [0e0, 20e0, 10e0, 20e0, 10e0, 0e0, 0e0, 0e0] AS projected FROM supplier""")
def corner_homography(spark, sf_dir):
    """P13, four corners: the fitted homography maps them onto the court's corners."""
    s = D.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "array(named_struct('x', 300D + s_suppkey % 50, 'y', 150D), named_struct('x', 900D, 'y', 160D + s_suppkey % 20), "
        "named_struct('x', 1150D - s_suppkey % 30, 'y', 680D), named_struct('x', 100D, 'y', 700D - s_suppkey % 10)) AS corners",
    )
    fitted = court.fit_corners(s)
    h = F.col("h")
    xy = F.flatten(F.transform("corners", lambda c: F.array(F.round(G.project_x(h, c["x"], c["y"]), 4) + 0.0, F.round(G.project_y(h, c["x"], c["y"]), 4) + 0.0)))
    return fitted.select("s_suppkey", F.size("corners").alias("corners"), xy.alias("projected"))


def _court_points(spark, sf_dir):
    t = court.court_template(spark)
    s = D.table(spark, sf_dir, "supplier").select("s_suppkey")
    p = s.withColumn("kpt", F.explode(F.sequence(F.lit(0), F.lit(25)))).join(F.broadcast(t), "kpt")
    hidden = "s_suppkey % 10 = 9 AND kpt > 2 OR kpt % 7 = 6"
    stray = "CASE WHEN kpt = s_suppkey % 5 THEN 400 ELSE 0 END"
    return p.selectExpr(
        "s_suppkey", "kpt", "court_x", "court_y", f"{hidden} AS hidden", f"kpt = s_suppkey % 5 AS stray",
        f"CASE WHEN {hidden} THEN 0D ELSE court_x * 50 + 100 + s_suppkey % 40 + {stray} END AS x", f"CASE WHEN {hidden} THEN 0D ELSE court_y * 30 + 50 + {stray} END AS y",
    )


@query("""
WITH k AS (SELECT s_suppkey, kpt, (s_suppkey % 10 = 9 AND kpt > 2) OR kpt % 7 = 6 AS hidden FROM supplier, (SELECT unnest(range(26)) AS kpt))
SELECT s_suppkey, CAST(count(*) FILTER (NOT hidden) AS INT) AS visible, count(*) FILTER (NOT hidden) >= 4 AS fitted,
  CASE WHEN count(*) FILTER (NOT hidden) >= 4 THEN count(*) FILTER (NOT hidden AND kpt <> s_suppkey % 5) END AS on_template
FROM k GROUP BY s_suppkey""")
def court_homography(spark, sf_dir):
    """P13, 26 points with hidden ones and one stray: all honest points land on the template."""
    pts = _court_points(spark, sf_dir)
    h = court.fit_homographies(pts.select("s_suppkey", "kpt", "x", "y"), ["s_suppkey"], threshold=0.5)
    j = pts.join(h, "s_suppkey")
    off = F.hypot(G.project_x(F.col("h"), F.col("x"), F.col("y")) - F.col("court_x"), G.project_y(F.col("h"), F.col("x"), F.col("y")) - F.col("court_y"))
    return j.groupBy("s_suppkey", "visible", "h").agg(F.sum(F.when(~F.col("hidden") & (off < 1e-4), 1).otherwise(0)).alias("_g")).select(
        "s_suppkey", "visible", F.col("h").isNotNull().alias("fitted"), F.when(F.col("h").isNotNull(), F.col("_g")).alias("on_template")
    )


@query(D.with_sql(D.PF) + """
SELECT match_id, slot, frame, CASE WHEN match_id % 3 = 0 THEN 'manual' WHEN match_id % 2 = 0 THEN 'detected' END AS chosen,
  round(CASE WHEN match_id % 3 = 0 THEN (x1 + x2) / 2 * 1e-2 + match_id WHEN match_id % 2 = 0 THEN (x1 + x2) / 2 * 2e-2 + 1 END, 6) AS px,
  round(CASE WHEN match_id % 3 = 0 THEN y2 * 2e-2 - match_id WHEN match_id % 2 = 0 THEN y2 * 3e-2 - 1 END, 6) AS py FROM pf""")
def homography_choice(spark, sf_dir):
    """Feet projected by the manual homography of a match, else by the detected one, else not at all."""
    pf = D.player_frames(spark, sf_dir).select("match_id", "slot", "frame", "x1", "x2", "y2")
    m = pf.select("match_id").distinct()
    manual = m.filter("match_id % 3 = 0").selectExpr("match_id", "array(0.01D, 0D, match_id * 1D, 0D, 0.02D, match_id * -1D, 0D, 0D, 1D) AS h")
    detected = m.filter("match_id % 2 = 0").selectExpr("match_id", "array(0.02D, 0D, 1D, 0D, 0.03D, -1D, 0D, 0D, 1D) AS h")
    j = court.choose_homography(pf, manual, detected, ["match_id"])
    x, y, h = G.feet_x("x1", "x2"), F.col("y2"), F.col("h")
    chosen = F.when(h.isNotNull(), F.when(h[0] == 0.01, "manual").otherwise("detected"))
    return j.select("match_id", "slot", "frame", chosen.alias("chosen"), F.round(G.project_x(h, x, y), 6).alias("px"), F.round(G.project_y(h, x, y), 6).alias("py"))


@query("""
WITH k AS (SELECT s_suppkey, kpt FROM supplier, (SELECT unnest([8, 9, 10, 11, 12, 13, 14, 15]) AS kpt) WHERE NOT ((s_suppkey % 10 = 9 AND kpt > 2) OR kpt % 7 = 6))
SELECT s_suppkey, 4 AS corners, 20e0 * 30 * 10 * 50 AS area FROM (SELECT DISTINCT s_suppkey FROM k)""")
def court_polygon(spark, sf_dir):
    """Hull of the visible outline points, checked by its corner count and area."""
    pts = _court_points(spark, sf_dir).filter(F.col("kpt").isin(court.POLYGON_POINTS) & ~F.col("hidden"))
    polys = court.court_polygons(pts.select("s_suppkey", "kpt", "x", "y"), ["s_suppkey"])
    n = F.size("polygon")
    cross = F.transform("polygon", lambda p, i: p["x"] * F.element_at("polygon", ((i + 1) % n) + 1)["y"] - F.element_at("polygon", ((i + 1) % n) + 1)["x"] * p["y"])
    return polys.select("s_suppkey", n.alias("corners"), F.round(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2, 6).alias("area"))
