"""Rally, statistics, lifecycle and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.operators import heatmap, lifecycle, rallies, report, stats
from courtspark.plans import domain as D
from courtspark.session import materialise

QUERIES, ORACLE = {}, {}
TEAM_FRAMES = 240
EARLY_FRAMES = 60  # for queries that also have to show teams in tables of few frames


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def teamed(spark, sf_dir, frames: int = TEAM_FRAMES):
    pf = D.player_frames(spark, sf_dir)
    return stats.attach_teams(pf, stats.team_locks(pf, min_frames=frames))


# --- SQL building blocks -------------------------------------------------------------------------
def lock_sql(frames: int) -> str:
    return f"""
obs AS (SELECT match_id, slot, frame, court_y, row_number() OVER (PARTITION BY match_id, slot ORDER BY frame) AS i FROM pf WHERE court_y IS NOT NULL),
lk AS (SELECT match_id, slot, max(frame) AS lock_frame,
        sum(court_y * CASE WHEN i = 1 THEN pow(98e-2, {frames - 1}) ELSE 2e-2 * pow(98e-2, {frames} - i) END) AS mean_y
      FROM obs WHERE i <= {frames} GROUP BY match_id, slot HAVING count(*) = {frames})"""


LOCK = lock_sql(TEAM_FRAMES)
TEAMED = """
pt AS (SELECT pf.*, CASE WHEN pf.frame >= lock_frame THEN CASE WHEN mean_y < 10 THEN 0 ELSE 1 END END AS team
       FROM pf LEFT JOIN lk USING (match_id, slot))"""


def rally_sql(fr="fr"):
    return f"""
aw AS (SELECT match_id, frame, seen, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame ROWS 9 PRECEDING) AS n10 FROM {fr}),
si AS (SELECT *, frame - lag(frame) OVER (PARTITION BY match_id ORDER BY frame) AS d FROM aw WHERE seen),
ii AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame) AS island FROM si),
r0 AS (SELECT match_id, min(CASE WHEN n10 >= 3 THEN frame END) AS start_frame, max(frame) + 12 AS end_frame FROM ii GROUP BY match_id, island),
ra AS (SELECT r0.match_id, start_frame, end_frame FROM r0 JOIN (SELECT match_id, max(frame) AS last FROM {fr} GROUP BY match_id) t
        ON t.match_id = r0.match_id AND end_frame <= last WHERE start_frame IS NOT NULL)"""


def cooldown_sql(sh="sh"):
    return f"""
cs AS (SELECT *, row_number() OVER (PARTITION BY match_id, slot ORDER BY frame) AS n FROM {sh}),
ac AS (
  SELECT match_id, slot, n, frame AS last, true AS ok FROM cs WHERE n = 1
  UNION ALL
  SELECT c.match_id, c.slot, c.n, CASE WHEN c.frame - a.last >= 8 THEN c.frame ELSE a.last END, c.frame - a.last >= 8
  FROM ac a JOIN cs c ON c.match_id = a.match_id AND c.slot = a.slot AND c.n = a.n + 1),
acc AS (SELECT cs.match_id, cs.frame, cs.ord, cs.slot, cs.shot_type FROM cs JOIN ac USING (match_id, slot, n) WHERE ok)"""


IN_RALLY = """
inr AS (SELECT acc.*, ra.start_frame, ra.end_frame FROM acc JOIN ra ON ra.match_id = acc.match_id AND acc.frame > ra.start_frame AND acc.frame <= ra.end_frame)"""


def ends_sql(pt="pt"):
    return f"""
hit AS (SELECT match_id, start_frame, count(*) AS shots_in_rally, max_by(slot, frame * 10 + ord) AS last_hitter FROM inr GROUP BY match_id, start_frame),
ends AS (SELECT ra.match_id, ra.start_frame, ra.end_frame, ra.end_frame - ra.start_frame AS duration_frames,
           coalesce(shots_in_rally, 0) AS shots_in_rally, last_hitter, p.team AS winner_team
         FROM ra LEFT JOIN hit USING (match_id, start_frame)
         LEFT JOIN {pt} p ON p.match_id = ra.match_id AND p.frame = ra.end_frame AND p.slot = last_hitter)"""


STATES = """
cmd AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame, CASE action WHEN 'reset' THEN 0 WHEN 'auto' THEN 1 WHEN 'start' THEN 2 ELSE 3 END) AS n FROM lc),
st AS (
  SELECT match_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS epoch, 'warmup' AS state, CAST(NULL AS VARCHAR) AS started_by,
    CAST(NULL AS BIGINT) AS live_started_at, CAST(NULL AS BIGINT) AS auto_start_frame, CAST(NULL AS BIGINT) AS ended_at, CAST(0 AS BIGINT) AS discarded
  FROM top
  UNION ALL
  SELECT s.match_id, c.n, s.epoch + CASE WHEN action = 'reset' THEN 1 ELSE 0 END,
    CASE WHEN action = 'reset' THEN 'warmup' WHEN action = 'auto' AND state = 'warmup' THEN 'live' WHEN action = 'start' AND state <> 'ended' THEN 'live'
         WHEN action = 'end' AND state = 'live' THEN 'ended' ELSE state END,
    CASE WHEN action = 'reset' THEN NULL WHEN action = 'auto' AND state = 'warmup' THEN 'auto' WHEN action = 'start' AND state <> 'ended' THEN 'button' ELSE started_by END,
    CASE WHEN action = 'reset' THEN NULL WHEN (action = 'auto' AND state = 'warmup') OR (action = 'start' AND state <> 'ended') THEN c.frame ELSE live_started_at END,
    CASE WHEN action = 'reset' THEN NULL WHEN action = 'auto' AND state = 'warmup' THEN c.frame ELSE auto_start_frame END,
    CASE WHEN action = 'reset' THEN NULL WHEN action = 'end' AND state = 'live' THEN c.frame ELSE ended_at END,
    CASE WHEN action = 'reset' THEN 0 WHEN action = 'start' AND state = 'live' AND started_by = 'auto' THEN c.frame - auto_start_frame ELSE discarded END
  FROM st s JOIN cmd c ON c.match_id = s.match_id AND c.n = s.n + 1),
fs AS (SELECT *, row_number() OVER (PARTITION BY match_id, epoch ORDER BY n DESC) AS r FROM st WHERE n > 0),
ep AS (SELECT match_id, epoch, state, started_by, live_started_at, auto_start_frame, ended_at, discarded AS discarded_warmup_frames FROM fs WHERE r = 1)"""

# the last epoch of each match, and the rows that count in it
LIVE = """
le AS (SELECT * FROM ep e WHERE epoch = (SELECT max(epoch) FROM ep x WHERE x.match_id = e.match_id)),
lp AS (SELECT pt.* FROM pt JOIN le USING (match_id) WHERE frame >= live_started_at AND (ended_at IS NULL OR frame < ended_at)),
lf AS (SELECT fr.* FROM fr JOIN le USING (match_id) WHERE frame >= live_started_at AND (ended_at IS NULL OR frame < ended_at)),
ls AS (SELECT sh.* FROM sh JOIN le USING (match_id) WHERE frame >= live_started_at AND (ended_at IS NULL OR frame < ended_at))"""


def movement_sql(src):
    return f"""
kn AS (SELECT match_id, slot, frame, sqrt(pow(court_x - lag(court_x) OVER w, 2) + pow(court_y - lag(court_y) OVER w, 2)) AS step
       FROM {src} WHERE court_x IS NOT NULL WINDOW w AS (PARTITION BY match_id, slot ORDER BY frame)),
gp AS (SELECT match_id, slot, frame, t_sec - lag(t_sec) OVER (PARTITION BY match_id, slot ORDER BY frame) AS gap FROM {src}),
mv AS (SELECT s.*, kn.step, CASE WHEN kn.step < 5 THEN kn.step ELSE 0 END AS moved, CASE WHEN gp.gap < 5 THEN gp.gap ELSE 0 END AS elapsed
       FROM {src} s LEFT JOIN kn USING (match_id, slot, frame) LEFT JOIN gp USING (match_id, slot, frame))"""


LAST = """max_by(x1, frame) AS x1, max_by(y1, frame) AS y1, max_by(x2, frame) AS x2, max_by(y2, frame) AS y2,
  max_by(court_x, frame) FILTER (court_x IS NOT NULL) AS court_x, max_by(court_y, frame) FILTER (court_x IS NOT NULL) AS court_y"""

SLOTS = """
tot AS (SELECT match_id, slot, count(*) AS frames_seen, round_even(sum(elapsed), 1) AS time_on_court, round_even(sum(moved), 1) AS distance_m,
          max_by(team, frame) FILTER (team IS NOT NULL) AS team, """ + LAST + """ FROM mv GROUP BY match_id, slot),
sc AS (SELECT match_id, slot, count(*) AS shots FROM ls GROUP BY match_id, slot),
sl AS (SELECT m.match_id, s.slot, team, tot.match_id IS NOT NULL AS active, coalesce(frames_seen, 0) AS frames_seen, coalesce(time_on_court, 0) AS time_on_court,
         coalesce(distance_m, 0) AS distance_m, coalesce(shots, 0) AS shots, x1, y1, x2, y2, court_x, court_y
       FROM (SELECT DISTINCT match_id FROM cp) m CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS slot) s
       LEFT JOIN tot ON tot.match_id = m.match_id AND tot.slot = s.slot LEFT JOIN sc ON sc.match_id = m.match_id AND sc.slot = s.slot)"""
COUNTED = "\ncp AS (SELECT * FROM lp WHERE NOT outside_court)"


# --- positions and movement ----------------------------------------------------------------------
@query(D.with_sql(D.PF, movement_sql("pf")) + f"""
SELECT match_id, slot, count(*) AS frames_seen, round_even(count(*) / 30e0, 1) AS time_on_court, round_even(sum(moved), 1) AS distance_m, {LAST}
FROM mv GROUP BY match_id, slot""")
def player_stats(spark, sf_dir):
    """A1 over W1."""
    return stats.batch_stats(D.player_frames(spark, sf_dir))


@query(D.with_sql(D.PF, movement_sql("pf")) + " SELECT event_id, round(step, 6) AS step_m, round(moved, 6) AS moved_m, elapsed AS elapsed_s FROM mv")
def step_distance(spark, sf_dir):
    """W1 and W2 per row."""
    m = stats.movement(D.player_frames(spark, sf_dir))
    return m.select("event_id", F.round("step_m", 6).alias("step_m"), F.round("moved_m", 6).alias("moved_m"), "elapsed_s")


@query(D.with_sql(D.PF, LOCK) + " SELECT match_id, slot, lock_frame, round(mean_y, 6) AS mean_y, CASE WHEN mean_y < 10 THEN 0 ELSE 1 END AS team FROM lk")
def team_lock(spark, sf_dir):
    """W6."""
    return stats.team_locks(D.player_frames(spark, sf_dir), min_frames=TEAM_FRAMES).withColumn("mean_y", F.round("mean_y", 6))


def buffer_sql(cap: int, drop: int, target: int) -> str:
    return D.with_sql(D.PF, f"""
v AS (SELECT match_id, slot, frame, court_x, court_y, row_number() OVER (PARTITION BY match_id, slot ORDER BY frame) AS i,
        count(*) OVER (PARTITION BY match_id, slot) AS n FROM pf WHERE court_x IS NOT NULL AND NOT outside_court),
b AS (SELECT *, CASE WHEN n <= {cap} THEN n ELSE {cap - drop + 1} + (n - {cap + 1}) % {drop} END AS len FROM v)""") + f"""
SELECT match_id, slot, frame, court_x, court_y, i - (n - len) - 1 AS buffer_idx, len AS buffer_len,
  len <= {target} OR (i - (n - len) - 1) % greatest(len // {target}, 1) = 0 AS kept_by_thinning
FROM b WHERE i > n - len"""


def _buffer(spark, sf_dir, cap: int, drop: int, target: int):
    buffer = stats.position_buffer(D.player_frames(spark, sf_dir), cap=cap, drop=drop)
    thinned = stats.thin(buffer, target).select("match_id", "slot", "frame", F.lit(True).alias("_k"))
    return buffer.join(thinned, ["match_id", "slot", "frame"], "left").withColumn("kept_by_thinning", F.coalesce("_k", F.lit(False))).drop("_k")


@query(buffer_sql(6000, 1000, 6000))
def position_buffer(spark, sf_dir):
    """W18."""
    return _buffer(spark, sf_dir, 6000, 1000, 6000)


@query(buffer_sql(60, 10, 20))
def position_buffer_overflow(spark, sf_dir):
    """W18 with a cap of 60 and drops of 10, so that the small tables overflow it."""
    return _buffer(spark, sf_dir, 60, 10, 20)


@query(D.with_sql(D.PF, """
bn AS (SELECT match_id, slot, round(court_x / 1e-1) * 1e-1 AS px, round(court_y / 1e-1) * 1e-1 AS py, count(*) AS n FROM pf
       WHERE court_x BETWEEN -1 AND 11 AND court_y BETWEEN -1 AND 21 GROUP BY ALL),
mo AS (SELECT match_id, slot, sum(n) AS t, sum(n * px) AS sx, sum(n * py) AS sy, sum(n * px * px) AS sxx, sum(n * px * py) AS sxy, sum(n * py * py) AS syy FROM bn GROUP BY ALL HAVING sum(n) >= 2),
ko AS (SELECT match_id, slot, t, (sxx - sx * sx / t) / (t - 1) * 225e-4 AS kxx, (sxy - sx * sy / t) / (t - 1) * 225e-4 AS kxy, (syy - sy * sy / t) / (t - 1) * 225e-4 AS kyy FROM mo),
kd AS (SELECT *, kxx * kyy - kxy * kxy AS det FROM ko),
g AS (SELECT ix, iy, ix * 10 / 119e0 AS gx, iy * 20 / 239e0 AS gy FROM (SELECT unnest(range(120)) AS ix) CROSS JOIN (SELECT unnest(range(240)) AS iy)),
d AS (SELECT b.match_id, b.slot, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix,
        sum(n * exp(-5e-1 * (kyy * pow(gx - px, 2) - 2 * kxy * (gx - px) * (gy - py) + kxx * pow(gy - py, 2)) / det)) / any_value(t * 2 * pi() * sqrt(det)) AS v
      FROM bn b JOIN kd k ON k.match_id = b.match_id AND k.slot = b.slot AND det > 1e-12 CROSS JOIN g GROUP BY ALL)""") + """
SELECT match_id, slot, iy, ix, CASE WHEN v >= 5e-2 * max(v) OVER (PARTITION BY match_id, slot) THEN round(v, 8) END AS density FROM d""")
def heat_grid(spark, sf_dir):
    """A22."""
    return heatmap.heat_grid(D.player_frames(spark, sf_dir)).withColumn("density", F.round("density", 8))


# --- rallies -------------------------------------------------------------------------------------
@query(D.with_sql(D.PF, D.FRAMES) + """
SELECT match_id, frame, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame ROWS 9 PRECEDING) >= 3 AS active FROM fr""")
def ball_active(spark, sf_dir):
    """W3."""
    return rallies.ball_active(D.frames(spark, sf_dir)).select("match_id", "frame", "active")


@query(D.with_sql(D.PF, D.FRAMES, """
sv AS (SELECT match_id, frame, frame - coalesce(lag(frame) OVER (PARTITION BY match_id ORDER BY frame), -1) - 1 AS still_frames FROM fr WHERE seen)""") + """
SELECT * FROM sv WHERE frame + 1 >= 22 AND still_frames >= 20""")
def serve_starts(spark, sf_dir):
    """W5."""
    return rallies.serve_starts(D.frames(spark, sf_dir), dense=True)


@query(D.with_sql(D.PF, D.FRAMES, rally_sql()) + " SELECT match_id, start_frame, end_frame FROM ra")
def rally_segments(spark, sf_dir):
    """W4."""
    return rallies.rallies(D.frames(spark, sf_dir), dense=True)


@query(D.with_sql(D.PF, D.SHOTS, cooldown_sql(), recursive=True) + " SELECT match_id, frame, ord, slot, shot_type FROM acc")
def shot_cooldown(spark, sf_dir):
    """W9."""
    return rallies.accepted_shots(D.shots(spark, sf_dir)).select("match_id", "frame", "ord", "slot", "shot_type")


def _in_rallies(spark, sf_dir):
    found = materialise(rallies.rallies(D.frames(spark, sf_dir), dense=True), "rallies")
    return found, rallies.shots_in_rallies(rallies.accepted_shots(D.shots(spark, sf_dir)), found)


@query(D.with_sql(D.PF, D.FRAMES, D.SHOTS, rally_sql(), cooldown_sql(), IN_RALLY, recursive=True) + " SELECT match_id, frame, ord, slot, shot_type, start_frame, end_frame FROM inr")
def rally_shots(spark, sf_dir):
    """W9 shots inside W4 rallies, by as-of scan."""
    return _in_rallies(spark, sf_dir)[1]


RALLY_CTES = (D.PF, D.FRAMES, D.SHOTS, LOCK, TEAMED, rally_sql(), cooldown_sql(), IN_RALLY, ends_sql())


@query(D.with_sql(*RALLY_CTES, recursive=True) + " SELECT * FROM ends")
def rally_winner(spark, sf_dir):
    """Rally ends with shot count, last hitter and coarse winner."""
    found, inside = _in_rallies(spark, sf_dir)
    return rallies.rally_ends(found, inside, teamed(spark, sf_dir))


@query(D.with_sql(*RALLY_CTES, recursive=True) + " SELECT match_id, winner_team, count(*) AS points FROM ends WHERE winner_team IN (0, 1) GROUP BY ALL")
def team_score(spark, sf_dir):
    """A5."""
    return rallies.team_score(rally_winner(spark, sf_dir))


EARLY_CTES = tuple(lock_sql(EARLY_FRAMES) if c == LOCK else c for c in RALLY_CTES)


@query(D.with_sql(*EARLY_CTES, recursive=True) + " SELECT match_id, winner_team, count(*) AS points FROM ends WHERE winner_team IN (0, 1) GROUP BY ALL")
def team_score_early(spark, sf_dir):
    """A5 with teams known after 60 observations."""
    found, inside = _in_rallies(spark, sf_dir)
    return rallies.team_score(rallies.rally_ends(found, inside, teamed(spark, sf_dir, EARLY_FRAMES)))


@query(D.with_sql(D.PF, D.SHOTS, LOCK, TEAMED, cooldown_sql(), """
rk AS (SELECT acc.*, pt.team, row_number() OVER (PARTITION BY acc.match_id ORDER BY acc.frame DESC, ord DESC) AS recency
       FROM acc LEFT JOIN pt ON pt.match_id = acc.match_id AND pt.frame = acc.frame AND pt.slot = acc.slot)""", recursive=True) + """
SELECT match_id, frame, ord, slot, shot_type, team, recency FROM rk WHERE recency <= 50""")
def shot_log_last50(spark, sf_dir):
    """T2 with J11."""
    shots = rallies.last_rows(rallies.accepted_shots(D.shots(spark, sf_dir)), 50)
    return rallies.with_team(shots, teamed(spark, sf_dir)).select("match_id", "frame", "ord", "slot", "shot_type", "team", "recency")


@query(D.with_sql(D.PF, D.SHOTS) + " SELECT match_id, slot, shot_type, count(*) AS shots FROM sh GROUP BY ALL")
def shot_by_type(spark, sf_dir):
    """A3, one row per map entry."""
    m = stats.shot_map(D.shots(spark, sf_dir))
    return m.select("match_id", "slot", F.explode("shots_by_type").alias("shot_type", "shots"))


# --- lifecycle and report ------------------------------------------------------------------------
@query(D.with_sql(D.PF, D.LIFECYCLE, STATES, recursive=True) + " SELECT * FROM ep")
def lifecycle_states(spark, sf_dir):
    """L1."""
    return lifecycle.lifecycle_states(D.lifecycle(spark, sf_dir))


@query(D.with_sql(D.PF, D.LIFECYCLE, STATES, recursive=True) + """
SELECT event_id, epoch FROM pf JOIN ep USING (match_id) WHERE NOT outside_court AND frame >= live_started_at AND (ended_at IS NULL OR frame < ended_at)""")
def live_gate(spark, sf_dir):
    """L2."""
    states = lifecycle.lifecycle_states(D.lifecycle(spark, sf_dir))
    return lifecycle.counted_players(D.player_frames(spark, sf_dir), states).select("event_id", "epoch")


@query(D.with_sql(D.PF, D.FRAMES, """
sv AS (SELECT match_id, frame, frame - coalesce(lag(frame) OVER (PARTITION BY match_id ORDER BY frame), -1) - 1 AS still_frames FROM fr WHERE seen)""") + """
SELECT match_id, min(frame) AS frame, 'auto' AS action FROM sv WHERE frame + 1 >= 22 AND still_frames >= 20 AND frame < 300 GROUP BY match_id""")
def auto_start(spark, sf_dir):
    """L3: first serve before a start command given in frame 300."""
    start = D.lifecycle(spark, sf_dir).filter("action = 'start'").withColumn("frame", F.lit(300).cast("bigint"))
    return lifecycle.auto_start(D.frames(spark, sf_dir), start, dense=True)


def match_tables(spark, sf_dir):
    return report.MatchTables(D.frames(spark, sf_dir), D.player_frames(spark, sf_dir), D.shots(spark, sf_dir), D.lifecycle(spark, sf_dir), TEAM_FRAMES)


LIVE_CTES = (D.PF, D.FRAMES, D.SHOTS, D.LIFECYCLE, STATES, LOCK, TEAMED, LIVE, COUNTED, movement_sql("cp"), SLOTS)
REPORT_CTES = (*LIVE_CTES, rally_sql("lf"), cooldown_sql("ls"), IN_RALLY, ends_sql("lp"))


@query(D.with_sql(*LIVE_CTES, recursive=True) + " SELECT * FROM sl")
def live_stats(spark, sf_dir):
    """A2 over live frames."""
    return match_tables(spark, sf_dir).slots.drop("shots_by_type")


@query(D.with_sql(*REPORT_CTES, recursive=True) + """
SELECT m.match_id, t.team, coalesce(players, 0) AS players, coalesce(shots, 0) AS shots, coalesce(points, 0) AS points
FROM (SELECT DISTINCT match_id FROM sl) m CROSS JOIN (SELECT unnest([0, 1]) AS team) t
LEFT JOIN (SELECT match_id, team, count(*) AS players, sum(shots) AS shots FROM sl GROUP BY ALL) s ON s.match_id = m.match_id AND s.team = t.team
LEFT JOIN (SELECT match_id, winner_team, count(*) AS points FROM ends WHERE winner_team IN (0, 1) GROUP BY ALL) e ON e.match_id = m.match_id AND e.winner_team = t.team""")
def team_rollup(spark, sf_dir):
    """A4."""
    t = match_tables(spark, sf_dir)
    return stats.team_rollup(t.slots, t.score)


@query(D.with_sql(*REPORT_CTES, recursive=True) + """
SELECT le.match_id, state, started_by, live_started_at, ended_at, coalesce(ended_at - live_started_at, 0) AS duration_frames,
  CASE WHEN coalesce(ended_at - live_started_at, 0) > 0 THEN round_even((ended_at - live_started_at) / 30e0, 1) ELSE 0 END AS duration_sec,
  (SELECT count(*) FROM ends e WHERE e.match_id = le.match_id AND winner_team = 0) AS points_0,
  (SELECT count(*) FROM ends e WHERE e.match_id = le.match_id AND winner_team = 1) AS points_1,
  (SELECT count(*) FROM ends e WHERE e.match_id = le.match_id) AS rallies,
  (SELECT sum(shots) FROM sl WHERE sl.match_id = le.match_id) AS total_shots,
  (SELECT sum(frames_seen) FROM sl WHERE sl.match_id = le.match_id) AS player_frames
FROM le""")
def match_report_flat(spark, sf_dir):
    """A6, flat part."""
    return report.flat_report(match_tables(spark, sf_dir))


@query()
def match_report(spark, sf_dir):
    """A6, nested document."""
    return report.match_report(match_tables(spark, sf_dir))


@query()
def live_snapshot(spark, sf_dir):
    """A24."""
    return report.live_snapshot(match_tables(spark, sf_dir))


@query(D.with_sql(*LIVE_CTES, recursive=True) + """
SELECT sl.match_id, slot, 'Player ' || slot AS name, team, active, time_on_court, distance_m, shots, coalesce(kinds, 0) AS kinds, CAST('heat_P' || slot || '.png' AS VARCHAR) AS heatmap
FROM sl LEFT JOIN (SELECT match_id, slot, count(DISTINCT shot_type) AS kinds FROM ls GROUP BY ALL) k USING (match_id, slot)""")
def report_players(spark, sf_dir):
    """The players of the nested document."""
    r = report.match_report(match_tables(spark, sf_dir)).select("match_id", F.explode("per_player").alias("p"))
    kinds = F.coalesce(F.size("p.shots_by_type"), F.lit(0))
    return r.select("match_id", *[f"p.{c}" for c in ("slot", "name", "team", "active", "time_on_court", "distance_m", "shots")], F.greatest(kinds, F.lit(0)).cast("bigint").alias("kinds"), "p.heatmap")


@query(D.with_sql(*REPORT_CTES, """
tl AS (SELECT acc.match_id, acc.frame, acc.ord, acc.slot, shot_type, lp.team, row_number() OVER (PARTITION BY acc.match_id ORDER BY acc.frame DESC, acc.ord DESC) AS i
       FROM acc LEFT JOIN lp ON lp.match_id = acc.match_id AND lp.frame = acc.frame AND lp.slot = acc.slot)""", recursive=True) + """
SELECT match_id, i AS place, frame, slot, shot_type, team FROM tl WHERE i <= 15""")
def snapshot_shots(spark, sf_dir):
    """The newest shots of the live snapshot in their order."""
    s = report.live_snapshot(match_tables(spark, sf_dir)).select("match_id", F.posexplode("newest_shots").alias("i", "s"))
    return s.select("match_id", (F.col("i") + 1).cast("bigint").alias("place"), "s.frame", "s.slot", "s.shot_type", "s.team")


@query(D.with_sql(*LIVE_CTES, recursive=True) + " SELECT match_id, slot, court_x, court_y, active FROM sl")
def snapshot_positions(spark, sf_dir):
    """Slots of the live snapshot with their positions and whether they are in play."""
    s = report.live_snapshot(match_tables(spark, sf_dir)).select("match_id", "active_slots", F.explode("positions").alias("p"))
    return s.select("match_id", "p.slot", "p.court_x", "p.court_y", F.array_contains("active_slots", F.col("p.slot")).alias("active"))
