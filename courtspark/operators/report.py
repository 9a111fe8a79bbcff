"""Match report and live snapshot."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.functions.labels import slot_dimension
from courtspark.operators import lifecycle, rallies, stats
from courtspark.session import materialise


class MatchTables:
    """Everything a report needs, from the last epoch of each match; parts are made when first asked for.

    Teams are learnt from all frames, warmup included; rallies, shots and movement from live
    frames only, with players outside the court left out of movement. Parts that several later
    steps read are written once to the shared folder; that also bounds what a lost executor costs.
    """

    def __init__(self, frames: DataFrame, players: DataFrame, shots: DataFrame, commands: DataFrame, min_frames: int = 240):
        self._frames, self._players, self._shots, self._commands, self._min_frames = frames, players, shots, commands, min_frames

    @cached_property
    def states(self) -> DataFrame:
        epochs = lifecycle.lifecycle_states(self._commands)
        last = epochs.groupBy("match_id").agg(F.max("epoch").alias("epoch"))
        return materialise(epochs.join(last, ["match_id", "epoch"], "left_semi"), "states")

    @cached_property
    def teams(self) -> DataFrame:
        return materialise(stats.team_locks(self._players, min_frames=self._min_frames), "teams")

    @cached_property
    def players(self) -> DataFrame:
        return materialise(lifecycle.live_rows(stats.attach_teams(self._players, self.teams), self.states), "live-players")

    @cached_property
    def shots(self) -> DataFrame:
        return lifecycle.live_rows(self._shots, self.states)

    @cached_property
    def slots(self) -> DataFrame:
        return materialise(stats.live_stats(self.players.filter("NOT outside_court"), self.shots), "slots")

    @cached_property
    def accepted(self) -> DataFrame:
        return materialise(rallies.accepted_shots(self.shots.select("match_id", "frame", "ord", "slot", "shot_type")), "accepted")

    @cached_property
    def rally_ends(self) -> DataFrame:
        # a live part starts mid-match, so positions are counted even where the full match is dense
        found = materialise(rallies.rallies(lifecycle.live_rows(self._frames, self.states)), "rallies")
        return materialise(rallies.rally_ends(found, rallies.shots_in_rallies(self.accepted, found), self.players), "rally-ends")

    @cached_property
    def score(self) -> DataFrame:
        return rallies.team_score(self.rally_ends)

    @cached_property
    def shot_log(self) -> DataFrame:
        return rallies.with_team(rallies.last_rows(self.accepted, 50), self.players)


def flat_report(t: MatchTables, fps: float = 30.0) -> DataFrame:
    """One flat row per match: lifecycle, duration, score, rallies and shot totals."""
    rally_count = t.rally_ends.groupBy("match_id").agg(F.count("*").alias("rallies"))
    score = t.score.groupBy("match_id").agg(
        F.sum(F.when(F.col("winner_team") == 0, F.col("points"))).alias("points_0"), F.sum(F.when(F.col("winner_team") == 1, F.col("points"))).alias("points_1")
    )
    totals = t.slots.groupBy("match_id").agg(F.sum("shots").alias("total_shots"), F.sum("frames_seen").alias("player_frames"))
    frames = F.coalesce(F.col("ended_at") - F.col("live_started_at"), F.lit(0))
    out = t.states.join(totals, "match_id", "left").join(rally_count, "match_id", "left").join(score, "match_id", "left")
    return out.select(
        "match_id", "state", "started_by", "live_started_at", "ended_at", frames.alias("duration_frames"),
        F.when(frames > 0, F.bround(frames / F.lit(fps or 30.0), 1)).otherwise(0.0).alias("duration_sec"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("points_0", "points_1", "rallies", "total_shots", "player_frames")],
    )


def match_report(t: MatchTables, fps: float = 30.0) -> DataFrame:
    """One nested document per match (four players, two teams, at most fifty log lines)."""
    flat = flat_report(t, fps)
    named = t.slots.join(F.broadcast(slot_dimension(t.slots.sparkSession)), "slot", "left")
    player = F.struct("slot", "name", "team", "active", "time_on_court", "distance_m", "shots", "shots_by_type", F.format_string("heat_P%d.png", "slot").alias("heatmap"))
    players = named.groupBy("match_id").agg(F.array_sort(F.collect_list(player), lambda a, b: a["slot"] - b["slot"]).alias("per_player"))
    rollup = stats.team_rollup(t.slots, t.score)
    teams = rollup.groupBy("match_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("team").cast("string"), F.struct("players", "shots", "points"))))).alias("per_team")
    )
    log = t.shot_log.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("frame", "ord", "slot", "shot_type", "team"))).alias("shot_log"))
    meta = F.struct("state", "started_by", "live_started_at", "ended_at", "duration_frames", "duration_sec", F.lit(fps).alias("fps"))
    doc = flat.join(players, "match_id", "left").join(teams, "match_id", "left").join(log, "match_id", "left")
    return doc.select(
        "match_id", meta.alias("meta"), F.array("points_0", "points_1").alias("score"), "rallies", "total_shots", "per_player", "per_team",
        F.coalesce("shot_log", F.array().cast(log.schema["shot_log"].dataType)).alias("shot_log"),
    )


def live_snapshot(t: MatchTables, recent: int = 15) -> DataFrame:
    """What a dashboard polls: slots with positions, teams, score and the newest shots."""
    report = match_report(t)
    where = t.slots.groupBy("match_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "court_x", "court_y"))).alias("positions"),
        F.sort_array(F.collect_set(F.when(F.col("active"), F.col("slot")))).alias("active_slots"),
    )
    teams = t.teams.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("slot", "team", F.bround("mean_y", 2).alias("mean_y")))).alias("teams"))
    newest = F.slice(F.reverse("shot_log"), 1, recent)
    out = report.join(where, "match_id", "left").join(teams, "match_id", "left")
    return out.select("match_id", "meta", "score", "rallies", "per_player", "positions", "active_slots", "teams", newest.alias("newest_shots"))


def report_list(reports: DataFrame) -> DataFrame:
    """Report headers, newest first; archived ones are left out."""
    return reports.filter("NOT coalesce(archived, false)").orderBy(F.col("match_id").desc())
