"""Sources and sinks, as round trips: derived rows are written in each file format and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from courtspark.operators.rallies import last_rows
from courtspark.operators.report import report_list
from courtspark.operators.stats import shot_map
from courtspark.plans import data
from courtspark.plans import domain as D
from courtspark.session import fresh_dir
from courtspark.sources import readers, writers

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(D.with_sql(D.PF) + " SELECT CAST(match_id AS INT) AS source_id, frame, slot, x1, y2, court_x, court_y, false AS malformed FROM pf UNION ALL SELECT CAST(match_id AS INT), NULL, NULL, NULL, NULL, NULL, NULL, true FROM (SELECT DISTINCT match_id FROM pf)")
def results_roundtrip(spark, sf_dir):
    """Result lines, with a blank and a broken line per source."""
    out = fresh_dir(spark, "results")
    pf = D.player_frames(spark, sf_dir).withColumnRenamed("match_id", "source_id")
    writers.write_results(pf, out)
    broken = pf.select("source_id").distinct().select("source_id", F.explode(F.array(F.lit(""), F.lit('{"frame": 7, "players": [{'))).alias("value"))
    broken.write.mode("append").partitionBy("source_id").text(out)
    rows = readers.result_players(readers.results_lines(spark, out))
    return rows.select("source_id", "frame", "slot", "x1", "y2", "court_x", "court_y", "malformed")


@query(D.with_sql(D.DETS) + """
SELECT 'v' || match_id AS video, frame, round(frame / 30e0, 6) AS timestamp_s, model, row_number() OVER (PARTITION BY match_id, frame, model ORDER BY class_id, part, supp) - 1 AS det_idx, conf, class_id, [bx, bt] AS bbox FROM det""")
def analysis_roundtrip(spark, sf_dir):
    """Analysis documents."""
    out = fresh_dir(spark, "analysis")
    d = D.detections(spark, sf_dir).select(
        F.concat(F.lit("v"), "match_id").alias("video"), "frame", "model", F.struct("class_id", "part", "supp").alias("det_idx"), F.array("bx", "bt").alias("bbox"), F.col("conf").alias("confidence"), "class_id"
    )
    writers.write_analysis(d, out)
    rows = readers.analysis_detections(spark, out)
    return rows.select("video", "frame", F.round("timestamp_s", 6).alias("timestamp_s"), "model", "det_idx", "conf", "class_id", "bbox")


def _report_docs(spark, sf_dir):
    """A small document per match; three matches end in the same second."""
    m = D.player_frames(spark, sf_dir).groupBy("match_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("shots"))
    m = m.withColumn("at", F.timestamp_seconds(F.lit(1700000000) + F.expr("match_id div 3")))
    return m


REPORTS = """
rd AS (SELECT match_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS shots FROM pf GROUP BY match_id),
ri AS (SELECT *, strftime(make_timestamp((1700000000 + match_id // 3) * 1000000), '%Y%m%d_%H%M%S') AS base, row_number() OVER (PARTITION BY match_id // 3 ORDER BY match_id) AS i FROM rd),
rp AS (SELECT *, CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS report_id FROM ri)"""


@query(D.with_sql(D.PF, REPORTS) + " SELECT report_id AS match_id, 'cam' || match_id AS source, shots AS total_shots, n AS rallies, [0, 0] AS score FROM rp")
def reports_roundtrip(spark, sf_dir):
    """Reports saved under unique ids, with an unreadable file in the library, and listed."""
    out = fresh_dir(spark, "reports")
    empty = spark.createDataFrame([], "match_id STRING")
    numbered = writers.number_reports(_report_docs(spark, sf_dir), empty, "at", "match_id")
    meta = F.struct(F.concat(F.lit("cam"), "match_id").alias("source"))
    docs = numbered.select(F.col("report_id").alias("match_id"), meta.alias("meta"), F.col("shots").alias("total_shots"), F.col("n").alias("rallies"))
    writers.write_reports(docs, out)
    docs.limit(1).select(F.lit("20200101_000000").alias("match_id"), F.lit("{ not json").alias("value")).write.mode("append").partitionBy("match_id").text(out)
    listed = report_list(readers.reports(spark, out).withColumn("archived", F.lit(False)))
    return listed.select("match_id", "source", "total_shots", "rallies", "score")


DETAIL = """
pp AS (SELECT match_id, slot, CAST(slot % 2 AS INT) AS team, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS shots FROM pf GROUP BY match_id, slot),
tm AS (SELECT match_id, team, count(*) AS players, sum(shots) AS shots FROM pp GROUP BY ALL),
lo AS (SELECT match_id, slot, frame, shot_type, row_number() OVER (PARTITION BY match_id ORDER BY frame DESC, ord DESC) AS i FROM sh)"""


def _full_reports(spark, sf_dir):
    """The library of whole reports: players, teams and the newest fifty shots of each match."""
    out = fresh_dir(spark, "full-reports")
    pf, log_type = D.player_frames(spark, sf_dir), "array<struct<slot: int, team: int, type: string, frame: bigint>>"
    by_type = shot_map(D.shots(spark, sf_dir)).select("match_id", "slot", "shots_by_type")
    p = pf.groupBy("match_id", "slot").agg(F.count("*").alias("seen"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("shots")).join(by_type, ["match_id", "slot"], "left")
    p = p.withColumn("team", (F.col("slot") % 2).cast("int"))
    row = F.struct("slot", F.format_string("Player %d", "slot").alias("name"), "team", (F.col("seen") > 0).alias("active"), (F.col("seen") / 4).alias("time_on_court"), F.lit(0.5).alias("distance_m"), "shots", "shots_by_type")
    players = p.groupBy("match_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["slot"] - b["slot"]).alias("per_player"))
    t = p.groupBy("match_id", "team").agg(F.count("*").alias("players"), F.sum("shots").alias("shots"))
    team = F.struct(F.col("team").cast("string").alias("k"), F.struct("players", "shots", F.lit(0).cast("bigint").alias("points")).alias("v"))
    teams = t.groupBy("match_id").agg(F.map_from_entries(F.collect_list(team)).alias("per_team"))
    last = last_rows(D.shots(spark, sf_dir), 50).withColumn("team", (F.col("slot") % 2).cast("int"))
    item = F.struct("frame", "ord", F.struct("slot", "team", F.col("shot_type").alias("type"), "frame").alias("s"))
    log = last.groupBy("match_id").agg(F.sort_array(F.collect_list(item)).alias("_l")).select("match_id", F.transform("_l", lambda x: x["s"]).cast(log_type).alias("shot_log"))
    numbered = writers.number_reports(_report_docs(spark, sf_dir), spark.createDataFrame([], "match_id STRING"), "at", "match_id")
    docs = numbered.select("match_id", "report_id").join(players, "match_id").join(teams, "match_id").join(log, "match_id", "left")
    meta = F.struct(F.concat(F.lit("cam"), "match_id").alias("source"))
    writers.write_reports(docs.select(F.col("report_id").alias("match_id"), meta.alias("meta"), "per_player", "per_team", "shot_log"), out)
    return out


@query(D.with_sql(D.PF, D.SHOTS, REPORTS, DETAIL) + """
SELECT report_id AS match_id, 'player' AS part, slot AS item, 'Player ' || slot AS name, team, seen / 4e0 AS amount, pp.shots FROM pp JOIN rp USING (match_id)
UNION ALL SELECT report_id, 'team', team, NULL, team, tm.players * 1e0, tm.shots FROM tm JOIN rp USING (match_id)
UNION ALL SELECT report_id, 'type', slot, shot_type, NULL, NULL, count(*) FROM sh JOIN rp USING (match_id) GROUP BY report_id, slot, shot_type
UNION ALL SELECT report_id, 'shot', slot, shot_type, CAST(slot % 2 AS INT), frame * 1e0, NULL FROM lo JOIN rp USING (match_id) WHERE lo.i <= 50""")
def report_details_roundtrip(spark, sf_dir):
    """S3 and K3: players, teams, shot types and shot logs of whole reports, written and read back."""
    r = readers.reports(spark, _full_reports(spark, sf_dir))
    cols = "match_id STRING, part STRING, item INT, name STRING, team INT, amount DOUBLE, shots BIGINT"
    p = r.select("match_id", F.explode("per_player").alias("p"))
    t = r.select("match_id", F.explode("per_team").alias("k", "v")).withColumn("k", F.col("k").cast("int"))
    y = p.select("match_id", "p.slot", F.explode("p.shots_by_type").alias("k", "v"))
    s = r.select("match_id", F.explode("shot_log").alias("s"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = [
        p.select("match_id", F.lit("player"), "p.slot", "p.name", "p.team", "p.time_on_court", "p.shots"),
        t.select("match_id", F.lit("team"), "k", none("string"), "k", F.col("v.players").cast("double"), "v.shots"),
        y.select("match_id", F.lit("type"), "slot", "k", none("int"), none("double"), "v"),
        s.select("match_id", F.lit("shot"), "s.slot", "s.type", "s.team", F.col("s.frame").cast("double"), none("bigint")),
    ]
    return reduce(lambda a, b: a.union(b), rows).toDF(*[c.split()[0] for c in cols.split(", ")])


@query(D.with_sql(D.PF, D.SHOTS, REPORTS, DETAIL) + """
SELECT report_id AS match_id, 'cam' || match_id AS source, slot, pp.shots FROM pp JOIN rp USING (match_id) WHERE report_id = '20231114_221320_2'""")
def report_by_id(spark, sf_dir):
    """S3: one report of the library by its id; only its folder is read."""
    r = readers.reports(spark, _full_reports(spark, sf_dir), "20231114_221320_2")
    return r.select("match_id", "source", F.explode("per_player").alias("p")).select("match_id", "source", "p.slot", "p.shots")


@query(D.with_sql(D.PF, REPORTS) + " SELECT report_id AS match_id, shots AS total_shots, match_id % 4 = 1 AS archived FROM rp WHERE match_id % 5 <> 0")
def report_archive(spark, sf_dir):
    """K7: reports archived, then deleted, each change written as a new version of the library; the last one is read."""
    numbered = writers.number_reports(_report_docs(spark, sf_dir), spark.createDataFrame([], "match_id STRING"), "at", "match_id")
    lib = numbered.select(F.col("report_id").alias("match_id"), F.col("match_id").alias("m"), F.col("shots").alias("total_shots"))
    out = fresh_dir(spark, "library")
    writers.write_library(lib, out, 0)
    lib = spark.read.parquet(f"{out}/version=00000000")
    version = writers.change_library(spark, out, 0, lib.filter("m % 4 = 1"), lib.filter("false"))
    version = writers.change_library(spark, out, version, lib.filter("false"), lib.filter("m % 5 = 0"))
    return spark.read.parquet(f"{out}/version={version:08d}").select("match_id", "total_shots", "archived")


@query(D.with_sql(D.IMAGES, D.ANNS) + " SELECT video, img.image_id, frame_no, category_id, bx, bh, len(kp) AS n_kp FROM img JOIN annk USING (image_id)")
def coco_roundtrip(spark, sf_dir):
    """Annotation documents of a thousand images each."""
    out = fresh_dir(spark, "coco")
    images, anns = D.images(spark, sf_dir), D.annotations(spark, sf_dir)
    part = lambda c: F.floor(F.col(c) / 1000).alias("part")
    i = images.groupBy(part("image_id")).agg(F.collect_list(F.struct(F.col("image_id").alias("id"), F.concat_ws("/", "video", "file_name").alias("file_name"), "width", "height")).alias("images"))
    a = anns.groupBy(part("image_id")).agg(F.collect_list(F.struct("image_id", "category_id", "bbox", "keypoints")).alias("annotations"))
    i.join(a, "part", "left").drop("part").write.option("maxRecordsPerFile", 1).option("compression", "gzip").json(out)
    im, an, _ = readers.coco(spark, out)
    name = F.split("file_name", "/")
    j = im.select("image_id", name[0].alias("video"), F.regexp_extract(name[1], "([0-9]+)", 1).cast("bigint").alias("frame_no"))
    # what isn't asked for stays out of the join
    an = an.select("image_id", "category_id", F.col("bbox")[0].alias("bx"), F.col("bbox")[3].alias("bh"), F.size("keypoints").alias("n_kp"))
    return j.join(an, "image_id").select("video", "image_id", "frame_no", "category_id", "bx", "bh", "n_kp")


@query(D.with_sql(D.IMAGES, D.SHOTCSV) + " SELECT video, frame_no, category FROM sx WHERE has_shot")
def shot_csv_roundtrip(spark, sf_dir):
    """S5."""
    out = fresh_dir(spark, "shots")
    D.shot_csv(spark, sf_dir).select("file_name", "has_shot", "category", "video").write.partitionBy("video").option("sep", ";").option("header", True).csv(out)
    from courtspark.operators.datasets import shot_rows

    return shot_rows(readers.shot_csv(spark, out))


@query(D.with_sql(D.LABELS, data.EXT) + " SELECT split, CAST(cls AS DOUBLE) AS class_id, count(*) AS n, round(sum(CAST(string_split(rest, ' ')[1] AS DOUBLE)), 6) AS sum_cx FROM lx GROUP BY ALL")
def labels_roundtrip(spark, sf_dir):
    """Label files read back as numbers."""
    out = fresh_dir(spark, "labels")
    D.label_text(spark, sf_dir).select("split", F.col("line").alias("value")).write.partitionBy("split").text(out)
    rows = readers.label_text(spark, out)
    return rows.groupBy("split", F.element_at("fields", 1).alias("class_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("fields", 2)), 6).alias("sum_cx"))


@query(D.with_sql(D.IMAGES, D.ANNS, data.POINTS) + """
SELECT split, printf('%s_r%04d', kc.video, chunk) AS rally_id, count(*) AS frames, sum(cf.visible) AS visible, round(sum(round_even(x, 2)), 4) AS sum_x
FROM cf JOIN kc ON kc.video = cf.video AND kc.chunk = frame_no // 256 WHERE split = 'train' GROUP BY ALL""")
def trajectory_roundtrip(spark, sf_dir):
    """Trajectory CSVs, read through the training manifest."""
    out = fresh_dir(spark, "trajectories")
    writers.write_trajectories(data.trajectory_rows(spark, sf_dir), out)
    every = readers.trajectories(spark, out)
    rows = readers.trajectories(spark, out, writers.manifest(every).filter("split = 'train'"))
    return rows.groupBy("split", "rally_id").agg(F.count("*").alias("frames"), F.sum("Visibility").alias("visible"), F.round(F.sum("X"), 4).alias("sum_x"))


@query(D.with_sql(D.IMAGES, D.ANNS, D.LABELS, data.NUM, data.EXT) + f"""
SELECT {data.SPLIT85} AS split, printf('%s_frame_%06d', video, frame_no) AS image, {data.line_sql("'0'", *data.BOX)} AS line
FROM im JOIN ann USING (image_id) WHERE frame_no % 5 = 0 AND category_id = 1
UNION ALL SELECT CASE split WHEN 'valid' THEN 'val' ELSE 'train' END, 'rf_' || stem, '0 ' || rest FROM lx""")
def label_sink(spark, sf_dir):
    """K5: the ball set written as label lines and read back."""
    out = fresh_dir(spark, "label-sink")
    writers.write_labels(data.ball_labels(spark, sf_dir), out)
    parts = F.split("value", "\t")
    return spark.read.schema("value STRING, split STRING").text(out).select("split", parts[0].alias("image"), parts[1].alias("line"))


@query(D.with_sql(D.LOGS) + r" SELECT CAST(run_no AS VARCHAR) AS run_id, line_no, rtrim(regexp_replace(line, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g')) AS line FROM lg")
def logs_roundtrip(spark, sf_dir):
    """Numbered log lines in a folder per run."""
    out = fresh_dir(spark, "logs")
    D.log_lines(spark, sf_dir).select(F.concat(F.lit("r"), "run_no").alias("run_id"), F.concat_ws("\t", F.col("line_no").cast("string"), "line").alias("value")).write.partitionBy("run_id").text(out)
    return readers.log_lines(spark, out).withColumn("run_id", F.substring("run_id", 2, 20))


@query(D.with_sql(D.RUNS, data.RUN) + " SELECT run_id, epoch, time, map50 FROM rn")
def metrics_roundtrip(spark, sf_dir):
    """Metric CSVs with blank and malformed cells (a folder per hundred runs)."""
    out = fresh_dir(spark, "metrics")
    m = D.run_metrics(spark, sf_dir).selectExpr("CAST(CAST(run_id AS BIGINT) % 20 AS STRING) AS folder", "run_id AS run", "CAST(epoch AS STRING) AS epoch", "time", "map50")
    m.withColumnRenamed("folder", "run_id").write.partitionBy("run_id").option("header", True).csv(out)
    rows = readers.metrics_csv(spark, out, ["run", "epoch", "time", "map50"])
    return rows.select(F.col("run").cast("bigint").cast("string").alias("run_id"), "epoch", "time", "map50")


@query("SELECT 'cam' || s_suppkey AS source_id, s_suppkey * 1e0 AS first_x, CAST(1280 AS INT) AS frame_width FROM supplier WHERE s_suppkey % 7 <> 3")
def calibrations_roundtrip(spark, sf_dir):
    """Calibrations upserted, some deleted, written a line each and read back."""
    out = fresh_dir(spark, "calibrations")
    s = D.table(spark, sf_dir, "supplier").select("s_suppkey")
    corner = lambda dx: F.expr(f"array(array(s_suppkey + {dx}D, 10D), array(900D, 20D), array(1000D, 700D), array(50D, 710D))")
    v = lambda dx, at, gone: s.select(F.concat(F.lit("cam"), "s_suppkey").alias("source_id"), corner(dx).alias("image_corners"), F.lit(1280).alias("frame_width"), F.lit(720).alias("frame_height"), F.lit(at).alias("updated_at"), gone.alias("deleted"))
    log = v(5, 1, F.lit(False)).unionByName(v(0, 2, F.col("s_suppkey") % 7 == 3))
    writers.latest_version(log, "source_id", "updated_at").drop("updated_at").write.json(out)
    return readers.calibrations(spark, out).select("source_id", F.col("corners")[0]["x"].alias("first_x"), "frame_width")


@query(D.with_sql(D.PF) + " SELECT DISTINCT match_id, raw_id, CAST(5 - raw_id // 1000 AS INT) AS canonical_id FROM pf")
def mapping_roundtrip(spark, sf_dir):
    """K4 and S10."""
    out = fresh_dir(spark, "mapping")
    m = D.player_frames(spark, sf_dir).selectExpr("match_id", "raw_id", "CAST(5 - raw_id div 1000 AS INT) AS canonical_id").distinct()
    writers.write_mapping(m, out, config={"k": 4})
    return readers.reid_mapping(spark, out)


@query("SELECT 'lang=' || lang AS folder, count(*) AS records FROM documents GROUP BY ALL")
def file_inventory(spark, sf_dir):
    """Files and bytes per folder of a written set, checked against the records its files hold."""
    out = fresh_dir(spark, "files")
    D.table(spark, sf_dir, "documents").select("lang", F.lit("x").alias("value")).write.partitionBy("lang").text(out)
    files = readers.inventory(spark, out, "*.txt")
    return readers.image_counts(files).select("folder", F.expr("bytes div 2").alias("records"))


@query("SELECT 'source=' || source AS folder, CAST(sum(octet_length(encode(url)) + 1) AS BIGINT) AS length, round_even(sum(octet_length(encode(url)) + 1) / 1048576e0, 1) AS size_mb FROM (SELECT d.source, p.url FROM pages p JOIN documents d ON d.doc_id = p.page_id) GROUP BY ALL")
def recordings_list(spark, sf_dir):
    """Files with their size, the newest first: one file per document source."""
    out = fresh_dir(spark, "recordings")
    j = D.table(spark, sf_dir, "pages").select("page_id", "url").join(D.table(spark, sf_dir, "documents").selectExpr("doc_id AS page_id", "source"), "page_id")
    j.select("source", F.col("url").alias("value")).write.partitionBy("source").text(out)
    files = readers.inventory(spark, out, "*.txt").groupBy("folder").agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"), F.max("name").alias("name"), F.max("path").alias("path"))
    return readers.recordings(files).select("folder", "length", "size_mb")


@query(D.with_sql(D.PF) + " SELECT match_id, state, progress, error FROM (SELECT match_id, 'done' AS state, 1e0 AS progress, NULL AS error FROM (SELECT DISTINCT match_id FROM pf) WHERE match_id % 3 <> 0 UNION ALL SELECT match_id, 'error', 0.5e0, 'decode' FROM (SELECT DISTINCT match_id FROM pf) WHERE match_id % 3 = 0)")
def job_state(spark, sf_dir):
    """K8: newest state of each analysis job."""
    m = D.player_frames(spark, sf_dir).select("match_id").distinct()
    running = m.selectExpr("match_id", "'running' AS state", "0.5D AS progress", "CAST(NULL AS STRING) AS error", "1 AS updated_at", "false AS deleted")
    done = m.selectExpr("match_id", "CASE WHEN match_id % 3 = 0 THEN 'error' ELSE 'done' END AS state", "CASE WHEN match_id % 3 = 0 THEN 0.5D ELSE 1D END AS progress", "CASE WHEN match_id % 3 = 0 THEN 'decode' END AS error", "2 AS updated_at", "false AS deleted")
    return writers.latest_version(running.unionByName(done), "match_id", "updated_at").drop("updated_at")
