"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a 64-bit ring, each document hashes to a place on it and belongs to the next point
clockwise. No shard takes more than (1 + spare) times the mean load: what a full shard can't take goes on clockwise to
the next shard with room. All documents before the same point meet the same shards in the same order, so the
allocation is worked out on the loads of the arcs between points (a fixed number), each arc cut where a shard is full;
documents then find their shard by their place in the running load of their arc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm.common import small, stored, text_or_empty
from courtspark.llm.words import mix

SHARDS = 8
#: Points of each shard on the ring.
POINTS = 512
#: Load above the mean that a shard may hold (besides the one document that a cut would split).
SPARE = 0.001
#: Documents of an arc that one task puts in order; larger arcs are taken in several parts.
BLOCK = 100_000


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted points, their shards); the points of a shard don't depend on how many other shards there are."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), points)
    place = mix(mix(shard + np.uint64(1)) + np.tile(np.arange(points, dtype=np.uint64), shards))
    order = np.argsort(place, kind="stable")
    return place[order], shard[order].astype(np.int64)


def allocation(owner: np.ndarray, load: np.ndarray, shards: int, spare: float) -> list[tuple[int, int, int]]:
    """(arc, load before, shard): how each arc's load is cut up so that no shard gets more than its bound."""
    room = [int(np.ceil((1 + spare) * load.sum() / shards))] * shards
    waiting = [(arc, 0, arc) for arc in range(len(owner)) if load[arc]]  # (arc, load placed so far, point it has come to)
    out = []
    while waiting:
        later = []
        for arc, done, point in waiting:
            shard = int(owner[point])
            taken = min(room[shard], int(load[arc]) - done)
            if taken:
                out.append((arc, done, shard))
                room[shard] -= taken
                done += taken
            if done < load[arc]:
                while room[int(owner[point])] == 0:  # clockwise to the next shard that has room
                    point = (point + 1) % len(owner)
                later.append((arc, done, point))
        waiting = later
    return sorted(out)


def sharded(
    docs: DataFrame, shards: int = SHARDS, points: int = POINTS, spare: float = SPARE, by: str = "bytes", text: str = "text", id: str = "doc_id",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row per document.

    ``size`` is the text's UTF-8 bytes plus one (a null text has none), the load it brings unless ``by`` is "rows".
    Shards fill up to (1 + ``spare``) times the mean load, plus less than one document. ``slot`` numbers a shard's
    documents from 0 without gaps. Documents hash by id (those without one by text); repeated rows are placed one by one.
    """
    place, owner = ring(shards, points)
    arcs = len(place)
    body = text_or_empty(text)
    key = F.when(F.col(id).isNull(), F.xxhash64(body)).otherwise(F.xxhash64(F.col(id)))
    chosen = docs.select(
        F.col(id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), key.alias("spot"),
        F.monotonically_increasing_id().alias("lane"),
    )
    kind = docs.schema[id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arc = np.searchsorted(place, b.column(3).to_numpy().view(np.uint64)) % arcs
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arc)], [*b.schema.names, "arc"])

    rows = stored(chosen.mapInArrow(find, f"doc_id {kind}, size long, text_crc32 long, spot long, lane long, arc long"), "ring")
    weight = F.col("size") if by == "bytes" else F.lit(1).cast("long")
    load, count = np.zeros(arcs, np.int64), np.zeros(arcs, np.int64)
    for r in rows.groupBy("arc").agg(F.sum(weight).alias("load"), F.count("*").alias("n")).collect():  # one row per arc
        load[r.arc], count[r.arc] = r.load, r.n
    plan = np.array(allocation(owner, load, shards, spare), dtype=np.int64).reshape(-1, 3)
    before = np.cumsum(load) - load  # a place on the running load of the whole ring stands for arc and place in the arc
    cuts, target = before[plan[:, 0]] + plan[:, 1], plan[:, 2]

    # place of each document in its arc: parts of large arcs are summed up first
    parts = F.element_at(F.lit(np.maximum(1, -(-count // BLOCK)).tolist()), (F.col("arc") + 1).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("lane"), parts.cast("long")))
    sums = rows.groupBy("arc", "part").agg(F.sum(weight).alias("load"), F.count("*").alias("n"))
    earlier = Window.partitionBy("arc").orderBy("part")
    base = sums.select("arc", "part", (F.sum("load").over(earlier) - F.col("load")).alias("base_load"), (F.sum("n").over(earlier) - F.col("n")).alias("base_n"))
    inside = Window.partitionBy("arc", "part").orderBy("spot", "lane")
    at = rows.select("*", (F.sum(weight).over(inside) - weight).alias("inside_load"), (F.row_number().over(inside) - 1).alias("inside_n"))
    at = at.join(small(stored(base, "ring-parts")), ["arc", "part"])
    at = at.select("doc_id", "size", "text_crc32", "arc", (F.col("base_load") + F.col("inside_load")).alias("load"), (F.col("base_n") + F.col("inside_n")).alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arc, start = (b.column(k).to_numpy() for k in (3, 4))
            piece = np.searchsorted(cuts, before[arc] + start, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(piece), b.column(5)], ["doc_id", "size", "text_crc32", "piece", "n"])

    placed = stored(at.mapInArrow(cut, f"doc_id {kind}, size long, text_crc32 long, piece long, n long"), "placed")
    shift = np.zeros(len(cuts), np.int64)  # slot minus place in the arc, for each piece
    filled = [0] * shards
    for r in sorted(placed.groupBy("piece").agg(F.min("n").alias("first"), F.count("*").alias("rows")).collect()):  # a few per arc at most
        shard = int(target[r.piece])
        shift[r.piece] = filled[shard] - r.first
        filled[shard] += r.rows

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            piece, n = b.column(3).to_numpy(), b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(target[piece].astype(np.int32)), pa.array(shift[piece] + n)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    return placed.mapInArrow(number, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
