"""Ordered computations over one long key, split into frame blocks.

``Window.partitionBy(match_id)`` puts a whole match in one task. A match may hold a
third of all rows, so every ordered operator here works on *blocks* of ``span``
consecutive order values instead:

1. each block is summarised with a map-side combined ``groupBy`` (one row per block);
2. the summaries, and only they, are scanned in order per key;
3. each block runs its own window, starting from the state carried in by step 2.

The big table is shuffled once, by (keys, block). Results equal the unsplit window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SPAN = 1 << 16
FOLD_SPAN = 1 << 12  # folds keep a block's order values in one array, so they use shorter blocks
BLK = "_blk"


@dataclass(frozen=True)
class Lane:
    """One ordered sequence per key: ``order`` is a whole number, ``ties`` make the order total."""

    keys: tuple[str, ...]
    order: str = "frame"
    ties: tuple[str, ...] = ()
    span: int = DEFAULT_SPAN

    @property
    def block(self) -> Column:
        return F.floor(F.col(self.order) / F.lit(self.span)).cast("bigint")

    @property
    def position(self) -> Column:
        return F.struct(self.order, *self.ties) if self.ties else F.col(self.order)

    def ordering(self, descending: bool = False) -> list[Column]:
        cols = [F.col(c) for c in (self.order, *self.ties)]
        return [c.desc() for c in cols] if descending else cols

    def in_block(self, descending: bool = False) -> Window:
        return Window.partitionBy(*self.keys, BLK).orderBy(*self.ordering(descending))

    def over_blocks(self, descending: bool = False) -> Window:
        blk = F.col(BLK)
        return Window.partitionBy(*self.keys).orderBy(blk.desc() if descending else blk)


@dataclass(frozen=True)
class Prev:
    """Value on the row just before (null on the first row)."""

    expr: Column


@dataclass(frozen=True)
class Next:
    """Value on the row just after."""

    expr: Column


@dataclass(frozen=True)
class LastSeen:
    """Last non-null value before the row, or up to and including it."""

    expr: Column
    include_current: bool = True


@dataclass(frozen=True)
class NextSeen:
    """First non-null value after the row, or from it on."""

    expr: Column
    include_current: bool = True


@dataclass(frozen=True)
class RunningSum:
    """Sum of all rows up to and including the row."""

    expr: Column


@dataclass(frozen=True)
class Total:
    """Sum over the whole lane, the same on each row."""

    expr: Column


@dataclass(frozen=True)
class RowNumber:
    """1-based position in the lane."""

    expr: Column = field(default_factory=lambda: F.lit(1))


ROW = "_row"


def dealt(df: DataFrame, lane: Lane) -> DataFrame:
    """``df`` dealt out by (keys, block), its columns packed as one value.

    A summary of the blocks and the rows that it is joined to then ask for the same exchange, whichever columns each of
    them needs, so the input is read and shuffled once. Rows with a null key or order belong to no lane.
    """
    known = lane.block.isNotNull()
    for k in lane.keys:
        known = known & F.col(k).isNotNull()
    rows = df.filter(known).select(*lane.keys, lane.block.alias(BLK), F.struct(*[c for c in df.columns if c not in (*lane.keys, BLK)]).alias(ROW))
    return rows.repartition(*lane.keys, BLK)


def whole(rows: DataFrame, lane: Lane) -> DataFrame:
    """The rows of ``dealt`` with their columns, read in a way that keeps the optimizer from shuffling only some of them."""
    row = F.element_at(F.array(ROW), 1)
    return rows.select(*lane.keys, BLK, ROW, *[row[c].alias(c) for c in rows.schema[ROW].dataType.names])


def scan(df: DataFrame, lane: Lane, **specs) -> DataFrame:
    """Add one column per spec. All specs share a single read and shuffle of ``df``."""
    columns = df.columns
    rows = dealt(df, lane)
    df = whole(rows, lane)
    ahead = Window.unboundedPreceding
    aggs, carries, outs = [], [], []
    ranked = {"_rank": F.row_number().over(lane.in_block())}
    if any(isinstance(s, Next) for s in specs.values()):
        ranked["_rank_desc"] = F.row_number().over(lane.in_block(True))

    for name, spec in specs.items():
        s, c = f"_s_{name}", f"_c_{name}"
        backwards = isinstance(spec, (Next, NextSeen))
        rows = lane.in_block(backwards)
        blocks = lane.over_blocks(backwards)
        pick = F.min_by if backwards else F.max_by
        if isinstance(spec, (Prev, Next)):
            aggs.append(pick(spec.expr, lane.position).alias(s))
            carries.append(F.lag(s).over(blocks).alias(c))
            rank = "_rank_desc" if backwards else "_rank"
            value = F.when(F.col(rank) == 1, F.col(c)).otherwise(F.lag(spec.expr).over(rows))
        elif isinstance(spec, (LastSeen, NextSeen)):
            aggs.append(pick(spec.expr, F.when(spec.expr.isNotNull(), lane.position)).alias(s))
            carries.append(F.last(s, ignorenulls=True).over(blocks.rowsBetween(ahead, -1)).alias(c))
            upto = 0 if spec.include_current else -1
            inside = F.last(spec.expr, ignorenulls=True).over(rows.rowsBetween(ahead, upto))
            value = F.coalesce(inside, F.col(c))
        elif isinstance(spec, (RunningSum, RowNumber)):
            aggs.append(F.sum(spec.expr).alias(s))
            carries.append(F.coalesce(F.sum(s).over(blocks.rowsBetween(ahead, -1)), F.lit(0)).alias(c))
            value = F.col(c) + F.coalesce(F.sum(spec.expr).over(rows.rowsBetween(ahead, 0)), F.lit(0))
        elif isinstance(spec, Total):
            aggs.append(F.sum(spec.expr).alias(s))
            carries.append(F.sum(s).over(blocks.rowsBetween(ahead, Window.unboundedFollowing)).alias(c))
            value = F.col(c)
        else:
            raise TypeError(f"unknown scan spec {spec!r}")
        outs.append(value.alias(name))

    key_cols = [*lane.keys, BLK]
    carry = df.groupBy(*key_cols).agg(*aggs, F.max(lane.order).alias("_last")).filter("_last IS NOT NULL").select(*key_cols, *carries)
    joined = df.join(carry, key_cols)
    needs_rank = any(isinstance(s, (Prev, Next)) for s in specs.values())
    if needs_rank:
        joined = joined.select("*", *[e.alias(n) for n, e in ranked.items()])
    keep = [c for c in columns if c != BLK and c not in specs]
    return joined.select(*keep, *outs)


def trailing(df: DataFrame, lane: Lane, n: int, **specs) -> DataFrame:
    """ROWS n-1 PRECEDING..CURRENT. Each spec is ``(kind, column)``, kind in sum, count, avg, list.

    ``list`` gives an array of structs ``{v}`` (nulls kept), oldest first.
    """
    columns = df.columns
    df = whole(dealt(df, lane), lane)
    key_cols = [*lane.keys, BLK]
    halo = n - 1
    values = F.struct(*[e.alias(name) for name, (_, e) in specs.items()])
    tails = (
        df.select(*key_cols, *{lane.order, *lane.ties} - set(key_cols), values.alias("_v"))
        .withColumn("_back", F.row_number().over(lane.in_block(True)))
        .filter(F.col("_back") <= halo)
        .groupBy(*key_cols)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("p"), F.col("_v").alias("v")))).alias("_t"))
    )
    recent = F.flatten(F.collect_list("_t").over(lane.over_blocks().rowsBetween(-halo, -1)))
    carry = tails.select(*key_cols, recent.alias("_recent")).select(
        *key_cols, F.transform(_last_of("_recent", F.lit(halo)), lambda r: r["v"]).alias("_halo")
    )
    rows = lane.in_block()
    sliding = rows.rowsBetween(-halo, 0)
    joined = df.join(carry, key_cols, "left").withColumn("_rank", F.row_number().over(rows))
    missing = F.lit(n) - F.col("_rank")
    border = F.coalesce(_last_of("_halo", missing), F.array().cast(_halo_type(df, values)))
    outs = []
    for name, (kind, expr) in specs.items():
        part = border[name]
        at_border = F.col("_rank") < n
        if kind == "list":
            inside = F.collect_list(F.struct(expr.alias("v"))).over(sliding)
            wrapped = F.transform(part, lambda v: F.struct(v.alias("v")))
            out = F.when(at_border, F.concat(wrapped, inside)).otherwise(inside)
        else:
            known = F.filter(part, lambda v: v.isNotNull())
            count = F.count(expr).over(sliding) + F.when(at_border, F.size(known)).otherwise(0)
            extra = F.aggregate(known, F.lit(0.0), lambda a, v: a + v.cast("double"))
            total = F.coalesce(F.sum(expr).over(sliding), F.lit(0)).cast("double") + F.when(
                at_border, extra
            ).otherwise(0.0)
            out = {"sum": total, "count": count, "avg": F.when(count > 0, total / count)}[kind]
        outs.append(out.alias(name))
    keep = [c for c in columns if c != BLK and c not in specs]
    return joined.select(*keep, *outs)


def _halo_type(df: DataFrame, values: Column) -> T.ArrayType:
    return T.ArrayType(df.select(values.alias("v")).schema["v"].dataType)


def _last_of(name: str, m: Column) -> Column:
    arr = F.col(name)
    return F.slice(arr, F.greatest(F.size(arr) - m, F.lit(0)) + 1, F.greatest(m, F.lit(0)))


def _rounds(df: DataFrame, lane: Lane) -> int:
    """Doublings after which a scan over any lane's blocks is complete; 0 if no lane has a second block."""
    low, high = df.agg(F.min(lane.block), F.max(lane.block)).first()
    return 0 if low is None else int(high - low).bit_length()


def _composed(summary: DataFrame, lane: Lane, state: list[str], rounds: int, compose) -> DataFrame:
    """The columns ``state`` of each block replaced by the composition of all blocks of the lane up to it.

    ``compose(before)`` gives the new columns from those of the stretch before, as a function of its column names. Each
    round doubles the stretch that a block stands for, so blocks are never walked one by one.
    """
    for k in range(rounds):
        before = {c: f"_p{c}" for c in state}
        summary = summary.select("*", *[F.lag(c, 1 << k).over(lane.over_blocks()).alias(p) for c, p in before.items()])
        there = F.col(before[state[0]]).isNotNull()
        kept = [c for c in summary.columns if c not in state and c not in before.values()]
        # new names first: inside a lambda a name may be taken for the new column of that name
        summary = summary.select(*kept, *[F.when(there, e).otherwise(F.col(c)).alias(f"_q{c}") for c, e in compose(before).items()])
        summary = summary.select(*kept, *[F.col(f"_q{c}").alias(c) for c in state])
    return summary


def greedy_spacing(df: DataFrame, lane: Lane, gap: int, limit: int | None = None) -> DataFrame:
    """Keep the first row of each lane, then every row at least ``gap`` after the last kept one.

    The state entering a block is the first order value allowed again. Only ``gap``
    different states matter, so a block is summarised by its outcome for each of them,
    the outcomes are composed over the blocks of a lane, and the blocks then run independently.
    Where no lane has a second block there is nothing to compose and each block runs once.
    """
    payload = [c for c in df.columns if c not in lane.keys and c != lane.order]
    key_cols = [*lane.keys, BLK]
    item = F.struct(F.col(lane.order).cast("bigint").alias("at"), *payload)
    known = lane.block.isNotNull()
    for k in lane.keys:
        known = known & F.col(k).isNotNull()
    df = df.filter(known)
    rounds = _rounds(df, lane)
    blocks = (
        df.withColumn(BLK, lane.block)
        .groupBy(*key_cols)
        .agg(F.sort_array(F.collect_list(F.struct(F.struct(*[F.col(c) for c in (lane.order, *lane.ties)]).alias("o"), item.alias("i")))).alias("_a"))
        .select(*key_cols, F.transform("_a", lambda r: r["i"]).alias("_rows"))
    )
    start = F.col(BLK) * F.lit(lane.span)
    if rounds:
        big = lambda c: c.cast("bigint")

        def run(ready: Column) -> Column:
            return F.aggregate(
                "_rows",
                F.struct(big(ready).alias("ready"), big(F.lit(0)).alias("n")),
                lambda s, r: F.when(r["at"] >= s["ready"], F.struct(big(r["at"] + gap).alias("ready"), (s["n"] + big(F.lit(1))).alias("n"))).otherwise(s),
            )

        outcome = F.transform(F.sequence(F.lit(0), F.lit(gap - 1)), lambda e: run(start + e))
        summary = blocks.select(*key_cols, outcome.alias("_out"))
        outs = [F.transform("_out", lambda s: s["ready"]).alias("_ready"), F.transform("_out", lambda s: s["n"]).alias("_n")]
        summary = summary.select(*key_cols, start.alias("_from"), *outs)

        def compose(before: dict) -> dict:
            entry = lambda r: F.greatest(F.least(r - F.col("_from"), F.lit(gap - 1)), F.lit(0)).cast("int")
            n = F.zip_with(before["_n"], before["_ready"], lambda n, r: n + F.get("_n", entry(r)))
            return {"_from": F.col(before["_from"]), "_ready": F.transform(before["_ready"], lambda r: F.get("_ready", entry(r))), "_n": n}

        summary = _composed(summary, lane, ["_from", "_ready", "_n"], rounds, compose)
        came = lambda c: F.lag(F.get(c, F.lit(0))).over(lane.over_blocks())
        entry = summary.select(*key_cols, F.greatest(F.coalesce(came("_ready"), start), start).alias("_entry"), F.coalesce(came("_n"), F.lit(0)).alias("_done"))
        blocks = blocks.join(entry, key_cols)
    else:
        blocks = blocks.withColumn("_entry", start).withColumn("_done", F.lit(0))
    kept = F.aggregate(
        "_rows",
        F.struct(F.col("_entry").cast("bigint").alias("ready"), F.slice("_rows", 1, 0).alias("kept")),
        lambda s, r: F.when(
            r["at"] >= s["ready"],
            F.struct((r["at"] + gap).cast("bigint").alias("ready"), F.concat(s["kept"], F.array(r)).alias("kept")),
        ).otherwise(s),
        lambda s: s["kept"],
    )
    out = blocks.select(*lane.keys, "_done", F.posexplode(kept).alias("_i", "_r"))
    if limit is not None:
        out = out.filter(F.col("_done") + F.col("_i") < limit)
    order_type = df.schema[lane.order].dataType
    return out.select(*lane.keys, F.col("_r.at").cast(order_type).alias(lane.order), *[F.col(f"_r.{c}").alias(c) for c in payload])


def ema(df: DataFrame, lane: Lane, alpha: float, initial: float | None = None, **specs) -> DataFrame:
    """Exponential moving average ``y = (1-a)*y + a*x``; nulls leave y unchanged.

    The first value seeds y unless ``initial`` is given.

    Inside a block y is a scaled prefix sum (weights grow towards the current row, so no
    cancellation); a block is an affine map of y, and the maps are composed over the blocks of a lane.
    """
    keep_per_row = 1.0 - alpha
    longest = int(600.0 / -np.log2(keep_per_row)) if keep_per_row > 0 else lane.span
    if lane.span > longest:
        lane = Lane(lane.keys, lane.order, lane.ties, max(1, longest))
    columns = df.columns
    rounds = _rounds(df, lane)
    df = whole(dealt(df, lane), lane)
    key_cols = [*lane.keys, BLK]
    upto = lane.in_block().rowsBetween(Window.unboundedPreceding, 0)
    parts, tails = df, []
    for name, expr in specs.items():
        i = F.count(expr).over(upto)
        scaled = F.when(expr.isNotNull(), F.lit(alpha) * expr.cast("double") * F.pow(F.lit(keep_per_row), -i.cast("double")))
        parts = parts.withColumn(f"_i_{name}", i).withColumn(f"_x_{name}", scaled)
    for name in specs:
        local = F.coalesce(F.sum(f"_x_{name}").over(upto), F.lit(0.0)) * F.pow(F.lit(keep_per_row), F.col(f"_i_{name}").cast("double"))
        first = F.first(F.when(F.col(f"_i_{name}") == 1, specs[name]), ignorenulls=True).over(upto)
        parts = parts.withColumn(f"_y_{name}", local).withColumn(f"_f_{name}", first.cast("double"))
        tails += [F.max_by(f"_y_{name}", lane.position).alias(f"_y_{name}"), F.max(f"_i_{name}").alias(f"_i_{name}"), F.max_by(f"_f_{name}", lane.position).alias(f"_f_{name}")]
    if rounds:
        summary = parts.groupBy(*key_cols).agg(*tails)
        entries = []
        for name in specs:
            y, factor, n, first = f"_y_{name}", f"_a_{name}", f"_i_{name}", f"_f_{name}"
            summary = summary.withColumn(factor, F.pow(F.lit(keep_per_row), F.col(n).cast("double")))
            # the lane's first value seeds y, as if y had equalled it beforehand
            seed = F.lit(initial).cast("double") if initial is not None else F.first(first, ignorenulls=True).over(lane.over_blocks().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            seen = F.coalesce(F.sum(n).over(lane.over_blocks().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            summary = summary.withColumn(f"_s_{name}", seed).withColumn(f"_n_{name}", seen)
            summary = _composed(summary, lane, [factor, y], rounds, lambda p, a=factor, y=y: {a: F.col(p[a]) * F.col(a), y: F.col(y) + F.col(a) * F.col(p[y])})
            came = F.lag(y).over(lane.over_blocks()) + F.lag(factor).over(lane.over_blocks()) * F.col(f"_s_{name}")
            entries.append(F.when(F.col(f"_n_{name}") > 0, came).otherwise(F.lit(initial).cast("double")).alias(f"_e_{name}"))
        joined = parts.join(summary.select(*key_cols, *entries), key_cols, "left")
    else:
        joined = parts.select("*", *[F.lit(None).cast("double").alias(f"_e_{name}") for name in specs])
    if initial is not None:
        joined = joined.na.fill(initial, [f"_e_{name}" for name in specs])
    outs = []
    for name in specs:
        seed = F.coalesce(F.col(f"_e_{name}"), F.col(f"_f_{name}"))
        outs.append((F.col(f"_y_{name}") + seed * F.pow(F.lit(keep_per_row), F.col(f"_i_{name}").cast("double"))).alias(name))
    keep = [c for c in columns if c != BLK and c not in specs]
    return joined.select(*keep, *outs)
