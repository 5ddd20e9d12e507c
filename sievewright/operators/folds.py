"""Folds of ordered groups in parallel: next-fit batches and what still fits, whatever the size of one group.

Rows are range-partitioned by group and order into blocks of about equal size, written once. What a block does to a
running total is worked out without knowing the total it begins with; totals then go from block to block over a few rows
a block, and each block is folded by itself from the total that it was given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Stands for a total that nothing fits to, with which a group begins its first batch.
FULL = np.iinfo(np.int64).max // 4


def blocks(rows: DataFrame, by: str, order: str, cost: str, count: int | None = None) -> DataFrame:
    """Rows (group, order, cost as a whole number, null as 0) with the block that each falls to: groups one after another,
    each in order, cut into `count` parts (the session's shuffle partitions). Ties in order go by cost."""
    count = count or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.col(by).alias("group"), F.col(order).alias("order"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("cost"))
    cut = own.repartitionByRange(count, "group", "order", "cost").withColumn("block", F.spark_partition_id())
    return written(cut, "blocks")


def _runs(cut: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Of each block, by one task: the table of run(costs, rows, whether it begins or ends its block) for each run of one
    group in it."""
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [x.split(" ")[0] for x in schema.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            code = table.column("group").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(code)]):
                part = table.slice(a, b - a)
                out = run(part.column("cost").to_numpy(), part, a == 0 or b == len(code))
                if out is not None:
                    yield from out.select(columns).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and held[-1].column("block")[0].as_py() != block[a]:
                        yield from ended(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from ended(held)

    dealt = cut.repartitionById(n, F.pmod("block", F.lit(n))).sortWithinPartitions("block", "group", "order", "cost")
    return dealt.mapInArrow(over, schema)


def _summary(part: pa.Table, **values) -> pa.Table:
    """One row for a run: its block and group, and whole numbers or lists of them."""
    return _with(part.slice(0, 1).select(["block", "group"]), {k: pa.array([v], pa.list_(pa.int64()) if isinstance(v, list) else pa.int64()) for k, v in values.items()})


def _with(table: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    for name, values in columns.items():
        table = table.append_column(name, values)
    return table


def _typed(cut: DataFrame, *names: str) -> str:
    kinds = dict(cut.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


# --- next fit


def _starts(cost: np.ndarray, limit: int) -> np.ndarray:
    """For a batch that begins at each row, the row at which the next one does; the number of rows if none does."""
    upto = np.cumsum(cost)
    return np.maximum(np.searchsorted(upto, upto - cost + limit, side="right"), np.arange(1, len(cost) + 1))


def next_fit_map(cost: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a run of costs does to a batch in use by u: with i the first place where reach[i] > limit - u, it begins
    batches[i] batches and leaves the last one in use by left[i]; with no such place it begins none and leaves u + total.

    A batch can only end within the first rows that fit into one, so there are no more places than those rows.
    """
    upto, n = np.cumsum(cost), len(cost)
    after = np.append(_starts(cost, limit), n)
    last, batches = np.arange(n + 1), np.ones(n + 1, np.int64)
    jump = np.where(after < n, after, np.arange(n + 1))
    steps = (after < n).astype(np.int64)
    steps[n] = 0
    while True:  # the last batch that each leads to, by doubling the steps
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        steps = steps + steps[jump]
        jump = further
    last, batches = jump[:n], 1 + steps[:n]
    places = int(np.searchsorted(upto, limit, side="right")) + 1
    reach, many, left = upto[:places], batches[:places], (upto[-1] - upto + cost)[last][:places]
    keep = np.append((many[1:] != many[:-1]) | (left[1:] != left[:-1]), True)[: len(reach)]
    return reach[keep], many[keep], left[keep], int(upto[-1])


def next_fit(rows: DataFrame, by: str, order: str, cost: str, limit: int, count: int | None = None) -> DataFrame:
    """Rows (group, order, cost) of each group in order, in batches from 1: one that would exceed the limit begins the
    next. A row above the limit is a batch of its own.

    Only runs at the ends of blocks can be parts of a group that goes on in another; of those, two a block, the maps of
    `next_fit_map` are put together in order. Costs are whole numbers from 0; null ones count as 0.
    """
    cut = blocks(rows, by, order, cost, count)

    def ends(costs: np.ndarray, part: pa.Table, at_end: bool) -> pa.Table | None:
        if at_end:
            reach, many, left, total = next_fit_map(costs, limit)
            return _summary(part, reach=reach.tolist(), many=many.tolist(), left=left.tolist(), total=total)

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        out, batch, used = [], 0, FULL
        for r in frame.sort_values("block").itertuples(index=False):
            out.append((r.block, r.group, batch, used))
            i = int(np.searchsorted(np.asarray(r.reach), limit - used, side="right"))
            batch, used = (batch, used + r.total) if i == len(r.reach) else (batch + int(r.many[i]), int(r.left[i]))
        return pd.DataFrame(out, columns=["block", "group", "batch_in", "used_in"])

    entry = f"{_typed(cut, 'block', 'group')}, batch_in long, used_in long"
    maps = _runs(cut, ends, f"{_typed(cut, 'block', 'group')}, reach array<long>, many array<long>, left array<long>, total long")
    entries = written(maps.groupBy("group").applyInPandas(chain, entry), "entries")

    def deal(costs: np.ndarray, part: pa.Table, at_end: bool) -> pa.Table:
        used, batch = part.column("used_in")[0].as_py(), part.column("batch_in")[0].as_py()
        used, batch = (FULL, 0) if used is None else (used, batch)
        upto, after, n = np.cumsum(costs), _starts(costs, limit), len(costs)
        at = int(np.searchsorted(upto, limit - used, side="right"))
        starts = np.zeros(n, np.int64)
        while at < n:
            starts[at] = 1
            at = int(after[at])
        return _with(part, {"batch": pa.array(batch + np.cumsum(starts))})

    # two runs a block at most
    given = cut.join(F.broadcast(entries.select(F.col("block").alias("__b"), F.col("group").alias("__g"), "batch_in", "used_in")), (F.col("block") == F.col("__b")) & F.col("group").eqNullSafe(F.col("__g")), "left").drop("__b", "__g")
    out = _runs(given, deal, f"{_typed(cut, 'group', 'order', 'cost')}, batch long")
    return out.select(F.col("group").alias(by), F.col("order").alias(order), F.col("cost").alias(cost), "batch")


# --- whatever still fits


def _fit(cost: np.ndarray, room: int, most: int) -> np.ndarray:
    """Which costs are taken, in order, passing over those that exceed what room is left, `most` at most.

    From where it stands it takes all that fit one after another at once, then goes on behind the first that doesn't,
    among those that are small enough for what is left.
    """
    taken = np.zeros(len(cost), bool)
    at = np.flatnonzero(cost <= room)
    while len(at) and most > 0:
        upto = np.cumsum(cost[at])
        n = min(int(np.searchsorted(upto, room, side="right")), most)
        taken[at[:n]] = True
        room, most = room - (int(upto[n - 1]) if n else 0), most - n
        at = at[n + 1 :]
        at = at[cost[at] <= room]
    return taken


def fitting(rows: DataFrame, by: str, order: str, cost: str, limit: int, most: int | None = None, count: int | None = None) -> DataFrame:
    """Rows (group, order, cost) with `selected`: in order every row that still fits within the limit, passing over those
    that don't, `most` of a group at most.

    A group within one block is folded there. Of one that goes over several, a block is passed over if its smallest cost
    exceeds the room that is left, and taken whole if its sum fits; the others are opened, one of each group in a round.
    Once a row didn't fit, the room is less than that row, so few are. Sums and smallest costs, two rows a block at most,
    are on the driver.
    """
    everything = FULL if most is None else most
    cut = blocks(rows, by, order, cost, count)

    def ends(costs: np.ndarray, part: pa.Table, at_end: bool) -> pa.Table | None:
        return _summary(part, n=len(costs), total=int(costs.sum()), least=int(costs.min())) if at_end else None

    runs: dict = {}
    for r in _runs(cut, ends, f"{_typed(cut, 'block', 'group')}, n long, total long, least long").orderBy("block").collect():
        runs.setdefault(r.group, []).append(r)
    runs = {g: own for g, own in runs.items() if len(own) > 1}
    state = {g: [0, limit, everything] for g in runs}  # next run, room, rows that may still be taken
    entries: list[tuple] = []
    while True:
        asked = []
        for g, (at, room, left) in state.items():
            own = runs[g]
            while at < len(own):
                r = own[at]
                if left == 0 or r.least > room:
                    entries.append((r.block, g, 0, 0))
                elif r.total <= room and r.n <= left:
                    entries.append((r.block, g, room, left))
                    room, left = room - r.total, left - r.n
                else:
                    entries.append((r.block, g, room, left))
                    asked.append((r.block, g, room, left))
                    break
                at += 1
            state[g] = [at, room, left]
        if not asked:
            break
        schema = f"__b int, __g {dict(cut.dtypes)['group']}, room long, left long"
        ask = cut.sparkSession.createDataFrame(asked, schema)
        opened = cut.join(F.broadcast(ask), (F.col("block") == F.col("__b")) & F.col("group").eqNullSafe(F.col("__g"))).drop("__b", "__g")

        def weigh(costs: np.ndarray, part: pa.Table, at_end: bool) -> pa.Table:
            taken = _fit(costs, part.column("room")[0].as_py(), part.column("left")[0].as_py())
            return _summary(part, used=int(costs[taken].sum()), n=int(taken.sum()))

        for r in _runs(opened, weigh, f"{_typed(cut, 'group')}, used long, n long").collect():
            at, room, left = state[r.group]
            state[r.group] = [at + 1, room - r.used, left - r.n]

    given = cut.withColumns({"room": F.lit(None).cast("long"), "left": F.lit(None).cast("long")})
    if entries:
        known = cut.sparkSession.createDataFrame(entries, f"__b int, __g {dict(cut.dtypes)['group']}, room long, left long")
        given = cut.join(F.broadcast(known), (F.col("block") == F.col("__b")) & F.col("group").eqNullSafe(F.col("__g")), "left").drop("__b", "__g")

    def take(costs: np.ndarray, part: pa.Table, at_end: bool) -> pa.Table:
        room, left = part.column("room")[0].as_py(), part.column("left")[0].as_py()
        return _with(part, {"selected": pa.array(_fit(costs, *((limit, everything) if room is None else (room, left))))})

    out = _runs(given, take, f"{_typed(cut, 'group', 'order', 'cost')}, selected boolean")
    return out.select(F.col("group").alias(by), F.col("order").alias(order), F.col("cost").alias(cost), "selected")
