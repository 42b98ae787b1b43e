"""Mixing sources to target weights by Pfair scheduling (native: DataFrame functions only on rows).

Each source's documents are shuffled by a hash and cut into blocks. With a target weight w, block j of a source may
run from slot floor(j / w) and must have run by slot ceil((j + 1) / w); earliest deadline first among the
released blocks then keeps every source within one block of its weight at every slot. Weights are
rounded to multiples of 1 / period, so the schedule repeats after `period` slots: one period is planned on
the driver (a list of `period` source names), and each row finds its slot from its block number alone.
Slots of a source that has no block left stay empty, so the others go on with their weights renormalised.

Row numbers within a source come from counts of small hashed cells, so that a source with a third of all rows
is numbered by many tasks.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Documents of a block; slots of a period at least; weight exponent; most sources that a mix may have.
BLOCK, PERIOD, EXPONENT, MAX_SOURCES = 64, 1024, 0.7, 1 << 15
#: Rows of a numbering cell, about.
CELL = 20_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole slots of a period: largest remainders, at least one slot for each positive weight."""
    positive = {s: w for s, w in weights.items() if w > 0}
    total = sum(positive.values())
    exact = {s: w / total * period for s, w in positive.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(positive, key=lambda s: (slots[s] - exact[s], s))
    while sum(slots.values()) < period:
        for s in order[: period - sum(slots.values())]:
            slots[s] += 1
    while sum(slots.values()) > period:
        slots[max(slots, key=lambda s: (slots[s] - exact[s] if slots[s] > 1 else -math.inf, s))] -= 1
    return slots


def plan_period(slots: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks, ties by name."""
    period = sum(slots.values())
    waiting = [(0, s, 0) for s in slots]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    plan = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-((j + 1) * period // -slots[s]), s, j))
        _, s, j = heapq.heappop(ready)
        plan.append(s)
        heapq.heappush(waiting, ((j + 1) * period // slots[s], s, j + 1))
    return plan


def tempered(counts: dict[str, int], exponent: float) -> dict[str, float]:
    """Target weights that lean from the sources' own sizes towards equal ones."""
    return {s: n**exponent for s, n in counts.items()}


def schedule(documents: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, exponent: float = EXPONENT, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", whole: bool | None = None) -> DataFrame:
    """(id, source, text_hash, block, slot, position, in_mix) for each row.

    `position` orders the mix, with gaps. A `whole` mix has all rows of its sources: one that has no block left leaves, and
    the others go on. Else it ends with the slot in which the first source has no block left, and rows from there on have
    in_mix false. By default a mix is whole unless `weights` are given. Without `weights` targets are the sources' sizes to the power `exponent`. Sources without
    a weight have no slot and aren't in the mix. A null source is the source ''; rows with equal ids are
    ordered by text, null ids first; identical rows have positions of their own, in either order. An empty table gives an
    empty schedule. Further columns are dropped.
    """
    spark = documents.sparkSession
    rows = pick(documents, id=id_column, source=source_column, text=text_column).select("id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("text_hash"))
    found = rows.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    counts = {r["source"]: r["n"] for r in found}
    whole = weights is None if whole is None else whole
    weights = tempered(counts, exponent) if weights is None else {s: w for s, w in weights.items() if w > 0 and s in counts}
    slots = shares(weights, max(period, 8 * len(weights))) if weights else {}
    plan = plan_period(slots)
    length, seen, places = len(plan), dict.fromkeys(slots, 0), []
    for slot, s in enumerate(plan):
        places.append((s, seen[s], slot, slots[s]))
        seen[s] += 1
    of = {(s, k): slot for s, k, slot, _ in places}
    end = min(((n := -(-counts[s] // block)) // slots[s] * length + of[s, n % slots[s]] for s in slots), default=0)

    cells = 1 << max(6, (max(counts.values(), default=1) // CELL).bit_length())
    placed = rows.withColumn("mixed", F.xxhash64(F.coalesce("id", F.lit(-1)))).withColumn("cell", F.pmod("mixed", F.lit(cells)).cast("int"))
    sizes = placed.groupBy("source", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "cell").orderBy("mixed", "id", "text_hash"))
    numbered = placed.withColumn("rank", rank).join(offsets.hint("shuffle_hash"), ["source", "cell"]).withColumn("number", F.col("before") + F.col("rank") - 1)
    table = spark.createDataFrame(places, "its string, turn int, at int, share int")
    shared = spark.createDataFrame(list(slots.items()), "of string, share int")
    blocks = numbered.withColumn("block", F.expr(f"number div {block}")).join(F.broadcast(shared), F.col("source") == F.col("of"), "left")
    turn = F.pmod("block", "share").cast("int")
    told = blocks.withColumn("turn_", turn).join(F.broadcast(table.drop("share")), (F.col("source") == F.col("its")) & (F.col("turn_") == F.col("turn")), "left")
    told = told.withColumn("slot", F.expr(f"(block div share) * {length} + at"))
    return told.select(
        F.col("id").alias(id_column),
        "source",
        "text_hash",
        "block",
        "slot",
        (F.col("slot") * block + F.pmod("number", F.lit(block))).alias("position"),
        (F.col("slot").isNotNull() if whole else F.coalesce(F.col("slot") < end, F.lit(False))).alias("in_mix"),
    )


def mix(documents: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, exponent: float = EXPONENT, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", whole: bool | None = None) -> DataFrame:
    """The documents of the mix in its order, in the columns of the input: those that `schedule` has in it.

    Rows that agree in id, source and text are in the mix as often as the schedule has them in it. Null ids and
    sources, empty tables and very long texts are as in `schedule`; further columns go along, whatever their names.
    """
    keys = ["id", "source", "text_hash"]
    chosen = schedule(documents, weights, block, period, exponent, id_column, source_column, text_column, whole).where("in_mix")
    chosen = chosen.select(F.col(id_column).alias("of_id"), F.col("source").alias("of_source"), F.col("text_hash").alias("of_hash"), "position")
    named = [F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{source_column}`"), F.lit("")).alias("source"), F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash")]
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), *named)
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("source") == F.col("of_source")) & (F.col("text_hash") == F.col("of_hash"))
    if not chosen.groupBy("of_id", "of_source", "of_hash").count().where("count > 1").isEmpty():
        chosen = chosen.withColumn("turn", F.row_number().over(Window.partitionBy("of_id", "of_source", "of_hash").orderBy("position")))
        rows = rows.withColumn("of_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
        same = same & (F.col("turn") == F.col("of_turn"))
    return rows.join(chosen, same).orderBy("position").select(*(F.col("row")[c].alias(c) for c in documents.columns))
