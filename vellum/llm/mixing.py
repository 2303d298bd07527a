"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks. Block k of a source of weight w/H (H slots make a period) may
take a slot from floor(k H / w) on and must have one before ceil((k + 1) H / w). In each slot the
block of earliest deadline goes among those released, so no source is ever a whole block
ahead of or behind its share. The pattern repeats with the period, so the driver schedules
one period, or, where that is longer, the slots until a source runs out; the place of every
block follows from its number by arithmetic. When a source runs out, a new phase begins in which the
others share its weight.
"""

from __future__ import annotations

import bisect
import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import row_numbers, table

BLOCK_ROWS = 64
#: Target weights of the production query; sources not named weigh REST.
WEIGHTS, REST = {"src0": 4.0}, 1.0
#: Slots of a pattern in one row of the plan, and blocks such a row stands for; rows numbered in one task.
PLAN_SLOTS, PLAN_BLOCKS, ROWS_NUMBERED = 65_536, 1 << 22, 20_000


def shares(weights: dict, period: int) -> dict:
    """Whole shares of a period in proportion to the weights, by largest remainders, at least 1 each."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    i = 0
    while (left := period - sum(out.values())) > 0:
        out[order[i % len(order)]] += 1
        i += 1
    while left < 0:
        largest = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1e9, str(s)))
        out[largest] -= 1
        left += 1
    return out


def exact_shares(weights: dict) -> dict:
    """The least whole shares in exactly the proportion of the weights, as their decimals are written."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * scale) for s, w in exact.items()}
    least = math.gcd(*whole.values())
    return {s: n // least for s, n in whole.items()}


def pattern(share: dict, most: dict | None = None) -> dict:
    """Earliest deadline first over one period: the slots of each source's blocks, in order.

    Ends early with the slot in which a source has had as many blocks as ``most`` gives it. Releases and
    deadlines are whole numbers of any size, so nothing is rounded and memory follows the slots used.
    """
    period = sum(share.values())
    names = sorted(share, key=str)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: dict = {s: array("q") for s in names}
    t = 0
    while t < period:
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        slots[names[i]].append(t)
        t += 1
        if most and k + 1 >= most[names[i]]:
            break
        if k + 1 < share[names[i]]:
            heapq.heappush(waiting, ((k + 1) * period // share[names[i]], i, k + 1))
    return slots


def phases(blocks: dict, weights: dict, period: int | None = None) -> list[dict]:
    """Rows (source, phase, start, stop, base, share, period, slots): where each source's blocks go.

    Without ``period``, shares are exactly in proportion to the weights, however long their period is.
    A phase that ends within its first period has as its period and shares what it used.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    base, phase, out = 0, 0, []
    while left:
        live = {s: weights[s] for s in left}
        share = shares(live, max(period, len(left))) if period else exact_shares(live)
        slots = pattern(share, left)
        if any(len(slots[s]) >= n for s, n in left.items()):  # a source has run out, in its last slot so far
            share, length = {s: len(slots[s]) for s in left}, sum(map(len, slots.values()))
            end = length
        else:
            length = sum(share.values())
            end = min((n - 1) // share[s] * length + slots[s][(n - 1) % share[s]] + 1 for s, n in left.items())
        for s in list(left):
            taken = end // length * share[s] + bisect.bisect_left(slots[s], end % length)
            start = blocks[s] - left[s]
            out.append({"source": s, "phase": phase, "start": start, "stop": start + taken, "base": base, "share": share[s], "period": length, "slots": slots[s]})
            left[s] -= taken
            if not left[s]:
                del left[s]
        base, phase = base + end, phase + 1
    return [r for r in out if r["stop"] > r["start"]]


def plan(rows: list[dict]) -> Iterator[tuple]:
    """Rows of ``phases`` in pieces: part of a pattern and how often it repeats. A pattern is sent once for every ``PLAN_BLOCKS`` blocks."""
    for r in rows:
        blocks = r["stop"] - r["start"]
        for first in range(0, min(len(r["slots"]), blocks), PLAN_SLOTS):
            part = r["slots"][first : first + PLAN_SLOTS].tolist()
            times = -(-(blocks - first) // r["share"])
            step = max(1, PLAN_BLOCKS // len(part))
            for t in range(0, times, step):
                yield r["source"], r["phase"], r["start"], r["stop"], r["base"], r["share"], r["period"], first, t, min(times, t + step), part


def mix(docs: DataFrame, weights: dict | None = None, rest: float = REST, block_rows: int = BLOCK_ROWS, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Give every document its place in a mix that follows the target weights of the sources.

    Returns id, source, block (number in the source), slot (of the block, gapless over all
    blocks), phase (0 until a source runs out) and position (slot * block_rows + place in the
    block), by which the mix is ordered. Every row has one place, none is dropped or repeated.
    Within a source the order is that of the id hash. A null source is a source of its own;
    repeated rows have places of their own; an empty table gives an empty one; other columns
    are never read. The driver holds one row for each source and phase.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(id_col).alias("h"))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {s: (weights or {}).get(s, rest) for s in counts}
    if any(w <= 0 for w in wanted.values()):
        raise ValueError("target weights must be positive")
    placed = phases({s: -(-n // block_rows) for s, n in counts.items()}, wanted, period)
    planned = spark.createDataFrame(list(plan(placed)), "s string, phase int, start long, stop long, base long, share long, period long, first long, low long, high long, slots array<long>")
    again = planned.select("*", F.explode(F.sequence("low", F.col("high") - 1)).alias("again"))
    each = again.select("s", "phase", "start", "stop", "base", "share", "period", "first", "again", F.posexplode("slots").alias("i", "at"))
    b = F.col("start") + F.col("again") * F.col("share") + F.col("first") + F.col("i")
    slots = each.withColumn("b", b).where(F.col("b") < F.col("stop")).select("s", "b", "phase", (F.col("base") + F.col("again") * F.col("period") + F.col("at")).alias("slot"))
    buckets = max(64, math.ceil(sum(counts.values()) / ROWS_NUMBERED))
    numbered = row_numbers(rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32)) * F.lit(buckets) / F.lit(float(1 << 32)))), ["source"], ["h", "id"], "bucket", "n")
    blocks = numbered.withColumn("block", F.floor(F.col("n") / block_rows))
    joined = blocks.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("block").cast("long").alias("block"), "slot", "phase", (F.col("slot") * block_rows + F.col("n") % block_rows).alias("position"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)
