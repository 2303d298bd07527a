"""K-d tree sharding with DataFrame functions only.

Documents are points in a metadata space: size, share of bytes beyond one per character,
and content hash. The tree is grown level by level. Each node splits along its widest
dimension at the byte-weighted median, which is found by distributed histograms over ever
finer digits of the coordinate, for all nodes of a level at once. Splitting ends when leaves
reach the target bytes. All coordinates are functions of the text, so equal texts share a shard
unless their group alone is too heavy for the balance; then the group is cut by document id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, row_numbers, table

DIMENSIONS = ("d_size", "d_wide", "d_hash")
#: Bits of a coordinate and of the hash that orders points of one coordinate.
COORDINATE, TIE = 36, 48
#: A bin of at most this share of the target bytes isn't refined any more.
TOLERANCE = 0.001
#: A group of equal texts heavier than this share of the target bytes, and than any single row, is cut into parts.
GROUP = 0.04
#: Rows of a table of nodes up to which it is broadcast (some 100 bytes each).
BROADCAST_NODES = 4096
#: Points of a bin that are put in order at once instead of being refined; rows numbered in one task.
BIN_POINTS, ROWS_NUMBERED = 4096, 20_000


def _digit_bits(nodes: int) -> int:
    """Bits of a digit: fewer for many nodes, so that bins stay few."""
    return 12 if nodes <= 64 else 6


def _scaled(c: str, low: float | None, high: float | None) -> Column:
    """A coordinate as an integer over the range that all documents span."""
    span = float(high - low) if high is not None and high > low else 1.0
    return F.floor((F.col(c) - F.lit(float(low or 0))) / F.lit(span) * F.lit(float((1 << COORDINATE) - 1))).cast("long")


def points(docs: DataFrame, shards: int | None, target_bytes: int | None, id_col: str, text_col: str) -> tuple[DataFrame, int, int, int]:
    """Rows (id, size, crc, coordinates, tie) by document; leaves, bytes and rows in all.

    ``tie`` is a hash of the text, and of the part of a group that is too heavy to stay whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h"),
            F.log2(size.cast("double")).alias("d_size"),
            ((F.octet_length(text) - F.char_length(text)) / size).alias("d_wide"),
        )
    )
    s = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest"), *[f(c).alias(f"{n}_{c}") for c in ("d_size", "d_wide") for n, f in (("low", F.min), ("high", F.max))]).first()
    total = s["bytes"] or 0
    leaves = shards or max(1, math.ceil(total / max(1, target_bytes or total)))
    limit = max(s["largest"] or 1, GROUP * total / leaves)
    # groups over the limit number at most total / limit, that is leaves / GROUP
    heavy = rows.groupBy("h", "size", "crc").agg(F.sum("size").alias("w")).where(F.col("w") > limit).select("h", "size", "crc", F.ceil(F.col("w") / F.lit(limit)).alias("parts")).collect()
    known = _table(docs.sparkSession, "h, size, crc, parts", [tuple(r) for r in heavy] or [(None,) * 4])
    marked = rows.join(known, ["h", "size", "crc"], "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0)
    scaled = marked.withColumns({c: _scaled(c, s[f"low_{c}"], s[f"high_{c}"]) for c in ("d_size", "d_wide")} | {"d_hash": F.shiftleft(F.col("crc"), COORDINATE - 32), "tie": F.shiftrightunsigned(F.xxhash64("h", "size", part), 64 - TIE)})
    return scaled.select("id", "size", "crc", *DIMENSIONS, "tie"), leaves, total, s["rows"]


def _table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of integers, doubles and strings with a row for each node of a level; broadcast while that is few, when a node may hold a large part of the rows."""
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else f"{x}L"
    out = spark.sql(f"select * from values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)} as t({columns})")
    return F.broadcast(out) if len(rows) <= BROADCAST_NODES else out


def _coordinate() -> Column:
    """The coordinate of a row in the dimension that the column dim names."""
    return F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS])


def _open_rows(groups: DataFrame, nodes: dict[int, tuple[str, float]], state: dict[int, tuple[int, int]], left: int) -> DataFrame:
    """Points of the open bins with k1 and their node's goal, less the bytes below the bin. ``left``: bits that aren't fixed."""
    low = max(0, left - TIE)  # of the coordinate
    rows = [(n, nodes[n][0], prefix >> max(0, TIE - left), prefix & ((1 << max(0, TIE - left)) - 1), float(nodes[n][1] - below)) for n, (prefix, below) in state.items()]
    asked = _table(groups.sparkSession, "n, dim, p1, p2, goal", rows)
    fixed = F.shiftright(_coordinate(), low) == F.col("p1")
    if left < TIE:
        fixed = fixed & (F.shiftright("tie", left) == F.col("p2"))
    return groups.join(asked, (F.col("node") == F.col("n")) & fixed).withColumn("k1", _coordinate())


def _crossing(bins: DataFrame, order: list[str]) -> dict[int, Row]:
    """For each node the bin in which the running sum of w reaches the goal. The driver holds a row a node."""
    sums = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return {r["node"]: r for r in sums.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal"))).collect()}


def _bounds(groups: DataFrame, nodes: dict[int, tuple[str, float]], slack: float) -> list[tuple[int, str, int, int]]:
    """(node, dimension, coordinate, tie) for each node (dimension, goal): the key at which bytes below come nearest to the goal.

    A key is a coordinate and a tie. Its digits are fixed from the highest down: one job bins the
    points of all open nodes by the next digit, and gives the bin in which each goal lies.
    Bins of few points are then put in order as they are.
    """
    out: list[tuple[int, str, int, int]] = []
    bits = _digit_bits(len(nodes))
    state, small = dict.fromkeys(nodes, (0, 0)), {}  # digits fixed so far, bytes below them

    def close(n: int, first: int, beyond: int, r: Row, below: int) -> None:
        before = below + r["upto"] - r["w"]
        key = first if nodes[n][1] - before < before + r["w"] - nodes[n][1] else beyond
        out.append((n, nodes[n][0], key >> TIE, key & ((1 << TIE) - 1)))

    left = COORDINATE + TIE
    while state and left:
        left -= bits
        digit = F.shiftright("k1", left - TIE) if left >= TIE else F.shiftright("tie", left)
        bins = _open_rows(groups, nodes, state, left + bits).groupBy("node", "goal", digit.bitwiseAND((1 << bits) - 1).alias("digit")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"))
        found = _crossing(bins, ["digit"])
        for n, (prefix, below) in list(state.items()):
            if (r := found.get(n)) is None:  # the goal is at the lower edge
                key = prefix << (left + bits)
                out.append((n, nodes[n][0], key >> TIE, key & ((1 << TIE) - 1)))
                del state[n]
                continue
            here = prefix << bits | r["digit"]
            if r["w"] <= slack or r["k"] == 1 or not left:
                close(n, here << left, (here + 1) << left, r, below)
                del state[n]
            else:
                state[n] = (here, below + r["upto"] - r["w"])
                if r["k"] <= BIN_POINTS:
                    small.setdefault(left, {})[n] = state.pop(n)
    for left, part in small.items():
        for n, r in _crossing(_open_rows(groups, nodes, part, left), ["k1", "tie"]).items():
            key = r["k1"] << TIE | r["tie"]
            close(n, key, key + 1, r, part[n][1])
    return out


def _moved(df: DataFrame, bounds: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """Rows at or beyond their node's bound go to its second child. Bounds, a row a node, join as a table."""
    beyond = F.struct(_coordinate(), F.col("tie")) >= F.struct("b1", "b2")
    joined = df.join(_table(df.sparkSession, "n, dim, b1, b2, to", bounds), F.col("node") == F.col("n"), "left")
    return joined.withColumn("node", F.when(F.col("n").isNotNull() & beyond, F.col("to")).otherwise(F.col("node"))).drop("n", "dim", "b1", "b2", "to")


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Give each document a shard of about ``target_bytes`` (or of 1/``shards`` of all bytes).

    Returns id, size (UTF-8 bytes plus 1; a null text counts as empty), text_crc32, law
    ("bytes"), shard, slot (gapless from 0 in each shard) and grown_shard (null). Equal texts share
    a shard, unless their group is heavier than GROUP of the target and than any single row: then
    it is cut into parts by id. Repeated rows stay rows of their own; an empty table gives an
    empty one; other columns are never read. The driver holds one row for each tree node, at most
    as many as there are shards.
    """
    rows, leaves, total, n_rows = points(docs, shards, target_bytes, id_col, text_col)
    groups = cut(rows.groupBy(*DIMENSIONS, "tie").agg(F.sum("size").alias("w"))).withColumn("node", F.lit(0).cast("long"))
    rows, nodes, depth = rows.withColumn("node", F.lit(0).cast("long")), {0: leaves} if total else {}, 0
    while open_ := {n: k for n, k in nodes.items() if k > 1}:
        stats = groups.where(F.col("node").isin(list(open_)) if len(open_) <= 64 else F.lit(True)).groupBy("node").agg(F.sum("w").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).collect()
        asked = {r["node"]: (max(DIMENSIONS, key=lambda d: r[f"max_{d}"] - r[f"min_{d}"]), r["bytes"] * (open_[r["node"]] // 2) / open_[r["node"]]) for r in stats if r["node"] in open_}
        bounds = [(*b, b[0] + open_[b[0]] // 2) for b in _bounds(groups, asked, tolerance * total / leaves)]
        for n, k in open_.items():
            nodes[n] = k // 2
            nodes[n + k // 2] = k - k // 2
        if bounds:
            groups, rows, depth = _moved(groups, bounds), _moved(rows, bounds), depth + 1
            if depth % 4 == 0:
                groups, rows = cut(groups), cut(rows)
    buckets = max(64, math.ceil(n_rows / (leaves * ROWS_NUMBERED)))
    placed = rows.select("id", "size", "crc", "node", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).alias("bucket"))
    slots = row_numbers(placed, ["node"], ["id", "crc"], "bucket", "slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in shards 0 to 7 of near equal bytes."""
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)
