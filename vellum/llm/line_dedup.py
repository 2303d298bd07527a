"""Line dedup with levelled sorted runs of line hashes, with DataFrame functions only.

An index holds the first owner (document id) of every line seen so far, as runs: tables
bucketed and sorted by the line's 128-bit hash. A new batch is reduced to its distinct lines,
which are merge-anti-joined with every run; the batch then becomes a run of its own on level 0.
When a level has ``fanout`` runs, they are compacted to one run of the next level. As
all runs share the buckets of the batch's shuffle, the runs themselves are never shuffled for a join.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import scratch, table, written
from vellum.session import remove

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that a key needs to count as a line that may repeat.
LEAST = 10
#: Runs of a level before they are compacted, and batches of the production query.
FANOUT, BATCHES = 3, 4
#: A line with more than this share of a batch's lines meets the others by a broadcast: at most 1 / HOT such lines.
HOT = 1 / 1024
HASHES = ["h1", "h2"]
#: Null ids count as one document after all others.
NO_ID = (1 << 63) - 1


def key_of(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (id, row, pos, h1, h2) of the lines long enough; ``row`` is a hash that tells rows of one id apart."""
    lines = docs.select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "row", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keys.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineIndex:
    """The runs of one index, in a folder that driver and executors share.

    ``buckets`` is the number of shuffle partitions unless given; it stays the same for the index's life.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fanout: int = FANOUT, least: int = LEAST):
        self.spark, self.fanout, self.least = spark, fanout, least
        self.folder = folder or f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A run: one file a bucket, sorted by hash, under a new name. ``rows`` are dealt by hash."""
        name = f"lines_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.folder}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def _compact(self) -> None:
        """Levels with too many runs become one run of the next; known lines of a batch aren't kept."""
        level = 0
        while level < len(self.levels):
            if len(runs := self.levels[level]) >= self.fanout:
                merged = reduce(DataFrame.unionByName, [self.spark.table(r).where("not known") for r in runs])
                self._place(self._write(merged.repartition(self.buckets, *HASHES).select(*HASHES, "owner", F.lit(False).alias("known"), F.lit(False).alias("shared"), F.lit(0).cast("long").alias("n"))), level + 1)
                self.levels[level] = []
            level += 1

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch (id, text); gives (id, row, gone), the sorted places of lines that go.

        A line goes unless its document owns it. The owner is the least id of the first batch
        that held the line, so a batch that comes twice gives the same result twice.
        """
        return self.add_lines(lines_of(docs, self.least))

    def add_lines(self, lines: DataFrame) -> DataFrame:
        """``add`` for a batch given as rows of ``lines_of``, which are read more than once."""
        keys = lines.groupBy(*HASHES).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        for i, run in enumerate(self.runs()):
            before = self.spark.table(run).where("not known").select(*HASHES, F.col("owner").alias(f"o{i}"))
            keys = keys.join(before.hint("merge"), HASHES, "left")
        old = F.coalesce(*[F.col(f"o{i}") for i in range(len(self.runs()))], F.lit(None).cast("long"))
        owner = F.coalesce(old, F.col("first"))
        run = self._write(keys.select(*HASHES, owner.alias("owner"), old.isNotNull().alias("known"), ((F.col("first") != owner) | (F.col("last") != owner)).alias("shared"), "n"))
        self._place(run, 0)
        gone = self._gone(lines, run)
        self._compact()
        return gone

    def _gone(self, lines: DataFrame, run: str) -> DataFrame:
        shared = self.spark.table(run).where("shared").select(*[F.col(h).alias(f"_{h}") for h in HASHES], "owner", "n")
        total = self.spark.table(run).agg(F.sum("n")).first()[0] or 0
        same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
        hot = F.broadcast(shared.where(F.col("n") > total * HOT))
        known = lines.join(hot, same, "left")
        rest = known.where("owner is null").select(*lines.columns).join(shared.where(F.col("n") <= total * HOT).hint("merge"), same)
        found = known.where("owner is not null").unionByName(rest)
        return found.where(F.col("id") != F.col("owner")).groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    def close(self) -> None:
        """Forget the runs, compacted ones included, and remove their files; results of ``add`` that weren't stored are lost."""
        for run in self.names:
            self.spark.sql(f"drop table if exists {run}")
        remove(self.spark, self.folder)


def without(text: Column, gone: Column) -> Column:
    """The lines of ``text``, joined, less those at the sorted places ``gone`` (null: none).

    One character a line says whether it stays, and both lists are walked side by side, so long texts take linear time.
    """
    gap = lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1"))
    flags = F.array_join(F.zip_with(gone, F.concat(F.array(F.lit(-1)), gone), gap), "")
    stays = lambda line, flag: F.when(F.coalesce(flag, F.lit("0")) == "0", line)
    kept = F.zip_with(F.split(text, "\n", -1), F.split(flags, ""), stays)
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def boundaries(docs: DataFrame, batches: int) -> list[int]:
    """Upper ids of all batches but the last, by approximate quantiles of the ids."""
    at = docs.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    return sorted(set(at or []))


def dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Drop from each document the lines that a document of smaller id holds.

    Returns id, n_lines (before), n_dropped and kept (the other lines, joined by a newline). Lines
    are compared stripped and with A-Z lower-cased; shorter ones than ``least`` code points always stay. A line
    that repeats in its first document stays there each time. A null or empty text is one empty
    line. Rows of one id are one document and each gives its own row; rows with a null id are one document
    after all others. An empty table gives an empty one; other columns are never read.

    Batches are ranges of ids in rising order, so the first batch with a line holds its least id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    index, edges = LineIndex(spark, fanout=fanout, least=least), boundaries(rows, batches)
    lines, gone = written(lines_of(rows, least), "line-hashes"), []  # texts are read twice only: here and at the end
    for low, high in zip([None, *edges], [*edges, None]):
        batch = lines if low is None else lines.where(F.col("id") > low)
        gone.append(index.add_lines(batch if high is None else batch.where(F.col("id") <= high)))
    places = reduce(DataFrame.unionByName, gone).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "gone")
    joined = rows.withColumn("row", F.xxhash64("text")).join(places, (F.col("id") == F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    n_lines = F.size(F.split("text", "\n", -1)).cast("long")
    return joined.select(F.col("doc").alias(id_col), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), without(F.col("text"), F.col("gone")).alias("kept"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents without the lines that smaller ids hold."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
