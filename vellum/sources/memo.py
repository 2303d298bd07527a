"""A memo of results that survives the run: an immutable table a version, and numbered pointers to versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import listed, remove


class Memo:
    """Results by key, with the artefacts each of them stands on.

    A version is a folder that never changes. A run writes a new one and then a pointer file of the next number,
    which is created only if no other run has taken it: the last complete pointer names the version in force, so
    a run killed at any place leaves the version before. ``keep`` versions stay, older ones are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = ("path", "mtime", "size", "work_dir"), artefacts: str = "artefacts", keep: int = 2):
        self.spark, self.folder, self.key, self.artefacts, self.keep = spark, folder, list(key), artefacts, keep

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, version) of all complete pointers, in order."""
        found = sorted(int(f.name) for f in listed(self.spark, f"{self.folder}/pointers") if f.name.isdigit() and f.size)
        return [(n, self.spark.read.text(f"{self.folder}/pointers/{n:010d}").first()[0]) for n in found[-self.keep - 1 :]]

    def current(self) -> DataFrame | None:
        pointers = self._pointers()
        return self.spark.read.parquet(f"{self.folder}/{pointers[-1][1]}") if pointers else None

    def _publish(self, version: str) -> None:
        """Create the next pointer; an error if another run was first."""
        taken = [int(f.name) for f in listed(self.spark, f"{self.folder}/pointers") if f.name.isdigit()]
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers/{max(taken, default=0) + 1:010d}")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
        out.writeBytes(version)
        out.close()
        for number, old in self._pointers()[: -self.keep]:
            remove(self.spark, f"{self.folder}/{old}")
            remove(self.spark, f"{self.folder}/{old}-fresh")
            remove(self.spark, f"{self.folder}/pointers/{number:010d}")

    def valid(self, present: DataFrame | None) -> DataFrame | None:
        """Entries all of whose artefacts are in ``present`` (a column ``path``); all, if that isn't given."""
        entries = self.current()
        if entries is None or present is None:
            return entries
        # artefacts met one by one; an entry is valid if as many are there as it names
        named = entries.select(*self.key, F.explode(F.array_distinct(self.artefacts)).alias("_a"))
        there = named.join(present.select(F.col("path").alias("_a")).distinct(), "_a", "left_semi").groupBy(*self.key).agg(F.count(F.lit(1)).alias("_n"))
        on = [F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in self.key]
        return entries.alias("e").join(there.alias("t"), on, "left").where(F.coalesce("_n", F.lit(0)) == F.size(F.array_distinct(self.artefacts))).select("e.*")

    def run(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], present: DataFrame | None = None) -> DataFrame:
        """Results of all distinct requests, with ``redone``; only those without a valid entry are computed.

        ``compute`` gives for its requests rows of the key's columns, the artefacts and what else a result has. Results
        without artefacts are returned but not kept. Entries of other requests stay; null keys equal each other.
        """
        asked = requests.select(*self.key).distinct()
        same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.key]
        valid, entries = self.valid(present), self.current()
        misses = asked if valid is None else asked.alias("a").join(valid.alias("v"), same("a", "v"), "left_anti")
        version = f"version-{uuid.uuid4().hex}"
        fresh_at = f"{self.folder}/{version}-fresh"  # goes with its version
        compute(misses).write.parquet(fresh_at)
        fresh = self.spark.read.parquet(fresh_at)
        kept = fresh.where(F.size(self.artefacts) > 0)
        if entries is not None:
            kept = kept.unionByName(entries.alias("e").join(fresh.select(*self.key).alias("f"), same("e", "f"), "left_anti"))
        kept.write.parquet(f"{self.folder}/{version}")
        empty = fresh.where(F.size(self.artefacts) <= 0)
        self._publish(version)
        found = self.spark.read.parquet(f"{self.folder}/{version}").alias("m").join(asked.alias("a"), same("m", "a"), "left_semi")
        out = found.alias("m").join(fresh.select(*self.key, F.lit(True).alias("redone")).alias("f"), same("m", "f"), "left").select("m.*", F.coalesce("redone", F.lit(False)).alias("redone"))
        return out.unionByName(empty.withColumn("redone", F.lit(True)))
