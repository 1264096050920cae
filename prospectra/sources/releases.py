"""Snapshots of places by release and region, published one by one.

A release is release=<token>/region=<name>/ under one folder and is visible once a marker
in _published names it; the marker holds the schema, so that tokens and regions stay texts
whatever they look like. Readers list the newest release alone and prune its regions.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.files import Folder


class ReleaseStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def releases(self) -> list[str]:
        """Published tokens, the oldest first: tokens sort by their dates."""
        return [n.rpartition("/")[2] for n in self.folder.names("_published/[!_]*")]

    def newest(self) -> str | None:
        return (self.releases() or [None])[-1]

    def publish(self, places: DataFrame, release: str, region: str = "region") -> None:
        """Write a release and make it visible. One that was left unfinished is written
        anew; one that is visible already is an error. Rows of a region are sorted by
        place, so that a box reads few row groups; rows with a null region are kept."""
        if release in self.releases():
            raise ValueError(f"release {release!r} is published already")
        rows = places.withColumnRenamed(region, "region").withColumn("region", F.col("region").cast("string"))
        by = [c for c in ("lat", "lon") if c in rows.columns]
        spread = rows.repartitionByRange("region", *by) if by else rows.repartition("region")
        spread.sortWithinPartitions("region", *by).write.mode("overwrite").partitionBy("region").parquet(f"{self.folder.path}/release={release}")
        kept = StructType([f for f in rows.schema if f.name != "region"])
        self.folder.write(f"_published/{release}", json.dumps({"schema": kept.jsonValue()}))

    def read(self, regions: Iterable[str] | None = None, release: str | None = None) -> DataFrame:
        """Rows of a release, by default the newest, with its token; only the folders of
        ``regions`` are read, if they are given."""
        release = release or self.newest()
        if release is None or release not in self.releases():
            raise LookupError(f"no release {release!r} in {self.folder.path}" if release else f"no release in {self.folder.path}")
        schema = StructType.fromJson(json.loads(self.folder.read(f"_published/{release}"))["schema"])
        rows = self.spark.read.schema(schema.add("release", "string").add("region", "string")).option("basePath", self.folder.path).parquet(f"{self.folder.path}/release={release}")
        rows = rows.filter(F.col("release") == release)
        return rows.filter(F.col("region").isin(list(regions))) if regions is not None else rows

    def in_box(self, bbox: tuple[float, float, float, float], regions: Iterable[str] | None = None, release: str | None = None) -> DataFrame:
        """Rows of read() inside (south, west, north, east), bounds included."""
        south, west, north, east = bbox
        return self.read(regions, release).filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))

    def prune(self, keep: int = 2) -> None:
        """Drop all but the newest releases; each goes out of sight before its rows go."""
        for old in self.releases()[:-keep]:
            self.folder.remove(f"_published/{old}")
            self.folder.remove(f"release={old}")
