"""Leads, CRM and audit rows stored in buckets of one id, so that their joins shuffle nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import joins
from .files import Folder


class ServingTables:
    """Tables <name>_leads, <name>_crm and <name>_audit under one folder, each bucketed and
    sorted by the lead's id in the same number of buckets. The catalogue of a session holds
    their layout; open() declares them in another session over the files that are there."""

    KEYS = {"leads": "id", "crm": "lead_id", "audit": "lead_id"}

    def __init__(self, spark: SparkSession, path: str, name: str = "serving", buckets: int = 64) -> None:
        self.spark, self.folder, self.name, self.buckets = spark, Folder(spark, path), name, buckets

    def build(self, **tables: DataFrame) -> None:
        """Write some of leads, crm and audit anew. A bucket is written by one task, whose
        rows are those of the bucket alone."""
        for part, df in tables.items():
            key = self.KEYS[part]
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
            spread = df.repartition(self.buckets, key)
            spread.write.mode("overwrite").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder.path}/{part}").saveAsTable(f"{self.name}_{part}")
            self.folder.write(f"{part}.ddl", f"{self.buckets} {df.schema.toDDL()}")

    def open(self) -> None:
        """Declare the tables that were built, in a session that does not know them."""
        for part, key in self.KEYS.items():
            if self.folder.has(f"{part}.ddl"):
                buckets, _, columns = self.folder.read(f"{part}.ddl").partition(" ")
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
                self.spark.sql(f"CREATE TABLE {self.name}_{part} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.folder.path}/{part}'")

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def view(self) -> DataFrame:
        """joins.lead_view() of the stored tables."""
        return joins.lead_view(self.table("leads"), self.table("crm"), self.table("audit"))
