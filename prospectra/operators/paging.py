"""Deep pages of a sorted list: after a given row, or by number from stored ranges."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Folder
from .serving import SORTS


@dataclass(frozen=True)
class Key:
    """A column of an order, its direction and the place of its nulls."""

    column: str
    down: bool = False
    nulls_last: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        if self.down:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def turned(self) -> Key:
        return Key(self.column, not self.down, not self.nulls_last)

    def after(self, value: Any) -> Column:
        """The column stands strictly after ``value`` in this order."""
        c = F.col(self.column)
        if value is None:
            return F.lit(False) if self.nulls_last else c.isNotNull()
        later = c < F.lit(value) if self.down else c > F.lit(value)
        return F.coalesce(later, F.lit(self.nulls_last))


def sort_keys(sort: str | None = None, order: str = "asc") -> list[Key]:
    """The order of serving.sort_order() as keys; the id makes it total."""
    down = str(order).lower() == "desc"
    last = down or sort in ("score", "updated")
    rest = [] if sort == "updated" else [Key("name")]
    return [Key(SORTS.get(sort or "", "tier"), down, last), *rest, Key("id")]


def after(keys: list[Key], row: dict[str, Any]) -> Column:
    """Rows that come strictly after ``row``, nulls in their place: equal in the first keys
    and later in the next, for each number of first keys."""
    found, equal = F.lit(False), F.lit(True)
    for k in keys:
        value = row[k.column]
        found |= equal & k.after(value)
        equal &= F.col(k.column).eqNullSafe(F.lit(value))
    return found


def next_page(view: DataFrame, row: dict[str, Any] | None = None, size: int = 50, sort: str | None = None, order: str = "asc", back: bool = False) -> DataFrame:
    """The ``size`` rows after ``row`` (a row of the page before, or any values of the
    order's columns), from the start without one; with ``back`` those just before it. The
    cost does not grow with depth, as an offset's does."""
    keys = sort_keys(sort, order)
    ahead = [k.turned() for k in keys] if back else keys
    rows = view if row is None else view.filter(after(ahead, row))
    found = rows.orderBy(*[k.order() for k in ahead]).limit(size)
    return found.orderBy(*[k.order() for k in keys]) if back else found


class SortedPages:
    """A list that is stored in its order, in ranges of rows, with the number of rows of
    each: any page is read from the one or two ranges that hold it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def build(self, view: DataFrame, sort: str | None = None, order: str = "asc", ranges: int | None = None) -> None:
        """Store the list in ``ranges`` ranges, or in as many as Spark takes for its size."""
        by = [k.order() for k in sort_keys(sort, order)]
        spread = view.repartitionByRange(ranges, *by) if ranges else view.repartitionByRange(*by)
        placed = spread.withColumn("_range", F.spark_partition_id())
        placed.sortWithinPartitions("_range", *by).write.mode("overwrite").partitionBy("_range").parquet(f"{self.folder.path}/rows")
        self.folder.write("schema", placed.schema.json())
        self._rows().groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/counts")

    def _rows(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.folder.read("schema")))
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/rows")

    def counts(self) -> list[tuple[int, int]]:
        """(range, rows), in order: one row a range."""
        return sorted(map(tuple, self.spark.read.schema("_range int, n long").parquet(f"{self.folder.path}/counts").collect()))

    def total(self) -> int:
        return sum(n for _, n in self.counts())

    def page(self, number: int, size: int = 50, sort: str | None = None, order: str = "asc") -> DataFrame:
        """Page ``number`` from 1, in the order that was stored."""
        first, before, wanted, skip = (max(1, number) - 1) * size, 0, [], 0
        for part, n in self.counts():
            if before < first + size and before + n > first:
                if not wanted:
                    skip = first - before
                wanted.append(part)
            before += n
        rows = self._rows().filter(F.col("_range").isin(wanted)).drop("_range")
        return rows.orderBy(*[k.order() for k in sort_keys(sort, order)]).offset(skip).limit(size)
