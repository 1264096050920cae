"""Hooks whose failures stay with the rows they happen on.

A column hook is an Attempt: a value and a text that says why it cannot be had. Both are
one struct, so the value is worked out only where the text is null and a row that would
stop the job (a cast, a division, an element that is not there) is told instead.

A row hook is a Python function of one row, for what no column expresses. It runs in
Arrow batches; what it raises, or returns in a form that does not fit its schema, becomes
the row's error text, and the other rows of the batch are as they would be alone. A worker
that dies (out of memory, a signal) is no row's failure: Spark runs its task again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import ship_package, stored

ERROR = "enrich_error"


@dataclass(frozen=True)
class Attempt:
    """``value`` where ``problem`` (a text column) is null."""

    value: Column
    problem: Column

    def outcome(self) -> Column:
        """struct(error, value): the error is null exactly where the value was worked out."""
        return F.struct(self.problem.cast("string").alias("error"), F.when(self.problem.isNull(), self.value).alias("value"))


def required(value: Column, text: str) -> Attempt:
    """A value that must not be null."""
    return Attempt(value, F.when(value.isNull(), F.lit(text)))


def to_number(text: Column, type_: str = "int") -> Attempt:
    """A number in a text; null and empty texts are null, others that are no number fail."""
    filled = F.nullif(F.trim(text), F.lit(""))
    value = filled.try_cast(type_)
    return Attempt(value, F.when(filled.isNotNull() & value.isNull(), F.concat(F.lit("no number: "), F.substring(filled, 1, 80))))


def try_columns(df: DataFrame, attempts: dict[str, Attempt], error: str = ERROR) -> DataFrame:
    """``df`` with a column for each attempt, null where it failed, and ``error``: the texts
    of those that failed as "name: text", in order and joined by "; ", null if none did. An
    error column that ``df`` has already is kept before them. Every row stays."""
    told = {name: F.concat(F.lit(f"{name}: "), F.col(f"_try_{name}.error")) for name in attempts}
    before = [F.col(error)] if error in df.columns else []
    out = df.withColumns({f"_try_{name}": a.outcome() for name, a in attempts.items()})
    out = out.withColumns({name: F.col(f"_try_{name}.value") for name in attempts} | {error: F.nullif(F.concat_ws("; ", *before, *told.values()), F.lit(""))})
    return out.drop(*[f"_try_{name}" for name in attempts])


def message(e: Exception) -> str:
    """What an error says, or its kind if it says nothing."""
    return str(e) or type(e).__name__


@dataclass(frozen=True)
class RowHook:
    """``call`` takes a row as a dictionary of ``reads`` and returns one of the fields of
    ``returns`` (DDL) or None; fields that it leaves out are null."""

    call: Callable[[dict], dict | None]
    reads: tuple[str, ...]
    returns: str

    @property
    def fields(self) -> StructType:
        return StructType.fromDDL(self.returns)


def try_rows(rows: DataFrame, hook: RowHook, keep: Sequence[str], error: str = ERROR) -> DataFrame:
    """The ``keep`` columns of each row, the fields of the hook and ``error``.

    Where the hook raised or returned what does not fit, its fields are null and the error
    says why; else the error is null. One row comes back for each row. Only ``keep`` and the
    columns that the hook reads are handed to Python.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(rows.sparkSession)
    fields, call, reads, n_keep = hook.fields, hook.call, list(hook.reads), len(keep)
    chosen = rows.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"_read_{c}") for c in reads])
    out = StructType([*chosen.select(*keep).schema.fields, *fields.fields]).add(error, "string")
    types = to_arrow_schema(fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def column(f, values: list) -> pa.Array:
            return pa.array(values, f.type)

        for b in batches:
            got, errors = [], []
            for values in zip(*[c.to_pylist() for c in b.columns[n_keep:]], strict=True) if reads else [()] * b.num_rows:
                try:
                    got.append(call(dict(zip(reads, values, strict=True))) or {})
                    errors.append(None)
                except Exception as e:  # whatever a user's hook may raise
                    got.append({})
                    errors.append(message(e))
            try:
                cols = [column(f, [g.get(f.name) for g in got]) for f in types]
            except Exception:  # some row's values do not fit: find it
                for k, g in enumerate(got):
                    try:
                        for f in types:
                            column(f, [g.get(f.name)])
                    except Exception as e:
                        got[k], errors[k] = {}, message(e)
                cols = [column(f, [g.get(f.name) for g in got]) for f in types]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *cols, pa.array(errors, pa.string())], [*keep, *types.names, error])

    return chosen.mapInArrow(run, out)


def by_lead(tried: DataFrame, hook: RowHook, key: str = "lead_id", order: str = "page_ord", error: str = ERROR) -> DataFrame:
    """One row a ``key``: each field from its first row that gave one, and the error of the
    first row that failed, null if none did. All are aggregates that combine on the map side."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return tried.groupBy(key).agg(*[first(f.name) for f in hook.fields], first(error))


def quarantine(tried: DataFrame, error: str = ERROR) -> DataFrame:
    """The rows that failed."""
    return tried.filter(F.col(error).isNotNull())


def split_failed(tried: DataFrame, what: str = "tried") -> tuple[DataFrame, DataFrame]:
    """(rows, failed rows) from one evaluation: the rows are stored first, so a hook is
    called once a row, whatever is read of it afterwards."""
    kept = stored(tried, what)
    return kept, quarantine(kept)


def add_quarantined(spark: SparkSession, failed: DataFrame, path: str, run: str) -> None:
    """Write the failed rows of a run to a table of all runs, partitioned by run. A run that
    is repeated replaces its own rows only."""
    failed.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def quarantined(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The table of failed rows: ``columns`` (DDL) and the run; without rows before any
    failed."""
    return spark.read.schema(f"{columns}, run string").parquet(path)


def error_counts(failed: DataFrame, error: str = ERROR) -> DataFrame:
    """(error, rows): how often each text occurs, the most frequent first."""
    return failed.groupBy(error).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), error)

