"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalogue, enrich, joins, pages, state
from ..operators.shared import stored
from . import views
from .oracle import with_tables


class Tables:
    """The base tables of the queries over one folder, each a plan made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        return views.places(self.spark, self.sf_dir)

    @cached_property
    def crawl(self) -> DataFrame:
        return views.crawl(self.spark, self.sf_dir)

    @cached_property
    def serp(self) -> DataFrame:
        return views.serp(self.spark, self.sf_dir)

    @cached_property
    def patch_rows(self) -> DataFrame:
        return views.patches(self.spark, self.sf_dir)

    @cached_property
    def flagged(self) -> DataFrame:
        return catalogue.flag_chains(self.places)

    @cached_property
    def clean(self) -> DataFrame:
        return catalogue.clean_catalogue(self.places)

    @cached_property
    def leads(self) -> DataFrame:
        return enrich.score_calls(enrich.enrich_offline(self.clean))

    @cached_property
    def crm(self) -> DataFrame:
        return state.apply_crm_patches(state.empty_crm(self.spark), state.as_patches(self.patch_rows), self.leads)

    @cached_property
    def lead_core(self) -> DataFrame:
        """What reports need of the leads, stored: the lead plan runs once, however many
        tables of a report are made from it."""
        return stored(self.leads.select("id", "tier", "phone", "score"), "lead-core")

    @cached_property
    def core_crm(self) -> DataFrame:
        return state.apply_crm_patches(state.empty_crm(self.spark), state.as_patches(self.patch_rows), self.lead_core)

    @cached_property
    def audit(self) -> DataFrame:
        return pages.audit_ci(self.crawl)

    @cached_property
    def view(self) -> DataFrame:
        return joins.lead_view(self.leads, self.crm, self.audit)


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables, with the DuckDB SQL of its rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    from . import queries_catalogue, queries_jobs, queries_pages, queries_serving  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Tables(spark, sf_dir))

    return {name: bound(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_tables(sql) for name, sql in _SQL.items()}
