"""All market queries by name: a DataFrame function and, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.market import market, oracle


@dataclass
class Tables:
    """The market's tables over one folder, each read when asked for."""

    spark: SparkSession
    sf_dir: str

    @property
    def listings(self) -> DataFrame:
        return market(self.spark, self.sf_dir, "listings")

    @property
    def history(self) -> DataFrame:
        return market(self.spark, self.sf_dir, "price_history")

    @property
    def runs(self) -> DataFrame:
        return market(self.spark, self.sf_dir, "scrape_runs")

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")

    @property
    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/pages.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(" ".join(sql.split()))
        return f

    return register


from . import agencies, agency_figures, aggregates, dashboards, deletion, duplicates, extraction, floorplans, floors, joins, matching, pages, projections, quality, rent_model, reports, selections, windows  # noqa: E402, F401
