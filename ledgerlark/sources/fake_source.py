"""A catalogue in a JSON or YAML list, for tests and trials, as a Spark data source named "catalogue_list"."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

FIELDS = ("id", "title", "author", "match_reason", "price_cents", "original_price_cents", "availability", "reservation_count", "available_from", "category", "url")
SCHEMA = "id string, title string, author string, match_reason string, price_cents long, original_price_cents long, availability string, reservation_count int, available_from string, category string, url string"


class CatalogueList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue_list"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CatalogueListReader(self.options["path"])


class CatalogueListReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        import yaml

        for row in yaml.safe_load(Path(self.path).read_text(encoding="utf-8")) or []:
            if unknown := set(row) - set(FIELDS):
                raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
            yield tuple({"match_reason": "watchlist", **row}.get(f) for f in FIELDS)


def observations(spark: SparkSession, path: str, source: str, watchlist: DataFrame) -> DataFrame:
    """The list as observations; a title on the watchlist (title, book_id) brings its book_id, whatever its case."""
    spark.dataSource.register(CatalogueList)
    rows = spark.read.format("catalogue_list").option("path", path).load()
    wanted = watchlist.groupBy(F.lower("title").alias("_title")).agg(F.min("book_id").alias("book_id"))
    return rows.withColumnRenamed("id", "source_item_id").withColumns({"source": F.lit(source), "_title": F.lower("title")}).join(wanted, "_title", "left").drop("_title")
