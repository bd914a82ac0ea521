"""A paged search service as a data source that takes predicates.

A partition is a shard: one query in one year. Filters on query, year and field reach the
source (spark.sql.python.filterPushdown.enabled): shards that can't match, and those said to
be done, are never asked for, and a field that is asked for goes to the service with every
page. Pages are asked for until one is short, so many rows are there, or the service's last
offset is reached.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from corpusloom.streaming.log import Folder

PAGE, LAST_OFFSET = 100, 999


class Page(NamedTuple):
    """What a service is asked for: rows offset .. offset + limit of a query's in a year, of one
    field of study if that isn't None."""

    query: str
    year: int
    field: str | None
    offset: int
    limit: int


class _Shard(InputPartition):
    def __init__(self, query: str, year: int):
        self.query, self.year = query, year


def _accepts(f: Filter) -> Callable[[object], bool] | None:
    """What a filter says of its column's value; None if it is of another kind."""
    match f:
        case EqualTo():
            return lambda v: v == f.value
        case In():
            return lambda v: v in f.value
        case GreaterThan():
            return lambda v: v > f.value
        case GreaterThanOrEqual():
            return lambda v: v >= f.value
        case LessThan():
            return lambda v: v < f.value
        case LessThanOrEqual():
            return lambda v: v <= f.value
    return None


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable[[Page], list[tuple]], shards: list[tuple[str, int]], most: int, by_field: bool):
        self.fetch, self.shards, self.most, self.by_field, self.field = fetch, shards, most, by_field, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Drops shards that can't match and takes one field; the rest is left to Spark."""
        for f in filters:
            column, accepts = getattr(f, "attribute", None), _accepts(f)
            if accepts and column in (("query",), ("year",)):
                self.shards = [s for s in self.shards if accepts(s[column == ("year",)])]
            elif self.by_field and column == ("field",) and isinstance(f, EqualTo) and self.field in (None, f.value):
                self.field = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Shard(*s) for s in self.shards]

    def read(self, partition: _Shard | None) -> Iterator[tuple]:
        if partition is None:  # no shard is left
            return
        got = 0
        for offset in range(0, LAST_OFFSET + 1, PAGE):
            rows = self.fetch(Page(partition.query, partition.year, self.field, offset, PAGE))
            for row in rows[: self.most - got]:
                yield (partition.query, partition.year, *row)
            got += len(rows)
            if len(rows) < PAGE or got >= self.most:
                return


def paged_source(name: str, schema: str, fetch: Callable[[Page], list[tuple]]) -> type[DataSource]:
    """A source class to register with `spark.dataSource.register`. `fetch` gives the rows of a
    page in the form of `schema`, those of the page's field alone if it has one; it waits and
    retries as its service asks. A column `field` in the schema is one to be asked by.
    Options: queries and years, separated by `;`, most rows of each shard, and done, the
    shards fetched before, as JSON: [[query, year], ...]."""
    by_field = any(c.split()[0] == "field" for c in schema.split(","))

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"query string, year int, {schema}"

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            done = {(q, int(y)) for q, y in json.loads(self.options.get("done", "[]"))}
            shards = [(q, int(y)) for q in self.options["queries"].split(";") for y in self.options["years"].split(";")]
            return _Reader(fetch, [s for s in shards if s not in done], int(self.options.get("most", "1000")), by_field)

    return Paged


def serve(rows: DataFrame, folder: str, *columns: str) -> Callable[[Page], list[tuple]]:
    """A service over a table (query, year, and `columns`, by the first of which results are in
    order): the table is written to `folder`, a file for each shard, and pages are read from it.
    A shard is put in order as it is read: rows come to its file as they are sent, and the
    writer's own order by shard takes the place of any other."""
    fanned = rows.select("query", "year", *columns).repartition("query", "year")
    fanned.withColumns({"q": F.hex(F.encode("query", "UTF-8")), "y": F.col("year")}).drop("query", "year").write.partitionBy("q", "y").parquet(folder)

    def fetch(page: Page) -> list[tuple]:
        held, at = Folder(folder), f"q={page.query.encode().hex().upper()}/y={page.year}"
        found = []
        for name in held.names(at):
            if name.endswith(".parquet"):
                with held.fs.open_input_file(held.at(f"{at}/{name}")) as file:
                    rows = pq.read_table(file)
                found.append(rows if page.field is None else rows.filter(pc.field("field") == page.field))
        if not found:
            return []
        served = pa.concat_tables(found).sort_by(columns[0]).slice(page.offset, page.limit)
        return [tuple(r[c] for c in columns) for r in served.to_pylist()]

    return fetch


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes the source known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
