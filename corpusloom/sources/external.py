"""An outside search service as a Spark data source.

`register(spark, "cases", client)` makes `spark.read.format("cases").option("query", ...)` read what
`client(options)` yields: (case_id, title, text, url) rows. Errors of the service become one row
with its code in `error` (NEED_SETUP, TIMEOUT, SERVICE_ERROR), so that a batch of searches goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, case_id string, title string, text string, url string, error string"
Client = Callable[[Mapping[str, str]], Iterable[tuple[str, str, str, str]]]


class _Query(InputPartition):
    def __init__(self, query: str) -> None:
        self.query = query


def register(spark: SparkSession, name: str, client: Client | None) -> None:
    class Reader(DataSourceReader):
        def __init__(self, options: Mapping[str, str]) -> None:
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return [_Query(q) for q in self.options.get("query", "").split("\n") if q.strip()]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            q = partition.query
            if client is None:
                yield q, None, None, None, None, "NEED_SETUP"
                return
            try:
                for row in client({**self.options, "query": q}):
                    yield (q, *row, None)
            except TimeoutError:
                yield q, None, None, None, None, "TIMEOUT"
            except OSError:
                yield q, None, None, None, None, "SERVICE_ERROR"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Source)
