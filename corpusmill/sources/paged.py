"""A table behind a paging service as a Spark data source: pages are the partitions, an injected object fetches them.

A service is any object (picklable, as tasks fetch) with ``following(offset)``, the offset of the page after one, or after
none, or None where there is no more yet, and ``fetch(offset)``, the rows of a page as tuples. Offsets are strings that only the
service understands. The driver walks the offsets, which are all that it sees; tasks fetch ``pages_per_task`` pages each, one in
memory at a time. A page that fails is tried again, ``attempts`` times in all, and then fails the read loudly: a read never
gives fewer rows in silence. A task that runs again fetches its pages again.

As a stream, each trigger takes the pages that follow the last one taken, at most ``pages_per_trigger`` if that is set.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Service(Protocol):
    def following(self, offset: str | None) -> str | None: ...

    def fetch(self, offset: str) -> list[tuple]: ...


class PageFailed(RuntimeError):
    """A page that could not be fetched in all its attempts."""


@dataclass
class Pages(InputPartition):
    offsets: tuple[str, ...]


def walk(service: Service, after: str | None, most: int = 0) -> list[str]:
    """Offsets of the pages after one; a service that repeats an offset is refused."""
    found, seen = [], {after}
    while (offset := service.following(found[-1] if found else after)) is not None and not (most and len(found) == most):
        if offset in seen:
            raise ValueError(f"page {offset!r} follows itself")
        seen.add(offset)
        found.append(offset)
    return found


def grouped(offsets: list[str], size: int) -> list[Pages]:
    return [Pages(tuple(offsets[i : i + size])) for i in range(0, len(offsets), size)]


class _Fetching:
    """What batch and stream readers share: the service and its options."""

    def __init__(self, service: Service, options: dict[str, str]):
        option = lambda name, usual: int(options.get(name, usual))
        self.service, self.pages, self.attempts = service, max(1, option("pages_per_task", 1)), max(1, option("attempts", 3))
        self.per_trigger, self.wait = option("pages_per_trigger", 0), float(options.get("wait_seconds", 0.1))

    def rows(self, offset: str) -> list[tuple]:
        for attempt in range(1, self.attempts + 1):
            try:
                return list(self.service.fetch(offset))
            except Exception as e:
                if attempt == self.attempts:
                    raise PageFailed(f"page {offset!r} failed {attempt} times: {e}") from e
                time.sleep(self.wait * 2 ** (attempt - 1))
        return []

    def read(self, partition: Pages) -> Iterator[tuple]:
        for offset in partition.offsets:
            yield from self.rows(offset)


class _Batch(_Fetching, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return grouped(walk(self.service, None), self.pages) or [Pages(())]


class _Stream(_Fetching, DataSourceStreamReader):
    """Stream offsets are {"after": the last page taken, or ""}."""

    last: str | None = None

    def initialOffset(self) -> dict[str, Any]:
        return {"after": ""}

    def latestOffset(self) -> dict[str, Any]:
        found = walk(self.service, self.last, self.per_trigger)
        return {"after": (found[-1] if found else self.last) or ""}

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Pages]:
        self.last, offsets = end["after"] or None, []
        at = start["after"] or None
        while at != self.last:
            at = self.service.following(at)
            if at is None:
                raise ValueError(f"page {self.last!r} no longer follows {start['after']!r}")
            offsets.append(at)
        return grouped(offsets, self.pages)

    def commit(self, end: dict[str, Any]) -> None:
        pass


def paged_source(name: str, service: Service, schema: StructType | str) -> type[DataSource]:
    """The data source class of a service, to register under ``name``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType | str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Batch(service, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Stream(service, self.options)

    return Paged


def read_pages(spark: SparkSession, service: Service, schema: StructType | str, stream: bool = False, name: str = "pages", **options: Any) -> DataFrame:
    """All rows of a service, or a stream of them."""
    spark.dataSource.register(paged_source(name, service, schema))
    reader = spark.readStream if stream else spark.read
    return reader.format(name).options(**options).load()
