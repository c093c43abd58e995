"""Catalogue pages as a Python data source, with filters pushed to the pages that are read.

``spark.read.format("catalogue").option("path", folder).load()`` reads pages saved as ``<source>/<page>.json``, one partition per page: the offline form of a catalogue's
paged interface. Filters on source (equality, lists) and page (equality, ranges) drop whole pages before anything is read. ``continuation`` is what the page names as the start of the next one, null on
the last; a page whose results are null is spent and has no rows. The options ``licence`` and ``least_width`` are the predicates that the interface itself evaluates, item by item.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, source: str, page: int, path: str) -> None:
        self.source, self.page, self.path = source, page, path


COMPARED = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}


class Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.tests = options["path"], []
        self.licence, self.least_width = options.get("licence"), int(options.get("least_width", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in COMPARED and f.attribute in (("source",), ("page",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        pages = [Page(p.parent.name, int(p.stem), str(p)) for p in sorted(Path(self.root).glob("*/*.json"), key=lambda p: (p.parent.name, int(p.stem)))]
        return [p for p in pages if all(COMPARED[how](getattr(p, name), value) for name, how, value in self.tests)]

    def read(self, partition: Page) -> Iterator[tuple]:
        body = json.loads(Path(partition.path).read_text())
        onward = body.get("continue")
        for place, item in enumerate(body.get("results") or []):
            if (self.licence is None or item.get("license") == self.licence) and (not self.least_width or (item.get("width") or 0) >= self.least_width):
                yield partition.source, partition.page, place, json.dumps(item, sort_keys=True), None if onward is None else json.dumps(onward, sort_keys=True)


class Catalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "source string, page int, place int, item string, continuation string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Pages(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Catalogue)
