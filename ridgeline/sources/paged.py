"""A paged feature service as a Spark data source.

``spark.read.format("ridgeline_pages")`` with options ``url`` (a file:// folder
or http address), ``page`` (rows per page), ``attempts`` and ``wait`` (seconds).
The service is asked for its row count, pages become partitions, and a failed
page is tried again before the last error is raised.  Column names, an envelope
(option ``box``) and comparisons of a column with a value go to the service as
query parameters; where Spark does not push filters to such sources, option
``where`` does it, and ``register`` asks for it.  A folder of pages cannot
filter, so Spark filters what it holds.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ridgeline_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.schema = options["url"], schema
        self.page, self.attempts, self.wait = int(options.get("page", 1000)), int(options.get("attempts", 4)), float(options.get("wait", 5))
        self.where, self.order, self.box = options.get("where", "1=1"), options.get("order", "OBJECTID"), options.get("box")
        self.pushed: list[str] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons become part of the service's condition; the others, and
        all of them where pages are files, stay with Spark."""
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        for f in filters:
            if self.url.startswith("http") and type(f) in signs and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool) and len(f.attribute) == 1:
                value = "'" + f.value.replace("'", "''") + "'" if isinstance(f.value, str) else repr(f.value)
                self.pushed.append(f"{f.attribute[0]} {signs[type(f)]} {value}")
            else:
                yield f

    def condition(self) -> dict[str, str]:
        """The query parameters that choose rows."""
        box = {"geometry": self.box, "geometryType": "esriGeometryEnvelope", "inSR": "4326", "outSR": "4326", "spatialRel": "esriSpatialRelIntersects"} if self.box else {}
        return {"where": " AND ".join([self.where, *self.pushed]), "geometryPrecision": "6"} | box

    def fetch(self, **query: object) -> dict:
        """One answer; tried again after a pause, the last error is raised."""
        target = self.url + "?" + urllib.parse.urlencode(query) if self.url.startswith("http") else f"{self.url.rstrip('/')}/{query.get('resultOffset', 'count')}.json"
        for i in range(self.attempts):
            try:
                with urllib.request.urlopen(target, timeout=60) as answer:
                    return json.load(answer)
            except (OSError, ValueError, http.client.HTTPException):  # broken answers too
                if i + 1 == self.attempts:
                    raise
                time.sleep(self.wait)
        raise ValueError("attempts must be positive")

    def partitions(self) -> list[InputPartition]:
        n = self.fetch(**self.condition(), returnCountOnly="true", f="json")["count"]
        return [Page(i) for i in range(0, n, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        names = self.schema.fieldNames()
        got = self.fetch(**self.condition(), outFields=",".join(names), orderByFields=self.order, resultOffset=partition.offset, resultRecordCount=self.page, f="json")
        for f in got["features"]:
            yield tuple(f["properties"].get(n) for n in names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
