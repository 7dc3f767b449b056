"""A Python data source for views behind an HTTP service, read page by page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .schemas import require_columns
from .snapshots import last_rows, write_snapshot

#: Fixed values.
RETRIED = {408, 429, 500, 502, 503, 504}
ATTEMPTS, FIRST_WAIT = 3, 0.5


def fetch(url: str, body: dict, headers: dict, timeout: float = 180.0, send: Callable | None = None) -> list | dict:
    """The answer to a POST; timeouts and the statuses of RETRIED are tried again after 0.5 and 1 second."""
    send = send or (lambda request: urllib.request.urlopen(request, timeout=timeout).read())
    for attempt in range(ATTEMPTS):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
            answer = send(request)
            try:
                return json.loads(answer)
            except ValueError:
                raise RuntimeError(f"not JSON: {answer[:200]!r}") from None
        except (urllib.error.HTTPError, urllib.error.URLError, TimeoutError) as error:
            if attempt == ATTEMPTS - 1 or getattr(error, "code", 408) not in RETRIED:
                raise
            time.sleep(FIRST_WAIT * 2**attempt)
    raise AssertionError


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


#: The filters that a service can apply, by the operator that it is sent.
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNotNull: "not_null"}


class ViewReader(DataSourceReader):
    """Reads ids of a view in pages that begin after the last id seen.

    Without the options lower and upper several partitions share the range between the view's bounds, which the service is asked for.
    """

    def __init__(self, schema, options: dict) -> None:
        self.names, self.options = [f.name for f in schema.fields], options
        self.key = options.get("key", self.names[0])
        self.where: list[list] = []
        self.low, self.high = 0, 1 << 62  # of the key, as filters bound it

    def _ask(self, body: dict) -> list | dict:
        return fetch(self.options["url"], {"view": self.options["view"], "where": self.where, **body}, {"X-API-Key": self.options.get("apikey", "")})

    def partitions(self) -> list[Range]:
        n = int(self.options.get("partitions", 1))
        if "lower" in self.options and "upper" in self.options:
            low, high = int(self.options["lower"]), int(self.options["upper"])
        elif n == 1:
            low, high = 0, 1 << 62
        else:
            bounds = self._ask({"bounds": self.key})
            low, high = (0, 0) if bounds.get("min") is None else (int(bounds["min"]), int(bounds["max"]) + 1)
        low, high = max(low, self.low), min(high, self.high)
        if high <= low:
            return [Range(low, low)]
        step = -(-(high - low) // n)
        return [Range(at, min(high, at + step)) for at in range(low, high, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        after, page = partition.low - 1, int(self.options.get("page", 80))
        if partition.high <= partition.low:
            return
        while True:
            rows = self._ask({"afterId": after, "beforeId": partition.high, "limit": page})
            yield from (tuple(r.get(c) for c in self.names) for r in rows)
            if len(rows) < page:
                return
            after = max(int(r[self.key]) for r in rows)


class PushingViewReader(ViewReader):
    """Filters on plain columns are left to the service; those that bound the key narrow the ranges that are read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            operator, column = OPERATORS.get(type(f)), ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if operator is None or column not in self.names or not isinstance(value, (int, float, str, bool, tuple, list, type(None))):
                yield f
                continue
            if column == self.key and isinstance(value, int) and not isinstance(value, bool):
                least = {"=": value, ">": value + 1, ">=": value}.get(operator, self.low)
                most = {"=": value + 1, "<": value, "<=": value + 1}.get(operator, self.high)
                self.low, self.high = max(self.low, least), min(self.high, most)
            else:
                self.where.append([column, operator, list(value) if isinstance(value, (tuple, list)) else value])


class ViewSource(DataSource):
    """spark.read.format("http_view").schema(...).options(url=, view=, key=, lower=, upper=, partitions=, page=, pushdown=).load()

    pushdown=true needs spark.sql.python.filterPushdown.enabled, which is off by default.
    """

    @classmethod
    def name(cls) -> str:
        return "http_view"

    def reader(self, schema) -> ViewReader:
        return (PushingViewReader if self.options.get("pushdown") == "true" else ViewReader)(schema, dict(self.options))


def read_view(spark: SparkSession, url: str, view: str, schema: str, key: str, **options: str | int) -> DataFrame:
    """A view as a table, with its filters pushed if the session allows it. options: partitions, page, lower, upper, apikey."""
    spark.dataSource.register(ViewSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("http_view").schema(schema).options(url=url, view=view, key=key, pushdown=push, **options).load()


def with_codes(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows with the model's code by model_id; rows of unknown models have a blank one. Of several codes of an id the last by row counts."""
    codes = last_rows(models.filter(F.trim("model") != ""), ["model_id"], ["row_id"]).select("model_id", F.trim("model").alias("model"))
    return rows.drop("model").join(codes, "model_id", "left").withColumn("model", F.coalesce("model", F.lit("")))


def fetch_training_views(views: dict[str, DataFrame], required: dict[str, list[str]], root: str, source: str = "") -> str:
    """Reads purchases, customers and models, checks their columns, and writes them as one snapshot; its path.

    All are checked before any is written. Models that come with images (model_id, row_id) get their codes by with_codes.
    """
    checked = {name: require_columns(df, required[name]) for name, df in views.items()}
    return write_snapshot(checked, root, source=source)
