"""A Python data source that writes rows to a table service: staged by the tasks, published or dropped by the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .remote import fetch


@dataclass
class Staged(WriterCommitMessage):
    """What a task's attempt has staged."""

    part: str
    rows: int


class RowWriter(DataSourceWriter):
    """Each task stages its rows in batches under a name of its attempt; publishing names the attempts that succeeded.

    So a task that is tried again, or runs twice, counts once, and a failure of any task leaves the table as it was. A row
    with a key (the option key, a number from 1) updates that row; one without is inserted, or updates the row of equal unique fields.
    """

    def __init__(self, schema, options: dict) -> None:
        self.names, self.options, self.job = [f.name for f in schema.fields], options, uuid.uuid4().hex

    def _post(self, **body) -> dict | list:
        return fetch(self.options["url"], {"table_name": self.options["table"], "job": self.job, **body}, {"X-API-Key": self.options.get("apikey", "")})

    def _row(self, row: tuple) -> dict:
        values = dict(zip(self.names, row))
        key = values.pop(self.options.get("key", "row_id"), None)
        keys = [c for c in self.options.get("unique", "").split(",") if c]
        if key is not None and int(key) > 0:
            fields = [c for c in values if c not in keys]
            return {"type": "update", "row_id": int(key), "fields": fields, "values": [values[c] for c in fields]}
        return {"type": "insert", "fields": list(values), "values": list(values.values()), "on_duplicate_update": [c for c in values if c not in keys]}

    def write(self, iterator: Iterator[tuple]) -> Staged:
        context = TaskContext.get()
        part, n = f"{context.partitionId()}-{context.taskAttemptId()}", 0
        rows = iter(iterator)
        while batch := [self._row(tuple(r)) for r in islice(rows, int(self.options.get("batch", 100)))]:
            self._post(type="stage", part=part, rows=batch)
            n += len(batch)
        return Staged(part, n)

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        self._post(type="publish", parts=[m.part for m in done], rows=sum(m.rows for m in done))

    def abort(self, messages: list[Staged | None]) -> None:
        self._post(type="drop", parts=[m.part for m in messages if m is not None])


class RowSink(DataSource):
    """df.write.format("http_rows").options(url=, table=, key=, unique=, batch=).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return "http_rows"

    def writer(self, schema, overwrite: bool) -> RowWriter:
        if overwrite:
            raise ValueError("http_rows only appends and updates")
        return RowWriter(schema, dict(self.options))


def write_rows(df: DataFrame, url: str, table: str, key: str = "row_id", unique: str = "", apikey: str = "") -> None:
    df.sparkSession.dataSource.register(RowSink)
    df.write.format("http_rows").options(url=url, table=table, key=key, unique=unique, apikey=apikey).mode("append").save()
