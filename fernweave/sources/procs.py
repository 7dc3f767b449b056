"""Stored procedures as table functions: SELECT * FROM name('{"json": "argument"}')."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from .remote import fetch


def argument(value) -> str:
    """What a procedure is sent: null is {}, objects and lists are JSON, all else is text."""
    return "{}" if value is None else json.dumps(value, separators=(",", ":")) if isinstance(value, (dict, list)) else str(value)


def procedure(name: str, schema: str, call: Callable[[str], Iterator[tuple]]) -> UserDefinedTableFunction:
    """A table function of one argument, JSON text or null. call gives its rows from the argument as it is sent."""
    if not name.strip():
        raise ValueError("a procedure needs a name")

    class Procedure:
        def eval(self, value: str | None = None):  # noqa: ANN202
            yield from call(argument(value))

    return F.udtf(Procedure, returnType=schema)


def remote_procedure(spark: SparkSession, name: str, schema: str, url: str, apikey: str = "") -> None:
    """Registers a procedure of the service at url, as a table function of that name."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def call(value: str) -> Iterator[tuple]:
        answer = fetch(url, {"type": "proc", "procName": name, "value": value}, {"X-API-Key": apikey})
        rows = next((answer[k] for k in ("data", "rows", "result", "records") if isinstance(answer.get(k), list)), []) if isinstance(answer, dict) else answer
        for row in rows:
            yield tuple(row.get(c) for c in columns)

    spark.udtf.register(name, procedure(name, schema, call))


def filtering(schema: str) -> UserDefinedTableFunction:
    """A procedure over the rows of a table argument: those whose fields equal the JSON object's. Rows stay in their tasks.

    A null argument is {} and passes all. Fields that a row lacks are equal to nothing; a null in the object matches nulls.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    class Filtering:
        def __init__(self) -> None:
            self.text, self.wanted = None, {}

        def eval(self, row, value: str | None):  # noqa: ANN001, ANN202
            if value != self.text:
                self.text, self.wanted = value, json.loads(argument(value))
            fields = row.asDict()
            if all(k in fields and fields[k] == v for k, v in self.wanted.items()):
                yield tuple(fields.get(c) for c in columns)

    return F.udtf(Filtering, returnType=schema)


def called(spark: SparkSession, name: str, value: dict | list | str | None = None) -> DataFrame:
    """The rows of a registered procedure."""
    return spark.sql(f"SELECT * FROM {name}(:value)", {"value": None if value is None else argument(value)})
