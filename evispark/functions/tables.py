"""Table functions in Python, for laterals in DataFrames and SQL; ``register`` gives them their names in a session."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="nth int, place int, object string", useArrow=True)
class JsonObjects:
    """The JSON objects that stand in a text, outermost ones only: number, place (from 0, in characters) and text.

    Strings and brackets are JSON's own, so braces in strings don't count; a brace that opens no whole object is passed by. A null text has
    none. Objects that nest deeper than the reader can follow are passed by too.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        decoder, nth, at = json.JSONDecoder(), 0, 0
        while text and (start := text.find("{", at)) >= 0:
            try:
                value, end = decoder.raw_decode(text, start)
            except (json.JSONDecodeError, RecursionError):
                at = start + 1
                continue
            at = end
            yield nth, start, json.dumps(value, ensure_ascii=False)
            nth += 1


@udtf(returnType="nth int, role string", useArrow=True)
class ExplodeRoles:
    """The distinct roles in a cell of several, in order: cut at commas, semicolons and line ends, with single blanks inside."""

    def eval(self, cell: str) -> Iterator[tuple]:
        text = cell or ""
        for mark in "，、;；\n":
            text = text.replace(mark, ",")
        roles = dict.fromkeys(" ".join(part.split()) for part in text.split(","))
        yield from enumerate(r for r in roles if r)


def register(spark: SparkSession) -> None:
    """``json_objects(text)`` and ``explode_roles(cell)`` for SQL."""
    spark.udtf.register("json_objects", JsonObjects)
    spark.udtf.register("explode_roles", ExplodeRoles)
