"""A list of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.functions.text import BLANKS

#: The SQL of white space taken off the ends of a text; trim with one argument takes off blanks alone.
_TRIM = re.compile(r"\b(l?trim)\(")


def stripping(sql: str) -> str:
    """The same SQL, in which trim and ltrim of one argument take off white space of any kind."""
    out, at = [], 0
    while m := _TRIM.search(sql, at):
        depth, k, several, quoted = 1, m.end(), False, False
        while depth:
            c = sql[k]
            quoted ^= c == "'"
            if not quoted:
                depth += (c == "(") - (c == ")")
                several |= c == "," and depth == 1
            k += 1
        inner = stripping(sql[m.end() : k - 1])
        out.append(f"{sql[at : m.start()]}{m[1]}({inner}" + (")" if several else f", '{BLANKS}')"))
        at = k
    return "".join(out) + sql[at:]


Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name; sql is the same result in DuckDB's dialect."""

        def add(f: Query) -> Query:
            assert f.__name__ not in self.queries, f.__name__
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = stripping(sql)
            return f

        return add
