"""Registered queries: a function of (spark, sf_dir) and, where SQL can express it, its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries {key}")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def literal(value) -> str:
    """A DuckDB literal of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return f"CAST('{value}' AS DOUBLE)" if isinstance(value, float) else str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, dict):
        return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in value.items()) + "}"
    return "'" + str(value).replace("'", "''") + "'"


class Fixture:
    """Rows that no table holds, for Spark as a frame and for DuckDB as a VALUES list."""

    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl, self.rows = ddl, rows
        depth, names, word = 0, [], ""
        for c in ddl + ",":
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                names.append(word.split()[0])
                word = ""
            else:
                word += c
        self.names = names

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows) + f") AS fx({', '.join(self.names)}))"

    @property
    def columns(self) -> list[tuple[str, str]]:
        """Names and types."""
        depth, out, word = 0, [], ""
        for c in self.ddl + ",":
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                out.append(tuple(word.split(None, 1)))
                word = ""
            else:
                word += c
        return out


class Spread:
    """Rows of a fixture as templates over a table's rows.

    Every row of the table gets all templates, or with ``one`` the one whose place is its key's
    rest. ``@`` in texts becomes the row's value, and columns named in ``keyed`` tell the
    table's rows apart: the key is added to texts, and a thousand times the key to numbers.
    """

    def __init__(self, fixture: Fixture, keyed: list[str], table: str = "supplier", key: str = "s_suppkey", value: str = "s_nationkey", one: bool = False):
        self.fixture, self.keyed, self.table, self.key, self.value, self.one = fixture, keyed, table, key, value, one

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        n = len(self.fixture.rows)
        rows = load(spark, sf_dir, self.table).select(F.col(self.key).alias("_key"), F.col(self.value).alias("_value"))
        typed = spark.createDataFrame([(k, *r) for k, r in enumerate(self.fixture.rows)], f"_n int, {self.fixture.ddl}")
        place = F.pmod("_key", F.lit(n)) if self.one else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # A handful of templates.
        both = rows.withColumn("_n", place.cast("int") if self.one else place).join(F.broadcast(typed), "_n")
        out = []
        for name, kind in self.fixture.columns:
            c = F.col(name)
            if kind == "string":
                c = F.replace(c, F.lit("@"), F.col("_value").cast("string"))
                c = F.concat(c, F.lit("-"), F.col("_key").cast("string")) if name in self.keyed else c
            elif name in self.keyed:
                c = c.cast("long") + 1000 * F.col("_key").cast("long")
            out.append(c.alias(name))
        return both.select(*out)

    def answers(self, rows: str, columns: str) -> str:
        """The same for expected rows: a VALUES list, for ``one`` with the template's place first as ``n``."""
        named = [c.strip() for c in columns.split(",")]
        shown = [self._sql(c.split()[0], c.split()[1] if " " in c else "string") for c in named if c != "n"]
        on = f" WHERE {self.key} % {len(self.fixture.rows)} = n" if self.one else ""
        return f"SELECT {', '.join(shown)} FROM {self.table}, (VALUES {rows}) AS fx({', '.join(c.split()[0] for c in named)}){on}"

    def _sql(self, name: str, kind: str) -> str:
        if kind == "string":
            text = f"replace({name}, '@', {self.value}::VARCHAR)"
            return f"{text} || '-' || {self.key}::VARCHAR AS {name}" if name in self.keyed else f"{text} AS {name}"
        return f"{name}::BIGINT + 1000 * {self.key}::BIGINT AS {name}" if name in self.keyed else name

    @property
    def sql(self) -> str:
        rows = ", ".join("(" + ", ".join(map(literal, (k, *r))) + ")" for k, r in enumerate(self.fixture.rows))
        shown = ", ".join(self._sql(n, k) for n, k in self.fixture.columns)
        on = f" WHERE {self.key} % {len(self.fixture.rows)} = _n" if self.one else ""
        return f"(SELECT {shown} FROM {self.table}, (VALUES {rows}) AS fx(_n, {', '.join(self.fixture.names)}){on})"


def of_parts(fixture: Fixture, *keyed: str) -> Spread:
    """One template for each part; ``@`` is its size."""
    return Spread(fixture, list(keyed), "part", "p_partkey", "p_size", one=True)


def of_suppliers(fixture: Fixture, *keyed: str) -> Spread:
    """All templates for each supplier; ``@`` is its nation."""
    return Spread(fixture, list(keyed))
