"""Extractors as table functions: a text gives rows, joined laterally to the row that it comes from.

An extractor is a plain function of a text that yields rows. ``extracted`` applies one to a
frame; ``registered`` gives it a name for SQL (``FROM docs d, LATERAL name(d.text)``). The
functions get whole texts, one at a time, and hold nothing between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import facts
from .code import _lexical

Extract = Callable[[str], Iterable[tuple]]
TOKENS = "n long, kind string, token string, depth int"
RULES = "rule string, symbol string, expression string"


def tokens(text: str) -> Iterable[tuple]:
    """Tokens of any language, with their depth of brackets."""
    for _, n, kind, token, depth in _lexical("", text):
        yield n, kind, token, depth


def rules(text: str) -> Iterable[tuple]:
    """Variables, bounds and equations that prose states."""
    for p in facts.VARIABLES:
        yield from (("variable", m[1], m[2].strip()) for m in re.finditer(p, text))
    yield from (("boundary", m[1], f"{m[2]} <= {m[1]} <= {m[3]}") for m in re.finditer(facts.BETWEEN, text))
    for sign, p in facts.BOUNDS:
        yield from (("boundary", m[1], f"{m[1]} {sign} {m[2]}") for m in re.finditer(p, text))
    yield from (("equation", m[1], f"{m[1]} = {m[2].strip()}") for m in re.finditer(facts.EQUATION, text))


def table_function(extract: Extract, schema: str):
    """A table function of one text; null gives no row."""

    class Extractor:
        def eval(self, text: str):
            if text is not None:
                yield from extract(text)

    return udtf(Extractor, returnType=schema)


def registered(spark: SparkSession, name: str, extract: Extract, schema: str) -> None:
    """Makes an extractor a function of SQL in this session."""
    spark.udtf.register(name, table_function(extract, schema))


def extracted(docs: DataFrame, extract: Extract, schema: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, joined to the rows that each text gives."""
    made = table_function(extract, schema)
    return docs.lateralJoin(made(F.col(text).outer())).drop(text)
