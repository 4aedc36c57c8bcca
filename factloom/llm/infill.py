"""Fill-in-middle: a text cut at two token boundaries and written in another order.

Tokens are runs of ASCII letters, and every other character for itself. No list of tokens is
made: a text is stored as its maximal runs of letters and of other characters, each with its
first character and the units (tokens) before it. A run of letters is one unit, a run of
others as many as it is long. The run that holds a cut is found by binary search among the
units, and the place in it is the difference, as no cut lies inside a run of letters.

The texts of a block are encoded together; a run ends where its text does.

Defined results: null text is empty; an empty text, and one that holds a mark, stays as it is
(plain); a null id is hashed as an empty string; repeated rows are done each for itself; an
empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, frugal, table

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Characters of a block, and of a piece whose classes are told at once.
BLOCK, PIECE = 2_000_000, 1_000_000


@dataclass
class Runs:
    """Maximal runs of one class: the first character of each, the units before each, and whether it is of letters."""

    starts: np.ndarray
    units: np.ndarray
    letters: np.ndarray
    #: Characters before each text, and after the last.
    texts: np.ndarray
    n_units: int

    @classmethod
    def of(cls, texts: list[str]) -> Runs:
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype="i8")])
        whole, size = "".join(texts), int(ends[-1])
        starts, classes, last = [], [], None
        for at in range(0, size, PIECE):
            points = np.frombuffer(whole[at : at + PIECE].encode("utf-32-le"), "<u4")
            letter = ((points | 32) - 97) < 26  # unsigned: what is below wraps far above
            turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
            if last is None or bool(letter[0]) != last:
                turn = np.concatenate([[0], turn])
            starts.append(turn + at)
            classes.append(letter[turn])
            last = bool(letter[-1])
        turns = np.concatenate([*starts, np.zeros(0, "i8")])
        kinds = np.concatenate([*classes, np.zeros(0, bool)])
        first = np.union1d(turns, ends[:-1][ends[:-1] < size]).astype("i8")
        own = kinds[np.searchsorted(turns, first, side="right") - 1]
        long = np.diff(np.append(first, size))
        units = np.concatenate([[0], np.cumsum(np.where(own, 1, long))])
        return cls(first, units[:-1], own, ends, int(units[-1]))

    def before_texts(self) -> np.ndarray:
        """Units before each text, and all."""
        at = np.searchsorted(self.starts, self.texts)
        return np.append(self.units, self.n_units)[at]

    def places(self, cuts: np.ndarray) -> np.ndarray:
        """The character at which each cut, given in units of the whole block, falls."""
        if not len(self.units):
            return np.zeros(len(cuts), "i8")
        run = np.searchsorted(self.units, cuts, side="right") - 1
        found = self.starts[run] + cuts - self.units[run]
        return np.where(cuts >= self.n_units, self.texts[-1], found)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that an id stands for."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _cut(seed: int, rate: int, spm_rate: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            runs = Runs.of(texts)
            first = runs.before_texts()
            n = np.diff(first)
            h = np.array([draws(i, seed) for i in ids], "i8")
            a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            start = runs.texts[:-1]
            left = (runs.places(first[:-1] + np.minimum(a, b)) - start).tolist()
            right = (runs.places(first[:-1] + np.maximum(a, b)) - start).tolist()
            plain, spm = (h[:, 2] % 100 >= rate).tolist(), (h[:, 3] % 100 < spm_rate).tolist()
            form, prefix, middle, output = [], [], [], []
            for t, i, j, p, s in zip(texts, left, right, plain, spm, strict=True):
                if p or not t or any(m in t for m in MARKS):
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(t)
                    continue
                form.append("spm" if s else "psm")
                prefix.append(i)
                middle.append(j - i)
                output.append(f"{SUFFIX}{t[j:]}{PREFIX}{t[:i]}{MIDDLE}{t[i:j]}" if s else f"{PREFIX}{t[:i]}{SUFFIX}{t[j:]}{MIDDLE}{t[i:j]}")
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, n, form, prefix, middle, output], schema, strict=True)], schema=schema)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:  # a block never waits for the next batch
        yield from blocks([batch], BLOCK)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    Of a hundred texts about ``rate`` are cut, and of those ``spm_rate`` in a hundred have the
    suffix first. Prefix ends at the smaller of two cuts that the id's hash gives, middle at
    the larger.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(_cut(seed, rate, spm_rate)), ROWS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no mark, so the marks part it."""
    part = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, tokens, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
