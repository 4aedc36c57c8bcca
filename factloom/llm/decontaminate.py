"""Benchmark decontamination: walks over characters, bit-sampling LSH, exact edit verification.

Texts become lower-cased words with a space between. An item is held where its edit distance
to a part of the document is within the limit, 20 % of its characters.

A walk (the CGK embedding) reads a text from a place on: at each step it notes the character
it stands on, and a random function of step and character says whether it moves on. After an
edit two walks fall into step again by chance, so what they note differs in few steps. A key is
the hash of sampled steps, one of each equal stretch of the walk, and each key has a walk of its
own. A walk over a whole item loses step for good at a fifth of edits; therefore walks are
short and start at every place of an item. In a document they start at every word and, in long
words, at every sixth character. Where keys are equal, the item-sized window around that place
is a candidate.

The number of keys is the least that finds ``recall`` of copies of the items with as many random
edits as the limit allows (``enough_keys``; README has what an independent test measured). Items
under 40 characters, and any for which no number of keys is enough, have seeds instead, of
(n - k) / (k + 1) characters at the limit k, at every place of a document: one of them stands in
every place within the limit.

All candidates are decided by the exact distance (Sellers' problem, bit-parallel: many side by
side on seven bits of each character, which is never above it, then those that pass alone).
Items of over ``PIECE`` characters are sought by their pieces: if the whole is within the limit,
so is one piece within its own. Equal items are one until the result.

Items come in chunks of bounded size, each of which is a pass over the documents; a chunk's
index goes to all executors.

Defined results: null text is empty; items without words are never found; rows with a null
or repeated id are searched each for itself, and a document has one row for each item row that
it holds, with the least distance; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, frugal, pieces, table

WORD = re.compile(r"\w+")
#: Item text in a chunk.
CHUNK_CHARS = 1_000_000
#: Text that is searched at once.
TEXT_CHARS = 4_000_000
#: Characters of a piece of an item; of a document's word between two walks.
PIECE, STRIDE = 512, 6
#: Diagonals that are one candidate; bits of the table that says which keys there are.
NEAR = 16
FILTER_BITS = 22
#: Steps of a walk for items of 80 characters or more in an index of 64,000, and for shorter ones.
STEPS, SHORT_STEPS = 28, 20
#: Copies that the number of keys is found with, and the most keys that are tried.
COPIES, MOST_KEYS = 300, 12
#: Hits that are expanded at once; candidates under which each is decided for itself.
HITS, FEW = 1_000_000, 48
#: Walks side by side; so few that they stay in a processor's cache.
WALKS = 1 << 14


def split(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def signs(text: str) -> np.ndarray:
    """Seven bits of each character; equal characters have equal ones."""
    if text.isascii():
        return np.frombuffer(text.encode(), "u1")
    out = np.empty(len(text), "u1")
    for k in range(0, len(text), 1 << 20):
        c = np.frombuffer(text[k : k + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4")
        out[k : k + len(c)] = (c ^ c >> np.uint32(7) ^ c >> np.uint32(14)) & np.uint32(127)
    return out


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance between the pattern and any part of the text, first end of such a part)."""
    if not pattern:
        return 0, 0
    m, where = len(pattern), defaultdict(int)
    for k, c in enumerate(pattern):
        where[c] |= 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    get = where.get
    for n, c in enumerate(text, 1):
        eq = get(c, 0)
        zero = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = (down | ~(zero | up)) & full
        minus = up & zero
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, n
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(zero | plus)) & full, plus & zero
    return best, end


def edit_distance(pattern: str, text: str) -> int:
    """Least edit distance between the pattern and any part of the text."""
    return nearest(pattern, text)[0]


def starts_of_words(text: np.ndarray) -> np.ndarray:
    """Places where a document's walks start: at words, and at every STRIDE characters of long ones."""
    blank = (text == 32) | (text == 10)
    at = np.flatnonzero(np.concatenate([[True], blank[:-1]]) & ~blank) if len(text) else np.zeros(0, "i8")
    more = (np.diff(np.append(at, len(text))) - 2) // STRIDE
    some = more > 0
    n = more[some]
    inner = np.repeat(at[some] - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(1, n.sum() + 1)
    return np.sort(np.concatenate([at, inner]), kind="stable") if len(inner) else at


@dataclass
class Key:
    """A walk's moves by step and character, and the steps that are noted. Without moves, all characters in a row."""

    sampled: list[bool]
    moves: np.ndarray | None = None

    @staticmethod
    def new(steps: int, seed: int) -> Key:
        rng = np.random.default_rng([steps, seed])
        noted = {2 * k + int(rng.integers(2)) for k in range(steps // 2)}
        return Key([k in noted for k in range(steps)], rng.integers(0, 2, (steps, 128)).astype("i8"))

    def read(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place after the last step) of walks from such places; text has ``len(sampled)`` signs to spare."""
        h = np.full(len(at), 0x811C9DC5, "u4")
        for k, noted in enumerate(self.sampled):
            c = text[at]
            if noted:
                h ^= c
                h *= np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            at = at + (1 if self.moves is None else self.moves[k][c])
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x9E3779B1)
        return h ^ h >> np.uint32(16), at


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """A copy after so many random edits of a character, a third each put in, taken out or changed."""
    out = list(text)
    for k in rng.integers(0, 1 << 40, edits).tolist():
        at, other = k % max(1, len(out)), text[(k >> 20) % len(text)]
        out[at : at + (k % 3 > 0)] = [] if k % 3 == 1 else [other]
    return "".join(out)


class Table:
    """Keys of pieces, and the pieces and places that have them."""

    def __init__(self, key: Key, texts: list[np.ndarray], names: np.ndarray):
        n = np.array([len(t) for t in texts])
        gap = len(key.sampled)
        both = np.concatenate([x for t in texts for x in (t, np.zeros(gap, "u1"))])
        first = np.cumsum(n + gap) - n - gap
        own = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        h, end = key.read(both, first[own] + place)
        whole = end <= (first + n)[own]
        order = np.flatnonzero(whole)[np.argsort(h[whole], kind="stable")]
        self.key, self.hashes, self.owner, self.place = key, h[order], names[own[order]].astype("i4"), place[order].astype("i4")
        there = np.zeros(1 << FILTER_BITS, bool)
        there[self.hashes >> np.uint32(32 - FILTER_BITS)] = True
        self.there = np.packbits(there)

    def hits(self, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(piece, diagonal, place in the text) of equal keys, a bounded number at a time."""
        for k in range(0, len(at), WALKS):
            yield from self._hits(text, at[k : k + WALKS])

    def _hits(self, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, _ = self.key.read(text, at)
        top = h >> np.uint32(32 - FILTER_BITS)
        some = np.flatnonzero(self.there[top >> np.uint32(3)] >> (7 - (top & np.uint32(7))).astype("u1") & 1)
        a, b = np.searchsorted(self.hashes, h[some], "left"), np.searchsorted(self.hashes, h[some], "right")
        some, a, b = some[b > a], a[b > a], b[b > a]
        total = np.cumsum(b - a)
        k = 0
        while k < len(some):
            until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + HITS, "right")))
            n = b[k:until] - a[k:until]
            post = np.repeat(a[k:until] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(at[some[k:until]], n)
            yield self.owner[post], place - self.place[post], place
            k = until


def enough_keys(texts: list[str], steps: int, distance: float, recall: float) -> list[Key] | None:
    """The first keys that find so many of edited copies; None if MOST_KEYS don't."""
    rng = np.random.default_rng(0)
    chosen = [texts[k % len(texts)] for k in rng.permutation(max(len(texts), COPIES))[:COPIES].tolist()]
    limits = np.array([int(distance * len(t)) for t in chosen])
    copies = [edited(t, int(limit), rng) for t, limit in zip(chosen, limits, strict=True)]
    text = np.concatenate([signs("\n".join(copies)), np.zeros(steps, "u1")])
    firsts = np.cumsum([0] + [len(c) + 1 for c in copies])
    at = starts_of_words(text[:-steps])
    found, keys, plain = np.zeros(COPIES, bool), [], [signs(t) for t in chosen]
    for seed in range(MOST_KEYS):
        keys.append(Key.new(steps, seed))
        for piece, diagonal, place in Table(keys[-1], plain, np.arange(COPIES)).hits(text, at):
            copy = np.searchsorted(firsts, place, "right") - 1
            right = (copy == piece) & (np.abs(diagonal - firsts[copy]) <= limits[piece])
            found[piece[right]] = True
        if found.mean() >= recall:
            return keys
    return None


class Index:
    """Items' keys; finds the items that a document holds."""

    def __init__(self, items: list[tuple[int | None, str]], distance: float = 0.2, recall: float = 0.98):
        self.distance = distance
        rows: dict[str, list[int | None]] = defaultdict(list)
        for i, text in items:
            rows[" ".join(split(text))].append(i)
        rows.pop("", None)
        self.texts, self.members = list(rows), list(rows.values())
        #: Pieces: (item, first character, text).
        self.parts: list[tuple[int, int, str]] = []
        for k, t in enumerate(self.texts):
            n = -(-len(t) // PIECE)
            edges = [len(t) * j // n for j in range(n + 1)]
            self.parts += [(k, a, t[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.size = np.array([len(t) for _, _, t in self.parts], "i8")
        self.limit = (distance * self.size).astype("i8")
        self.tables: list[tuple[Table, bool]] = []
        self._add_keys(recall)
        #: Pieces by the words of 64 bits that they take: places of each character.
        self.words = (self.size + 63) // 64
        self.row = np.zeros(len(self.parts), "i8")
        self.places: dict[int, list[np.ndarray]] = {}
        for w in np.unique(self.words).tolist():
            members = np.flatnonzero(self.words == w)
            self.row[members] = np.arange(len(members))
            bits = np.zeros((w, len(members) * 128), "u8")
            for row, k in enumerate(members.tolist()):
                c = signs(self.parts[k][2]).astype("i8")
                j = np.arange(len(c))
                np.bitwise_or.at(bits, (j // 64, row * 128 + c), np.uint64(1) << (j % 64).astype("u8"))
            self.places[w] = list(bits)

    def _add_keys(self, recall: float) -> None:
        seeded: dict[int, list[int]] = defaultdict(list)
        larger = int(np.clip(round(np.log(max(1, self.size.sum()) / 64_000) / np.log(4)), 0, 3))
        for low, high, steps in ((80, PIECE + 1, STEPS + 4 * larger), (40, 80, SHORT_STEPS + 4 * larger)):
            members = np.flatnonzero((self.size >= low) & (self.size < high))
            if not len(members):
                continue
            texts = [self.parts[k][2] for k in members.tolist()]
            keys = enough_keys(texts, steps, self.distance, recall)
            if keys is None:
                for k in members.tolist():
                    seeded[self._seed(k)].append(k)
            else:
                plain = [signs(t) for t in texts]
                self.tables += [(Table(key, plain, members), False) for key in keys]
        for k in np.flatnonzero(self.size < 40).tolist():
            seeded[self._seed(k)].append(k)
        for q, some in sorted(seeded.items()):
            self.tables.append((Table(Key([True] * q), [signs(self.parts[k][2]) for k in some], np.array(some)), True))

    def _seed(self, k: int) -> int:
        """Characters of a seed that stands in every place within the limit."""
        return max(1, int((self.size[k] - self.limit[k]) // (self.limit[k] + 1)))

    def _candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first of NEAR diagonals) of places with equal keys; a diagonal is the place where the piece would start."""
        found = [np.zeros(0, "i8")]
        spare = max([len(t.key.sampled) for t, _ in self.tables], default=0)
        for first in range(0, len(text), TEXT_CHARS):
            own = text[first : first + TEXT_CHARS + spare]
            wide = np.concatenate([own, np.zeros(spare, "u1")])
            n = min(TEXT_CHARS, len(text) - first)
            words = starts_of_words(own[:n]) if any(not every for _, every in self.tables) else None
            for t, every in self.tables:
                for piece, diagonal, _ in t.hits(wide, np.arange(n) if every else words):
                    # One number for both, as a sort of numbers is the faster.
                    found.append(np.unique(piece.astype("i8") << 40 | (diagonal + first) // NEAR + (1 << 39)))
        both = np.unique(np.concatenate(found))
        return both >> 40, ((both & (1 << 40) - 1) - (1 << 39)) * NEAR

    def _stretches(self, joined: str) -> Iterator[tuple[int, int, int]]:
        """(piece, first character, end) around keys where the piece is within its limit."""
        text = signs(joined)
        piece, diagonal = self._candidates(text)
        start = diagonal - self.limit[piece]
        stop = diagonal + NEAR + self.size[piece] + self.limit[piece]
        edge = 2 * PIECE
        padded = np.pad(text, (edge, edge + PIECE))
        for w in self.places:
            of_w = np.flatnonzero(self.words[piece] == w)
            for x in range(0, len(of_w), 4_000):
                some = of_w[x : x + 4_000]
                p, a, b = piece[some], start[some], stop[some]
                if len(some) < FEW:
                    near = np.array([nearest(self.parts[k][2], joined[max(0, i) : max(0, j)])[0] <= self.limit[k] for k, i, j in zip(p.tolist(), a.tolist(), b.tolist(), strict=True)], bool)
                else:
                    near = self._least(w, p, padded, a + edge, b - a) <= self.limit[p]
                yield from zip(p[near].tolist(), a[near].tolist(), b[near].tolist(), strict=True)

    def _least(self, words: int, piece: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Least distance of each piece to a part of its stretch, side by side; characters with equal signs are equal, so it is never above the exact one."""
        order = np.argsort(-size, kind="stable")
        piece, start, size = piece[order], start[order], size[order]
        places, row, n = self.places[words], self.row[piece] * 128, self.size[piece]
        zero, one, top = np.zeros(len(piece), "u8"), np.uint64(1), np.uint64(63)
        up, down = [~zero for _ in range(words)], [zero.copy() for _ in range(words)]
        last = ((n - 1) % 64).astype("u8")
        score, best = n.copy(), n.copy()
        live = len(piece)
        for step in range(int(size[0])):
            while size[live - 1] <= step:
                live -= 1
            r = row[:live] + text[start[:live] + step]
            more, less = zero[:live], zero[:live]
            for w in range(words):
                eq, p, m = places[w].take(r), up[w][:live], down[w][:live]
                keep = eq | m
                eq |= less
                x = (((eq & p) + p) ^ p) | eq
                plus, minus = m | ~(x | p), p & x
                bit = last[:live] if w == words - 1 else top
                above, below = plus >> bit, minus >> bit
                plus, minus = plus << one | more, minus << one | less
                up[w][:live], down[w][:live] = minus | ~(keep | plus), plus & keep
                more, less = above, below
            score[:live] += (more & one).view("i8") - (less & one).view("i8")
            np.minimum(best[:live], score[:live], out=best[:live])
        out = np.empty_like(best)
        out[order] = best
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text the items that it holds: (item, distance, item's characters, first word)."""
        out: list[list] = [[] for _ in texts]
        plain = [" ".join(split(t)) for t in texts]
        if not self.parts:
            return out
        for part in pieces(plain, TEXT_CHARS):
            some = plain[part]
            firsts = np.cumsum([0] + [len(t) + 1 for t in some])
            spots: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for p, a, b in self._stretches("\n".join(some)):
                k, offset, own = self.parts[p]
                if len(own) < len(self.texts[k]):
                    # The rest of the item may stand as much further off as the limit says.
                    slack = int(self.distance * len(self.texts[k]))
                    a, b = a - offset - slack, b + len(self.texts[k]) - offset - len(own) + slack
                for d in range(max(0, int(np.searchsorted(firsts, a, "right")) - 1), min(len(some), int(np.searchsorted(firsts, b, "left")))):
                    spots[d, k].append((max(0, a - int(firsts[d])), b - int(firsts[d])))
            for (d, k), found in sorted(spots.items()):
                hit = self._held(k, some[d], sorted(found))
                if hit:
                    out[part.start + d] += [(i, *hit) for i in self.members[k]]
        return out

    def _held(self, k: int, text: str, stretches: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        pattern = self.texts[k]
        limit = int(self.distance * len(pattern))
        best: tuple[int, int] | None = None
        a, until = stretches[0]
        for x, y in [*stretches[1:], (sys.maxsize, 0)]:
            if x <= until:
                until = max(until, y)
                continue
            if min(until, len(text)) - a >= len(pattern) - limit:
                e, end = nearest(pattern, text[a:until])
                if best is None or e < best[0]:
                    best = e, a + end
            a, until = x, y
        if best is None or best[0] > limit:
            return None
        # Read backwards from the place's end, the same distance ends where the place starts.
        _, back = nearest(pattern[::-1], text[max(0, best[1] - len(pattern) - best[0]) : best[1]][::-1])
        return best[0], len(pattern), text.count(" ", 0, max(0, best[1] - back))


def item_chunks(items: DataFrame, limit: int = CHUNK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in chunks of about ``limit`` characters."""
    rows = items.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        if part:
            yield sorted(((r.i, r.t) for r in part), key=lambda r: (r[0] is None, r[0], r[1]))


_ROWS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_chars", pa.int64()), ("at_word", pa.int64())])


def _matches(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, TEXT_CHARS):
            rows = [(i, *hit) for i, hits in zip(ids, index.search(texts), strict=True) for hit in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return run


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, at_word) of documents that hold an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    ddl = "doc_id long, item_id long, distance long, item_chars long, at_word long"
    out = rows.sparkSession.createDataFrame([], ddl)
    for chunk in item_chunks(items):
        out = out.unionByName(rows.mapInArrow(frugal(_matches(Index(chunk, **options))), ddl))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    place = docs.columns.index("text")

    def without(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not hits for hits in index.search(batch.column(place).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for chunk in item_chunks(items):
        docs = docs.mapInArrow(frugal(without(Index(chunk, **options))), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
