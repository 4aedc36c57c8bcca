"""N-gram Jaccard join by vertical partitioning, and the groups that its links form.

A document's set holds its distinct shingles (64-bit hashes of n words). All shingles have
one global order, rarest first. The order is cut into fragments by document frequency; the
overlap of a pair is counted in each fragment for itself and summed per pair.

1. Per block of documents, the shingles go to ranges of their hash; a range's task sees
   which ones stand in two documents or more and with what frequency, and answers to the
   blocks. A shingle of one document only cannot be shared: it is counted, never sent back.
2. A document of n shingles needs a partner among its first n - ceil(t n) + 1 in the global
   order. Its unshared ones come first in that order, so most documents end here.
3. Equal sets are one class from here on. In each posting list of the rest, neighbours in a
   random order are tested, by fragments; the classes they join are components.
4. What is left to test are pairs of different components in one posting list: all of them
   are tested whose parts in the fragments, and in finer ones by hash, are large enough to link
   at all. Pairs inside one component need no test, so a group of thousands of near copies
   doesn't grow to all its pairs; in one of near copies that don't link, whose shingles differ
   in different places, the finer parts tell most pairs apart. No link is lost.

Defined results: null text is empty; documents without words have 0 shingles and are alone;
documents of fewer words than n have the whole as their only shingle; rows with null or
repeated ids are documents of their own, and null is never a group's smallest id unless it
has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, dropped, frugal, shuffle_partitions, stored, table, unused
from .words import Words

#: Ranges of shingle hashes to a shuffle partition; a task works off one at a time.
RANGES_A_PARTITION = 4
#: Document frequencies at which the global order is cut.
CUTS = (8, 64)
#: Posting lists are dealt out in parts of about so many for the neighbour test.
PART = 256
#: Shingles at each end of a prefix, the rarest and the most frequent, that name lists for it.
ENDS = 4
#: Further neighbour tests between components.
ROUNDS = 3
#: Parts by hash whose sizes bound a pair's overlap, and bits of each; posting lists from which on they are used.
LANES, LANE_BITS = 64, 16
LANE_COLUMNS = [*(f"l{k}" for k in range(LANES * LANE_BITS // 64)), "over"]
LARGE = 64

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_RS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])
ROWS = "bucket int, block long, kind int, a binary, b binary, c binary, d binary"


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: Words, text: str, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Lower-cases A-Z; words are parted by ASCII white space."""
    h = words.hashes(text.encode().lower().split())
    if not len(h):
        return h
    width = min(n, len(h))
    mixed = np.zeros(len(h) - width + 1, "<u8")
    for j in range(width):
        mixed = (mixed + h[j : len(h) - width + 1 + j]) * _MIX[j % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_finish(mixed + np.uint64(width)))


def _batch(rows: list[tuple], schema: pa.Schema = _RS) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


#: Low bits of a hash that are sent; with its range they name a shingle.
LOW = np.uint64((1 << 48) - 1)
#: Larger document frequencies count as this one in the order.
MOST = 65_535


def _pack(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes."""
    return h.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _to_ranges(n: int, block_chars: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words = TaskContext.get().partitionId(), Words()
        for k, (ids, texts) in enumerate(blocks(batches, block_chars)):
            block = part << 24 | k
            seen: set[bytes] = set()
            sets, docs, sizes, digests, hashes = [], [], np.zeros(len(ids), "<i8"), [], []
            for i, text in enumerate(texts):
                s = shingles(words, text, n)
                sizes[i] = len(s)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                digests.append(digest)
                hashes.append(xxhash.xxh64_intdigest(text.encode(), 42))
                # Of equal sets in a block one stands for all.
                if len(s) and digest not in seen:
                    seen.add(digest)
                    sets.append(s)
                    docs.append(np.full(len(s), i, "<u2"))
            known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + sizes.tobytes() + np.array(hashes, "<u8").tobytes()
            yield _batch([(block % buckets, block, 0, known, np.array([i is not None for i in ids], "u1").tobytes(), b"".join(digests), None)])
            if not sets:
                continue
            all_, docs = np.concatenate(sets), np.concatenate(docs)
            order = np.argsort(all_, kind="stable")
            all_, docs = all_[order], docs[order]
            own = (all_ >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = np.searchsorted(own, np.arange(buckets + 1).astype("<u8"))
            yield _batch([(b, block, 1, _pack(all_[edges[b] : edges[b + 1]]), docs[edges[b] : edges[b + 1]].tobytes(), None, None) for b in np.flatnonzero(np.diff(edges)).tolist()])

    return run


def _shared(held: int):
    """Of each range the shingles that two documents have: hash, document and frequency, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list] = {}
        size, now, rows = 0, None, []

        def done():
            nonlocal size
            h = np.concatenate([_unpack(a) for _, a, _ in rows])
            docs = np.concatenate([np.frombuffer(b, "<u2") for _, _, b in rows])
            owner = np.repeat(np.arange(len(rows)), [len(a) // 6 for _, a, _ in rows])
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.concatenate([first, [len(h)]]))
            df = np.repeat(times, times)
            keep = df > 1
            # Again 64 bits: of the range and the bits sent.
            h = _finish(h[keep] + np.array([now + 1], "<u8") * _MIX[0])
            df, place = np.minimum(df[keep], MOST).astype("<u2"), order[keep]
            owner, docs = owner[place], docs[place]
            back = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[back], np.arange(len(rows) + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                at = back[edges[k] : edges[k + 1]]
                answers.setdefault(rows[k][0], []).append((h[at], docs[at], df[at]))
                size += len(at)

        def flush():
            nonlocal answers, size
            out = _batch([(0, block, 1, *(np.concatenate(x).tobytes() for x in zip(*parts, strict=True)), None) for block, parts in answers.items()])
            answers, size = {}, 0
            return out

        for batch in batches:
            for bucket, block, kind, a, b, c, _ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    yield _batch([(0, block, 0, a, b, c, None)])
                    continue
                if bucket != now and rows:
                    done()
                    rows = []
                    if size > held:
                        yield flush()
                now = bucket
                rows.append((block, a, b))
        if rows:
            done()
        if answers:
            yield flush()

    return run


_DS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("prefix", pa.list_(pa.int64())), *((f"f{k}", pa.list_(pa.int64())) for k in range(len(CUTS) + 1))])
DOCS = "doc_id long, text_hash long, n_shingles long, cls binary, prefix array<long>, " + ", ".join(f"f{k} array<long>" for k in range(len(CUTS) + 1))


def _lists(values: np.ndarray, counts: np.ndarray, there: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("i4"))
    return pa.ListArray.from_arrays(offsets, pa.array(values.view("<i8"), pa.int64()), mask=pa.array(~there))


def _prefixes(least: int, of: int):
    """A row for each document: those that may have a partner have their prefix and fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, parts = None, []

        def done():
            a, b, c = meta
            ids, sizes, hashes = np.split(np.frombuffer(a, "<i8"), 3)
            known = np.frombuffer(b, "u1")
            n = len(ids)
            h, docs, df = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(("<u8", "<u2", "<u2")))
            shared = np.bincount(docs, minlength=n)
            # n - ceil(t n) + 1, less those that no other document has.
            prefix = np.minimum(sizes - -(-least * sizes // of) + 1 - (sizes - shared), shared)
            may = (prefix > 0) & (shared > 0)
            keep = may[docs]
            h, docs, df = h[keep], docs[keep], df[keep]
            order = np.lexsort((h, df, docs))
            h, docs, df = h[order], docs[order], df[order]
            starts = np.cumsum(np.bincount(docs, minlength=n))
            starts = np.concatenate([[0], starts])[:-1]
            nth = np.arange(len(h)) - starts[docs]
            chosen = nth < prefix[docs]
            fragment = np.searchsorted(CUTS, df, side="right")
            lists = [_lists(h[chosen], np.bincount(docs[chosen], minlength=n), may)]
            for k in range(len(CUTS) + 1):
                of_k = fragment == k
                lists.append(_lists(h[of_k], np.bincount(docs[of_k], minlength=n), may))
            cls = pa.array([c[16 * i : 16 * i + 16] if s else None for i, s in enumerate(sizes.tolist())], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), cls, *lists], schema=_DS)

        for batch in batches:
            for _, _, kind, a, b, c, _ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    if meta is not None:
                        yield done()
                    meta, parts = (a, b, c), []
                else:
                    parts.append((a, b, c))
        if meta is not None:
            yield done()

    return run


def shingle_table(docs: DataFrame, n: int, least: int, of: int, block_chars: int = 4_000_000, held: int = 2_000_000) -> DataFrame:
    """Steps 1 and 2: (doc_id, text_hash, n_shingles, cls, prefix, f0, f1, ...) of every row."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).mapInArrow(frugal(_to_ranges(n, block_chars, RANGES_A_PARTITION * parts)), ROWS)
    back = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_shared(held)), ROWS)
    return back.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(frugal(_prefixes(least, of)), DOCS)


SIZES = [f"c{k}" for k in range(len(CUTS) + 1)]


def sized(classes: DataFrame) -> DataFrame:
    """With the number of shared shingles in each fragment."""
    return classes.withColumns({c: F.size(f"f{k}").cast("long") for k, c in enumerate(SIZES)})


def fitting(n_a: Column, n_b: Column, a: list[Column], b: list[Column], least: int, of: int) -> Column:
    """Whether sets of such sizes can link: no fragment's overlap is above its smaller part."""
    most = sum((F.least(x, y) for x, y in zip(a, b, strict=True)), F.lit(0))
    return most * of >= (n_a + n_b - most) * least


def linked(pairs: DataFrame, classes: DataFrame, least: int, of: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that link: overlaps by fragment, summed per pair."""
    fragments = classes.select("cls", "n_shingles", F.posexplode(F.array(*[f"f{k}" for k in range(len(CUTS) + 1)])).alias("fragment", "own")).where("size(own) > 0")
    left = fragments.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n_a"), "fragment", F.col("own").alias("own_a"))
    right = fragments.select(F.col("cls").alias("b"), F.col("n_shingles").alias("n_b"), "fragment", F.col("own").alias("own_b"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = F.size(F.array_intersect("own_a", "own_b")).cast("long")
    sums = both.select("a", "b", "n_a", "n_b", partial.alias("part")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("common"))
    return sums.where((F.col("common") * of) >= (F.col("n_a") + F.col("n_b") - F.col("common")) * least).select("a", "b")


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each class by lane, as many ones in the lane's bits; what a lane can't hold is counted in all."""
    schema = pa.schema([("cls", pa.binary()), *((c, pa.int64()) for c in LANE_COLUMNS)])
    for batch in batches:
        counts = np.zeros((len(batch), LANES), "<i8")
        for lists in batch.columns[1:]:
            at = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].view("<u8")
            np.add.at(counts, (at, (flat % np.uint64(LANES)).astype("i8")), 1)
        ones = ((1 << np.minimum(counts, LANE_BITS)) - 1).astype("<u2")
        packed = np.ascontiguousarray(ones).view("<i8")
        over = np.maximum(counts - LANE_BITS, 0).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(packed[:, k]), pa.int64()) for k in range(packed.shape[1])), pa.array(over, pa.int64())], schema=schema)


def lanes(classes: DataFrame) -> DataFrame:
    """(cls, l0, l1, ..., over): the fragments cut finer, by hash into ``LANES`` parts, of which only the sizes are kept."""
    ddl = "cls binary, " + ", ".join(f"{c} long" for c in LANE_COLUMNS)
    return classes.select("cls", *[f"f{k}" for k in range(len(CUTS) + 1)]).mapInArrow(frugal(_lanes), ddl)


def lane_bound(a: list[Column], b: list[Column]) -> Column:
    """Most common shingles by lanes: ones that stand in both, and the lesser of what the lanes couldn't hold."""
    return sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a[:-1], b[:-1], strict=True)), F.least(a[-1], b[-1]))


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node that has no other edge to the middle of its star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return nodes.agg(F.count(F.when(F.col("ups") > 0, F.when(F.col("n") > 1, 1)))).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of edges (a, b): stars are drawn together until nothing else is left.

    Alternates large-star and small-star; each joins a node's smallest neighbour, found by an
    aggregate, to its edges. A star's edges are narrow rows of one key: adaptive execution splits
    a partition of them that is large. Whether only stars are left is asked by one aggregate, not
    by another step that changes nothing: plans and tasks of steps are what the driver has to hold.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        # An edge of each, not distinct: no more than there were, and the last line makes them so.
        large = now.join(least, "b").select("a", F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, name)
        dropped(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _contracted(roots: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """(node, root) after further links (a, b): components of the roots that they join."""
    ends = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    over = stored(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), name)
    top = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(moved.unionByName(over.join(roots, "node", "left_anti")), name)


def _open_lists(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Posting lists that hold more than one component, with each row's root and the largest one."""
    known = postings.join(roots, postings["cls"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
    by_root = known.groupBy("h", "root").agg(F.count("*").alias("n"))
    major = by_root.groupBy("h").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("major")).where("roots > 1").select("h", "major")
    return stored(known.join(major, "h"), "join-open")


def _neighbours(rows: DataFrame, seed: int, least: int, of: int) -> DataFrame:
    """Distinct pairs (a, b) of rows that follow each other in a random order of their list and may link."""
    mixed = F.xxhash64("cls", "h", F.lit(seed))
    turn = Window.partitionBy("h", "part").orderBy(mixed, "cls")
    names = ["cls", "n_shingles", *SIZES, *(["root"] if "root" in rows.columns else [])]
    follow = rows.withColumn("part", F.pmod(mixed, F.ceil(F.col("size") / PART))).select(*names, *[F.lead(c).over(turn).alias(f"next_{c}") for c in names])
    cols = lambda *x: [F.col(c) for c in x]
    near = follow.where(F.col("next_cls").isNotNull() & fitting(*cols("n_shingles", "next_n_shingles"), cols(*SIZES), cols(*[f"next_{c}" for c in SIZES]), least, of))
    if "root" in names:
        near = near.where("root <> next_root")
    return near.select(F.least("cls", "next_cls").alias("a"), F.greatest("cls", "next_cls").alias("b")).distinct()


def jaccard_links(classes: DataFrame, least: int, of: int) -> tuple[DataFrame, DataFrame]:
    """Steps 3 and 4 for distinct classes: (links found, (node, root) of all that link)."""
    postings = sized(classes).select("cls", "n_shingles", *SIZES, F.size("prefix").alias("of"), F.posexplode("prefix").alias("pos", "h"))
    ends = (F.col("pos") < ENDS) | (F.col("pos") >= F.col("of") - ENDS)
    # Shared shingles from this one on, in the global order.
    left = sum((F.col(c) for c in SIZES), F.lit(0)) - F.col("pos")
    postings = postings.withColumns({"end": ends, "left": left}).drop("pos", "of")
    counts = postings.groupBy("h").agg(F.count("*").alias("size"), F.min("n_shingles").alias("low")).where("size > 1")
    # The first common shingle of sets that link has their whole overlap after it in both:
    # with the list's smallest set, what is left here must be as much as a link needs.
    postings = postings.join(counts, "h").where(F.col("left") * (of + least) >= (F.col("n_shingles") + F.col("low")) * least).drop("low")
    postings = stored(postings, "join-postings")
    tried = stored(_neighbours(postings.where("end"), 0, least, of), "join-tried")
    links = stored(linked(tried, classes, least, of), "join-links")
    roots = stored(components(links), "join-roots")
    # Again, in other orders, between components only: what links to a large one joins it here.
    for seed in range(1, ROUNDS + 1):
        open_ = _open_lists(postings, roots)
        next_ = stored(_neighbours(open_, seed, least, of).join(tried, ["a", "b"], "left_anti"), "join-tried")
        dropped(open_)
        more = stored(linked(next_, classes, least, of), "join-links")
        tried, links = tried.unionByName(next_), links.unionByName(more)
        if more.isEmpty():
            continue
        roots = _contracted(roots, more, "join-roots")
    # Step 4: every pair of different components.
    open_ = _open_lists(postings, roots)
    dropped(postings)
    # Pairs of small lists are few; their rows carry no lanes.
    fine = stored(lanes(classes.join(open_.where(F.col("size") >= LARGE).select("cls").distinct(), "cls", "left_semi")).withColumnRenamed("cls", "l_cls"), "join-lanes")
    open_ = open_.join(fine, (F.col("cls") == F.col("l_cls")) & (F.col("size") >= LARGE), "left").drop("l_cls")
    minor = open_.where("root <> major").select("h", "cls", "n_shingles", "root", "left", *SIZES, *LANE_COLUMNS)
    other = open_.select("h", F.col("cls").alias("cls2"), F.col("n_shingles").alias("n2"), F.col("root").alias("root2"), F.col("left").alias("left2"), "major", *[F.col(c).alias(f"{c}_2") for c in [*SIZES, *LANE_COLUMNS]])
    cols = lambda *x: [F.col(c) for c in x]
    apart = minor.join(other, "h").where(
        (F.col("root") != F.col("root2"))
        & ((F.col("root2") == F.col("major")) | (F.col("cls") < F.col("cls2")))
        & (F.least("left", "left2") * (of + least) >= (F.col("n_shingles") + F.col("n2")) * least)
        & fitting(*cols("n_shingles", "n2"), cols(*SIZES), cols(*[f"{c}_2" for c in SIZES]), least, of)
        & F.coalesce(lane_bound(cols(*LANE_COLUMNS), cols(*[f"{c}_2" for c in LANE_COLUMNS])) * (of + least) >= (F.col("n_shingles") + F.col("n2")) * least, F.lit(True))
    )
    rest = apart.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = stored(linked(stored(rest, "join-rest"), classes, least, of), "join-more")
    return links.unionByName(more), _contracted(roots, more, "join-final")


def ngram_groups(docs: DataFrame, n: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, found_links, text_hash) of every row of ``docs``.

    Documents link when ``of * common >= least * union``. ``component_id`` is the smallest id
    that links reach; ``found_links`` counts the different sets whose link to this one was found:
    links inside a component that others already join are not looked for; ``text_hash`` is ``xxhash64(text)``.
    """
    rows = stored(shingle_table(docs, n, least, of), "join-docs")
    lowest = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    classes = stored(rows.where("prefix is not null").dropDuplicates(["cls"]).drop("doc_id", "text_hash"), "join-classes")
    links, roots = jaccard_links(classes, least, of)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("found_links"))
    members = roots.join(lowest.withColumnRenamed("cls", "node"), "node")
    groups = members.groupBy("root").agg(F.min("low").alias("component"))
    placed = roots.join(groups, "root").join(ends, "node").select(F.col("node").alias("cls"), "component", "found_links")
    out = rows.select("doc_id", "text_hash", "n_shingles", "cls").join(lowest, "cls", "left").join(placed, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "low", "doc_id").alias("component_id"), F.coalesce("found_links", F.lit(0)).alias("found_links"), "text_hash")


def one_of_each_group(docs: DataFrame, n: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; of rows equal in id and text one."""
    groups = stored(ngram_groups(docs, n, least, of), "join-groups")
    id_, hash_, n = unused(docs, "k_id", "k_hash", "k_n")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.count("*").alias(n))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_))
    single = docs.join(kept.where(F.col(n) == 1), same).select(*[docs[c] for c in docs.columns])
    several = docs.join(kept.where(F.col(n) > 1), same).select(*[docs[c] for c in docs.columns], id_, hash_)
    return single.unionByName(several.dropDuplicates([id_, hash_]).drop(id_, hash_))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"), n=4, least=85, of=100).select("doc_id", "n_shingles", "component_id")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS s FROM w),
c AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS cls, any_value(s) AS s, min(doc_id) AS low FROM s WHERE len(s) > 0 GROUP BY 1),
t AS (SELECT cls, len(s) AS n, unnest(s) AS h FROM c),
f AS (SELECT h FROM t GROUP BY 1 HAVING count(*) > 1),
u AS (SELECT t.* FROM t SEMI JOIN f USING (h)),
p AS (SELECT a.cls AS a, b.cls AS b FROM u a JOIN u b ON a.h = b.h AND a.cls < b.cls AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
      GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 85),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS cls, a AS other FROM e UNION SELECT r.cls, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT r.cls, min(c.low) AS component_id FROM r JOIN c ON c.cls = r.other GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(g.component_id, c.low, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.cls = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN g ON g.cls = c.cls
"""
