"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word (hashed) and one of its character n-grams
(hashed, with the word's ends). Forward and backward gated units run over windows of
words, attention pools their states, and one unit gives the window's logit. A text's score
is that of its highest window; windows overlap by half and cover the whole text.

Training takes labelled documents with many windows and one label: each round picks every
document's highest window and learns from it. First coordinates of the embeddings start
from smoothed log odds of their words and n-grams, so that the first picks are no guess.

Input projections depend on the word alone and are computed once while a word is
remembered; per window only the recurrent part is left.

Defined results: null text is empty; a text without words has the training labels' share of
toxic ones as score; without labelled rows of both kinds every score is that share (0
without any); repeated labels of a document count as toxic if one says so, null ones as
none; all rows are scored, those with null or repeated ids too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, pieces, table, trim

WORD = re.compile(r"\w+")
#: Window and step in words.
WINDOW, STEP = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
GRAMS = (3, 4, 5)
#: Documents of each label that training takes at most, by ascending hash of the id.
TRAIN_DOCS = 2000
#: Characters of each label that training takes at most.
TRAIN_CHARS = 20_000_000


def split(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Gram buckets of all words in one array, and the offset of each word's first."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.fromiter(map(len, raw), "i8", len(raw))
    data = np.frombuffer(b"".join(raw) + bytes(max(GRAMS)), "u1").astype("u4")
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    out, own = [], []
    h = np.zeros(size.sum(), "u4")
    for n in range(1, max(GRAMS) + 1):
        h = (h ^ data[n - 1 : n - 1 + len(h)]) * np.uint32(0x01000193)
        if n in GRAMS:
            # A word shorter than n gives its whole as the only gram.
            ok = left >= n
            out.append(((h[ok] ^ h[ok] >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(16)) & np.uint32(GRAM_BUCKETS - 1))
            own.append(owner[ok])
    out, own = np.concatenate(out), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(raw))
    return out[order].astype("u2"), np.concatenate([[0], np.cumsum(counts)])


def all_grams(words: list[str], some: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of many words, made of some at a time."""
    parts = [grams(words[k : k + some]) for k in range(0, len(words), some)]
    sizes = np.concatenate([np.diff(at) for _, at in parts]) if parts else np.zeros(0, "i8")
    return np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, "u2"), np.concatenate([[0], np.cumsum(sizes)])


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) & (WORD_BUCKETS - 1) for w in words), "i8", len(words))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of each window of documents of so many words."""
    n = np.maximum(1, -(-(np.maximum(sizes, 1) - WINDOW) // STEP) + 1)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, nth * STEP


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray]
    base: float = 0.0

    @staticmethod
    def new(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype("f4")
        d = WORD_DIM + GRAM_DIM
        p = {"word": normal(WORD_BUCKETS, WORD_DIM, scale=0.05), "gram": normal(GRAM_BUCKETS, GRAM_DIM, scale=0.05)}
        for way in "fb":
            p[f"W{way}"] = normal(d, 3 * HIDDEN, scale=d**-0.5)
            p[f"U{way}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            p[f"b{way}"] = np.zeros(3 * HIDDEN, "f4")
        p["A"] = normal(2 * HIDDEN, ATTEND, scale=(2 * HIDDEN) ** -0.5)
        p["a"] = np.zeros(ATTEND, "f4")
        p["v"] = normal(ATTEND, scale=ATTEND**-0.5)
        p["o"] = normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5)
        p["c"] = np.zeros(1, "f4")
        return Network(p)

    def inputs(self, buckets: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Embeddings of words: their own, and the sum of their grams' over the root of their number."""
        out = np.zeros((len(buckets), WORD_DIM + GRAM_DIM), "f4")
        out[:, :WORD_DIM] = self.p["word"][buckets]
        n = np.diff(at)
        some = n > 0
        if some.any():
            sums = np.add.reduceat(self.p["gram"][gram], at[:-1][some], axis=0)
            out[some, WORD_DIM:] = sums / np.sqrt(n[some])[:, None]
        return out

    def projections(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def table(self, bucket: np.ndarray, gram: np.ndarray, at: np.ndarray, some: int = 20_000) -> np.ndarray:
        """Projections of many words, made of some at a time."""
        out = np.empty((len(bucket), 6 * HIDDEN), "f4")
        for k in range(0, len(bucket), some):
            n = min(k + some, len(bucket))
            out[k:n] = self.projections(self.inputs(bucket[k:n], gram[at[k] : at[n]], at[k : n + 1] - at[k]))
        return out

    def _run(self, way: str, q: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction from its projections (batch, window, 3 * hidden)."""
        u, h = self.p[f"U{way}"], np.zeros((len(q), HIDDEN), "f4")
        states = np.empty((q.shape[1], len(q), HIDDEN), "f4")
        saved = [None] * q.shape[1]
        order = range(q.shape[1]) if way == "f" else range(q.shape[1] - 1, -1, -1)
        for t in order:
            g, x, m = h @ u, q[:, t], mask[:, t, None]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep:
                saved[t] = (h, z, r, n, g[:, 2 * HIDDEN :])
            h = np.where(m, new, h)
            states[t] = h
        return states.transpose(1, 0, 2), saved

    def logits(self, table_: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Of windows of table rows; with what the gradients need if it is to be kept."""
        q = table_[rows]
        hf, sf = self._run("f", q[:, :, : 3 * HIDDEN], mask, keep)
        hb, sb = self._run("b", q[:, :, 3 * HIDDEN :], mask, keep)
        h = np.concatenate([hf, hb], 2)
        k = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask, k @ self.p["v"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        w = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * h).sum(1)
        out = pooled @ self.p["o"] + self.p["c"]
        return (out, (q, h, k, w, pooled, sf, sb)) if keep else out

    def gradients(self, rows, mask, target, out, saved, x):
        """Of the mean log loss, by parameter; "x" of the distinct words' embeddings."""
        q, h, k, w, pooled, sf, sb = saved
        p, g = self.p, {}
        d = ((_sigmoid(out) - target) / len(out)).astype("f4")
        g["o"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * p["o"]
        dh = w[:, :, None] * dpool[:, None, :]
        dw = (h * dpool[:, None, :]).sum(2)
        de = w * (dw - (dw * w).sum(1, keepdims=True))
        g["v"] = np.einsum("bt,bta->a", de, k)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["A"], g["a"] = np.einsum("bth,bta->ha", h, dk), dk.sum((0, 1))
        dh += dk @ p["A"].T
        dx = np.zeros_like(x)
        flat = rows.ravel()
        for way, s, part in (("f", sf, slice(0, HIDDEN)), ("b", sb, slice(HIDDEN, None))):
            u = p[f"U{way}"]
            gu, dq, carry = np.zeros_like(u), np.zeros((*rows.shape, 3 * HIDDEN), "f4"), np.zeros((len(rows), HIDDEN), "f4")
            order = range(rows.shape[1] - 1, -1, -1) if way == "f" else range(rows.shape[1])
            for t in order:
                before, z, r, n, gn = s[t]
                m = mask[:, t, None]
                now = carry + dh[:, t, part]
                dn = np.where(m, now * (1 - z) * (1 - n * n), 0)
                dz = np.where(m, now * (before - n) * z * (1 - z), 0)
                dr = dn * gn * r * (1 - r)
                dq[:, t] = np.concatenate([dz, dr, dn], 1)
                back = np.concatenate([dz, dr, dn * r], 1)
                gu += before.T @ back
                carry = np.where(m, now * z, now) + back @ u.T
            g[f"U{way}"], g[f"b{way}"] = gu, dq.sum((0, 1))
            sums = np.zeros((len(x), 3 * HIDDEN), "f4")
            np.add.at(sums, flat, dq.reshape(-1, 3 * HIDDEN))
            g[f"W{way}"] = x.T @ sums
            dx += sums @ p[f"W{way}"].T
        g["x"] = dx
        return g


def _spans(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of all grams of some words."""
    n = at[words + 1] - at[words]
    return np.repeat(at[words] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _log_odds(documents: Iterator[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of a bucket's standing in a toxic document."""
    counts = np.zeros((2, size))
    for buckets, label in zip(documents, toxic, strict=True):
        counts[int(label), np.unique(buckets)] += 1
    ratio = toxic.mean() / (1 - toxic.mean())
    return np.log((counts[1] + 1) / (counts[0] * ratio + 1)).astype("f4")


def train(texts: list[str], labels: list[int], base: float, rounds: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Network:
    """Fits a network; ``base`` is the score of texts without words."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    net.base = base
    toxic = np.array(labels, "f4")
    if not len(toxic) or toxic.min() == toxic.max():
        return Network({}, base)
    known: dict[str, int] = {}
    each = [np.array([known.setdefault(w, len(known)) for w in split(t)], "i4") for t in texts]
    sizes, ids = np.array([len(x) for x in each]), np.concatenate(each)
    bucket, (gram, at) = word_buckets(list(known)), all_grams(list(known))
    per = np.diff(at)
    net.p["word"][:, 0] = 0.5 * _log_odds((bucket[np.unique(x)] for x in each), toxic, WORD_BUCKETS)
    net.p["gram"][:, 0] = 0.5 * _log_odds((gram[_spans(at, np.unique(x))] for x in each), toxic, GRAM_BUCKETS)
    doc, first = windows(sizes)
    at_doc = np.cumsum(sizes) - sizes
    place = (at_doc[doc] + first)[:, None] + np.arange(WINDOW)
    mask = first[:, None] + np.arange(WINDOW) < sizes[doc][:, None]
    rows = np.where(mask, ids[np.minimum(place, max(len(ids) - 1, 0))] if len(ids) else 0, 0).astype("i4")
    del place
    # For the first pick the start values alone decide: the highest sum in a window.
    value = net.p["word"][bucket, 0] + np.maximum.reduceat(net.p["gram"][gram, 0], at[:-1]) * (per > 0) if len(gram) else net.p["word"][bucket, 0]
    highest = np.where(mask, value[rows], -1e9).max(1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            table_ = net.table(bucket, gram, at)
            highest = np.concatenate([net.logits(table_, rows[k : k + 2048], mask[k : k + 2048]) for k in range(0, len(rows), 2048)])
        order = np.lexsort((-highest, doc))
        top = order[np.concatenate([[True], np.diff(doc[order]) > 0])]
        # Of clean documents a window at random as well.
        clean = np.flatnonzero(toxic[doc] < 0.5)
        more = rng.choice(clean, size=min(len(clean), len(top) // 2), replace=False)
        chosen = np.concatenate([top, more])
        for _ in range(2):
            rng.shuffle(chosen)
            for k in range(0, len(chosen), batch):
                c = chosen[k : k + batch]
                words, inverse = np.unique(rows[c], return_inverse=True)
                own = _spans(at, words)
                local = np.concatenate([[0], np.cumsum(per[words])])
                x = net.inputs(bucket[words], gram[own], local)
                inverse = inverse.reshape(rows[c].shape)
                out, saved = net.logits(net.projections(x), inverse, mask[c], keep=True)
                g = net.gradients(inverse, mask[c], toxic[doc[c]], out, saved, x)
                dx = g.pop("x")
                step += 1
                for name, grad in g.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    net.p[name] -= rate / 4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
                dgram = np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(per[words], 1))[:, None], per[words], 0)
                for name, where, grad in (("word", bucket[words], dx[:, :WORD_DIM]), ("gram", gram[own], dgram)):
                    spots, back = np.unique(where, return_inverse=True)
                    sums = np.zeros((len(spots), grad.shape[1]), "f4")
                    np.add.at(sums, back, grad)
                    moments[name][1][spots] += sums * sums
                    net.p[name][spots] -= rate * sums / (np.sqrt(moments[name][1][spots]) + 1e-6)
    return net


class Scorer:
    """Scores whole texts; remembers the projections of up to ``kept`` words."""

    def __init__(self, net: Network, kept: int = 150_000):
        self.net, self._kept = net, kept
        self._known: dict[str, int] = {}
        self._table = np.zeros((1 << 12, 6 * HIDDEN), "f4")

    def _rows(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._kept:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            n = len(known)
            while len(self._table) < n + len(new):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self._table[n + k : n + k + len(part)] = self.net.projections(self.net.inputs(word_buckets(part), *grams(part)))
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), "i8", len(words))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.net.base)
        if not self.net.p:
            return out
        split_ = [split(t) for t in texts]
        sizes = np.array([len(x) for x in split_], "i8")
        if not sizes.sum():
            return out
        ids = self._rows([w for x in split_ for w in x])
        doc, first = windows(sizes)
        at = np.cumsum(sizes) - sizes
        top = np.full(len(texts), -np.inf)
        for k in range(0, len(doc), 2048):
            d, f = doc[k : k + 2048], first[k : k + 2048, None] + np.arange(WINDOW)
            mask = f < sizes[d][:, None]
            rows = np.where(mask, ids[np.minimum(at[d][:, None] + f, len(ids) - 1)], 0)
            np.maximum.at(top, d, self.net.logits(self._table, rows, mask))
        some = sizes > 0
        out[some] = _sigmoid(top[some].astype("f8"))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int], float]:
    """Texts and labels to learn from, at most ``per_label`` and ``chars`` of each label, and the share of toxic ones.

    Rows whose crc32 of the id's decimal text is divisible by 5 are held out. Of an id's texts
    the shortest is taken; one that would exceed ``chars`` is passed over.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("l_toxic"))
    one = one.where(F.crc32(F.col("l_id").cast("string")) % 5 != 0)
    share = one.agg(F.avg("l_toxic")).first()[0] or 0.0
    mixed = F.xxhash64(F.lit(11), "l_id")
    some = [one.where(F.col("l_toxic") == k).orderBy(mixed, "l_id").limit(per_label) for k in (0, 1)]
    ids = {r.l_id: r.l_toxic for r in some[0].unionByName(some[1]).collect()}  # 2 * per_label rows at most
    if not ids:
        return [], [], share
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = spark.createDataFrame([(k,) for k in ids], "l_id long")
    sizes = rows.join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("id", F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h")).alias("t")).groupBy("id").agg(F.min("t").alias("t"))
    left, wanted = {0: chars, 1: chars}, []
    for i, n, h in sorted((r.id, r.t.n, r.t.h) for r in sizes.collect()):  # a row for each chosen id at most
        if n <= left[ids[i]]:
            left[ids[i]] -= n
            wanted.append((i, h))
    picked = spark.createDataFrame(wanted, "l_id long, l_hash long")
    texts = rows.join(F.broadcast(picked), (F.col("id") == F.col("l_id")) & (F.xxhash64("text") == F.col("l_hash"))).dropDuplicates(["l_id"])
    found = sorted((r.id, r.text) for r in texts.select("id", "text").collect())
    return [t for _, t in found], [ids[i] for i, _ in found], share


def fit(docs: DataFrame, labels: DataFrame, **options) -> Network:
    net = train(*labelled_sample(docs, labels), **options)
    trim()
    return net


def with_scores(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col``; other columns pass through as they are."""
    kept = docs.columns
    fields = [f for f in docs.schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    place, schema = kept.index(text_col), StructType([*fields, StructField(score_col, DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(net)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            out = [score(texts[part]) for part in pieces(texts, 1_000_000)]
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), scores], schema=arrow)

    return docs.mapInArrow(frugal(run), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.select("doc_id", "text"), net)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
