"""Token counts without token ids: each distinct pre-token is encoded once.

A sentencepiece BPE model whose pieces hold the word mark only as a prefix never merges
across the start of a run of marks, so a text's pieces are those of its pre-tokens: a run
of marks and what follows it up to the next run. The plan:

1. per block of documents, its distinct pre-tokens with the documents that hold each and
   how often, packed into one row for each bucket of the pre-tokens' hash;
2. shuffled and sorted by bucket, each bucket's distinct pre-tokens are encoded once, the
   piece counts are joined to the frequencies, and sums per document are combined while
   they come and leave the task in bounded arrays;
3. summed per block.

A pre-token that stands in every document costs one entry a block and two bytes a document.
Buckets are ``BUCKETS_A_PARTITION`` to a shuffle partition, so that a partition is worked
off in small parts.

Defined results: null text is empty and has 0 tokens; rows with a null or repeated
``doc_id`` are counted each for itself; an empty table gives an empty result; columns other
than the two named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, frugal, shuffle_partitions, table, tokenizer_path

#: The word mark of sentencepiece.
MARK = "▁"
PRE_TOKEN = re.compile("▁+[^▁]*")
BUCKETS_A_PARTITION = 4
#: Kinds: 0 a block's documents, 1 its pre-tokens of a bucket, 2 sums of its documents.
ROWS = "bucket int, block long, kind int, words binary, sizes binary, docs binary, times binary"
_RS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("words", "sizes", "docs", "times"))])
SUMS = "block long, kind int, a binary, b binary"
_SS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, the dummy prefix included."""
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def _frequencies(block_chars: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, texts) in enumerate(blocks(batches, block_chars)):
            block = part << 24 | n
            known: dict[str, int] = {}
            each, docs, times = [], [], []
            sizes = np.zeros(len(ids), "<i8")
            for k, text in enumerate(texts):
                sizes[k] = len(text.encode())
                words, often = np.unique(np.array([known.setdefault(w, len(known)) for w in pre_tokens(text)], "<u4"), return_counts=True)
                each.append(words)
                docs.append(np.full(len(words), k, "<u2"))
                times.append(often.astype("<u4"))
            there = np.array([i is not None for i in ids], "u1")
            meta = np.array([0 if i is None else i for i in ids], "<i8")
            yield _batch([(block % buckets, block, 0, meta.tobytes(), sizes.tobytes(), there.tobytes(), None)], _RS)
            if not known:
                continue
            raw = [w.encode() for w in known]
            hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in raw), "<u8", len(raw)) % np.uint64(buckets)
            words, docs, times = np.concatenate(each), np.concatenate(docs), np.concatenate(times)
            # Pairs by bucket, then word.
            rank = np.argsort(hashed, kind="stable")
            place = np.empty(len(rank), "<i8")
            place[rank] = np.arange(len(rank))
            order = np.argsort(place[words], kind="stable")
            docs, times = docs[order], times[order]
            pairs = np.concatenate([[0], np.cumsum(np.bincount(place[words], minlength=len(raw)))])
            edges = np.searchsorted(hashed[rank], np.arange(buckets + 1).astype("<u8"))
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                own = [raw[i] for i in rank[a:b]]
                lengths = np.array([list(map(len, own)), np.diff(pairs[a : b + 1])], "<u4")
                out.append((k, block, 1, b"".join(own), lengths.tobytes(), docs[pairs[a] : pairs[b]].tobytes(), times[pairs[a] : pairs[b]].tobytes()))
            yield _batch(out, _RS)

    return run


def _piece_sums(model: str, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        counts: dict[bytes, int] = {}
        sums: dict[int, np.ndarray] = {}
        now, size = None, 0

        def flush():
            return _batch([(b, 1, s.tobytes(), None) for b, s in sums.items()], _SS)

        for batch in batches:
            for bucket, block, kind, words, lengths, docs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    yield _batch([(block, 0, words + lengths, docs)], _SS)
                    continue
                if bucket != now:
                    now, counts = bucket, {}
                chars, pairs = np.frombuffer(lengths, "<u4").reshape(2, -1)
                ends = np.cumsum(chars).tolist()
                own = [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                new = [w for w in own if w not in counts]
                counts.update(zip(new, piece_counts(pieces, [w.decode() for w in new]), strict=True))
                n = np.repeat(np.fromiter(map(counts.__getitem__, own), "<i8", len(own)), pairs)
                got = np.bincount(np.frombuffer(docs, "<u2"), weights=n * np.frombuffer(times, "<u4")).astype("<i8")
                s = sums.get(block)
                if s is None or len(s) < len(got):
                    size += len(got) - (0 if s is None else len(s))
                    if s is not None:
                        got[: len(s)] += s
                    sums[block] = got
                else:
                    s[: len(got)] += got
                if size > held:
                    yield flush()
                    sums, size = {}, 0
        if sums:
            yield flush()

    return run


def piece_counts(pieces, words: list[str]) -> list[int]:
    """Pieces of each pre-token. The model puts one mark in front of what it is given, so one is left off."""
    counts = list(map(len, pieces.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1))) if words else []
    if MARK in words:  # of an empty string the model makes nothing
        counts[words.index(MARK)] = len(pieces.encode("x ")) - len(pieces.encode("x"))
    return counts


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    block, total = None, None
    ids = there = sizes = None

    def done():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=there == 0), pa.array(sizes, pa.int64()), pa.array(total, pa.int64())], schema=schema)

    for batch in batches:
        for b, kind, a, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if kind == 0:
                if block is not None:
                    yield done()
                block = b
                ids, sizes = np.split(np.frombuffer(a, "<i8"), 2)
                there, total = np.frombuffer(c, "u1"), np.zeros(len(ids), "<i8")
            else:
                s = np.frombuffer(a, "<i8")
                total[: len(s)] += s
    if block is not None:
        yield done()


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, block_chars: int = 16_000_000, held_sums: int = 4_000_000
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``.

    ``block_chars`` bounds a block's text and ``held_sums`` the 8-byte sums that a task
    holds before it hands them on.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(_frequencies(block_chars, BUCKETS_A_PARTITION * parts)), ROWS)
    sums = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_piece_sums(model, held_sums)), SUMS)
    return sums.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
