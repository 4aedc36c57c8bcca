"""Token-id output: one compressed wavelet matrix per shard.

A shard file holds the ids of a run of documents in ascending ``doc_id`` order. The ids
are cut into bit planes, the highest bit first; before each next plane the ids are split
stably into those with a 0 and those with a 1. With a directory of ones per block of a
plane, ``access``, ``count`` and ``locate`` read a few blocks of each plane only.

File: 8 bytes of mark, u32 header length, a JSON header (zlib), then the blocks of each
plane, each compressed (zstd) for itself. The header has the offsets, the ones before each block,
and the documents' ids and lengths are two more sections.

Defined results: null text is empty and gives the end id alone; rows with null ``doc_id``
come first; repeated ``doc_id`` rows follow each other in the order of their text's hash;
an empty table writes no file and gives no row.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt, blocks, crc32, frugal, get_file, held, put_file, scratch, shuffle_partitions, stored, table, tokenizer_path

MAGIC = b"FLWM0001"
#: Bits of a block that is compressed for itself.
BLOCK_BITS = 1 << 16
BLANKS = re.compile(r"[ \t\r\n]+")


class WaveletMatrix:
    """Rank/select over a compressed file's bytes; blocks are inflated when they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack_from("<I", data, 8)[0]
        head = json.loads(zlib.decompress(data[12 : 12 + size]))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        self._at, self._ones = head["at"], head["ones"]
        self._data, self._base = data, 12 + size
        self._kept: dict[tuple[int, int], np.ndarray] = {}
        self._sections = head["sections"]
        self._unpack = zstandard.ZstdDecompressor().decompress

    @staticmethod
    def build(ids: np.ndarray, sections: dict[str, bytes], levels: int | None = None) -> bytes:
        ids = np.ascontiguousarray(ids, dtype="<u4")
        levels = levels or max(1, int(ids.max(initial=0)).bit_length())
        pack = zstandard.ZstdCompressor(level=1)
        parts: list[bytes] = []
        at, ones, zeros, pos = [], [], [], 0
        # Two bytes an id while they suffice.
        now = ids.astype("<u2") if levels <= 16 else ids
        kind = now.dtype.type
        for level in range(levels - 1, -1, -1):
            bit = ((now >> kind(level)) & kind(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little").tobytes()
            step = BLOCK_BITS // 8
            offsets, before = [], []
            sums = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK_BITS), dtype="i8") if len(bit) else np.zeros(0, int)
            before = [0, *np.cumsum(sums).tolist()]
            for k in range(0, len(packed), step):
                offsets.append(pos)
                parts.append(pack.compress(packed[k : k + step]))
                pos += len(parts[-1])
            at.append([*offsets, pos])
            ones.append(before)
            zeros.append(len(bit) - before[-1])
            # Not by a mask: unforeseeable bits make that several times slower.
            now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        places = {}
        for name, raw in sections.items():
            parts.append(pack.compress(raw))
            places[name] = [pos, pos + len(parts[-1])]
            pos += len(parts[-1])
        head = zlib.compress(json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "at": at, "ones": ones, "sections": places}).encode(), 6)
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)

    def section(self, name: str) -> bytes:
        a, b = self._sections[name]
        return self._unpack(self._data[self._base + a : self._base + b])

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._kept:
            a, b = self._at[level][k : k + 2]
            raw = np.frombuffer(self._unpack(self._data[self._base + a : self._base + b]), "u1")
            self._kept[level, k] = np.unpackbits(raw, bitorder="little")
        return self._kept[level, k]

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, r = divmod(i, BLOCK_BITS)
        return self._ones[level][k] + (int(self._block(level, k)[:r].sum()) if r else 0)

    def select(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) such bit of a plane."""
        ones = self._ones[level]
        lo, hi = 0, len(ones) - 1
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            if (ones[mid] if bit else mid * BLOCK_BITS - ones[mid]) <= nth:
                lo = mid
            else:
                hi = mid
        before = ones[lo] if bit else lo * BLOCK_BITS - ones[lo]
        return lo * BLOCK_BITS + int(np.flatnonzero(self._block(level, lo) == bit)[nth - before])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.levels):
            k, r = divmod(i, BLOCK_BITS)
            bit = int(self._block(level, k)[r])
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        a, b = 0, self.n
        for level in range(self.levels):
            bit = token >> (self.levels - 1 - level) & 1
            x, y = self.rank1(level, a), self.rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
        return a, b

    def count(self, token: int) -> int:
        a, b = self._range(token)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of an id."""
        a, b = self._range(token)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids: the splits are undone from the last plane to the first."""
        now = np.zeros(self.n, "<u2" if self.levels <= 16 else "<u4")
        for level in range(self.levels - 1, -1, -1):
            blocks = [self._unpack(self._data[self._base + a : self._base + b]) for a, b in zip(self._at[level], self._at[level][1:], strict=False)]
            mask = np.unpackbits(np.frombuffer(b"".join(blocks), "u1"), count=self.n, bitorder="little").astype(bool)
            was = np.empty_like(now)
            was[np.flatnonzero(~mask)] = now[: self.zeros[level]]
            was[np.flatnonzero(mask)] = now[self.zeros[level] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = was
        return now.astype("<u4")


class WordEncoder:
    """Ids of whole texts from a tokenizer that never joins what white space parts.

    Text is cut where the tokenizer cuts it in any case, and each part is encoded once while
    it is remembered: about ``kept`` bytes of parts, in two generations, of which the older goes
    when the younger is half of them. A file with other rules than ``RULES`` has its texts
    encoded whole. A text of Latin letters, digits and ASCII signs
    without an apostrophe is lower-cased, as the tokenizer does after nothing that changes
    it, and cut into its pre-tokens: runs of letters, single digits and runs of signs. A block's
    pre-tokens are cut, told apart and put together again by Arrow, so that Python sees each
    of them once. Other texts are cut at blanks. New pre-tokens go to the library's model, spelt by
    bytes as its pre-tokenizer does; all else goes through the whole library.
    """

    SAFE_TEXT = staticmethod(re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~ \t\r\n]*").fullmatch)
    SAFE = staticmethod(re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+").fullmatch)
    PARTS = staticmethod(re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+").findall)
    #: What stands alone between blanks once these have blanks around them is a pre-token.
    ALONE = r"([!-&(-/:-@\[-`{-~]+|[0-9])"
    MARK = "</w>"
    #: The byte-level spelling of the letters À to ÿ: bytes 0xA1 to 0xFF but 0xAD stand for themselves, those below for 289 on.
    SPELT = {c: "".join(chr(b) if b > 0xA0 and b != 0xAD else chr(323 if b == 0xAD else b + 162) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
    # How the file cuts texts, which the patterns above follow.
    RULES = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
        "truncation": None,
        "padding": None,
    }
    # Strings that are ids of their own; a file with more of them is not cut here.
    ADDED = ("<|startoftext|>", "<|endoftext|>")
    #: Bytes that a remembered part takes beside its characters and ids.
    EACH = 200

    def __init__(self, path: str, kept: int = 160_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as src:
            told = json.load(src)
        self._tok = Tokenizer.from_file(path)
        added = [t["content"] for t in told.get("added_tokens") or []]
        plain = not any(t.get(k) for t in told.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self._known = all(told.get(k) == v for k, v in self.RULES.items()) and told["model"].get("end_of_word_suffix") == self.MARK and plain and set(added) <= set(self.ADDED)
        self._kept, self._size = kept, 0
        self._memo: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        if not self._known:
            return
        self._model = self._tok.model.tokenize
        self._four = [struct.pack("<I", i) for i in range(max(self._tok.get_vocab().values()) + 1)]

    def _learn_parts(self, new: list[str]) -> None:
        """Of lower-case pre-tokens of plain Latin text."""
        memo, model, four, spelt = self._memo, self._model, self._four, self.SPELT
        for p in new:
            memo[p] = b"".join([four[t.id] for t in model(p if p.isascii() else p.translate(spelt))])

    def _learn(self, new: list[str]) -> None:
        memo, plain, several, other = self._memo, {}, [], []
        for c in new:
            if c.isascii() and c.isalpha():
                plain[c] = None
                continue
            if not self.SAFE(c) or "<|" in c:
                other.append(c)
                continue
            parts = self.PARTS(c)
            if len(parts) > 1:
                several.append((c, parts))
            plain.update((p, None) for p in parts if p not in memo)
        model, four = self._model, self._four
        for p in plain:
            low = p.lower()
            memo[p] = b"".join([four[t.id] for t in model(low if low.isascii() else low.translate(self.SPELT))])
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            for c, e in zip(part, self._tok.encode_batch(part, add_special_tokens=False), strict=True):
                memo[c] = np.array(e.ids, "<u4").tobytes()
        for c, parts in several:
            memo[c] = b"".join([memo[p] for p in parts])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self._known:
            return [np.array(e.ids, "<u4").tobytes() for e in self._tok.encode_batch(texts, add_special_tokens=False)]
        safe = [bool(self.SAFE_TEXT(t)) and "<|" not in t for t in texts]
        # Large types: one text may be of any length.
        plain = pa.array([t.lower() for t, s in zip(texts, safe, strict=True) if s], pa.large_string())
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, self.ALONE, r" \1 "))
        own = self._joined(words.flatten().dictionary_encode(), words.offsets.to_numpy())
        return [next(own) if s else self._cut(t) for t, s in zip(texts, safe, strict=True)]

    def _joined(self, words: pa.DictionaryArray, at: np.ndarray) -> Iterator[bytes]:
        """Ids of texts whose words begin at places ``at``."""
        some = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        memo = self._all(some, self._learn_parts)
        ids = pa.array(list(map(memo.__getitem__, some)), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        data, ends = memoryview(data or b""), np.frombuffer(offsets, "<i8")[at].tolist()
        return (bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False))

    def _cut(self, text: str) -> bytes:
        words = BLANKS.split(text)
        memo = self._all(words, self._learn)
        return b"".join(map(memo.__getitem__, words))

    def _all(self, words: list[str], learn: Callable[[list[str]], None]) -> dict[str, bytes]:
        """The memory, which holds all these words now."""
        if self._size > self._kept // 2:
            self._old, self._memo, self._size = self._memo, {"": b""}, 0
        memo, old = self._memo, self._old
        new = set(words).difference(memo)
        if new:
            before = len(memo)
            # A set's intersection would go through all of a dict.
            again = {w: old[w] for w in new if w in old}
            memo.update(again)
            learn([w for w in new if w not in again] if again else list(new))
            # A character takes up to 4 bytes.
            self._size += (len(memo) - before) * self.EACH + 4 * sum(map(len, new)) + sum(map(len, map(memo.__getitem__, new)))
        return memo


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and stage, so that its memory outlives a task."""
    return held(("encoder", path), lambda: WordEncoder(path))


def _few(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        yield from blocks([batch], chars)


def _write(folder: str, tokenizer: str, end_id: int, shard_ids: int):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, own, shard = encoder(tokenizer), TaskContext.get().partitionId(), attempt(), 0
        end = np.array([end_id], "<u4").tobytes()
        docs: list = []
        texts: list[bytes] = []
        size = 0

        def flush():
            nonlocal docs, texts, size, shard
            path = f"{folder}/ids-{own}-{shard:06d}.flwm"
            lengths = np.array([len(t) // 4 for t in texts], "<u4")
            known = np.array([i is not None for i in docs], "u1")
            ids = np.array([0 if i is None else i for i in docs], "<i8")
            put_file(path, WaveletMatrix.build(np.frombuffer(b"".join(texts), "<u4"), {"doc_id": ids.tobytes(), "known": known.tobytes(), "length": lengths.tobytes()}))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "n_docs": len(docs), "n_ids": size}], schema)
            docs, texts, size, shard = [], [], 0, shard + 1
            return row

        for some, whole in _few(batches):
            for i, ids in zip(some, encode(whole), strict=True):
                ids += end
                if docs and size + len(ids) // 4 > shard_ids:
                    yield flush()
                docs.append(i)
                texts.append(ids)
                size += len(ids) // 4
        if docs:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            matrix = WaveletMatrix(get_file(path))
            raw = memoryview(matrix.ids().tobytes())
            n = np.frombuffer(matrix.section("length"), "<u4").astype("<i8")
            stop = np.cumsum(n)
            crc = [crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), n.tolist(), strict=True)]
            known = np.frombuffer(matrix.section("known"), "u1")
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(matrix.section("doc_id"), "<i8"), pa.int64(), mask=known == 0), pa.array(base + stop - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=schema)


def write_token_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, shard_ids: int = 2_000_000) -> DataFrame:
    """Writes the shard files and returns their list (part, shard, path, n_docs, n_ids).

    Documents go out in ascending id order: parts are ranges of (id, hash of the text), so
    repeated ids don't gather in one. ``shard_ids`` bounds the ids of a file.
    """
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(max(1, 2 * shuffle_partitions(docs.sparkSession)), "id", "tie").sortWithinPartitions("id", "tie")
    files = ordered.select("id", "text").mapInArrow(frugal(_write(folder, tokenizer, end_id, shard_ids)), "part int, shard int, path string, n_docs long, n_ids long")
    return stored(files, "token-shards")


def read_token_shards(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the listed files.

    A part's first position is a running sum over parts (one row for each task that wrote);
    inside a part it runs over the part's files.
    """
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("first"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    placed = files.withColumn("inside", inside).join(parts, "part").select("path", (F.col("first") + F.col("inside")).alias("base"))
    return placed.repartition(max(1, 2 * shuffle_partitions(files.sparkSession)), "path").mapInArrow(frugal(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` as wavelet-matrix shards and returns what the files hold."""
    folder = folder or scratch(docs.sparkSession, "ids")
    return read_token_shards(write_token_shards(docs, folder, **options))


def op5_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_output(table(spark, sf_dir, "documents"))
