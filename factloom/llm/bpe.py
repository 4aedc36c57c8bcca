"""BPE by an index of pairs: every place of a pair is known, and ranks are applied in turn.

A block's texts are cut into pre-tokens, and each distinct one that isn't remembered stands
once in one array of symbols, with links to the symbols before and after it. An index maps a
pair (by its rank) to all its places. The lowest rank that has places is applied to all of
them; each merge ends the pairs beside it and puts the pairs that it makes into the lists of
their ranks. A place whose symbols have changed since is skipped when its rank comes. Many
places are merged as arrays, few one by one. As words don't touch, the lowest rank of all is
the lowest of each word that holds it, so every word is merged as if it were alone.

Defined results: null text is empty and has no ids; repeated rows are done each for itself; an
empty table gives an empty result; columns other than the named ones are not read. Strings of
added tokens in a text become their ids, as the library does it. Files whose rules aren't
known here are refused, not guessed.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, frugal, held, table, tokenizer_path

#: Characters of a block; a longer text is cut at blanks into slices of about as many.
BLOCK = 4_000_000
#: Places of a rank from which they are merged as arrays.
MANY = 40
BLANK = re.compile(r"[ \t\r\n]")
BLANKS = re.compile(r"[ \t\r\n]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class PairIndex:
    """The merges of a file, and their application to many words at once."""

    def __init__(self, pairs: list[tuple[int, int]], results: list[int]):
        self._base = 1 + max([max(p) for p in pairs] + results, default=0)
        self._ranks = {a * self._base + b: r for r, (a, b) in enumerate(pairs)}
        self._pairs, self._results = pairs, results
        keys = np.fromiter(self._ranks, "i8", len(self._ranks))
        order = np.argsort(keys)
        self._keys, self._of_key = keys[order], np.fromiter(self._ranks.values(), "i8", len(keys))[order]
        first: dict[int, int] = {}
        for r, pair in enumerate(pairs):
            for s in pair:
                first.setdefault(s, r)
        # Whether what a merge makes is only ever merged later.
        self._rising = all(first.get(s, r + 1) > r for r, s in enumerate(results))

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = left.astype("i8") * self._base + right
        key[(left < 0) | (right < 0)] = -1
        if not len(self._keys):
            return np.full(len(key), -1, "i8")
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._of_key[at], -1)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Applies all merges to words that are parted by -1; the last symbol is -1."""
        n = len(symbols)
        sym = array("i", symbols.astype("i4").tobytes())
        nxt = array("i", np.arange(1, n + 1, dtype="i4").tobytes())
        prv = array("i", np.arange(-1, n - 1, dtype="i4").tobytes())
        vs, vn, vp = (np.frombuffer(x, "i4") for x in (sym, nxt, prv))
        vn[-1:] = n - 1
        ranks = self._rank_of(vs[:-1], vs[1:])
        places: dict[int, list] = {}
        heap = self._list(places, np.flatnonzero(ranks >= 0), ranks[ranks >= 0])
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            own = places.pop(r)
            (a, b), c = self._pairs[r], self._results[r]
            size = sum(len(x) if isinstance(x, np.ndarray) else 1 for x in own)
            if size < MANY or a == b or not self._rising:
                at = sorted({p for x in own for p in (x.tolist() if isinstance(x, np.ndarray) else (x,))})
                self._one_by_one(sym, nxt, prv, r, at, places, heap)
                continue
            p = np.unique(np.concatenate([np.atleast_1d(x) for x in own]))
            p = p[vs[p] == a]
            p = p[vs[vn[p]] == b]
            q = vn[p]
            after, before = vn[q], vp[p]
            vs[p], vs[q] = c, -2
            vn[p], vp[after] = after, p
            # The symbol before the first one is the last, which is no symbol.
            at = np.concatenate([before, p])
            new = self._rank_of(vs[at], vs[vn[at]])
            for x in self._list(places, at[new >= 0], new[new >= 0]):
                heapq.heappush(heap, x)
        return np.array(vs)

    @staticmethod
    def _list(places: dict[int, list], at: np.ndarray, ranks: np.ndarray) -> list[int]:
        """Adds places to the lists of their ranks; returns the ranks that had none."""
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        new = []
        for part, r in zip(np.split(at, edges), ranks[np.concatenate([[0], edges])].tolist() if len(at) else [], strict=False):
            if r in places:
                places[r].append(part)
            else:
                places[r] = [part]
                new.append(r)
        return new

    def _one_by_one(self, sym: array, nxt: array, prv: array, r: int, at: list[int], places: dict[int, list], heap: list[int]) -> None:
        (a, b), c, base, ranks = self._pairs[r], self._results[r], self._base, self._ranks
        for k, p in enumerate(at):
            if sym[p] != a:
                continue
            q = nxt[p]
            if sym[q] != b:
                continue
            after, before = nxt[q], prv[p]
            sym[p], sym[q] = c, -2
            nxt[p], prv[after] = after, p
            lower = False
            for place, x, y in ((before, sym[before], c), (p, c, sym[after])):
                new = ranks.get(x * base + y) if x >= 0 and y >= 0 else None
                if new is None:
                    continue
                if new in places:
                    places[new].append(place)
                else:
                    places[new] = [place]
                    heapq.heappush(heap, new)
                lower |= new < r
            if lower and k + 1 < len(at):  # what was made goes first; the rest of this rank waits
                if r in places:
                    places[r] += at[k + 1 :]
                else:
                    places[r] = at[k + 1 :]
                    heapq.heappush(heap, r)
                return


class Bpe:
    """Ids of whole texts, and texts of ids, by a tokenizer file of the BPE kind.

    The file's own normalizer and pre-tokenizer cut what isn't plainly Latin text. Words that
    were seen are remembered, about ``kept`` bytes of them in two generations, of which the
    older goes when the younger is half of them.
    """

    # Rules under which blanks part a text in any case and the patterns below hold.
    RULES = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }
    # Letters of Latin-1, digits and ASCII signs. None of them is changed but by lower case.
    PLAIN = staticmethod(re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-/:-@\[-`{-~ \t\r\n]*").fullmatch)
    PARTS = staticmethod(re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall)
    #: Bytes that a remembered word takes beside its own and those of its ids.
    EACH = 200

    def __init__(self, path: str, kept: int = 160_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as src:
            told = json.load(src)
        model = told["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        tokens = told.get("added_tokens") or []
        odd += [t["content"] for t in tokens if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
        decoder = (told.get("decoder") or {}).get("type")
        if model.get("type") != "BPE" or odd or decoder not in (None, "ByteLevel"):
            raise ValueError(f"not a tokenizer whose rules are known here: {model.get('type')}, {odd}, {decoder}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        lacking = [c for c in letters if c not in vocab or c + suffix not in vocab]
        if lacking:
            raise ValueError(f"no symbol for {len(lacking)} bytes")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._index = PairIndex([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self._codes = {c: b for b, c in enumerate(letters)}
        self._inner = np.array([vocab[c] for c in letters], "i4")
        self._last = np.array([vocab[c + suffix] for c in letters], "i4")
        self._tok = Tokenizer.from_file(path)
        self._added = {t["content"]: t["id"] for t in tokens}
        by_length = sorted(self._added, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        known = all(told.get(k) == v for k, v in self.RULES.items())
        self._by_blanks = known and not any(BLANK.search(t) or not t for t in self._added)
        names = {i: w for w, i in vocab.items()} | {i: w for w, i in self._added.items()}
        self._names = names
        self._bytes = {i: self._raw(w) for i, w in names.items()} if decoder == "ByteLevel" else None
        self._kept, self._size = kept, 0
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _raw(self, name: str) -> bytes:
        code = self._codes
        return bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()

    def _pieces(self, text: str) -> list[bytes | int]:
        """Pre-tokens, and ids of added tokens, by the file's own rules."""
        out: list[bytes | int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self._added:
                out.append(self._added[part])
            elif part:
                part = self._tok.normalizer.normalize_str(part) if self._tok.normalizer else part
                cut = self._tok.pre_tokenizer.pre_tokenize_str(part) if self._tok.pre_tokenizer else [(part, None)]
                out += [bytes([self._codes[c] for c in w]) for w, _ in cut if w]
        return out

    def _plain(self, text: str) -> bool:
        return self.PLAIN(text) is not None and not (self._special and self._special.search(text))

    def _words(self, text: str) -> list[str]:
        """What is remembered each for itself: pre-tokens of plain text, else, with a blank before it, what blanks part."""
        if not self._by_blanks:
            return [" " + text] if text else []
        if self._plain(text):
            return self.PARTS(text.lower())
        out = []
        for chunk in BLANKS.split(text):
            if self._plain(chunk):
                out += self.PARTS(chunk.lower())
            else:
                out.append(" " + chunk)
        return out

    def _learn(self, new: set[str]) -> None:
        odd = [w for w in new if w[0] == " "]
        words = list(new.difference(odd))
        self._memo.update(zip(words, self._encode([w.encode() for w in words]), strict=True))
        cut = [self._pieces(w[1:]) for w in odd]
        distinct = [p for p in dict.fromkeys(chain.from_iterable(cut)) if not isinstance(p, int)]
        ids = dict(zip(distinct, self._encode(distinct), strict=True))
        for w, parts in zip(odd, cut, strict=True):
            self._memo[w] = b"".join([ids[p] if not isinstance(p, int) else np.array([p], "<u4").tobytes() for p in parts])

    def _encode(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of each pre-token, so many together that their symbols stay about a block's."""
        k = 0
        while k < len(pieces):
            n, size = k, 0
            while n < len(pieces) and size < BLOCK:
                size += len(pieces[n])
                n += 1
            # No UTF-8 holds the byte 255.
            raw = np.frombuffer(b"\xff".join([*pieces[k:n], b""]), "u1")
            symbols, ends = self._inner[raw], np.flatnonzero(raw == 255)
            symbols[ends - 1] = self._last[raw[ends - 1]]
            symbols[ends] = -1
            merged = self._index.merge(symbols)
            merged = merged[merged != -2]
            stops = 4 * np.flatnonzero(merged == -1)
            ids = merged.astype("<u4").tobytes()
            yield from [ids[a:b] for a, b in zip([0, *(stops + 4).tolist()], stops.tolist(), strict=False)]
            k = n

    def _slices(self, text: str) -> list[str]:
        """A long text cut at blanks, where that changes nothing."""
        out, at = [], 0
        while self._by_blanks and len(text) - at > BLOCK:
            cut = BLANK.search(text, at + BLOCK)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if max(map(len, texts), default=0) <= BLOCK:
            return self._ids(texts)
        return [b"".join([self._ids([s])[0] for s in self._slices(t)]) for t in texts]

    def _ids(self, texts: list[str]) -> list[bytes]:
        if self._size > self._kept // 2:
            self._old, self._memo, self._size = self._memo, {}, 0
        memo, old = self._memo, self._old
        split = [self._words(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(memo)
        if new:
            again = new.intersection(old)
            memo.update((w, old[w]) for w in again)
            new -= again
            self._learn(new)
            for some in (new, again):  # a character takes up to 4 bytes
                self._size += len(some) * self.EACH + 4 * sum(map(len, some)) + sum(map(len, map(memo.__getitem__, some)))
        return [b"".join(map(memo.__getitem__, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids: names joined by blanks, or the bytes of a byte-level file."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self._bytes is not None:
            return b"".join([self._bytes.get(i, b"") for i in numbers]).decode(errors="replace")
        names = self._names
        try:
            return " ".join([names[i] for i in numbers])
        except KeyError:
            return " ".join([names[i] for i in numbers if i in names])


def bpe(path: str) -> Bpe:
    return held(("bpe", path), lambda: Bpe(path))


def _encoded(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for docs, texts in blocks(batches, BLOCK):
            ids = own.encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return run


def _decoded(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for batch in batches:
            texts = pa.array([own.decode(i or b"") for i in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return run


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are unsigned, 32 bits each, the lowest byte first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(_encoded(tokenizer or tokenizer_path("word_bpe_49k.json"))), "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) with ``decoded``; null ids are none."""
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(frugal(_decoded(tokenizer or tokenizer_path("word_bpe_49k.json"), 2)), "doc_id long, n_tokens long, ids binary, decoded string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
