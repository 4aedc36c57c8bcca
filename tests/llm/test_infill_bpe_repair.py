"""Fill-in-middle, BPE by an index of pairs, and repair of conversations, against brute force and the library."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, infill, repair
from factloom.llm.common import tokenizer_path

ODD = [(1, "a b c d e"), (2, None), (3, ""), (4, "  "), (5, "word " * 20_000), (6, "Élan vital, naïve 12 ſ 日本語 ΣΑΣ İ\n\n\ty"), (6, "Élan vital, naïve 12 ſ 日本語 ΣΑΣ İ\n\n\ty"), (None, "no id here"), (7, "it's <|endoftext|> o'clock"), (8, "x <P> y"), (9, "x" * 5000), (10, "😀[`{@Zz"), (11, "<"), (12, "S> a <P"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("output", F.lit("y")).withColumn("ids", F.lit("z"))


# 11


def _fim(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(tokens), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_runs_find_every_cut(monkeypatch):
    rng = random.Random(3)
    for piece in (3, 1_000_000):
        monkeypatch.setattr(infill, "PIECE", piece)
        for _ in range(400):
            texts = ["".join(rng.choice("abZ .\n1é日😀[`{@") for _ in range(rng.choice([0, 1, 2, 5, 20]))) for _ in range(rng.randint(1, 6))]
            runs = infill.Runs.of(texts)
            before = runs.before_texts()
            for k, t in enumerate(texts):
                tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
                assert len(tokens) == before[k + 1] - before[k]
                for u in range(len(tokens) + 1):
                    assert runs.places(np.array([before[k] + u]))[0] - runs.texts[k] == len("".join(tokens[:u]))


def test_fill_in_middle(spark, odd):
    rng = random.Random(11)
    rows = ODD + [(100 + k, "".join(rng.choice("ab c.<>PSM\n日") for _ in range(rng.randint(0, 30)))) for k in range(500)]
    for seed, rate, spm in ((1, 90, 20), (7, 100, 100), (3, 0, 50)):
        got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), seed=seed, rate=rate, spm_rate=spm)
        got = got.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
        want = [_fim(i, t, seed, rate, spm) for i, t in rows]
        assert sorted(map(repr, [tuple(r)[:6] for r in got])) == sorted(map(repr, want))
        assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert infill.fill_in_middle(odd).count() == len(ODD)
    assert infill.fill_in_middle(odd.where("doc_id > 1000")).count() == 0


# 12


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("many", [3, 1_000_000])
def test_bpe_equals_the_library(monkeypatch, name, many):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MANY", many)
    own, tok = bpe.Bpe(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC   \t\n'.,!0123éÉß日本ΣςAİ́ 　<|>ſ😀-_"
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "aaaaaaaaaaaaa bananabananana", "abababababab " * 30, "I'D 'sx ''s !'s we'll"]
    for t, ids, e in zip(texts, own.encode(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert own.decode(ids) == tok.decode(e.ids, skip_special_tokens=False)


def test_bpe_slices_and_forgets(monkeypatch):
    own = bpe.Bpe(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdeé'0日") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    want = own.encode([text, "x"])
    monkeypatch.setattr(bpe, "BLOCK", 500)
    small = bpe.Bpe(tokenizer_path("word_bpe_49k.json"), kept=2_000)
    assert small.encode([text, "x"]) == want == small.encode([text, "x"])


def test_merges_that_make_lower_ranks_possible():
    # What rank 2 makes is merged by rank 0, which a word's own order takes before the rest of rank 2.
    pairs, results = [(5, 1), (1, 1), (1, 2)], [6, 7, 5]

    def slow(word):
        word = list(word)
        while True:
            found = [(pairs.index(p), k) for k, p in enumerate(zip(word, word[1:], strict=False)) if p in pairs]
            if not found:
                return word
            r, k = min(found)
            word[k : k + 2] = [results[r]]

    index = bpe.PairIndex(pairs, results)
    rng = random.Random(9)
    words = [[rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 12))] for _ in range(500)]
    out = index.merge(np.array([s for w in words for s in [*w, -1]], "i4"))
    out = out[out != -2].tolist()
    assert out == [s for w in words for s in [*slow(w), -1]]


def test_unknown_rules_are_refused(tmp_path):
    import json

    with open(tokenizer_path("word_bpe_49k.json")) as src:
        told = json.load(src)
    for change in ({"decoder": {"type": "Fuse"}}, {"model": told["model"] | {"dropout": 0.1}}):
        (tmp_path / "t.json").write_text(json.dumps(told | change))
        with pytest.raises(ValueError):
            bpe.Bpe(str(tmp_path / "t.json"))


def test_bpe_with_another_added_token(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path("word_bpe_49k.json")) as src:
        told = json.load(src)
    told["added_tokens"].append(told["added_tokens"][0] | {"id": 49408, "content": "[MASK]"})
    (tmp_path / "t.json").write_text(json.dumps(told))
    own, tok = bpe.Bpe(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    from factloom.llm.wavelet import WordEncoder

    encoder = WordEncoder(str(tmp_path / "t.json"))
    for t in ("a [MASK] b", "[mask][MASK]x", "a[MASK", "plain"):
        assert encoder([t]) == own.encode([t])
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_op12_frames(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = bpe.bpe_decode(bpe.bpe_encode(odd.repartition(3))).collect()
    want = []
    for i, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == sorted(want)
    assert bpe.bpe_encode(odd.where("doc_id > 1000")).count() == 0


# 13


def _cheapest(rows):
    """Cost and audit by the automaton of the pattern, from the end; rows of (initial, fault)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def step(cost, letter, rest):
            found.append((cost + rest[0], letter + rest[1]))

        for c, to in after[state].items():
            if inserts < 3 and c != "s":
                step(5, "I", best(i, to, inserts + 1))
        if i < len(rows):
            initial, fault = rows[i]
            step(2, "D", best(i + 1, state, 0))
            if fault in (repair.SOUND, repair.TRUNCATED):
                for c, to in after[state].items():
                    if c == initial or c != "s":
                        step((c != initial) + 5 * (fault == repair.TRUNCATED), "K" if c == initial else "R", best(i + 1, to, 0))
        return min(found, default=(10**9, ""))

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in after:
            best(i, state, 0)
    return best(0, 0, 0)


def _by_hand(turns):
    """A conversation's result from (turn, role, text) rows in order."""
    seen, rows = set(), []
    for _, role, text in turns:
        body = text.rstrip(repair.SPACES)
        fault = repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if body[-1] not in ".!?" else repair.SOUND
        seen.add((role, text))
        rows.append((role[:1], fault))
    cost, audit = _cheapest(tuple(rows))
    out, left, state = [], list(turns), ""
    for e in audit:
        due = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((due, ""))
        else:
            _, role, text = left.pop(0)
            if e == "D":
                continue
            out.append((role if e == "K" else due, text))
        state = out[-1][0][0]
    known = [t for t, _, _ in turns if t is not None]
    faults = [f for _, f in rows]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)), illegal, cost, audit, digest)


def test_segments_join_to_the_cheapest_repair():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randint(1, 9)
        rows = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(3, n - 1)))) if n > 1 else []
        segments = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            s = repair._Segment(1, 1, a, a, begins=a == 0 and rng.random() < 0.5)
            for k in range(a, b):
                s.add(1, k, rows[k][0], rows[k][1], repair.DUPLICATE, 1)
            segments.append(s.row())
        got = list(repair._decide(segments))[-1]
        assert (got["cost"], got["audit"]) == _cheapest(tuple(rows))


def _compare(frame, rows):
    fixed = repair.Repair(frame)
    digests = {r.conv_id: r.repaired_sha256 for r in fixed.digests().collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, empty)) for r in fixed.conversations().collect()}
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest())
    want = {}
    for c in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c]
        want[c] = _by_hand(sorted(own, key=order))
    assert got == want


def test_repair_against_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for c in [None, *range(150)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, *range(8)]), rng.choice([None, "", "system", "user", "assistant", "user", "assistant", "tool"]), rng.choice([None, "", " \t", "Yes.", "no", "Why?", "ok \n", "é!", "x. y"])))
    rows += [(999, 3, "user", "Same.")] * 40 + [(998, None, "user", "")] * 5
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("pos", F.lit(1))
    _compare(frame.repartition(3), rows)


def test_one_conversation_in_many_segments(spark):
    rng = random.Random(14)
    rows = [(1, k // 2, rng.choice(["user", "assistant"]), rng.choice(["A.", "B?", f"t{k}.", f"u{k}", ""])) for k in range(300)] + [(2, k, "user", "x.") for k in range(20)]
    _compare(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "There!"), (1, 2, "user", "cut"), (2, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.Repair(frame).turns().orderBy("conv_id", "place", "sub").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in out] == [(1, "R", "user", "Hi."), (1, "K", "assistant", "There!")]
    none = repair.Repair(frame.where("conv_id > 7"))
    assert none.conversations().count() == none.turns().count() == none.digests().count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (None, *range(12)) for r, x in ((None, None), ("assistant", "A. b! c?"))]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
