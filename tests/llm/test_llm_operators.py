"""The operators against brute force and round trips, with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, mixing, ngram_join, ogg, preference, resampling, token_counts, toxicity, warc, wavelet
from factloom.llm.common import scratch, tokenizer_path

ODD = [(1, "a b c d e"), (2, None), (3, ""), (4, "  "), (5, "word " * 20_000), (6, "Élan vital, naïve 12 ſ 日本語 <s> ▁ x\n\n\ty"), (6, "Élan vital, naïve 12 ſ 日本語 <s> ▁ x\n\n\ty"), (None, "no id here"), (7, "it's <|endoftext|> o'clock"), (8, "a  b   c    d"), (9, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    # A column with a name that operators use inside.
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("id", F.lit("x"))


def _empty(odd):
    return odd.where("doc_id > 1000")


# 1


def test_preferences(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    kind = "array<struct<role:string,text:string>>"
    rows = [
        (1, t(("user", "q"), ("assistant", "yes")), t(("user", "q"), ("assistant", "no"), ("user", "why"))),
        (2, t(("user", "q")), t(("user", "q"))),
        (3, t(("user", "a")), None),
        (4, t(("user", ""), ("assistant", "")), t(("user", ""), ("tool", ""))),
    ]
    got = {r.pair_id: r for r in preference.format_preferences(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    assert got[1].n_common_turns == 1 and got[1].prompt == "<|user|>\nq<|end|>\n"
    for side in ("chosen", "rejected"):
        text, mask = got[1][side], got[1][f"{side}_mask"]
        assert [text[s.start : s.stop] for s in mask] == [("yes" if side == "chosen" else "no") + "<|end|>\n"]
    assert (got[2].n_common_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].n_common_turns == 0 and got[3].rejected == "" and got[3].chosen
    assert got[4].n_common_turns == 1
    turns = spark.createDataFrame([(None, 0, "user", "x"), (1, 1, None, "b"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    convs = preference.conversations(turns).collect()
    assert [(c.conv_id, [(x.role, x.text) for x in c.turns]) for c in convs] == [(1, [("user", ""), ("", "b")])]
    assert preference.format_preferences(preference.swapped_answers(preference.conversations(turns))).count() == 0


# 2


def test_token_counts_equal_the_library(spark, odd):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for block in (20, 16_000_000):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd.repartition(3), block_chars=block, held_sums=10).collect())
        assert got == sorted((i or 0, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in ODD)
    assert token_counts.token_counts(_empty(odd)).count() == 0
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("ab  \n\t.▁é日\0<s>　") for _ in range(rng.randint(0, 25)))
        assert sum(token_counts.piece_counts(pieces, token_counts.pre_tokens(t))) == len(pieces.encode(t))


# 3


def test_resampling_prefers_target_text(spark):
    good, bad = "the cat sat on the mat and purred softly", "zzz qqq || buy now !!! zzz click here"
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice((good if k % 2 else bad).split()) for _ in range(30))) for k in range(200)]
    frame = spark.createDataFrame([*docs, (None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = resampling.importance_resample(frame, labels, keep=0.4, buckets=500).collect()
    assert len(out) == round(0.4 * 202)
    assert sum(bool(r.doc_id and r.doc_id < 200 and r.doc_id % 2) for r in out) >= 0.95 * len(out)
    assert resampling.importance_resample(frame, labels.where("quality = 7"), keep=1.0).count() == 202
    assert resampling.importance_resample(frame.where("doc_id < 0"), labels).count() == 0


def test_kth_largest_with_ties(spark):
    values = [1.0] * 50 + [2.5, 2.5, -3.0, 1e9, 1e-9] + [float(k) / 7 for k in range(300)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 3, 50, 100, len(values)):
        assert resampling.kth_largest(keys, k, bins=8) == sorted(values, reverse=True)[k - 1]


def test_resampling_does_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} same") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(100)], "doc_id long, quality int")
    runs = [sorted(r.doc_id for r in resampling.importance_resample(frame.repartition(n), labels).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 30


# 4


def _brute_groups(rows, n, least, of):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and of * len(x & y) >= least * len(x | y):
                parent[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[find(k)].append(i)
    smallest = {r: min((i for i in v if i is not None), default=None) for r, v in low.items()}
    return sorted((i is None, i or 0, len(s), smallest[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "least"), [(4, 85), (5, 80), (2, 50)])
def test_groups_equal_brute_force(spark, odd, n, least):
    rng = random.Random(n)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(4)]
    rows = list(ODD)
    for k in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 50)}"
        rows.append((100 + k, " ".join(words) if k % 9 else " ".join(words[: rng.randint(1, 4)])))
    rows += [(300, "Same Text here now ok"), (299, "same text\tHERE now ok"), (301, "a b c"), (302, "a b c"), (303, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_groups(frame.repartition(5), n, least, 100).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == _brute_groups(rows, n, least, 100)


def test_groups_of_empty_tables_and_one_of_each(spark, odd):
    assert ngram_join.ngram_groups(_empty(odd)).count() == 0
    kept = ngram_join.one_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == sorted({i or 0 for i, _ in ODD})


def test_lanes_bound_every_overlap(spark):
    rng = random.Random(3)
    sets = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.choice((0, 1, 40, 500, 12_000)))] for _ in range(12)]
    sets += [s[: len(s) // 2] + s[: len(s) // 3] for s in sets]
    rows = [(bytes([k]), s[: len(s) // 4], None, s[len(s) // 4 :]) for k, s in enumerate(sets)]
    got = ngram_join.lanes(spark.createDataFrame(rows, "cls binary, f0 array<long>, f1 array<long>, f2 array<long>"))
    a = got.select(F.col("cls").alias("a"), *[F.col(c).alias(f"a{c}") for c in ngram_join.LANE_COLUMNS])
    pairs = a.crossJoin(got).select("a", "cls", ngram_join.lane_bound([F.col(f"a{c}") for c in ngram_join.LANE_COLUMNS], [F.col(c) for c in ngram_join.LANE_COLUMNS]).alias("bound"))
    counts = [np.bincount((np.array(s, "i8").view("u8") % ngram_join.LANES).astype("i8"), minlength=ngram_join.LANES) for s in sets]
    for r in pairs.collect():
        x, y = counts[r.a[0]], counts[r.cls[0]]
        most = np.minimum(x, y).sum()
        assert r.bound >= most and (r.bound == most or max(x.max(), y.max()) > ngram_join.LANE_BITS)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)] + [(bytes([200]), bytes([100]))], "a binary, b binary")
    got = {bytes(r.node)[0]: bytes(r.root)[0] for r in ngram_join.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100}
    assert ngram_join.components(edges.limit(0)).count() == 0


def test_components_take_no_step_that_changes_nothing(spark, monkeypatch):
    steps, stored = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: steps.append(name) or stored(df, name))
    rng = random.Random(7)
    # Stars, which are found at once, and the same with their middle as the largest node: one step.
    for middle, most in ((0, 1), (99, 2)):
        steps.clear()
        edges = [(bytes([k]), bytes([100 * j + middle])) for j in (0, 1) for k in range(100 * j + 1, 100 * j + 99)]
        got = {bytes(r.node)[0]: bytes(r.root)[0] for r in ngram_join.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
        least = [0, 100] if middle == 0 else [1, 101]
        assert got == {k: least[k >= 100] for e in edges for k in (e[0][0], e[1][0])}
        assert len(steps) <= most
    for n in (30, 60, 120):
        edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(n)]
        root = {k: k for e in edges if e[0] != e[1] for k in e}
        for _ in range(100):
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        got = [(bytes(r.node)[0], bytes(r.root)[0]) for r in ngram_join.components(spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")).collect()]
        assert sorted(got) == sorted(root.items())


# 5


def test_token_shards_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter((i, len(e) + 1, zlib.crc32(np.array([*e, 1], "<u4").tobytes())) for i, e in ((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in ODD))
    got = wavelet.token_id_output(odd.repartition(4), shard_ids=50).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert wavelet.token_id_output(_empty(odd)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1000, 140_000])
def test_wavelet_matrix_answers(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 50_000).astype("<u4")
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids, {"s": b"kept"}))
    assert (m.ids() == ids).all() and m.section("s") == b"kept"
    for i in rng.integers(0, n, 20) if n else []:
        assert m.access(int(i)) == ids[i]
    for token in {1, 2, 49_999, 70_000, *(ids[:5].tolist())}:
        places = np.flatnonzero(ids == token)
        assert m.count(token) == len(places)
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert m.locate(token, k) == places[k]
        with pytest.raises(IndexError):
            m.locate(token, len(places))
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"something else")


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok, enc, rng = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), wavelet.WordEncoder(tokenizer_path("word_bpe_49k.json"), kept=50), random.Random(4)
    for alphabet in ("abcéÀß.,12-<|>*[^_`]~ \n", "aAbİΣσ éé 　\x1c\n's'll12٣,.!日本́  "):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert enc([t])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


# 6


def _slow_checksum(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


def test_ogg_round_trip_and_damage():
    rng = random.Random(5)
    for n in (0, 1, 255, 1000):
        data = rng.randbytes(n)
        assert ogg.page_checksum(data) == _slow_checksum(data)
    for n, size in ((64, 4032), (4032, 4032), (64 * 300, 255), (64 * 300, 510), (64 * 4000, 70_000), (64 * 9000, 200_000)):
        payload = rng.randbytes(n)
        media = ogg.multiplex(payload, packet_bytes=size)
        streams = ogg.demultiplex(media)
        assert ogg.samples(streams) == payload
        for s in streams.values():
            assert round(s.seconds * ogg.RATE) == sum(map(len, s.packets[1:]))
    for damaged in (media[:100] + bytes([media[100] ^ 1]) + media[101:], media[:-5], b"OggX" + media[4:]):
        with pytest.raises(ogg.OggError):
            ogg.demultiplex(damaged)


def test_media_columns(spark, odd):
    rows = ogg.media_columns(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        raw = next((t or "") for i, t in ODD if i == r.doc_id).encode()
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 0}) == 1
    assert ogg.media_columns(_empty(odd)).count() == 0


# 7


def test_edit_distance_against_table():
    def slow(a, b):
        prev = list(range(len(a) + 1))
        best = prev[-1]
        for c in b:
            cur = [0]
            for i, x in enumerate(a):
                cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
            prev, best = cur, min(best, cur[-1])
        return best

    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (15, 30))
        assert decontaminate.edit_distance(a, b) == slow(a, b)


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(1, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "...")]
    docs, planted = [], set()
    for k in range(300):
        words = text(rng.randint(0, 300))
        if k % 2:
            i = rng.randrange(40)
            own = items[i][1].split()
            if len(own) >= 12:
                for _ in range(len(own) // 15):
                    own[rng.randrange(len(own))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = own
            planted.add((k, i))
        docs.append((k, " ".join(words)))
    docs += [(None, None), (500, ""), (1, docs[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    long = {(d, i) for d, i in planted if len(items[i][1].split()) >= 3}
    assert len(got & long) >= 0.97 * len(long)
    assert all(len(items[i][1]) * 0.2 >= decontaminate.edit_distance(" ".join(decontaminate.split(items[i][1])), " ".join(decontaminate.split(dict(docs[:300])[d]))) for d, i in got)
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(frame, bench.where("item_id > 90")).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0
    chunks = list(decontaminate.item_chunks(bench, 500))
    assert len(chunks) > 3 and sum(map(len, chunks)) == 41


def _edited(rng, text, kind, part):
    if kind == "characters":
        changed = set(rng.sample(range(len(text)), int(part * len(text))))
        return "".join(rng.choice(("", "z", c + "z")) if k in changed else c for k, c in enumerate(text))
    words = []
    for w in text.split():
        if rng.random() < part:
            k = rng.randrange(len(w))
            w = "" if kind == "deleted" else w[:k] + "z" + w[k + 1 :]
        words.append(w)
    return " ".join(w for w in words if w)


def test_decontamination_finds_what_is_within_the_limit(spark):
    """Edits spread over many words; exact distance decides what has to be found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 59)))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for kind, part, least in (("letters", 0.3, 1.0), ("letters", 0.5, 1.0), ("deleted", 0.12, 0.98), ("characters", 0.08, 1.0), ("characters", 0.19, 0.96)):
        texts, want = [], []
        for _ in range(100):
            i, t = rng.choice(items)
            copy = _edited(rng, t, kind, part)
            if decontaminate.edit_distance(t, copy) <= 0.2 * len(t):
                texts.append(" ".join(word() for _ in range(20)) + " " + copy + rng.choice(("", " " + word())))
                want.append((i, decontaminate.edit_distance(t, texts[-1])))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect()}
        assert len(want) > 30 and sum((d, *w) in got for d, w in enumerate(want)) >= least * len(want)


def test_decontamination_decides_every_candidate_by_the_exact_distance(monkeypatch):
    """Side by side or alone, a candidate passes where its piece is within the limit, and nothing is lost between."""
    rng = random.Random(12)
    items = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 900)))) for k in range(60)]
    passed = []
    for few in (0, 1 << 30):
        monkeypatch.setattr(decontaminate, "FEW", few)
        rng.seed(13)
        index = decontaminate.Index(items)
        text = " ".join(decontaminate.split(" ".join(_edited(rng, t, "characters", rng.choice((0.02, 0.1, 0.2))) + "".join(rng.choice("abcd ") for _ in range(200)) for _, t in items)))
        passed.append(set(index._stretches(text)))
        pieces, diagonals = index._candidates(decontaminate.signs(text))
        want = set()
        for p, d in zip(pieces.tolist(), diagonals.tolist(), strict=True):
            limit, own = int(index.limit[p]), index.parts[p][2]
            a, b = d - limit, d + decontaminate.NEAR + len(own) + limit
            if decontaminate.edit_distance(own, text[max(0, a) : max(0, b)]) <= limit:
                want.add((p, a, b))
        assert want <= passed[-1] and len(want) > 200
    assert passed[0] == passed[1]


@pytest.mark.parametrize("long", [False, True])
def test_decontamination_recall_up_to_the_limit(long):
    """Uniform edits of characters and of words up to the limit, for items of 15 to 59 words and short ones."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("etaoinsrhldcum") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 59) if long else rng.randint(3, 14)))) for k in range(60)]
    index = decontaminate.Index(items)
    for kind, part in (("characters", 0.05), ("characters", 0.1), ("characters", 0.15), ("characters", 0.2), ("letters", 0.5), ("letters", 0.9), ("deleted", 0.15)):
        texts, want = [], []
        for _ in range(150):
            i, t = rng.choice(items)
            copy = " ".join(decontaminate.split(_edited(rng, t, kind, part)))
            if decontaminate.edit_distance(t, copy) <= 0.2 * len(t):
                texts.append(" ".join(word() for _ in range(15)) + " " + copy + " " + word())
                want.append(i)
        found = index.search(texts)
        assert len(want) > 20 and sum(i in {x[0] for x in f} for i, f in zip(want, found, strict=True)) >= 0.9 * len(want), (kind, part)


def test_decontamination_of_odd_items(spark):
    """Items of 20,000 words, many equal ones, and texts without blanks."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    huge = [word() for _ in range(20_000)]
    same = " ".join(word() for _ in range(30))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    items = [(1, " ".join(huge)), *((k, same) for k in range(10, 1010)), (2000, han)]
    edited = list(huge)
    for k in range(0, len(edited), 11):
        edited[k] = word()
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (1, noise(50) + " " + " ".join(edited) + " " + noise(50)),
        (2, " ".join(huge[5000:5200])),
        (3, noise(40) + " " + same.upper() + "! " + noise(5)),
        (4, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200)) + han[:60] + "一丁" + han[61:] + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(100))),
        (5, noise(3000)),
        (6, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    got = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    by_doc = {d: sorted(r.item_id for r in got if r.doc_id == d) for d, _ in docs}
    assert by_doc == {1: [1], 2: [], 3: list(range(10, 1010)), 4: [2000], 5: [], 6: []}
    assert {(r.distance, r.at_word) for r in got if r.doc_id == 3} == {(0, 40)} and {r.at_word for r in got if r.doc_id == 1} == {50}



# 8


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200_000
    pages = [(3, "http://a", "p" * 150), (1, "http://b\r\nX: y", "p" * 150), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "n", "p" * 150), (6, "v", big), (7, "w", big), (1, "again", "p" * 150), (8, "z", "é" * 60), (None, "n", "q" * 120), (None, "n", "q" * 120)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    got = warc.read_archives(warc.write_archives(frame, scratch(spark, "w"), file_bytes=500)).collect()
    assert len(got) == len(pages)
    want = collections.Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        same = [j for j, _, g in pages if g == h and j is not None]
        first = min(same) if same and len(raw) >= 100 else i
        revisit = len(raw) >= 100 and bool(same) and first != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.read_archives(warc.write_archives(frame.limit(0), scratch(spark, "w"))).count() == 0


def test_warc_reader_refuses_damage():
    whole = warc.record_bytes(1, "u", b"payload " * 50, None)
    assert [r.http()[1] for r in warc.read_records(io.BytesIO(whole * 3))] == [b"payload " * 50] * 3
    raw = zlib.decompress(whole, 31)
    for bad in (raw.replace(b"payload payload", b"paYload payload", 1), raw[:-3], raw.replace(b"Content-Length: 4", b"Content-Length: 5")):
        pack = zlib.compressobj(5, zlib.DEFLATED, 31)
        with pytest.raises((warc.WarcError, ValueError)):
            list(warc.read_records(io.BytesIO(pack.compress(bad) + pack.flush())))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(whole[:-20])))


# 9


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "do", "mi", "ru", "te", "na"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(5, 120))]
        if k % 4 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(["scumbag", "grolk" + word()]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    rows += [(9001, None), (9002, "..."), (None, "grolkba"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("l_id", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    net = toxicity.fit(docs, marks)
    out = toxicity.with_scores(docs, net).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    empty = {r.doc_id: r.score for r in out if r.doc_id in (9001, 9002)}
    assert empty[9001] == empty[9002] == net.base
    assert toxicity.with_scores(docs.limit(0), net).count() == 0
    none = toxicity.fit(docs, marks.where("toxic = 7"))
    assert {r.score for r in toxicity.with_scores(docs, none).collect()} == {0.0}


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Network.new(1)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x = rng.normal(size=(7, toxicity.WORD_DIM + toxicity.GRAM_DIM))
    rows, mask = rng.integers(0, 7, (3, 5)), np.array([[1, 1, 1, 0, 0], [1, 1, 1, 1, 1], [1, 0, 0, 0, 0]], bool)
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(net.projections(x), rows, mask)
        return np.mean(np.log1p(np.exp(-z)) * target + np.log1p(np.exp(z)) * (1 - target))

    out, saved = net.logits(net.projections(x), rows, mask, keep=True)
    g = net.gradients(rows, mask, target, out, saved, x)
    for name in ("Wf", "Ub", "bf", "A", "v", "o", "c", "x"):
        p = x if name == "x" else net.p[name]
        at = tuple(int(rng.integers(0, n)) for n in p.shape)
        keep = p[at]
        p[at] = keep + 1e-3
        up = loss()
        p[at] = keep - 1e-3
        down = loss()
        p[at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        doc, first = toxicity.windows(np.array([n]))
        assert (doc == 0).all() and first[0] == 0 and first[-1] + toxicity.WINDOW >= n
        assert (np.diff(first) == toxicity.STEP).all()


# 10


def test_mix_meets_its_targets(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 5}", "w " * (1 + k % 7)) for k in range(900)] + [(9000, None, "a b"), (9001, "void", None), (9002, "void", ""), (5, "hot", "w " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("budget", F.lit(0))
    units = mixing.units_of(docs)
    w = {r.source: r for r in mixing.mixture_weights(units, 0.9, None).collect()}
    p = np.array([r.weight for r in w.values() if r.tokens])
    assert abs(p.sum() - 1) < 1e-6 and -(p * np.log(p)).sum() >= 0.9 * np.log(len(p)) - 1e-4
    places = mixing.mix(docs, 0.9, None, block_tokens=300).collect()
    got = collections.Counter()
    for r in places:
        got[r.source] += r.n_tokens * r.n_rows
    for s, r in w.items():
        if r.tokens:
            assert r.budget <= got[s] < r.budget + 20
    # Each pass holds each document once, and blocks follow the budget.
    assert max(collections.Counter((r.doc_id, r.source, r.text_md5, r.epoch) for r in places).values()) == 1
    assert sum(r.source == "void" for r in places) == 2
    limited = mixing.mixture_weights(units, None, 3.0).collect()
    assert max(r.budget / r.tokens for r in limited if r.tokens) <= 3.01


def test_mixed_documents_cover_all(spark, odd):
    docs = odd.withColumn("source", F.when(F.col("doc_id") < 5, "a").otherwise(F.col("text").substr(1, 1)))
    out = mixing.mixed_documents(docs, target_entropy=None, repetition_limit=2.0, cover=True)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert set(got) == {(i, t) for i, t in ODD} and all(got[i, t] >= ODD.count((i, t)) for i, t in ODD)
    assert mixing.mixed_documents(docs.limit(0), cover=True).count() == 0


def test_names_that_operators_use_inside_may_be_columns(spark, odd):
    docs = odd.withColumns({n: F.lit(1) for n in ("k_id", "k_hash", "k_n", "K_ID_", "_mix_id", "_mix_source", "_mix_md5", "cls", "node", "h")}).withColumn("source", F.lit("s"))
    assert ngram_join.one_of_each_group(docs).columns == docs.columns and mixing.mixed_documents(docs, cover=True).columns == docs.columns
    assert ngram_join.one_of_each_group(docs).count() == len({i for i, _ in ODD})


# the pipeline's stages


def test_stages_take_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline

    words = [f"w{k}" for k in range(40)]
    more = [(20, " ".join(words)), (21, " ".join(words)), (21, " ".join(words)), (22, " ".join([*words[:-1], "other"])), (None, None), (23, "x " * 60_000)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") != 4, "s").alias("source"), F.length("text").alias("n_chars"), F.lit(1).alias("k_id"), F.lit(2).alias("_mix_id"), F.lit("a").alias("_toxicity"))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0, name
        got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "token_ids":
            assert sum(got.values()) == docs.count()
        else:
            assert out.columns == docs.columns, name
        if name == "near_copies":
            assert set(got) == ids - {21, 22} and max(got.values()) <= 2
        elif name != "toxicity":
            assert set(got) == ids, name


# what the registered queries rest on, by hand


def test_resampling_keys_by_hand(spark):
    rng = random.Random(31)
    rows = [(k, " ".join(rng.choice(("ab", "cd", "ef", "gh", "X!")) for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(None, "ab ab"), (7, None), (90, "ab " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(60)], "doc_id long, quality boolean").withColumn("quality", F.col("quality").cast("int"))
    buckets, seed = 97, 13
    words = {w: resampling.Words()[w] for _, t in rows for w in resampling._SPLIT.findall((t or "").lower())}

    def grams(t):
        h = [words[w] for w in resampling._SPLIT.findall((t or "").lower())]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93) % (1 << 64) for a, b in zip(h, h[1:])]
        return [(x >> 11) % buckets for x in h + pairs]

    raw, good = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i < 60 and i % 3 == 0:
            good.update(grams(t))
    p = lambda c: {b: (c[b] + 1) / (sum(c.values()) + buckets) for b in range(buckets)}
    p_raw, p_good = p(raw), p(good)
    weight = lambda t: sum(np.log(p_good[g]) - np.log(p_raw[g]) for g in grams(t))
    noise = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))).alias("x")).collect()
    keys = sorted(((weight(r.text) - np.log(-np.log(((r.x % (1 << 64)) >> 11) / 2**53 + 0.5 / 2**53)), r.doc_id) for r in noise), key=lambda k: -k[0])
    out = resampling.importance_resample(docs, labels, buckets=buckets, seed=seed).collect()
    k = round(len(rows) / 3)
    assert len(out) == k
    got = sorted(((r.gumbel_key, r.doc_id) for r in out), key=lambda k: -k[0])
    assert [i for _, i in got] == [i for _, i in keys[:k]] and np.allclose([x for x, _ in got], [x for x, _ in keys[:k]])
    mean = {r.doc_id: r.log_weight for r in resampling.importance_resample(docs, labels, keep=1.0, buckets=buckets, length=50.0).collect()}
    assert np.isclose(mean[90], 50 * weight(rows[-1][1]) / len(grams(rows[-1][1])))
    none = spark.createDataFrame([(None, "same text")] * 40, "doc_id long, text string")
    assert resampling.importance_resample(none, labels, keep=0.5).count() == 20


def test_toxicity_scores_by_hand():
    """Scores of batches equal those of one window of one text at a time, worked out step by step."""
    rng = random.Random(32)
    word = lambda: "".join(rng.choice(["ba", "do", "mi", "ru"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 3, 31, 32, 33, 48, 49, 100)] + ["", "..."]
    net = toxicity.train([*texts, "ba grolk ru"] * 4, [0, 1] * 22, 0.25, rounds=1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, size = net.p, toxicity.HIDDEN

    def embedded(w):
        g, _ = toxicity.grams([w])
        return np.concatenate([p["word"][zlib.crc32(w.encode()) & (toxicity.WORD_BUCKETS - 1)], p["gram"][g].sum(0) / np.sqrt(len(g))])

    def run(way, xs):
        h, out = np.zeros(size), []
        for x in xs:
            q, g = x @ p[f"W{way}"] + p[f"b{way}"], h @ p[f"U{way}"]
            z, r = sigmoid(q[:size] + g[:size]), sigmoid(q[size : 2 * size] + g[size : 2 * size])
            n = np.tanh(q[2 * size :] + r * g[2 * size :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    def window(words):
        xs = [embedded(w) for w in words]
        states = np.concatenate([run("f", xs), run("b", xs[::-1])[::-1]], 1)
        e = np.exp(np.tanh(states @ p["A"] + p["a"]) @ p["v"])
        return float((e / e.sum()) @ states @ p["o"] + p["c"][0])

    def score(text):
        words = toxicity.split(text)
        if not words:
            return net.base
        first = [0, *range(toxicity.STEP, len(words) - toxicity.WINDOW + toxicity.STEP, toxicity.STEP)]
        return sigmoid(max(window(words[k : k + toxicity.WINDOW]) for k in first))

    scorer = toxicity.Scorer(net, kept=20)
    want = [score(t) for t in texts]
    assert np.allclose(scorer(texts), want, atol=1e-4) and np.allclose([scorer([t])[0] for t in texts], want, atol=1e-4)


def test_toxicity_training_is_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(50)] + [(1, "short"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    texts, toxic, share = toxicity.labelled_sample(docs, labels, per_label=10, chars=1600)
    assert sum(map(len, texts)) <= 3200 and 4 <= len(texts) <= 20 and len(texts) == len(toxic) and 0.3 < share < 0.7
    assert all(len(t) in (0, 500) for t in texts)


def test_warc_attempts_and_hot_payloads(spark):
    """Many equal payloads go past the join, and a second attempt's files are its own."""
    pages = [(k, f"u{k}", ("hot " * 40) if k % 3 else ("cold %d " % (k % 50)) * 20) for k in range(900)] + [(None, None, None)] * 3 + [(2000 + k, "s", "small") for k in range(300)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = scratch(spark, "w")
    first = warc.write_archives(frame.repartition(5), folder, file_bytes=20_000)
    again = warc.write_archives(frame.orderBy(F.rand(3)).repartition(3), folder, file_bytes=30_000)
    for files in (first, again):
        rows = warc.read_archives(files).collect()
        assert collections.Counter(r.page_id for r in rows) == collections.Counter(i for i, _, _ in pages)
        refers = {r.page_id: r.refers_to for r in rows}
        assert refers[1] is None and refers[4] == 1 and refers[899] == 1 and refers[2299] is None
        assert sum(r.record_type == "revisit" for r in rows) == 599 + 300 - 50
    assert not {r.path for r in first.collect()} & {r.path for r in again.collect()}


def test_encoder_of_another_file_and_small_memory(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    told = json.load(open(path, encoding="utf-8"))
    told["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told), encoding="utf-8")
    for file, kept in ((str(other), 10**8), (path, 5_000)):
        tok, enc, rng = Tokenizer.from_file(file), wavelet.WordEncoder(file, kept=kept), random.Random(8)
        for _ in range(60):
            t = [" ".join(rng.choice(("Some", "words", "IT'S", "né", "a-b", "12")) + str(rng.randint(0, 30)) for _ in range(20)) for _ in range(3)]
            assert enc(t) == [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t]


def test_workers_drop_what_another_operator_kept():
    """A task function travels by value, yet reaches what the worker's module holds."""
    from pyspark import cloudpickle

    from factloom.llm import common

    task = lambda of: cloudpickle.loads(cloudpickle.dumps(common.frugal(of)))
    read, other = task(wavelet._read), task(resampling._counts(5))
    list(read([]))
    assert common.held(("x",), lambda: 5) == 5
    list(read([]))
    assert common.held(("x",), lambda: 6) == 5
    list(other([]))
    assert common.held(("x",), lambda: 6) == 6
