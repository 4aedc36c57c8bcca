"""The registered queries on the smallest tables, and the pipeline against its parts done by brute force."""

import zlib

import numpy as np
import pytest

from factloom.llm.queries import oracle_sql, queries
from tests.compare import duck, plain


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in oracle_sql():
        want = duck(sf_dir).sql(oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_op4_and_op9_contracts(spark, sf_dir):
    groups = queries()["op4_ngram_join"](spark, sf_dir).toPandas()
    assert (groups.component_id <= groups.doc_id).all()
    scores = queries()["op9_toxicity"](spark, sf_dir).toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(scores.doc_id, scores.held_out, strict=True))
    assert ((scores.score >= 0.5).astype(int) == scores.predicted).all()


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from factloom.llm import decontaminate, toxicity
    from factloom.llm.common import stored, tokenizer_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stored(stage(spark, steps[-1], sf_dir), "test-pipeline"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [s.toPandas() for s in steps]
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.Scorer(net)
    assert set(rows[1].doc_id) == {d for d, t in zip(rows[0].doc_id, rows[0].text, strict=True) if score([t])[0] < 0.5}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: shingles(t) for d, t in zip(rows[1].doc_id, rows[1].text, strict=True)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids[: ids.index(a)]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    assert set(rows[2].doc_id) == {d for d in ids if find(d) == d}
    items = [" ".join(decontaminate.split(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = lambda t: not any(decontaminate.edit_distance(i, " ".join(decontaminate.split(t))) <= 0.2 * len(i) for i in items)
    assert set(rows[3].doc_id) == {d for d, t in zip(rows[2].doc_id, rows[2].text, strict=True) if clean(t)}
    assert set(rows[4].doc_id) == set(rows[3].doc_id)
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((d, zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in zip(rows[4].doc_id, rows[4].text, strict=True))
    assert sorted(zip(rows[5].doc_id, rows[5].ids_crc32, strict=True)) == want
    assert p.run(spark, sf_dir).count() == len(rows[5])
