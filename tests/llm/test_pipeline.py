"""The pipeline's stages, one after another, against brute force on a small table."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from weftlink.llm import packing, toxicity

from .test_exactness import WORD, _brute, _spans, prose


@pytest.fixture(scope="module")
def table(spark, make, tmp_path_factory):
    rng = random.Random(21)
    rows = []
    for i in range(160):
        text = prose(rng, rng.randint(30, 150))
        if i % 5 == 0:
            text += " vile fool"
        if i % 7 == 0:
            text += f" password=hunter{i:04d} and AKIA{'Z9' * 9}"
        rows.append((i, text, "en", rng.choice("abc")))
    rows += [(200 + i, rows[i][1] + (" new" if i % 2 else ""), "en", "a") for i in range(1, 40, 3)] + [(300, None, None, None), (301, "", "en", "b")]
    d = str(tmp_path_factory.mktemp("sf"))
    make(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, {r[0]: r for r in rows}


def test_stages(spark, table, tmp_path):
    d, rows = table
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns, name
        kept.append(out.toPandas())
        docs = out
    clean, unique, masked, mixed, packed = kept
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    ids = sorted(rows)
    scores = dict(zip(ids, model.scores([rows[i][1] or "" for i in ids])))
    assert set(clean["doc_id"]) == {i for i in ids if scores[i] < 0.5}
    toxic = set(range(0, 160, 5))
    assert len(toxic & set(clean["doc_id"])) <= 3 and len(set(range(160)) - toxic - set(clean["doc_id"])) <= 3
    groups = _brute([(i, rows[i][1]) for i in clean["doc_id"]], 5)
    assert set(unique["doc_id"]) == {i for i, (_, least) in groups.items() if least == i}
    for r in masked.itertuples():
        text = rows[r.doc_id][1]
        for a, _, b in reversed(_spans(text or "")):
            text = text[:a] + "[SECRET]" + text[b:]
        assert (r.text is None and text is None) or r.text == text
    texts = {r.doc_id: r.text or "" for r in masked.itertuples()}
    for i, g in mixed.groupby("doc_id"):
        assert len(g) <= 3 and all(set(WORD.findall(t)) <= set(WORD.findall(texts[i])) for t in g["text"])
    total = sum(len(WORD.findall(t)) for t in texts.values())
    assert abs(sum(len(WORD.findall(t)) for t in mixed["text"]) - total) < 0.05 * total
    encode = packing.encoder(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(encode(t) + np.array([1], "<u4").tobytes()) for t in mixed["text"])
    assert sorted(packed["ids_crc32"]) == want and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_run_is_the_stages(spark, table):
    d, _ = table
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
