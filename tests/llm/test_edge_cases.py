"""Every operator on odd rows and on an empty table."""

import pytest
from pyspark.sql import functions as F

from weftlink.llm import fingerprints, language_id, mixing, near_dups, packing, quality_classifier, quality_rules, secrets, substring_dedup, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (6, 1, None), (8, None, 1), (None, 1, 1), (9, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")


def _tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


OPERATORS = {
    "substring_dedup": lambda d, x: substring_dedup.deduplicated(d),
    "fingerprints": lambda d, x: fingerprints.contract(d, 8),
    "quality_classifier": quality_classifier.contract,
    "near_dups": lambda d, x: near_dups.contract(d),
    "toxicity": toxicity.contract,
    "secrets": lambda d, x: secrets.contract(d),
    "mixing": lambda d, x: mixing.contract(d),
    "language_id": lambda d, x: language_id.contract(d),
    "quality_rules": quality_rules.contract,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, odd, labels):
    out = OPERATORS[name](odd, labels).cache()
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in out.select("doc_id").collect())
    assert ids == sorted((r["doc_id"] is None, r["doc_id"]) for r in odd.select("doc_id").collect())
    again = OPERATORS[name](odd, labels)
    assert out.exceptAll(again).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, odd, labels):
    assert OPERATORS[name](odd.limit(0), labels).count() == 0
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_packing(odd):
    out = packing.contract(odd, _tokenizer()).toPandas()
    assert packing.contract(odd.limit(0), _tokenizer()).count() == 0
    per = odd.count()
    assert (out["start"] == 0).sum() == per and out.groupby("sequence_id")["length"].sum().max() <= 4096


def test_filters_keep_columns(odd, labels):
    for out in (toxicity.accepted(odd, labels), near_dups.deduplicated(odd), secrets.redact(odd), mixing.mixed(odd), substring_dedup.deduplicated(odd)):
        assert out.columns == odd.columns
        assert out.where(F.col("found") != "x").count() == 0 and out.count() > 0
    for out in (toxicity.accepted(odd.limit(0), labels), near_dups.deduplicated(odd.limit(0)), secrets.redact(odd.limit(0)), mixing.mixed(odd.limit(0)), substring_dedup.deduplicated(odd.limit(0))):
        assert out.count() == 0


def test_row_numbers_hold_on_any_input(spark, make, tmp_path):
    """Rows are numbered once: inputs that are no bare scan give what the same rows give from Parquet."""
    import random

    from .test_exactness import prose

    rng = random.Random(77)
    passage = ". ".join(prose(rng, 15) for _ in range(4)) + "."
    rows = [(i, prose(rng, 40) + ". " + (passage + " " if i % 6 == 0 else "") + prose(rng, 30) + ".", "en", rng.choice("abc")) for i in range(240)]
    make(rows).write.parquet(f"{tmp_path}/docs")
    plain = spark.read.parquet(f"{tmp_path}/docs")
    shuffled = {"distinct": plain.union(plain).dropDuplicates(["doc_id"]), "repartition": plain.repartition(7), "limit": plain.orderBy(F.rand()).limit(1000)}
    for name, docs in {"plain": plain, **shuffled}.items():
        now = [
            sorted((r["doc_id"], r["text"]) for r in substring_dedup.deduplicated(docs).collect()),
            sorted((r["doc_id"], r["text"]) for r in mixing.mixed(docs).collect()),
            sorted((r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint(docs, 4).collect()),
        ]
        if name == "plain":
            want = now
            assert sum(passage in t for _, t in want[0]) == 1
        assert now == want, name
