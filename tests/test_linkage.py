import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink import queries
from weftlink.functions import draws
from weftlink.functions.text import normalized
from weftlink.operators import audit, blocking, evaluate, features, ground_truth, pairs, profile, rules, splits, stats, validate
from weftlink.schema import FEATURES, SHARD_COLUMNS

SCHEMA = "entity_id string, business_name string, country string, business_address string"


def recs(spark, rows):
    return normalized(spark.createDataFrame([(*r, None) if len(r) == 3 else r for r in rows], SCHEMA))


@pytest.fixture(scope="module")
def harbour(spark):
    """Three harbours' firms: one name in two spellings and sources, a namesake abroad, a shared word, a lone firm."""
    return recs(spark, [
        ("S1-10", "Nordlys Ferries Limited", "Norway"), ("S2-11", "NORDLYS  FERRIES Ltd.", "Norway"), ("S3-12", "Nordlys Ferries Ltd", "Chile"),
        ("S2-13", "Kelp & Ferries", "Norway"), ("S3-14", "Østfold Rør", "Norway"), ("S1-15", None, "Norway"),
    ]).cache()


def test_candidate_pairs(harbour):
    of = lambda **options: {tuple(r) for r in blocking.candidate_pairs(harbour, **options).collect()}
    assert of() == {("S1-10", "S2-11")}
    assert of(use_country=False) == {("S1-10", "S2-11"), ("S1-10", "S3-12"), ("S2-11", "S3-12")}
    assert of(use_exact_name=False, use_tokens=True) == {("S1-10", "S2-11"), ("S1-10", "S2-13"), ("S2-11", "S2-13")}
    assert of(use_exact_name=False) == set()


def test_prefix_and_token_keys(spark):
    df = recs(spark, [("1", "Saltwater Mills", "PE"), ("2", "Salt", "PE"), ("3", "y", "PE"), ("4", "Saltwind and Sons of the Mills", "PE")])
    keys = lambda strategy, **options: {(r["entity_id"], r["block_key"]) for r in blocking.block_index(df, strategy, **options).collect()}
    assert keys("prefix") == {("1", "saltw"), ("2", "salt"), ("4", "saltw")}
    assert keys("prefix", prefix_len=4) == {("1", "salt"), ("2", "salt"), ("4", "salt")}
    assert keys("tokens") == {("1", "saltwater"), ("1", "mills"), ("2", "salt"), ("4", "saltwind"), ("4", "sons"), ("4", "mills")}
    index = blocking.block_index(df, "tokens", min_token_len=5)
    assert {tuple(r) for r in blocking.candidates_of(df, index, "tokens", min_token_len=5).collect()} == {("1", "4"), ("4", "1")}
    assert keys("tokens", stopwords=("mills",)) >= {("4", "and"), ("4", "the")} and ("1", "mills") not in keys("tokens", stopwords=("mills",))


def test_pairs_in_blocks(spark):
    index = spark.createDataFrame([(k, m, "US") for k, ms in {"b1": "ABC", "b2": "DE", "solo": "X", "dup": "AAB"}.items() for m in ms], "block_key string, entity_id string, country_norm string")
    got = {r["block_key"]: r["count"] for r in blocking.pairs_in_blocks(index).groupBy("block_key").count().collect()}
    assert got == {"b1": 3, "b2": 1, "dup": 1}


def test_tiers(spark):
    s1 = recs(spark, [("S1-1", "Pomelo Press", "PT"), ("S1-2", "Quartz", None)])
    s2 = recs(spark, [("S2-1", "pomelo press", "PT"), ("S2-2", "Pomelo Print", "PT"), ("S2-3", "Old Press", "PT"), ("S2-4", "Pomelo Press", "AO"), ("S2-5", "Quartz", None), ("S2-6", "Basalt", "PT")])
    of = lambda **options: {(r["s1_id"], r["secondary_id"], r["tier"]) for r in blocking.tier_pairs(s1, s2, **options).collect()}
    assert of() == {("S1-1", "S2-1", 1), ("S1-1", "S2-2", 2), ("S1-1", "S2-3", 2)}
    assert of(tiers=(1,)) == {("S1-1", "S2-1", 1)} and of(tiers=(2,)) == {("S1-1", f"S2-{i}", 2) for i in (1, 2, 3)}


def test_volume_and_reduction(spark, harbour):
    got = {r["country_norm"]: r["n_pairs"] for r in blocking.country_volume(harbour, harbour).collect()}
    assert got == {"NORWAY": 25, "CHILE": 1}
    row = spark.range(1).select(blocking.reduction_ratio(F.lit(10), F.lit(9)).alias("a"), blocking.reduction_ratio(F.lit(1), F.lit(0)).alias("b"), blocking.reduction_ratio(F.lit(3), F.lit(99)).alias("c")).first()
    assert tuple(row) == (0.8, 1.0, 0.0)


def test_hard_negatives(spark):
    """A match is never drawn; same name before shared word before same country, and nothing from abroad."""
    s1 = recs(spark, [("S1-7", "Lumen Kiln Co.", "DK", "Havnegade 4")])
    s2 = recs(spark, [("S2-a", "Basalt Boats", "DK"), ("S2-b", "Lumen Glass", "DK"), ("S2-c", "LUMEN KILN COMPANY", "DK"), ("S2-d", "Lumen Kiln Co", "DK"), ("S2-e", "Lumen Kiln Co", "SE")])
    edges, _ = ground_truth.from_dict(spark, {"S1-7": ["S2-d"]})
    yes = pairs.positives(s1, s2, edges, "S2")
    assert [tuple(r) for r in yes.collect()] == [("S1-7", "S2-d")]
    for seed in (None, 11):
        for ratio, want in ((1.0, {"S2-c": 1}), (2.0, {"S2-c": 1, "S2-b": 2}), (9.0, {"S2-c": 1, "S2-b": 2, "S2-a": 3})):
            assert {r["secondary_id"]: r["tier"] for r in pairs.negatives(s1, s2, yes, edges, ratio, seed).collect()} == want


def test_seeded_negatives_against_brute_force(spark):
    """Tiers, preferred addresses and keyed draws of many records, by the definition."""
    import hashlib
    import random

    rng = random.Random(3)
    words = ["amber", "birch", "cedar", "delta", "ember", "flint"]
    make = lambda p, n: [(f"{p}-{i}", " ".join(rng.choices(words, k=2)), rng.choice(["DK", "SE"]), rng.choice([None, "1 Elm Rd", "2 Oak Rd"])) for i in range(n)]
    one, two = make("S1", 12), make("S2", 60)
    edges, _ = ground_truth.from_dict(spark, {r[0]: [x[0] for x in two if x[1] == r[1] and x[2] == r[2]][:2] for r in one})
    s1, s2 = recs(spark, one), recs(spark, two)
    yes = pairs.positives(s1, s2, edges, "S2")
    got = {(r["s1_id"], r["secondary_id"], r["tier"]) for r in pairs.negatives(s1, s2, yes, edges, 3.0, 42).collect()}
    true = {(r["s1_id"], r["secondary_id"]) for r in edges.collect()}
    draw = lambda a, b: hashlib.md5(f"42:{a}:{b}".encode()).hexdigest()
    for a, name, country, address in one:
        n = sum(x == a for x, _ in true)
        ranked = []
        for b, other, there, at in two:
            if there == country and (a, b) not in true:
                tier = 1 if other == name else 2 if other[:5] == name[:5] or set(other.split()) & set(name.split()) else 3
                ranked.append((tier, (not (address and at and address != at)) if tier == 2 else 0, draw(a, b), b))
        want = sorted(ranked)[: max(1, 3 * n)]
        mine = {(b, t) for x, b, t in got if x == a}
        assert {(b, t) for b, t in mine if t < 3} == {(b, t) for t, _, _, b in want if t < 3}
        assert len(mine) == len(want) and all((3, 0, draw(a, b), b) in ranked for b, t in mine if t == 3)


def test_preferred_addresses(spark):
    s1 = recs(spark, [("S1-1", "Heron Lamps", "NZ", "8 Quay Rd")])
    s2 = recs(spark, [(f"S2-{i}", f"Heron Works {i}", "NZ", a) for i, a in enumerate(["8 Quay Rd", None, "30 Fern Ave", "8 quay road"])])
    none = ground_truth.from_pairs(spark, [("S1-x", "S2-x")])
    got = pairs.negatives(s1, s2, pairs.positives(s1, s2, none, "S2"), none, 1.0, 3)
    assert [r["secondary_id"] for r in got.collect()] == ["S2-2"]


@pytest.mark.parametrize("ratio", [1, 2, 3])
def test_ratios_and_scalable_top_up(spark, ratio):
    names = ["Delta Corp", "Delta Corp", "Delta Services", "Omega", "Sigma", "Kappa", "Lambda"]
    s2 = recs(spark, [(f"S2-{i}", n, "US") for i, n in enumerate(names)])
    s1 = recs(spark, [("S1-A", "Delta Corp", "US"), ("S1-B", "Nothing Alike", "US"), ("S1-C", "Solo", None)])
    edges, _ = ground_truth.from_dict(spark, {"S1-A": ["S2-0"], "S1-B": [], "S1-C": []})
    yes = pairs.positives(s1, s2, edges, "S2")
    got = pairs.negatives(s1, s2, yes, edges, float(ratio), None).collect()
    want = pairs.negatives_exact(s1, s2, yes, edges, float(ratio)).collect()
    count = lambda rows: {(s, t): sum(1 for r in rows if (r["s1_id"], r["tier"]) == (s, t)) for s, t in {(r["s1_id"], r["tier"]) for r in rows}}
    assert count(got) == count(want)
    assert {(r["s1_id"], r["secondary_id"]) for r in got if r["tier"] < 3} == {(r["s1_id"], r["secondary_id"]) for r in want if r["tier"] < 3}
    assert len({(r["s1_id"], r["secondary_id"]) for r in got}) == len(got) and ("S1-A", "S2-0") not in {(r["s1_id"], r["secondary_id"]) for r in got}


def test_parse_ratio():
    assert [pairs.parse_ratio(x) for x in (2, "1:3", "2:1", "1.5", "1:0")] == [2.0, 3.0, 0.5, 1.5, 0.0]
    for bad in ("x", "1:2:3", 0, -1, "0:1", None):
        with pytest.raises(ValueError):
            pairs.parse_ratio(bad)


def test_labelled_pairs_and_stats(spark):
    s1 = recs(spark, [("S1-01", "Apex Global", "US"), ("S1-03", "Apex Logistics", "US")])
    s2, s3 = recs(spark, [("S2-01", "Apex Global", "US"), ("S2-02", "Apex Other", "US")]), recs(spark, [("S3-01", "Apex Global", "US")])
    edges, universe = ground_truth.from_dict(spark, {"S1-01": ["S2-01", "S3-01"], "S1-03": []})
    assert universe.count() == 2 and ground_truth.counts(edges, universe).first().asDict() == {"s1_count": 2, "s2_match_count": 1, "s3_match_count": 1, "total_match_count": 2}
    got = pairs.labelled_pairs(s1, {"S2": s2, "S3": s3}, edges, "1:1")
    row = pairs.pair_stats(got).first()
    assert (row["s2_positives"], row["s3_positives"], row["total_positives"]) == (1, 1, 2)
    assert row["total_negatives"] == 3 and row["negative_ratio"] == 1.5


def _features(spark, a, b):
    left, right = recs(spark, [("A", *a)]), recs(spark, [("B", *b)])
    pair = spark.createDataFrame([("A", "B")], "s1_id string, secondary_id string")
    return features.pair_features(features.joined_records(pair, left, right)).first().asDict()


def test_features_of_equal_records(spark):
    f = _features(spark, ("Reliance Industries Ltd", "IN", "Mumbai"), ("Reliance Industries Ltd", "India", "Mumbai"))
    assert [c for c in f if c in FEATURES] == list(FEATURES) and len(FEATURES) == 26 and len(SHARD_COLUMNS) == 30
    assert all(f[c] is not None for c in FEATURES)
    ones = ("country_equal", "name_exact_raw", "name_exact_norm", "name_jaro_winkler", "addr_exact_norm", "combined_weighted_sim", "interaction_name_x_addr", "country_strong_name")
    assert all(f[c] == 1 for c in ones) and f["addr_missing"] == 0


def test_features_without_address(spark):
    f = _features(spark, ("Apple", "US", None), ("Apple Inc", "US", "1 Loop"))
    assert f["addr_missing"] == 1 and f["addr_both_present"] == 0
    assert all(f[c] == 0 for c in FEATURES if c.startswith("addr_") and c != "addr_missing")
    assert f["combined_name_dominant_sim"] == f["name_sim_composite"] == f["combined_weighted_sim"]


def test_features_of_missing_names(spark):
    f = _features(spark, (None, "US", "x"), ("-", "US", "###"))
    assert (f["name_jaro_winkler"], f["name_levenshtein_norm"], f["name_token_similarity"], f["name_len_ratio"]) == (0, 1, 1, 1)
    assert f["name_sim_composite"] == 0.6 and f["addr_both_present"] == 1


def test_split_sizes_and_stability(spark):
    ids = spark.createDataFrame([(f" S1-{i:04d} ",) for i in range(100)] * 2, "s1_id string")
    one = {r["s1_id"]: r["split"] for r in splits.grouped_split(ids).collect()}
    assert sorted(list(one.values()).count(s) for s in ("train", "val", "holdout")) == [15, 15, 70]
    assert one == {r["s1_id"]: r["split"] for r in splits.grouped_split(ids.orderBy(F.rand())).collect()}
    assert one != {r["s1_id"]: r["split"] for r in splits.grouped_split(ids, seed=999).collect()}
    assert splits.grouped_split(ids.limit(0)).count() == 0 and splits.hashed_split(ids).count() == 100
    for bad in ((0.5, 0.5, 0.5), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            splits.grouped_split(ids, *bad)


AUDIT = "split string, s1_id string, secondary_id string, source string, label int"


@pytest.mark.parametrize(("rows", "message"), [
    ([("train", "S1-1", "S2-1", "S2", 1)] * 2, "Duplicate"),
    ([("train", "S1-1", "S2-1", "S2", 0)], "mislabeled"),
    ([("train", "S1-2", "S3-1", "S2", 0)], "Source mismatch"),
    ([("train", "S1-2", "S2-5", "S2", 0), ("val", "S1-2", "S2-6", "S2", 0)], "leakage"),
])
def test_audit_failures(spark, rows, message):
    edges = ground_truth.from_pairs(spark, [("S1-1", "S2-1")])
    with pytest.raises(ValueError, match=message):
        audit.audit(spark.createDataFrame(rows, AUDIT), edges)


def test_audit_of_clean_pairs(spark):
    edges = ground_truth.from_pairs(spark, [("S1-1", "S2-1")])
    df = spark.createDataFrame([("train", "S1-1", "S2-1", "S2", 1), ("val", "S1-2", "S3-1", "S3", 0)], AUDIT)
    report = audit.audit(df, edges, {"f": "1"}, {"f": "1"})
    assert report["status"] == "PASS" and report["pair_counts"] == {"train": 1, "val": 1} and report["raw_data_check"] == "Verified untouched"
    for after, message in (({"f": "2"}, "modified"), ({}, "disappeared")):
        with pytest.raises(ValueError, match=message):
            audit.audit(df, edges, {"f": "1"}, after)


def _scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def test_evaluation(spark):
    df = _scored(spark, [1, 1, 0, 0, 1, 0], [0.9, 0.8, 0.1, 0.2, 0.95, 0.05])
    assert tuple(evaluate.confusion(df, 0.5).first()) == (3, 0, 0, 3)
    assert evaluate.at_threshold(df, 0.5).first()["f1"] == 1.0
    assert tuple(evaluate.confusion(_scored(spark, [1, 0], [0.5, 0.5]), 0.5).first()) == (1, 1, 0, 0)
    empty = evaluate.at_threshold(df.limit(0)).first()
    assert (empty["precision"], empty["support"]) == (0.0, 0)
    assert tuple(evaluate.confusion(_scored(spark, [2, 1], [0.9, 0.9]), 0.5).first()) == (1, 0, 0, 1)


def test_sweep(spark):
    df = _scored(spark, [1, 0, 1, 0, 1], [0.3, 0.3, 0.6, 0.9, 0.05])
    rows = evaluate.sweep(df).collect()
    assert len(rows) == 19 and [r["threshold"] for r in rows] == sorted(r["threshold"] for r in rows)
    for r in rows:
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(evaluate.confusion(df, r["threshold"]).first())
    assert all(a["recall"] >= b["recall"] for a, b in zip(rows, rows[1:]))
    assert [r["threshold"] for r in evaluate.sweep(df, [0.9, 0.1, 0.1]).collect()] == [0.1, 0.9]


def test_rules(spark):
    s1 = recs(spark, [("S1-1", "Acme Corp", "US", "1 Main St")])
    s2 = recs(spark, [("S2-1", "Acme Corporation", "USA", "1 Main Street"), ("S2-2", "Acme Corp", "US", None), ("S2-3", "Acme Corp.", "US", "zzz")])
    edges = ground_truth.from_pairs(spark, [("S1-1", "S2-1")])
    got = {(r["rule"], r["source"]): (r["tp"], r["fp"], r["fn"]) for r in rules.rule_counts(s1, {"S2": s2}, edges).collect()}
    assert [got[(r, "S2")] for r in rules.RULES] == [(0, 1, 1), (1, 2, 0), (1, 0, 0), (1, 1, 0)]
    assert all(got[(r, "S2")] == got[(r, "Overall")] for r in rules.RULES)


def test_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    row = stats.linear(df, "x", (50,)).first()
    assert row["p50"] == 2.5 and row["std"] == pytest.approx(1.2909944)
    assert stats.linear(df.limit(1), "x").first()["std"] == 0.0 and stats.linear(df.limit(0), "x").count() == 0
    low = stats.floor_index(df, "x", (50, 99)).first()
    assert (low["p50"], low["p99"], low["std"]) == (3.0, 4.0, 1.118)


def test_profiles(spark):
    df = spark.createDataFrame([("S1-1", "é", " ", "US"), ("S1-1", "", None, "US"), ("bad", "abc", "x", None)], "entity_id string, business_name string, business_address string, country string")
    assert tuple(profile.id_profile(df).first()) == (3, 2, 1, 1)
    got = {r["field"]: (r["missing"], r["blank"], r["valid"]) for r in profile.missing_profile(df, "business_name", "business_address").collect()}
    assert got == {"business_name": (1, 0, 2), "business_address": (1, 1, 1)}
    assert [tuple(r) for r in profile.country_top(df).collect()] == [("US", 2, 66.67)]
    lines = spark.createDataFrame([("S1-1", "S2-1, S3-2,"), ("S1-2", ""), ("S1-3", "S2-9")], "source1_entity_id string, matched_entity_ids string")
    row = profile.ground_truth_profile(lines).first()
    assert (row["total_matches"], row["singletons"], row["s2_only"], row["both"], row["max"]) == (3, 1, 1, 1, 2)
    assert {r["kind"]: r["n"] for r in profile.co_occurrence(lines).collect()} == {"singleton": 1, "both": 1, "s2_only": 1}
    assert profile.ground_truth_profile(lines.limit(0)).first()["total_matches"] == 0


def test_validation(spark):
    df = spark.createDataFrame([("S1-1", "a", "b", "c"), ("X-1", None, "b", "c"), ("", "a", "b", "c")], "entity_id string, business_name string, business_address string, country string")
    assert [len(r["errors"]) for r in validate.record_errors(df).collect()] == [0, 1, 0]
    assert [r["errors"] for r in validate.record_errors(df.drop("country")).limit(1).collect()] == [["missing field: country"]]
    row = validate.table_report(df).first()
    assert (row["n_rows"], row["null_business_name"], row["unknown_prefix"]) == (3, 1, 1)


def test_prefilter(spark):
    s1 = recs(spark, [("S1-1", "Acme Tools", "US")])
    s2 = recs(spark, [("S2-0", "Zeta", "FR"), ("S2-1", "Zeta", "US"), ("S2-2", "Acme Tools", "US"), *[(f"S2-3{i}", f"Acme T{i}", "US") for i in range(7)], ("S2-9", "True One", "IN")])
    edges = ground_truth.from_pairs(spark, [("S1-1", "S2-9")])
    got = {r["entity_id"]: r["kept_as"] for r in pairs.prefiltered(s1, s2, edges).collect()}
    assert "S2-0" not in got and got["S2-9"] == "match" and got["S2-2"] == "name"
    assert list(got.values()).count("prefix") == 5 and list(got.values()).count("country") == 3


def test_prefilter_with_small_limits(spark):
    s1 = recs(spark, [("S1-1", "Acme Tools", "US"), ("S1-2", "Brisk Ltd", "IN")])
    s2 = recs(spark, [*[(f"S2-1{i}", f"Acme T{i}", "US") for i in range(4)], *[(f"S2-2{i}", f"Zeta {i}", "US") for i in range(4)], *[(f"S2-3{i}", f"Yota {i}", "IN") for i in range(3)]])
    got = pairs.prefiltered(s1, s2, ground_truth.from_pairs(spark, [("S1-2", "S2-32")]), per_prefix=1, per_country=2).collect()
    assert {r["entity_id"]: r["kept_as"] for r in got} == {"S2-10": "prefix", "S2-11": "country", "S2-12": "country", "S2-30": "country", "S2-31": "country", "S2-32": "match"}


def test_registered_prefilter_takes_every_s1_record(spark, tmp_path):
    names = {3: "walnut desk", 13: "walnut desk", 6: "copper lamp", 12: "silver bowl"}
    keys = [3, 6, 12, *range(1, 180, 3)]
    rows = [(k, names.get(k, f"{k:05d} thing"), "Brand", "TYPE", 7) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["entity_id"]: r["kept_as"] for r in queries.pilot_prefilter(spark, str(tmp_path)).collect()}
    # 3 is in India, 6 and 12 in the US, none in France; 36 records of the US have no other claim than their country.
    assert got == {f"S2-{k}": "match" if k == 13 else "country" for k in keys[3:] if k % 5 != 4}


def _clones(spark, n=40, prefix="S"):
    """Records of few names, many alike, some repeated with another name and some without country or name."""
    words = ["amber quay", "amber kiln ltd", "birch quay", "cedar loft", "cedarwood inn", "x"]
    rows = [(f"{prefix}{i % (n - 4)}", None if i % 11 == 10 else words[i * i % len(words)], None if i % 13 == 12 else ["DK", "SE"][i % 2]) for i in range(n)]
    return recs(spark, rows)


def _plan_rows(spark, make):
    """The result of ``make`` and the most rows that a join in its plan gave."""
    df = make()
    got = [tuple(r) for r in df.collect()]
    most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return got, most


def test_counts_of_pairs_without_the_pairs(spark):
    """Counts equal those of the pairs, also where ids repeat or are on both sides; no join makes the pairs."""
    a, b = _clones(spark).cache(), _clones(spark, 60, "S").cache()
    least = lambda rows, key: {k: (len(v), min(v), max(v)) for k in {key(r) for r in rows} for v in [[r[1] for r in rows if key(r) == k]]}
    for strategy in ("name", "prefix", "tokens"):
        items = lambda df: {(r[1], r[0]) for r in blocking.block_index(df, strategy).select("block_key", "entity_id").collect()}
        want = {(x, y) for x, k in items(a) for y, m in items(b) if k == m and x != y}
        pairs_ = [tuple(r) for r in blocking.candidates_of(a, blocking.block_index(b, strategy), strategy).collect()]
        assert len(pairs_) == len(set(pairs_)) and set(pairs_) == want
        assert {r[0]: tuple(r[1:]) for r in blocking.candidate_counts(a, b, strategy).collect()} == least(want, lambda r: r[0])
    made = [tuple(r) for r in blocking.tier_pairs(a, b).collect()]
    assert len(made) == len({r[:2] for r in made}) and all(x != y for x, y, _ in made)
    want = least(made, lambda r: (r[0], r[2]))
    assert {(r["s1_id"], r["tier"]): (r["n"], r["first"]) for r in blocking.tier_counts(a, b).collect()} == {k: v[:2] for k, v in want.items()}
    for options in ({}, {"use_prefix": True, "use_tokens": True}, {"use_country": False, "use_tokens": True}, {"use_exact_name": False}):
        want = least([tuple(r) for r in blocking.candidate_pairs(a, **options).collect()], lambda r: r[0])
        assert {r["id_a"]: (r["n"], r["first"]) for r in blocking.candidate_pair_counts(a, **options).collect()} == {k: v[:2] for k, v in want.items()}
    many = recs(spark, [(f"S{i % 2}-{i}", "amber quay", "DK") for i in range(600)]).cache()
    one, two = many.where("entity_id LIKE 'S0%'").cache(), many.where("entity_id LIKE 'S1%'").cache()
    for make in (lambda: blocking.tier_counts(one, two), lambda: blocking.candidate_counts(one, two, "tokens"), lambda: blocking.candidate_pair_counts(many, use_tokens=True)):
        got, most = _plan_rows(spark, make)
        assert len(got) in (300, 599) and most <= 600


def test_labels_of_lists(spark):
    """Labelled lists hold the labelled pairs, each once; records with equal matches share the cut of a list."""
    a, b = _clones(spark).cache(), _clones(spark, 60).cache()
    pairs_ = blocking.tier_pairs(a, b).cache()
    edges = pairs_.where(F.crc32("secondary_id") % 3 == 0).select("s1_id", "secondary_id")
    want = {tuple(r) for r in ground_truth.labelled(pairs_, edges).select("s1_id", "secondary_id", "tier", "is_match").collect()}
    extra = a.select(F.col("entity_id").alias("s1_id"), F.lit(7).alias("seven")).distinct()
    lists = blocking.labelled_lists(a, b, ground_truth.listed(edges), carried=extra)
    rows = lists.where("seven = 7").select("s1_id", F.explode("ids").alias("secondary_id"), "tier", "is_match").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) and {r[3] for r in want} == {True, False}


def test_negatives_counted_without_the_pairs(spark):
    s2 = recs(spark, [("S2-1", "Kestrel Optics", "US"), ("S2-2", "Kestrel Optics", "US"), ("S2-3", "Kestrel Tools", "US"), ("S2-4", "Bramble", "US"), ("S2-5", "Kestrel Optics", "IN"), ("S1-D", "Kestrel Optics", "US")])
    s1 = recs(spark, [("S1-A", "Kestrel Optics", "US"), ("S1-B", "Kestrel Optics", "US"), ("S1-C", "Otter Inns", "US"), ("S1-D", "Kestrel Optics", "US"), ("S1-E", "Kestrel Optics", None), ("S1-F", "Kestrel Mills", "IN")])
    edges, _ = ground_truth.from_dict(spark, {"S1-A": ["S2-1", "S2-4"], "S1-D": ["S2-2"], "S1-F": ["S2-1"]})
    for ratio in (9.0,):
        want = pairs.negatives_exact(s1, s2, pairs.positives(s1, s2, edges, "S2"), edges, ratio).groupBy("s1_id", "tier").count()
        members, cells = pairs.negative_counts(s1, s2, edges, "S2", ratio)
        got = members.join(cells, "cell").collect()
        assert {(r["s1_id"], t, r[f"n_{t}"]) for r in got for t in (1, 2, 3) if r[f"n_{t}"]} == {tuple(r) for r in want.collect()}
        assert sum(r["records"] for r in cells.collect()) == 6


def test_features_of_kinds_equal_those_of_pairs(spark):
    s1 = recs(spark, [("S1-A", "Wren Mills", "US", "3 Elm St"), ("S1-B", "Wren Mills", "US", "3 Elm St"), ("S1-C", "wren mills", "US", None), ("S1-X", "Wren Mills", "US", "9 Oak Rd")])
    sec = recs(spark, [("S2-A", "Wren Mills", "USA", "4 Elm St"), ("S2-B", "Wren Mills", "USA", "4 Elm St"), ("S3-A", "WREN MILLS", "US", None), ("S1-X", "Wren Mills", "US", "9 Oak Rd"), ("S2-C", "Wren Mills", "IN", "x")])
    met = blocking.tier_pairs(s1, sec, tiers=(1,)).select("s1_id", "secondary_id")
    want = features.pair_features(features.joined_records(met, s1, sec)).select("s1_id", "secondary_id", *FEATURES).collect()
    got = features.exact_name_features(s1, sec).collect()
    assert len(got) == 15 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_seeded_pairs_of_grouped_edges(spark):
    import hashlib

    s1, s2 = recs(spark, [("S1-A", "Plover Dyes", "US")]), recs(spark, [(f"S2-{i}", "Plover Dyes", "US") for i in range(6)])
    edges, _ = ground_truth.from_dict(spark, {"S1-A": ["S2-4"]})
    got = pairs.labelled_pairs(s1, {"S2": s2}, ground_truth.grouped(edges), 2.0, 42).collect()
    draw = sorted((i for i in range(6) if i != 4), key=lambda i: hashlib.md5(f"42:S1-A:S2-{i}".encode()).hexdigest())
    assert {(r["secondary_id"], r["label"]) for r in got} == {("S2-4", 1), *((f"S2-{i}", 0) for i in draw[:2])}


def test_draws_against_hashlib():
    """Ids of all lengths (a message may be longer than a block), missing and equal addresses, all or few taken."""
    import hashlib
    import random

    rng = random.Random(5)
    for n, low, high in ((9, 1, 45), (300, 6, 9), (17_000, 7, 8)):
        items = sorted({"é" * rng.randint(0, 1) + "".join(rng.choices("abc0123456789-", k=rng.randint(low, high))) for _ in range(n)})
        at = [rng.choice([None, "x", "y"]) for _ in items]
        records = [f"S1-{rng.randint(1, 10 ** rng.randint(1, 7))}" for _ in range(5)]
        k, own = [rng.randint(1, len(items)) for _ in records], [rng.choice([None, "x", "q"]) for _ in records]
        for r, take, mine, got in zip(records, k, own, draws.drawn(42, records, k, own, items, pa.array(at, pa.string()))):
            order = sorted((not (mine and a and a != mine), hashlib.md5(f"42:{r}:{x}".encode()).digest(), i) for i, (a, x) in enumerate(zip(at, items)))
            assert sorted(got.tolist()) == sorted(i for _, _, i in order[:take])


def test_draws_in_blocks(spark, monkeypatch):
    s1, s2 = recs(spark, [(f"S1-{i}", "Gannet Tiles", "US") for i in range(9)]), recs(spark, [(f"S2-{i}", "Gannet Tiles", "US") for i in range(8)])
    none = ground_truth.from_pairs(spark, [("S1-x", "S2-x")])
    want = pairs.negatives(s1, s2, pairs.positives(s1, s2, none, "S2"), none, 1.0, 7).collect()
    monkeypatch.setattr(pairs, "DRAWS", 16)
    assert sorted(pairs.negatives(s1, s2, pairs.positives(s1, s2, none, "S2"), none, 1.0, 7).collect()) == sorted(want) and len(want) == 9


def test_features_of_chosen_pairs_equal_those_of_joined_records(spark):
    s1 = recs(spark, [("S1-A", "Wren Mills", "US", "3 Elm St"), ("S1-B", "Wren Mills", "US", "3 Elm St"), ("S1-C", "wren mills", "US", None)])
    sec = recs(spark, [("S2-A", "Wren Mills", "USA", "4 Elm St"), ("S2-B", "Wren Mills", "USA", "4 Elm St"), ("S3-A", "WREN WORKS", "US", None)])
    chosen = spark.createDataFrame([("S1-A", "S2-A", 1, "val"), ("S1-B", "S2-B", 0, "train"), ("S1-C", "S3-A", 0, "train"), ("S1-B", "S3-A", 0, "train"), ("S1-B", "S9-x", 0, "train")], "s1_id string, secondary_id string, label int, split string")
    want = features.pair_features(features.joined_records(chosen, s1, sec))
    got = features.chosen_features(chosen, s1, sec)
    key = lambda r: (r["s1_id"], r["secondary_id"])
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() == 4
