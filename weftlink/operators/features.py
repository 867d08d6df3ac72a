"""The 26 features of a pair of records, one projection over normalised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.similarity import Weights
from ..functions.text import is_missing, safe_field
from ..schema import FEATURES
from ..sources.scratch import small, written
from .blocking import BROADCAST_IDS, MEMBERS

_RECORD = ("entity_id", "business_name", "business_address", "name_norm", "addr_norm", "country_norm")


def joined_records(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "s1_id", right_id: str = "secondary_id") -> DataFrame:
    """Pairs with the columns of both records, as ``a_...`` and ``b_...``."""
    side = lambda df, p, key: df.select(*[F.col(c).alias(key if c == "entity_id" else f"{p}_{c}") for c in _RECORD])
    return pairs.join(side(left, "a", left_id), left_id).join(side(right, "b", right_id), right_id)


def _equal(a: Column, b: Column) -> Column:
    return ((a == b) & (a != "")).cast("int")


def _with_jaro_winkler(df: DataFrame, variant: str) -> DataFrame:
    """Jaro-Winkler of names and of addresses, each distinct pair of strings scored once."""
    out = df
    for name, a, b in (("_name_jw", "_a_name", "_b_name"), ("_addr_jw", "_a_addr", "_b_addr")):
        unique = out.select(a, b).distinct()
        out = out.join(unique.withColumn(name, sim.jaro_winkler(F.col(a), F.col(b), variant)), [a, b])
    return out


def pair_features(joined: DataFrame, weights: Weights = Weights(), variant: str = "gated") -> DataFrame:
    """``joined`` (see ``joined_records``) with the feature columns, rounded half-even to six places."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = joined.withColumns({"_a_name": empty("a_name_norm"), "_b_name": empty("b_name_norm"), "_a_addr": empty("a_addr_norm"), "_b_addr": empty("b_addr_norm"), "_both": ~is_missing("a_business_address") & ~is_missing("b_business_address")})
    df = _with_jaro_winkler(df, variant)
    out: dict[str, Column] = {}
    both = F.col("_both")

    def compare(prefix: str, a: Column, b: Column, jw: Column, present: Column) -> None:
        zero = lambda c, z: F.when(present, c).otherwise(F.lit(z))
        ta, tb = sim.tokens(a), sim.tokens(b)
        lev, tok = sim.levenshtein_norm(a, b), sim.jaccard(ta, tb)
        out[f"{prefix}_exact_norm"] = zero(_equal(a, b), 0)
        out[f"{prefix}_jaro_winkler"] = zero(jw, 0.0)
        out[f"{prefix}_levenshtein_norm"] = zero(lev, 0.0)
        out[f"{prefix}_token_similarity"] = zero(tok, 0.0)
        out[f"{prefix}_len_diff"] = zero(F.abs(F.length(a) - F.length(b)), 0)
        out[f"{prefix}_len_ratio"] = zero(sim.length_ratio(a, b), 0.0)
        out[f"{prefix}_token_count_diff"] = zero(F.abs(F.size(ta) - F.size(tb)), 0)
        out[f"{prefix}_sim_composite"] = zero(sim.composite(jw, lev, tok, weights), 0.0)

    a, b = F.col("_a_name"), F.col("_b_name")
    out["name_exact_raw"] = _equal(safe_field("a_business_name"), safe_field("b_business_name"))
    compare("name", a, b, F.col("_name_jw"), F.lit(True))
    out["name_char_bigram_sim"] = sim.jaccard(sim.bigrams(a), sim.bigrams(b))
    compare("addr", F.col("_a_addr"), F.col("_b_addr"), F.col("_addr_jw"), both)
    out["addr_both_present"] = both.cast("int")
    out["addr_missing"] = (~both).cast("int")
    same = _equal(empty("a_country_norm"), empty("b_country_norm"))
    out["country_equal"] = out["same_country"] = same
    out["interaction_name_x_addr"] = out["name_exact_norm"] * out["addr_jaro_winkler"]
    out["country_strong_name"] = ((same == 1) & (F.col("_name_jw") >= weights.strong_name)).cast("int")
    df = df.withColumns(out)
    share = F.when(both, F.lit(weights.address)).otherwise(F.lit(0.0))
    total = F.lit(weights.name) + share
    df = df.withColumn("combined_weighted_sim", F.when(total > 0, (F.lit(weights.name) * F.col("name_sim_composite") + share * F.col("addr_sim_composite")) / total).otherwise(0.0))
    df = df.withColumn("combined_name_dominant_sim", F.when(both, F.col("combined_weighted_sim")).otherwise(F.col("name_sim_composite")))
    kinds = dict(df.dtypes)
    kept = [c for c in joined.columns if c not in FEATURES]
    return df.select(*kept, *[F.bround(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in FEATURES])


def exact_name_features(s1: DataFrame, secondary: DataFrame, weights: Weights = Weights(), variant: str = "gated") -> DataFrame:
    """``(s1_id, secondary_id, features)`` of all pairs with one name and country (tier 1).

    Records with the same texts are a kind: pairs of kinds are scored, and scores are given to the pairs of their ids,
    which are neither shuffled nor sorted.
    """
    texts = [c for c in _RECORD if c != "entity_id"]

    def kinds(records: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        each = records.where("name_norm IS NOT NULL AND country_norm IS NOT NULL").withColumn("kind", F.md5(F.to_json(F.struct(*texts)))).select("kind", "entity_id", *texts)
        sizes = each.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("n_lists"), *[F.any_value(c).alias(c) for c in texts])
        sizes = written(sizes, "kinds")
        dealt = each.select("kind", "entity_id").join(sizes.select("kind", "n_lists"), "kind").groupBy("kind", F.pmod(F.xxhash64("entity_id"), "n_lists").alias("list"))
        lists = written(dealt.agg(F.collect_set("entity_id").alias(f"{p}_ids")).select(F.col("kind").alias(f"{p}_kind"), f"{p}_ids"), "lists")
        return sizes.select(F.col("kind").alias(f"{p}_kind"), *[F.col(c).alias(f"{p}_{c}") for c in texts]), lists

    (left, left_ids), (right, right_ids) = kinds(s1, "a"), kinds(secondary, "b")
    met = written(left.join(right, (F.col("a_name_norm") == F.col("b_name_norm")) & (F.col("a_country_norm") == F.col("b_country_norm"))), "kind-pairs")
    scored = written(pair_features(met, weights, variant).select("a_kind", "b_kind", *FEATURES), "scored")
    out = scored.join(left_ids, "a_kind").join(right_ids, "b_kind").select(F.explode("a_ids").alias("s1_id"), "b_ids", *FEATURES)
    return out.select("s1_id", F.explode("b_ids").alias("secondary_id"), *FEATURES).where("s1_id <> secondary_id")


def chosen_features(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: Weights = Weights(), variant: str = "gated") -> DataFrame:
    """``pair_features`` of ``joined_records``: records with the same texts are a kind, and the pairs of kinds that occur
    among ``pairs`` are scored once. Pairs are shuffled with their ids alone (and not for their kinds where ids are few)."""
    texts = [c for c in _RECORD if c != "entity_id"]

    def kinds(records: DataFrame, p: str, key: str) -> tuple[DataFrame, DataFrame]:
        each = records.select(F.col("entity_id").alias(key), F.md5(F.to_json(F.struct(*texts))).alias("_texts"), *texts)
        table = each.groupBy("_texts").agg(*[F.any_value(c).alias(f"{p}_{c}") for c in texts])
        table = written(table.withColumn(f"{p}_kind", F.monotonically_increasing_id()), "kinds")
        ids = written(each.select(key, "_texts").join(table.select("_texts", f"{p}_kind"), "_texts").drop("_texts"), "kind-ids")
        return table.drop("_texts"), small(ids, BROADCAST_IDS)

    (left, left_ids), (right, right_ids) = kinds(left, "a", "s1_id"), kinds(right, "b", "secondary_id")
    met = pairs.join(left_ids, "s1_id").join(right_ids, "secondary_id")
    unique = written(met.select("a_kind", "b_kind").distinct(), "kind-pairs")
    scored = written(pair_features(unique.join(left, "a_kind").join(right, "b_kind"), weights, variant), "scored")
    kept = ["secondary_id", *[c for c in ("s1_id", *pairs.columns) if c != "secondary_id"]]
    return met.join(scored, ["a_kind", "b_kind"]).select(*dict.fromkeys(kept), *[f"{p}_{c}" for p in "ab" for c in texts], *FEATURES)
