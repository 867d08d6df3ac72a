"""Blocking: candidate pairs by equi-joins on keys, never by comparing everything with everything.

A strategy is a function from normalised records to an array of keys; records that share a key are candidates. The
country is a further key of every join, and alone it only counts pairs (``country_volume``) or fills up negatives.

Records with the same keys are a class: keys are joined between classes, and counts need no pairs of records at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import written

# Words that make no token key.
STOPWORDS = ("the", "and", "of", "a", "an", "in", "at", "for", "to", "by", "inc", "llc", "ltd", "corp", "co", "pvt", "pte", "lp", "llp")
PREFIX_LEN, TOKEN_LEN = 5, 3
TIERS = ("exact", "similar", "ordinary")
# Ids in a list of a class's members, about, and in all lists that a join may broadcast.
MEMBERS, BROADCAST_IDS = 512, 1_000_000
# Fixed value: members of a class that are ranked in one part, about.
PART = 50_000

KeyMaker = Callable[[], Column]


def name_key() -> Column:
    return F.when(F.col("name_norm").isNotNull(), F.array("name_norm"))


def prefix_key(prefix_len: int = PREFIX_LEN) -> Column:
    """The first characters; names of a single character have no key, shorter names count whole."""
    return F.when(F.length("name_norm") >= 2, F.array(F.substring("name_norm", 1, prefix_len)))


def token_keys(min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None) -> Column:
    """Distinct tokens that are long enough and no stopwords."""
    stop = list(STOPWORDS if stopwords is None else stopwords)
    significant = lambda t: (F.length(t) >= min_token_len) & (~t.isin(*stop) if stop else F.lit(True))
    return F.array_distinct(F.filter(F.split("name_norm", " "), significant))


#: Strategies by name; add to it to make a new one available to ``candidate_pairs``.
STRATEGIES: dict[str, Callable[..., Column]] = {"name": name_key, "prefix": prefix_key, "tokens": token_keys}


def block_index(records: DataFrame, strategy: str = "name", **options) -> DataFrame:
    """``(block_key, entity_id, country_norm)`` of one strategy; ``country`` is one too."""
    keys = F.when(F.col("country_norm").isNotNull(), F.array("country_norm")) if strategy == "country" else STRATEGIES[strategy](**options)
    return records.select(F.explode(keys).alias("block_key"), "entity_id", "country_norm")


def blocks(index: DataFrame) -> DataFrame:
    """Members of each block as a sorted array: ``(block_key, members)``. For inspection; joins use the index itself."""
    return index.groupBy("block_key").agg(F.array_sort(F.collect_set("entity_id")).alias("members"))


# Classes of records: (id, cls) is a table of members, links are (a, b, tier) between classes.


def _members(items: DataFrame, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, cls)`` and classes ``(cls, own, ...)``, a row an item, of ``(id, item)`` with structs as items. Ids
    in ``own`` are a class each, so that a record on both sides can be told from its likes."""
    each = items.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = each.withColumn("own", F.lit(None).cast("string")) if own is None else each.join(own.withColumn("own", F.col("id")), "id", "left")
    each = written(each.withColumn("cls", F.md5(F.concat(F.to_json("items"), F.coalesce("own", F.lit(""))))), "members")
    classes = each.groupBy("cls", "own").agg(F.any_value("items").alias("items"))
    return each.select("id", "cls"), written(classes.select("cls", "own", F.inline("items")), "classes")


def _names(records: DataFrame) -> DataFrame:
    """Items of records: whatever keys are made of."""
    return records.select(F.col("entity_id").alias("id"), F.struct("country_norm", "name_norm").alias("item"))


def _keyed(classes: DataFrame, strategy: str, **options) -> DataFrame:
    keys = block_index(classes.withColumn("entity_id", F.col("cls")), strategy, **options)
    return keys.join(classes.select(F.col("cls").alias("entity_id"), "own").distinct(), "entity_id").select(F.col("entity_id").alias("cls"), "own", "block_key", F.lit(1).alias("tier"))


def _linked(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a, b, tier)``: classes that share a key, by the least tier, from ``(cls, own, tier, ...)``, a row a key."""
    side = lambda df, name: df.distinct().withColumnsRenamed({"cls": name, "own": f"own_{name}"})
    on = [c for c in left.columns if c not in ("cls", "own", "tier")]
    met = side(left, "a").join(side(right, "b").drop("tier"), on)
    return met.where("own_a IS NULL OR own_b IS NULL OR own_a <> own_b").groupBy("a", "b").agg(F.min("tier").alias("tier"))


Sides = tuple[DataFrame, DataFrame, DataFrame]


def _classes(left: DataFrame, right: DataFrame, keys: Callable[[DataFrame], DataFrame], right_keys: Callable[[DataFrame], DataFrame] | None = None) -> Sides:
    """Members of both sides and the links of their classes, from items."""
    both = left.select("id").distinct().join(right.select("id"), "id", "left_semi")
    (lm, lc), (rm, rc) = _members(left, both), _members(right, both)
    return lm, rm, written(_linked(keys(lc), (right_keys or keys)(rc)), "links")


def _counted(sides: Sides) -> DataFrame:
    """``(id, tier, n, first, last)``: how many records of the right side each record meets, without making the pairs."""
    lm, rm, links = sides
    sizes = rm.groupBy(F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    per = links.join(sizes, "b").groupBy(F.col("a").alias("cls"), "tier").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return lm.join(per, "cls").select("id", "tier", "n", "first", "last")


def _lists(members: DataFrame) -> DataFrame:
    """``(b, ids)``: the members of each class in lists of about ``MEMBERS`` ids."""
    sizes = members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("n_lists"))
    dealt = members.join(sizes, "cls").groupBy(F.col("cls").alias("b"), F.pmod(F.xxhash64("id"), "n_lists").alias("list"))
    return written(dealt.agg(F.array_sort(F.collect_list("id")).alias("ids")).select("b", "ids"), "lists")


def _paired(sides: Sides) -> DataFrame:
    """``(id, tier, ids)``: the records of the right side that each record meets.

    A pair of ids is in one list only, so nothing has to be made distinct. Where lists and links are small, the records
    are dealt by id, evenly, and lists and links go to all; else both are dealt by class.
    """
    lm, rm, links = sides
    lists = _lists(rm)
    total = lists.agg(F.sum(F.size("ids") + 4)).first()[0] or 0
    if total > BROADCAST_IDS or links.limit(BROADCAST_IDS // 4 + 1).count() > BROADCAST_IDS // 4:
        return lm.join(links.join(lists, "b").withColumnRenamed("a", "cls"), "cls").select("id", "tier", "ids")
    dealt = lm.repartition(int(lm.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.join(F.broadcast(links.withColumnRenamed("a", "cls")), "cls").join(F.broadcast(lists), "b").select("id", "tier", "ids")


def _labelled(sides: Sides, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, sub)`` and ``(sub, tier, is_match, ids)``: ``_paired``, each list cut into matches and others. Records of a
    class that have the same matches share their lists, which are cut once. ``matches``: (id, matches)."""
    lm, rm, links = sides
    none = F.array().cast("array<string>")
    each = lm.join(matches.hint("merge"), "id", "left").withColumn("matches", F.array_sort(F.coalesce("matches", none)))
    each = each.withColumn("sub", F.md5(F.concat("cls", F.to_json("matches"))))
    subs = written(each.groupBy("sub").agg(F.any_value("cls").alias("a"), F.any_value("matches").alias("matches")), "subclasses")
    cut = F.array(F.struct(F.lit(True).alias("is_match"), F.array_intersect("ids", "matches").alias("ids")), F.struct(F.lit(False).alias("is_match"), F.array_except("ids", "matches").alias("ids")))
    lists = written(subs.join(links, "a").join(_lists(rm), "b").select("sub", "tier", F.inline(cut)).where(F.size("ids") > 0), "lists")
    return written(each.select("id", "sub"), "members"), lists


def first_ids(sides: Sides, need: DataFrame, tier: int) -> DataFrame:
    """``(cls, ids)``: of the right records that a class meets in a tier the first ``k`` in order. ``need``: (cls, k).

    A class takes from each class it meets what may be among its first k: up to an id below which it surely meets k.
    """
    _, rm, links = sides
    wanted = links.where(F.col("tier") == tier).select(F.col("a").alias("cls"), "b").join(need, "cls")
    wanted = written(wanted, "wanted")
    most = wanted.groupBy(F.col("b").alias("cls")).agg(F.max("k").alias("k"))
    sizes = rm.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = rm.join(most, "cls").join(sizes, "cls").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    for by in (("cls", "part"), ("cls",)):  # a class may hold most records: its parts are ranked first
        dealt = dealt.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where("r <= k")
    firsts = written(dealt.groupBy(F.col("cls").alias("b")).agg(F.array_sort(F.collect_list("id")).alias("ids")), "firsts")
    around = Window.partitionBy("cls")
    share = F.ceil(2 * F.col("k") / F.count(F.lit(1)).over(around)).cast("int")
    ends = wanted.join(firsts, "b").withColumn("took", F.least(share, F.size("ids"))).select("cls", "k", "took", F.element_at("ids", F.col("took")).alias("end"))
    ends = ends.withColumn("sum", F.sum("took").over(around.orderBy("end", "took").rowsBetween(Window.unboundedPreceding, 0)))
    bound = ends.groupBy("cls").agg(F.min(F.when(F.col("sum") >= F.col("k"), F.col("end"))).alias("bound"))
    near = wanted.join(bound, "cls").join(firsts, "b").withColumn("ids", F.slice(F.when(F.col("bound").isNull(), F.col("ids")).otherwise(F.filter("ids", lambda x: x <= F.col("bound"))), F.lit(1), F.col("k")))
    every = near.groupBy("cls").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.any_value("k").alias("k"))
    return every.select("cls", F.slice(F.array_sort("ids"), F.lit(1), F.col("k")).alias("ids"))


def candidate_counts(probe: DataFrame, records: DataFrame, strategy: str = "name", **options) -> DataFrame:
    """``(entity_id, n, first, last)`` of ``candidates_of`` the index of ``records``, counted by classes."""
    sides = _classes(_names(probe), _names(records), lambda classes: _keyed(classes, strategy, **options))
    return _counted(sides).select(F.col("id").alias("entity_id"), "n", "first", "last")


def candidates_of(probe: DataFrame, index: DataFrame, strategy: str = "name", **options) -> DataFrame:
    """``(entity_id, candidate_id)``: records of ``index`` that share a key with a probe record, itself excepted."""
    items = index.select(F.col("entity_id").alias("id"), F.struct("block_key").alias("item"))
    met = _paired(_classes(_names(probe), items, lambda classes: _keyed(classes, strategy, **options), lambda classes: classes.withColumn("tier", F.lit(1))))
    return met.select(F.col("id").alias("entity_id"), F.explode("ids").alias("candidate_id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def candidate_pairs(records: DataFrame, *, use_country: bool = True, use_exact_name: bool = True, use_prefix: bool = False, prefix_len: int = PREFIX_LEN, use_tokens: bool = False, min_token_len: int = TOKEN_LEN) -> DataFrame:
    """Distinct unordered pairs ``id_a < id_b`` that any chosen strategy proposes (within a country, if it counts)."""
    tagged = _tagged(records, use_exact_name, use_prefix, prefix_len, use_tokens, min_token_len)
    if tagged is None:
        return records.select(F.col("entity_id").alias("id_a"), F.col("entity_id").alias("id_b")).where(F.lit(False))
    on = ["tag", "block_key", *(["country_norm"] if use_country else [])]
    left, right = tagged.select(*on, F.col("entity_id").alias("a")), tagged.select(*on, F.col("entity_id").alias("b"))
    return _ordered(left.join(right, on).where("a < b"))


def _tagged(records: DataFrame, use_exact_name: bool, use_prefix: bool, prefix_len: int, use_tokens: bool, min_token_len: int) -> DataFrame | None:
    """The index entries of all chosen strategies as one table with ``tag``: one self-join serves them all."""
    chosen: list[tuple[str, dict]] = []
    if use_exact_name:
        chosen.append(("name", {}))
    if use_prefix:
        chosen.append(("prefix", {"prefix_len": prefix_len}))
    if use_tokens:
        chosen.append(("tokens", {"min_token_len": min_token_len}))
    tagged = None
    for name, options in chosen:
        part = block_index(records, name, **options).withColumn("tag", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def candidate_pair_counts(records: DataFrame, *, use_country: bool = True, use_exact_name: bool = True, use_prefix: bool = False, prefix_len: int = PREFIX_LEN, use_tokens: bool = False, min_token_len: int = TOKEN_LEN) -> DataFrame:
    """``(id_a, n, first)`` of ``candidate_pairs``: the ids after each id that it meets and the first of them.

    Classes that meet the same classes share one sorted list of all they meet.
    """
    members, classes = _members(_names(records))
    keys = _tagged(classes.withColumn("entity_id", F.col("cls")), use_exact_name, use_prefix, prefix_len, use_tokens, min_token_len)
    if keys is None:
        return members.select(F.col("id").alias("id_a"), F.lit(0).cast("long").alias("n"), F.col("id").alias("first")).where(F.lit(False))
    keys = keys.where("country_norm IS NOT NULL") if use_country else keys.drop("country_norm")
    keys = written(keys.withColumnsRenamed({"entity_id": "cls"}).withColumns({"own": F.lit(None).cast("string"), "tier": F.lit(1)}), "keys")
    links = written(_linked(keys, keys), "links")  # every class with a key meets itself
    around = links.groupBy("a").agg(F.md5(F.to_json(F.array_sort(F.collect_set("b")))).alias("list"))
    around = written(around, "neighbours")
    lists = written(links.join(around, "a").select("list", F.col("b").alias("cls")).distinct(), "lists")
    own = around.select("list", F.col("a").alias("cls"), F.lit(True).alias("mine"))
    each = lists.join(own, ["list", "cls"], "left").select("list", "cls", F.coalesce("mine", F.lit(False)).alias("mine"))
    ahead = Window.partitionBy("list").orderBy(F.desc("id"))
    ranked = members.join(each, "cls").select("list", "id", "mine", (F.row_number().over(ahead) - 1).cast("long").alias("n"), F.lag("id").over(ahead).alias("first"))
    return ranked.where("mine AND n > 0").select(F.col("id").alias("id_a"), "n", "first")


def pairs_in_blocks(index: DataFrame) -> DataFrame:
    """Every pair inside each block, once a block: ``(block_key, id_a, id_b)``."""
    one = index.select("block_key", "entity_id").distinct()
    return one.select("block_key", F.col("entity_id").alias("id_a")).join(one.select("block_key", F.col("entity_id").alias("id_b")), "block_key").where("id_a < id_b")


def country_volume(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one country, counted without making them: ``(country_norm, n_left, n_right, n_pairs)``."""
    count = lambda df, out: df.where("country_norm IS NOT NULL").groupBy("country_norm").agg(F.count(F.lit(1)).alias(out))
    return count(left, "n_left").join(count(right, "n_right"), "country_norm").withColumn("n_pairs", F.col("n_left") * F.col("n_right"))


def estimate_pairs(n: Column) -> Column:
    """Pairs among n records."""
    return (n * (n - 1) / 2).cast("long")


def reduction_ratio(n: Column, pairs: Column) -> Column:
    """Share of all pairs among n records that blocking avoids; 1 if there are none."""
    every = estimate_pairs(n)
    return F.when(every == 0, 1.0).otherwise(1.0 - F.least(pairs, every) / every)


def tier_pairs(s1: DataFrame, secondary: DataFrame, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None, tiers: Iterable[int] = (1, 2)) -> DataFrame:
    """``(s1_id, secondary_id, tier)`` of tiers 1 (same name) and 2 (shared prefix or token), within a country.

    Only keys of the wanted ``tiers`` are joined: tier 1 alone is an equality join on names. (A pair of tier 1 counts
    as tier 2 where only that is asked for.) Tier 3, the rest of the country, is never made here: ``pairs.top_up`` draws from it what is needed.
    """
    met = _paired(tier_classes(s1, secondary, prefix_len, min_token_len, stopwords, tiers))
    return met.select(F.col("id").alias("s1_id"), F.explode("ids").alias("secondary_id"), "tier")


def labelled_lists(s1: DataFrame, secondary: DataFrame, matches: DataFrame, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None, tiers: Iterable[int] = (1, 2), carried: DataFrame | None = None) -> DataFrame:
    """``(s1_id, tier, is_match, ids)``: ``tier_pairs`` in lists of secondary ids that are matches, or are not.
    ``matches``: (s1_id, matches), see ``ground_truth.listed``; ``carried``: further columns by ``s1_id``."""
    members, lists = labelled_classes(s1, secondary, matches, prefix_len, min_token_len, stopwords, tiers)
    members = members if carried is None else members.join(carried, "s1_id", "left")
    return members.join(lists.hint("merge"), "list").drop("list")


def labelled_classes(s1: DataFrame, secondary: DataFrame, matches: DataFrame, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None, tiers: Iterable[int] = (1, 2)) -> tuple[DataFrame, DataFrame]:
    """The same apart: ``(s1_id, list)`` and ``(list, tier, is_match, ids)``; a list of many records is there once."""
    members, lists = _labelled(tier_classes(s1, secondary, prefix_len, min_token_len, stopwords, tiers), matches.withColumnRenamed("s1_id", "id"))
    return members.withColumnsRenamed({"id": "s1_id", "sub": "list"}), lists.withColumnRenamed("sub", "list")


def tier_counts(s1: DataFrame, secondary: DataFrame, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None, tiers: Iterable[int] = (1, 2)) -> DataFrame:
    """``(s1_id, tier, n, first)`` of ``tier_pairs``, counted by classes."""
    return _counted(tier_classes(s1, secondary, prefix_len, min_token_len, stopwords, tiers)).select(F.col("id").alias("s1_id"), "tier", "n", "first")


def tier_classes(s1: DataFrame, secondary: DataFrame, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None, tiers: Iterable[int] = (1, 2)) -> Sides:
    """Members ``(id, cls)`` of both sides and ``(a, b, tier)``, the classes that meet by the least tier."""
    keys = [k for k in (("name", name_key(), 1), ("prefix", prefix_key(prefix_len), 2), ("token", token_keys(min_token_len, stopwords), 2)) if k[2] in set(tiers)]

    def entries(name: str, key: Column, tier: int) -> Column:
        return F.transform(F.coalesce(key, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("tag"), x.alias("key"), F.lit(tier).alias("tier")))

    each = F.flatten(F.array(*[entries(*k) for k in keys]))
    return _classes(_names(s1), _names(secondary), lambda classes: classes.where("country_norm IS NOT NULL").select("cls", "own", "country_norm", F.inline(each)))
