"""Labelled pairs: positives from the ground truth, negatives by tier, a fixed number for each S1 record and source.

Random choices are keyed hashes (md5 of seed and ids), so they are the same on every run and any number of executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.draws import drawn
from ..functions.text import is_missing
from ..sources.scratch import small, written
from .blocking import MEMBERS, PREFIX_LEN, TOKEN_LEN, Sides, first_ids, tier_classes, tier_pairs
from .ground_truth import Grouped, grouped

# Fixed value: hashes that a task makes in one go, about.
DRAWS = 10_000_000
# How hard a pair is, by tier; positives have a word of their own.
DIFFICULTY = {0: "positive", 1: "hard_exact_name", 2: "hard_similar_name", 3: "easy_same_country"}


def parse_ratio(ratio: float | int | str) -> float:
    """Negatives for each positive: a positive number, or ``"p:n"`` for n/p."""
    if isinstance(ratio, str) and ":" in ratio:
        parts = ratio.split(":")
        try:
            if len(parts) == 2 and float(parts[0]) > 0 and float(parts[1]) >= 0:
                return float(parts[1]) / float(parts[0])
        except ValueError:
            pass
        raise ValueError(f"not a ratio: {ratio!r}")
    try:
        value = float(ratio)
    except (TypeError, ValueError):
        raise ValueError(f"not a ratio: {ratio!r}") from None
    if value <= 0:
        raise ValueError(f"not a positive ratio: {ratio!r}")
    return value


def keyed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def one_record_each(records: DataFrame) -> DataFrame:
    """One record for each id (ids are unique in clean data)."""
    return records.dropDuplicates(["entity_id"])


def positives(s1: DataFrame, secondary: DataFrame, edges: DataFrame | Grouped, source: str) -> DataFrame:
    """``(s1_id, secondary_id)``: matches of the source whose both records exist."""
    mine, others = s1.select(F.col("entity_id").alias("s1_id")), secondary.select(F.col("entity_id").alias("secondary_id"))
    if isinstance(edges, Grouped):  # a pair is in one group: records are looked up before there are pairs
        matches = edges.matches.where(F.col("source") == source).select("grp", "secondary_id").distinct().join(others, "secondary_id", "left_semi")
        sizes = matches.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("n_lists"))
        dealt = matches.join(sizes, "grp").groupBy("grp", F.pmod(F.xxhash64("secondary_id"), "n_lists").alias("list"))
        lists = written(dealt.agg(F.collect_list("secondary_id").alias("ids")), "matches")
        return edges.owners.join(mine, "s1_id", "left_semi").join(lists.hint("merge"), "grp").select("s1_id", F.explode("ids").alias("secondary_id"))
    of = edges.where(F.col("source") == source).select("s1_id", "secondary_id").distinct()
    return of.join(mine, "s1_id", "left_semi").join(others, "secondary_id", "left_semi").select("s1_id", "secondary_id")


def skipped(s1: DataFrame, secondary: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """Matches of the source that no secondary record has."""
    of = edges.where(F.col("source") == source).join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    return of.join(secondary.select(F.col("entity_id").alias("secondary_id")), "secondary_id", "left_anti")


def wanted_negatives(s1: DataFrame, positives_: DataFrame, ratio: float, singletons: bool = True) -> DataFrame:
    """``(s1_id, country_norm, target)``: at least one for a record with positives, one or none for a singleton.
    ``positives_``: pairs, or their number by record as ``positive_counts`` has it."""
    n = positives_ if "n" in positives_.columns else positives_.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    return _targets(s1, n, ratio, singletons)


def _targets(s1: DataFrame, n: DataFrame, ratio: float, singletons: bool) -> DataFrame:
    target = F.when(F.col("n").isNull(), F.lit(1 if singletons else 0)).otherwise(F.greatest(F.lit(1), F.bround(F.col("n") * ratio).cast("int")))
    return s1.select(F.col("entity_id").alias("s1_id"), "country_norm").join(n, "s1_id", "left").select("s1_id", "country_norm", target.alias("target"))


def positive_counts(s1: DataFrame, secondary: DataFrame, edges: Grouped, source: str) -> DataFrame:
    """``(s1_id, n)`` of ``positives``, counted by groups."""
    of = edges.matches.where(F.col("source") == source).join(secondary.select(F.col("entity_id").alias("secondary_id")), "secondary_id", "left_semi")
    n = of.groupBy("grp").agg(F.countDistinct("secondary_id").alias("n"))
    return s1.select(F.col("entity_id").alias("s1_id")).distinct().join(edges.owners, "s1_id").join(n, "grp").select("s1_id", "n")


class Cells(NamedTuple):
    """S1 records by class, matches, country and wanted negatives: all of a cell have the same choice."""

    members: DataFrame  # (s1_id, cell)
    cells: DataFrame  # (cell, cls, grp, country_norm, target, records)
    sides: Sides
    true: DataFrame  # (grp, cls, secondary_id): matches among the secondary records


def _cells(s1: DataFrame, secondary: DataFrame, wanted: DataFrame, matches: Grouped, options: tuple) -> Cells:
    sides = tier_classes(s1, secondary, *options)
    each = sides[0].select(F.col("id").alias("s1_id"), "cls").join(wanted.where("target > 0"), "s1_id").join(matches.owners, "s1_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = written(each.withColumn("cell", F.md5(F.concat_ws(":", *[text(c) for c in ("cls", "grp", "target", "country_norm")]))), "cells")
    same = lambda c: F.any_value(c).alias(c)
    cells = each.groupBy("cell").agg(same("cls"), same("grp"), same("country_norm"), same("target"), F.count(F.lit(1)).alias("records"))
    true = matches.matches.select("grp", F.col("secondary_id").alias("id")).distinct().join(sides[1], "id").select("grp", "cls", F.col("id").alias("secondary_id"))
    return Cells(each.select("s1_id", "cell"), written(cells, "cells"), sides, written(true, "true"))


def _counted(c: Cells, secondary: DataFrame) -> DataFrame:
    """The cells with ``n_1``, ``n_2`` and ``n_3``, the negatives of each record by tier, counted by classes."""
    _, rm, links = c.sides
    sizes = rm.groupBy(F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    met = links.join(sizes, "b").groupBy(F.col("a").alias("cls")).pivot("tier", [1, 2]).agg(F.sum("n")).withColumnsRenamed({"1": "met_1", "2": "met_2"})
    held = c.true.groupBy("grp", F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    held = c.cells.select("cls", "grp").distinct().join(held, "grp").join(links.withColumnRenamed("a", "cls"), ["cls", "b"])
    held = held.groupBy("cls", "grp").pivot("tier", [1, 2]).agg(F.sum("n")).withColumnsRenamed({"1": "true_1", "2": "true_2"})
    ids = secondary.where("country_norm IS NOT NULL").select(F.col("entity_id").alias("secondary_id"), "country_norm").distinct()
    around = ids.groupBy("country_norm").agg(F.count(F.lit(1)).alias("around"))
    inside = c.true.select("grp", "secondary_id").join(ids, "secondary_id").groupBy("grp", "country_norm").agg(F.count(F.lit(1)).alias("inside"))
    # A record that is on both sides, and no match of itself, is none of its negatives; it has a cell of its own.
    both = c.members.join(ids.withColumnRenamed("secondary_id", "s1_id"), "s1_id").join(c.cells.select("cell", "grp", F.col("country_norm").alias("own")), "cell").where("own = country_norm")
    itself = both.join(c.true.select("grp", F.col("secondary_id").alias("s1_id")), ["grp", "s1_id"], "left_anti").groupBy("cell").agg(F.count(F.lit(1)).alias("itself"))
    out = c.cells.join(met, "cls", "left").join(held, ["cls", "grp"], "left").join(around, "country_norm", "left").join(inside, ["grp", "country_norm"], "left").join(itself, "cell", "left")
    out = out.fillna(0, ["met_1", "met_2", "true_1", "true_2", "around", "inside", "itself"])
    out = out.withColumn("n_1", F.least(F.col("target"), F.col("met_1") - F.col("true_1")))
    out = out.withColumn("n_2", F.least(F.col("target") - F.col("n_1"), F.col("met_2") - F.col("true_2")))
    rest = F.expr("around - inside - itself - (met_1 - true_1) - (met_2 - true_2)")
    out = out.withColumn("n_3", F.greatest(F.lit(0), F.least(F.col("target") - F.col("n_1") - F.col("n_2"), rest)))
    free = [F.expr(f"met_{t} - true_{t}").alias(f"free_{t}") for t in (1, 2)]
    return out.select(*c.cells.columns, "n_1", "n_2", "n_3", *free)


def negative_counts(s1: DataFrame, secondary: DataFrame, edges: DataFrame | Grouped, source: str, ratio: float = 2.0, singletons: bool = True, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``negatives``, without the pairs: ``(s1_id, cell)`` and ``(cell, records, target, n_1, n_2, n_3)``, a record's
    negatives by tier. Ids are unique in ``secondary``."""
    edges, s1 = grouped(edges), one_record_each(s1)
    wanted = _targets(s1, positive_counts(s1, secondary, edges, source), ratio, singletons)
    c = _cells(s1, secondary, wanted, edges, (prefix_len, min_token_len, stopwords))
    return c.members, _counted(c, secondary)


def _first_by_id(c: Cells) -> tuple[DataFrame, DataFrame]:
    """``(cell, tier, ids)``, the negatives of tiers 1 and 2 in the order of ids, and ``(cell, lacking)``, what is left."""
    none = F.array().cast("array<string>")
    held = c.true.groupBy("grp").agg(F.collect_list("secondary_id").alias("held"))
    lacking, found = c.cells.select("cell", "cls", "grp", F.col("target").alias("lacking")), None
    for tier in (1, 2):
        open_ = lacking.join(held, "grp", "left").withColumn("held", F.coalesce("held", none))
        ids = first_ids(c.sides, open_.groupBy("cls").agg(F.max(F.col("lacking") + F.size("held")).alias("k")), tier)
        taken = F.slice(F.array_except("ids", "held"), F.lit(1), F.col("lacking")).alias("ids")
        got = written(open_.join(ids, "cls").select("cell", F.lit(tier).alias("tier"), taken).where(F.size("ids") > 0), "negatives")
        found = got if found is None else found.unionByName(got)
        have = got.select("cell", F.size("ids").alias("have"))
        lacking = written(lacking.join(have, "cell", "left").select("cell", "cls", "grp", (F.col("lacking") - F.coalesce("have", F.lit(0))).alias("lacking")).where("lacking > 0"), "short")
    return found, lacking.select("cell", "lacking")


def _by_id(s1: DataFrame, secondary: DataFrame, wanted: DataFrame, matches: Grouped, options: tuple) -> DataFrame:
    """``negatives`` in the order of ids: each cell's lists are made once and given to its records."""
    c = _cells(s1, secondary, wanted, matches, options)
    lists, lacking = _first_by_id(c)
    made = c.members.join(lists.hint("merge"), "cell").select("s1_id", F.explode("ids").alias("secondary_id"), "tier")
    short = c.members.join(lacking.join(c.cells.select("cell", "grp", "country_norm"), "cell"), "cell").where("country_norm IS NOT NULL")
    short = written(short, "short")
    if short.isEmpty():
        return made
    # Whoever is still short has taken all of its near pairs.
    near = short.select("s1_id", "cell").join(lists, "cell").select("s1_id", F.explode("ids").alias("secondary_id"))
    excluded = near.unionByName(short.select("s1_id", "grp").join(c.true, "grp").select("s1_id", "secondary_id"))
    more = top_up(short.select("s1_id", "country_norm", "lacking"), secondary, excluded, 0)
    return made.unionByName(more.withColumn("tier", F.lit(3)))


def _address(records: DataFrame, key: str) -> DataFrame:
    """``(key, at)``: the address, null if it is missing."""
    return records.select(F.col("entity_id").alias(key), F.when(~is_missing("business_address"), F.coalesce("addr_norm", F.lit(""))).alias("at"))


def _usable(c: Cells, open_: DataFrame, items: DataFrame, tier: int) -> DataFrame:
    """``(cell, items)``: what the cells may take in a tier, in lists of about ``MEMBERS``. ``items``: (cls, id, at)."""
    _, _, links = c.sides
    held = c.true.groupBy("grp", F.col("cls").alias("b")).agg(F.collect_list("secondary_id").alias("held"))
    sizes = items.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("n_lists"))
    dealt = items.join(sizes, "cls").groupBy(F.col("cls").alias("b"), F.pmod(F.xxhash64("id"), "n_lists").alias("list"))
    lists = written(dealt.agg(F.collect_list(F.struct("id", "at")).alias("items")), "lists")
    met = open_.join(links.where(F.col("tier") == tier).select(F.col("a").alias("cls"), "b"), "cls").join(held, ["grp", "b"], "left").join(lists, "b")
    free = F.filter("items", lambda x: ~F.array_contains("held", x["id"]))
    return met.select("cell", F.when(F.col("held").isNull(), F.col("items")).otherwise(free).alias("items")).where(F.size("items") > 0)


def _drawn(c: Cells, counted: DataFrame, items: DataFrame, own: DataFrame, tier: int, seed: int) -> DataFrame:
    """``(s1_id, ids)``: each record's draw from what its cell may take in a tier. Records of a cell meet its items in one
    place, in blocks of about ``DRAWS`` hashes. ``own``: (s1_id, at)."""
    open_ = counted.where(f"n_{tier} > 0").select("cell", "cls", "grp", F.col(f"n_{tier}").cast("long").alias("k"), F.ceil(F.col("records") * F.col(f"free_{tier}") / DRAWS).cast("int").alias("blocks"))
    near = _usable(c, open_, items, tier).join(open_.select("cell", "blocks"), "cell")
    near = near.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("items.id").alias("ids"), F.col("items.at").alias("ats"))
    asks = c.members.join(open_, "cell").join(own, "s1_id").select("s1_id", "cell", F.pmod(F.xxhash64("s1_id"), "blocks").cast("int").alias("block"), "k", F.col("at").alias("own"))

    def draw(records: pa.Table, lists: pa.Table) -> pa.Table:
        flat = lambda name: pc.list_flatten(lists.column(name).combine_chunks())
        ids = records.column("s1_id").combine_chunks()
        if not len(ids) or not lists.num_rows:
            return pa.table({"s1_id": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.string()))})
        among = flat("ids")
        places = drawn(seed, ids.to_pylist(), records.column("k").to_pylist(), records.column("own").to_pylist(), among.to_pylist(), flat("ats"))
        ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
        return pa.table({"s1_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), among.take(pa.array(np.concatenate(places))))})

    return written(asks.groupBy("cell", "block").cogroup(near.groupBy("cell", "block")).applyInArrow(draw, "s1_id string, ids array<string>"), "drawn")


def _by_draw(s1: DataFrame, secondary: DataFrame, wanted: DataFrame, matches: Grouped, options: tuple, seed: int) -> DataFrame:
    """``negatives`` in the order of a keyed hash of both ids. Lists are those of cells; hashes are made for records."""
    c = _cells(s1, secondary, wanted, matches, options)
    counted = written(_counted(c, one_record_each(secondary)), "counted")
    items = written(c.sides[1].join(_address(one_record_each(secondary), "id"), "id"), "addresses")
    own, none = written(_address(s1, "s1_id"), "addresses"), F.lit(None).cast("string")
    first = _drawn(c, counted, items.withColumn("at", none), own.withColumn("at", none), 1, seed).withColumn("tier", F.lit(1))
    lists = first.unionByName(_drawn(c, counted, items, own, 2, seed).withColumn("tier", F.lit(2)))
    made = lists.select("s1_id", F.explode("ids").alias("secondary_id"), "tier")

    short = counted.where("n_1 + n_2 < target AND country_norm IS NOT NULL").select("cell", "grp", "country_norm", (F.col("target") - F.col("n_1") - F.col("n_2")).alias("lacking"))
    short = written(c.members.join(short, "cell"), "short")
    if short.isEmpty():
        return made
    taken = made.join(short.select("s1_id"), "s1_id", "left_semi").select("s1_id", "secondary_id")
    excluded = taken.unionByName(short.select("s1_id", "grp").join(c.true, "grp").select("s1_id", "secondary_id"))
    more = top_up(short.select("s1_id", "country_norm", "lacking"), secondary, written(excluded, "excluded"), seed)
    return made.unionByName(more.withColumn("tier", F.lit(3)))


def top_up(short: DataFrame, secondary: DataFrame, excluded: DataFrame, seed: int) -> DataFrame:
    """Tier 3 for records that are short of negatives, without a join of whole countries.

    The records of a country are numbered by a keyed hash. A record that lacks k starts at a hashed number and takes
    the k following ones that it may take: it looks at k plus as many as it excludes, so k always suffice. ``short``:
    (s1_id, country_norm, lacking); ``excluded``: (s1_id, secondary_id).
    """
    # Numbering is two-level: a country may hold most records, so ranks are taken in hashed parts and then offset.
    parts = secondary.where("country_norm IS NOT NULL").select("country_norm", F.col("entity_id").alias("secondary_id"), F.md5("entity_id").alias("h"))
    parts = parts.withColumn("part", F.substring("h", 1, 2))
    sizes = parts.groupBy("country_norm", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("country_norm").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("country_norm")
    sizes = sizes.select("country_norm", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.sum("n").over(every).alias("size"))
    inside = Window.partitionBy("country_norm", "part").orderBy("h", "secondary_id")
    ranked = parts.withColumn("rank", F.row_number().over(inside) - 1).join(small(sizes), ["country_norm", "part"]).select("country_norm", "secondary_id", (F.col("rank") + F.col("base")).alias("r"))
    slack = excluded.groupBy("s1_id").agg(F.count(F.lit(1)).alias("slack"))
    asks = short.join(small(sizes.select("country_norm", "size").distinct()), "country_norm").join(slack, "s1_id", "left")
    look = F.least(F.col("size"), F.col("lacking") + F.coalesce("slack", F.lit(0)) + 1)  # one more: the record itself may be met
    asks = asks.withColumn("start", F.pmod(F.conv(F.substring(keyed(seed, "s1_id"), 1, 15), 16, 10).cast("long"), F.col("size")))
    asks = asks.select("s1_id", "country_norm", "lacking", "start", "size", F.explode(F.sequence(F.lit(0).cast("long"), look - 1)).alias("j"))
    asks = asks.select("s1_id", "country_norm", "lacking", "j", ((F.col("start") + F.col("j")) % F.col("size")).alias("r"))
    met = asks.join(ranked, ["country_norm", "r"]).where("secondary_id <> s1_id").join(excluded, ["s1_id", "secondary_id"], "left_anti")
    order = Window.partitionBy("s1_id").orderBy("j")
    return met.withColumn("n", F.row_number().over(order)).where("n <= lacking").select("s1_id", "secondary_id")


def negatives(s1: DataFrame, secondary: DataFrame, positives_: DataFrame, matches: DataFrame | Grouped, ratio: float = 2.0, seed: int | None = 42, singletons: bool = True, prefix_len: int = PREFIX_LEN, min_token_len: int = TOKEN_LEN, stopwords: Iterable[str] | None = None) -> DataFrame:
    """``(s1_id, secondary_id, tier)``: the first ``target`` of each record by tier; in tier 2 pairs whose addresses are
    both there and differ come first. With no seed the order inside a tier is by id. ``matches``: all true pairs."""
    options = (prefix_len, min_token_len, stopwords)
    if seed is None:
        s1 = one_record_each(s1)
        return _by_id(s1, secondary, wanted_negatives(s1, positives_, ratio, singletons), grouped(matches), options)
    s1 = one_record_each(s1)
    return _by_draw(s1, secondary, wanted_negatives(s1, positives_, ratio, singletons), grouped(matches), options, seed)


def negatives_exact(s1: DataFrame, secondary: DataFrame, positives_: DataFrame, matches: DataFrame, ratio: float = 2.0, singletons: bool = True) -> DataFrame:
    """The id-ordered choice with tier 3 spelled out as a join on the country. For small inputs and tests only."""
    wanted = wanted_negatives(s1, positives_, ratio, singletons).where("target > 0")
    country = s1.select(F.col("entity_id").alias("s1_id"), "country_norm").join(secondary.select(F.col("entity_id").alias("secondary_id"), "country_norm"), "country_norm").where("s1_id <> secondary_id")
    every = country.join(tier_pairs(s1, secondary), ["s1_id", "secondary_id"], "left").withColumn("tier", F.coalesce("tier", F.lit(3)))
    usable = every.join(matches.select("s1_id", "secondary_id").distinct(), ["s1_id", "secondary_id"], "left_anti").join(wanted.select("s1_id", "target"), "s1_id")
    order = Window.partitionBy("s1_id").orderBy("tier", "secondary_id")
    return usable.withColumn("n", F.row_number().over(order)).where("n <= target").select("s1_id", "secondary_id", "tier")


def labelled_pairs(s1: DataFrame, sources: dict[str, DataFrame], edges: DataFrame, ratio: float | str = 2.0, seed: int | None = 42, singletons: bool = True) -> DataFrame:
    """``(s1_id, secondary_id, source, label, difficulty)`` over all secondary sources (normalised records)."""
    value, out, edges = parse_ratio(ratio), None, grouped(edges)
    names = F.create_map(*[x for k, v in DIFFICULTY.items() for x in (F.lit(k), F.lit(v))])
    for source, secondary in sources.items():
        unique = one_record_each(secondary)
        yes = positives(s1, unique, edges, source)
        no = negatives(s1, unique, positive_counts(s1, unique, edges, source), edges, value, seed, singletons)
        both = yes.withColumn("tier", F.lit(0)).unionByName(no)
        part = both.select("s1_id", "secondary_id", F.lit(source).alias("source"), (F.col("tier") == 0).cast("int").alias("label"), F.element_at(names, F.col("tier")).alias("difficulty"))
        out = part if out is None else out.unionByName(part)
    return out


def labelled_counts(s1: DataFrame, sources: dict[str, DataFrame], edges: DataFrame | Grouped, ratio: float | str = 2.0, singletons: bool = True) -> DataFrame:
    """``pair_stats`` of ``labelled_pairs``, counted by classes of records without the pairs."""
    value, edges, found = parse_ratio(ratio), grouped(edges), None
    for source, secondary in sources.items():
        unique = one_record_each(secondary)
        yes = positive_counts(s1, unique, edges, source).agg(F.sum("n").alias("n")).select(F.lit(source).alias("source"), F.lit(0).alias("tier"), "n")
        _, cells = negative_counts(s1, unique, edges, source, value, singletons)
        no = cells.agg(*[F.sum(F.col("records") * F.col(f"n_{t}")).alias(f"n_{t}") for t in (1, 2, 3)]).select(F.lit(source).alias("source"), F.stack(F.lit(3), *[x for t in (1, 2, 3) for x in (F.lit(t), F.col(f"n_{t}"))]).alias("tier", "n"))
        part = yes.unionByName(no)
        found = part if found is None else found.unionByName(part)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    return _totals(found, lambda source, tier: n((F.col("tier") == tier) & (F.lit(True) if source is None else F.col("source") == source)))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """One row of totals by source and difficulty and the ratio of negatives to positives (0 without positives)."""
    label, kind = F.col("label"), F.col("difficulty")
    return _totals(pairs, lambda source, tier: F.count_if(((label == 1) & (F.col("source") == source)) if source else kind == DIFFICULTY[tier]))


def _totals(rows: DataFrame, n: Callable[[str | None, int], Column]) -> DataFrame:
    out = rows.agg(
        n("S2", 0).alias("s2_positives"), n("S3", 0).alias("s3_positives"),
        n(None, 1).alias("exact_name_negatives"), n(None, 2).alias("similar_name_negatives"), n(None, 3).alias("same_country_negatives"),
    )
    out = out.withColumns({"total_positives": F.col("s2_positives") + F.col("s3_positives"), "total_hard_negatives": F.col("exact_name_negatives") + F.col("similar_name_negatives"), "total_easy_negatives": F.col("same_country_negatives")})
    out = out.withColumn("total_negatives", F.col("total_hard_negatives") + F.col("total_easy_negatives"))
    return out.withColumn("negative_ratio", F.when(F.col("total_positives") > 0, F.bround(F.col("total_negatives") / F.col("total_positives"), 4)).otherwise(0.0))


def true_match_sample(edges: DataFrame, k: int = 5000, seed: int = 42) -> DataFrame:
    """A uniform sample of k edges, the same on every run."""
    return edges.select("s1_id", "source", "secondary_id").orderBy(keyed(seed, "s1_id", "secondary_id"), "s1_id", "secondary_id").limit(k)


def prefiltered(s1: DataFrame, secondary: DataFrame, edges: DataFrame, prefix_len: int = PREFIX_LEN, per_prefix: int = 5, per_country: int = 15_000, order: str = "entity_id") -> DataFrame:
    """Secondary records worth keeping for a pilot: true matches; in the countries of ``s1``, those with a name of
    ``s1``, the first few of each prefix of ``s1`` and, of all others, the first many of each country."""
    rec = one_record_each(secondary)
    flag = lambda df, key, keys, out: df.join(keys.distinct().withColumn(out, F.lit(True)), key, "left").withColumn(out, F.coalesce(out, F.lit(False)))
    df = rec.withColumn("_prefix", F.when(F.length("name_norm") >= prefix_len, F.substring("name_norm", 1, prefix_len)))
    df = flag(df, "entity_id", edges.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.col("secondary_id").alias("entity_id")), "_true")
    df = flag(df, "country_norm", s1.where("country_norm IS NOT NULL").select("country_norm"), "_country")
    df = flag(df, "name_norm", s1.where("name_norm IS NOT NULL").select("name_norm"), "_name")
    df = flag(df, "_prefix", s1.where(F.length("name_norm") >= prefix_len).select(F.substring("name_norm", 1, prefix_len).alias("_prefix")), "_shared")
    open_ = ~F.col("_true") & F.col("_country") & ~F.col("_name")
    by_prefix = Window.partitionBy("_prefix", open_ & F.col("_shared")).orderBy(order)
    df = df.withColumn("_by_prefix", open_ & F.col("_shared") & (F.row_number().over(by_prefix) <= per_prefix))
    rest = open_ & ~F.col("_by_prefix")
    by_country = Window.partitionBy("country_norm", rest).orderBy(order)
    df = df.withColumn("_by_country", rest & (F.row_number().over(by_country) <= per_country))
    why = F.when(F.col("_true"), "match").when(~F.col("_country"), None).when(F.col("_name"), "name").when(F.col("_by_prefix"), "prefix").when(F.col("_by_country"), "country")
    return df.withColumn("kept_as", why).where("kept_as IS NOT NULL").select(*secondary.columns, "kept_as")
