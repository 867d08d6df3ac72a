"""Secret scan over a trigram inverted index.

Each rule's regex is turned into a Boolean query over lower-case trigrams: a disjunction of trigram sets, each
of which must be wholly present in a text that can match. The index holds (trigram, doc_id) postings; queries
intersect them, and only the candidates are verified with the regex. A rule without mandatory trigrams (a run
of hex digits, say) is matched against every text.

Cases: a null text is empty and has no spans; a null doc_id is indexed like any other; rows that share a doc_id
share their postings (a superset), and each row is verified on its own text; an empty table gives an empty
result; columns that the operator doesn't use are ignored. Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, written

#: Choices and repetitions beyond this many strings count as unknown text.
MOST_STRINGS = 64
#: Code points of a text that are cut at a time.
PART = 4096


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  #: code points that the group must have; shorter matches are dropped


#: The three base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{30,}"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Trigram sets one of which every match must contain (lower case); None if the regex has no such sets."""
    parser = re._parser

    def conjoin(a, b):
        if a is None or b is None:
            return b if a is None else a
        return [x | y for x in a for y in b] if len(a) * len(b) <= MOST_STRINGS else a

    def of_strings(strings):
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        return sets if all(sets) else None

    def members(items) -> set[str] | None:
        out: set[str] = set()
        for op, arg in items:
            if op is parser.LITERAL:
                out.add(chr(arg).lower())
            elif op is parser.RANGE and arg[1] - arg[0] < 8:
                out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None

    def walk(nodes):
        """(strings, query): all strings the nodes can match if known, else None, and what they demand."""
        run, query, whole = {""}, None, True

        def flush(part):
            nonlocal run, query, whole
            query = conjoin(query, of_strings(run))
            query, run, whole = conjoin(query, part), {""}, False

        for op, arg in nodes:
            if op is parser.LITERAL:
                known, part = {chr(arg).lower()}, None
            elif op is parser.IN:
                known, part = members(arg), None
            elif op is parser.SUBPATTERN:
                known, part = walk(arg[-1])
            elif op is parser.BRANCH:
                each = [walk(x) for x in arg[1]]
                known = set().union(*[k for k, _ in each]) if all(k is not None for k, _ in each) else None
                demands = [of_strings(k) if k is not None else q for k, q in each]
                part = None if any(d is None for d in demands) else [x for d in demands for x in d]
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                low, high, inner = arg
                once, part = walk(inner)
                known = {""} | once if once is not None and (low, high) == (0, 1) else None
                if low == 0:
                    part = None
                elif once is not None and known is None:
                    part = of_strings({"".join(x) for x in product(once, repeat=min(low, 3))}) if len(once) ** min(low, 3) <= MOST_STRINGS else None
            else:
                known, part = None, None
            if known is not None and len(run) * len(known) <= MOST_STRINGS:
                run = {a + b for a in run for b in known}
            else:
                flush(part)
        if whole:
            return run, of_strings(run)
        return None, conjoin(query, of_strings(run))

    return walk(parser.parse(pattern))[1]


def build_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings ``(trigram, doc_id)`` of the given lower-case trigrams, written to the shared folder."""
    known = F.array(*[F.lit(t) for t in sorted(vocabulary)])
    found = let(F.lower(F.coalesce(F.col("text"), F.lit(""))), lambda x: F.filter(known, lambda t: F.contains(x, t)))
    return written(docs.select(F.explode(found).alias("trigram"), "doc_id"), "trigram-postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, kinds)``: the rules whose trigram query the postings of a document satisfy."""
    spark = index.sparkSession
    rows = [(rule.kind, i, t, len(clause)) for rule in rules for i, clause in enumerate(trigram_query(rule.pattern) or []) for t in sorted(clause)]
    queries = spark.createDataFrame(rows, "kind string, clause int, trigram string, need int")  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(queries), "trigram").groupBy("doc_id", "kind", "clause", "need").agg(F.countDistinct("trigram").alias("n"))
    return met.where("n = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Sorted structs (start, place, end) of one rule: gaps and matches alternate, running totals of their lengths are the ends."""
    kind = "array<struct<start:int,place:int,end:int>>"
    group = lambda g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))

    def located(m: Column) -> Column:
        long_enough = F.transform(group(rule.group) if rule.group else m, lambda g: F.length(g) >= rule.least)
        steps = let(F.split(text, rule.pattern), lambda gaps: F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i))))

        def spans(ends: Column) -> Column:
            every = F.transform(ends, lambda e, i: F.struct((e - F.length(F.get(m, i))).alias("start"), F.lit(place).alias("place"), e.alias("end")))
            return let(long_enough, lambda ok: F.filter(every, lambda s, i: F.get(ok, i)))

        return F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(let(running(steps, lambda a, b: a + b), spans))

    return let(group(0), located).cast(kind)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: an array of (start, place, end) per row, by start and then by the rule's place."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    vocabulary = sorted({t for r in indexed for clause in trigram_query(r.pattern) for t in clause})
    hits = written(candidates(build_index(docs, vocabulary), indexed), "secret-candidates")
    hits = hits.select(F.col("doc_id").alias("_hit"), F.col("kinds").alias("_kinds"))
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<struct<start:int,place:int,end:int>>")
    each = []
    for place, rule in enumerate(rules):
        spans = _spans(text, rule, place)
        each.append(F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(none) if rule in indexed else spans)
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_hit"]), "left").withColumn("found", F.sort_array(F.concat(*each))).drop("_hit", "_kinds")


def spans_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, found: Column, mask: str) -> Column:
    """``text`` with every span of ``found`` (sorted, not empty) replaced; overlapping spans get one mask.

    Texts are cut into parts of ``PART`` code points, so that a cut costs what its part is long, not the whole text.
    """

    def disjoint(ends: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.when(i > 0, F.get(found, i)["start"] >= F.get(ends, i - 1)).otherwise(True))
        one = lambda s, i, k: F.struct(F.get(found, i)["start"].alias("a"), F.get(ends, F.coalesce(F.get(s, k + 1), F.size(ends)) - 1).alias("b"))
        return let(first, lambda s: F.transform(s, lambda i, k: one(s, i, k)))

    def part(t: Column, at: Column, spans: Column) -> Column:
        def cut(own: Column) -> Column:
            def piece(x: Column, k: Column) -> Column:
                begin = F.when(k > 0, F.get(own, k - 1)["b"]).otherwise(at)
                return F.concat(F.when(x["a"] > begin, F.substring(t, begin - at + 1, x["a"] - begin)).otherwise(""), F.when(x["a"] >= at, mask).otherwise(""))

            tail = F.substring(t, F.element_at(own, -1)["b"] - at + 1, F.lit(PART))
            return F.when(F.size(own) == 0, t).otherwise(F.concat(F.array_join(F.transform(own, piece), ""), tail))

        return let(F.filter(spans, lambda x: (x["b"] > at) & (x["a"] < at + PART)), cut)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    reach = running(F.transform(found, lambda s: s["end"]), F.greatest)
    return let(let(reach, disjoint), lambda spans: F.array_join(F.transform(parts, lambda t, i: part(t, i * PART, spans)), ""))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); n_chars follows the text."""
    # The row's own columns travel in a struct, so that no name of theirs can clash with those made here.
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    clean = F.when(F.size("found") > 0, let(F.col("found"), lambda found: _masked(F.col("text"), found, mask))).otherwise(F.col("text"))
    out = scan(rows, rules).withColumn("clean", clean)
    changed = {"text": F.col("clean"), "n_chars": F.when(F.size("found") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def contract(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    of = lambda place: F.size(F.filter("found", lambda s: s["place"] == place)).cast("long")
    base = F.filter("found", lambda s: s["place"] < len(BASE))
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))
