"""Missing-value tests and the normalisation of names, addresses and countries, as column expressions.

Everything is a built-in expression but Unicode composition, which Spark lacks: it is an Arrow UDF, and plans call it
for rows with non-ASCII text only (see ``composed``).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space, as character class members.
WHITE = "\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
# Texts that stand for a missing value, and the letters of a word.
MISSING = ("", "nan", "none", "null", "n/a", "na", "-")
WORD = "[\\p{L}\\p{N}_]"
PUNCTUATION = "[\\p{Pc}\\p{Pe}\\p{Pf}\\p{Pi}\\p{Po}\\p{Ps}\\p{S}]"
# Legal forms by their canonical token; all variants in order, longer ones of a token first.
LEGAL_FORMS = {
    "llc": ("limited liability company", "l.l.c.", "l.l.c", "llc."),
    "inc": ("incorporated", "inc.", "inc,"),
    "corp": ("corporation", "corp.", "corp,"),
    "ltd": ("limited", "ltd.", "ltd,"),
    "co": ("company", "co.", "co,"),
    "lp": ("limited partnership", "l.p."),
    "llp": ("limited liability partnership", "l.l.p."),
    "pvt": ("private", "pvt.", "pvt,"),
    "pte": ("private limited", "pte."),
}
# Address abbreviations.
STREET_WORDS = {
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "dr": "drive",
    "rd": "road",
    "ln": "lane",
    "ct": "court",
    "pl": "place",
    "sq": "square",
    "hwy": "highway",
    "fwy": "freeway",
    "pkwy": "parkway",
    "fte": "suite",
    "ste": "suite",
    "apt": "apartment",
    "flr": "floor",
    "n": "north",
    "s": "south",
    "e": "east",
    "w": "west",
    "nw": "northwest",
    "ne": "northeast",
    "sw": "southwest",
    "se": "southeast",
}
# Country aliases.
COUNTRIES = {"us": "US", "usa": "US", "united states": "US", "united states of america": "US", "india": "IN", "in": "IN", "france": "FR", "fr": "FR"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space at both ends (more than the blanks that ``trim`` knows)."""
    return F.regexp_replace(_col(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_valid(c: Column | str) -> Column:
    """True unless the value is null, blank or a word for a missing value."""
    c = _col(c)
    return c.isNotNull() & ~F.lower(stripped(c)).isin(*MISSING)


def is_missing(c: Column | str) -> Column:
    return ~is_valid(c)


def safe_field(c: Column | str, default: str = "") -> Column:
    return F.when(is_valid(c), stripped(c)).otherwise(F.lit(default))


def _if_valid(c: Column) -> Column:
    return F.when(is_valid(c), c)


def collapse(c: Column | str) -> Column:
    """White space runs become one blank; null if nothing valid is left."""
    return F.transform(F.array(_blanks(_if_valid(_col(c)))), _if_valid)[0]


def replace_punctuation(c: Column | str, keep_hyphens: bool = True) -> Column:
    """Dashes become hyphens (or blanks), other punctuation and symbols blanks."""
    dashed = F.regexp_replace(_if_valid(_col(c)), "\\p{Pd}", "-" if keep_hyphens else " ")
    return F.regexp_replace(dashed, PUNCTUATION, " ")


def lowered(c: Column | str) -> Column:
    return F.lower(_if_valid(_col(c)))


def unicode_form(form: str = "NFC"):
    """Arrow UDF that brings texts to a Unicode normal form; null when missing."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")

    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return lambda c: normal(_if_valid(_col(c)))


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in composed form (NFC). ASCII texts stay in the JVM: Python gets nulls for them."""
    normal = unicode_form("NFC")
    odd = lambda c: F.when(F.col(c).rlike("[^\\x00-\\x7F]"), F.col(c))
    made = df.withColumns({f"_odd_{c}": normal(odd(c)) for c in columns})
    return made.withColumns({c: F.coalesce(f"_odd_{c}", c) for c in columns}).drop(*[f"_odd_{c}" for c in columns])


def _spelled(c: Column, variant: str, token: str) -> Column:
    return F.regexp_replace(c, f"(?<!{WORD}){re.escape(variant)}(?!{WORD})", token)


def legal_forms(c: Column | str) -> Column:
    """Spellings of legal forms become their tokens, one spelling after another in the fixed order."""
    out = _col(c)
    for token, variants in LEGAL_FORMS.items():
        for variant in variants:
            out = _spelled(out, variant, token)
    return out


def _checked(c: Column) -> Column:
    """``c``, null if it is a word for a missing value. A one-element transform, so that ``c`` is evaluated once."""
    return F.transform(F.array(c), lambda x: F.when(~x.isin(*MISSING), x))[0]


def _blanks(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def _spaced(c: Column) -> Column:
    """Punctuation and symbols but dashes become blanks."""
    return F.regexp_replace(F.regexp_replace(c, "\\p{Pd}", "-"), PUNCTUATION, " ")


def normal_name(c: Column | str) -> Column:
    """Business name (already composed): lower case, canonical legal forms, no punctuation but hyphens."""
    return _checked(_blanks(_spaced(legal_forms(_blanks(lowered(c))))))


def normal_address(c: Column | str) -> Column:
    """Address (already composed): lower case, no punctuation but hyphens, abbreviations spelled out."""
    out = _spaced(_blanks(lowered(c)))
    for short, full in STREET_WORDS.items():
        out = _spelled(out, short, full)
    return _checked(_blanks(out))


def normal_country(c: Column | str) -> Column:
    """Two-letter code of the known aliases, else upper case."""
    c = _col(c)
    text = stripped(c)
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.when(is_valid(c), F.coalesce(F.element_at(aliases, F.lower(text)), F.upper(text)))


def normalized(records: DataFrame) -> DataFrame:
    """Records with ``name_norm``, ``addr_norm`` and ``country_norm``. Each distinct name, address and country is normalised
    once: that takes up to some sixty patterns, many times what the join of its result costs."""
    out = records
    if records.isStreaming:  # rows as they arrive, without a shuffle
        ready = composed(records.withColumns({"_name": F.col("business_name"), "_addr": F.col("business_address")}), "_name", "_addr")
        return ready.withColumns({"name_norm": normal_name("_name"), "addr_norm": normal_address("_addr"), "country_norm": normal_country("country")}).drop("_name", "_addr")
    for column, name, norm in (("business_name", "name_norm", normal_name), ("business_address", "addr_norm", normal_address), ("country", "country_norm", normal_country)):
        texts = records.select(F.col(column).alias("_raw")).where("_raw IS NOT NULL").distinct().withColumn("_text", F.col("_raw"))
        texts = (texts if column == "country" else composed(texts, "_text")).select("_raw", norm("_text").alias(name))
        out = out.join(texts, F.col(column) == F.col("_raw"), "left").drop("_raw")
    return out
