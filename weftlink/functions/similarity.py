"""String and set similarities. Jaro-Winkler is vectorised over Arrow batches, the rest are built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a batch's comparison matrix that are held at once.
_CELLS = 1 << 22


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points as rows of a matrix, padded with zeros."""
    padded = "".join(t.ljust(width, "\0") for t in texts)
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), width)


def _matched_codes(codes: np.ndarray, matched: np.ndarray) -> np.ndarray:
    """The matched code points of each row moved to its front."""
    order = np.argsort(~matched, axis=1, kind="stable")
    return np.take_along_axis(np.where(matched, codes, 0), order, axis=1)


def _block(a: list[str], b: list[str], boosted_from: float, floor_swaps: bool) -> np.ndarray:
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ca, cb = _codes(a, int(la.max())), _codes(b, int(lb.max()))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    places = np.arange(cb.shape[1])
    free = places[None, :] < lb[:, None]
    hit_a = np.zeros(ca.shape, dtype=bool)
    rows = np.arange(len(a))
    for i in range(ca.shape[1]):
        fits = free & (cb == ca[:, i : i + 1]) & (np.abs(places[None, :] - i) <= reach[:, None])
        found = fits.any(axis=1) & (i < la)
        hit_a[:, i] = found
        free[rows[found], fits.argmax(axis=1)[found]] = False
    hit_b = (places[None, :] < lb[:, None]) & ~free
    m = hit_a.sum(axis=1)
    width = min(ca.shape[1], cb.shape[1])
    swaps = (_matched_codes(ca, hit_a)[:, :width] != _matched_codes(cb, hit_b)[:, :width]).sum(axis=1) / 2
    if floor_swaps:
        swaps = np.floor(swaps)
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (some - swaps) / some) / 3, 0.0)
    head = min(4, ca.shape[1], cb.shape[1])
    alike = (ca[:, :head] == cb[:, :head]) & (ca[:, :head] != 0)
    prefix = np.cumprod(alike, axis=1).sum(axis=1)
    return np.where(jaro > boosted_from, jaro + prefix * 0.1 * (1 - jaro), jaro)


def jaro_winkler_values(a: list[str], b: list[str], gated: bool = True) -> np.ndarray:
    """Jaro-Winkler of pairs of texts. ``gated``: a common prefix counts only above 0.7, transpositions are whole;
    otherwise it always counts and half transpositions do too. 0 if either is empty, 1 if they are equal."""
    out = np.array([1.0 if x and x == y else 0.0 for x, y in zip(a, b)])
    todo = np.array([i for i, (x, y) in enumerate(zip(a, b)) if x and y and x != y], dtype=np.int64)
    size = np.array([max(len(a[i]), len(b[i])) for i in todo], dtype=np.int64)
    todo = todo[np.argsort(size, kind="stable")]
    size.sort()
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and (end - at + 1) * int(size[end]) <= _CELLS // 8 and size[end] <= 2 * size[at] + 8:
            end += 1
        part = todo[at:end]
        out[part] = _block([a[i] for i in part], [b[i] for i in part], 0.7 if gated else -1.0, gated)
        at = end
    return out


def _udf(gated: bool):
    @F.pandas_udf(T.DoubleType())
    def values(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_values(a.fillna("").tolist(), b.fillna("").tolist(), gated))

    return values


def jaro_winkler(a: Column | str, b: Column | str, variant: str = "gated") -> Column:
    """Jaro-Winkler as an Arrow UDF; nulls count as empty."""
    if variant not in ("gated", "ungated"):
        raise ValueError(f"unknown variant {variant!r}")
    return _udf(variant == "gated")(a, b)


def with_jaro_winkler(df: DataFrame, wanted: dict[str, tuple[str, str]], variant: str = "gated") -> DataFrame:
    """``df`` with a Jaro-Winkler column for each name: all of a row's pairs go through one Python pass."""
    return df.withColumns({out: jaro_winkler(F.col(a), F.col(b), variant) for out, (a, b) in wanted.items()})


def levenshtein_norm(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def tokens(c: Column) -> Column:
    """Distinct blank-separated tokens."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring code points; a single one counts as itself."""
    n = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).when(n == 1, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / union)


def length_ratio(a: Column, b: Column) -> Column:
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).otherwise(F.least(la, lb) / F.greatest(la, lb))


@dataclass(frozen=True)
class Weights:
    """Weights of the combined similarities."""

    name: float = 0.6
    address: float = 0.4
    jaro_winkler: float = 0.4
    levenshtein: float = 0.3
    token: float = 0.3
    strong_name: float = 0.90


def composite(jw: Column, lev: Column, tok: Column, w: Weights = Weights()) -> Column:
    total = w.jaro_winkler + w.levenshtein + w.token
    if total == 0:
        return F.lit(0.0)
    return (F.lit(w.jaro_winkler) * jw + F.lit(w.levenshtein) * lev + F.lit(w.token) * tok) / F.lit(total)
