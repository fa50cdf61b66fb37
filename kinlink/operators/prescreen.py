"""Cheap scores for candidate pairs and the union of rankings that keeps the best of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.kernels import accent_fold_lower, compared
from kinlink.functions.text import filled
from kinlink.operators.blocking import top


#: What the channels rank by.
CHANNELS = ("s1_id", "cand_id", "comp", "best_addr", "rom_score", "roman_wins", "rescue")


def attributes(pairs: DataFrame, s1: DataFrame, s23: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of both entities, suffixed _1 and _2; pairs with an unknown id go.

    The entities are shuffled: their size is told from the file they come from, which says little of computed texts, and
    taken for small they would pass the driver to be broadcast.
    """
    left = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{c}_1") for c in columns])
    right = s23.select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs.join(left.hint("merge"), "s1_id").join(right.hint("merge"), "cand_id")


def cut(c: str, n: int):
    return F.substring(filled(c), 1, n)


def cuts(c: str, n: int):
    """The first n characters of a column of either side."""
    return cut(f"{c}_1", n), cut(f"{c}_2", n)


def first_score(df: DataFrame) -> DataFrame:
    """First generation: 1.2 times the name's ratio plus the address's, on prefixes of 100 and 80."""
    df = df.withColumn("_k", compared(n=(*cuts("norm_name", 100), "ratio"), a=(*cuts("norm_addr", 80), "ratio")))
    return df.withColumn("score", 1.2 * F.col("_k.n_ratio") + F.col("_k.a_ratio")).drop("_k")


def first_top(df: DataFrame, k: int = 30) -> DataFrame:
    """The k best of each query by first_score, ids settling ties."""
    return top(first_score(df), k, F.desc("score"))


def sixth_score(df: DataFrame) -> DataFrame:
    """Later first generation: 1.25 times the best of ratio, token-set ratio and that of the folded raw names, plus the address."""
    folded = [accent_fold_lower(f"business_name_{k}") for k in (1, 2)]
    df = df.withColumn("_k", compared(n=(*cuts("norm_name", 100), "ratio", "set_ratio"), f=(*folded, "set_ratio"), a=(*cuts("norm_addr", 80), "ratio")))
    best = F.greatest("_k.n_ratio", "_k.n_set_ratio", "_k.f_set_ratio")
    return df.withColumn("score", 1.25 * best + F.col("_k.a_ratio")).drop("_k")


def channel_scores(df: DataFrame) -> DataFrame:
    """Second generation: best_name, best_addr, comp (1.2 name + address), roman_wins, rescue (acronym or number agrees)."""
    kinds = ("ratio", "set_ratio")
    df = df.withColumn("_k", compared(n=(*cuts("norm_name", 80), *kinds), r=(*cuts("rom_name", 80), *kinds), a=(*cuts("norm_addr", 70), *kinds)))
    raw, rom, address = (F.greatest(f"_k.{x}_ratio", f"_k.{x}_set_ratio") for x in "nra")
    df = df.withColumns({"best_name": F.greatest(raw, rom), "best_addr": address, "rom_score": rom, "roman_wins": rom > raw})
    agrees = lambda c: (filled(f"{c}_1") != "") & (filled(f"{c}_1") == filled(f"{c}_2"))
    rescue = agrees("acronym") | (agrees("number") & (F.col("best_addr") >= 0.40))
    return df.withColumns({"comp": 1.2 * F.col("best_name") + F.col("best_addr"), "rescue": rescue}).drop("_k")


def channels(scored: DataFrame, cap: int = 60, best: int = 25, bar: float = 1.40, address: int = 10, roman: int = 10, rescues: int = 10) -> DataFrame:
    """s1_id, cand_id, comp, rank: the union of five rankings, then the cap best by comp.

    scored is used once for each branch and should be written or persisted. Every branch is a ranking of its own, so
    each gets its group limit before the shuffle. Rescued pairs are taken by comp, then id.
    """
    narrow = scored.select(*CHANNELS)
    branches = [
        top(narrow, best, F.desc("comp")),
        narrow.filter(F.col("comp") >= bar),
        top(narrow, address, F.desc("best_addr")),
        top(narrow.filter("roman_wins"), roman, F.desc("rom_score")),
        top(narrow.filter("rescue"), rescues, F.desc("comp")),
    ]
    union = branches[0].select("s1_id", "cand_id", "comp")
    for b in branches[1:]:
        union = union.union(b.select("s1_id", "cand_id", "comp"))
    return top(union.distinct(), cap, F.desc("comp"))
