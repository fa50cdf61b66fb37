"""The feature vectors of candidate pairs, 20 for the first generation and 25 for the second, as float columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import features as f
from kinlink.functions.kernels import compared
from kinlink.functions.text import tokens
from kinlink.operators.prescreen import cuts

FIRST = (
    "name_tj", "name_lev", "name_c3j", "name_c4j", "name_tss", "name_aov", "addr_tj", "addr_c3j", "addr_nov", "addr_rov", "addr_lev",
    "name_emb", "addr_emb", "ctry", "both_legal", "legal_xor", "n_tlen", "n_lrat", "a_tlen", "a_lrat",
)
SECOND = (
    "name_tj", "name_lev", "name_jw", "name_tsr", "name_c3", "name_c4", "name_tr_lev", "name_tr_jw", "name_tr_tsr", "addr_tj", "addr_lev",
    "addr_jw", "addr_tsr", "addr_c3", "addr_nov", "num_exact", "acro_match", "both_legal", "legal_xor", "n_tlen_diff", "n_lrat", "a_tlen_diff",
    "a_lrat", "first_tok_match", "prescore",
)
KEEP = ("s1_id", "cand_id")


def split(df: DataFrame) -> DataFrame:
    """Adds the tokens of both names (_n1, _n2) and addresses (_a1, _a2), which several features read."""
    return df.withColumns({f"_{x}{k}": tokens(f"norm_{c}_{k}") for x, c in (("n", "name"), ("a", "addr")) for k in (1, 2)})


def first(df: DataFrame) -> DataFrame:
    """Of pairs with norm_name, norm_addr, has_legal and country of both sides; emb_name and emb_addr count where present."""
    n, a = ("norm_name_1", "norm_name_2"), ("norm_addr_1", "norm_addr_2")
    df = split(df).withColumn("_k", compared(n=(*cuts("norm_name", 150), "ratio", "sort_ratio"), a=(*cuts("norm_addr", 100), "ratio"), w=(*n, "c3", "c4"), v=(*a, "c3")))
    nt, at = [F.col("_n1"), F.col("_n2")], [F.col("_a1"), F.col("_a2")]
    emb = {k: f.dot(f"emb_{k}_1", f"emb_{k}_2") if f"emb_{k}_1" in df.columns else F.lit(0.0) for k in ("name", "addr")}
    cols = {
        "name_tj": f.jaccard(*nt), "name_lev": F.col("_k.n_ratio"), "name_c3j": F.col("_k.w_c3"), "name_c4j": F.col("_k.w_c4"),
        "name_tss": F.col("_k.n_sort_ratio"), "name_aov": f.prefix_share(*nt), "addr_tj": f.jaccard(*at), "addr_c3j": F.col("_k.v_c3"),
        "addr_nov": f.jaccard(*map(f.with_digits, at)), "addr_rov": f.rare_jaccard(*at), "addr_lev": F.col("_k.a_ratio"), "name_emb": emb["name"], "addr_emb": emb["addr"],
        "ctry": f.same("country_1", "country_2"), "both_legal": f.both("has_legal_1", "has_legal_2"), "legal_xor": f.either("has_legal_1", "has_legal_2"),
        "n_tlen": f.size_difference(*nt), "n_lrat": f.length_ratio(*n), "a_tlen": f.size_difference(*at), "a_lrat": f.length_ratio(*a),
    }
    return df.select(*KEEP, *[cols[c].cast("float").alias(c) for c in FIRST])


def second(df: DataFrame) -> DataFrame:
    """Of pairs with norm_name, rom_name, norm_addr, number, acronym and has_legal of both sides."""
    n, a = ("norm_name_1", "norm_name_2"), ("norm_addr_1", "norm_addr_2")
    kinds = ("ratio", "set_ratio", "jaro_winkler")
    df = split(df).withColumn("_k", compared(n=(*cuts("norm_name", 120), *kinds), r=(*cuts("rom_name", 120), *kinds), a=(*cuts("norm_addr", 100), *kinds), w=(*n, "c3", "c4"), v=(*a, "c3")))
    nt, at = [F.col("_n1"), F.col("_n2")], [F.col("_a1"), F.col("_a2")]
    cols = {
        "name_tj": f.jaccard(*nt), "name_lev": F.col("_k.n_ratio"), "name_jw": F.col("_k.n_jaro_winkler"), "name_tsr": F.col("_k.n_set_ratio"),
        "name_c3": F.col("_k.w_c3"), "name_c4": F.col("_k.w_c4"), "name_tr_lev": F.col("_k.r_ratio"), "name_tr_jw": F.col("_k.r_jaro_winkler"),
        "name_tr_tsr": F.col("_k.r_set_ratio"), "addr_tj": f.jaccard(*at), "addr_lev": F.col("_k.a_ratio"), "addr_jw": F.col("_k.a_jaro_winkler"),
        "addr_tsr": F.col("_k.a_set_ratio"), "addr_c3": F.col("_k.v_c3"), "addr_nov": f.jaccard(*map(f.with_digits, at)),
        "num_exact": f.equal_filled("number_1", "number_2"), "acro_match": f.equal_filled("acronym_1", "acronym_2"),
        "both_legal": f.both("has_legal_1", "has_legal_2"), "legal_xor": f.either("has_legal_1", "has_legal_2"),
        "n_tlen_diff": f.size_difference(*nt), "n_lrat": f.length_ratio(*n), "a_tlen_diff": f.size_difference(*at), "a_lrat": f.length_ratio(*a),
        "first_tok_match": f.same_first(*nt), "prescore": F.greatest("_k.n_ratio", "_k.r_ratio") * 1.2 + F.col("_k.a_ratio"),
    }
    return df.select(*KEEP, *[cols[c].cast("float").alias(c) for c in SECOND])


def hashed(*columns: str, seed: int) -> Column:
    """A number below 2**32 of columns and a seed, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where the pair is in truth (s1_id, cand_id), else 0."""
    true = truth.select(*KEEP, F.lit(1).alias("label")).distinct()
    return pairs.join(true, list(KEEP), "left").withColumn("label", F.coalesce("label", F.lit(0)))


def training_pairs(pairs: DataFrame, per_positive: int = 6, seed: int = 42) -> DataFrame:
    """Labelled pairs with, for each query, all positives and per_positive times as many negatives plus one, by hash."""
    from pyspark.sql import Window

    own = Window.partitionBy("s1_id")
    rank = F.row_number().over(own.orderBy("label", hashed("s1_id", "cand_id", seed=seed), "cand_id"))
    df = pairs.withColumns({"_rank": rank, "_positive": F.sum("label").over(own)})
    return df.filter((F.col("label") == 1) | (F.col("_rank") <= per_positive * F.col("_positive") + 1)).drop("_rank", "_positive")


def grouped_split(pairs: DataFrame, percent: int = 15, seed: int = 42) -> DataFrame:
    """pairs with validation (boolean); all pairs of a query fall on the same side."""
    return pairs.withColumn("validation", hashed("s1_id", seed=seed) % 100 < percent)


def selected_pairs(truth: DataFrame, candidates: DataFrame, positives: int, negatives: int, seed: int = 42) -> DataFrame:
    """s1_id, cand_id, label: so many true pairs and so many candidates that are not true, by hash, the same on every run."""
    key = hashed(*KEEP, seed=seed)
    true = truth.select(*KEEP).distinct()
    yes = true.orderBy(key, *KEEP).limit(positives).withColumn("label", F.lit(1))
    no = candidates.select(*KEEP).join(true, list(KEEP), "left_anti").distinct().orderBy(key, *KEEP).limit(negatives).withColumn("label", F.lit(0))
    return yes.union(no)
