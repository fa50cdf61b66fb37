"""Mixing sources to target weights by hash-threshold histograms.

The size of a document is its number of words. Sources, by code point with null last, weigh 5, 2, 1, repeating.
Together they get BUDGET times all words; a target stops at CAP times its source's size and the excess goes to the
others by weight until none is above (water filling). A source's target is some whole copies of it plus a rest; the
rest is a threshold on a hash of doc_id, found without sorting documents: a histogram of words by source and the
leading hash bits gives the bucket where the budget is crossed, only that bucket is dealt again by the next bits,
and the last crossed bucket, a few documents, by whole hashes. Thresholds are nested: a larger budget takes a
superset. The same rows always give the same mix.

Null text: size 0. Null source: a source of its own. Null doc_id: hashed as the empty text. Rows that share a
doc_id share a hash and are taken together. Very long texts count whole. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import WORD, table, written

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
#: Hash bits: all, and those of one histogram level.
BITS, LEVEL = 48, 12
#: Up to so many sources their thresholds are broadcast; beyond, the join is dealt by source and salt.
FEW_SOURCES, SALTS = 10_000, 32


def hashed(doc_id: str = "doc_id") -> Column:
    """The first 48 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def key(source: str = "source") -> Column:
    """A source without nulls, so that it can be joined."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", key().alias("source_key"), "source", words().alias("size"), hashed().alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, target, full (whole copies), rest. One row for each source; the windows go over sources, not documents."""
    each = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    each = each.withColumn("weight", weigh).withColumn("cap", CAP * F.col("source_size"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("total", F.sum("source_size").over(every) * F.lit(BUDGET)).withColumn("weights", F.sum("weight").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    each = each.withColumn("full_up", F.col("cap") / F.col("weight") <= level)
    left = F.col("total") - F.sum(F.when(F.col("full_up"), F.col("cap")).otherwise(0)).over(every)
    share = left / F.sum(F.when(F.col("full_up"), 0).otherwise(F.col("weight"))).over(every)
    each = each.withColumn("target", F.when(F.col("full_up"), F.col("cap").cast("double")).otherwise(share * F.col("weight")))
    each = each.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    return each.select("source_key", "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"))


def with_sources(docs: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """docs with the row of their source; a hot source is dealt over SALTS tasks."""
    if few:
        return docs.join(F.broadcast(per_source), "source_key")
    salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", (F.col("h") % SALTS).cast("int")).join(salted, ["source_key", "salt"]).drop("salt")


def crossing(docs: DataFrame, per_source: DataFrame, few: bool, down: int) -> DataFrame:
    """per_source with low moved to the first hash of the bucket (of 2**down hashes) where the budget is crossed, and spent, the words before it."""
    inside = with_sources(docs, per_source.select("source_key", "low", "high"), few).filter("h >= low and h < high")
    hist = inside.groupBy("source_key", F.shiftright("h", down).alias("bucket")).agg(F.sum("size").alias("words"))
    hist = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket")))
    found = hist.join(per_source.select("source_key", "spent", "rest"), "source_key").filter(F.col("spent") + F.col("upto") > F.col("rest"))
    found = found.groupBy("source_key").agg(F.min("bucket").alias("bucket"), F.min(F.struct("bucket", "words", "upto")).alias("at"))
    out = per_source.join(found, "source_key", "left")
    start = F.shiftleft(F.col("bucket"), down)
    return out.select(
        "source_key", "source_size", "target", "full", "rest",
        F.coalesce(start, F.col("high")).alias("low"),
        F.coalesce(start + (1 << down), F.col("high")).alias("high"),
        F.coalesce(F.col("spent") + F.col("at.upto") - F.col("at.words"), F.col("spent")).alias("spent"),
    )


def thresholds(sizes: DataFrame) -> tuple[DataFrame, bool]:
    """source_key, source_size, target, full and cut: hashes below cut get one copy more. And whether the sources are few."""
    per_source = written(targets(sizes).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(1 << BITS).cast("long"), "spent": F.lit(0).cast("long")}), "sources")
    few = per_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    for down in range(BITS - LEVEL, 2 * LEVEL - 1, -LEVEL):
        per_source = written(crossing(sizes, per_source, few, down), "sources")
    inside = with_sources(sizes, per_source.select("source_key", "low", "high", "spent", "rest"), few).filter("h >= low and h < high")
    each = inside.groupBy("source_key", "h", "spent", "rest").agg(F.sum("size").alias("words"))
    each = each.withColumn("upto", F.col("spent") + F.sum("words").over(Window.partitionBy("source_key").orderBy("h")))
    last = each.filter(F.col("upto") - F.col("words") / 2 <= F.col("rest")).groupBy("source_key").agg(F.max("h").alias("last"))
    out = per_source.join(last, "source_key", "left")
    return written(out.select("source_key", "source_size", "target", "full", F.coalesce(F.col("last") + 1, F.col("low")).alias("cut")), "sources"), few


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    sizes = written(sized(docs), "sizes")
    cuts, few = thresholds(sizes)
    taken = F.col("size") * (F.col("full") + (F.col("h") < F.col("cut")).cast("long"))
    return with_sources(sizes, cuts, few).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken; documents without words are not. Columns as in docs."""
    cuts, few = thresholds(written(sized(docs), "sizes"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key().alias("source_key"), hashed().alias("h"), words().alias("size"))
    copies = (F.col("full") + (F.col("h") < F.col("cut")).cast("long")).cast("int")
    out = with_sources(keyed, cuts, few).withColumn("copies", copies).filter("copies > 0 and size > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as h
  from documents),
each as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from each),
levels as (
  select *, 1.5::double * sum(source_size) over () as total,
         cap::double / weight <= (1.5::double * sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as full_up
  from weighed window w as (order by cap::double / weight, source nulls first rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size,
         case when full_up then cap::double else
           (total - sum(case when full_up then cap else 0 end) over ()) / (sum(case when full_up then 0 else weight end) over ())::double * weight end as target
  from levels),
parts as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
hashes as (
  select s.source, s.h, sum(s.size) as words, any_value(p.target - p.whole * p.source_size) as rest
  from sizes s join parts p on s.source is not distinct from p.source group by s.source, s.h),
marked as (select *, sum(words) over (partition by source order by h) - words / 2.0::double <= rest as more from hashes)
select s.doc_id, s.size, p.source_size, p.target, (s.size * (p.whole + case when m.more then 1 else 0 end))::bigint as taken
from sizes s join parts p on s.source is not distinct from p.source
join marked m on s.source is not distinct from m.source and s.h = m.h
"""
