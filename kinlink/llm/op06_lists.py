"""URL filters as of the time of the fetch: a temporal join with dated list entries.

An entry says that a list named a domain (action `add`) or dropped it (`remove`) on a date. The entries of one list
and domain, in order of date, become validity intervals [valid_from, valid_to): one opens where an add follows no
open one and closes at the next remove; of several entries on one date a remove counts last. A domain covers its
subdomains. Intervals are kept as one array for each domain, so the as-of evaluation of a capture is an equi-join
on the domains above its host, without a row for each pair of capture and entry. It is done once for each distinct
host and date; captures get its outcome by host and date.

Hosts are lower case without user, port and final dot, IPv6 ones in their brackets; domains of entries are cleaned in
the same way. Null or hostless URLs, and null fetch times, match nothing.
Entries with null or empty domain, null list, date or another action are ignored. Repeated captures: one result each. Empty
tables: empty results; without entries nothing is blocked. Extra columns of captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import table

#: Domains with intervals up to this number are broadcast; beyond, the join is shuffled.
FEW_DOMAINS = 50_000


def host(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def listed(domain: Column) -> Column:
    """The domain of an entry as hosts are written: also of a whole URL, with port, final dots or blanks around it."""
    bare = F.trim(F.regexp_replace(domain, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://", ""))
    return host(F.concat(F.lit("http://"), F.regexp_replace(bare, r"^\.+", "")))


def above(name: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """domain and spans: array of (list, valid_from, valid_to); valid_to null while open."""
    fine = entries.withColumn("domain", listed(F.col("domain"))).filter("domain is not null and list is not null and on is not null and action in ('add', 'remove')")
    day = fine.groupBy("list", "domain", "on").agg(F.max(F.col("action") == "remove").alias("ends"))
    order = Window.partitionBy("list", "domain").orderBy("on")
    # of runs of equal actions only the first changes anything
    turns = day.withColumn("was", F.lag("ends").over(order)).filter("was is null and not ends or was <> ends")
    spans = turns.withColumn("valid_to", F.lead("on").over(order)).filter("not ends")
    return spans.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("list", F.col("on").alias("valid_from"), "valid_to"))).alias("spans"))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """id, host, fetched, blocked, lists (names, sorted, comma-joined), listed_since (first valid_from among the active)."""
    own = captures.select("id", host("url").alias("host"), "fetched")
    asked = own.filter("host is not null and fetched is not null").select("host", "fetched").distinct()
    names = asked.select("host", "fetched", F.explode(above(F.col("host"))).alias("domain"))
    spans = intervals(entries)
    if spans.limit(FEW_DOMAINS + 1).count() <= FEW_DOMAINS:
        spans = F.broadcast(spans)
    active = F.filter("spans", lambda s: (s["valid_from"] <= F.col("fetched")) & (s["valid_to"].isNull() | (F.col("fetched") < s["valid_to"])))
    hits = names.join(spans, "domain").select("host", "fetched", F.explode(active).alias("hit"))
    hits = hits.groupBy("host", "fetched").agg(F.array_join(F.array_sort(F.collect_set("hit.list")), ",").alias("lists"), F.min("hit.valid_from").alias("listed_since"))
    return own.join(hits, ["host", "fetched"], "left").select("id", "host", "fetched", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), "listed_since")


#: The dated lists of the query: list, domain, date, action.
ENTRIES = (
    ("gambling", "casino-win.example.com", "2024-01-10", "add"),
    ("gambling", "casino-win.example.com", "2024-05-01", "remove"),
    ("gambling", "casino-win.example.com", "2024-08-15", "add"),
    ("gambling", "free-bets.example.com", "2024-03-01", "add"),
    ("gambling", "free-bets.example.com", "2024-04-01", "add"),
    ("gambling", "free-bets.example.com", "2024-11-30", "remove"),
    ("pills", "cheap-pills.example.com", "2023-06-01", "add"),
    ("pills", "cheap-pills.example.com", "2024-02-02", "remove"),
    ("pills", "cheap-pills.example.com", "2024-02-02", "add"),
    ("spam", "example.org", "2024-06-01", "add"),
    ("spam", "example.org", "2024-06-20", "remove"),
    ("spam", "tionsh.example.net", "2024-09-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-07-01", "add"),
)


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures; the tables hold no fetch time, so page n counts as fetched n modulo 366 days into 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", day.alias("fetched"))
    entries = spark.createDataFrame(list(ENTRIES), "list string, domain string, on string, action string").withColumn("on", F.col("on").cast("date"))
    out = judged(captures, entries)
    return out.select(F.col("id").alias("page_id"), "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "lists", F.col("listed_since").cast("string").alias("listed_since"))


_VALUES = ", ".join(f"('{a}', '{b}', date '{c}', '{d}')" for a, b, c, d in ENTRIES)
OP6_SQL = rf"""
with entries(list, domain, day, action) as (values {_VALUES}),
state as (
  select p.page_id, e.list, e.domain, e.day, e.action, p.fetched,
         row_number() over (partition by p.page_id, e.list, e.domain order by e.day desc, e.action desc) as r
  from (select *, date '2024-01-01' + (page_id % 366)::int as fetched,
               nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '\.+$', ''), '') as host from pages) p
  join entries e on e.day <= p.fetched and (p.host = e.domain or ends_with(p.host, '.' || e.domain))),
opened as (
  select s.page_id, s.list, s.domain,
         (select min(a.day) from entries a where a.list = s.list and a.domain = s.domain and a.action = 'add' and a.day <= s.fetched
          and not exists (select 1 from entries b where b.list = a.list and b.domain = a.domain and b.action = 'remove' and b.day >= a.day and b.day <= s.fetched)) as since
  from state s where s.r = 1 and s.action = 'add')
select p.page_id, nullif(regexp_replace(lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '\.+$', ''), '') as host,
       (date '2024-01-01' + (p.page_id % 366)::int)::date::varchar as fetched,
       o.lists is not null as blocked, coalesce(o.lists, '') as lists, o.since::varchar as listed_since
from pages p left join (select page_id, string_agg(distinct list, ',' order by list) as lists, min(since) as since from opened group by page_id) o on p.page_id = o.page_id
"""
