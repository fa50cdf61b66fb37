"""Entity tables derived from the test tables, by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

E_DOC = """
select 'S' || (case doc_id % 3 when 0 then '1' when 1 then '2' else '3' end) || '-' || cast(doc_id as varchar(20)) as entity_id,
       split_part(text, chr(10), 1) as business_name, split_part(text, chr(10), 2) as business_address,
       lang as country
from documents"""
E_PART = """
select 'S' || (case p_partkey % 3 when 0 then '1' when 1 then '2' else '3' end) || '-' || cast(p_partkey as varchar(20)) as entity_id,
       p_name as business_name, cast(p_size as varchar(20)) || ' ' || lower(p_type) || ' road' as business_address, p_brand as country
from part"""
E_CUST = """
select 'S1-' || cast(s_suppkey as varchar(20)) as entity_id, s_name as business_name, n_name || ' ' || cast(s_suppkey % 50 as varchar(20)) as business_address, n_name as country
from supplier join nation on s_nationkey = n_nationkey
union all
select (case when c_custkey % 2 = 0 then 'S2-' else 'S3-' end) || cast(c_custkey as varchar(20)), c_name, n_name || ' ' || cast(c_custkey % 50 as varchar(20)), n_name
from customer join nation on c_nationkey = n_nationkey"""
# Short records of many kinds: legal forms, capitals, accents, Devanagari and Tamil letters, numbers, the French rule.
E_REC = """
select (case p_partkey % 3 when 0 then 'S1-' when 1 then 'S2-' else 'S3-' end) || cast(p_partkey as varchar(20)) as entity_id,
       (case p_partkey % 7 when 1 then translate(n, 'aeou', 'àéôü') when 3 then translate(lower(n), 'abcdefghiklmnoprstuwy', 'अबकदएफगहइकलमनओपरसटउवय') when 5 then translate(lower(n), 'acdegiklmnoprstuvy', 'அகதஎகஇகலமநஒபரசடஉவய')
             when 6 then upper(n) else n end) as business_name,
       (case when p_partkey % 13 = 0 then null when p_partkey % 7 = 3 then translate(lower(a), 'aegiklmnoprst', 'अएगइकलमनओपरसट') else a end) as business_address,
       (case p_brand when 'Brand#1' then 'France' when 'Brand#2' then 'India' else p_brand end) as country
from (select p_partkey, p_brand,
             p_name || ' ' || lower(p_type) || (case p_partkey % 5 when 0 then ' Ltd' when 1 then ' Corp.' when 2 then ' Pvt Ltd' when 3 then ' & Co' else '' end) as n,
             cast(p_size as varchar(20)) || ' ' || p_name || ' St, ' || lower(p_type) || ' ' || cast(p_partkey % 97 as varchar(20)) as a
      from part)"""
SQL = {"doc": E_DOC, "part": E_PART, "cust": E_CUST, "rec": E_REC}
TABLES = {"doc": ("documents",), "part": ("part",), "cust": ("supplier", "customer", "nation"), "rec": ("part",)}


def entities(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[kind]}
    sql = SQL[kind]
    return spark.sql(_bound(sql, frames), **frames)


def _bound(sql: str, frames: dict[str, DataFrame]) -> str:
    """The SQL with its tables as named arguments."""
    import re

    for t in frames:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (S1) and targets (S2 and S3)."""
    return df.filter(F.col("entity_id").startswith("S1-")), df.filter(~F.col("entity_id").startswith("S1-"))
