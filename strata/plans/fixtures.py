"""Inputs in the shape that the operators take, derived from the test tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF, RUN_TS = "2001-08-01", "2001-08-02 00:00:00"

SPARK = {"first": "min_by", "last": "max_by", "text": "string", "iso": "date_format({}, 'yyyy-MM-dd')"}
DUCKDB = {"first": "arg_min", "last": "arg_max", "text": "varchar", "iso": "strftime({}, '%Y-%m-%d')"}

BARS = """select o_orderpriority symbol, cast(o_orderdate as date) day_date, {first}(o_totalprice, o_orderkey) open, max(o_totalprice) high,
 min(o_totalprice) low, {last}(o_totalprice, o_orderkey) close, count(*) volume from orders group by 1, 2"""
WEEKLY_BARS = BARS.replace("cast(o_orderdate as date) day_date", "cast(date_trunc('week', o_orderdate) as date) week_date")
DIRTY_BARS = """select k as row_id, case when k % 101 = 0 then ' n/a ' else concat(' ', lower(symbol), ' ') end symbol,
 case when k % 103 = 0 then 'not-a-date' else d end day_date,
 case when k % 97 = 0 then 'None' when k % 89 = 0 then '-1.00' when k % 83 = 0 then 'abc' else cast(cast(op as decimal(18,2)) as {text}) end open,
 case when k % 79 = 0 then '0.01' else cast(cast(hi as decimal(18,2)) as {text}) end high,
 cast(cast(lo as decimal(18,2)) as {text}) low, cast(cast(cl as decimal(18,2)) as {text}) close,
 case when k % 73 = 0 then '-' when k % 71 = 0 then '-5' else cast(vol as {text}) end volume,
 case when k % 107 = 0 then 'NULL' else '2001-08-01' end last_refreshed
 from (select o_orderpriority symbol, {day} d, {first}(o_totalprice, o_orderkey) op, max(o_totalprice) hi, min(o_totalprice) lo,
  {last}(o_totalprice, o_orderkey) cl, count(*) vol, min(o_orderkey) k from orders group by 1, 2)"""
# Trades: as many symbols as there are parts, besides one that has a third of all rows.
TRADES = """select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then 'HOT' else concat('P', cast(l_partkey as {text})) end symbol, cast(l_shipdate as date) day_date,
 l_extendedprice open, l_extendedprice high, l_extendedprice * (1 - l_discount) low, l_extendedprice * (1 + l_tax) close from lineitem"""
OVERVIEW_WIDE = """select c_custkey row_id, concat(' ', lower(c_name), ' ') "Symbol", case when c_custkey % 7 = 0 then ' N/A ' else n_name end "Country",
 case when c_custkey % 11 = 0 then 'None' else c_mktsegment end "Sector", cast(c_custkey as {text}) "CIK",
 case when c_custkey % 13 = 0 then '-' else cast(cast(c_acctbal as decimal(18,2)) as {text}) end "BookValue",
 case when c_custkey % 17 = 0 then 'bad' else cast(c_custkey * 1000000 as {text}) end "MarketCapitalization",
 case when c_custkey % 19 = 0 then 'None' else '2026-06-30' end "DividendDate" from customer join nation on c_nationkey = n_nationkey"""
OVERVIEW_SNAP = """select concat(' ', lower(o_orderpriority), ' ') "Symbol", o_orderstatus snapshot_id, case when o_orderstatus = 'F' then 'n/a' else 'USA' end "Country",
 {max_day} "LatestQuarter", cast(cast(max(o_totalprice) as decimal(18,2)) as {text}) "52WeekHigh", cast(count(*) as {text}) "AnalystRatingBuy"
 from orders where o_orderpriority <> '5-LOW' group by o_orderpriority, o_orderstatus"""


def sql(template: str, dialect: dict[str, str]) -> str:
    out = template.format(**{k: v for k, v in dialect.items() if k != "iso"}, day=dialect["iso"].format("o_orderdate"), max_day=dialect["iso"].format("max(o_orderdate)"))
    return out.replace('"', "`") if dialect is SPARK else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A recipe over the tables it names."""
    text, names = sql(template, SPARK), [n for n in ("orders", "customer", "nation", "lineitem") if f"from {n}" in template or f"join {n}" in template]
    for n in names:
        text = text.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n}", f"join {{{n}}}")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})
