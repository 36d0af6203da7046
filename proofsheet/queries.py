"""Registered queries over the driver tables and their DuckDB oracle SQL.

Each query reads whole tables (or views Spark derives from them) and runs
one operator of the inventory; the matching SQL states the same semantics
independently for DuckDB.  Column names agree on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.functions.expr import col, period_label
from proofsheet.operators import metrics as M
from proofsheet.operators import profile as P
from proofsheet.operators import rollup as R
from proofsheet.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark, sf, name):
    return load_table(spark, sf, name)


# Explicit role answers (R3) for the driver tables: keys are identifiers.
ORDERS_MAPPING = {"o_orderkey": "identifier", "o_custkey": "identifier", "o_orderstatus": "dimension",
                  "o_totalprice": "measure", "o_orderdate": "date", "o_orderpriority": "dimension"}
LINEITEM_MAPPING = {"l_orderkey": "identifier", "l_partkey": "identifier", "l_suppkey": "identifier",
                    "l_linenumber": "identifier", "l_returnflag": "dimension", "l_linestatus": "dimension"}

# DuckDB side of the exact-sum policy (DECIMAL(38,6) accumulation).
def dsum(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(38,6))) as double)"


def davg(x: str) -> str:
    return f"({dsum(x)} / count({x}))"


# --------------------------------------------------------------- profile
@register("profile_orders", """
with s as (
  select count(*) as rows,
    count(*) - count(o_orderkey) n0, count(*) - count(o_custkey) n1, count(*) - count(o_orderstatus) n2,
    count(*) - count(o_totalprice) - count_if(isnan(o_totalprice)) n3, count(*) - count(o_orderdate) n4,
    count(*) - count(o_orderpriority) n5,
    count(distinct o_orderkey) d0, count(distinct o_custkey) d1, count(distinct o_orderstatus) d2,
    count(distinct o_totalprice) d3, count(distinct o_orderdate) d4, count(distinct o_orderpriority) d5,
    count_if(regexp_full_match(replace(o_orderstatus, ',', ''), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)')) k2,
    count_if(regexp_full_match(replace(o_orderpriority, ',', ''), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)')) k5
  from orders)
select 0 as ordinal, 'o_orderkey' as "column", rows, n0 as null_count, rows - n0 as present_count, cast(null as bigint) as numeric_count, d0 as unique_count from s
union all select 1, 'o_custkey', rows, n1, rows - n1, null, d1 from s
union all select 2, 'o_orderstatus', rows, n2, rows - n2, k2, d2 from s
union all select 3, 'o_totalprice', rows, n3, rows - n3, null, d3 from s
union all select 4, 'o_orderdate', rows, n4, rows - n4, null, d4 from s
union all select 5, 'o_orderpriority', rows, n5, rows - n5, k5, d5 from s
""")
def q_profile_orders(spark, sf):
    return P.column_stats(T(spark, sf, "orders"), distinct="exact").drop("unique_exact")


# --------------------------------------------------------------- KPIs
@register("kpis_lineitem", f"""
select * from (
  select 'rows.total' as key, round(cast(count(*) as double), 2) as value, 'count' as operation from lineitem
  union all select 'sum.l_quantity', round({dsum('l_quantity')}, 2), 'sum' from lineitem
  union all select 'sum.l_extendedprice', round({dsum('l_extendedprice')}, 2), 'sum' from lineitem
  union all select 'sum.l_discount', round({dsum('l_discount')}, 2), 'sum' from lineitem
  union all select 'sum.l_tax', round({dsum('l_tax')}, 2), 'sum' from lineitem)
""")
def q_kpis_lineitem(spark, sf):
    df = T(spark, sf, "lineitem")
    res, _ = M.kpi_frame(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return res.select("key", "value", "operation")


@register("kpis_orders_extras", f"""
select * from (
  select 'rows.total' as key, round(cast(count(*) as double), 2) as value, 'count' as operation from orders
  union all select 'sum.o_totalprice', round({dsum('o_totalprice')}, 2), 'sum' from orders
  union all select 'metric.average.o_totalprice', round({davg('o_totalprice')}, 2), 'average' from orders
  union all select 'metric.max.o_totalprice', round(max(o_totalprice), 2), 'max' from orders
  union all select 'metric.min.o_totalprice', round(min(o_totalprice), 2), 'min' from orders)
""")
def q_kpis_orders_extras(spark, sf):
    res, _ = M.kpi_frame(T(spark, sf, "orders"), ["o_totalprice"])
    return res.select("key", "value", "operation")


# --------------------------------------------------------------- charts
@register("category_topk", f"""
select row_number() over (order by value_0 desc nulls last, category) - 1 as rank, category, value_0 from (
  select cast(p_brand as varchar) as category, {dsum('p_retailprice')} as value_0
  from part where p_brand is not null group by 1 order by value_0 desc nulls last, category limit 8)
""")
def q_category_topk(spark, sf):
    return M.category_topk(T(spark, sf, "part"), "p_brand", ["p_retailprice"])


@register("category_topk_two_measures", f"""
select row_number() over (order by value_0 desc nulls last, category) - 1 as rank, category, value_0, value_1 from (
  select cast(l_returnflag as varchar) as category, {dsum('l_extendedprice')} as value_0, {dsum('l_quantity')} as value_1
  from lineitem where l_returnflag is not null group by 1 order by value_0 desc nulls last, category limit 8)
""")
def q_category_topk_two(spark, sf):
    return M.category_topk(T(spark, sf, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"])


@register("monthly_trend", f"""
select row_number() over (order by period) - 1 as ordinal, period, value_0 from (
  select strftime(o_orderdate, '%Y-%m') as period, {dsum('o_totalprice')} as value_0
  from orders where o_orderdate is not null group by 1 order by 1 limit 24)
""")
def q_monthly_trend(spark, sf):
    return M.trend(T(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"], is_date=True)


@register("trend_year_quarter", f"""
select row_number() over (order by y, q) - 1 as ordinal, cast(y as varchar) || ' · ' || q as period, value_0 from (
  select year(o_orderdate) as y, 'Q' || cast(quarter(o_orderdate) as varchar) as q, {dsum('o_totalprice')} as value_0
  from orders group by 1, 2 order by 1, 2 limit 24)
""")
def q_trend_year_quarter(spark, sf):
    df = T(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
        "o_totalprice")
    return M.trend(df, ["year", "quarter"], ["o_totalprice"], is_date=False)


@register("value_range", f"""
select min(l_extendedprice) as min_value, {davg('l_extendedprice')} as avg_value, max(l_extendedprice) as max_value from lineitem
""")
def q_value_range(spark, sf):
    return M.value_range(T(spark, sf, "lineitem"), "l_extendedprice")


@register("formula_totals", f"""
select coalesce({dsum('l_tax')}, 0) as l_tax, coalesce({dsum('l_quantity')}, 0) as l_quantity from lineitem
""")
def q_formula_totals(spark, sf):
    return M.formula_totals(T(spark, sf, "lineitem"), ["l_tax", "l_quantity"])


# =============================================================== cleaning
from proofsheet.functions.expr import normalize_text, parse_numeric_text, text_changed  # noqa: E402
from proofsheet.operators import clean as C  # noqa: E402
from proofsheet.operators import quality as Q  # noqa: E402
from proofsheet.operators.profile import ColumnProfile  # noqa: E402


def _money_text(k, price):
    fmt = price.cast("decimal(18,2)").cast("string")
    return (F.when(k % 31 == 0, F.lit("n/a")).when(k % 37 == 0, F.lit("12abc"))
             .when(k % 5 == 0, F.concat(F.lit("("), fmt, F.lit(")")))
             .otherwise(F.concat(F.lit("$"), fmt, F.lit(" USD"))))


@register("numeric_parse_currency", """
select o_orderkey, case when o_orderkey % 31 = 0 then null when o_orderkey % 37 = 0 then null
  when o_orderkey % 5 = 0 then -abs(cast(cast(o_totalprice as decimal(18,2)) as double))
  else cast(cast(o_totalprice as decimal(18,2)) as double) end as parsed_value
from orders
""")
def q_numeric_parse(spark, sf):
    o = T(spark, sf, "orders")
    return o.select("o_orderkey", parse_numeric_text(_money_text(F.col("o_orderkey"), F.col("o_totalprice"))).alias("parsed_value"))


def _padded_priority(o):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return (F.when(k % 11 == 0, F.lit("N/A")).when(k % 3 == 0, F.concat(F.lit("  "), p, F.lit(" ")))
             .when(k % 7 == 0, F.concat(F.lit(" "), p)).otherwise(p))


@register("text_normalize", """
select case when o_orderkey % 11 = 0 then null else o_orderpriority end as value, count(*) as cells,
  sum(case when o_orderkey % 11 <> 0 and (o_orderkey % 3 = 0 or o_orderkey % 7 = 0) then 1 else 0 end) as changed
from orders group by 1
""")
def q_text_normalize(spark, sf):
    raw = _padded_priority(T(spark, sf, "orders")).alias("raw")
    o = T(spark, sf, "orders").select(raw)
    return o.groupBy(normalize_text(F.col("raw")).alias("value")).agg(
        F.count(F.lit(1)).alias("cells"), F.sum(text_changed(F.col("raw"))).alias("changed"))


ROLE_STATUS = [ColumnProfile("status", "category", "dimension"), ColumnProfile("priority", "category", "dimension"),
               ColumnProfile("total_price", "number", "measure"), ColumnProfile("order_date", "date", "date")]


@register("summary_row_filter", f"""
select count(*) as kept_rows, {dsum('o_totalprice')} as kept_total, 1 as excluded_rows from orders
""")
def q_summary_rows(spark, sf):
    o = T(spark, sf, "orders")
    body = o.select(F.col("o_orderkey").alias("__source_row"), F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total_price"),
                    F.col("o_orderdate").alias("order_date"))
    total = o.agg(F.lit(-1).cast("long").alias("__source_row"), F.lit("Grand Total").alias("status"),
                  F.lit(None).cast("string").alias("priority"), M.exact_sum(F.col("o_totalprice")).alias("total_price"),
                  F.lit(None).cast("timestamp_ntz").alias("order_date"))
    df = body.unionByName(total)
    flagged = df.withColumn("__summary", C.summary_row_predicate(df, ROLE_STATUS))
    return flagged.agg(F.count_if(~F.col("__summary")).alias("kept_rows"),
                       M.exact_sum(F.when(~F.col("__summary"), F.col("total_price"))).alias("kept_total"),
                       F.count_if("__summary").alias("excluded_rows"))


def _doc_content(spark, sf):
    d = T(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("__source_row"), "text", "lang", "source", "n_chars")


@register("dedupe_keep_first", """
select min(doc_id) as doc_id, count(*) - 1 as removed from documents group by text, lang, source, n_chars
""")
def q_dedupe(spark, sf):
    kept = C.drop_duplicates_keep_first(_doc_content(spark, sf))
    return kept.select(F.col("__source_row").alias("doc_id"), F.col("__dups").alias("removed"))


@register("duplicate_rows_removed", """
select doc_id from documents d where doc_id not in (select min(doc_id) from documents group by text, lang, source, n_chars)
""")
def q_dup_removed(spark, sf):
    df = _doc_content(spark, sf)
    kept = C.drop_duplicates_keep_first(df)
    return C.duplicate_rows(df, kept).select(F.col("__source_row").alias("doc_id"))


@register("quality_duplicates", """
select coalesce(sum(c - 1), 0) as duplicate_rows from (select count(*) c from documents group by text, lang, source, n_chars)
""")
def q_quality_dups(spark, sf):
    return Q.duplicate_row_count(_doc_content(spark, sf))


def _dirty_orders(spark, sf):
    o = T(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("__source_row"), "o_orderkey", "o_orderstatus",
                    F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                    "o_orderdate",
                    F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


DIRTY_ORDERS_SQL = """(select o_orderkey, o_orderstatus,
  case when o_orderkey % 17 = 0 then null else o_totalprice end as o_totalprice, o_orderdate,
  case when o_orderkey % 23 = 0 then null else o_orderpriority end as o_orderpriority from orders)"""


@register("missing_locations", f"""
select 'o_totalprice' as "column", o_orderkey as source_row from {DIRTY_ORDERS_SQL} where o_totalprice is null
union all select 'o_orderpriority', o_orderkey from {DIRTY_ORDERS_SQL} where o_orderpriority is null
""")
def q_missing_locations(spark, sf):
    return C.missing_locations(_dirty_orders(spark, sf))


@register("impute_mean_label", f"""
with d as {DIRTY_ORDERS_SQL}, m as (select {dsum('o_totalprice')} / count(o_totalprice) as mean from d)
select o_orderkey, coalesce(o_totalprice, (select mean from m)) as o_totalprice,
  coalesce(o_orderpriority, 'غير محدد') as o_orderpriority from d
""")
def q_impute_mean_label(spark, sf):
    df = _dirty_orders(spark, sf)
    from proofsheet.operators.profile import infer_columns
    prof = infer_columns(df, ORDERS_MAPPING)
    res = C.clean_dataset(df, prof)
    return res.cleaned.select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("impute_audit_counts", f"""
with d as {DIRTY_ORDERS_SQL}
select 'o_totalprice' as "column", 'mean' as strategy, count(*) as cells from d where o_totalprice is null
union all select 'o_orderpriority', 'label', count(*) from d where o_orderpriority is null
""")
def q_impute_audit(spark, sf):
    df = _dirty_orders(spark, sf)
    from proofsheet.operators.profile import infer_columns
    res = C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING))
    return res.actions.groupBy("column", "strategy").agg(F.count(F.lit(1)).alias("cells"))


@register("impute_median", """
with d as (select case when l_orderkey % 13 = 0 then null else l_quantity end as q from lineitem)
select sum(cast(coalesce(q, (select quantile_cont(q, 0.5) from d)) as decimal(38,6)))::double as total_quantity,
  (select quantile_cont(q, 0.5) from d) as fill_value, count(*) as rows from d
""")
def q_impute_median(spark, sf):
    li = T(spark, sf, "lineitem")
    d = li.select(F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"))
    strategy, fill = C.fill_value_for(d, ColumnProfile("l_quantity", "number", "measure"), "")
    assert strategy == "median"
    return d.agg(M.exact_sum(F.coalesce(F.col("l_quantity"), F.lit(fill))).alias("total_quantity"),
                 F.lit(fill).alias("fill_value"), F.count(F.lit(1)).alias("rows"))


SEQ_NUMERIC_SQL = """
with d as (select c_custkey as src, case when c_custkey % 29 = 0 then null else c_custkey end as cust_id from customer),
p as (select *, row_number() over (order by src) - 1 as pos from d),
o as (select cust_id - pos as off, count(*) as n from p where cust_id is not null group by 1),
b as (select off from o order by n desc, off limit 1)
select src as source_row, coalesce(cust_id, (select off from b) + pos) as cust_id from p
"""


@register("sequential_id_numeric", SEQ_NUMERIC_SQL)
def q_seq_numeric(spark, sf):
    c = T(spark, sf, "customer")
    d = c.select(F.col("c_custkey").alias("__source_row"),
                 F.when(F.col("c_custkey") % 29 == 0, F.lit(None).cast("long")).otherwise(F.col("c_custkey")).alias("cust_id"))
    out, how = C.sequential_identifier(d, "cust_id")
    return out.select(F.col("__source_row").alias("source_row"), "cust_id")


SEQ_TEXT_SQL = """
with d as (select c_custkey as src, case when c_custkey % 29 = 0 then null else c_name end as cust_code from customer),
p as (select *, row_number() over (order by src) - 1 as pos,
      regexp_extract(cust_code, '^(.*?)(\\d+)$', 1) as prefix, regexp_extract(cust_code, '^(.*?)(\\d+)$', 2) as digits from d),
pre as (select prefix from p where digits <> '' group by 1 order by count(*) desc, prefix limit 1),
m as (select cast(digits as bigint) - pos as off, length(digits) as w from p where digits <> '' and prefix = (select prefix from pre)),
b as (select off from m group by 1 order by count(*) desc, off limit 1),
w as (select w from m group by 1 order by count(*) desc, w limit 1)
select src as source_row, coalesce(cust_code, (select prefix from pre) ||
  case when length(cast((select off from b) + pos as varchar)) >= (select w from w) then cast((select off from b) + pos as varchar)
       else lpad(cast((select off from b) + pos as varchar), cast((select w from w) as integer), '0') end) as cust_code from p
"""


@register("sequential_id_text", SEQ_TEXT_SQL)
def q_seq_text(spark, sf):
    c = T(spark, sf, "customer")
    d = c.select(F.col("c_custkey").alias("__source_row"),
                 F.when(F.col("c_custkey") % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("cust_code"))
    out, how = C.sequential_identifier(d, "cust_code")
    return out.select(F.col("__source_row").alias("source_row"), "cust_code")


DERIVED_SQL = """
with d as (select l_orderkey * 10 + l_linenumber as src,
    case when l_orderkey % 7 = 0 and l_orderkey % 11 <> 0 and l_orderkey % 13 <> 0 then null else l_quantity end as quantity,
    case when l_orderkey % 11 = 0 and l_orderkey % 13 <> 0 then null else l_extendedprice end as unit_price,
    case when l_orderkey % 13 = 0 then null else l_quantity * l_extendedprice end as total_sales from lineitem),
t as (select src, quantity, unit_price,
    case when total_sales is null and quantity is not null and unit_price is not null then quantity * unit_price else total_sales end as total_sales from d),
pr as (select src, quantity, total_sales,
    case when unit_price is null and total_sales is not null and quantity is not null and quantity <> 0 then total_sales / quantity else unit_price end as unit_price from t),
qq as (select *, case when unit_price <> 0 then total_sales / unit_price end as cand from pr)
select src as source_row,
  case when quantity is null and total_sales is not null and unit_price is not null
       and abs(cand - round(cand)) <= greatest(1e-9, 1e-9 * abs(cand)) then round(cand) else quantity end as quantity,
  unit_price, total_sales from qq
"""


@register("derived_repairs", DERIVED_SQL)
def q_derived(spark, sf):
    li = T(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    d = li.select((k * 10 + F.col("l_linenumber")).alias("__source_row"),
                  F.when((k % 7 == 0) & (k % 11 != 0) & (k % 13 != 0), F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("quantity"),
                  F.when((k % 11 == 0) & (k % 13 != 0), F.lit(None).cast("double")).otherwise(F.col("l_extendedprice")).alias("unit_price"),
                  F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity") * F.col("l_extendedprice")).alias("total_sales"))
    prof = [ColumnProfile("quantity", "number", "measure"), ColumnProfile("unit_price", "number", "measure"),
            ColumnProfile("total_sales", "number", "measure")]
    out, _ = C.derived_repairs(d, prof)
    return out.select(F.col("__source_row").alias("source_row"), "quantity", "unit_price", "total_sales")


# =============================================================== quality
@register("iqr_outliers_by_type", """
with f as (select event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, count(value) n from events group by 1)
select e.event_type, count_if(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers
from events e join f using (event_type) where n >= 4 and q3 - q1 > 0 group by 1
""")
def q_iqr(spark, sf):
    return Q.iqr_outliers(T(spark, sf, "events"), "value", ["event_type"])


EVENTS_MAPPING = {"event_type": "dimension", "value": "measure", "user_id": "identifier"}


@register("quality_report_events", """
with f as (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events),
o as (select count_if(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers from events, f)
select count(*) as row_count, 6 as column_count, 0 as missing_cells, 0.0 as missing_rate, 0 as duplicate_rows,
  0 as invalid_values, (select outliers from o) as outlier_count,
  count_if(regexp_matches(event_type, '^[=+\\-@]')) + count_if(regexp_matches(props, '^[=+\\-@]')) as formula_like_cells,
  greatest(0, 100 - least(100, round((select outliers from o)))) as score,
  greatest(0, 100 - least(100, round((select outliers from o) / (count(*) * 6.0) * 100))) as score_normalized
from events
""")
def q_quality_events(spark, sf):
    from proofsheet.operators.profile import infer_columns
    ev = T(spark, sf, "events")
    return Q.quality_report(ev, infer_columns(ev, EVENTS_MAPPING))


# =============================================================== insights
from proofsheet.operators import insights as I  # noqa: E402
from proofsheet.operators import verify as VF  # noqa: E402

TOP8_PART_SQL = f"""(select row_number() over (order by value_0 desc nulls last, category) - 1 as rank, category, value_0 from (
  select cast(p_brand as varchar) as category, {dsum('p_retailprice')} as value_0
  from part where p_brand is not null group by 1 order by value_0 desc nulls last, category limit 8))"""

MONTHS_SQL = f"""(select row_number() over (order by period) - 1 as ordinal, period, value_0 from (
  select strftime(o_orderdate, '%Y-%m') as period, {dsum('o_totalprice')} as value_0
  from orders where o_orderdate is not null group by 1 order by 1 limit 24))"""


@register("category_readings", f"""
with t as {TOP8_PART_SQL},
a as (select max(case when rank = 0 then value_0 end) as top_value, max(case when rank = 1 then value_0 end) as second_value,
      max(case when rank = (select max(rank) from t) then value_0 end) as bottom_value, {dsum('value_0')} as total from t)
select * from (
  select 'category.primary.lead_margin' as key, round(top_value - second_value, 2) as value from a
  union all select 'category.primary.gap', round(top_value - bottom_value, 2) from a
  union all select 'category.primary.top_share', round(top_value / total * 100, 2) from a)
""")
def q_category_readings(spark, sf):
    top = M.category_topk(T(spark, sf, "part"), "p_brand", ["p_retailprice"])
    return I.category_readings(top, "p_brand", "p_retailprice").select("key", "value")


@register("trend_readings", f"""
with t as {MONTHS_SQL},
a as (select max(case when ordinal = 0 then value_0 end) as first, max(case when ordinal = (select max(ordinal) from t) then value_0 end) as last,
      max(value_0) as peak, {dsum('value_0')} / count(*) as average from t)
select * from (
  select 'trend.primary.change' as key, round(last - first, 2) as value from a
  union all select 'trend.primary.average', round(average, 2) from a
  union all select 'trend.primary.change_rate', round((last - first) / abs(first) * 100, 2) from a
  union all select 'trend.primary.periods_above_average', round(cast((select count(*) from t where value_0 > (select average from a)) as double), 2)
  union all select 'trend.primary.distance_from_peak', round(peak - last, 2) from a)
""")
def q_trend_readings(spark, sf):
    tr = M.trend(T(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"], is_date=True)
    return I.trend_readings(tr, "o_orderdate", "o_totalprice").select("key", "value")


@register("trend_extremes", f"""
with t as {MONTHS_SQL}
select arg_max(period, value_0 * 1e6 - ordinal) as peak_period, max(value_0) as peak_value,
       arg_min(period, value_0 * 1e6 + ordinal) as low_period, min(value_0) as low_value from t
""")
def q_trend_extremes(spark, sf):
    tr = M.trend(T(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"], is_date=True)
    return I.trend_extremes(tr)


@register("insight_facts", f"""
with t as (select row_number() over (order by value_0 desc nulls last, category) - 1 as rank, category, value_0, value_1 from (
    select cast(l_returnflag as varchar) as category, {dsum('l_extendedprice')} as value_0, {dsum('l_quantity')} as value_1
    from lineitem where l_returnflag is not null group by 1 order by value_0 desc nulls last, category limit 8)),
a as (select * from t where rank = 0), b as (select * from t where rank = 1), z as (select * from t where rank = (select max(rank) from t)),
hi as (select * from t order by value_1 desc, rank limit 1), lo as (select * from t order by value_1, rank limit 1),
m as {MONTHS_SQL},
m0 as (select * from m where ordinal = 0), mz as (select * from m where ordinal = (select max(ordinal) from m)),
mh as (select * from m order by value_0 desc, ordinal limit 1), ml as (select * from m order by value_0, ordinal limit 1),
mean as (select {dsum('value_0')} / count(*) as v from m)
select 'leads' as verb, category as subject, null as object, 'l_extendedprice' as measure, round(value_0, 2) as number, 'chart.category.0.0' as refs from a
union all select 'follows', category, null, 'l_extendedprice', round(value_0, 2), 'chart.category.0.1' from b
union all select 'lead margin', a.category, b.category, 'l_extendedprice', round(a.value_0 - b.value_0, 2),
  'category.primary.lead_margin,chart.category.0.0,chart.category.0.1' from a, b
union all select 'trails', category, null, 'l_extendedprice', round(value_0, 2), 'chart.category.0.' || cast(rank as varchar) from z where rank > 0
union all select 'gap', a.category, z.category, 'l_extendedprice', round(a.value_0 - z.value_0, 2),
  'category.primary.gap,chart.category.0.0,chart.category.0.' || cast(z.rank as varchar) from a, z where z.rank > 0
union all select 'share', a.category, null, 'l_extendedprice', round(a.value_0 / (select {dsum('value_0')} from t) * 100, 2),
  'category.primary.top_share,chart.category.0.0' from a
union all select 'second highest', category, null, 'l_quantity', round(value_1, 2), 'chart.category.1.' || cast(rank as varchar) from hi
union all select 'second lowest', category, null, 'l_quantity', round(value_1, 2), 'chart.category.1.' || cast(rank as varchar) from lo
union all select 'peak', period, null, 'o_totalprice', round(value_0, 2), 'chart.trend.0.' || cast(ordinal as varchar) from mh
union all select 'weakest', period, null, 'o_totalprice', round(value_0, 2), 'chart.trend.0.' || cast(ordinal as varchar) from ml
union all select 'change', m0.period, mz.period, 'o_totalprice', round(mz.value_0 - m0.value_0, 2),
  'trend.primary.change,chart.trend.0.0,chart.trend.0.' || cast(mz.ordinal as varchar) from m0, mz
union all select 'average', null, null, 'o_totalprice', round(v, 2), 'trend.primary.average' from mean
union all select 'change rate', m0.period, mz.period, 'o_totalprice', round((mz.value_0 - m0.value_0) / abs(m0.value_0) * 100, 2),
  'trend.primary.change_rate,chart.trend.0.0,chart.trend.0.' || cast(mz.ordinal as varchar) from m0, mz where m0.value_0 <> 0
union all select 'above average', null, null, 'o_totalprice', cast((select count(*) from m where value_0 > v) as double),
  'trend.primary.periods_above_average,trend.primary.average' from mean
union all select 'distance from peak', mz.period, mh.period, 'o_totalprice', round(mh.value_0 - mz.value_0, 2),
  'trend.primary.distance_from_peak,chart.trend.0.' || cast(mh.ordinal as varchar) || ',chart.trend.0.' || cast(mz.ordinal as varchar) from mh, mz
""")
def q_insight_facts(spark, sf):
    top = M.category_topk(T(spark, sf, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"])
    tr = M.trend(T(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"], is_date=True)
    facts = I.category_facts(top, ["l_extendedprice", "l_quantity"]).unionByName(I.trend_facts(tr, "o_totalprice"))
    return facts.select("verb", "subject", "object", "measure", F.get("numbers", F.lit(0)).alias("number"), F.array_join("refs", ",").alias("refs"))


@register("insight_texts", f"""
with o as (select count(*) n, {dsum('o_totalprice')} s, {davg('o_totalprice')} a, min(o_totalprice) lo, max(o_totalprice) hi from orders),
c as (select o_orderstatus k, {dsum('o_totalprice')} v from orders where o_orderstatus is not null group by 1),
r as (select k, v, row_number() over (order by v desc, k) - 1 as i from c),
f as (select {dsum('v')} t from r where i < 8)
select 'Scope of the analysis' as title, 'The analysis covers ' || cast(n as varchar) || ' records.' as text, 'rows.total' as refs from o
union all select 'Category leader', '«' || k || '» leads in «o_totalprice» with ' || regexp_replace(format('{{:.2f}}', round(v, 2)), '\\.00$', '') || '.',
  'chart.category.0.0' from r where i = 0
union all select 'Share of the first category', '«' || k || '» has ' || regexp_replace(format('{{:.2f}}', round(v / t * 100, 2)), '\\.00$', '')
  || '% of «o_totalprice» among the categories shown.', 'category.primary.top_share,chart.category.0.0' from r, f where i = 0
union all select 'Extent of values', '«o_totalprice» lies between ' || regexp_replace(format('{{:.2f}}', round(lo, 2)), '\\.00$', '') || ' and '
  || regexp_replace(format('{{:.2f}}', round(hi, 2)), '\\.00$', '') || ', ' || regexp_replace(format('{{:.2f}}', round(a, 2)), '\\.00$', '') || ' on average.',
  'dist.o_totalprice.min,dist.o_totalprice.avg,dist.o_totalprice.max' from o
union all select 'Indicator: Total o_totalprice', '«Total o_totalprice» is ' || regexp_replace(format('{{:.2f}}', round(s, 2)), '\\.00$', '')
  || ' within the data analysed.', 'sum.o_totalprice' from o
""")
def q_insight_texts(spark, sf):
    from proofsheet.plans.analysis import analyze
    res = analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    titles = ["Scope of the analysis", "Category leader", "Share of the first category", "Extent of values", "Indicator: Total o_totalprice"]
    return res.insights.where(F.col("title").isin(titles)).select("title", "text", F.array_join("result_refs", ",").alias("refs"))


@register("range_readings", f"""
with r as (select min(l_extendedprice) mn, {davg('l_extendedprice')} av, max(l_extendedprice) mx from lineitem)
select 'distribution.primary.spread' as key, round(mx - mn, 2) as value from r
union all select 'distribution.primary.relative_spread', round((mx - mn) / abs(av) * 100, 2) from r
""")
def q_range_readings(spark, sf):
    return I.range_readings(M.value_range(T(spark, sf, "lineitem"), "l_extendedprice"), "l_extendedprice").select("key", "value")


@register("reconcile_grouped", """
select * from (select 1 as l_returnflag, 1.0 as value_0, 1.0 as __check) where false
""")
def q_reconcile(spark, sf):
    li = T(spark, sf, "lineitem")
    top = li.groupBy("l_returnflag").agg(M.aggregate("sum", F.col("l_extendedprice")).alias("value_0"))
    bad = VF.reconcile(top, li, ["l_returnflag"], "value_0", "sum", "l_extendedprice", complete=True)
    return bad.select(F.col("l_returnflag").cast("int").alias("l_returnflag"), "value_0", "__check")


@register("reconcile_faults", """
with o as (select o_orderpriority as k, count(*) n from orders group by 1)
select k as o_orderpriority, case k when '1-URGENT' then 'missing right' else 'altered' end as difference, n as left_rows,
  case k when '1-URGENT' then null else n - (select count(*) from orders where o_orderpriority = '2-HIGH' and o_orderkey % 10 = 3) end as right_rows
from o where k = '1-URGENT' or (k = '2-HIGH' and exists (select 1 from orders where o_orderpriority = '2-HIGH' and o_orderkey % 10 = 3))
union all select k, 'altered', n, n from o where k = '3-MEDIUM' and exists (select 1 from orders where o_orderpriority = '3-MEDIUM' and o_totalprice is not null)
union all select 'added', 'missing left', null, count(*) from orders where o_orderpriority = '5-LOW' having count(*) > 0
""")
def q_reconcile_faults(spark, sf):
    """Orders against a copy with one group dropped, one short of rows, one with other values and one added."""
    o = T(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    p = F.col("o_orderpriority")
    other = o.where(~F.coalesce((p == "1-URGENT") | (p == "2-HIGH") & (F.col("o_orderkey") % 10 == 3), F.lit(False)))
    other = other.withColumn("o_totalprice", F.when(p == "3-MEDIUM", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    other = other.unionByName(o.where(p == "5-LOW").withColumn("o_orderpriority", F.lit("added")))
    return VF.compare_groups(o, other, ["o_orderpriority"], ["o_orderkey", "o_totalprice"])


@register("reconcile_missing_groups", """
with s as (select o_orderpriority, sum(o_totalprice) s from orders group by 1)
select o_orderpriority, cast(null as double) value, round(s, 2) as recomputed from s where o_orderpriority = '1-URGENT'
union all select 'no such group', cast(1 as double), null
""")
def q_reconcile_missing(spark, sf):
    """A grouped result that lacks one group of the data and has one that the data lacks."""
    o = T(spark, sf, "orders")
    sums = o.groupBy("o_orderpriority").agg(M.aggregate("sum", F.col("o_totalprice")).alias("value")).where("o_orderpriority <> '1-URGENT' or o_orderpriority is null")
    sums = sums.unionByName(spark.createDataFrame([("no such group", 1.0)], "o_orderpriority string, value double"))
    bad = VF.reconcile(sums, o, ["o_orderpriority"], "value", "sum", "o_totalprice", complete=True)
    return bad.select("o_orderpriority", "value", F.round("__check", 2).alias("recomputed"))


@register("analysis_registry_keys", """
select key from (values ('rows.total'), ('sum.o_totalprice'), ('metric.average.o_totalprice'), ('metric.max.o_totalprice'),
  ('metric.min.o_totalprice'), ('quality.score'), ('quality.missing'), ('quality.duplicates'), ('quality.invalid'),
  ('quality.outliers'), ('quality.completeness'), ('category.primary.lead_margin'), ('category.primary.gap'),
  ('category.primary.top_share'), ('trend.primary.change'), ('trend.primary.average'), ('trend.primary.change_rate'),
  ('trend.primary.periods_above_average'), ('trend.primary.distance_from_peak'), ('dist.o_totalprice.min'),
  ('dist.o_totalprice.avg'), ('dist.o_totalprice.max'), ('distribution.primary.spread'),
  ('distribution.primary.relative_spread')) v(key)
union all select 'chart.category.0.' || cast(row_number() over (order by o_orderstatus) - 1 as varchar)
  from (select distinct o_orderstatus from orders)
union all select 'chart.trend.0.' || cast(n as varchar) from range(0, 24) t(n)
""")
def q_analysis_registry_keys(spark, sf):
    from proofsheet.plans.analysis import analyze
    res = analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    return res.results.select("key")


@register("registry_integrity", """
select 'x' as ref where false
""")
def q_integrity(spark, sf):
    from proofsheet.plans.analysis import analyze
    return analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey").integrity


# =============================================================== questions
from proofsheet.plans import question as QP  # noqa: E402
from proofsheet.operators.positions import join_small as _join_small  # noqa: E402

SALES_PROFILES = [ColumnProfile("brand", "category", "dimension"), ColumnProfile("year", "category", "dimension"),
                  ColumnProfile("quarter", "category", "dimension"), ColumnProfile("revenue", "number", "measure"),
                  ColumnProfile("quantity", "number", "measure")]

SALES_SQL = """(select p_brand as brand, year(l_shipdate) as year, 'Q' || cast(quarter(l_shipdate) as varchar) as quarter,
  l_extendedprice as revenue, l_quantity as quantity, l_orderkey * 10 + l_linenumber as src
  from lineitem join part on l_partkey = p_partkey)"""


def brand_sales(spark, sf):
    """Sales by brand: lineitem ⋈ part (part is broadcast only when its
    checked row count is small; otherwise a shuffle join)."""
    li = T(spark, sf, "lineitem")
    pt = T(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    j = _join_small(li, pt, "l_partkey", "inner")
    return j.select(F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("year"),
                    F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("quarter"),
                    F.col("l_extendedprice").alias("revenue"), F.col("l_quantity").alias("quantity"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("__source_row"))


def ask(spark, sf, question):
    df = brand_sales(spark, sf)
    cat = QP.build_catalog(df, SALES_PROFILES)
    plan = QP.plan_question(question, cat)
    return df, plan, QP.run_plan(df, plan)


@register("question_aggregate", f"""
select coalesce({dsum('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s where year = 1996 and brand = 'Brand#3'
""")
def q_question_aggregate(spark, sf):
    return ask(spark, sf, "What is the total revenue of Brand#3 in 1996?")[2]


@register("question_ranking_top", f"""
select row_number() over (order by value desc, label) - 1 as ordinal, label, value, rows from (
  select brand as label, coalesce({dsum('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s
  where year = 2000 group by 1 order by value desc, label limit 3)
""")
def q_question_top(spark, sf):
    return ask(spark, sf, "Top 3 brands by revenue 2000")[2]


@register("question_ranking_bottom", f"""
select row_number() over (order by value, label) - 1 as ordinal, label, value, rows from (
  select quarter as label, coalesce({dsum('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s
  where year = 2000 group by 1 order by value, label limit 1)
""")
def q_question_bottom(spark, sf):
    return ask(spark, sf, "Which quarter had the lowest revenue 2000?")[2]


@register("question_comparison", f"""
select row_number() over (order by value desc, label) - 1 as ordinal, label, value, rows from (
  select brand as label, coalesce({dsum('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s
  where brand in ('Brand#5', 'Brand#6') group by 1 order by value desc, label limit 10)
""")
def q_question_comparison(spark, sf):
    return ask(spark, sf, "Compare revenue of Brand#5 and Brand#6")[2]


GROWTH_SQL = f"""(select row_number() over (order by year) - 1 as ordinal, cast(year as varchar) as label,
  coalesce({dsum('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s where brand = 'Brand#7' group by year)"""


@register("question_growth", f"select * from {GROWTH_SQL}")
def q_question_growth(spark, sf):
    return ask(spark, sf, "Revenue growth of Brand#7 by year")[2]


@register("question_growth_rate", f"""
with g as {GROWTH_SQL}
select min_by(label, ordinal) as first_label, max_by(label, ordinal) as last_label, min_by(value, ordinal) as first_value,
  max_by(value, ordinal) as last_value, count(*) as periods,
  (max_by(value, ordinal) - min_by(value, ordinal)) / abs(min_by(value, ordinal)) * 100 as growth_pct from g
""")
def q_question_growth_rate(spark, sf):
    return QP.growth_answer(ask(spark, sf, "Revenue growth of Brand#7 by year")[2])


@register("question_comparison_gap", f"""
with c as (select row_number() over (order by value desc, label) - 1 as ordinal, label, value from (
  select brand as label, coalesce({dsum('revenue')}, 0) as value from {SALES_SQL} s
  where brand in ('Brand#5', 'Brand#6') group by 1))
select max(case when ordinal = 0 then label end) as first_label, max(case when ordinal = 1 then label end) as second_label,
  max(case when ordinal = 0 then value end) - max(case when ordinal = 1 then value end) as difference from c
""")
def q_question_comparison_gap(spark, sf):
    return QP.comparison_answer(ask(spark, sf, "Compare revenue of Brand#5 and Brand#6")[2])


@register("value_dictionary", f"""
select 'brand' as "column", brand as value, min(src) as first_row from {SALES_SQL} s group by brand
union all select 'year', cast(year as varchar), min(src) from {SALES_SQL} s group by year
union all select 'quarter', quarter, min(src) from {SALES_SQL} s group by quarter
""")
def q_value_dictionary(spark, sf):
    return QP.build_catalog(brand_sales(spark, sf), SALES_PROFILES).dictionary.select("column", "value", "first_row")


@register("quality_question_audit", f"""
with d as {DIRTY_ORDERS_SQL}
select 'o_totalprice' as "column", count(*) as cells, 'mean' as actions, 0 as remaining, min(o_orderkey) as first_row from d where o_totalprice is null
union all select 'o_orderpriority', count(*), 'label', 0, min(o_orderkey) from d where o_orderpriority is null
""")
def q_quality_question(spark, sf):
    df = _dirty_orders(spark, sf)
    from proofsheet.operators.profile import infer_columns
    res = C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING))
    return QP.quality_answer(res.actions)


# =============================================================== formulas
from proofsheet.plans import formula as FP  # noqa: E402
from proofsheet.operators import explore as X  # noqa: E402

LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("formula_ratio", f"""
select 'margin' as name, 'l_tax / l_quantity * 100' as expression,
  round({dsum('l_tax')} / {dsum('l_quantity')} * 100, 6) as value, 'percent' as format, true as verified,
  cast(null as varchar) as error from lineitem
""")
def q_formula_ratio(spark, sf):
    return FP.execute_formula(T(spark, sf, "lineitem"), "margin = l_tax / l_quantity * 100", LINEITEM_MEASURES)


@register("formula_grouped", f"""
select l_returnflag, 'net' as name, 'l_extendedprice - l_discount' as expression,
  round({dsum('l_extendedprice')} - {dsum('l_discount')}, 6) as value, 'decimal' as format, true as verified,
  cast(null as varchar) as error from lineitem group by l_returnflag
""")
def q_formula_grouped(spark, sf):
    return FP.execute_formula(T(spark, sf, "lineitem"), "net = l_extendedprice minus l_discount", LINEITEM_MEASURES,
                              group_by=["l_returnflag"])


@register("formula_zero_denominator", f"""
select l_linestatus, 'share' as name, 'l_tax / l_discount' as expression,
  case when abs(sum(l_discount)) <= 1e-12 then null else round({dsum('l_tax')} / {dsum('l_discount')}, 6) end as value,
  'decimal' as format,
  case when abs(sum(l_discount)) <= 1e-12 then null else true end as verified_flag,
  case when abs(sum(l_discount)) <= 1e-12 then 'zero denominator or non-finite result' end as error
from (select l_linestatus, l_tax, case when l_linestatus = 'O' then 0.0 else l_discount end as l_discount from lineitem)
group by l_linestatus
""")
def q_formula_zero(spark, sf):
    li = T(spark, sf, "lineitem").withColumn(
        "l_discount", F.when(F.col("l_linestatus") == "O", F.lit(0.0)).otherwise(F.col("l_discount")))
    out = FP.execute_formula(li, "share = l_tax / l_discount", LINEITEM_MEASURES, group_by=["l_linestatus"])
    return out.select("l_linestatus", "name", "expression", "value", "format",
                      F.when(F.col("error").isNull(), F.col("verified")).alias("verified_flag"), "error")


# =============================================================== explore
@register("explore_bar", f"""
select event_type as label, {dsum('value')} as value from events
where event_type is not null and trim(event_type) <> '' and value is not null
group by 1 order by value desc, label limit 10
""")
def q_explore_bar(spark, sf):
    return X.explore(T(spark, sf, "events"), "event_type", "value", "bar")


@register("explore_line", f"""
select cast(l_linenumber as varchar) as label, {dsum('l_quantity')} as value from lineitem
where l_quantity is not null group by 1 order by try_cast(label as double), label limit 24
""")
def q_explore_line(spark, sf):
    return X.explore(T(spark, sf, "lineitem"), "l_linenumber", "l_quantity", "line")


@register("rollup_charts", f"""
with t as {MONTHS_SQL}
select * from (select 'category' as chart, o_orderpriority as label, {dsum('o_totalprice')} as value from orders where o_orderpriority is not null
  group by 2 order by value desc nulls last, label limit 8)
union all select 'trend', period, value_0 from t
union all select 'filter', o_orderstatus, cast(min(o_orderkey) as double) from orders where o_orderstatus is not null group by 2
""")
def q_rollup_charts(spark, sf):
    o = T(spark, sf, "orders").withColumn("__source_row", F.col("o_orderkey"))
    cube = R.roll_up(o, [["o_orderpriority"], ["__month"], ["o_orderstatus"]], ["o_totalprice"], {"__month": period_label(F.col("o_orderdate"))})
    top, tr, values = cube.category_topk("o_orderpriority", ["o_totalprice"]), cube.trend(["__month"], ["o_totalprice"]), cube.first_values("o_orderstatus")
    return top.select(F.lit("category").alias("chart"), F.col("category").alias("label"), F.col("value_0").alias("value")).unionByName(
        tr.select(F.lit("trend").alias("chart"), F.col("period").alias("label"), F.col("value_0").alias("value"))).unionByName(
        values.select(F.lit("filter").alias("chart"), F.col("value").alias("label"), F.col("__first").cast("double").alias("value")))


@register("rollup_selection", f"""
with s as (select * from lineitem where l_linestatus = 'F' and l_returnflag = 'R'),
l as (select cast(l_linenumber as varchar) as label, {dsum('l_quantity')} as value from s where l_quantity is not null and l_linenumber is not null
  group by 1 order by try_cast(label as double), label limit 24)
select 'line' as answer, label, value from l
union all select 'rows', null, cast(count(*) as double) from s
union all select 'average', null, coalesce({davg('l_extendedprice')}, 0) from s
union all select 'max', null, max(l_extendedprice) from s
""")
def q_rollup_selection(spark, sf):
    cube = R.roll_up(T(spark, sf, "lineitem"), [["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag", "l_linestatus"]],
                     ["l_quantity", "l_extendedprice"])
    sel = {"l_returnflag": "R", "l_linestatus": "F"}
    parts = [cube.explore("l_linenumber", "l_quantity", "line", sel).select(F.lit("line").alias("answer"), "label", "value"),
             cube.kpi("count", None, sel).select(F.lit("rows").alias("answer"), F.lit(None).cast("string").alias("label"), "value"),
             cube.kpi("average", "l_extendedprice", sel).select(F.lit("average").alias("answer"), F.lit(None).cast("string").alias("label"), "value"),
             cube.selection_range("l_extendedprice", sel).select(F.lit("max").alias("answer"), F.lit(None).cast("string").alias("label"), F.col("max_value").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("selection_range", f"""
select min(l_extendedprice) as min_value, {davg('l_extendedprice')} as avg_value, max(l_extendedprice) as max_value
from lineitem where l_returnflag = 'R'
""")
def q_selection_range(spark, sf):
    return X.selection_range(T(spark, sf, "lineitem"), "l_extendedprice", {"l_returnflag": "R", "l_linestatus": ""})


@register("kpi_under_selection", f"""
select coalesce({dsum('o_totalprice')}, 0) as value from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'
""")
def q_kpi_selection(spark, sf):
    return X.kpi_under_selection(T(spark, sf, "orders"), "sum", "o_totalprice",
                                 {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@register("global_search", """
select c_custkey from customer where contains(lower(concat_ws(chr(1), cast(c_custkey as varchar), c_name,
  cast(c_nationkey as varchar), cast(c_acctbal as varchar), c_mktsegment)), 'build')
""")
def q_global_search(spark, sf):
    return X.global_search(T(spark, sf, "customer"), "BUILD").select("c_custkey")


@register("sorted_page", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 50 offset 100
""")
def q_sorted_page(spark, sf):
    o = T(spark, sf, "orders").withColumn("__source_row", F.col("o_orderkey"))
    return X.sorted_page(o, "o_totalprice", True, page=2).select("o_orderkey", "o_totalprice")


@register("page_after_key", """
select o_orderkey, o_totalprice from orders where o_totalprice is not null order by o_totalprice, o_orderkey limit 50 offset 120
""")
def q_page_after(spark, sf):
    """The page behind the last row of another page, found by its key."""
    o = T(spark, sf, "orders").where("o_totalprice is not null").withColumn("__source_row", F.col("o_orderkey"))
    pages = X.PageDirectory(o.select("o_orderkey", "o_totalprice", "__source_row"), "o_totalprice")
    last = pages.page(11, 10).orderBy(F.col("o_totalprice").desc(), F.col("__source_row").desc()).first()  # one row
    return pages.after(last["o_totalprice"], last["__source_row"]).select("o_orderkey", "o_totalprice")


@register("analyze_profile", """
select 'o_orderkey' as name, count(distinct o_orderkey) as unique_count, true as unique_exact from orders
union all select 'o_custkey', count(distinct o_custkey), true from orders
union all select 'o_totalprice', count(distinct o_totalprice), true from orders
union all select 'o_orderdate', count(distinct o_orderdate), true from orders
""")
def q_analyze_profile(spark, sf):
    """The distinct counts that the end-to-end job itself decides on."""
    from proofsheet.plans.analysis import analyze
    result = analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    named = F.col("name").isin("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return result.profile.where(named).select("name", "unique_count", "unique_exact")


@register("delimited_scan_quoted", """
select doc_id, md5(case when regexp_full_match(text, '[\\x09-\\x0D\\x1C-\\x20\\x85\\p{Z}]*') then '' else text end) as text_md5,
  lang from documents
""")
def q_delimited_scan(spark, sf):
    """The documents written as quoted CSV, line ends inside fields, and read back in byte ranges."""
    import uuid

    from proofsheet.session import checkpoint_dir
    from proofsheet.sources.delimited import read_delimited
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    (T(spark, sf, "documents").select(F.col("doc_id").cast("string"), "lang", "text").write.option("header", True).option("quoteAll", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_delimited(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang")


@register("repaired_cells", f"""
with d as {DIRTY_ORDERS_SQL}
select o_orderkey, concat_ws(',', case when o_orderpriority is null then 'o_orderpriority' end,
  case when o_totalprice is null then 'o_totalprice' end) as repaired
from d where o_orderpriority is null or o_totalprice is null
""")
def q_repaired_cells(spark, sf):
    df = _dirty_orders(spark, sf)
    from proofsheet.operators.profile import infer_columns
    res = C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING))
    out = X.repaired_cells(res.cleaned, res.actions)
    return out.where(F.size("repaired_columns") > 0).select("o_orderkey", F.array_join("repaired_columns", ",").alias("repaired"))


# =============================================================== remaining inventory
from proofsheet.operators.positions import with_row_index, exact_quantiles  # noqa: E402
from proofsheet.functions.expr import display_number, day_label  # noqa: E402


@register("row_index", """
select count(*) as n, 2 as first_row, count(*) + 1 as last_row, count(*) as distinct_rows from lineitem
""")
def q_row_index(spark, sf):
    df = with_row_index(T(spark, sf, "lineitem").select("l_orderkey"), "__source_row", 2)
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("__source_row").alias("first_row"),
                  F.max("__source_row").alias("last_row"), F.countDistinct("__source_row").alias("distinct_rows"))


@register("sample_values", """
with c as (select * from customer),
s as (
  select 0 as ordinal, cast(c_custkey as varchar) as v, c_custkey as o from c
  union all select 1, c_name, c_custkey from c union all select 2, cast(c_nationkey as varchar), c_custkey from c
  union all select 3, cast(c_acctbal as varchar), c_custkey from c union all select 4, c_mktsegment, c_custkey from c),
r as (select ordinal, v, o, row_number() over (partition by ordinal order by o) as rn from s where v is not null)
select ordinal, string_agg(v, '|' order by o) as sample_values from r where rn <= 3 group by ordinal
""")
def q_sample_values(spark, sf):
    c = T(spark, sf, "customer")
    out = P.sample_values(c, c.columns, "c_custkey")
    return out.select("ordinal", F.array_join("sample_values", "|").alias("sample_values"))


@register("filter_values", """
select * from (
  select 'o_orderstatus' as "column", o_orderstatus as value, min(o_orderkey) as first_row from orders where o_orderstatus is not null group by 2
  order by first_row limit 30)
union all select * from (
  select 'o_orderpriority', o_orderpriority, min(o_orderkey) from orders where o_orderpriority is not null group by 2
  order by 3 limit 30)
""")
def q_filter_values(spark, sf):
    from proofsheet.plans.question import build_catalog
    o = T(spark, sf, "orders").withColumn("__source_row", F.col("o_orderkey"))
    prof = [ColumnProfile("o_orderstatus", "category", "dimension"), ColumnProfile("o_orderpriority", "category", "dimension")]
    d = build_catalog(o, prof).dictionary
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy("first_row")
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 30).select("column", "value", "first_row")


def _text_measure_view(spark, sf):
    o = T(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("__source_row"), F.col("o_orderstatus").alias("status"),
                    _money_text(F.col("o_orderkey"), F.col("o_totalprice")).alias("amount"))


@register("quality_invalid_text", """
select count(*) as row_count, 2 as column_count, 0 as missing_cells, 0.0 as missing_rate,
  (select coalesce(sum(c - 1), 0) from (select count(*) c from orders group by o_orderstatus,
     case when o_orderkey % 31 = 0 then 'n/a' when o_orderkey % 37 = 0 then '12abc'
          when o_orderkey % 5 = 0 then '(' || cast(cast(o_totalprice as decimal(18,2)) as varchar) || ')'
          else '$' || cast(cast(o_totalprice as decimal(18,2)) as varchar) || ' USD' end)) as duplicate_rows,
  count_if(o_orderkey % 31 = 0 or o_orderkey % 37 = 0) as invalid_values
from orders
""")
def q_quality_invalid(spark, sf):
    df = _text_measure_view(spark, sf)
    prof = [ColumnProfile("status", "category", "dimension"), ColumnProfile("amount", "number", "measure")]
    return Q.quality_report(df, prof).select("row_count", "column_count", "missing_cells", "missing_rate",
                                             "duplicate_rows", "invalid_values")


# A text view of the order dates: one column mostly ISO, one mostly day/month, with cells of the other form among them.
MIXED_DATES_SQL = """(select o_orderkey as id,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%Y-%m-%d') end as opened,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 7 = 3 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d/%m/%Y') end as closed
  from orders)"""


def _mixed_dates(spark, sf):
    k = F.col("o_orderkey")
    iso, day_first = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    return T(spark, sf, "orders").select(
        k.alias("__source_row"), k.alias("id"),
        F.when(k % 11 == 0, None).when(k % 7 == 0, day_first).otherwise(iso).alias("opened"),
        F.when(k % 13 == 0, None).when(k % 7 == 3, iso).otherwise(day_first).alias("closed"))


MIXED_PROFILES = [ColumnProfile("id", "number", "identifier"), ColumnProfile("opened", "date", "date"), ColumnProfile("closed", "date", "date")]

#: A column's form from its first cell: ISO, else month first where that reads it, else day first.
_FORM_SQL = """case when try_strptime(v, '%Y-%m-%d') is not null then 'yyyy-M-d' when try_strptime(v, '%m/%d/%Y') is not null then 'M/d/yyyy'
  when try_strptime(v, '%d/%m/%Y') is not null then 'd/M/yyyy' end"""
_READ_SQL = """case (select form from f where f."column" = '{c}') when 'yyyy-M-d' then try_strptime({c}, '%Y-%m-%d')
  when 'M/d/yyyy' then try_strptime({c}, '%m/%d/%Y') when 'd/M/yyyy' then try_strptime({c}, '%d/%m/%Y') end"""
_FORMS_SQL = f"""d as {MIXED_DATES_SQL},
x as (select 'opened' as "column", (select arg_min(opened, id) from d where opened is not null) as v
  union all select 'closed', (select arg_min(closed, id) from d where closed is not null)),
f as (select "column", v, {_FORM_SQL} as form from x)"""


@register("date_format_per_column", f"""
with {_FORMS_SQL}
select 'opened' as "column", (select v from f where "column" = 'opened') as first_value, (select form from f where "column" = 'opened') as format,
  count(opened) as texts, count({_READ_SQL.format(c='opened')}) as fitting from d
union all select 'closed', (select v from f where "column" = 'closed'), (select form from f where "column" = 'closed'),
  count(closed), count({_READ_SQL.format(c='closed')}) from d
""")
def q_date_formats(spark, sf):
    return P.date_formats(_mixed_dates(spark, sf), ["opened", "closed"]).drop("scores")


@register("dates_by_column_format", f"""
with {_FORMS_SQL}
select id, strftime({_READ_SQL.format(c='opened')}, '%Y-%m-%d') as opened, strftime({_READ_SQL.format(c='closed')}, '%Y-%m-%d') as closed from d
""")
def q_dates_by_format(spark, sf):
    work = C.clean_dataset(_mixed_dates(spark, sf), MIXED_PROFILES).cleaned
    return work.select("id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("opened", "closed")])


@register("date_coercion_counts", f"""
with {_FORMS_SQL},
r as (select opened, closed, {_READ_SQL.format(c='opened')} as po, {_READ_SQL.format(c='closed')} as pc from d)
select count(po) + count(pc) as date_conversions,
  count_if(opened is not null and po is null) + count_if(closed is not null and pc is null) as invalid_date_cells from r
""")
def q_date_counts(spark, sf):
    return C.clean_dataset(_mixed_dates(spark, sf), MIXED_PROFILES).counters.select("date_conversions", "invalid_date_cells")


@register("quality_notes", """
select 0 as ordinal, cast(count(*) as varchar) || ' missing cells found.' as note from orders where o_orderkey % 17 = 0 or o_orderkey % 23 = 0
""")
def q_quality_notes(spark, sf):
    df = _dirty_orders(spark, sf).drop("o_totalprice", "o_orderpriority").withColumn(
        "flag", F.when((F.col("o_orderkey") % 17 == 0) | (F.col("o_orderkey") % 23 == 0), F.lit(None)).otherwise(F.lit("x")))
    prof = [ColumnProfile("o_orderkey", "text", "identifier"), ColumnProfile("o_orderstatus", "category", "dimension"),
            ColumnProfile("o_orderdate", "date", "date"), ColumnProfile("flag", "category", "dimension")]
    return Q.quality_notes(Q.quality_report(df, prof))


@register("quality_readings", f"""
with f as (select quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3 from orders),
o as (select count_if(o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as n from orders, f)
select 'rows.total' as key, cast(count(*) as double) as value from orders
union all select 'quality.score', greatest(0, 100 - least(100, round((select n from o)))) union all select 'quality.missing', 0.0
union all select 'quality.duplicates', 0.0 union all select 'quality.completeness', 100.0
union all select 'quality.invalid', 0.0 union all select 'quality.outliers', cast((select n from o) as double)
""")
def q_quality_readings(spark, sf):
    from proofsheet.operators.profile import infer_columns
    o = T(spark, sf, "orders")
    return Q.quality_readings(Q.quality_report(o, infer_columns(o, ORDERS_MAPPING)))


@register("fallback_chart", """
select 'quality-overview' as chart_id, 0 as ordinal, 'quality.score' as label, 100.0 as value
union all select 'quality-overview', 0, 'quality.missing', 0.0
union all select 'quality-overview', 0, 'quality.duplicates', cast(count(*) - count(distinct r_name) as double) from region
""")
def q_fallback_chart(spark, sf):
    from proofsheet.plans.analysis import analyze
    r = T(spark, sf, "region")
    res = analyze(r, {"r_regionkey": "identifier", "r_name": "dimension"}, source_row="r_regionkey")
    return res.charts.drop("chart_order", "series", "result_ref")


@register("kpi_fallback", f"""
with d as (select l_discount as discount_rate from lineitem)
select 'metric.average.discount_rate' as key, round({davg('discount_rate')}, 2) as value from d
union all select 'metric.max.discount_rate', round(max(discount_rate), 2) from d
union all select 'metric.min.discount_rate', round(min(discount_rate), 2) from d
union all select 'metric.fallback.sum.discount_rate', round({dsum('discount_rate')}, 2) from d
""")
def q_kpi_fallback(spark, sf):
    d = T(spark, sf, "lineitem").select(F.col("l_discount").alias("discount_rate"))
    res, _ = M.kpi_frame(d, ["discount_rate"])
    return res.where(F.col("key") != "rows.total").select("key", "value")


@register("insight_completion", """
select 25 as insights, 25 as distinct_titles, 0 as unreferenced
""")
def q_insight_completion(spark, sf):
    from proofsheet.plans.analysis import analyze
    res = analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    ins = res.insights
    unref = VF.missing_refs(ins.select("result_refs"), res.results).count()
    return ins.agg(F.count(F.lit(1)).alias("insights"), F.countDistinct("title").alias("distinct_titles"),
                   F.lit(unref).alias("unreferenced"))


@register("numeric_provenance", """
select 'x' as raw where false
""")
def q_provenance(spark, sf):
    from proofsheet.plans.analysis import analyze
    res = analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    texts = res.results.select(F.format_string("The value is %s.", F.col("value").cast("string")).alias("text"))
    return VF.unproven_numbers(texts, res.results)


@register("verified_summary", """
select 'metric-o_totalprice' as id, 1 as n_values union all select 'average-o_totalprice', 1
union all select 'max-o_totalprice', 1 union all select 'min-o_totalprice', 1
""")
def q_verified_summary(spark, sf):
    from proofsheet.plans.analysis import analyze
    res = analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")
    items = res.kpis.select("id", F.array("result_ref").alias("result_refs"))
    return VF.verified_summary(items, res.results).select("id", F.size("values").alias("n_values"))


@register("display_numbers", f"""
select o_orderstatus, case when abs(v) >= 1e9 then format('{{:,.2f}}', v / 1e9) || ' billion'
  when abs(v) >= 1e6 then format('{{:,.2f}}', v / 1e6) || ' million' else format('{{:,.2f}}', v) end || ' SAR' as shown
from (select o_orderstatus, {dsum('o_totalprice')} as v from orders group by 1)
""")
def q_display_numbers(spark, sf):
    o = T(spark, sf, "orders").groupBy("o_orderstatus").agg(M.exact_sum(F.col("o_totalprice")).alias("v"))
    return o.select("o_orderstatus", display_number(F.col("v"), "SAR").alias("shown"))


@register("preview_rows", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_totalprice from orders
""")
def q_preview_rows(spark, sf):
    o = T(spark, sf, "orders")
    return o.select("o_orderkey", day_label(F.col("o_orderdate")).alias("o_orderdate"), "o_totalprice")


@register("preview_repaired", f"""
with d as {DIRTY_ORDERS_SQL}, m as (select {dsum('o_totalprice')} / count(o_totalprice) as mean from d)
select o_orderkey, round(coalesce(o_totalprice, (select mean from m)), 6) as o_totalprice, coalesce(o_orderpriority, 'غير محدد') as o_orderpriority,
  concat_ws(',', case when o_orderpriority is null then 'o_orderpriority' end, case when o_totalprice is null then 'o_totalprice' end) as repaired
from d
""")
def q_preview_repaired(spark, sf):
    from proofsheet.operators.profile import infer_columns
    from proofsheet.plans.store import preview
    df = _dirty_orders(spark, sf)
    shown = preview(C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING)), ORDERS_MAPPING).rows
    return shown.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderpriority", F.array_join("repaired_columns", ",").alias("repaired"))


@register("preview_profile", f"""
with d as {DIRTY_ORDERS_SQL}, m as (select {dsum('o_totalprice')} / count(o_totalprice) as mean from d)
select 'o_totalprice' as name, 'measure' as semantic_role, 0 as null_count,
  (select count(distinct coalesce(o_totalprice, (select mean from m))) from d) as unique_count
union all select 'o_orderpriority', 'dimension', 0, (select count(distinct coalesce(o_orderpriority, 'غير محدد')) from d)
""")
def q_preview_profile(spark, sf):
    from proofsheet.operators.profile import infer_columns
    from proofsheet.plans.store import preview
    df = _dirty_orders(spark, sf)
    profile = preview(C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING)), ORDERS_MAPPING).profile
    return profile.where(F.col("name").isin("o_totalprice", "o_orderpriority")).select("name", "semantic_role", "null_count", "unique_count")


@register("cleaned_copy_reused", f"""
select run, run = 2 as reused, (select count(*) from orders) as output_rows, (select {dsum('o_totalprice')} from orders) as total
from (values (1), (2)) v(run)
""")
def q_cleaned_copy(spark, sf):
    import uuid
    from proofsheet.plans.store import cleaned_copy
    from proofsheet.session import checkpoint_dir
    store = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    parts = []
    for run in (1, 2):
        res, reused = cleaned_copy(spark, store, f"{sf}/orders.parquet", ORDERS_MAPPING, source_row="o_orderkey")
        parts.append(res.cleaned.agg(F.lit(run).alias("run"), F.lit(reused).alias("reused"), F.count(F.lit(1)).alias("output_rows"),
                                     M.aggregate("sum", F.col("o_totalprice")).alias("total")))
    return parts[0].unionByName(parts[1])


@register("audit_summary", f"""
with d as {DIRTY_ORDERS_SQL}
select 'The working copy was cleaned: found ' || cast(count_if(o_totalprice is null) + count_if(o_orderpriority is null) as varchar)
  || ' missing values, treated ' || cast(count_if(o_totalprice is null) + count_if(o_orderpriority is null) as varchar)
  || ' missing values under a documented policy; the source file was not changed.' as summary from d
""")
def q_audit_summary(spark, sf):
    from proofsheet.operators.profile import infer_columns
    df = _dirty_orders(spark, sf)
    return C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING)).summary().select("summary")


@register("role_inference", """
with s as (select count(*) n, count(distinct o_orderstatus) d2, count(distinct o_orderpriority) d5 from orders)
select 'o_orderkey' as name, 'number' as inferred_type, 'measure' as semantic_role, false as ambiguous
union all select 'o_custkey', 'number', 'measure', false
union all select 'o_orderstatus', case when (select d2 from s) <= greatest(20, (select n from s) * 0.2) then 'category' else 'text' end, 'unknown', true
union all select 'o_totalprice', 'number', 'measure', false
union all select 'o_orderdate', 'date', 'date', false
union all select 'o_orderpriority', case when (select d5 from s) <= greatest(20, (select n from s) * 0.2) then 'category' else 'text' end, 'unknown', true
""")
def q_role_inference(spark, sf):
    prof = P.infer_columns(T(spark, sf, "orders"))
    return spark.createDataFrame([(p.name, p.inferred_type, p.semantic_role, p.ambiguous) for p in prof],
                                 "name string, inferred_type string, semantic_role string, ambiguous boolean")


@register("ambiguity_gate", """
with s as (select count(*) n, count(distinct event_type) d3, count(distinct props) d5 from events)
select 3 as ordinal, 'event_type' as name, case when d3 <= greatest(20, n * 0.2) then 'category' else 'text' end as inferred_type from s
union all select 5, 'props', case when d5 <= greatest(20, n * 0.2) then 'category' else 'text' end from s
""")
def q_ambiguity_gate(spark, sf):
    ev = T(spark, sf, "events")
    return P.ambiguities(P.profile_frame(spark, P.infer_columns(ev))).select("ordinal", "name", "inferred_type")


@register("median_by_type", """
select event_type, 0.5 as p, quantile_cont(value, 0.5) as q from events group by 1
""")
def q_median_by_type(spark, sf):
    return exact_quantiles(T(spark, sf, "events"), "value", [0.5], ["event_type"])


@register("delete_rows", f"""
select count(*) as rows, {dsum('o_totalprice')} as total from orders where o_orderstatus <> 'P'
""")
def q_delete_rows(spark, sf):
    o = T(spark, sf, "orders").withColumn("__source_row", F.col("o_orderkey"))
    chosen = o.where(F.col("o_orderstatus") == "P").select("__source_row")
    kept = C.delete_rows(o, chosen)
    return kept.agg(F.count(F.lit(1)).alias("rows"), M.exact_sum(F.col("o_totalprice")).alias("total"))


@register("manual_overrides", """
select o_orderkey, o_totalprice, o_orderpriority from orders
""")
def q_manual_overrides(spark, sf):
    from proofsheet.operators.profile import infer_columns
    df = _dirty_orders(spark, sf)
    o = T(spark, sf, "orders")
    ov = (o.where(F.col("o_orderkey") % 17 == 0)
            .select(F.lit("o_totalprice").alias("column"), F.col("o_orderkey").alias("source_row"),
                    F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"))
            .unionByName(o.where(F.col("o_orderkey") % 23 == 0)
                         .select(F.lit("o_orderpriority").alias("column"), F.col("o_orderkey").alias("source_row"),
                                 F.col("o_orderpriority").alias("value"))))
    res = C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING), mode="manual", overrides=ov)
    return res.cleaned.select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("cross_filter", f"""
select count(*) as rows, {dsum('o_totalprice')} as total from orders where cast(o_orderpriority as varchar) = '1-URGENT'
""")
def q_cross_filter(spark, sf):
    o = X.cross_filter(T(spark, sf, "orders"), "o_orderpriority", "1-URGENT")
    return o.agg(F.count(F.lit(1)).alias("rows"), M.exact_sum(F.col("o_totalprice")).alias("total"))


@register("question_average", f"""
select coalesce({davg('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s where year = 2000 and brand = 'Brand#8'
""")
def q_question_average(spark, sf):
    return ask(spark, sf, "What is the average revenue of Brand#8 2000?")[2]


@register("question_maximum", f"""
select coalesce(max(revenue), 0) as value, count(revenue) as rows from {SALES_SQL} s where brand = 'Brand#9'
""")
def q_question_maximum(spark, sf):
    # the measure is chosen by the revenue/e-commerce/percent score, not by naming a column
    return ask(spark, sf, "maximum revenue of Brand#9")[2]


@register("question_minimum_by_quarter", f"""
select row_number() over (order by value desc, label) - 1 as ordinal, label, value, rows from (
  select quarter as label, coalesce(min(revenue), 0) as value, count(revenue) as rows from {SALES_SQL} s
  group by 1 order by value desc, label limit 10)
""")
def q_question_minimum(spark, sf):
    return ask(spark, sf, "Compare minimum revenue by quarter")[2]


# =============================================================== text tables
@register("profile_documents", """
with s as (select count(*) rows, count(*) - count(text) n1, count(*) - count(lang) n2, count(*) - count(source) n3,
  count(*) - count(n_chars) n4, count(distinct doc_id) d0, count(distinct text) d1, count(distinct lang) d2,
  count(distinct source) d3, count(distinct n_chars) d4 from documents)
select 0 as ordinal, 'doc_id' as "column", rows, 0::bigint as null_count, rows as present_count, null::bigint as numeric_count, d0 as unique_count from s
union all select 1, 'text', rows, n1, rows - n1, 0, d1 from s
union all select 2, 'lang', rows, n2, rows - n2, 0, d2 from s
union all select 3, 'source', rows, n3, rows - n3, 0, d3 from s
union all select 4, 'n_chars', rows, n4, rows - n4, null, d4 from s
""")
def q_profile_documents(spark, sf):
    return P.column_stats(T(spark, sf, "documents"), distinct="exact").drop("unique_exact")


CONV_PROFILES = [ColumnProfile("conv_id", "text", "identifier"), ColumnProfile("turn", "number", "measure"),
                 ColumnProfile("role", "category", "dimension"), ColumnProfile("text", "text", "unknown")]


@register("quality_report_conversations", """
with f as (select quantile_cont(turn, 0.25) q1, quantile_cont(turn, 0.75) q3, count(turn) n from conversations),
o as (select case when (select n from f) >= 4 and q3 - q1 > 0
        then count_if(turn < q1 - 1.5 * (q3 - q1) or turn > q3 + 1.5 * (q3 - q1)) else 0 end as outliers from conversations, f group by q1, q3),
d as (select coalesce(sum(c - 1), 0) as dups from (select count(*) c from conversations group by conv_id, turn, role, text))
select count(*) as row_count, 4 as column_count, 0 as missing_cells, 0.0 as missing_rate, (select dups from d) as duplicate_rows,
  0 as invalid_values, (select outliers from o) as outlier_count,
  count_if(regexp_matches(role, '^[=+\\-@]')) + count_if(regexp_matches(text, '^[=+\\-@]')) as formula_like_cells
from conversations
""")
def q_quality_conversations(spark, sf):
    rep = Q.quality_report(T(spark, sf, "conversations"), CONV_PROFILES)
    return rep.select("row_count", "column_count", "missing_cells", "missing_rate", "duplicate_rows",
                      "invalid_values", "outlier_count", "formula_like_cells")


@register("dedupe_conversations", """
select min(conv_id * 1000 + turn) as source_row, count(*) - 1 as removed from conversations group by role, text
""")
def q_dedupe_conversations(spark, sf):
    c = T(spark, sf, "conversations")
    df = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("__source_row"), "role", "text")
    return drop_dup_frame(df)


def drop_dup_frame(df):
    kept = C.drop_duplicates_keep_first(df)
    return kept.select(F.col("__source_row").alias("source_row"), F.col("__dups").alias("removed"))


@register("category_topk_events", f"""
select row_number() over (order by value_0 desc nulls last, category) - 1 as rank, category, value_0 from (
  select cast(event_type as varchar) as category, {dsum('value')} as value_0
  from events where event_type is not null group by 1 order by value_0 desc nulls last, category limit 8)
""")
def q_category_topk_events(spark, sf):
    return M.category_topk(T(spark, sf, "events"), "event_type", ["value"])


@register("explore_conversations", f"""
select role as label, {dsum('turn')} as value from conversations
where role is not null and trim(role) <> '' and turn is not null group by 1 order by value desc, label limit 10
""")
def q_explore_conversations(spark, sf):
    return X.explore(T(spark, sf, "conversations"), "role", "turn", "bar")


# --------------------------------------------------------------- values and cardinalities that a cut would lose
@register("sum_small_values", """
select l_returnflag, round(sum(l_quantity * 1e-9) * 1e6, 6) as total, round(avg(l_quantity * 1e-9) * 1e9, 6) as mean
from lineitem group by 1
""")
def q_sum_small_values(spark, sf):
    small = T(spark, sf, "lineitem").withColumn("v", F.col("l_quantity") * 1e-9)
    return small.groupBy("l_returnflag").agg(F.round(M.aggregate("sum", F.col("v")) * 1e6, 6).alias("total"),
                                             F.round(M.aggregate("average", F.col("v")) * 1e9, 6).alias("mean"))


@register("profile_default_distinct", """
select 'l_orderkey' as "column", count(distinct l_orderkey) as unique_count from lineitem
union all select 'l_partkey', count(distinct l_partkey) from lineitem
union all select 'l_extendedprice', count(distinct l_extendedprice) from lineitem
""")
def q_profile_default_distinct(spark, sf):
    return P.column_stats(T(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_extendedprice"]).select("column", "unique_count")


@register("sequential_id_long_digits", """
select o_orderkey, 'DOC-9' || lpad(cast(row_number() over (order by o_orderkey) - 1 as varchar), 20, '0') as code from orders
""")
def q_sequential_id_long_digits(spark, sf):
    from proofsheet.operators import clean as C
    from proofsheet.operators.positions import with_row_index
    rows = with_row_index(T(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey"), C.SRC, 0)
    code = F.concat(F.lit("DOC-9"), F.lpad(F.col(C.SRC).cast("string"), 20, "0"))
    gaps = rows.withColumn("code", F.when(F.col(C.SRC) % 7 == 3, None).otherwise(code))
    return C.sequential_identifier(gaps, "code")[0].select("o_orderkey", "code")


@register("question_compare_two_with_year", f"""
select row_number() over (order by value desc, label) - 1 as ordinal, label, value, rows from (
  select brand as label, coalesce({dsum('revenue')}, 0) as value, count(revenue) as rows from {SALES_SQL} s
  where year = 1996 and brand in ('Brand#1', 'Brand#2') group by 1)
""")
def q_question_compare_two_with_year(spark, sf):
    return ask(spark, sf, "Compare the revenue of Brand#1 and Brand#2 in year 1996")[2]


# =============================================================== answers
from proofsheet.plans import answers as AN  # noqa: E402

#: Sales of which one brand has no row in 2000 and another no revenue in its first year.
ANSWER_SALES_SQL = f"""(select brand, year, quarter, case when brand = 'Brand#8' and year = 1995 then 0 else revenue end as revenue, quantity
  from {SALES_SQL} x where not (brand = 'Brand#9' and year = 2000))"""


def shown_sql(v: str) -> str:
    return f"""(case when abs({v}) >= 1e9 then format('{{:,.2f}}', {v} / 1e9) || ' billion'
      when abs({v}) >= 1e6 then format('{{:,.2f}}', {v} / 1e6) || ' million' else format('{{:,.2f}}', {v}) end || ' USD')"""


def answer_sales(spark, sf, question):
    df = brand_sales(spark, sf).where(~((F.col("brand") == "Brand#9") & (F.col("year") == 2000)))
    df = df.withColumn("revenue", F.when((F.col("brand") == "Brand#8") & (F.col("year") == 1995), F.lit(0.0)).otherwise(F.col("revenue")))
    return AN.answer(question, QP.build_catalog(df, SALES_PROFILES), "USD").withColumn("sources", F.array_join("sources", ","))


def refused_sql(question: str, why: str) -> str:
    return f"select '{question}' as question, cast(null as varchar) as answer, cast(null as varchar) as sources, '{why}' as error"


def register_answer(name: str, question: str, sql: str) -> None:
    register(name, sql)(lambda spark, sf: answer_sales(spark, sf, question))


register_answer("answer_two_digit_brand", "What is the total revenue of Brand#12 in 1996?", f"""
select 'What is the total revenue of Brand#12 in 1996?' as question, 'sum of revenue (year=1996; brand=Brand#12): ' || {shown_sql("v")} as answer,
  'revenue,year,brand' as sources, cast(null as varchar) as error
from (select {dsum("revenue")} as v from {ANSWER_SALES_SQL} s where brand = 'Brand#12' and year = 1996)
""")
register_answer("answer_ranking", "Top 3 brands by revenue 2000", f"""
select 'Top 3 brands by revenue 2000' as question, 'ranking of revenue by brand (year=2000): ' ||
  string_agg(n || '. ' || brand || ': ' || {shown_sql("v")}, '; ' order by n) as answer, 'revenue,brand,year' as sources, cast(null as varchar) as error
from (select brand, {dsum("revenue")} as v, row_number() over (order by {dsum("revenue")} desc, brand) as n from {ANSWER_SALES_SQL} s
  where year = 2000 group by brand) where n <= 3
""")
register_answer("answer_comparison", "Compare revenue of Brand#5 and Brand#16", f"""
with c as (select brand, {dsum("revenue")} as v, row_number() over (order by {dsum("revenue")} desc, brand) as n from {ANSWER_SALES_SQL} s
  where brand in ('Brand#5', 'Brand#16') group by brand),
g as (select max(case when n = 1 then v end) - max(case when n = 2 then v end) as gap, max(case when n = 1 then brand end) as leader from c)
select 'Compare revenue of Brand#5 and Brand#16' as question, (select 'comparison of revenue by brand (' ||
  'brand=' || string_agg(brand, ', ' order by first_row) || '): ' from (select brand, min(src) as first_row from {SALES_SQL} s
  where brand in ('Brand#5', 'Brand#16') group by brand)) || (select string_agg(n || '. ' || brand || ': ' || {shown_sql("v")}, '; ' order by n) from c)
  || '; ' || leader || ' leads by ' || {shown_sql("gap")} as answer, 'revenue,brand' as sources, cast(null as varchar) as error from g
""")
register_answer("answer_growth", "Revenue growth of Brand#7 by year", f"""
with g as (select year, {dsum("revenue")} as v from {ANSWER_SALES_SQL} s where brand = 'Brand#7' group by year),
e as (select min(year) as a, max(year) as b, min_by(v, year) as va, max_by(v, year) as vb from g)
select 'Revenue growth of Brand#7 by year' as question, 'revenue changed from ' || {shown_sql("va")} || ' (' || a || ') to ' || {shown_sql("vb")} ||
  ' (' || b || '): ' || format('{{:,.2f}}', (vb - va) / abs(va) * 100) || '% (brand=Brand#7)' as answer, 'revenue,year,brand' as sources, cast(null as varchar) as error from e
""")
for _name, _question, _why in (
        ("answer_no_rows", "What is the total revenue of Brand#9 in 2000?", "no rows match the question"),
        ("answer_one_period", "Revenue growth of Brand#7 in 1996", "a growth needs two groups or more"),
        ("answer_zero_base", "Revenue growth of Brand#8 by year", "a growth rate needs a first period that is not zero"),
        ("answer_unknown_year", "What is the total revenue of Brand#12 in 2030?", "year 2030 is not in the data")):
    register_answer(_name, _question, refused_sql(_question, _why))


@register("answer_data_quality", f"""
with d as {DIRTY_ORDERS_SQL}, n as (select count(*) filter (o_totalprice is null) as t, count(*) filter (o_orderpriority is null) as p from d)
select 'Which values were missing and how was cleaning done?' as question, (t + p) || ' missing cells were found: o_orderpriority (' || p ||
  '), o_totalprice (' || t || '). o_orderpriority: ' || p || ' by label. o_totalprice: ' || t || ' by mean. None remains untreated.' as answer,
  'missing-value audit,imputation policy,cleaned working copy' as sources, cast(null as varchar) as error from n
""")
def q_answer_quality(spark, sf):
    from proofsheet.operators.profile import infer_columns
    df = _dirty_orders(spark, sf)
    res = C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING))
    catalog = QP.Catalog(res.cleaned, res.actions, res.profiles)  # a quality question looks nothing up
    out = AN.answer("Which values were missing and how was cleaning done?", catalog, clean=res)
    return out.withColumn("sources", F.array_join("sources", ","))


@register("quality_rows", f"""
with d as {DIRTY_ORDERS_SQL}, x as (select 'o_totalprice' as "column", 'mean' as strategy, o_orderkey as r from d where o_totalprice is null
  union all select 'o_orderpriority', 'label', o_orderkey from d where o_orderpriority is null)
select "column", strategy, min(r) as first_row, count(*) as cells, string_agg(cast(r as varchar), ',' order by r) as rows
from x group by "column", strategy, r // 1000
""")
def q_quality_rows(spark, sf):
    from proofsheet.operators.profile import infer_columns
    df = _dirty_orders(spark, sf)
    res = C.clean_dataset(df, infer_columns(df, ORDERS_MAPPING))
    return AN.quality_rows(res.actions).withColumn("rows", F.array_join(F.transform("rows", lambda r: r.cast("string")), ","))


# =============================================================== registry values and planted faults
def analysed_orders(spark, sf):
    from proofsheet.plans.analysis import analyze
    return analyze(T(spark, sf, "orders"), ORDERS_MAPPING, source_row="o_orderkey")


STATUS_SQL = f"""(select o_orderstatus as label, {dsum("o_totalprice")} as v,
  row_number() over (order by {dsum("o_totalprice")} desc, o_orderstatus) - 1 as n from orders group by o_orderstatus)"""


@register("registry_values", f"""
with t as (select strftime(o_orderdate, '%Y-%m') as p, {dsum("o_totalprice")} as v from orders group by 1 order by 1 limit 24),
tn as (select p, v, row_number() over (order by p) - 1 as n from t),
tr as (select min_by(v, n) as a, max_by(v, n) as b, avg(v) as m, max(v) as peak from tn),
c as (select * from {STATUS_SQL}),
cs as (select max(case when n = 0 then v end) as lead, max(case when n = 1 then v end) as second, min(v) as low, sum(v) as total from c),
k as (select count(*) as rows, {dsum("o_totalprice")} as s, {davg("o_totalprice")} as a, max(o_totalprice) as hi, min(o_totalprice) as lo from orders),
r as (
select 'chart.trend.0.' || n as key, v as value, 'period_sum' as operation from tn
union all select 'chart.category.0.' || n, v, 'group_sum' from c
union all select 'trend.primary.change', b - a, 'period_change' from tr
union all select 'trend.primary.average', m, 'period_average' from tr
union all select 'trend.primary.change_rate', (b - a) / abs(a) * 100, 'period_change_rate' from tr
union all select 'trend.primary.periods_above_average', (select count(*) from tn where v > m), 'periods_above_average' from tr
union all select 'trend.primary.distance_from_peak', peak - b, 'last_period_distance_from_peak' from tr
union all select 'category.primary.lead_margin', lead - second, 'leader_runner_up_gap' from cs
union all select 'category.primary.gap', lead - low, 'top_bottom_gap' from cs
union all select 'category.primary.top_share', lead / total * 100, 'top_category_share' from cs
union all select 'distribution.primary.spread', hi - lo, 'range_spread' from k
union all select 'distribution.primary.relative_spread', (hi - lo) / abs(a) * 100, 'relative_range_spread' from k
union all select 'rows.total', rows, 'count' from k
union all select 'sum.o_totalprice', s, 'sum' from k
union all select 'metric.average.o_totalprice', a, 'average' from k union all select 'dist.o_totalprice.avg', a, 'average' from k
union all select 'metric.max.o_totalprice', hi, 'max' from k union all select 'dist.o_totalprice.max', hi, 'max' from k
union all select 'metric.min.o_totalprice', lo, 'min' from k union all select 'dist.o_totalprice.min', lo, 'min' from k)
select key, round(value, 2) as value, operation from r
""")
def q_registry_values(spark, sf):
    """The values that the end-to-end job registers (those of the quality report have queries of their own)."""
    return analysed_orders(spark, sf).results.where(~F.col("key").startswith("quality.")).select("key", "value", "operation")


@register("integrity_faults", """
select 'chart' as place, 'chart.trend.0.3' as ref union all select 'kpi', 'sum.o_totalprice'
""")
def q_integrity_faults(spark, sf):
    """Charts and KPIs against a registry that lost one row of each and kept one that nothing refers to."""
    res = analysed_orders(spark, sf)
    kept = res.results.where(~F.col("key").isin("chart.trend.0.3", "sum.o_totalprice")).select("key").unionByName(
        spark.createDataFrame([("nothing refers to this",)], "key string"))
    lost = [VF.missing_refs(frame.select(F.col("result_ref").alias("ref")), kept).distinct().select(F.lit(place).alias("place"), "ref")
            for place, frame in (("chart", res.charts), ("kpi", res.kpis))]
    return lost[0].unionByName(lost[1])


@register("provenance_faults", f"""
select format('{{:.2f}}', v + 0.01) as raw from {STATUS_SQL} where n = 1
""")
def q_provenance_faults(spark, sf):
    """A sentence for each category, one of which quotes a cent too much."""
    res = analysed_orders(spark, sf)
    shown = res.results.where(F.col("key").startswith("chart.category.0.")).select("key", "value")
    said = F.col("value") + F.when(F.col("key") == "chart.category.0.1", F.lit(0.01)).otherwise(F.lit(0.0))
    texts = shown.select(F.format_string("The category «no. 7» reached %.2f.", said).alias("text"))
    return VF.unproven_numbers(texts, res.results)


@register("verified_values", f"""
with k as (select {dsum("o_totalprice")} as s, {davg("o_totalprice")} as a, max(o_totalprice) as hi, min(o_totalprice) as lo from orders)
select 'metric-o_totalprice' as id, 'sum.o_totalprice' as key, round(s, 2) as value, 'sum' as operation from k
union all select 'average-o_totalprice', 'metric.average.o_totalprice', round(a, 2), 'average' from k
union all select 'max-o_totalprice', 'metric.max.o_totalprice', hi, 'max' from k
union all select 'min-o_totalprice', 'metric.min.o_totalprice', lo, 'min' from k
union all select 'min-o_totalprice', 'metric.max.o_totalprice', hi, 'max' from k
""")
def q_verified_values(spark, sf):
    """Each item with the values it refers to; one item refers to a second value and to one that does not exist."""
    res = analysed_orders(spark, sf)
    more = F.when(F.col("id") == "min-o_totalprice", F.array(F.col("result_ref"), F.lit("metric.max.o_totalprice"), F.lit("no such value")))
    items = res.kpis.select("id", F.coalesce(more, F.array("result_ref")).alias("result_refs"))
    out = VF.verified_summary(items, res.results).select("id", F.explode("values").alias("v"))
    return out.select("id", "v.key", "v.value", "v.operation")
