"""Reference SQL (DuckDB dialect) for the registered queries, on the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}


def shown(v: str) -> str:
    """A number as charts write it."""
    return f"case when abs({v}) >= 1000 or {v} = floor({v}) then format('{{:,.0f}}', {v}) else format('{{:,.2f}}', {v}) end"


def whole(v: str) -> str:
    return f"format('{{:,}}', cast({v} as bigint))"


NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def number_of(text: str, shorthand: bool = True) -> str:
    bare = f"regexp_replace({text}, '[$,€£%]', '', 'g')"
    plain = f"case when regexp_matches({bare}, {NUMBER}) then try_cast(trim({bare}) as double) end"
    if not shorthand:
        return plain
    short = r"'^\s*([+-]?\d*\.?\d+)\s*([KkMmBb])\s*$'"
    return (
        f"case when regexp_matches({bare}, {short}) then cast(regexp_extract({bare}, {short}, 1) as double) * "
        f"case upper(regexp_extract({bare}, {short}, 2)) when 'K' then 1e3 when 'M' then 1e6 else 1e9 end "
        f"else {plain} end"
    )


def spread(rows: str, by: str) -> str:
    """Per group: count, extremes, quartiles, trimmed mean and range. ``rows`` has ``by, v``."""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    join = f"using ({by})" if by else "on true"
    return f"""
      q as (select {keys} count(v) n, min(v) v_min, max(v) v_max, sum(v) total, avg(v) mean,
              quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) q2, quantile_cont(v, 0.75) q3
            from {rows} where v is not null {group}),
      t as (select {', '.join('r.' + k.strip() for k in by.split(',')) + ', ' if by else ''}
              avg(v) filter (where q3 = q1 or v between q1 - 3 * (q3 - q1) and q3 + 3 * (q3 - q1)) inner_mean,
              count(*) filter (where q3 <> q1 and (v < q1 - 3 * (q3 - q1) or v > q3 + 3 * (q3 - q1))) n_extreme
            from {rows} r join q {join} where v is not null {'group by ' + ', '.join('r.' + k.strip() for k in by.split(',')) if by else ''}),
      s as (select q.*, coalesce(inner_mean, mean) trimmed, n_extreme,
              case when q3 <> q1 and greatest(v_min, q1 - 3 * (q3 - q1)) < least(v_max, q3 + 3 * (q3 - q1))
                   then greatest(v_min, q1 - 3 * (q3 - q1)) else v_min end lo,
              case when q3 <> q1 and greatest(v_min, q1 - 3 * (q3 - q1)) < least(v_max, q3 + 3 * (q3 - q1))
                   then least(v_max, q3 + 3 * (q3 - q1)) else v_max end hi
            from q join t {join})"""


def long(table: str, columns: list[str], keep: str = "", where: str = "true") -> str:
    keep = f"{keep}, " if keep else ""
    return " union all ".join(
        f"select {keep} '{c}' as measure, cast({c} as double) as v from {table} where {where}" for c in columns
    )


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ANCHOR = "(hi - lo <= 0 or lo <= 0 or lo / (hi - lo) <= 2.0)"

HOLED = """holed as (select c_custkey, case when c_custkey % 6 <> 2 then c_name end c_name,
   case when c_custkey % 3 <> 1 then c_acctbal end c_acctbal, nullif(c_mktsegment, 'MACHINERY') c_mktsegment
   from customer)"""
PRICE = "cast(cast(o_totalprice as decimal(12,2)) as varchar)"
MESSY = f"""messy as (select cast(o_orderkey as varchar) order_id, o_totalprice,
   case when o_orderkey % 4 = 0 then '$' || {PRICE} when o_orderkey % 4 = 1 then {PRICE} || '%'
        when o_orderkey % 50 = 2 then 'unknown' else {PRICE} end total_price,
   cast(o_orderdate as date) ordered,
   case when o_orderkey % 10 = 3 then null else o_orderpriority end priority,
   case when o_orderstatus = 'F' then 'Yes' else 'No' end filled from orders)"""

# --- cleaning -------------------------------------------------------------------------
SQL["numeric_clean_currency"] = f"""
with c as (select o_orderkey, case o_orderkey % 7
    when 0 then '$' || format('{{:,.2f}}', o_totalprice) when 1 then {PRICE} || '%' when 2 then {PRICE} || 'K'
    when 3 then {PRICE} || ' m' when 4 then '€' || {PRICE} when 5 then {PRICE} || ' USD' else {PRICE} end x
  from orders)
select o_orderkey, round({number_of('x')}, 2) amount, round({number_of('x', False)}, 2) disk_size from c"""

SQL["date_parse_mixed"] = """
with c as (select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%m/%d/%y')
    when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%b %d, %Y')
    when 3 then strftime(o_orderdate, '%d-%b-%y') when 4 then strftime(o_orderdate, '%m.%d.%Y') else 'unknown' end x
  from orders)
select o_orderkey, cast(cast(try_strptime(x, ['%m/%d/%y', '%Y-%m-%d', '%b %d, %Y', '%d-%b-%y', '%m.%d.%Y']) as date) as varchar) as day
from c"""

SQL["null_tokens"] = """
select case event_id % 11 when 0 then null when 1 then null when 2 then null when 3 then '-' when 4 then 'unknown'
  else event_type end as cell, count(*) n from events group by 1"""

SQL["truth_words"] = """
select case when quality = 1 then true when toxic = 1 then null else false end as truth, count(*) n
from labels group by 1"""

# --- profile --------------------------------------------------------------------------
SQL["profile_counts"] = f"with {HOLED} " + " union all ".join(
    f"select '{c}' column_name, count({c}) n, count(*) - count({c}) n_null, count(distinct {c}) n_distinct from holed"
    for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
)

_PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
_PART_TEXTS = ["p_name", "p_brand", "p_type"]
PART_TYPES = "with c as (" + " union all ".join(
    f"select '{c}' column_name, {c in _PART_NUMBERS} is_number, count({c}) n, count(*) r, count(distinct {c}) d from part"
    for c in [*_PART_NUMBERS, *_PART_TEXTS]
) + """), typed as (select column_name, case when is_number then 'numeric_measure' when d = 1 then 'constant'
    when d <= 50 and d / n <= 0.5 then 'categorical' else 'free_text' end column_type, d cardinality,
  round(1 - n / r, 3) null_fraction,
  case when is_number or d = 1 then 1.0 else round(least(1.0, 0.5 + abs(d / n - 0.5)), 3) end::double type_confidence,
  case when is_number then 'sum' end agg_kind from c)"""
SQL["profile_types"] = PART_TYPES + " select * from typed"
SQL["profile_types_estimated"] = PART_TYPES + " select column_name, column_type from typed"
SQL["confidence_tiers"] = PART_TYPES + """ select column_name, type_confidence, case when type_confidence >= 0.9 then 'high'
  when type_confidence >= 0.7 then 'medium' else 'low' end tier from typed"""

SQL["profile_text_columns"] = f"""
with {MESSY}, n as (select count(*) r, count(priority) p, sum(case when total_price <> 'unknown' then o_totalprice end) total,
    min(ordered) lo, max(ordered) hi from messy)
select 'order_id' column_name, 'identifier' column_type, 0.0::double null_fraction, null::varchar agg_kind, null::double "sum",
  null::varchar min_date, null::varchar max_date from n
union all select 'total_price', 'numeric_measure', 0.0, 'sum', round(total, 2), null, null from n
union all select 'ordered', 'date', 0.0, null, null, cast(lo as varchar), cast(hi as varchar) from n
union all select 'priority', 'categorical', round(1 - p / r, 3), null, null, null, null from n
union all select 'filled', 'boolean', 0.0, null, null, null, null from n
union all select 'origin', 'constant', 0.0, null, null, null, null from n
union all select 'blank', 'empty', 1.0, null, null, null, null from n"""

SQL["profile_measure_stats"] = f"""
with r as ({long('lineitem', LINE)}), {spread('r', 'measure')}
select measure column_name, round(total, 2) "sum", round(trimmed, 2) mean, round(v_min, 2) "min", round(v_max, 2) "max",
  n_extreme n_extreme_outliers, {ANCHOR} zero_anchor from s"""

SQL["profile_top_values"] = """
with c as (select 'p_brand' column_name, p_brand v, count(*) n from part group by p_brand
  union all select 'p_type', p_type, count(*) from part group by p_type)
select column_name, cast(rk - 1 as integer) rank, v as value, n
from (select *, row_number() over (partition by column_name order by n desc, v) rk from c) where rk <= 10"""

SQL["overrides_applied"] = f"""
with r as (select c_acctbal v from customer), {spread('r', '')}
select 'c_custkey' column_name, 'identifier' column_type, null::varchar agg_kind, null::double mean, true user_corrected, false has_note
union all select 'c_acctbal', 'numeric_measure', 'average', round(trimmed, 2), true, false from s
union all select 'c_name', 'categorical', null, null, true, true
union all select 'c_mktsegment', 'categorical', null, null, true, true
union all select 'c_nationkey', 'numeric_measure', 'sum', (select round(avg(c_nationkey), 2) from customer), false, false"""

SQL["metadata_merge"] = """
select 's_suppkey' column_name, 'S Suppkey' label, 'sum' agg_kind, 0.5::double agg_kind_confidence
union all select 's_name', 'S Name', null, null
union all select 's_nationkey', 'S Nationkey', 'sum', 1.0
union all select 's_acctbal', 'Balance', 'average', 0.5"""

# --- quality --------------------------------------------------------------------------
SQL["missing_report"] = f"with {HOLED}, m as (" + " union all ".join(
    f"select '{c}' column_name, count(*) - count({c}) n_missing, count(*) r from holed"
    for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
) + ") select column_name, n_missing, round(n_missing * 100 / r, 1) pct from m where n_missing > 0"


def repeats(table: str, columns: str) -> str:
    return (f"select cast(sum(n) as bigint) n_rows, cast(sum(n - 1) as bigint) duplicate_rows "
            f"from (select count(*) n from {table} group by {columns})")


SQL["duplicate_rows"] = repeats("documents", "text, lang, source")
SQL["duplicate_rows_small_domain"] = repeats("lineitem", "l_returnflag, l_quantity, l_discount")


def entities(table: str, key: str, others: str) -> str:
    return (f"e as (select {key} k, count(*) n from {table} where {key} is not null group by {key} "
            f"having count(*) >= 2 and count(distinct row({others})) > 1)")


_DOC = entities("documents", "text", "lang, source, n_chars")
ENTITY = "select count(*) n_repeated_values, cast(coalesce(sum(n), 0) as bigint) n_affected_rows from e"
SQL["duplicate_entities"] = f"with {_DOC} {ENTITY}"
SQL["duplicate_entities_hot_key"] = f"with {entities('events', 'user_id', 'event_type, value')} {ENTITY}"
SQL["duplicate_entity_examples"] = f"""with {_DOC}
select k as value, n from e
order by n desc, case when length(k) > 64 then chr(1) || sha256(k) else k end limit 5"""

_FLAGGED = f"with r as (select 'value' measure, value v from events), {spread('r', 'measure')}, " + """
f as (select r.measure, v, n, q2, q1 - 1.5 * (q3 - q1) lower_f, q3 + 1.5 * (q3 - q1) upper_f from r join s using (measure)
      where n >= 5 and q3 <> q1),
o as (select * from f where v < lower_f or v > upper_f)"""
SQL["outlier_report"] = _FLAGGED + """
select measure, count(*) n_outliers, round(count(*) * 100 / any_value(n), 1) pct, round(any_value(lower_f), 2) "lower",
  round(any_value(upper_f), 2) "upper" from o group by measure"""
SQL["outlier_examples"] = _FLAGGED + """
select measure, cast(rk as integer) rank, round(v, 2) as value from
 (select *, row_number() over (partition by measure order by abs(v - q2) desc, v) rk from o) where rk <= 5"""
SQL["quality_summary"] = f"""
with r as (select cast(n_chars as double) v from documents), {spread('r', '')}, {_DOC}
select (select count(*) from documents) n_rows, 0::bigint n_missing,
  (select cast(sum(n - 1) as bigint) from (select count(*) n from documents group by text, lang, source, n_chars)) duplicate_rows,
  (select count(*) from r, s where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) n_outliers,
  (select count(*) from e) n_repeated, false clean"""

# --- robust statistics ----------------------------------------------------------------
QS = ", ".join(f"round({q}, 4) {q}" for q in ("q1", "q2", "q3"))
SQL["quartiles"] = f"""
with r as ({long('lineitem', LINE, 'l_returnflag')}), {spread('r', 'l_returnflag, measure')}
select l_returnflag, measure, n, {QS} from s"""
SQL["quartiles_narrowed"] = f"""
with r as (select l_linestatus, l_extendedprice v from lineitem), {spread('r', 'l_linestatus')}
select l_linestatus, n, {QS} from s"""
SQL["quartiles_hot_value"] = f"""
with r as (select l_linestatus, case when l_orderkey % 10 <> 0 then 42.0 when l_linenumber in (1, 2) then null
  else cast(l_extendedprice as double) end v from lineitem), {spread('r', 'l_linestatus')}
select l_linestatus, n, round(v_min, 2) v_min, round(v_max, 2) v_max, round(q1, 2) q1, round(q2, 2) q2, round(q3, 2) q3,
  round(trimmed, 2) trimmed_mean, n_extreme from s"""
SQL["trimmed_range"] = f"""
with r as (select event_type, value v from events), {spread('r', 'event_type')}
select event_type, round(lo, 2) lo, round(hi, 2) hi, {ANCHOR} zero_anchor from s"""
SQL["trimmed_mean_by_category"] = f"""
with r as (select l_returnflag category, l_extendedprice v from lineitem), {spread('r', 'category')}
select category, round(trimmed, 2) as value from s where n >= 5 order by trimmed desc, category limit 8"""
SQL["trimmed_mean_by_user"] = f"""
with r as (select user_id, value v from events), {spread('r', 'user_id')}
select user_id, round(trimmed, 2) as value, n from s where n >= 5"""

# --- breakdowns and trends ------------------------------------------------------------
SQL["sum_by_category_top8"] = """
select p_brand category, round(sum(p_retailprice), 2) as value from part group by p_brand
order by sum(p_retailprice) desc, p_brand limit 8"""
SQL["count_by_category_top8"] = """
select source category, count(*) as value from documents group by source order by count(*) desc, source limit 8"""


def _fused(category: str, measure: str, kind: str, i: int) -> str:
    return f"""
r{i} as (select {category} category, {measure} v from lineitem),
{spread(f'r{i}', 'category').replace(' q as', f' q{i}x as').replace(' t as', f' t{i}x as').replace(' s as', f' s{i}x as')
 .replace('join q ', f'join q{i}x q ').replace('from q join t', f'from q{i}x q join t{i}x t')},
b{i} as (select '{category}' category_column, '{measure}' measure, category,
  {'trimmed' if kind == 'average' else 'total'} x from s{i}x where {'n >= 5' if kind == 'average' else 'true'})"""


_PAIRS = [("l_returnflag", "l_quantity", "sum"), ("l_returnflag", "l_discount", "average"),
          ("l_linestatus", "l_quantity", "sum"), ("l_linestatus", "l_extendedprice", "average")]
SQL["breakdowns_fused"] = "with " + ",".join(_fused(*p, i) for i, p in enumerate(_PAIRS)) + """
select category_column, measure, cast(rk as integer) rank, category, round(x, 2) as value from (
  select *, row_number() over (partition by category_column, measure order by x desc, category) rk from (
""" + " union all ".join(f"select * from b{i}" for i in range(len(_PAIRS))) + ")) where rk <= 8"

SQL["trend_month_sum"] = """
select strftime(l_shipdate, '%Y-%m') period, round(sum(l_extendedprice), 2) as value from lineitem group by 1"""
SQL["trend_month_avg"] = f"""
with r as (select strftime(l_shipdate, '%Y-%m') period, l_quantity v from lineitem), {spread('r', 'period')}
select period, round(trimmed, 2) as value from s where n >= 5"""
WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + interval 6 day, '%Y-%m-%d')"
SQL["trend_week_sum"] = f"select {WEEK} period, round(sum(value), 2) as value from events group by 1"
SQL["week_sunday"] = """
select strftime(cast(ts as date) - cast(dayofweek(ts) as integer), '%Y-%m-%d') period, round(sum(value), 2) as value
from events group by 1"""
SQL["trend_day_avg"] = f"""
with r as (select strftime(ts, '%Y-%m-%d') period, value v from events), {spread('r', 'period')}
select period, round(trimmed, 2) as value from s where n >= 5"""
SQL["trends_fused"] = f"""
with r as (select strftime(l_shipdate, '%Y-%m') period, l_discount v from lineitem), {spread('r', 'period')}
select 'l_discount' measure, period, round(trimmed, 2) as value from s where n >= 5
union all select 'l_quantity', strftime(l_shipdate, '%Y-%m') p, round(sum(l_quantity), 2) from lineitem group by p"""
SQL["trend_summary"] = f"""
with p as ({SQL['trend_month_sum']}),
f as (select arg_min(period, period) first_period, arg_min(value, period) first_value, arg_max(period, period) last_period,
        arg_max(value, period) last_value, max(value) peak_value from p),
g as (select f.*, (select min(period) from p where value = peak_value) peak_period,
        (last_value - first_value) / abs(first_value) * 100 change from f)
select first_period, first_value, last_period, last_value, peak_period, peak_value, round(change, 4) change_pct,
  case when change > 1 then 'up' when change < -1 then 'down' else 'flat' end direction,
  first_period || ' - ' || last_period || ': ' || format('{{:+.0f}}', round_even(change, 0)) || ' percent; high point ' ||
  peak_period || ' with ' || {shown('peak_value')} || '.' stat_summary from g"""
SQL["trend_guard"] = " union all ".join(f"""
select '{t}' table_name, least(7, count(distinct cast({d} as date))) days_up_to_7,
  case when date_diff('day', min(cast({d} as date)), max(cast({d} as date))) > 180 then 'M'
       when date_diff('day', min(cast({d} as date)), max(cast({d} as date))) > 21 then 'W' else 'D' end as grouping
from {t}""" for t, d in (("events", "ts"), ("orders", "o_orderdate")))

# --- histograms, proportions, cards ---------------------------------------------------


def histogram(rows: str, bins: int = 10, label=shown) -> str:
    edge_lo, edge_hi = f"(lo + g.b * ((hi - lo) / {bins}))", f"(lo + (g.b + 1) * ((hi - lo) / {bins}))"
    return f"""with r as ({rows}), {spread('r', 'measure')},
c as (select r.measure, case when v_min = v_max then 0
        else greatest(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}), 0) end b, count(*) n
      from r join s using (measure) group by 1, 2),
g as (select s.*, b from s, range({bins}) t(b) where v_min < v_max or b = 0)
select g.measure, cast(g.b as integer) bin,
  case when v_min = v_max then {label('v_min')} else {label(edge_lo)} || '-' || {label(edge_hi)} end as label,
  coalesce(c.n, 0) n, g.n as total, (lo > v_min or hi < v_max) as trimmed
from g left join c on g.measure = c.measure and g.b = c.b"""


def axis(v: str) -> str:
    return (f"case when abs({v}) >= 1000 then {whole(f'floor({v} + 0.5)')} "
            f"else regexp_replace(format('{{:,.2f}}', round({v}, 2)), '\\.?0+$', '') end")


SQL["histogram_10"] = histogram(long("lineitem", ["l_extendedprice", "l_quantity"]))
SQL["histogram_trimmed"] = histogram("select 'value' measure, value v from events")
SQL["histogram_12"] = histogram(long("lineitem", ["l_extendedprice"]), 12, axis)
SQL["histogram_filtered"] = histogram(
    long("lineitem", ["l_extendedprice"], where="l_returnflag = 'R'"), 10, lambda v: f"format('{{:.1f}}', round({v}, 1))"
)
SQL["histogram_mode"] = f"""
with h as ({SQL['histogram_trimmed']}), m as (select * from h order by n desc, bin limit 1)
select measure, label, n, total, cast(round_even(n * 100 / total, 0) as bigint) pct,
  cast(cast(round_even(n * 100 / total, 0) as bigint) as varchar) || ' percent lie in ' || label || ': ' || {whole('n')} ||
  ' out of ' || {whole('total')} || ' values.' stat_summary from m"""


def pie(column: str, keep: int, limit: int) -> str:
    return f"""
with c as (select {column} k, count(*) n from part group by {column}),
r as (select *, row_number() over (order by n desc, k) rk, count(*) over () seen, sum(n) over () total from c),
x as (select case when seen <= {limit} or rk <= {keep} then rk else {keep + 1} end rk,
        case when seen <= {limit} or rk <= {keep} then k else 'Other' end category, n, total from r)
select cast(rk as integer) rank, category, cast(sum(n) as bigint) as value, cast(any_value(total) as bigint) total
from x group by rk, category"""


SQL["pie_top6_other"] = pie("p_brand", 6, 7)
SQL["pie_all_slices"] = pie("p_type", 6, 7)
SQL["pie_top7_other"] = pie("p_brand", 7, 7)
SQL["pie_statement"] = f"""
with p as ({SQL['pie_all_slices']}) select category, value, total, cast(round_even(value * 100 / total, 0) as bigint) pct,
  'Largest part: ' || category || ', ' || {whole('value')} || ' out of ' || {whole('total')} || ' rows, or ' ||
  cast(cast(round_even(value * 100 / total, 0) as bigint) as varchar) || ' percent.' stat_summary from p where rank = 1"""
SQL["bar_statement"] = f"""
with b as (select p_type category, cast(round(sum(p_size), 2) as double) as value from part group by p_type),
e as (select first(category order by value desc, category) highest, max(value) highest_value,
        last(category order by value desc, category) lowest, min(value) lowest_value from b)
select *, 'From ' || lowest || ' with ' || {shown('lowest_value')} || ' up to ' || highest || ' with ' ||
  {shown('highest_value')} || '.' stat_summary from e"""

SQL["summary_cards"] = f"""
with r as ({long('lineitem', LINE)}), {spread('r', 'measure')}
select measure, case when measure in ('l_quantity', 'l_extendedprice') then 'sum' else 'average' end agg_kind,
  round(total, 2) "sum", round(trimmed, 2) mean, round(v_min, 2) "min", round(v_max, 2) "max" from s"""
SQL["filtered_summary_cards"] = f"""
with r as (select value v from events where event_type = 'click' and cast(ts as date) between date '2024-01-05' and date '2024-01-20'),
{spread('r', '')}
select 'as_sum' measure, 'sum' agg_kind, round(total, 2) "sum", round(mean, 2) mean, round(v_min, 2) "min", round(v_max, 2) "max" from s
union all select 'as_average', 'average', round(total, 2), round(trimmed, 2), round(v_min, 2), round(v_max, 2) from s"""
SQL["filtered_trend"] = """
select strftime(l_shipdate, '%Y-%m') period, round(sum(l_quantity), 2) as value from lineitem
where l_returnflag = 'A' and cast(l_shipdate as date) between date '1996-03-01' and date '1998-06-30' group by 1"""
SQL["filtered_breakdown"] = f"""
with r as (select o_orderpriority category, o_totalprice v from orders
  where cast(o_orderdate as date) between date '1996-01-01' and date '1996-12-31'), {spread('r', 'category')}
select category, round(trimmed, 2) as value from s where n >= 5 order by trimmed desc, category limit 8"""

FILTERED = "o_orderpriority = '1-URGENT' and cast(o_orderdate as date) between date '1995-03-01' and date '1997-08-31'"
ORDER_MEASURES = ["o_orderkey", "o_custkey", "o_totalprice"]


def _filtered_groups(kind: str, column: str, label: str, measures: list[str], order: str, top: int) -> str:
    rows = long("orders", measures, f"{label} as label", FILTERED)
    value = "case when measure = 'o_custkey' then trimmed else total end"
    return f"""select '{kind}' as type, measure, '{column}' as category_column, pos as position, label, round(value, 2) as value from (
  with r as ({rows}), {spread('r', 'measure, label')},
  g as (select measure, label, {value} as value from s where measure <> 'o_custkey' or n >= 5)
  select *, row_number() over (partition by measure order by {order}) as pos from g) where pos <= {top}"""


SQL["dashboard_filtered"] = f"""
with c as (with r as ({long('orders', ORDER_MEASURES, '', FILTERED)}), {spread('r', 'measure')} select * from s),
h as ({histogram(long('orders', ORDER_MEASURES, '', FILTERED))})
select 'summary_card' as type, measure, '' as category_column, u.position, u.label, round(u.value, 2) as value from c, unnest([
  {{'position': 1, 'label': 'sum', 'value': total}}, {{'position': 2, 'label': 'mean', 'value': case when measure = 'o_custkey' then trimmed else mean end}},
  {{'position': 3, 'label': 'min', 'value': v_min}}, {{'position': 4, 'label': 'max', 'value': v_max}}]) as t(u)
union all {_filtered_groups('line', '', "strftime(o_orderdate, '%Y-%m')", ORDER_MEASURES[:2], 'label', 10**6)}
union all {_filtered_groups('bar', 'o_orderstatus', 'o_orderstatus', ORDER_MEASURES, 'value desc, label', 8)}
union all {_filtered_groups('bar', 'o_orderpriority', 'o_orderpriority', ORDER_MEASURES, 'value desc, label', 8)}
union all select 'histogram', measure, '', bin + 1, '', cast(n as double) from h"""

# --- exploration and samples ----------------------------------------------------------
SQL["corr_fit"] = """
with f as (select count(*) n, corr(l_quantity, l_extendedprice) r, regr_slope(l_extendedprice, l_quantity) slope,
   regr_intercept(l_extendedprice, l_quantity) intercept, min(l_quantity) x_min, max(l_quantity) x_max from lineitem)
select n, round(r, 6) r, round(slope, 6) slope, round(intercept, 2) intercept,
  round(slope * x_min + intercept, 2) trend_at_min, round(slope * x_max + intercept, 2) trend_at_max, x_min, x_max,
  'quantity and price: ' || (case when abs(r) < 0.2 then 'no clear link' when abs(r) < 0.4 then 'a loose link'
    when abs(r) < 0.7 then 'a clear link' else 'a close link' end) ||
   (case when abs(r) < 0.2 then '' when r > 0 then ', rising together' else ', one rising as the other falls' end) ||
   ' (correlation ' || format('{:.2f}', r) || ').' as statement
from f"""
SQL["sample_hash"] = """
select * from orders order by substr(md5('42|' || o_orderkey), 1, 13), o_orderkey
limit (select greatest(1, count(*) // 4) from orders)"""
SQL["scatter_systematic"] = """
with o as (select row_number() over (order by o_orderkey) - 1 as "row", cast(o_custkey as double) x, o_totalprice y,
   count(*) over () n from orders)
select "row", x, y from o where "row" % greatest(1, cast(ceil(n / 1000) as bigint)) = 0"""

# --- filters and query specs ----------------------------------------------------------


def counts(source: str, tests: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' test, count(*) filter (where {v}) n from {source}" for k, v in tests.items())


SQL["filter_boolish"] = """with w as (select quality, case when quality = 1 then 'Yes' when doc_id % 3 = 0 then 'NO' else 'other' end word
  from labels) """ + counts("w", {
    "number_is_true": "quality = 1", "number_is_yes": "quality = 1", "number_not_true": "quality <> 1",
    "word_is_true": "word = 'Yes'", "word_is_0": "word = 'NO'", "word_not_true": "word <> 'Yes'", "word_is_1": "word = 'Yes'",
})
SQL["filter_ordered_text"] = counts("events", {
    "text_after": "cast(ts as date) > date '2024-01-10'", "text_upto": "cast(ts as date) <= date '2024-01-10'",
    "number_text_above": "value > 100", "number_text_below": "value < 9.5",
    "typed_after": "cast(ts as date) > date '2024-01-10'", "typed_from": "cast(ts as date) >= date '2024-01-10'",
    "typed_on": "cast(ts as date) = date '2024-01-10'", "typed_not_on": "cast(ts as date) <> date '2024-01-10'",
})
SQL["filter_ci_equals"] = f"with {HOLED} " + counts("holed", {
    "same": "lower(c_mktsegment) = 'building'", "different": "lower(c_mktsegment) <> 'building'", "emptied": "false",
    "number": "c_acctbal >= 5000", "number_not": "c_custkey <> 7",
})
_SINGLE = "from lineitem where lower(l_returnflag) = 'a' and l_quantity > 10 and l_shipdate < timestamp '1999-01-01'"
SQL["spec_single"] = " union all ".join(
    f"select '{op}' operation, round(cast({sql} as double), 2) as value, count(*) matched_rows {_SINGLE}" for op, sql in (
        ("sum", "sum(l_extendedprice)"), ("average", "avg(l_extendedprice)"), ("count", "count(*)"),
        ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"),
    )
)
SQL["spec_grouped"] = f"""with {HOLED}
select c_mktsegment segment, round(avg(c_acctbal), 2) as value, count(*) n from holed
where c_custkey >= 10 and c_mktsegment is not null group by 1"""
_HELD = "m as (select * from lineitem where lower(l_returnflag) <> 'n'), x as (select max(l_quantity) q from m)"
SQL["spec_lookup"] = f"""with {_HELD}
select l_quantity, l_orderkey, l_linenumber, l_partkey from m, x where l_quantity = q
order by l_quantity, l_orderkey, l_linenumber, l_partkey limit 5"""
SQL["spec_lookup_counts"] = f"""with {_HELD}, h as (select count(*) n from m, x where l_quantity = q)
select (select count(*) from m) matched_rows, n total_matching, n > 5 as truncated from h"""

TEXT_ORDERS = """o as (select cast(o_orderkey as varchar) order_id, cast(o_orderdate as date) ordered,
  case when o_orderkey % 4 not in (0, 1) and o_orderkey % 50 = 2 then null else cast(o_totalprice as decimal(12, 2)) end price,
  case when o_orderkey % 10 = 3 then 'N/A' else o_orderpriority end priority, o_orderstatus = 'F' filled from orders)"""
SQL["spec_text_table"] = f"""with {TEXT_ORDERS}
select priority as "group", round(cast(sum(price) as double), 2) as value, count(*) n from o
where ordered >= date '1996-02-01' and price > 1000 and filled group by priority"""
SQL["cross_filter_text_dates"] = f"""with {TEXT_ORDERS}
select count(*) n, round(cast(sum(price) as double), 2) total, cast(min(ordered) as varchar) first_day from o
where ordered between date '1995-01-01' and date '1996-12-31' and filled"""
SQL["spec_lookup_date"] = f"""with {TEXT_ORDERS}, f as (select * from o where price < 100000.5)
select cast(ordered as varchar) ordered, order_id from f where ordered = (select max(ordered) from f) order by order_id limit 5"""

# --- dashboard ------------------------------------------------------------------------
def bars_statement(table: str, category: str, measure: str) -> str:
    return f"""(with g as (select {category} category, cast(round(sum({measure}), 2) as double) x from {table} group by 1),
  b as (select * from g order by x desc, category limit 8),
  e as (select first(category order by x desc, category) c1, max(x) v1, last(category order by x desc, category) c2, min(x) v2 from b)
  select 'From ' || c2 || ' with ' || {shown('v2')} || ' up to ' || c1 || ' with ' || {shown('v1')} || '.' from e)"""


def mode_statement(table: str, measure: str) -> str:
    return f"""(with h as ({histogram(long(table, [measure]))}), m as (select * from h order by n desc, bin limit 1)
  select cast(cast(round_even(n * 100 / total, 0) as bigint) as varchar) || ' percent lie in ' || label || ': ' || {whole('n')} ||
    ' out of ' || {whole('total')} || ' values.' from m)"""


SQL["dashboard_plan"] = """
with c as (select count(distinct strftime(o_orderdate, '%Y-%m')) n_months, count(distinct o_orderstatus) n_statuses,
  count(distinct o_orderpriority) n_priorities from orders),
p as (
  select 0 as "position", 'summary_card' chart_type, 'O Orderkey' title, null category_column, 'o_orderkey' measure_column, 0 n_points from c
  union all select 1, 'summary_card', 'O Custkey', null, 'o_custkey', 0 from c
  union all select 2, 'summary_card', 'O Totalprice', null, 'o_totalprice', 0 from c
  union all select 3, 'line', 'O Orderkey over time', null, 'o_orderkey', n_months from c
  union all select 4, 'line', 'O Custkey over time', null, 'o_custkey', n_months from c
  union all select 5, 'bar', 'O Orderkey by O Orderstatus', 'o_orderstatus', 'o_orderkey', n_statuses from c
  union all select 6, 'bar', 'O Custkey by O Orderstatus', 'o_orderstatus', 'o_custkey', n_statuses from c
  union all select 7, 'bar', 'O Totalprice by O Orderstatus', 'o_orderstatus', 'o_totalprice', n_statuses from c
  union all select 8, 'bar', 'O Orderkey by O Orderpriority', 'o_orderpriority', 'o_orderkey', n_priorities from c
  union all select 9, 'bar', 'O Custkey by O Orderpriority', 'o_orderpriority', 'o_custkey', n_priorities from c
  union all select 10, 'bar', 'O Totalprice by O Orderpriority', 'o_orderpriority', 'o_totalprice', n_priorities from c
  union all select 11, 'histogram', 'Distribution of O Orderkey', null, 'o_orderkey', 10 from c
  union all select 12, 'histogram', 'Distribution of O Custkey', null, 'o_custkey', 10 from c
  union all select 13, 'histogram', 'Distribution of O Totalprice', null, 'o_totalprice', 10 from c
  union all select 14, 'pie', 'Proportion of O Orderstatus', 'o_orderstatus', null, n_statuses from c
  union all select 15, 'pie', 'Proportion of O Orderpriority', 'o_orderpriority', null, n_priorities from c)
select cast("position" as integer) as "position", chart_type, title, category_column, measure_column, cast(n_points as integer) n_points from p"""

_PART_LABELS = {"p_partkey": "P Partkey", "p_size": "P Size", "p_retailprice": "P Retailprice"}
SQL["dashboard_statements"] = " union all ".join(
    [
        f"select '{label} by {c_label}' title, {bars_statement('part', c, m)} as text"
        for c, c_label in (("p_brand", "P Brand"), ("p_type", "P Type")) for m, label in _PART_LABELS.items()
    ]
    + [f"select 'Distribution of {label}' title, {mode_statement('part', m)} as text" for m, label in _PART_LABELS.items()]
    + [f"select 'Proportion of P Type' title, (select stat_summary from ({SQL['pie_statement']})) as text"]
)

SQL["dashboard_warnings"] = f"""
with r as (select cast(n_chars as double) v from documents), {spread('r', '')}, {_DOC},
w as (select 'Totals may count something twice: ' || cast(sum(n) as bigint) || ' rows repeat a value of ''Text'' with differing details.' x
      from e having count(*) > 0),
o as (select n_extreme || ' extreme ' || case when n_extreme = 1 then 'value sits' else 'values sit' end || ' in the outer bins.' x
      from s where lo > v_min or hi < v_max)
select 0 as "position", 'summary_card' chart_type, 'N Chars' title, (select x from w) as warning
union all select 1, 'bar', 'N Chars by Lang', (select x from w)
union all select 2, 'bar', 'N Chars by Source', (select x from w)
union all select 3, 'histogram', 'Distribution of N Chars', (select x from o)
union all select 4, 'pie', 'Proportion of Lang', null"""

SQL["samples_of_columns"] = " union all ".join(
    f"select '{c}' column_name, (select string_agg(v, '|') from (select cast({c} as varchar) v from orders limit 5)) samples"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
)
SQL["first_rows_as_text"] = """
select cast(s_suppkey as varchar) s_suppkey, s_name, cast(s_nationkey as varchar) s_nationkey, cast(s_acctbal as varchar) s_acctbal
from supplier limit 5"""

SQL["headline_measure"] = """
select title, total from (
  select 'O Totalprice' title, round(sum(o_totalprice), 2) total from orders
  union all select 'O Orderkey', round(cast(sum(o_orderkey) as double), 2) from orders
  union all select 'O Custkey', round(cast(sum(o_custkey) as double), 2) from orders)
order by total desc limit 1"""
SQL["table_overview"] = """
select 3::bigint n_numeric, 2::bigint n_categorical, 1::bigint n_date, cast(cast(min(o_orderdate) as date) as varchar) min_date,
  cast(cast(max(o_orderdate) as date) as varchar) max_date from orders"""

# --- role-based KPIs ------------------------------------------------------------------
SALES = """sales as (select o_orderdate d, case when o_orderkey % 20 = 0 then null else o_totalprice end total,
  o_orderpriority category from orders)"""
SQL["role_verify"] = f"""with {SALES}, k as (select count(*) n, count(d) dates, count(total) totals,
  count(*) filter (where total >= 0) usable, count(category) categories,
  count(*) filter (where try_cast(category as double) is null and category is not null) words from sales),
r(column_name, "role", part, note) as (
  select 'Order Date', 'date', dates / n, 'dates: ' || dates || ' of ' || n from k
  union all select 'Total', 'sales_amount', least(totals / n, usable / totals), 'numbers: ' || totals || ' of ' || n || '; not below zero: ' || usable from k
  union all select 'Category', 'category', words / categories, 'words: ' || words || ' of ' || categories from k
  union all select 'Notes', 'notes', 1, 'taken by name' from k
  union all select 'Customer', 'customer_name', 0, 'words: 0 of ' || n from k)
select column_name, "role", part >= 0.8 as verified, note from r"""
SQL["kpi_total"] = f"with {SALES} select round(sum(total), 2) total_revenue from sales"
SQL["kpi_monthly"] = f"""with {SALES}
select strftime(d, '%Y-%m') as month, round(sum(total), 2) revenue from sales where total is not null group by 1"""
SQL["kpi_top5"] = f"""with {SALES}
select category as name, round(sum(total), 2) revenue from sales where total is not null group by 1
order by sum(total) desc, category limit 5"""
SQL["kpi_unavailable"] = """
select kpi, 'no verified column for ' || reason as reason from (values ('total_revenue', 'sales_amount'),
  ('revenue_over_time', 'sales_amount'), ('top_categories', 'sales_amount')) as t(kpi, reason)"""

# --- sources, sinks, usage ------------------------------------------------------------
SQL["csv_ingest"] = f"""with {MESSY}
select priority, count(*) n, round(sum(case when total_price <> 'unknown' then o_totalprice end), 2) total,
  cast(min(ordered) as varchar) first_day, cast(max(ordered) as varchar) last_day, count(ordered) n_dated
from messy group by priority"""
SQL["csv_columns"] = f"with {MESSY} " + " union all ".join(
    f"select '{c}' column_name, count({x}) n from messy" for c, x in (
        ("order_id", "order_id"), ("total_price", "total_price"), ("ordered", "ordered"), ("priority", "priority"),
        ("filled", "filled"), ("origin", "*"),
    )
)
SQL["ragged_reject"] = "select 'NO_TABULAR_DATA' code, count(*) n from orders where o_orderkey % 9 = 4"
SQL["typed_records"] = """
select cast(o_orderkey as double) o_orderkey, cast(o_custkey as double) o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') o_orderdate, o_orderpriority from orders"""
SQL["typed_records_sink"] = f"""with {HOLED}
select c_acctbal, cast(c_custkey as double) c_custkey, c_mktsegment, c_name from holed"""
SQL["eventlog_daily"] = """
select strftime(ts, '%Y-%m-%d') as day, count(*) n from events where event_type = 'click' and event_id % 10 <> 1 group by 1"""
SQL["eventlog_totals"] = """
select count(*) total, count(distinct case when event_id % 10 <> 1 then cast(ts as date) end) days_active
from events where event_type = 'click'"""
SQL["usage_daily"] = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) n from events group by 1, 2"
SQL["usage_daily_stream"] = SQL["usage_daily"]
