"""DuckDB SQL for the catalog's queries, composed from common table expressions."""

from __future__ import annotations

from strata.plans.fixtures import AS_OF, BARS, DIRTY_BARS, DUCKDB, OVERVIEW_SNAP, OVERVIEW_WIDE, RUN_TS, TRADES, WEEKLY_BARS, sql
from strata.spec import OVERVIEW_DEFAULTS, OVERVIEW_NAMES, OVERVIEW_STRINGS, PRICES, overview_types

STAMP = f"timestamp '{RUN_TS}' processed_at"


def rnd(x: str) -> str:
    return f"cast(round(cast({x} as decimal(28,8)), 2) as double)"


def nt(x: str) -> str:
    return f"case when lower(trim({x})) in ('', 'n/a', 'na', 'null', 'none', '-') then null else trim({x}) end"


def day(x: str) -> str:
    return f"cast(try_strptime({x}, '%Y-%m-%d') as date)"


REASONS = [("symbol is null", "Missing symbol"), ("day_date is null", "Missing or invalid day date"), ("last_refreshed is null", "Missing or invalid last refreshed date")]
REASONS += [(f"{p} is null", f"Missing or invalid {p} price") for p in PRICES] + [("volume is null", "Missing or invalid volume")]
REASONS += [(f"isnan({p})", f"{p.capitalize()} price is not a number") for p in PRICES]
REASONS += [(f"{p} <= 0", f"{p.capitalize()} price must be greater than zero") for p in PRICES]
REASONS += [("volume < 0", "Volume cannot be negative"), ("high < low", "High price cannot be lower than low price")]
REASON = "case " + " ".join(f"when {c} then '{r}'" for c, r in REASONS) + " end"
CHANGE = f"{rnd('close - open')} {{p}}_change, case when open = 0 then null else {rnd('(close - open) / open * 100')} end {{p}}_change_percentage"
MOVE = "case when close > open then 'Bull' when close < open then 'Bear' else 'Neutral' end market_movement"
PARTS = {"year": "cast(year({d}) as int) as year", "month": "cast(month({d}) as int) as month", "day": "cast(day({d}) as int) as day", "week_number": "cast(weekofyear({d}) as int) week_number"}


def calendar(d: str, *parts: str) -> str:
    return ", ".join(PARTS[p].format(d=d) for p in parts)


def stats(over: str) -> str:
    recent = lambda n, x: f"case when day_date >= date '{AS_OF}' - {n} then {x} end"
    cols = {
        "thirty_day_avg_open": f"avg({recent(30, 'open')})", "thirty_day_avg_close": f"avg({recent(30, 'close')})", "fifty_two_week_high": f"max({recent(365, 'high')})",
        "fifty_two_week_low": f"min({recent(365, 'low')})", "all_time_high": "max(high)", "all_time_low": "min(low)",
    }
    return ", ".join(f"{rnd(f'{c} {over}')} {n}" for n, c in cols.items())


PX = "open, high, low, close, cast(volume as bigint) volume"
CTE = {
    "bars": sql(BARS, DUCKDB), "weekly_bars": sql(WEEKLY_BARS, DUCKDB), "dirty": sql(DIRTY_BARS, DUCKDB), "wide": sql(OVERVIEW_WIDE, DUCKDB), "snap": sql(OVERVIEW_SNAP, DUCKDB), "trades": sql(TRADES, DUCKDB),
    "dup": "select *, 0 src from dirty union all select *, 1 src from dirty where row_id % 10 = 0",
    "typed": f"select row_id, src, {nt('upper(symbol)')} symbol, {day(nt('day_date'))} day_date, {day(nt('last_refreshed'))} last_refreshed, "
    + ", ".join(f"try_cast({nt(p)} as double) {p}" for p in PRICES) + f", try_cast({nt('volume')} as bigint) volume from dup",
    "tagged": f"select *, {REASON} validation_reason, case when ({REASON}) is null then 'VALID' else 'INVALID' end validation_status from typed",
    "one": "select * from tagged where validation_reason is null qualify row_number() over (partition by symbol, day_date order by row_id, src) = 1",
    "rounded": f"select row_id, symbol, day_date, last_refreshed, {', '.join(f'{rnd(p)} {p}' for p in PRICES)}, volume, validation_status, validation_reason from one",
    "silver": f"select symbol, day_date, {PX}, {CHANGE.format(p='daily')}, {MOVE}, {stats('over (partition by symbol)')}, last_refreshed last_refreshed_date, validation_status, validation_reason, "
    f"{calendar('day_date', 'year', 'month', 'day')}, {STAMP} from rounded",
    "over": "select upper(trim(\"Symbol\")) symbol, snapshot_id, coalesce(case when lower(\"Country\") = 'n/a' then null else \"Country\" end, 'Unknown') country, "
    'cast("LatestQuarter" as date) latest_quarter, cast("52WeekHigh" as double) fifty_two_week_high, cast("AnalystRatingBuy" as int) analyst_rating_buy from snap',
    "last_over": "select * from over qualify row_number() over (partition by symbol order by latest_quarter desc, snapshot_id desc) = 1",
}


def q(select: str, *ctes: str) -> str:
    return f"with {', '.join(f'{c} as ({CTE[c]})' for c in ctes)} {select}" if ctes else select


TYPED, TAGGED = ("dirty", "dup", "typed"), ("dirty", "dup", "typed", "tagged")
ROUNDED = (*TAGGED, "one", "rounded")
SILVER, OVER = (*ROUNDED, "silver"), ("snap", "over")
TYPED_COLS = "row_id, src, symbol, day_date, last_refreshed, open, high, low, close, volume"
OPEN_CLOSE = "symbol, day_date"


def wide_columns() -> str:
    """The overview's silver columns over `wide`, whose other fields are null."""
    have, types, out = {"Symbol", "Country", "Sector", "CIK", "BookValue", "MarketCapitalization", "DividendDate"}, overview_types(), []
    for f, name in OVERVIEW_NAMES.items():
        x = nt(f'"{f}"' if f != "Symbol" else 'upper("Symbol")') if f in have else "null"
        kind = types.get(f, "varchar")
        x = day(x) if kind == "date" and f in have else f"try_cast({x} as {kind})"
        out.append(f"coalesce({x}, '{OVERVIEW_DEFAULTS[f]}') {name}" if f in OVERVIEW_DEFAULTS else f"{x} {name}")
    assert set(OVERVIEW_STRINGS) <= set(OVERVIEW_NAMES)
    return ", ".join(out)


STAMPED = f"cast(2001 as int) as year, cast(8 as int) as month, cast(2 as int) as day, {STAMP}"
TICKS = "select event_type symbol, date_trunc('day', ts) bar_start, arg_min(value, event_id) open, max(value) high, min(value) low, arg_max(value, event_id) \"close\", count(*) volume from events group by 1, 2"
HELD, SINCE = "event_id % 50 = 0 and ts < timestamp '2024-01-11'", "day_date >= date '1998-06-15' - {}"
BAR_HASH = "sha256(concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), chr(92) || 'N')" for c in ("day_date", "symbol", "volume")) + "))"
SUMS = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint)::varchar" for i in range(4))
CONTENT = f"h as (select {BAR_HASH} h from bars), c as (select sha256(concat_ws(',', count(*)::varchar, {SUMS})) content_hash from h)"
GOLD_BARS = "symbol, day_date, open, high, low, close, volume, daily_change, daily_change_percentage, market_movement, thirty_day_avg_open, thirty_day_avg_close, all_time_high, all_time_low, processed_at"
CUT = "date '2000-12-31'"
VIDEO = "select cast(doc_id as varchar) video_id, source channel_id, lang channel_title, cast(null as varchar) channel_description, cast(n_chars as varchar) publish_time, cast(null as varchar) publish_at, 'v' kind from documents"
CUSTOMER_HASH = "case when o.c_custkey is null then 'new' when n.c_custkey is null then 'removed' when o.c_mktsegment is not distinct from n.c_mktsegment and o.c_name is not distinct from n.c_name then 'unchanged' else 'changed' end"

ORACLE = {
    "scan_json_series": q("select symbol, '2001-08-01' last_refreshed, strftime(day_date, '%Y-%m-%d') day_date, cast(volume as varchar) volume from bars", "bars"),
    "scan_json_series_weekly": q("select symbol, '2001-08-01' last_refreshed, strftime(week_date, '%Y-%m-%d') week_date, cast(volume as varchar) volume from weekly_bars", "weekly_bars"),
    "scan_json_record": q('select "Symbol", "Country", "Sector", "CIK", "BookValue", "MarketCapitalization", "DividendDate" from wide', "wide"),
    "scan_json_items": "select lang \"regionCode\", count(*) n_items from documents group by 1",
    "scan_csv_typed": "select cast(doc_id as varchar) video_id, lang channel_title, n_chars views, source tags, false comments_disabled from documents",
    "scan_csv_modes": "select 'DROPMALFORMED' read_mode, count(*) good, cast(0 as bigint) corrupt, cast(null as varchar) error from documents where doc_id % 10 <> 0 union all select 'PERMISSIVE', count(*) filter (doc_id % 10 <> 0), count(*) filter (doc_id % 10 = 0), null from documents "
    "union all select 'FAILFAST', null, null, 'MALFORMED'",
    "scan_csv_located": "select doc_id || ',many' as value, 'Malformed row' validation_reason, true placed from documents where doc_id % 10 = 0",
    "schema_registry": "select doc_id, n_chars::double n_chars, case when doc_id % 2 <> 0 then lang end lang from documents",
    "scan_silver_parquet": q(f"select symbol, day_date, close from bars where day_date > {CUT}", "bars"),
    "scan_silver_csv": q("select * from silver", *SILVER), "scan_overview_csv": q("select * from last_over", *OVER, "last_over"),
    "read_or_empty": q("select symbol, cast(count(*) as bigint) n from bars group by 1", "bars"),
    "scan_run_partition": "select o_orderkey, o_totalprice from orders where year(o_orderdate) = 2000 and month(o_orderdate) = 3",
    "guard_raw_files": "select case when doc_id % 20 = 0 then 'rate limit' when doc_id % 30 = 1 then 'bad symbol' else lang end kind, count(*) n from documents group by 1",
    "guard_error_payload": "select cast(doc_id as varchar) as key, case when doc_id % 20 = 0 then 'rate limit' when doc_id % 30 = 1 then 'bad symbol' end error from documents",
    "sink_parquet_roundtrip": q("select * from silver", *SILVER), "sink_csv_roundtrip": q("select * from silver", *SILVER),
    "sink_dual_format": q("select f.format, symbol, count(*) n, sum(volume)::bigint volume from silver, (select unnest(['csv', 'parquet']) as format) f group by 1, 2", *SILVER),
    "land_bronze": "select lang as dataset, cast(doc_id as varchar) as key, length(text) n from documents",
    "sink_quarantine": q("select case src when 0 then 'b1' else 'b2' end batch_id, validation_reason, row_id, src from tagged where validation_reason is not null", *TAGGED),
    "project_nested": q("select symbol, '2001-08-01' last_refreshed, count(*) n_days from bars group by 1", "bars"),
    "flatten_items": VIDEO, "explode_items": "select lang, cast(doc_id as varchar) video_id, source channel_id from documents",
    "explode_map_series": q(f"select symbol, strftime(day_date, '%Y-%m-%d') day_date, cast(volume as varchar) volume from bars where day_date > {CUT}", "bars"),
    "project_silver": q("select symbol, day_date, open, high, low, close, volume from rounded", *ROUNDED),
    "rename_snake": q('select "Symbol" symbol, "Country" country, "Sector" sector, "CIK" cik, "BookValue" book_value, "MarketCapitalization" market_cap, "DividendDate" dividend_date, row_id from wide', "wide"),
    "filter_valid": q(f"select {TYPED_COLS} from tagged where validation_reason is null", *TAGGED),
    "filter_after_watermark": q(f"select symbol, day_date, close from bars where day_date > case symbol when '1-URGENT' then date '2001-01-01' when '2-HIGH' then date '1999-06-30' when '3-MEDIUM' then date '2001-07-20' when '4-NOT SPECIFIED' then date '1995-01-01' else date '1900-01-01' end", "bars"),
    "normalize_nulls": q(f"select row_id, {nt('symbol')} symbol, {nt('open')} open, {nt('volume')} volume, {nt('last_refreshed')} last_refreshed from dirty", "dirty"),
    "stamp_run": f"select o_orderkey, {STAMPED}, timestamp '2001-08-02 05:30:00' processed_local from orders",
    "trim_upper": q("select row_id, upper(trim(symbol)) symbol, trim(day_date) day_date from dirty", "dirty"),
    "cast_typed": q("select row_id, try_cast(open as double) open, try_cast(volume as bigint) volume, try_cast(volume as int) volume_int, cast(row_id as varchar) id_text from dirty", "dirty"),
    "cast_dates": q(f"select row_id, {day('day_date')} day_date, {day('last_refreshed')} last_refreshed from dirty", "dirty"),
    "cast_by_spec": q(f"select {TYPED_COLS} from typed", *TYPED),
    "impute_defaults": q(f"select row_id, coalesce({nt(chr(34) + 'Country' + chr(34))}, 'Unknown') country, coalesce({nt(chr(34) + 'Sector' + chr(34))}, 'Unknown') sector from wide", "wide"),
    "round_prices": f"select event_id, {rnd('value')} \"value\" from events",
    "validate_status": q("select row_id, src, validation_status from tagged", *TAGGED), "validate_reason": q("select row_id, src, validation_reason from tagged", *TAGGED),
    "quarantine_rows": q(f"select {TYPED_COLS}, validation_reason from tagged where validation_reason is not null", *TAGGED),
    "dq_counts": q("select count(*) n_rows, count(*) filter (validation_reason is null) n_valid, count(*) filter (validation_reason is not null) n_invalid from tagged", *TAGGED),
    "dq_by_reason": q("select validation_reason, count(*) n, cast(round(cast(count(*) * 100 as decimal(28,8)) / (select count(*) from tagged), 2) as double) share from tagged where validation_reason is not null group by 1", *TAGGED),
    "schema_drift": "select * from (values ('extra', null, 'int', 'unexpected', null), ('n_chars', 'string', 'bigint', 'type', 0), ('parent', 'bigint', 'string', 'type', (select count(*) from documents where doc_id % 2 <> 0)), "
    "('url', 'string', null, 'missing', null)) t(\"column\", expected, \"found\", drift, n_unreadable)",
    "dup_report": q("select symbol, day_date, count(*) n from typed group by 1, 2 having count(*) > 1", *TYPED),
    "dedupe_keys": q(f"select {TYPED_COLS} from one", *TAGGED, "one"),
    "latest_per_key": q("select * from last_over", *OVER, "last_over"),
    "trailing_avg_30d": q(f"select symbol, {rnd(f'avg(open) filter (day_date >= date {chr(39)}{AS_OF}{chr(39)} - 30)')} thirty_day_avg_open, {rnd(f'avg(close) filter (day_date >= date {chr(39)}{AS_OF}{chr(39)} - 30)')} thirty_day_avg_close from bars group by 1", "bars"),
    "high_low_52w": q(f"select symbol, {rnd(f'max(high) filter (day_date >= date {chr(39)}{AS_OF}{chr(39)} - 365)')} fifty_two_week_high, {rnd(f'min(low) filter (day_date >= date {chr(39)}{AS_OF}{chr(39)} - 365)')} fifty_two_week_low from bars group by 1", "bars"),
    "all_time_high_low": q(f"select symbol, {rnd('max(high)')} all_time_high, {rnd('min(low)')} all_time_low from bars group by 1", "bars"),
    "max_watermark": q("select symbol, max(day_date) mark from bars group by 1 union all select null, max(day_date) from bars", "bars"),
    "run_tally": "select case when o_orderstatus = 'F' then 'FAILED' else 'SUCCESS' end status, count(*) n from orders group by 1",
    "bars_with_stats": q(f"select {OPEN_CLOSE}, {stats('over (partition by symbol)')} from bars", "bars"), "bars_with_stats_agg": q(f"select {OPEN_CLOSE}, {stats('over (partition by symbol)')} from bars", "bars"),
    "rolling_avg_30d": q(f"select {OPEN_CLOSE}, {rnd('avg(open) over w')} rolling_avg_open, {rnd('avg(close) over w')} rolling_avg_close from bars window w as (partition by symbol order by day_date range between interval 29 days preceding and current row)", "bars"),
    "rolling_high_low_52w": q(f"select {OPEN_CLOSE}, {rnd('max(high) over w')} rolling_high, {rnd('min(low) over w')} rolling_low from bars window w as (partition by symbol order by day_date range between interval 364 days preceding and current row)", "bars"),
    "running_high_low": q(f"select {OPEN_CLOSE}, {rnd('max(high) over w')} running_high, {rnd('min(low) over w')} running_low from bars window w as (partition by symbol order by day_date range between unbounded preceding and current row)", "bars"),
    "trailing_trades": q(f"select l_orderkey, l_linenumber, {rnd('avg(open) over m')} rolling_avg_open, {rnd('avg(close) over m')} rolling_avg_close, {rnd('max(high) over y')} rolling_high, {rnd('min(low) over y')} rolling_low, {rnd('max(high) over e')} running_high, {rnd('min(low) over e')} running_low from trades "
    "window m as (partition by symbol order by day_date range between interval 29 days preceding and current row), y as (partition by symbol order by day_date range between interval 364 days preceding and current row), e as (partition by symbol order by day_date range between unbounded preceding and current row)", "trades"),
    "trades_as_of": q("select symbol, " + ", ".join(f"{rnd(x)} {n}" for n, x in (("thirty_day_avg_open", f"avg(open) filter ({SINCE.format(30)})"), ("thirty_day_avg_close", f"avg(close) filter ({SINCE.format(30)})"), ("fifty_two_week_high", f"max(high) filter ({SINCE.format(365)})"),
        ("fifty_two_week_low", f"min(low) filter ({SINCE.format(365)})"), ("all_time_high", "max(high)"), ("all_time_low", "min(low)"))) + " from trades group by 1", "trades"),
    "diff_by_digests": "select coalesce(o.c_custkey, n.c_custkey) c_custkey, case when o.c_custkey is null then 'new' when n.c_custkey is null then 'removed' when o.c_mktsegment is not distinct from n.c_mktsegment and o.c_name is not distinct from n.c_name then 'unchanged' else 'changed' end change "
    "from (select * from customer where c_custkey % 500 <> 7) o full join (select c_custkey, c_name, case when c_custkey % 400 <> 5 then c_mktsegment end c_mktsegment from customer where c_custkey % 500 <> 11) n on o.c_custkey = n.c_custkey",
    "gold_join": q("select bars.*, snapshot_id, country, latest_quarter, fifty_two_week_high, analyst_rating_buy from bars left join last_over using (symbol)", "bars", *OVER, "last_over"),
    "incremental_stats": q(f"select {OPEN_CLOSE}, {stats('over (partition by symbol)')} from bars qualify day_date > {CUT}", "bars"),
    "gold_unmatched": q("select symbol, day_date from bars where symbol not in (select symbol from last_over)", "bars", *OVER, "last_over"),
    "sort_silver": q("select symbol, day_date, close, row_number() over (order by symbol, day_date desc) as position from bars", "bars"),
    "preview_top_n": q("select symbol, day_date, close from bars order by symbol, day_date desc limit 20", "bars"),
    "price_change": q(f"select {OPEN_CLOSE}, {CHANGE.format(p='daily')} from bars", "bars"), "market_movement": q(f"select {OPEN_CLOSE}, {MOVE} from bars", "bars"),
    "calendar_week": q(f"select symbol, week_date, {calendar('week_date', 'year', 'month', 'week_number')} from weekly_bars", "weekly_bars"),
    "calendar_day": q(f"select symbol, day_date, {calendar('day_date', 'year', 'month', 'day')} from bars", "bars"),
    "state_latest": "select o_orderpriority watermark_key, arg_max(cast(cast(o_orderdate as date) as varchar), o_orderkey) watermark_value, max(cast(o_orderkey as varchar)) filter (o_orderkey = mk) batch_id from (select *, max(o_orderkey) over (partition by o_orderpriority) mk from orders where o_orderstatus <> 'F') group by 1",
    "incremental_load": q("select * from silver", *SILVER),
    "content_hash": q("select content_hash from c", "bars").replace(" select content_hash", f", {CONTENT} select content_hash"),
    "hash_changed": q("select content_hash, content_hash previous_hash, false changed from c", "bars").replace(" select content_hash,", f", {CONTENT} select content_hash,"),
    "snapshot_diff": f"select coalesce(o.c_custkey, n.c_custkey) c_custkey, {CUSTOMER_HASH} change from (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 7 <> 0) o full join (select c_custkey, c_name, case when c_custkey % 5 = 0 then null else c_mktsegment end c_mktsegment from customer where c_custkey % 11 <> 0) n on o.c_custkey = n.c_custkey",
    "run_metrics": q("select 'batch-1' batch_id, count(*) n_rows, count(*) filter (validation_reason is null) n_valid, count(*) filter (validation_reason is not null) n_invalid, (select count(*) from one) n_written, cast(null as date) old_mark, (select max(day_date) from one) new_mark, false skipped from tagged", *TAGGED, "one"),
    "skip_empty_load": q("select 'batch-' || b batch_id, count(*) n_rows, count(*) filter (validation_reason is null) n_valid, count(*) filter (validation_reason is not null) n_invalid, case b when 1 then (select count(*) from one) else 0 end n_written, "
    "case b when 2 then (select max(day_date) from one) end old_mark, (select max(day_date) from one) new_mark, b = 2 skipped from tagged, (select unnest([1, 2]) b) group by b", *TAGGED, "one"),
    "silver_from_blocks": q("select * from silver", *SILVER),
    "load_log": q(f"select batch_id, count(*) n_rows, count(*) filter (validation_reason is null) n_valid, count(*) filter (validation_reason is not null) n_invalid, case batch_id when 'batch-1' then (select count(*) from one where day_date <= {CUT}) "
    f"else (select count(*) from one where day_date > {CUT}) end n_written, false skipped from (select t.*, case when d.day_date <= '2000-12-31' then 'batch-1' else 'batch-2' end batch_id from tagged t join dirty d using (row_id)) group by batch_id "
    "union all select 'batch-3', 0, 0, 0, 0, true union all select 'rate limit', count(distinct symbol), null, null, null, null from dirty where not day_date <= '2000-12-31'", *TAGGED, "one"),
    "stream_silver": q("select * from silver", *SILVER), "tick_bars": TICKS, "stream_bars": TICKS,
    "stream_upsert": q("select * from silver", *SILVER), "stream_hourly": TICKS.replace("'day'", "'hour'").replace("from events", f"from events where not ({HELD})"), "stream_late": f"select event_id, event_type from events where {HELD}", "stream_daily": TICKS,
    "stream_dedupe": "select event_id, event_type, user_id from events",
    "silver_weekly": q(f"select symbol, week_date, {', '.join(f'{rnd(p)} {p}' for p in PRICES)}, volume, {CHANGE.format(p='weekly')}, {MOVE}, {calendar('week_date', 'year', 'month', 'week_number')}, date '2001-08-01' last_refreshed_date, 'VALID' validation_status, cast(null as varchar) validation_reason, {STAMP} from weekly_bars", "weekly_bars"),
    "silver_daily": q("select * from silver", *SILVER),
    "silver_overview": q(f"select row_id, {wide_columns()}, {STAMPED} from wide", "wide"),
    "gold_dataset": q(f"select s.*, country, latest_quarter, fifty_two_week_high, analyst_rating_buy from (select {GOLD_BARS} from silver) s left join last_over using (symbol)", *SILVER, *OVER, "last_over"),
    "silver_videos": VIDEO,
    "silver_trending": "select cast(doc_id as varchar) video_id, lang title, n_chars views, source tags from documents",
    "medallion_run": q(f"select s.*, country, latest_quarter, fifty_two_week_high, analyst_rating_buy from (select {GOLD_BARS} from silver) s left join last_over using (symbol)", *SILVER, *OVER, "last_over"),
}
