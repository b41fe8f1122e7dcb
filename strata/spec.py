"""What a dataset is: schemas, types, defaults, names and rules that the operators are parameterised with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that stand for a missing value, compared after trimming and lower-casing.
NULL_TOKENS = ("", "n/a", "na", "null", "none", "-")

# A document with one of these keys at its top is an error message, not data.
ERROR_KEYS = ("Information", "Note", "Error Message")

# Fields of the overview record and their names in silver.
OVERVIEW_NAMES = {
    "Symbol": "symbol", "AssetType": "asset_type", "Name": "company_name", "CIK": "cik", "Exchange": "exchange", "Currency": "currency",
    "Country": "country", "Sector": "sector", "Industry": "industry", "OfficialSite": "official_site", "FiscalYearEnd": "fiscal_year_end",
    "LatestQuarter": "latest_quarter", "MarketCapitalization": "market_cap", "EBITDA": "ebitda", "PERatio": "pe_ratio", "PEGRatio": "peg_ratio",
    "BookValue": "book_value", "DividendPerShare": "dividend_per_share", "DividendYield": "dividend_yield", "EPS": "eps",
    "RevenuePerShareTTM": "revenue_per_share_ttm", "ProfitMargin": "profit_margin", "OperatingMarginTTM": "operating_margin_ttm",
    "ReturnOnAssetsTTM": "return_on_assets_ttm", "ReturnOnEquityTTM": "return_on_equity_ttm", "RevenueTTM": "revenue_ttm",
    "GrossProfitTTM": "gross_profit_ttm", "DilutedEPSTTM": "diluted_eps_ttm", "QuarterlyEarningsGrowthYOY": "quarterly_earnings_growth_yoy",
    "QuarterlyRevenueGrowthYOY": "quarterly_revenue_growth_yoy", "AnalystTargetPrice": "analyst_target_price",
    "AnalystRatingStrongBuy": "analyst_rating_strong_buy", "AnalystRatingBuy": "analyst_rating_buy", "AnalystRatingHold": "analyst_rating_hold",
    "AnalystRatingSell": "analyst_rating_sell", "AnalystRatingStrongSell": "analyst_rating_strong_sell", "TrailingPE": "trailing_pe",
    "ForwardPE": "forward_pe", "PriceToSalesRatioTTM": "price_to_sales_ratio_ttm", "PriceToBookRatio": "price_to_book_ratio",
    "EVToRevenue": "ev_to_revenue", "EVToEBITDA": "ev_to_ebitda", "Beta": "beta", "52WeekHigh": "fifty_two_week_high", "52WeekLow": "fifty_two_week_low",
    "50DayMovingAverage": "fifty_day_moving_average", "200DayMovingAverage": "two_hundred_day_moving_average", "SharesOutstanding": "shares_outstanding",
    "SharesFloat": "shares_float", "PercentInsiders": "percent_insiders", "PercentInstitutions": "percent_institutions",
    "DividendDate": "dividend_date", "ExDividendDate": "ex_dividend_date",
}

# The overview's types; of the other fields these are strings, the rest doubles.
OVERVIEW_STRINGS = ("Symbol", "AssetType", "Name", "Exchange", "Currency", "Country", "Sector", "Industry", "OfficialSite", "FiscalYearEnd")
OVERVIEW_INTS = ("CIK", "AnalystRatingStrongBuy", "AnalystRatingBuy", "AnalystRatingHold", "AnalystRatingSell", "AnalystRatingStrongSell")
OVERVIEW_LONGS = ("MarketCapitalization", "EBITDA", "RevenueTTM", "GrossProfitTTM", "SharesOutstanding", "SharesFloat")
OVERVIEW_DATES = ("LatestQuarter", "DividendDate", "ExDividendDate")
OVERVIEW_DEFAULTS = {"Country": "Unknown", "Sector": "Unknown", "Industry": "Unknown", "OfficialSite": "Not Available"}


def overview_types() -> dict[str, str]:
    """Field -> type of the fields that aren't strings."""
    named = {n: t for names, t in ((OVERVIEW_INTS, "int"), (OVERVIEW_LONGS, "bigint"), (OVERVIEW_DATES, "date")) for n in names}
    return {n: named.get(n, "double") for n in OVERVIEW_NAMES if n not in OVERVIEW_STRINGS}


BAR_FIELDS = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume"}
DAILY_SERIES, WEEKLY_SERIES = "Time Series (Daily)", "Weekly Time Series"


def series_schema(series: str) -> T.StructType:
    """A document of one symbol: its meta data and a map of date to prices, all strings."""
    return struct(**{"Meta Data": struct("2. Symbol", "3. Last Refreshed"), series: T.MapType(T.StringType(), struct(*BAR_FIELDS))})


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def struct(*names: str, **kinds: str | T.DataType) -> T.StructType:
    """A struct of string fields, and of fields of other kinds; needs no session, as parsing DDL does."""
    return T.StructType([T.StructField(n, TYPES[k] if isinstance(k, str) else k) for n, k in (dict.fromkeys(names, "string") | kinds).items()])


OVERVIEW_SCHEMA = struct(*OVERVIEW_NAMES)
SNIPPET = struct("assignable", "channelId", "channelTitle", "description", "liveBroadcastContent", "publishTime", "publishedAt", "thumbnails", "title")
ITEM = struct(etag="string", id=struct("kind", "videoId"), kind="string", snippet=SNIPPET)
ITEMS_SCHEMA = struct("etag", "kind", "nextPageToken", "regionCode", items=T.ArrayType(ITEM))
TRENDING_SCHEMA = struct(
    video_id="string", trending_date="date", title="string", channel_title="string", category_id="int", publish_time="timestamp", tags="string", views="bigint", likes="bigint", dislikes="bigint",
    comment_count="bigint", thumbnail_link="string", comments_disabled="boolean", ratings_disabled="boolean", video_error_or_removed="boolean", description="string",
)

# The names of the as-of statistics.
AS_OF_STATS = ("thirty_day_avg_open", "thirty_day_avg_close", "fifty_two_week_high", "fifty_two_week_low", "all_time_high", "all_time_low")
PRICES = ("open", "high", "low", "close")
Rule = tuple[str, Column]


def bar_rules(date: str, date_name: str) -> list[Rule]:
    """(reason, condition that rejects) in order; the first that holds is the row's reason."""
    missing = [("symbol", "Missing symbol"), (date, f"Missing or invalid {date_name} date"), ("last_refreshed", "Missing or invalid last refreshed date")]
    missing += [(p, f"Missing or invalid {p} price") for p in PRICES] + [("volume", "Missing or invalid volume")]
    rules = [(reason, F.col(c).isNull()) for c, reason in missing]
    rules += [(f"{p.capitalize()} price is not a number", F.isnan(p)) for p in PRICES]
    rules += [(f"{p.capitalize()} price must be greater than zero", F.col(p) <= 0) for p in PRICES]
    return rules + [("Volume cannot be negative", F.col("volume") < 0), ("High price cannot be lower than low price", F.col("high") < F.col("low"))]


@dataclass(frozen=True)
class BarSpec:
    """A series of price bars. prefix names the change columns; stats: whether as-of statistics are attached."""

    name: str
    date: str
    prefix: str
    series: str
    date_name: str
    calendar: tuple[str, ...]
    stats: bool
    keys: tuple[str, ...] = field(default=("symbol",))

    @property
    def types(self) -> dict[str, str]:
        return {self.date: "date", "last_refreshed": "date", **dict.fromkeys(PRICES, "double"), "volume": "bigint"}

    def rules(self) -> list[Rule]:
        return bar_rules(self.date, self.date_name)

    @property
    def columns(self) -> list[str]:
        change = [f"{self.prefix}_change", f"{self.prefix}_change_percentage", "market_movement"]
        bar = ["symbol", self.date, *PRICES, "volume", *change]
        audit = ["last_refreshed_date", "validation_status", "validation_reason"]
        return [*bar, *AS_OF_STATS, *audit, *self.calendar, "processed_at"] if self.stats else [*bar, *self.calendar, *audit, "processed_at"]


DAILY = BarSpec("daily", "day_date", "daily", DAILY_SERIES, "day", ("year", "month", "day"), True)
WEEKLY = BarSpec("weekly", "week_date", "weekly", WEEKLY_SERIES, "week", ("year", "month", "week_number"), False)

GOLD_BARS = ["symbol", "day_date", *PRICES, "volume", "daily_change", "daily_change_percentage", "market_movement", "thirty_day_avg_open", "thirty_day_avg_close", "all_time_high", "all_time_low", "processed_at"]

STATE_SCHEMA = struct(
    pipeline_name="string", dataset_name="string", watermark_column="string", watermark_key="string", watermark_value="string", last_processed_at="timestamp", batch_id="string", status="string",
    updated_at="timestamp", content_hash="string",
)
