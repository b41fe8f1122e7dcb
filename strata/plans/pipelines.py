"""Bronze to silver to gold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import clean, dedupe, enrich, gold, incremental, partials, quality, reshape, stats
from strata.operators.joins import joined
from strata.sources import readers, sinks
from strata.sources.commits import LOG, Attempt, Commits, path_of
from strata.spec import AS_OF_STATS, BAR_FIELDS, DAILY, GOLD_BARS, OVERVIEW_DEFAULTS, OVERVIEW_NAMES, PRICES, STATE_SCHEMA, BarSpec, overview_types, series_schema, struct


def typed_bars(bars: DataFrame, spec: BarSpec = DAILY) -> DataFrame:
    """String bars, cleaned, typed and tagged with the first rule that rejects them."""
    return quality.tag(clean.cast_by_spec(clean.clean_strings(bars, ["symbol"]), spec.types), spec.rules())


def silver_rows(tagged: DataFrame, spec: BarSpec, order: list[str], run_ts: str) -> DataFrame:
    """Valid bars, one per symbol and date (smallest order columns), rounded and enriched, without statistics."""
    valid, _ = quality.split(tagged)
    one = dedupe.keep_one(valid, ["symbol", spec.date], [F.col(c) for c in order])
    rows = enrich.movement(enrich.price_change(clean.round_cols(one, list(PRICES)), spec.prefix))
    rows = clean.stamp(enrich.calendar(rows, spec.date, spec.calendar), run_ts, parts=False)
    return rows.withColumnRenamed("last_refreshed", "last_refreshed_date")


def silver_bars(bars: DataFrame, spec: BarSpec, order: list[str], as_of: str, run_ts: str, strategy: str = "window") -> DataFrame:
    """String bars (symbol, date, last_refreshed, prices, volume and the order columns) to silver."""
    rows = silver_rows(typed_bars(bars, spec), spec, order, run_ts)
    if spec.stats:
        rows = stats.as_of_stats(rows, ["symbol"], spec.date, as_of, strategy)
    return rows.select(*spec.columns)


def silver_documents(documents: DataFrame, spec: BarSpec, as_of: str, run_ts: str, after: str | None = None) -> DataFrame:
    """Series documents to silver; a symbol's date occurs once in a document, so the newest document wins."""
    bars = reshape.bars_of(documents, spec.series, spec.date, BAR_FIELDS, after)
    return silver_bars(newest_first(bars), spec, ["newest", *PRICES, "volume"], as_of, run_ts)


def newest_first(bars: DataFrame) -> DataFrame:
    """With a column that is smaller the later a bar's document was refreshed."""
    return bars.withColumn("newest", F.expr("-unix_date(try_to_date(trim(last_refreshed), 'yyyy-MM-dd'))"))


def silver_overview(records: DataFrame, run_ts: str, parts: bool = True) -> DataFrame:
    """Overview records (strings; columns beyond the fields are dropped, save those the caller renames later) to silver."""
    rows = clean.clean_strings(records.select(*(n for n in OVERVIEW_NAMES)), ["Symbol"])
    rows = clean.cast_by_spec(clean.impute(rows, OVERVIEW_DEFAULTS), overview_types())
    return clean.stamp(reshape.rename(rows, OVERVIEW_NAMES), run_ts, parts=parts)


def gold_dataset(bars: DataFrame, overview: DataFrame, stored: bool = False) -> DataFrame:
    """Silver bars with their overview; the 52-week range is the overview's."""
    return gold.enrich_left(bars.select(*GOLD_BARS), overview, stored=stored)


def trailing_stats(rows: DataFrame, keys: list[str], day: str, limit: int | None = None) -> DataFrame:
    """rows with rolling and running statistics (see partials.trailing), whatever the number of rows of a key or a day. Their
    days are stored on the way."""
    days = partials.trailing(partials.by_day(rows, keys, day), keys, day)
    return partials.attach(rows, sinks.write_parquet(days, sinks.scratch(rows.sparkSession)), keys, day, limit)


def silver_videos(documents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Search results to one row per video: of several the one published last."""
    item = lambda *names: ("item", *names)
    rows = reshape.project(reshape.explode_array(documents.select("items"), "items", "item"), {
        "video_id": item("id", "videoId"), "channel_id": item("snippet", "channelId"), "channel_title": item("snippet", "channelTitle"),
        "channel_description": item("snippet", "description"), "publish_time": item("snippet", "publishTime"), "publish_at": item("snippet", "publishedAt"), "kind": item("id", "kind"),
    })
    return dedupe.latest(rows.where("video_id is not null"), ["video_id"], order or ["publish_at", "publish_time", "channel_id", "channel_title", "channel_description", "kind"])


def silver_trending(rows: DataFrame) -> DataFrame:
    """The trending columns, without rows that lack a video or a title."""
    from strata.spec import TRENDING_SCHEMA

    return rows.select(*TRENDING_SCHEMA.names).where("video_id is not null and title is not null")


#: What a load stores of a bar: its silver columns without as-of statistics.
STORED = [c for c in DAILY.columns if c not in AS_OF_STATS]
STATE, BARS, BLOCKS, QUARANTINE, FILES, DOCUMENTS = "state", "silver", "blocks", "quarantine", "files", "rejected_documents"
BLOCK = struct("symbol", month="date", n_open="bigint", sum_open="double", n_close="bigint", sum_close="double", high="double", low="double")
FILE = struct("path", modified="timestamp", bytes="bigint")
REJECTED = struct("dataset", "key", "value", "error")
KINDS = {**DAILY.types, **dict.fromkeys(("daily_change", "daily_change_percentage"), "double"), "last_refreshed_date": "date", "processed_at": "timestamp", **dict.fromkeys(("year", "month", "day"), "int")}
BAR = struct(**{c: KINDS.get(c, "string") for c in STORED})


@dataclass
class Run:
    """Where a lake lies and what a run is called. Each load of a batch is a try of its own (see commits): what it wrote counts
    once its commit record stands, and then instead of what earlier tries of that batch wrote."""

    spark: SparkSession
    root: str
    batch_id: str
    run_ts: str
    as_of: str
    pipeline: str = "bars"

    def commits(self, dataset: str = DAILY.name) -> Commits:
        return Commits(self.spark, self.root, dataset)

    def state_before(self, dataset: str, attempt: Attempt | None = None) -> DataFrame:
        """State records of the batches that count, with seq; of those before attempt's batch alone, if it is given."""
        log = self.commits(dataset)
        return log.read(STATE, STATE_SCHEMA, [r for r in attempt.known if r["seq"] < attempt.seq] if attempt else None)

    @property
    def state(self) -> DataFrame:
        return self.state_before(DAILY.name).unionByName(self.state_before("overview")).select(*STATE_SCHEMA.names)

    def bars(self) -> DataFrame:
        """Stored bars as they stand: of each symbol and date the row of the last batch."""
        return dedupe.latest(self.commits().read(BARS, BAR), ["symbol", "day_date"], ["seq"]).drop("seq", "version")

    def quarantine(self) -> DataFrame:
        """batch_id, and rejected bars of the batches that count."""
        log = self.commits()
        paths = [path_of(self.root, DAILY.name, QUARANTINE, r["batch_id"], r["attempt"]) for r in log.current() if QUARANTINE in r["parts"]]
        return self.spark.read.parquet(*paths).drop("seq", "version") if paths else self.spark.createDataFrame([], "batch_id string, validation_reason string")

    def rejected_documents(self) -> DataFrame:
        return self.commits().read(DOCUMENTS, REJECTED).drop("seq", "version")

    def log(self) -> DataFrame:
        """One row a batch: its counts and marks."""
        return self.commits().log()

    def daily(self, bars: DataFrame, lateness: int = 0, order: tuple[str, ...] = ("row_id",), attempt: Attempt | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
        """Loads the bars past each symbol's mark and returns the run's metrics, one row, which are also logged.

        Marks are those of the batches before this one, so a batch that is repeated, with the same rows, with more, or with
        another lateness, loads what it would have loaded the first time; its new try replaces the old one, in data, state and
        log at once. A crash before the commit leaves all as it was. Batches loaded since keep what they loaded, and their rows
        win. Without bars past a mark no silver and no state is written. Stored rows have no as-of statistics, which later
        loads would make stale: silver adds them to all rows. Of the months that the load touched, blocks of partial sums and
        extremes are written anew. attempt, parts: a try that has begun, and what it has written so far.
        """
        log = self.commits()
        attempt = attempt or log.begin(self.batch_id)
        marks = incremental.latest_state(self.state_before(DAILY.name, attempt), order=("seq",)).select(F.col("watermark_key").alias("symbol"), F.col("watermark_value").cast("date").alias("mark"))
        tagged, seen = quality.observed_counts(typed_bars(bars), f"bars-{attempt.attempt}")
        tagged = log.write(tagged, attempt, "tagged").drop("seq", "version")
        valid, rejected = quality.split(tagged)
        log.write(rejected.withColumn("batch_id", F.lit(self.batch_id)), attempt, QUARANTINE)
        late = incremental.after_mark(valid, marks, ["symbol"], "day_date", lateness)
        old, new, n, parts = marks.agg(F.max("mark")).first()[0], None, 0, (*parts, QUARANTINE)
        if not incremental.is_empty(late):
            fresh = silver_rows(late, DAILY, list(order), self.run_ts)
            wrote = log.write(fresh.select(*STORED), attempt, BARS, ("symbol", "day_date"))
            by_symbol = incremental.new_marks(wrote, ["symbol"], "day_date").join(marks.withColumnRenamed("mark", "before"), "symbol", "left")
            by_symbol = by_symbol.select("symbol", F.greatest("mark", "before").alias("mark"))  # a late row doesn't move a mark back
            log.write(incremental.state_rows(by_symbol, self.pipeline, DAILY.name, "day_date", "symbol", self.batch_id, self.run_ts), attempt, STATE)
            n, new = wrote.agg(F.count("*"), F.max("day_date")).first()
            parts = (*parts, BARS, STATE)
        if n or attempt.number > 1:
            self.write_blocks(log, attempt, n > 0)
            parts = (*parts, BLOCKS)
        counts = seen.get
        row = (*(counts[k] for k in ("n_rows", "n_valid", "n_invalid")), n, old, max(filter(None, (old, new)), default=None), n == 0)
        log.commit(attempt, row, parts)
        return self.spark.createDataFrame([(self.batch_id, *row)], LOG)

    def write_blocks(self, log: Commits, attempt: Attempt, wrote: bool) -> None:
        """Blocks of the months that this try or the one that it replaces touched, over the bars as they stand with it. Of
        stored bars those of the touched span of dates are read, which their files' ranges tell."""
        replaced, others = ([r for r in attempt.known if (r["batch_id"] == attempt.batch_id) == same] for same in (True, False))
        month, mine = F.trunc("day_date", "month").alias("month"), attempt if wrote else None
        touched = log.read(BARS, BAR, [], mine).select("symbol", month).unionByName(log.read(BLOCKS, BLOCK, replaced).select("symbol", "month")).distinct()
        low, high = touched.agg(F.min("month"), F.last_day(F.max("month"))).first()
        span = log.read(BARS, BAR, others, mine).where(F.col("day_date").between(low, high))
        now = dedupe.latest(span, ["symbol", "day_date"], ["seq"]).withColumn("month", month).join(touched, ["symbol", "month"], "left_semi")
        # a month that the replaced try alone had is empty now: its row of nulls says so
        made = touched.join(partials.blocks(now, ["symbol"], "day_date"), ["symbol", "month"], "left")
        log.write(made.select(*BLOCK.names), attempt, BLOCKS)

    def daily_files(self, landing: str, lateness: int = 0, series: BarSpec = DAILY) -> DataFrame:
        """Loads the documents of landed files that no other batch has read: error documents are kept apart, the others parsed,
        their bars loaded by daily. A batch that is repeated reads its own files again, and new ones."""
        log = self.commits()
        attempt = log.begin(self.batch_id)
        read = log.read(FILES, FILE, [r for r in attempt.known if r["batch_id"] != self.batch_id])
        fresh = log.write(readers.new_files(self.spark, landing, read), attempt, FILES)
        paths = [r["path"] for r in fresh.select("path").collect()]  # as many as Spark itself lists on the driver to read them
        documents = readers.read_landed_files(self.spark, landing, paths)
        data, errors = readers.split_error_payloads(documents)
        log.write(errors.select(*REJECTED.names), attempt, DOCUMENTS)
        rows = reshape.bars_of(readers.parse_documents(data, series_schema(series.series)), series.series, series.date, BAR_FIELDS)
        return self.daily(newest_first(rows), lateness, ("newest", *PRICES, "volume"), attempt, (FILES, DOCUMENTS))

    def silver(self, strategy: str = "window") -> DataFrame:
        """Silver bars as they stand, with statistics over all of them. strategy: "blocks" takes them from the stored blocks and
        the bars of two months, and joins a row per symbol; the others are those of stats.as_of_stats."""
        one = self.bars()
        if strategy != "blocks":
            return stats.as_of_stats(one, ["symbol"], "day_date", self.as_of, strategy).select(*DAILY.columns)
        summary = sinks.write_parquet(self.summary(), sinks.scratch(self.spark))
        return joined(one, summary, "symbol", "left").select(*DAILY.columns)

    def summary(self) -> DataFrame:
        """The as-of statistics of each symbol, from blocks."""
        log = self.commits()
        months = dedupe.latest(log.read(BLOCKS, BLOCK), ["symbol", "month"], ["version"]).where("high is not null")
        days = log.read(BARS, BAR).where(partials.cut_months("day_date", self.as_of))
        return partials.as_of_summary(months, dedupe.latest(days, ["symbol", "day_date"], ["seq"]), ["symbol"], "day_date", self.as_of)

    def overview(self, records: DataFrame) -> DataFrame:
        """Writes the overview if its content isn't that of the batches before, and returns one row: content_hash, previous_hash,
        changed."""
        log = self.commits("overview")
        attempt = log.begin(self.batch_id)
        rows = silver_overview(records, self.run_ts)
        rows = dedupe.latest(rows.where("symbol is not null"), ["symbol"], ["latest_quarter", "market_cap", "company_name"])
        exclude = ("year", "month", "day", "processed_at")
        before = incremental.latest_state(self.state_before("overview", attempt), order=("seq",)).select(*STATE_SCHEMA.names)
        verdict = incremental.hash_changed(rows, before, "overview", exclude).first()
        parts = ()
        if verdict["changed"]:
            wrote = log.write(rows, attempt, "silver")
            sinks.write_csv(wrote.drop("seq", "version"), attempt.path("csv"))
            marks = self.spark.range(1).select(F.lit(None).cast("date").alias("mark"))
            log.write(incremental.state_rows(marks, self.pipeline, "overview", "content_hash", "", self.batch_id, self.run_ts, verdict["content_hash"]), attempt, STATE)
            parts = ("silver", "csv", STATE)
        log.commit(attempt, (None, None, None, None, None, None, not parts), parts)
        return self.spark.createDataFrame([tuple(verdict)], "content_hash string, previous_hash string, changed boolean")

    def overview_rows(self) -> DataFrame:
        """The overview as it stands: that of the last batch that changed it."""
        log = self.commits("overview")
        last = [r for r in log.current() if "silver" in r["parts"]][-1]
        return self.spark.read.parquet(path_of(self.root, "overview", "silver", last["batch_id"], last["attempt"])).drop("seq", "version")

    def gold(self, strategy: str = "blocks") -> DataFrame:
        """Gold over all of silver, with the overview. Stored bars are read once, and those of two months for the statistics."""
        return sinks.write_dual(gold_dataset(self.silver(strategy), self.overview_rows(), stored=True), f"{self.root}/gold")
