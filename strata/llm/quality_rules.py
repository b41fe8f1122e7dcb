"""Quality rules with thresholds that follow the data: quantile sketches per language and source instead of fixed cutoffs.

A sketch is a count of zeros and a histogram of the values above zero over logarithmic bins (relative error below 1%):
sketches merge by adding counts, so partial aggregation does the work, no group meets in one task, and a rerun gives the same
thresholds. Where the values above zero lie, how far they spread, and how rare they are make a group's fence.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import joined, map_rows, materialise

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW = 5
#: Statistic: a count, and of how many it is.
STATS = {"symbol_share": ("n_symbols", "word_chars"), "mark_share": ("n_marks", "word_chars"), "upper_share": ("n_upper", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
#: Fence, in odds: q75 * (q75 / q25) ** FENCE, the exponent RARE less for each tenfold that values above zero are rarer. A
#: count must pass its fence by CHANCE standard deviations. Quantiles of n values weigh against those of the language as by
#: PRIOR of these, and these likewise against those of all.
FENCE, RARE, CHANCE, PRIOR = 3.0, 0.5, 3.0, 100
#: Bins grow by GAMMA from LEAST; a share counts as MOST at most.
GAMMA, LEAST, MOST = 1.02, 1e-4, 0.999
MARKS = np.array([c < 128 and not chr(c).isalnum() and chr(c) not in " \t\n\x0b\x0c\r" for c in range(256)])
UPPER = np.array([c < 128 and chr(c).isupper() for c in range(256)])
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long"


def count_text(text: str) -> tuple[int, ...]:
    """The counts of COUNTS of one whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), int(by_byte[MARKS].sum()), int(by_byte[UPPER].sum())


def repeated_words(words: list) -> int:
    """How many words stand in a window of five words that occurs at least twice, the first one included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered[i : i + WINDOW] = True
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text (null: none)."""
    def make():
        def handle(batch):
            for *key, text in zip(batch["doc_id"], batch["lang"], batch["source"], batch["text"], strict=True):
                yield *key, *count_text(text or "")
        return handle

    return map_rows(docs.select("doc_id", "lang", "source", "text"), make, f"doc_id long, lang string, source string, {COUNTS}")


def shares() -> dict[str, Column]:
    return {s: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0)) for s, (n, of) in STATS.items()}


def sketch(rows: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """keys, stat, bin, n: the mergeable sketch of each statistic; merging is a sum of n over fewer keys. Bin 0 has the zeros."""
    binned = lambda c: F.when(F.col(c) <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), 1 + F.ceil(F.log(F.col(c) / LEAST) / np.log(GAMMA)).cast("int")))
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), binned(s).alias("bin")) for s in stats))).alias("x"))
    return long.groupBy(*keys, "x.stat", "x.bin").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """keys, stat, n_rows, n_above (values above zero) and a column for each wanted quantile of these: the upper edge of the
    first bin that reaches it; null without such values."""
    group = Window.partitionBy(*keys, "stat")
    above = F.when(F.col("bin") > 0, F.col("n")).otherwise(0)
    run = sketches.groupBy(*keys, "stat", "bin").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum(above).over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "n_above": F.sum(above).over(group)})
    edge = LEAST * F.pow(F.lit(GAMMA), F.col("bin") - 1)
    reached = lambda q: (F.col("bin") > 0) & (F.col("upto") >= q * F.col("n_above"))
    return run.groupBy(*keys, "stat").agg(F.sum("n").alias("n_rows"), F.first("n_above").alias("n_above"), *(F.min(F.when(reached(q), edge)).alias(name) for name, q in wanted.items()))


def thresholds(rows: DataFrame, stats: tuple[str, ...] = tuple(STATS), fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """key (language and source), stat, above (the share of values above zero), q25, q75 and fence, for each pair of language
    and source in rows. All of them are drawn to the language's, and those to the ones of all rows, by their numbers: they
    move smoothly with a group's size. A statistic that is 0 everywhere has no fence.
    """
    base = materialise(sketch(rows, ["key", "lang_key"], list(stats)))

    def at(keys: list[str], name: str) -> DataFrame:
        return quantiles(base, keys, {"q25": 0.25, "q75": 0.75}).select(*keys, "stat", F.struct("n_rows", "n_above", "q25", "q75").alias(name))

    every = at(["key", "lang_key"], "own").join(at(["lang_key"], "lang"), ["lang_key", "stat"]).join(at([], "all"), "stat")

    def drawn(of: str, n: str, start: Column) -> Column:
        value = start
        for group in ("lang", "own"):
            mine = F.col(f"{group}.{n}")
            value = (F.coalesce(F.col(f"{group}.{of}"), F.lit(0.0)) * (mine if of != "n_above" else 1) + prior * value) / (mine + prior)
        return value

    capped = lambda c: F.when(c > MOST, F.lit(MOST)).otherwise(c)
    every = every.select("key", "stat", drawn("n_above", "n_rows", F.col("all.n_above") / F.col("all.n_rows")).alias("above"), *(capped(drawn(q, "n_above", F.col(f"all.{q}"))).alias(q) for q in ("q25", "q75")))
    odds = lambda c: F.col(c) / (1 - F.col(c))
    power = F.greatest(F.lit(0.0), fence + RARE * F.log10("above"))
    limit = odds("q75") * F.pow(odds("q75") / odds("q25"), power)
    return every.withColumn("fence", limit / (1 + limit))


def judge(docs: DataFrame, stats: tuple[str, ...] = tuple(STATS), fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """Each document's counts, base_failed, kept and the statistics that are past their fence (failed, comma-joined).

    docs: doc_id, text, lang, source; other columns are ignored. Whole texts are counted, however long. A null text counts as
    empty and fails the base rule; a null language or source is a group of its own; repeated rows, also of null id, each
    count and are judged alike; an empty table gives an empty one. Thresholds are those of documents that pass the base rule.
    A count is past its fence if it exceeds what a share at the fence gives by CHANCE standard deviations, so that short
    texts aren't rejected by chance.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialise(measure(docs)).withColumns({**shares(), "key": F.to_json(F.struct("lang", "source")), "lang_key": F.to_json(F.struct("lang")), "base_failed": base})
    limits = thresholds(rows.where(~F.col("base_failed")), stats, fence, prior).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("stat", "fence"))).alias("fences"))

    def past(stat: str) -> Column:
        n, of, limit = *map(F.col, STATS[stat]), F.col("fences")[stat]
        return n > limit * of + CHANCE * F.sqrt(of * limit * (1 - limit))

    found = joined(rows, materialise(limits), "key", "left").withColumn("failed", F.concat_ws(",", *(F.when(past(s), F.lit(s)) for s in stats)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")


# DuckDB SQL for judge's rows over `documents`, with the default statistics, fence and prior.
JUDGE_SQL = r"""
with d as (select row_number() over () r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, len(regexp_extract_all(text, '[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')) n_marks, len(regexp_extract_all(text, '[A-Z]')) n_upper from d),
p as (select r, i, words[i:i + 4] five from (select r, words, unnest(range(1, greatest(len(words) - 3, 1))) i from w)),
often as (select r, i from p qualify count(*) over (partition by r, five) > 1),
hit as (select r, count(distinct i + j)::bigint n from often, (select unnest(range(5)) j) group by 1),
c as (select r, doc_id, lang, source, len(words)::bigint n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint word_chars, n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(lines) n_lines, n_marks, n_upper from w left join hit using (r)),
s as (select r, base, concat(lang is null, '|', lang) lang_key, concat(lang is null, '|', lang, '|', source is null, '|', source) key, unnest([
        {'stat': 'symbol_share', 'c': n_symbols::double, 'm': word_chars::double}, {'stat': 'mark_share', 'c': n_marks::double, 'm': word_chars::double}, {'stat': 'upper_share', 'c': n_upper::double, 'm': word_chars::double},
        {'stat': 'dup_line_share', 'c': n_dup_lines::double, 'm': n_lines::double}, {'stat': 'repeat_share', 'c': n_repeat_words::double, 'm': n_words::double}], recursive := true)
      from (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base from c)),
b as (select level, case level when 2 then key when 1 then lang_key else '' end as k, stat, case when c <= 0 or m <= 0 then 0 else greatest(1, 1 + ceil(ln(c / m / 1e-4::double) / ln(1.02::double))::int) end bin, count(*) n
      from s, (select unnest([0, 1, 2]) as level) where not base group by all),
u as (select *, case when bin > 0 then sum(n) filter (bin > 0) over (partition by level, k, stat order by bin) end upto, sum(n) filter (bin > 0) over (partition by level, k, stat) n_above, 1e-4::double * pow(1.02::double, bin - 1) edge from b),
q as (select level, k, stat, sum(n)::double n_rows, coalesce(any_value(n_above), 0)::double n_above, min(edge) filter (upto >= 0.25 * n_above) q25, min(edge) filter (upto >= 0.75 * n_above) q75 from u group by 1, 2, 3),
l as (select l.k, l.stat, (l.n_above + 100 * a.n_above / a.n_rows) / (l.n_rows + 100) above, (coalesce(l.n_above * l.q25, 0) + 100 * a.q25) / (l.n_above + 100) q25, (coalesce(l.n_above * l.q75, 0) + 100 * a.q75) / (l.n_above + 100) q75
      from q l join q a on a.stat = l.stat and l.level = 1 and a.level = 0),
o as (select o.k, o.stat, (o.n_above + 100 * above) / (o.n_rows + 100) above, least((coalesce(o.n_above * o.q25, 0) + 100 * l.q25) / (o.n_above + 100), 0.999) q25, least((coalesce(o.n_above * o.q75, 0) + 100 * l.q75) / (o.n_above + 100), 0.999) q75
      from q o join l on l.stat = o.stat and o.level = 2 and l.k = (select any_value(lang_key) from s where s.key = o.k)),
e as (select k, stat, q75 / (1 - q75) * pow(q75 / (1 - q75) / (q25 / (1 - q25)), greatest(0, 3.0::double + 0.5::double * log10(above))) odds from o where q75 is not null),
f as (select r, string_agg(s.stat, ',' order by array_position(['symbol_share', 'mark_share', 'upper_share', 'dup_line_share', 'repeat_share'], s.stat)) failed
      from s join (select k, stat, odds / (1 + odds) fence from e) e on e.k = s.key and e.stat = s.stat where c > fence * m + 3.0::double * sqrt(m * fence * (1 - fence)) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and failed is null as kept, coalesce(failed, '') failed from c left join f using (r)
"""
