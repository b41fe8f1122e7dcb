"""Filter interaction audit: which documents each of five filters removes, in every order of the filters.

Four filters look at a document alone. The fifth (an earlier document has the same text) is an existential self-join: a
left-semi join on hash, exact text and smaller doc_id. Its ids are united with those that fail the other filters; each
document's failures become a combination of bits, and all orders are worked out from the counts of combinations.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import joined, map_rows, materialise, part_of

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
SIGNS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A hash with more rows than TOGETHER, and than one HOT-th of all, is dealt over several tasks of the self-join.
TOGETHER, HOT = 512, 2000


def failures_alone(text: str) -> int:
    """The bits of A to D of one whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # at blanks and \t to \r, as bytes are
    capitals = len(data) - len(data.translate(None, CAPITALS))
    short, repeats = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    return BIT["A"] * short + BIT["B"] * repeats + BIT["C"] * (100 * capitals > 5 * len(text)) + BIT["D"] * (len(data.translate(None, SIGNS)) < len(data))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash of the text and the bits of A to D, a row per document."""
    def make():
        def handle(batch):
            for doc_id, source, h, text in zip(batch["doc_id"], batch["source"], batch["hash"], batch["text"], strict=True):
                yield doc_id, source, h, failures_alone(text or "")
        return handle

    rows = docs.select("doc_id", "source", part_of("text").alias("hash"), "text")
    return map_rows(rows, make, "doc_id long, source string, hash long, bits int")


def later_copies(docs: DataFrame, measured: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id and hash of the documents whose text a document with a smaller doc_id has.

    Texts move for hashes alone that several ids have. Of equal texts the smallest id is enough to compare with, so the right
    side has a row per text. limit: bytes of a side that are broadcast; beyond that both are shuffled. A hash with more rows
    than a task should hold is dealt over several, to each of which its few texts are copied.
    """
    known = measured.where("doc_id is not null")
    together = max(TOGETHER, measured.count() // HOT)
    shared = known.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = materialise(shared.select("hash", F.ceil(F.col("n") / together).alias("deals")))
    hot = shared.where("deals > 1")  # HOT rows at most, as each has more than 1 / HOT of all documents
    dealt = lambda df: df.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part_of("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = rows.join(F.broadcast(hot), "hash", "left").withColumn("deals", F.coalesce("deals", F.lit(1).cast("long"))).withColumn("deal", F.pmod(F.xxhash64("place"), "deals"))
    rows = joined(rows, dealt(shared), ["hash", "deal"], "left_semi", limit)
    first = dealt(materialise(rows.groupBy("hash", "text").agg(F.min("doc_id").alias("least"), F.max("deals").alias("deals"))))
    a, b = rows.alias("a"), first.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.deal") == F.col("b.deal")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.least") < F.col("a.doc_id"))
    return joined(a, b, same, "left_semi", limit).select("doc_id", "hash")


def combinations(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """part, bits, n, good, toxic: how many documents of each part fail just these filters, and how many of them are labelled."""
    measured = materialise(measure(docs))
    failing = measured.withColumn("n", F.lit(1).cast("long")).unionByName(later_copies(docs, measured, limit).select("doc_id", F.lit(None).cast("string").alias("source"), "hash", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n")))
    # rows of one id and text share E, whatever their source, so the source is a list of counts until the bits are known
    mask = failing.groupBy("doc_id", "hash", "source").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    mask = mask.groupBy("doc_id", "hash").agg(F.bit_or("bits").alias("bits"), F.collect_list(F.when(F.col("n") > 0, F.struct("source", "n"))).alias("parts"))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    known = mask.select("doc_id", "bits", F.explode("parts").alias("x")).select("doc_id", "bits", F.coalesce("x.source", F.lit("")).alias("part"), "x.n")
    rows = joined(known, materialise(told), "doc_id", "left", limit)
    count = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("part", "bits").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """For each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text (null: empty) and source (the part; null: empty string); labels: doc_id, quality, toxic. Other columns
    are ignored. A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z > 5 * code points; D: any of
    #$%&*|; E: a smaller doc_id has the same text, wherever it is and whether or not it was removed. A null id has no smaller
    one and is none's. Repeated rows each count; rows of one id don't make each other copies. A document is good or toxic if
    any of its labels says so; labels without a document, or with a null id, don't count. shapley sums what the step's filter
    removes over all 120 orders. Each part has 600 rows, zeros included; an empty table has no parts.
    """
    seen = combinations(docs, labels, limit).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("seen"))  # 32 at most
    steps = [{"filter_order": order, "step": i + 1, "own": BIT[f], "before": sum(BIT[g] for g in order[:i])} for order in ORDERS for i, f in enumerate(order)]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = seen.select("part", "seen", F.explode(plan).alias("s")).select("part", "seen", "s.*")
    bits = lambda x, c: x["bits"].bitwiseAND(F.col(c))
    fails = lambda x: bits(x, "own") != 0
    here = lambda x: fails(x) & (bits(x, "before") == 0)

    def total(which, value="n") -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("seen", zero, lambda sum_, x: sum_ + F.when(which(x), value(x) if callable(value) else x[value]).otherwise(zero))

    share = lambda x: x["n"] * F.lit(120) / F.bit_count(x["bits"])  # noqa: E731  # of the orders, in which it comes first
    return rows.select(
        "part", "filter_order", "step", total(lambda x: ~fails(x) & (bits(x, "before") == 0)).alias("kept"), total(here).alias("removed"),
        total(lambda x: fails(x) & (bits(x, "before") != 0)).alias("redundant"), total(lambda x: x["bits"] == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), total(fails, lambda x: share(x).cast("long")).alias("shapley"),
    )


# DuckDB SQL for audit's rows over `documents` and `labels`.
AUDIT_SQL = r"""
with d as (select row_number() over () r, doc_id, coalesce(source, '') part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words from d),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
m as (select w.r, part, (case when len(words) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
        + (case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 4 else 0 end) + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
        + (case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end) as bits, coalesce(good, 0) good, coalesce(toxic, 0) toxic from w left join l using (doc_id)),
c as (select part, bits, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
b as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(f, b)),
o as (select f1.f || f2.f || f3.f || f4.f || f5.f filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] bs from b f1, b f2, b f3, b f4, b f5 where f1.b + f2.b + f3.b + f4.b + f5.b = 31 and len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s as (select filter_order, step, bs[step] own, coalesce(list_sum(bs[:step - 1]), 0)::int before from o, (select unnest([1, 2, 3, 4, 5]) step)),
x as (select part, filter_order, step::int step, own, coalesce(sum(n) filter (bits & (own | before) = 0), 0)::bigint kept, coalesce(sum(n) filter (bits & own <> 0 and bits & before = 0), 0)::bigint removed,
        coalesce(sum(n) filter (bits & own <> 0 and bits & before <> 0), 0)::bigint redundant, coalesce(sum(n) filter (bits = own), 0)::bigint unique_fails,
        coalesce(sum(good) filter (bits & own <> 0 and bits & before = 0), 0)::bigint good_lost, coalesce(sum(toxic) filter (bits & own <> 0 and bits & before = 0), 0)::bigint toxic_lost from c, s group by all)
select * exclude (own), (sum(removed) over (partition by part, own))::bigint shapley from x
"""
