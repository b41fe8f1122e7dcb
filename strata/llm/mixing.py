"""Mixing sources to target weights, with DataFrame operations only.

Each source has a target of words. Whole epochs of the source come first; what remains is drawn by weighted sampling
without replacement: every document gets the key -ln(u) / weight with u a hash of its id, and the documents of the
smallest keys are taken until their prefix sum reaches the rest. Prefix sums are two-level (buckets of a source, then
documents of a bucket), so that no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import joined, materialise

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Documents of a bucket, about: a task's share of a source.
BUCKET = 2_000
#: Bins of the logarithm of weights, from LEAST up to 1, by which the spread of a source's keys is told.
BINS, LEAST = 24, 0.1


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """0.1 to 1: nearer to 1 the closer the mean word length is to that of prose (five letters); from lengths alone."""
    mean = F.coalesce(F.try_divide(F.length(text).cast("double"), size), F.lit(0.0))
    return F.lit(LEAST) + F.lit(1 - LEAST) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0)


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the MD5 digest of the id: the same in every run and every engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def weight_bins(weight: Column) -> Column:
    """An array of (p, w): the share of the rows in each bin of weights, and their mean weight."""
    which = F.least(F.floor(F.log(weight / LEAST) / F.log(F.lit(1 / LEAST)) * BINS), F.lit(BINS - 1))
    return F.array(*(F.struct((F.count_if(which == i) / F.count("*")).alias("p"), F.coalesce(F.avg(F.when(which == i, weight)), F.lit(0.0)).alias("w")) for i in range(BINS)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: `share` of all sizes is split by weight, weights going round the sources in order of
    code point (null last); a source stops at `epochs` times its size and the others share the excess by weight.

    With level = target per weight, a source stops if the level reaches epochs * size / weight. With sources ordered
    by that bound, (total - what the stopped ones before hold) / (weights of the rest) falls once it is under the next
    bound, so the level is the largest of these. The input has one row a source.
    """
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumns({"weight": weight, "cap": (epochs * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(one) * share})
    before = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumns({"level": left / rest}).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(one))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, bucket: int = BUCKET, quality: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies), drawn (boolean) and taken of every document.

    docs: doc_id, text, source; other columns are ignored. quality: a column of docs with a score from 0 to 1 to draw by;
    by default the words' mean length stands in. Whole texts are measured, however long. Null text: size 0; a null score
    or NaN counts as 0; a null source is a source of its own, null ids are alike. Rows of equal id and text are drawn in a row and
    each counts; an empty table gives an empty one; with no words at all every target is 0. A document is drawn if the prefix sum's rest reaches at least its middle, so a
    source misses its target by half a document at most.
    """
    weight = quality_weight(F.coalesce("text", F.lit("")), size_of(F.col("text"))) if quality is None else F.lit(LEAST) + F.lit(1 - LEAST) * F.least(F.greatest(F.nanvl(F.coalesce(F.col(f"`{quality}`").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), weight.alias("weight"))
    rows = materialise(sized.select("doc_id", "source", "size", "weight", (-F.log(uniform(F.col("doc_id"))) / F.col("weight")).alias("key")))
    per = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"), weight_bins(F.col("weight")).alias("bins")))
    goal = materialise(targets(per.select("source", "source_size"), weights, share, epochs).withColumnRenamed("source", "src").join(per.select(F.col("source").alias("src2"), "n_rows", "bins"), F.expr("src <=> src2")).drop("src2"))
    rows = joined(rows.drop("weight"), goal, F.expr("source <=> src"), "left")
    # A key of weight w is below x with probability 1 - exp(-w * x); so this mean over the source's weights grows with the
    # key and is spread over 0 to 1: its buckets are of like size, whatever the weights, and keep the keys' order.
    spread = 1 - F.aggregate("bins", F.lit(0.0), lambda so_far, x: so_far + x["p"] * F.exp(-x["w"] * F.col("key")))
    rows = rows.withColumn("bucket", F.floor(spread * F.ceil(F.col("n_rows") / bucket)).cast("long")).drop("bins")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(totals.select(F.col("source").alias("src3"), F.col("bucket").alias("bucket3"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")))
    rows = joined(rows, offsets, F.expr("source <=> src3 and bucket = bucket3"), "left")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    until = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    rows = rows.withColumns({"epochs": whole, "until": until})
    drawn = (F.col("epochs") < epochs) & (F.col("size") > 0) & (F.col("until") + F.col("size") / 2 <= F.col("target") - F.col("epochs") * F.col("source_size"))
    return rows.withColumn("drawn", drawn).select("doc_id", "source", "size", "source_size", "target", "epochs", "drawn", (F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs' rows as the mix repeats them: `epochs` times, once more if drawn. Rows of one id are taken alike.

    The mix is per row and documents have ids of their own; rows that share an id are put together by their mean copies,
    rounded up, so that none is lost. A row of size 0 stays as often as its source has whole epochs.
    """
    copies = mix(docs, **how).groupBy("doc_id").agg(F.ceil(F.avg(F.col("epochs") + F.col("drawn").cast("long"))).cast("int").alias("__copies")).where("__copies > 0")
    rows = joined(docs, materialise(copies).withColumnRenamed("doc_id", "__doc_id"), F.expr("doc_id <=> __doc_id"), "inner")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__doc_id", "__copies", "__copy")


# DuckDB SQL for mix's rows over `documents`, with the default weights, share and epochs.
MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, coalesce(length(text), 0)::double chars from documents),
k as (select doc_id, source, size, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
        / (0.1 + 0.9 / (1.0 + abs(coalesce(chars / nullif(size, 0), 0.0) - 6.0) / 6.0)) as key from d),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source is null, encode(source)) - 1 as r from k group by source),
w as (select source, source_size, case r % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end::double weight, (2 * source_size)::double cap, (sum(source_size) over ())::double * 1.5::double total from s),
l as (select *, (total - coalesce(sum(cap) over b, 0)) / ((sum(weight) over ()) - coalesce(sum(weight) over b, 0)) as level from w
      window b as (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap, coalesce(max(case when level * weight <= cap then level end) over () * weight, cap)) target from l),
p as (select k.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::bigint epochs,
        coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::double as upto
      from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (epochs + case when epochs < 2 and size > 0 and upto + size / 2.0::double <= target - epochs * source_size then 1 else 0 end))::bigint taken from p
"""
