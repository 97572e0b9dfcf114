"""Mixing sources to target weights by capped water-filling, then seeded sampling.

Each source may be repeated at most max_epochs times.  Sources whose share of
the budget would exceed that are clamped there and the excess goes to the
others in proportion to their weights, until all fit: allocation = min(cap,
level x weight), with the one level at which the allocations fill the budget.
The level follows from one sort by cap / weight and running sums, so no loop
is needed.  epochs = allocation / size; a document is taken floor(epochs)
times, and once more if the uniform number that MD5 makes of the seed and its
id lies under the fraction.

Defined results: a null source is a source of its own; a null or negative
n_chars counts 0 characters; sources without characters or weight get no
repetition; if even all caps don't fill the budget every source stands at its
cap; rows with equal ids are drawn alike; a null id is drawn as the empty
string; ties of cap / weight go by source name; an empty table gives no rows;
other columns are ignored (mixed) or kept (resample).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MAX_EPOCHS, ALPHA, SEED = 4.0, 0.7, 17
#: A plan of more sources than this isn't broadcast; the join then shuffles, and AQE splits the hot sources.
BROADCAST_SOURCES = 10_000


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def water_fill(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(key, size, weight) -> (key, epochs).  The budget is the total size unless given.

    The windows run over one row a source, not over documents.
    """
    if max_epochs <= 0 or (budget is not None and budget < 0):
        raise ValueError("max_epochs must be positive and the budget not negative")
    whole = Window.partitionBy()
    order = whole.orderBy("ratio", "key")
    total = F.lit(float(budget)) if budget is not None else F.sum("size").over(whole)
    ranked = (
        sizes.where("size > 0 and weight > 0").withColumn("cap", F.col("size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", total)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ahead", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", F.row_number().over(order)).withColumn("lam", F.col("left") / F.col("ahead"))
    )
    level = F.min(F.when(F.col("lam") < F.col("ratio"), F.struct("at", "lam"))).over(whole)
    level = ranked.withColumn("level", level["lam"])
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("level")) * F.col("weight")))
    return level.select("key", (share / F.col("size")).alias("epochs"))


def plan(docs: DataFrame, weights: dict | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(key, epochs) of each source; target weights are given, or size ** alpha."""
    size = F.sum(F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0))).cast("double")
    sizes = docs.groupBy(_key(F.col("source")).alias("key")).agg(size.alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        rows = [("null" if k is None else f"={k}", float(w)) for k, w in weights.items()]
        sizes = sizes.join(docs.sparkSession.createDataFrame(rows, "key string, weight double"), "key", "left")
    return water_fill(sizes, max_epochs, budget)


def _repeats(doc_id: Column, epochs: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    whole = F.floor(epochs)
    return (whole + F.when(u < epochs - whole, 1).otherwise(0)).cast("int")


def resample(docs: DataFrame, weights: dict | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None, alpha: float = ALPHA, seed: int = SEED, number: str | None = None) -> DataFrame:
    """docs, each row as often as the mixture takes it; number names a column for 1, 2, ... of the repetitions."""
    plans = stored(plan(docs, weights, max_epochs, budget, alpha).toDF("_lw_key", "_lw_epochs"), "op5-plan")
    plans = F.broadcast(plans) if plans.count() <= BROADCAST_SOURCES else plans
    cols = [docs[c] for c in docs.columns]
    rows = docs.join(plans, _key(docs["source"]) == plans["_lw_key"])
    times = _repeats(docs["doc_id"], F.col("_lw_epochs"), seed)
    taken = rows.withColumn("_lw_times", times).where("_lw_times > 0")
    out = taken.select(*cols, F.explode(F.sequence(F.lit(1), F.col("_lw_times"))).alias("_lw_n"))
    return out.withColumnRenamed("_lw_n", number) if number else out.drop("_lw_n")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, repetition)."""
    return resample(docs.select("doc_id", "source", "n_chars"), number="repetition", **how).select("doc_id", "source", "repetition")


def sql(docs: str = "documents", max_epochs: float = MAX_EPOCHS, alpha: float = ALPHA, seed: int = SEED) -> str:
    """The common table expressions up to mixed(doc_id, source, repetition)."""
    return f"""
sized as (select coalesce('=' || source, 'null') as key, sum(greatest(coalesce(n_chars, 0), 0))::double as size from {docs} group by 1),
caps as (select key, size, pow(size, {alpha}) as weight, size * {max_epochs} as cap, size * {max_epochs} / pow(size, {alpha}) as ratio, sum(size) over () as budget from sized where size > 0),
levels as (select *, row_number() over (order by ratio, key) as nth,
           (budget - coalesce(sum(cap) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, key rows between current row and unbounded following) as lam from caps),
epochs as (select key, least(cap, coalesce((select arg_min(lam, nth) from levels where lam < ratio) * weight, cap)) / size as epochs from levels),
drawn as (select d.*, floor(epochs)::integer + case when ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double < epochs - floor(epochs) then 1 else 0 end as times
          from {docs} d join epochs e on coalesce('=' || source, 'null') = e.key),
mixed as (select * exclude (times), unnest(range(1, times + 1))::integer as repetition from drawn where times > 0)"""


def oracle() -> str:
    return f"with {sql()} select doc_id, source, repetition from mixed"
