"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. The work on documents is one aggregation and one map-side decision; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut, table

#: A source may be repeated so many times at most.
MAX_EPOCHS = 3
SEED = 20_240_117
#: The sampling key has two levels of so many bins each.
BINS = 256


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame) -> DataFrame:
    """The default weights: sources by code point, null last, weigh 1, 2, 3, repeating. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """Adds target to rows of (source, source_size, weight).

    Sources share the budget (default: the sum of sizes) by weight. One whose share exceeds max_epochs times its size is
    clamped there and its excess is reshared by weight among the rest, until none is above. With sources in the order
    in which they clamp (capacity over weight), that fixed point is the first prefix whose water level does not exceed
    the next source's ratio, so running sums give it without iteration. Where the budget exceeds all capacities, every
    source gets its capacity. Sources without words or with no weight get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight"))
    rows = sources.withColumn("cap", cap).withColumn("ratio", ratio)
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    usable = F.col("ratio").isNotNull()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything).cast("double") if budget is None else F.lit(float(budget)))
        .withColumn("clamped", F.coalesce(F.sum(F.when(usable, F.col("cap"))).over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum(F.when(usable, F.col("weight"))).over(before), F.lit(0.0)))
        .withColumn("all_weight", F.sum(F.when(usable, F.col("weight"))).over(everything))
        .withColumn("level", F.when(usable, (F.col("total") - F.col("clamped")) / (F.col("all_weight") - F.col("gone"))))
        .withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    level = F.coalesce(F.col("final"), F.lit(float("inf")))
    target = F.when(F.col("ratio").isNull(), F.lit(0.0)).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return rows.withColumn("target", F.when(F.col("cap") <= 0, F.lit(0.0)).otherwise(target)).select(*sources.columns, "target")


def sampling_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A number below BINS * BINS for a document; depends on nothing else, so reruns and any partitioning agree."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 4), 16, 10).cast("int")


def _nearest(bins: DataFrame, bin_column: str) -> DataFrame:
    """Adds, for rows of (source, bin, w, base, extra), the running sum up to each bin, in a window of BINS rows at most."""
    upto = Window.partitionBy("source").orderBy(bin_column).rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("upto", F.col("base") + F.sum("w").over(upto))


def plan(sized: DataFrame, max_epochs: float = MAX_EPOCHS, budget: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of all), below (keys below it get one more).

    sized: (source, key, size), a row per document. Keys of a source, in order, are taken until the words so far are
    nearest to what whole repetitions leave of the target.
    """
    fine = cut(sized.groupBy("source", "key").agg(F.sum("size").alias("w")))
    sources = fine.groupBy("source").agg(F.sum("w").alias("source_size"))
    if weights is None:
        weighted = ranked_weights(sources)
    else:
        own = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        weighted = sources.join(own, sources["source"].eqNullSafe(own["__s"]), "left").drop("__s").fillna(0.0, ["weight"])
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(int(max_epochs)))).otherwise(0)
    goals = (
        water_fill(weighted, max_epochs, budget)
        .withColumn("whole", whole.cast("long"))
        .withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        .withColumn("extra", F.when(F.col("whole") >= int(max_epochs), F.lit(0.0)).otherwise(F.col("extra")))
    )
    goals = cut(goals)
    hint = broadcast_if_small(goals.select(F.col("source").alias("__s"), "extra"))
    coarse = fine.groupBy("source", F.floor(F.col("key") / BINS).alias("top")).agg(F.sum("w").alias("w"))
    coarse = coarse.join(hint, F.col("source").eqNullSafe(F.col("__s"))).withColumn("base", F.lit(0))
    first = _nearest(coarse, "top").filter((F.col("upto") >= F.col("extra")) & (F.col("extra") > 0))
    first = first.groupBy("source", "extra").agg(F.min(F.struct("top", (F.col("upto") - F.col("w")).alias("base"))).alias("at"))
    first = first.select(F.col("source").alias("__s"), "extra", F.col("at.top").alias("top"), F.col("at.base").alias("base"))
    first = cut(first)
    inner = fine.withColumn("t", F.floor(F.col("key") / BINS)).join(
        broadcast_if_small(first), F.col("source").eqNullSafe(F.col("__s")) & (F.col("t") == F.col("top"))
    )
    steps = _nearest(inner.select("source", "key", "w", "extra", "base"), "key").select("source", (F.col("key") + 1).alias("below"), "upto", "extra")
    start = first.select(F.col("__s").alias("source"), (F.col("top") * BINS).cast("int").alias("below"), F.col("base").alias("upto"), "extra")
    ends = steps.unionByName(start).groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("extra")), F.col("below"))).alias("best"))
    ends = ends.select(F.col("source").alias("__s"), F.col("best.below").alias("below"))
    return goals.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).cast("int").alias("below")
    )


def mix(docs: DataFrame, seed: int = SEED, max_epochs: float = MAX_EPOCHS, budget: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies times size) to docs of (doc_id, text, source, ...).

    A null or empty text has size 0 and takes no words; a null source is a source of its own; rows equal in doc_id and
    text get equal decisions; an empty table gives an empty result. Columns of docs that clash with the added ones are
    replaced. Sources are one row each in the plan; the plan is broadcast only after a check of its size.
    """
    key = sampling_key(seed, F.col("doc_id"), F.col("text"))
    source = F.col("source").cast("string")
    sized = docs.select(source.alias("source"), key.alias("key"), words(F.col("text")).alias("size"))
    goals = cut(plan(sized, max_epochs, budget, weights))
    goals = broadcast_if_small(goals.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("below").alias("__below")))
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], key.alias("__key"), words(F.col("text")).alias("size"))
    rows = rows.join(goals, F.col("source").cast("string").eqNullSafe(F.col("__source")), "left")
    copies = F.col("__whole") + F.when(F.col("__key") < F.col("__below"), 1).otherwise(0)
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        "size",
        F.col("__size").alias("source_size"),
        F.col("__target").alias("target"),
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its repetition's number from 1."""
    return mixed.filter("copies > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB SQL for op2_mixing.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 4) AS INTEGER) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
c AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM s) AS total, (SELECT sum(weight) FROM s) AS all_weight,
    coalesce(sum(cap) OVER b, 0) AS clamped, coalesce(sum(weight) OVER b, 0) AS gone
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - clamped) / (all_weight - gone) AS level FROM c),
f AS (SELECT level AS final FROM l WHERE ratio >= level ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap <= 0 THEN 0.0 ELSE least(cap, coalesce((SELECT final FROM f), 'inf'::DOUBLE) * weight) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size + 1e-9) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
e AS (SELECT *, CASE WHEN whole >= 3 THEN 0.0 ELSE greatest(0.0, target - whole * source_size) END AS extra FROM g),
k AS (SELECT source, key, sum(size) AS w FROM d GROUP BY source, key),
u AS (SELECT k.source, key + 1 AS below, sum(w) OVER (PARTITION BY k.source ORDER BY key) AS upto FROM k),
n AS (SELECT source, below, upto FROM u UNION ALL SELECT source, 0, 0 FROM s),
p AS (SELECT e.source, arg_min(below, struct_pack(a := abs(upto - extra), b := below)) AS below
  FROM e JOIN n ON e.source IS NOT DISTINCT FROM n.source WHERE extra > 0 GROUP BY e.source)
SELECT d.doc_id, d.size, e.source_size, e.target,
  CAST((e.whole + CASE WHEN d.key < coalesce(p.below, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
