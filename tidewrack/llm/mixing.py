"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Hex digits of a key that one level of the histogram adds, and the keys that one task puts in order at most.
DIGITS, EDGE = 3, 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(id_col: str, text_col: str, seed: str) -> Column:
    """The seeded place of a row in its source's draw: 16 hex digits of the id and the text."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)), 1, 16)


def water_fill(sources: DataFrame, max_epochs: float = 3.0, cycle: int = 3) -> DataFrame:
    """Targets for ``sources`` (source, source_size): weights 1..cycle by code point, null last, and shares of the
    total that stop at ``max_epochs`` times a source, the excess going to the others by weight.

    Clamping and sharing anew until nothing exceeds its cap ends at one water level: target = min(cap, level *
    weight). Taking the sources by cap over weight, the level if the first k are clamped is (total - their caps) /
    (the other weights); it rises with k just as long as the next source is above its cap, so the level sought is
    the largest of these. Windows over one row a source find it in one task.
    """
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy(F.lit(0))
    lower = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    caps, weights = (F.coalesce(F.sum(c).over(lower), F.lit(0)) for c in ("cap", "weight"))
    level = (F.sum("source_size").over(every).cast("double") - caps) / (F.sum("weight").over(every).cast("double") - weights)
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return filled.select("source", "source_size", "weight", "cap", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _reach(hist: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the part of its keys (``bucket``) where its need is reached, and the words ahead of that part.
    ``hist`` has source, bucket, words, keys and before, the words ahead of all its buckets."""
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = hist.withColumn("incl", F.col("before") + F.sum("words").over(up_to)).join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    cut = F.min(F.struct("bucket", (F.col("incl") - F.col("words")).alias("excl"), "keys"))
    return reach.filter("need > 0 and incl > need").groupBy("p_source").agg(cut.alias("cut"), F.first("need").alias("need")).select(F.col("p_source").alias("c_source"), "cut.*", "need")


def mix_plan(rows: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """One row a source: its target, the whole repetitions of each row, and the draw key up to which rows are taken
    once more. ``rows`` has source, size and key.

    The cut is found by a histogram of words over the first digits of the keys, refined within the one part where the
    need is reached, by ``DIGITS`` more at a time, until that part has at most ``EDGE`` keys: so many are put in order
    in a task, whatever the size of a source. Rows with one key are taken or left together. A source that needs
    nothing beyond its whole repetitions has the empty key, which no row reaches.
    """
    count = [F.sum("size").alias("words"), F.approx_count_distinct("key").alias("keys")]
    hist = scratch.table(rows.groupBy("source", F.substring("key", 1, DIGITS).alias("bucket")).agg(*count), "hist")
    plan = water_fill(hist.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.table(plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "need"), "targets")
    cuts, digits = scratch.table(_reach(hist.withColumn("before", F.lit(0).cast("long")), plan), "cuts"), DIGITS

    def inside() -> DataFrame:
        return rows.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.substring("key", 1, digits) == F.col("bucket")))

    while digits < 16 and (cuts.agg(F.max("keys")).first()[0] or 0) > EDGE:
        finer = inside().groupBy("source", F.substring("key", 1, digits + DIGITS).alias("finer")).agg(*count, F.first("excl").alias("before"))
        cuts, digits = scratch.table(_reach(finer.withColumnRenamed("finer", "bucket"), plan), "cuts"), digits + DIGITS
    edge = inside().groupBy("c_source", "key").agg(F.sum("size").alias("size"), F.first("excl").alias("excl"), F.first("need").alias("need"))
    by_key = Window.partitionBy("c_source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("middle", 2 * (F.col("excl") + F.sum("size").over(by_key)) - F.col("size")).filter(F.col("middle") <= 2 * F.col("need"))
    last = edge.groupBy("c_source").agg(F.max("key").alias("last"))
    ends = cuts.join(last.withColumnRenamed("c_source", "l_source"), F.col("c_source").eqNullSafe(F.col("l_source")), "left")
    ends = ends.select(F.col("c_source"), F.coalesce("last", "bucket").alias("cut_key"))
    plan = plan.join(ends, F.col("p_source").eqNullSafe(F.col("c_source")), "left")
    # Where rounding puts the need at a whole source, no part exceeds it and every key, of hex digits, is below "g".
    cut_key = F.when(F.col("need") > 0, F.coalesce("cut_key", F.lit("g"))).otherwise(F.lit(""))
    return scratch.table(plan.select("p_source", "source_size", "target", "whole", cut_key.alias("cut_key")), "plan")


def _repeats() -> Column:
    return F.col("whole") + F.when(F.col("key") <= F.col("cut_key"), 1).otherwise(0)


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, its source's size and target, repeats and words taken.

    A source's rows are drawn in the order of a seeded hash: every row ``floor(target / size)`` times and those up
    to the cut once more, which comes within half a row of the target. A null text has no words; null sources are
    one source, last in the order; a source without words has target 0 and gives no rows to the mix. Repeated rows share one key and are taken
    alike. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw_key(id_col, text_col, seed).alias("key"))
    rows = scratch.table(rows, "rows")
    taken = rows.join(mix_plan(rows, max_epochs), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("repeats", _repeats())
    return taken.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "source", F.col("repeats").cast("int").alias("repeats"))


def draw(docs: DataFrame, max_epochs: float = 3.0, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the columns of ``docs``, whatever
    else they are called. Nulls, repeats and wordless texts are taken as in ``mix``; an empty table gives no rows."""
    rows = scratch.table(docs.select("source", word_count(F.col("text")).alias("size"), draw_key("doc_id", "text", seed).alias("key")), "rows")
    plan = mix_plan(rows, max_epochs).select("p_source", "whole", "cut_key")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col("source").alias("d_source"), draw_key("doc_id", "text", seed).alias("key"))
    drawn = keyed.join(plan, F.col("d_source").eqNullSafe(F.col("p_source"))).withColumn("repeats", _repeats().cast("int")).filter("repeats > 0")
    return drawn.select(F.explode(F.array_repeat("doc", F.col("repeats"))).alias("doc")).select("doc.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 1, 2, 3, repeating, at 3 epochs at most."""
    return mix(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 16) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3.0::DOUBLE AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws, (SELECT sum(source_size) FROM r)::DOUBLE AS total,
             (SELECT sum(w) FROM r)::DOUBLE AS tw
      FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - caps) / (tw - ws)) AS level FROM c),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM r, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, k, sum(size) AS unit FROM d GROUP BY source, k),
p AS (SELECT *, 2 * sum(unit) OVER (PARTITION BY source ORDER BY k) - unit AS middle FROM g)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (d.size * (n.whole + CASE WHEN n.target > n.whole * n.source_size AND p.middle <= 2 * (n.target - n.whole * n.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken,
       d.source, (n.whole + CASE WHEN n.target > n.whole * n.source_size AND p.middle <= 2 * (n.target - n.whole * n.source_size) THEN 1 ELSE 0 END)::INTEGER AS repeats
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.k = p.k
"""
