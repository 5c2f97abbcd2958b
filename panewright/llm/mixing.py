"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, target / size of the
source. The documents stand in order of size; the running sum of what they
expect, moved by one random offset, emits a copy each time it passes an
integer. Since neighbours are alike in size, the words taken come near the target.

The running sum is built from block totals: a block is a source, the two leading digits
and number of digits of the size, and the first digits of a hash of the id, so that
no window holds more than one block's rows or the few hundred totals of one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free_name

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target for (source, source_size).

    Sources in order of code points, null last, weigh 5, 2, 1, 5, 2, 1, ... and share
    all words. No target is above `most` times its source; what is above is shared
    again by weight. With the sources in order of most * size / weight, those before some
    place are at their limit and the others share what is left by weight, so one sorted pass finds
    the same end as sharing again and again.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    s = s.withColumn("at", F.col("cap") / F.col("w"))
    up = W.orderBy("at", "k")
    every = W.partitionBy()
    s = s.withColumn("full", F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1))).withColumn("rest", F.sum("w").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))).withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce("full", F.lit(0.0))) / F.col("rest"))
    # the level that holds is the first that its source's own limit does not undercut
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "k", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, digits: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    size is the number of words (null text: 0), taken is copies * size, copies is 0 to 3.
    Null is a source of its own. Documents without words have copies too, which
    count nothing. Repeated rows share their id's place in order but are counted
    one by one. An empty table gives an empty result. digits: hexadecimal digits of the
    id's hash that split a block.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    text = F.col("size").cast("string")
    d = cut(d.withColumn("class", (F.length(text) * 100 + F.substring(text, 1, 2).cast("int")).cast("int"))
            .withColumn("part", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, digits)))
    parts = d.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    classes = parts.groupBy("source", "class").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    sources = targets(classes.groupBy("source").agg(F.sum("cs").alias("source_size")))
    classes = classes.select("source", "class", F.coalesce(F.sum("cn").over(W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("c0"))
    parts = parts.select("source", "class", "part", F.coalesce(F.sum("n").over(W.partitionBy("source", "class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("p0"))
    same = lambda x, y, on: [x[c].eqNullSafe(y[c]) for c in on]
    at = parts.join(classes, same(parts, classes, ["source", "class"])).select(parts["source"], parts["class"], "part", (F.col("c0") + F.col("p0")).alias("before"))
    at = at.join(sources, same(at, sources, ["source"])).select(at["source"], "class", "part", "before", "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("source", "class", "part").orderBy("size", "doc_id")))
    d = d.join(at, same(d, at, ["source", "class", "part"])).select("doc_id", "size", "source_size", "target", (F.col("before") + F.col("rank")).cast("double").alias("rank"), d["source"].alias("source"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumn("each", each).withColumn("whole", F.floor("each")).withColumn("off", offset)
    part = F.col("each") - F.col("whole")
    crossed = F.floor(F.col("off") + part * F.col("rank")) - F.floor(F.col("off") + part * (F.col("rank") - 1))
    d = d.withColumn("copies", F.least(F.col("whole") + crossed, F.lit(MOST)).cast("long"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself: docs, with all their columns, each row as often as mix() takes its id.

    The copies of rows that repeat an id, or have none, are counted together and dealt out evenly among them.
    """
    key, copies, rows, at = (free_name(docs, c) for c in ("_key", "_copies", "_rows", "_at"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    taken = mix(docs, id_col, text_col, source_col, seed).groupBy(named("doc_id").alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    both = docs.withColumn(key, named(id_col)).join(taken, key).withColumn(at, F.row_number().over(W.partitionBy(key).orderBy(key)))
    upto = lambda k: F.floor(F.col(copies) * k / F.col(rows))
    n = (upto(F.col(at)) - upto(F.col(at) - 1)).cast("int")
    return both.withColumn(at, F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size::DOUBLE AS cap FROM k),
u AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT arg_min((total - full_) / rest, cap / w * 1e6 + k) AS level FROM u WHERE (total - full_) / rest <= cap / w),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM u LEFT JOIN l ON true),
o AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY length(size::VARCHAR) * 100 + left(size::VARCHAR, 2)::INT, left(md5(coalesce(doc_id::VARCHAR, '')), 2), size, doc_id) AS r,
  ('0x' || left(md5('17:' || coalesce(d.source, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(3, floor(each) + floor(off + (each - floor(each)) * r) - floor(off + (each - floor(each)) * (r - 1))) AS BIGINT) AS copies FROM o)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
