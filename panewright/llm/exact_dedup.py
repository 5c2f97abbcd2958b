"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, so equal passages are cut alike
wherever they stand. A chunk's identifier is its 64-bit hash once it is verified
that no other chunk has that hash; the few chunks for which one has get a second
number. A document is then its list of identifiers, a hundredth of its
length, and only these lists are grouped and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: A chunk ends at white space after one of d, g, k, t, with or without a stop or comma, 512 characters in or later; 8,192 are the most.
CHUNKS = r"(?s).{512,8192}?[dgkt][.,]?\s|.{1,8192}"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, text_sha256, recipe, extra): texts are equal exactly if recipe and extra are.

    recipe has the chunks' hashes in order. extra is empty unless two chunks in
    the input share a hash; then it tells, for the documents with such chunks,
    which is which.
    """
    text = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(text_col, F.lit(""))).alias("t"))
    lists = text.select("id", F.sha2("t", 256).alias("text_sha256"), F.transform(_chunks(F.col("t")), lambda c: key(c)).alias("recipe"))
    each = text.select("t", F.explode(_chunks(F.col("t"))).alias("chunk")).select("t", key(F.col("chunk")).alias("h"), "chunk")
    known = each.select("h", "chunk").distinct()
    shared = cut(known.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        return lists.withColumn("extra", F.array().cast("array<string>"))
    number = known.join(shared, "h").select("h", "chunk", F.sha2("chunk", 256).alias("n"))
    odd = text.select(F.sha2("t", 256).alias("text_sha256"), F.posexplode(_chunks(F.col("t"))).alias("k", "chunk")).withColumn("h", key(F.col("chunk")))
    told = odd.dropDuplicates(["text_sha256", "k"]).join(number, ["h", "chunk"]).groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("x"))
    told = told.select("text_sha256", F.transform("x", lambda x: F.concat_ws(":", x["k"], x["n"])).alias("extra"))
    return lists.join(told, "text_sha256", "left").select("id", "text_sha256", "recipe", F.coalesce("extra", F.array().cast("array<string>")).alias("extra"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; null counts as
    empty, so null and empty texts form one group. Of a group the largest id
    stays. Repeated rows of one id are members of their group each, and kept
    says the same of all of them. Null ids stay only if the whole group has no
    other. Further columns, whatever their names, are not read.
    """
    r = cut(recipes(docs, id_col, text_col, key))
    groups = r.groupBy("recipe", "extra").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # dealt anew, so that the join shuffles both sides and a group with very many rows can be split at run time
    out = r.join(groups.repartition("keep_id"), ["recipe", "extra"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs, with all their columns, with one row of each group of texts with equal recipes: that of the largest id, and of those the one of the greatest text. Null ids are less than others."""
    r = recipes(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", key)
    order = F.struct(F.col("id")[id_col], F.coalesce(F.col("id")[text_col], F.lit("")))
    return r.groupBy("recipe", "extra").agg(F.max_by("id", order).alias("_row")).select("_row.*")


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
