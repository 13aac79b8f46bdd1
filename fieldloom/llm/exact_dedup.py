"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row by a stable id.

Plan, DataFrame functions only:

1. One pass over the texts writes (id, row number, 128-bit hash, SHA-256) to the checkpoint folder; later steps read
   these 60 bytes a row instead of the texts.
2. Hash groups are counted with a map-side partial aggregate, so that a group with a third of all rows reaches the
   shuffle as one row a task.
3. Texts of groups of two or more are read again and grouped by (hash, text): the aggregate compares the bytes. Copies
   meet in the map-side hash table, so a hot group again sends one row a task.
4. A hash under which two texts were found (a collision) has its rows joined by the text itself; all other rows are
   joined by the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, folded

#: Repeated hashes are broadcast up to this many (some 30 MB in memory); beyond, the join is shuffled.
BROADCAST_ROWS = 200_000


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_of=content_hash) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. keep is "min" or "max": which id of a
    group stays. Rows that repeat the same id and text form a group in which one of them stays; a null id is below all
    others. An empty table gives no rows. Other columns of docs are ignored.
    """
    text = docs.select(F.col(id_col).alias("_fl_id"), folded(F.col(text_col)).alias("_fl_text"))
    hashed = checkpointed(
        text.select(
            F.col("_fl_id"),
            F.monotonically_increasing_id().alias("_fl_row"),
            hash_of(F.col("_fl_text")).alias("_fl_hash"),
            F.sha2("_fl_text", 256).alias("_fl_sha"),
        )
    )
    best = F.max if keep == "max" else F.min
    who = F.struct("_fl_id", "_fl_row")
    groups = hashed.groupBy("_fl_hash").agg(F.count(F.lit(1)).alias("_fl_size"), best(who).alias("_fl_rep")).where("_fl_size > 1")
    groups = checkpointed(groups)
    n_groups = groups.count()
    keys = _sized(groups.select("_fl_hash"), n_groups)
    bytes_of = text.withColumn("_fl_hash", hash_of(F.col("_fl_text"))).join(keys, "_fl_hash", "left_semi")
    texts = bytes_of.groupBy("_fl_hash", "_fl_text").agg(F.count(F.lit(1)).alias("_fl_size"), best("_fl_id").alias("_fl_best"))
    texts = texts.groupBy("_fl_hash").agg(F.count(F.lit(1)).alias("_fl_texts"))
    collided = checkpointed(texts.where("_fl_texts > 1").select("_fl_hash"))
    n_collided = collided.count()

    joined = hashed.join(_sized(groups, n_groups), "_fl_hash", "left")
    if n_collided:
        joined = joined.join(_sized(collided, n_collided), "_fl_hash", "left_anti")
    out = joined.select("_fl_id", "_fl_row", "_fl_sha", F.coalesce("_fl_size", F.lit(1)).alias("_fl_size"), F.coalesce("_fl_rep", who).alias("_fl_rep"))
    if n_collided:
        # Texts that share a hash: the text is the key; the salted row number breaks ties between repeated rows.
        rows = text.withColumns({"_fl_hash": hash_of(F.col("_fl_text")), "_fl_row": F.monotonically_increasing_id()}).join(_sized(collided, n_collided), "_fl_hash", "left_semi")
        exact = rows.groupBy("_fl_text").agg(F.count(F.lit(1)).alias("_fl_size"), best(who).alias("_fl_rep"))
        out = out.unionByName(rows.join(exact, "_fl_text").select("_fl_id", "_fl_row", F.sha2("_fl_text", 256).alias("_fl_sha"), "_fl_size", "_fl_rep"))
    return out.select(
        F.col("_fl_id").alias(id_col),
        F.col("_fl_rep._fl_id").alias("keep_id"),
        F.col("_fl_size").cast("long").alias("group_size"),
        (F.col("_fl_row") == F.col("_fl_rep._fl_row")).alias("kept"),
        F.col("_fl_sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and a text, one stays."""
    groups = exact_groups(docs, id_col, text_col, keep).where("group_size > 1")
    own = checkpointed(groups.select(F.col(id_col).alias("_fl_drop_id"), "keep_id", "text_sha256"))
    folded_key = docs.withColumn("_fl_sha", F.sha2(folded(F.col(text_col)), 256))
    dropped = checkpointed(own.where(~F.col("_fl_drop_id").eqNullSafe(F.col("keep_id"))).select("_fl_drop_id", "text_sha256").distinct())
    dropped = _sized(dropped, dropped.count())
    out = folded_key.join(dropped, folded_key[id_col].eqNullSafe(dropped["_fl_drop_id"]) & (folded_key["_fl_sha"] == dropped["text_sha256"]), "left_anti")
    again = own.where(F.col("_fl_drop_id").eqNullSafe(F.col("keep_id"))).groupBy("_fl_drop_id", "text_sha256").count().where("count > 1").select("_fl_drop_id", "text_sha256")
    again = checkpointed(again)
    if n := again.count():  # rows that repeat the id that stays
        again = _sized(again, n)
        repeated = out[id_col].eqNullSafe(again["_fl_drop_id"]) & (out["_fl_sha"] == again["text_sha256"])
        out = out.join(again, repeated, "left_anti").unionByName(out.join(again, repeated, "left_semi").dropDuplicates([id_col, "_fl_sha"]))
    return out.drop("_fl_sha")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
