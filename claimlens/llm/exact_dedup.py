"""Exact dedup: 128-bit content hash groups, compared byte for byte.

1. Every row gets the 128-bit hash, the SHA-256 and the byte length of its
   text: narrow rows, the texts stay where they are.
2. Hash groups are counted (partial sums first); each names the row that
   stays, by the smallest or the largest id.
3. Only members of groups of two or more meet their group's kept text, on
   (hash, salt): a group of n rows is dealt over ceil(n / SALT_ROWS) salts,
   so a group that holds a third of all rows spreads over many tasks, with
   whatever ids (salts follow the rows' places, and are written with them).
   Bytes are compared there. Members that differ (hash collisions) are
   grouped anew by their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written, written_and_told

#: rows of one hash group that share a salt
SALT_ROWS = 1000


def content_hash(text: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest",
                hash_of=content_hash) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of the rows with equal texts stays.
    Null texts count as empty. Rows that repeat an id count as rows of their
    own: each is counted in group_size, and all rows that carry the kept id
    are kept. Null ids take part in the count, and are kept only where a
    whole group has none. hash_of: 128-bit hash of a text column (tests pass
    a weak one to force collisions).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{doc_id}`").alias("d"), body.alias("t")).withColumn("h", hash_of(F.col("t")))
    keys = docs.select("d", "h", F.sha2(F.col("t").cast("binary"), 256).alias("sha"))
    # written, so that the last join has two plain sides, of which Spark can split a hot group's
    groups = written(keys.groupBy("h").agg(best("d").alias("keep"), F.count(F.lit(1)).alias("n")), "groups")

    shared = groups.where("n > 1").select("h", "keep", F.expr(f"cast(ceil(n / {SALT_ROWS}) as int)").alias("salts"))
    # the only step that moves all texts; written, since both sides of the comparison read it
    members = written(docs.join(shared, "h").withColumn("salt", F.pmod(F.xxhash64("d", F.monotonically_increasing_id()), F.col("salts"))), "copies")
    # one text for each group that has the kept id (a repeated id may come with several: any will do, the rest collide)
    kept = (members.where(F.col("d").eqNullSafe(F.col("keep"))).groupBy("h").agg(F.max_by("t", F.xxhash64("t")).alias("kt"), F.max("salts").alias("m"))
            .select("h", "kt", F.explode(F.expr("sequence(0L, m - 1L)")).alias("salt")))
    differ = members.join(kept, ["h", "salt"]).where(~F.col("t").eqNullSafe(F.col("kt"))).select("h", "d", "t")
    collided, told = written_and_told(
        differ.groupBy("h", "t").agg(best("d").alias("keep2"), F.count(F.lit(1)).alias("n2"))
        .select("h", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "keep2", "n2"), "collided", n=F.count(F.lit(1)))

    rows = keys.join(groups, "h")
    if told["n"]:  # hash collisions: those rows form groups of their own
        lost = collided.groupBy("h").agg(F.sum("n2").alias("lost"))
        rows = rows.join(collided, ["h", "sha"], "left").join(lost, "h", "left").withColumns({
            "keep": F.coalesce("keep2", "keep"), "n": F.coalesce(F.col("n2"), F.col("n") - F.coalesce("lost", F.lit(0)))})
    return rows.select(F.col("d").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
                       F.col("d").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
