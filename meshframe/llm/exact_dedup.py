"""Exact deduplication: a tree-merge of sorted digest runs.

Every document becomes one digest entry; the entries of a partition are a run. Each round merges FAN neighbouring runs
into one, so the number of rounds follows the number of partitions. A round's map tasks sort their runs by digest and
drop what is repeated in them, slices of the runs are exchanged, and the slices of a group are merged: of entries that
agree on digest, length and a second hash, one with the smallest identifier and the summed count goes on. A text with any
number of copies therefore costs a round at most FAN entries a group, however many rows share it. The verdict then goes
down the same tree, so that the copies of one text never gather under one key either: at the bottom those of FAN
partitions meet.

Runs are cut into slices by a hash of the digest, so that no run, the last one included, has to fit a task. All of it is
DataFrame code; a lost executor repeats single partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, numbered, whole

FAN = 8

#: What must agree for two entries to count as the same text: SHA-256 and, as its verification, byte length and XXH64.
SAME = ["__digest", "__bytes", "__check"]


def digest_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One digest entry a row: identifier, digest, verification columns and the run."""
    flat = docs.select(
        F.col(id_col).alias("__id"), F.regexp_replace(whole(text_col), SPACES, " ").alias("__flat")
    )
    return flat.select(
        "__id",
        F.unhex(F.sha2("__flat", 256)).alias("__digest"),
        F.octet_length("__flat").cast("long").alias("__bytes"),
        F.xxhash64("__flat").alias("__check"),
        F.spark_partition_id().alias("__run"),
    )


def merge_round(runs: DataFrame, group: str) -> DataFrame:
    """Merge the runs of a group: entries meet sorted by digest, the smallest identifier and the count go on.

    The minimum of a struct has no hash buffer, so Spark aggregates sorted rows before and after the exchange.
    """
    return (
        runs.groupBy(*SAME, group)
        .agg(F.min(F.struct(F.isnull("__keep").alias("none"), "__keep")).alias("__least"), F.sum("__n").alias("__n"))
        .select(*SAME, group, F.col("__least.__keep").alias("__keep"), "__n")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict for every row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. Of equal
    texts the row with the smallest identifier stays. Rows repeated with one identifier are one document: each gets the
    same verdict and each counts in group_size. A null identifier never beats another one; a group with null
    identifiers only keeps them (keep_id null, kept true). No rows give no rows. Other columns are ignored.
    """
    entries = checkpointed(digest_entries(docs, id_col, text_col))
    width = (entries.agg(F.max("__run")).first()[0] or 0) + 1
    up = lambda g: F.floor(F.col(g) / FAN).cast("int")
    levels = [merge_round(entries.select(*SAME, up("__run").alias("__g1"), F.col("__id").alias("__keep"), F.lit(1).alias("__n")), "__g1")]
    while width > FAN:
        width = -(-width // FAN)
        below = f"__g{len(levels)}"
        levels.append(merge_round(levels[-1].withColumn(f"__g{len(levels) + 1}", up(below)), f"__g{len(levels) + 1}"))

    # Down the tree: only texts with copies travel; each node takes the verdict of the node that it was merged into.
    top = f"__g{len(levels)}"
    verdict = levels[-1].where("__n > 1").select(*SAME, top, F.col("__keep").alias("__best"), F.col("__n").alias("__size"))
    for k in range(len(levels) - 1, 0, -1):
        nodes = levels[k - 1].select(*SAME, f"__g{k}", up(f"__g{k}").alias(f"__g{k + 1}"))
        verdict = nodes.join(verdict, [*SAME, f"__g{k + 1}"]).select(*SAME, f"__g{k}", "__best", "__size")
    rows = entries.withColumn("__g1", up("__run")).join(verdict, [*SAME, "__g1"], "left")
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__best"))
    return rows.select(
        F.col("__id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one row of each text, the one with the smallest identifier
    (null last; of rows that repeat an identifier and a text one stays)."""
    rows = numbered(docs)
    key = F.struct(F.isnull(F.col(f"`{id_col}`")).alias("none"), F.col(f"`{id_col}`").alias("id"), F.col("__row").alias("row"))
    own = rows.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    kept = exact_dedup(own, "key", "text").where("kept").select(F.col("doc_id.row").alias("__kept"))
    return rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


OP8_SQL = r"""
WITH flat AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM flat
"""
