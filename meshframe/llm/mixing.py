"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame code only.

The mix is allotted in blocks of equal token counts. Highest quotients v / (2n + 1) give every source an integer number
of blocks, and the same rule divides a source's blocks among its shards. Within a shard, documents stand in a seeded
order and the shard's quota is read off that order from its start, going round again when the quota exceeds the shard.

Only per-source and per-shard sums meet in one task; documents are sorted within shards of bounded expected size, so a
source that holds a third of all rows is simply many shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, numbered, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
DOCS_A_SHARD = 1024
MAX_BLOCK = 1024
#: Blocks are no larger than this fraction of all tokens.
LEAST_BLOCKS = 100_000
#: The smallest positive target is so many blocks, unless a block is one word.
LEAST_A_SOURCE = 16
#: A list of at most so many sources is broadcast.
SOURCES_LIMIT = 10_000
SEED = "mix-1"


def apportion(votes: DataFrame, group: list[str], key: str, n: str, seats: str) -> DataFrame:
    """Sainte-Lague within each group: adds the long column `quota` to (group.., key, n, seats).

    A divisor that is surely too large gives every key seats that it gets in any case, one that is surely too small
    bounds what it can get; only the few seats between are ranked by quotient (ties: smaller key first, null last).
    A group without votes gets no seats.
    """
    w = Window.partitionBy(*group)
    v, b = F.sum(n).over(w), F.col(seats)
    a = votes.withColumns({"__v": v, "__s": F.count(F.lit(1)).over(w)})
    some = (F.col("__v") > 0) & (b > 0)
    a = a.withColumn("__q", F.when(some, F.col(n) * b.cast("double") / F.col("__v")).otherwise(F.lit(0.0)))
    wide = 1 + F.col("__s") / b.cast("double")
    a = a.withColumns(
        {
            "__low": F.when(some & (b >= F.col("__s")), F.floor(F.col("__q") / wide + 0.5)).otherwise(F.lit(0)).cast("long"),
            "__high": F.when(some, F.floor(F.col("__q") * wide + 0.5) + 1).otherwise(F.lit(0)).cast("long"),
        }
    )
    a = a.withColumn("__left", b - F.sum("__low").over(w))
    place = Window.partitionBy(*group).orderBy(
        F.desc("__quotient"), F.col(key).isNull(), F.col(key), F.col("__k")
    )
    ranked = (
        a.where("__high > __low")
        .withColumn("__k", F.explode(F.sequence("__low", F.col("__high") - 1)))
        .withColumn("__quotient", F.col(n) / (2 * F.col("__k") + 1))
        .where("__quotient > 0")
        .withColumn("__place", F.row_number().over(place))
        .where(F.col("__place") <= F.col("__left"))
        .groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate([*group, key])])
        .agg(F.count(F.lit(1)).alias("__more"))
    )
    on = F.lit(True)
    for i, c in enumerate([*group, key]):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    quota = (F.col("__low") + F.coalesce("__more", F.lit(0))).cast("long").alias("quota")
    return a.join(ranked, on, "left").select(*votes.columns, quota)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, total, target): the weights' shares of all tokens, stopped at MAX_EPOCHS times a
    source's size, what is cut off being shared again by weight.

    Sources sorted by the level at which they stop: with the first k stopped, the others share what is left; the first k
    whose level does not reach the next source's stop is the answer. One row a source.
    """
    one = Window.partitionBy(F.lit(1))
    named = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    stops = Window.partitionBy(F.lit(1)).orderBy("__stop", F.col("source").isNull(), "source")
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.row_number().over(named) - 1) % len(WEIGHTS) + 1)
    s = s.withColumn("__w", weight).withColumn("total", F.sum("source_size").over(one))
    s = s.withColumn("__cap", MAX_EPOCHS * F.col("source_size")).withColumn("__stop", F.col("__cap") / F.col("__w"))
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    onward = stops.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn(
        "__level",
        (F.col("total") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(onward),
    )
    s = s.withColumn("__free", F.min(F.when(F.col("__level") <= F.col("__stop"), F.struct("__stop", "__level"))).over(one))
    level = F.coalesce(F.col("__free.__level"), F.lit(float("inf")))
    target = F.least(F.col("__cap").cast("double"), F.col("__w") * level)
    return s.select("source", "n_docs", "source_size", "total", target.alias("target"))


def seeded(id_col: str | Column, seed: str) -> Column:
    """The seeded order: an MD5 of seed and identifier."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(c.cast("string"), F.lit("null"))))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    order_by: Column | None = None,
) -> DataFrame:
    """What the mix takes of every document: (doc_id, size, source_size, target, taken), and its source.

    size counts the words of the whole text (null: 0); taken counts words with repeats and never exceeds MAX_EPOCHS
    times size. A block is small enough for the smallest source to get some. A null source is a source of its own, the last one. Rows with equal identifiers are separate rows that
    stand next to each other in the order. Without any words all targets and takings are 0. No rows give no rows. The
    result depends on the rows and the seed alone, not on partitions. The seeded order is that of order_by, else of the
    identifier. Other columns are ignored.
    """
    sizes = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            seeded(id_col if order_by is None else order_by, seed).alias("__order"),
        )
    )
    targets = checkpointed(source_targets(sizes))
    n_sources, least = targets.agg(F.count(F.lit(1)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    small = F.floor(F.lit(least or 0.0) / LEAST_A_SOURCE)
    plan = targets.withColumn(
        "__block",
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("total") / LEAST_BLOCKS), small)).cast("long"),
    )
    plan = plan.withColumn("__all", F.lit(1)).withColumn("__seats", F.floor(F.col("total") / F.col("__block")).cast("long"))
    plan = apportion(plan, ["__all"], "source", "target", "__seats").withColumn(
        "__shards", F.ceil(F.col("n_docs") / DOCS_A_SHARD).cast("long")
    )
    plan = plan.select(
        F.col("source").alias("__source"), "source_size", "target", "__block", F.col("quota").alias("__blocks"), "__shards"
    )
    # One row a source; the list is counted before it is broadcast, so a hot source's documents stay where they are.
    few = n_sources <= SOURCES_LIMIT
    rows = sizes.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "__shard", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") % F.col("__shards")
    )
    shards = rows.groupBy("__source", "__shard", "__block", "__blocks").agg(F.sum("size").alias("__shard_size"))
    quotas = apportion(shards, ["__source"], "__shard", "__shard_size", "__blocks").select(
        F.col("__source").alias("__q_source"),
        F.col("__shard").alias("__q_shard"),
        F.col("__shard_size"),
        F.least(F.col("quota") * F.col("__block"), MAX_EPOCHS * F.col("__shard_size")).alias("__quota"),
    )
    rows = rows.join(
        quotas, F.col("__source").eqNullSafe(F.col("__q_source")) & (F.col("__shard") == F.col("__q_shard"))
    )
    order = Window.partitionBy("__source", "__shard").orderBy("__order", "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__start", end - F.col("size"))
    rounds = F.when(F.col("__shard_size") > 0, F.expr("__quota div __shard_size")).otherwise(F.lit(0))
    rest = F.when(F.col("__shard_size") > 0, F.col("__quota") % F.col("__shard_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__start")))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken")
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, with their columns and size, source_size, target and taken, each row by itself.

    Columns of docs by these four names are replaced. Rows that repeat an identifier stand next to each other in the
    seeded order, in the order of a hash of their texts.
    """
    made = ["size", "source_size", "target", "taken"]
    rows = numbered(docs)
    own = rows.select(
        F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"), F.col("__row").alias("row")).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{source_col}`").alias("source"),
    )
    took = mix_sources(own, "key", order_by=F.col("key.id")).where("taken > 0")
    took = took.select(F.col("doc_id.row").alias("__taken_row"), F.struct(*made).alias("__mix"))
    return rows.join(took, F.col("__row") == F.col("__taken_row")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in made], *[F.col(f"__mix.{c}").alias(c) for c in made]
    )


def _apportion_sql(name: str, frm: str, group: str, key: str, n: str, seats: str) -> str:
    return f"""
{name}_a AS (
  SELECT *, sum({n}) OVER (PARTITION BY {group}) AS v, count(*) OVER (PARTITION BY {group}) AS s FROM {frm}
), {name}_b AS (
  SELECT *, CASE WHEN v > 0 AND {seats} > 0 THEN {n} * {seats}::DOUBLE / v ELSE 0.0 END AS q,
         CASE WHEN {seats} > 0 THEN 1 + s / {seats}::DOUBLE ELSE 1.0 END AS wide FROM {name}_a
), {name}_c AS (
  SELECT *, CASE WHEN v > 0 AND {seats} > 0 AND {seats} >= s THEN floor(q / wide + 0.5) ELSE 0 END::BIGINT AS low,
         CASE WHEN v > 0 AND {seats} > 0 THEN floor(q * wide + 0.5) + 1 ELSE 0 END::BIGINT AS high FROM {name}_b
), {name}_d AS (
  SELECT *, {seats} - sum(low) OVER (PARTITION BY {group}) AS spare FROM {name}_c
), {name}_e AS (
  SELECT {group} AS g, {key} AS k, spare, {n} / (2 * i + 1)::DOUBLE AS quotient, i
  FROM (SELECT *, unnest(range(low, high)) AS i FROM {name}_d WHERE high > low)
), {name}_f AS (
  SELECT g, k, count(*) AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY quotient DESC, k NULLS LAST, i) AS place
    FROM {name}_e WHERE quotient > 0) WHERE place <= spare GROUP BY g, k
), {name} AS (
  SELECT d.*, d.low + coalesce(f.more, 0) AS quota FROM {name}_d d
  LEFT JOIN {name}_f f ON d.{group} IS NOT DISTINCT FROM f.g AND d.{key} IS NOT DISTINCT FROM f.k
)"""


OP10_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents
), s1 AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), s2 AS (
  SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         (sum(source_size) OVER ())::BIGINT AS total, 3 * source_size AS cap FROM s1
), s3 AS (
  SELECT *, cap / w AS stop FROM s2
), s4 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(w) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lev FROM s3
), s5 AS (
  SELECT *, first_value(CASE WHEN lev <= stop THEN lev END IGNORE NULLS)
         OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS free FROM s4
), s6 AS (
  SELECT 1 AS one, source, n_docs, source_size, total, least(cap::DOUBLE, w * coalesce(free, 'infinity'::DOUBLE)) AS target FROM s5
), s6b AS (
  SELECT *, greatest(1, least({MAX_BLOCK}, total // {LEAST_BLOCKS},
         floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0.0) / {LEAST_A_SOURCE})))::BIGINT AS block FROM s6
), s7 AS (
  SELECT *, total // block AS seats FROM s6b
), {_apportion_sql("src", "s7", "one", "source", "target", "seats")},
rws AS (
  SELECT z.doc_id, z.source, z.size, z.ord, p.source_size, p.target, p.block, p.quota AS blocks,
         ('0x' || substr(z.ord, 1, 8))::BIGINT % ceil(p.n_docs / {DOCS_A_SHARD}::DOUBLE)::BIGINT AS shard
  FROM sizes z JOIN src p ON z.source IS NOT DISTINCT FROM p.source
), sh AS (
  SELECT source, shard, any_value(block) AS block, any_value(blocks) AS blocks, sum(size)::BIGINT AS shard_size FROM rws GROUP BY source, shard
), {_apportion_sql("shq", "sh", "source", "shard", "shard_size", "blocks")},
fin AS (
  SELECT r.*, q.shard_size, least(q.quota * q.block, 3 * q.shard_size) AS qt,
         sum(r.size) OVER (PARTITION BY r.source, r.shard ORDER BY r.ord, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS st
  FROM rws r JOIN shq q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard
)
SELECT doc_id, size, source_size, target,
       CASE WHEN shard_size > 0 THEN (qt // shard_size) * size + greatest(0, least(size, qt % shard_size - st)) ELSE 0 END::BIGINT AS taken
FROM fin
"""
