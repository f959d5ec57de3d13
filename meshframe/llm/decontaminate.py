"""Benchmark decontamination in DataFrame code only.

Benchmark items become normalised windows of WINDOW words (a shorter item is one window). The hashes of all windows form
a set that Spark ships with the plan; every token window of a text is hashed and looked up in it, and each hit is
verified by an equi-join on the words themselves. Verified hits mark words, and spans or whole documents can go.

The set's size is checked: beyond SET_LIMIT hashes the windows are joined with the benchmark's by a shuffle on the hash
instead, and the hits come back to their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, whole

WINDOW = 10
#: Hashes that go with the plan, about 20 bytes each; more are joined.
SET_LIMIT = 100_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Runs of 0-9, a-z and all that is not ASCII, after A-Z became a-z."""
    flat = F.trim(F.regexp_replace(F.translate(whole(text), UPPER, LOWER), BREAKS, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def joined(w: Column, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, n, h): the windows of every item, each once an item."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(text_col).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - n + 1))
    w = w.withColumn("n", n).withColumn("at", starts)
    return w.select(
        "item_id", joined(F.col("w"), F.col("at"), F.col("n")).alias("words"), "n", F.xxhash64(F.slice("w", F.col("at"), F.col("n"))).alias("h")
    ).distinct()


def _places(n: int) -> Column:
    return F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))


def _starts(lengths: list[int], hit) -> Column:
    """Starts (counted from 1) and lengths of the windows of w that hit."""

    def of(n: int) -> Column:
        some = F.filter(_places(n), lambda i: hit(F.xxhash64(F.slice("w", i, n))))
        return F.transform(some, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n")))

    found = [of(n) for n in lengths]
    return F.concat(*found) if found else F.array().cast("array<struct<at:int,n:int>>")


def _joined_starts(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by a shuffle join on the hash, for benchmarks beyond SET_LIMIT."""
    known = windows.select(F.col("h").alias("__h")).distinct()

    def of(n: int) -> DataFrame:
        h = F.transform(_places(n), lambda i: F.xxhash64(F.slice("w", i, n)))
        at = rows.select("doc_id", F.posexplode(h).alias("p", "h"))
        return at.select("doc_id", "h", (F.col("p") + 1).alias("at"), F.lit(n).alias("n"))

    parts = [of(n) for n in lengths]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hits = every.join(known, F.col("h") == F.col("__h"), "left_semi")
    hits = hits.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id").withColumn(
        "hits", F.coalesce("hits", F.array().cast("array<struct<at:int,n:int>>"))
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    set_limit: int = SET_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Word counts (doc_id, n_words) of all rows, and verified hits (doc_id, at, n, item_id)."""
    windows = checkpointed(benchmark_windows(benchmark, window))
    lengths = [r.n for r in windows.select("n").distinct().orderBy("n").collect()]  # at most `window` rows
    rows = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w"))
    hashes = [r.h for r in windows.select("h").distinct().limit(set_limit + 1).collect()]
    if len(hashes) <= set_limit:
        known = _hash_set(hashes)
        found = rows.withColumn("hits", _starts(lengths, known))
    else:
        found = _joined_starts(rows, windows, lengths)
    found = found.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), joined(F.col("w"), x["at"], x["n"]).alias("words"))).alias("hits"),
    )
    found = checkpointed(found)
    hits = found.where("size(hits) > 0").select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.*")
    names = windows.select("item_id", F.col("words").alias("__words"), F.col("n").alias("__n"))
    hits = hits.join(names, (F.col("words") == F.col("__words")) & (F.col("n") == F.col("__n")))
    return found.select("doc_id", "n_words"), hits.select("doc_id", "at", "n", "item_id")


def _hash_set(hashes: list[int]):
    """Membership in the set; Spark turns a list of literals into a hash set that each task holds once."""
    return lambda h: h.isin(hashes) if hashes else F.lit(False)


def covered(spans: Column) -> Column:
    """Number of words in the union of (first, last) spans, both ends inclusive."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["last"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(acc["end"] + 1, x["first"]) + 1)).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    set_limit: int = SET_LIMIT,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans) of every document.

    Words are maximal runs of digits, a-z and non-ASCII characters after A-Z became a-z. A word is hit if it lies in an
    occurrence of `window` consecutive words of an item, or of a whole shorter item; items without words have no
    windows. hit_spans lists the hit words as (first, last), counted from 1, by window. Null and empty texts have no
    words. Rows that repeat an identifier get the hits of the repeated text once a row; rows without identifier share
    one verdict. An empty benchmark hits nothing; no documents give no rows. Other columns are ignored.
    """
    counts, hits = find_hits(docs, benchmark, id_col, text_col, window, set_limit)
    each = hits.groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))).alias("hit_spans"),
        F.array_sort(F.collect_set("item_id")).alias("__items"),
    )
    none = F.array().cast("array<struct<first:int,last:int>>")
    rows = counts.join(each, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    rows = rows.withColumn("hit_spans", F.array_sort(F.coalesce("hit_spans", none)))
    rows = rows.withColumn("__items", F.coalesce("__items", F.array().cast("array<string>")))
    rows = rows.withColumn("n_hit", covered(F.col("hit_spans")).cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "hit_spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without any hit, with the columns of docs; each row is judged by its own text."""
    rows = numbered(docs)
    _, hits = find_hits(rows.select("__row", F.col(f"`{text_col}`").alias("text")), benchmark, "__row")
    bad = hits.select(F.col("doc_id").alias("__bad")).distinct()
    return rows.join(bad, F.col("__row") == F.col("__bad"), "left_anti").drop("__row")


OP5_SQL = rf"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM bw WHERE len(w) > 0)
), tok AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, l.n AS n, unnest(range(1, len(w) - l.n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) l WHERE len(w) >= l.n)
), hit AS (
  SELECT t.doc_id, t.i, t.n, win.item_id FROM tok t JOIN win ON t.g = win.g AND t.n = win.n
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(s.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cov c USING (doc_id) LEFT JOIN its s USING (doc_id)
"""
