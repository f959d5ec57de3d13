"""Language identification by word-first backoff.

A known word counts with its log frequency in each language. An unknown word falls back on its character n-grams with
word edges: the longest length of which any n-gram is known decides, shorter ones are tried only if none is. Frequencies
come from a bounded sample of labelled rows (SAMPLE_DOCS of them, as many of each language, by a hash of the identifier).
The sample is written out once and counted once; words and n-grams that it has LEAST_WORD and LEAST_GRAM times make the
model that workers get, so the model is bounded by the sample.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import TokenTable, held_out, kept_table, stripped

SAMPLE_DOCS = 8192
#: How often the sample must have a word or an n-gram for it to be known.
LEAST_WORD, LEAST_GRAM = 3, 5
LONGEST_GRAM = 4
#: How much less an n-gram says than a whole word, a length.
DISCOUNT = {4: 0.7, 3: 0.5, 2: 0.3, 1: 0.15}
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """langs in order of their share, and for each word and n-gram the log frequency in each language
    less the mean over languages."""

    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]


def grams(word: str, n: int) -> list[str]:
    edged = f"^{word}$" if n > 1 else word
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in map(stripped, (text or "").lower().split()) if any(c.isalpha() for c in w))
        pieces: Counter = Counter()
        for (lang, w), k in words.items():
            for n in range(1, LONGEST_GRAM + 1):
                for g in grams(w, n):
                    pieces[lang, g] += k
        rows = [(lang, w, True, k) for (lang, w), k in words.items()] + [(lang, g, False, k) for (lang, g), k in pieces.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)],
            names=["lang", "piece", "is_word", "n"],
        )


def sample_ids(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n identifiers, by a hash: bounded whatever the input, and the same in each run."""
    ids = rows.select(F.col(id_col).alias("__sample_id"))
    return ids.orderBy(F.xxhash64("__sample_id"), "__sample_id").limit(n)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from rows that are not held out and have a language; without such rows the model knows no language."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = checkpointed(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    quota = max(1, SAMPLE_DOCS // max(1, sizes.count()))
    # A hash below a language's rate leaves about twice its quota, so the ranking sees few rows of a hot language too.
    rates = sizes.select(F.col("lang").alias("__of"), F.least(F.lit(1.0), F.lit(2.0 * quota) / F.col("n")).alias("rate"))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / float(1 << 53)
    some = usable.select("id", "lang").join(F.broadcast(rates), F.col("lang") == F.col("__of")).where(at < F.col("rate"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 53)), "id"))
    ids = some.select("id", "lang").distinct().withColumn("place", place).where(F.col("place") <= quota)
    ids = checkpointed(ids.select(F.col("id").alias("__id"), F.col("lang").alias("__lang")))
    # SAMPLE_DOCS rows, or one a language
    taken = usable.join(F.broadcast(ids), (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")
    counted = taken.select("lang", "text").mapInArrow(_counts, "lang string, piece string, is_word boolean, n long")
    by_lang = counted.groupBy("is_word", "piece", "lang").agg(F.sum("n").alias("n"))
    pieces = by_lang.groupBy("is_word", "piece").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    known = pieces.where(F.col("total") >= F.when(F.col("is_word"), LEAST_WORD).otherwise(LEAST_GRAM)).collect()
    known.sort(key=lambda r: r["piece"])
    most = [[r for r in known if r["is_word"] == is_word] for is_word in (True, False)]
    totals: Counter = Counter()
    for r in most[0]:
        totals.update(r["by"])
    langs = [x for x, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))]

    def logs(rows: list) -> dict[str, tuple[float, ...]]:
        if not langs:
            return {}
        n = np.array([[r["by"].get(x, 0) for x in langs] for r in rows], dtype=float).reshape(-1, len(langs)) + 0.1
        table = np.log(n / n.sum(axis=0))
        table -= table.mean(axis=1, keepdims=True)
        return dict(zip((r["piece"] for r in rows), map(tuple, table.tolist()), strict=True))

    return LanguageModel(langs, logs(most[0]), logs(most[1]))


def token_row(model: LanguageModel, token: str) -> Sequence[float]:
    """What a token says for each language, and whether it has a letter."""
    w = stripped(token)
    if not w.isalpha() and not any(map(str.isalpha, w)):
        return (0.0,) * (len(model.langs) + 1)
    known = model.words.get(w)
    if known is not None:
        return (*known, 1.0)
    for n in range(LONGEST_GRAM, 0, -1):
        hits = [x for x in map(model.grams.get, grams(w, n)) if x is not None]
        if hits:
            share = DISCOUNT[n] / len(hits)
            return (*[share * sum(x) for x in zip(*hits, strict=True)], 1.0)
    return (*(0.0,) * len(model.langs), 1.0)


def predict_text(model: LanguageModel, table: TokenTable, text: str | None) -> tuple[str, float]:
    rows = table.values(text or "")
    letters = rows[:, -1].sum() if len(rows) else 0
    if not letters or not model.langs:
        return UNKNOWN, 0.0
    total = rows[:, :-1].sum(axis=0)
    odds = np.exp(np.clip(total - total.max(), -50, 0))
    best = int(odds.argmax())
    return model.langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text alone.

    `und` with score 0 if the text is null or has no letter, or if nothing could be learned. score is the share of the
    best language's likelihood among all. Ties go to the language with more words in the sample. Rows are judged one by
    one; no rows give no rows. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = kept_table(key, lambda t: token_row(m, t), len(m.langs) + 1)
        for batch in batches:
            found = [predict_text(m, table, t.as_py()) for t in batch.column(2)]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
