"""Substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash of the MER-word stretches in it;
consecutive windows that share it form a super-k-mer, which travels as one packed string to the bucket of the minimiser.
Equal windows have equal minimisers, so they meet in one bucket. There, windows are sorted by hash and then by location,
neighbours are compared word for word, and every window that is not the first of its kind is marked. Marked stretches
go back to their documents. A bucket with more than WINDOWS_AT_A_TIME windows, as a very frequent minimiser makes, is
counted in several passes, each over the windows whose hash falls to it; packed strings are opened one at a time.

Before anything travels, a piece of a partition keeps one of the super-k-mers whose words are the same and marks the others, so that a
passage or a text that fills a third of all rows sends one copy a piece. Super-k-mers of one bucket and piece are packed
and compressed together.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Hashes, pieces, words_of

WINDOW = 20
MER = 3
BUCKETS_A_PARTITION = 8
#: Text that a map task works on at a time; copies within it are merged before they travel.
PIECE = 1 << 23
#: Windows that a reduce task sorts at a time, some 40 bytes each.
WINDOWS_AT_A_TIME = 1 << 23
#: Zstandard's level for what travels.
LEVEL = 3

SENT = "bucket int, kind int, windows long, packed binary"
MARKED = "doc_id long, first int, last int"


def _pack(ids: np.ndarray, at: np.ndarray, second: np.ndarray, text: bytes) -> bytes:
    """ids, word positions and, of a super-k-mer, its number of windows or, of a marked stretch, its end; then words."""
    steps = np.diff(ids.astype(np.int64), prepend=0)  # identifiers mostly grow, so steps pack better
    head = np.int64(len(ids)).tobytes() + steps.tobytes() + at.astype(np.int32).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + second.astype(np.int32).tobytes() + text)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    at, second = np.frombuffer(raw, np.int32, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 12 * n)
    return ids, at, second, np.frombuffer(raw, np.uint8, -1, 8 + 16 * n)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each stretch of width values, by doubling."""
    done, m = 1, h
    while 2 * done <= width:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - done : width - done + n])


def super_kmers(words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """First word, number of windows, minimiser and hash of the words of each super-k-mer of a slice."""
    n = len(words.starts)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    mer = min(MER, window)
    hashes = Hashes(words.text)
    least = _least(hashes.of(words.starts[: n - mer + 1], words.ends[mer - 1 :]), window - mer + 1)
    valid = words.doc[: n - window + 1] == words.doc[window - 1 :]
    same = np.zeros(len(valid), dtype=bool)
    same[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~same)
    stop = np.append(same, False)[1:]
    last = np.flatnonzero(valid & ~stop)
    return first, last - first + 1, least[first], hashes.of(words.starts[first], words.ends[last + window - 1])


def _cut(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in (p for b in batches for p in pieces(b, 1, PIECE)):
            known = np.asarray(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            parts, texts, held = [], [], 0
            for w in words_of(batch.column(1), overlap=window - 1):
                first, n, least, own = super_kmers(w, window)
                ok = known[w.first + w.doc[first]]
                first, n, least, own = first[ok], n[ok], least[ok], own[ok]
                doc = w.doc[first]
                parts.append(
                    (
                        np.full(len(first), len(texts)), w.starts[first], w.ends[first + n + window - 2], least, own,
                        ids[w.first + doc], first - w.bounds[doc] + w.base, n,
                    )
                )
                texts.append(w.text.tobytes())
                held += len(texts[-1])
                if held >= PIECE:  # a long text goes out as it is read
                    yield _bucketed(parts, texts, window, buckets, turn := turn + 1)
                    parts, texts, held = [], [], 0
            if parts:
                yield _bucketed(parts, texts, window, buckets, turn := turn + 1)

    return run


def _bucketed(parts: list[tuple], texts: list[bytes], window: int, buckets: int, turn: int) -> pa.RecordBatch:
    """Packed super-k-mers by bucket, and those that are marked, in a bucket by turn."""
    of, start, end, least, own, doc, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, doc, own))
    marked, lead = np.zeros(len(order), dtype=bool), -1
    alike = np.zeros(len(order), dtype=bool)
    alike[1:] = own[order][1:] == own[order][:-1]
    for i in np.flatnonzero(alike | np.append(alike[1:], False)):  # only those that may have copies
        x = order[i]
        if not alike[i]:
            lead = x
        elif texts[of[x]][start[x] : end[x]] == texts[of[lead]][start[lead] : end[lead]]:
            marked[x] = True
    out = {"bucket": [], "kind": [], "windows": [], "packed": []}
    if marked.any():
        x = np.flatnonzero(marked)
        # A repeated row of one document marks nothing: its first copy stands at the same place.
        lead_of = _leaders(order, alike, marked)
        x = x[(doc[x] != doc[lead_of[x]]) | (at[x] != at[lead_of[x]])]
        out["bucket"].append(turn % buckets)
        out["kind"].append(1)
        out["windows"].append(0)
        out["packed"].append(_pack(doc[x], at[x], at[x] + n[x] + window - 1, b""))
    x = np.flatnonzero(~marked)
    bucket = (least[x] % np.uint64(buckets)).astype(np.int64)
    x = x[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        y = x[a:b]
        text = b"".join(texts[t][s : e + 1] for t, s, e in zip(of[y].tolist(), start[y].tolist(), end[y].tolist(), strict=True))
        out["bucket"].append(int(bucket[a]))
        out["kind"].append(0)
        out["windows"].append(int(n[y].sum()))
        out["packed"].append(_pack(doc[y], at[y], n[y], text))
    return pa.RecordBatch.from_arrays(
        [pa.array(out[c], t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=[*out]
    )


def _leaders(order: np.ndarray, alike: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """For each super-k-mer the first one of its kind."""
    head = np.where(~alike, np.arange(len(order)), 0)
    lead = np.empty(len(order), dtype=np.int64)
    lead[order] = order[np.maximum.accumulate(head)]
    return lead


def _stretches(doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Marked windows as (document, first word, word after the last)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], at[last] + window


def _windows(packed: bytes, window: int) -> tuple[np.ndarray, ...]:
    """Document, first word, first byte and end of each window of a packed string, and its text."""
    ids, at, n, text = _unpack(packed)
    stops = np.flatnonzero(text == 0x20)
    begins = np.append(0, stops[:-1] + 1)
    n_words = n + window - 1
    base = np.cumsum(n_words) - n_words
    of = np.repeat(np.arange(len(ids)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    w = base[of] + step
    return ids[of], at[of] + step, begins[w], stops[w + window - 1], text


def _repeated(blobs: list[bytes], window: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of each window that is not the first of its kind, of windows whose hash falls to the part."""
    hashes, places = [], []
    for x in blobs:
        _, _, start, end, text = _windows(x, window)
        h = Hashes(text).of(start, end)
        mine = np.arange(len(h), dtype=np.int32) if parts == 1 else np.flatnonzero(h % np.uint64(parts) == part).astype(np.int32)
        hashes.append(h[mine])
        places.append(mine)
    edges = np.cumsum([0, *map(len, hashes)])
    h = np.concatenate(hashes)
    del hashes
    order = np.argsort(h)
    alike = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][alike]] = True
    twice[order[:-1][alike]] = True
    del order, alike
    found, texts = [], []
    for k, x in enumerate(blobs):  # only what may be repeated is looked at word for word
        some = twice[edges[k] : edges[k + 1]]
        if not some.any():
            continue
        doc, at, start, end, text = _windows(x, window)
        i = places[k][some]
        raw = text.tobytes()
        found.append((h[edges[k] : edges[k + 1]][some], doc[i], at[i]))
        texts += [raw[a:b] for a, b in zip(start[i].tolist(), end[i].tolist(), strict=True)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, doc, h))
    h, doc, at = h[order], doc[order], at[order]
    marked = np.zeros(len(h), dtype=bool)
    kinds: dict[bytes, list[int]] = {}
    new = np.append(True, h[1:] != h[:-1])
    for k, (i, head, *place) in enumerate(zip(order.tolist(), new.tolist(), doc.tolist(), at.tolist(), strict=True)):
        if head:
            kinds = {}
        marked[k] = kinds.setdefault(texts[i], place) != place
    return doc[marked], at[marked]


def _count(window: int, limit: int | None = None):
    def run(group: pa.Table) -> pa.Table:
        kinds = np.asarray(group["kind"])
        blobs = group["packed"].to_pylist()
        out: list[tuple[np.ndarray, ...]] = [_unpack(x)[:3] for x, k in zip(blobs, kinds, strict=True) if k]
        blobs = [x for x, k in zip(blobs, kinds, strict=True) if not k]
        parts = max(1, -(-int(np.asarray(group["windows"]).sum()) // (limit or WINDOWS_AT_A_TIME)))
        for part in range(parts if blobs else 0):
            doc, at = _repeated(blobs, window, part, parts)
            if len(doc):
                out.append(_stretches(doc, at, window))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "first": pa.array(cols[1], pa.int32()), "last": pa.array(cols[2], pa.int32())})

    return run


def repeated_stretches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, windows_at_a_time: int | None = None
) -> DataFrame:
    """(doc_id, first, last): stretches of words whose windows start earlier as well; they may overlap."""
    spark = docs.sparkSession
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = own.mapInArrow(_cut(window, buckets), SENT)
    return sent.groupBy("bucket").applyInArrow(_count(window, windows_at_a_time), MARKED)


def _strip(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretches = batch.column(2)
            at = np.asarray(stretches.offsets)
            flat = stretches.values
            first, last = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            valid = np.asarray(stretches.is_valid())
            n_words, n_removed, sums, texts = [], [], [], []
            for w in words_of(batch.column(1)):
                raw = w.text.tobytes()
                for i in range(w.n_docs):
                    row, (a, b) = w.first + i, w.bounds[i : i + 2]
                    n = int(b - a)
                    change = np.zeros(n + 1, dtype=np.int32)
                    if valid[row]:
                        x, y = at[row], at[row + 1]
                        np.add.at(change, np.clip(first[x:y] - w.base, 0, n), 1)
                        np.add.at(change, np.clip(last[x:y] - w.base, 0, n), -1)
                    kept = np.cumsum(change)[:n] == 0
                    edge = np.flatnonzero(np.diff(kept, prepend=False, append=False)) + a
                    runs = [raw[w.starts[s] : w.ends[e - 1]] for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    text = b" ".join(runs)
                    if not w.base:
                        digest, total, removed, said, told = hashlib.sha256(), 0, 0, False, []
                    if text and said:
                        text = b" " + text
                    said = said or bool(text)
                    digest.update(text)
                    total, removed = total + n, removed + n - int(kept.sum())
                    if with_text:
                        told.append(text)
                    if w.more:
                        continue
                    n_words.append(total)
                    n_removed.append(removed)
                    sums.append(digest.hexdigest())
                    texts.append(b"".join(told) if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(sums, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): words covered by a window that starts earlier too are gone.

    Words are maximal runs without blank, tab, line feed, vertical tab, form feed and carriage return; windows are
    judged on the input. Earlier is a smaller identifier (an integer), or the same document and an earlier start. Null
    and empty texts have no words; documents of fewer than `window` words lose none. Rows that repeat an identifier
    repeat one document and get one verdict. A row without identifier takes no part: it loses nothing. kept_text joins
    the kept words by one blank (null unless with_text). Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = (
        repeated_stretches(docs, id_col, text_col, window)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_list(F.struct("first", "last")).alias("__marks"))
    )
    rows = own.join(marks, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "__marks")
    return rows.mapInArrow(
        _strip(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
