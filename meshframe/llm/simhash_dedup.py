"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints within DISTANCE bits agree wholly on at least KEEP of BLOCKS blocks of bits, so every link lies in a group of
fingerprints that share such a combination of blocks. In a group, fingerprints are sorted by Gray rank, so that
neighbours differ in few bits. Runs of FAN nodes get an upper node that holds the bits which all of them share; a search
goes down from the root, adds up the differences on the bits that a node adds to its parent, and drops the whole node
when they exceed the distance, or when all below it is already joined with the one that searches. A group hands on a
spanning forest of its links, never all pairs. Large-star and small-star rounds join the forests of all groups into
components.

Only distinct fingerprints travel; copies of one text are one fingerprint with the smallest identifier.

For near duplicates by similarity (keep_one_a_group) the fingerprint has WIDE words of 64 bits over the set of five-word
shingles. Two sets of Jaccard similarity s differ in about acos(2s / (1 + s)) / pi of the bits, which gives the distance;
candidates are those that agree on all of SAMPLED bits in one of TABLES samples of bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Hashes, Words, words_of
from .common import checkpointed, numbered

SHINGLE, SEED = 3, 42
DISTANCE = 2
BLOCKS, KEEP = 5, 3
FAN = 8
#: Candidates that a search holds at a time.
FRONT = 1 << 21
SHINGLES_AT_A_TIME = 1 << 18
#: Fingerprints for a similarity: shingles of NEAR_SHINGLE words, WIDE words of 64 bits. Distances scatter, so the limit is
#: SLACK standard deviations above the mean at that similarity: it takes 0.94 of the pairs at 0.8, 0.7 of those at 0.75
#: and 0.05 of those at 0.6. A pair at 0.8 agrees in one of the TABLES samples of SAMPLED bits with probability 0.91.
NEAR_SHINGLE, SIMILARITY, WIDE, SLACK = 5, 0.8, 4, 1.5
TABLES, SAMPLED = 32, 16
#: A fingerprint that at least one in so many rows has is joined in SALTS parts; there are no more than HOT of them.
HOT, SALTS = 1000, 64

#: For each byte, its bits as eight bytes of one number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(h: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set among h[heads[i] : heads[i] + n[i]], for stretches that follow each other."""
    ones = np.zeros((len(n), 64), dtype=np.int64)
    some = np.flatnonzero(n)
    for a in range(0, len(h), SHINGLES_AT_A_TIME):
        part = h[a : a + SHINGLES_AT_A_TIME]
        inside = some[(heads[some] < a + len(part)) & (heads[some] + n[some] > a)]
        cut = np.maximum(heads[inside] - a, 0)
        size = np.diff(np.append(cut, len(part)))
        parts = (size + 254) // 255  # a lane counts to 255
        first = np.cumsum(parts) - parts
        at = np.repeat(cut, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
        lanes = np.add.reduceat(_LANES[part.view(np.uint8).reshape(-1, 8)], at, axis=0)
        ones[inside] += np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    return ones


def _shingles(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each shingle, and the first shingle and number of shingles of each text."""
    n = np.diff(w.bounds)
    count = np.maximum(n - length + 1, 0) if w.base else np.where(n >= length, n - length + 1, np.minimum(n, 1))
    heads = np.cumsum(count) - count
    word = np.arange(count.sum()) + np.repeat(w.bounds[:-1] - heads, count)
    last = np.minimum(word + length, np.repeat(w.bounds[1:], count)) - 1
    return w.starts[word], w.ends[last], heads, count


def _packed(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    mark = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(mark, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        all_ones, all_n = 0, 0
        for w in words_of(batch.column(1), lower=True, overlap=SHINGLE - 1):
            start, end, heads, n = _shingles(w, SHINGLE)
            raw = w.text.tobytes()
            h = np.array([digest(raw[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
            ones = bit_counts(h, heads, n)
            if w.base or w.more:
                ones, n = all_ones + ones, all_n + n
                all_ones, all_n = (ones, n) if w.more else (0, 0)
            out[w.first : w.first + w.n_docs] = _packed(ones, n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same, for each k."""
    x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the sets of shingles, WIDE words each."""
    for batch in batches:
        out = np.zeros((WIDE, batch.num_rows), dtype=np.uint64)
        seen: list[np.ndarray] = []
        for w in words_of(batch.column(2), lower=True, overlap=NEAR_SHINGLE - 1):
            start, end, _, n = _shingles(w, NEAR_SHINGLE)
            h = Hashes(w.text).of(start, end)
            doc = np.repeat(np.arange(w.n_docs), n)
            if w.base or w.more:
                seen.append(np.unique(h))
                if w.more:
                    continue
                h, seen = np.concatenate(seen), []
                doc = np.zeros(len(h), dtype=np.int64)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, n = h[new], np.bincount(doc[new], minlength=w.n_docs)
            heads = np.cumsum(n) - n
            for k in range(WIDE):
                out[k, w.first : w.first + w.n_docs] = _packed(bit_counts(_mixed(h, k), heads, n), n)
        fps = [pa.array(x.view(np.int64)) for x in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *fps], names=["__id", "__row", *FPS])


FPS = [f"f{k}" for k in range(WIDE)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a bit is 1 if set in over half of the shingles' hashes; without words the fingerprint is 0."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(block, KEEP)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class GrayIndex:
    """Hierarchical index over the fingerprints of many groups, sorted by group and Gray rank. A fingerprint is a number
    or a row of them; order gives where each came from."""

    def __init__(self, group: np.ndarray, values: np.ndarray) -> None:
        words = values if values.ndim == 2 else values[:, None]
        rank, odd = words.copy(), np.zeros(len(words), dtype=np.uint64)
        for k in range(words.shape[1]):
            for s in (1, 2, 4, 8, 16, 32):
                rank[:, k] ^= rank[:, k] >> np.uint64(s)
            rank[:, k] ^= np.uint64(0) - odd  # an odd number of bits before turns all that follow
            odd = rank[:, k] & np.uint64(1)
        self.order = np.lexsort((*rank.T[::-1], group))
        self.values, self.group, self.words, self.most = values[self.order], group[self.order], words[self.order], 0
        low, high, g = self.words, self.words, self.group
        last = np.arange(len(g))
        self.levels = [(low, np.full_like(low, ~np.uint64(0)), None, None, last)]
        while len(g) and (g[1:] == g[:-1]).any():
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            place = np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g))))
            first = np.flatnonzero(place % FAN == 0)
            stop = np.append(first[1:], len(place))
            low, high = np.bitwise_and.reduceat(low, first, axis=0), np.bitwise_or.reduceat(high, first, axis=0)
            g, last = g[first], last[stop - 1]
            self.levels.append((low, ~(low ^ high), first, stop, last))
        self.root = np.repeat(np.arange(len(g)), np.diff(np.append(np.searchsorted(self.group, g), len(self.group))))

    def joined(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node of each level the label of all that is below it, -1 if there are several."""
        out = [label]
        for _, _, first, _, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], first), np.maximum.reduceat(out[-1], first)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, within: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, value) of positions in one group that have different labels, the value after the query, within
        so many bits; most is the number of candidates that were held at a time."""
        count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int16)
        label = np.arange(len(self.words)) if label is None else label
        below = self.joined(label)
        q, node, self.most = queries, self.root[queries], len(queries)
        low, shared, first, stop, last = self.levels[-1]
        far = count((self.words[q] ^ low[node]) & shared[node])
        for level in range(len(self.levels) - 2, -1, -1):
            ok = (far <= within) & (last[node] > q) & (below[level + 1][node] != label[q])
            q, node, far = q[ok], node[ok], far[ok]
            n = stop[node] - first[node]
            child = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = np.repeat(q, n)
            self.most = max(self.most, len(q))
            if level == 0:  # a leaf has all bits: what its parents added up is part of the whole difference
                far, node = count(self.words[q] ^ self.words[child]), child
                continue
            parent_bits, far = np.repeat(shared[node], n, axis=0), np.repeat(far, n)
            low, shared, first, stop, last = self.levels[level]
            far = far + count((self.words[q] ^ low[child]) & shared[child] & ~parent_bits)
            node = child
        ok = (far <= within) & (node > q) & (label[node] != label[q])
        return q[ok], node[ok]


def forest(group: np.ndarray, values: np.ndarray, within: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place of the representative) that join whatever lies within so many bits in one group.

    Searches go on from what is joined already, so a group of many that are all alike takes about as long as it is large.
    """
    index = GrayIndex(group, values)
    n = len(values)
    label = np.arange(n)
    sizes = np.bincount(index.group, minlength=1)[index.group] if n else np.zeros(0, np.int64)
    load, share, a = np.cumsum(sizes), 1.0, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + FRONT / share, "right")))
        i, j = index.search(np.arange(a, b), within, label)
        share = min(1.0, max(2.0 * index.most / max(1, load[b - 1] - (load[a - 1] if a else 0)), share / 2))
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        a = b
    moved = np.flatnonzero(label != np.arange(n))
    return index.order[moved], index.order[label[moved]]


def _linker(within: int, keys: int, words: int):
    """Rows come sorted by `keys` columns of keys, which words of a fingerprint follow, and perhaps a node's number; a
    group may go on in the next batch. Links are between numbers, or between fingerprints of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(batch.num_columns)])
            if not rows.shape[1]:
                continue
            if rest and (rest[-1][:keys, -1] == rows[:keys, -1]).all():  # all of one group
                rest.append(rows)
                continue
            rows = np.concatenate([*rest, rows], axis=1)
            new = np.append(True, (rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0))
            cut = int(np.flatnonzero(new)[-1])
            rest = [rows[:, cut:]]
            if cut:
                yield links(rows[:, :cut], new[:cut])
        if rest:
            rows = np.concatenate(rest, axis=1)
            yield links(rows, np.append(True, np.zeros(rows.shape[1] - 1, dtype=bool)))

    def links(rows: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(new) - 1
        some = np.bincount(group)[group] > 1
        group = np.unique(group[some], return_inverse=True)[1]
        u, v = forest(group, np.ascontiguousarray(rows[keys : keys + words, some].T).view(np.uint64), within)
        name = rows[-1, some]
        return pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[v])], names=["u", "v"])

    return run


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link what a node sees to the smallest node that it sees: of the larger ones (large-star) or of the smaller."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"))
    least = least.select("__u", F.least("__u", "__m").alias("__m"))
    seen = both.where("v > u") if large else both.unionByName(both.select("u", F.col("u").alias("v")))
    return (
        seen.join(least, F.col("u") == F.col("__u"))
        .select(F.col("v").alias("u"), F.col("__m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of a link but the smallest of its component, with that smallest node.

    Each round's links are written out, so a lost executor costs a round's partitions at most. Rounds grow with the
    logarithm of a component's width.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        edges = checkpointed(_star(_star(edges, True), False))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest identifier in reach.

    Words are maximal runs without blank, tab, line feed, vertical tab, form feed and carriage return, A-Z in lower
    case; fingerprints link at DISTANCE or fewer differing bits. Null and empty texts have fingerprint zero and link
    like others. Rows that repeat an identifier are fingerprinted one by one. Null identifiers take part but are never
    the smallest, unless a component has no other (component_id null). No rows give no rows.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(_signed(m)).bitwiseAND(F.col("fp")).alias("key")) for i, m in enumerate(_masks())])
    dealt = (
        nodes.select("fp", F.explode(keys).alias("k"))
        .select("k.c", "k.key", "fp")
        .repartition("c", "key")
        .sortWithinPartitions("c", "key")
    )
    tree = components(dealt.mapInArrow(_linker(DISTANCE, 2, 1), "u long, v long"))
    node = nodes.join(tree, F.col("fp") == F.col("u"), "left").select(
        F.col("fp").alias("__fp"), F.coalesce("v", "fp").alias("__root"), "least", "n"
    )
    roots = tree.select(F.col("v").alias("__root")).distinct()
    linked = node.join(roots, "__root", "left_semi")
    best = linked.groupBy("__root").agg(F.min("least").alias("component_id"))
    linked = linked.join(best, "__root").select("__fp", "component_id", "n")
    alone = node.join(roots, "__root", "left_anti").select("__fp", F.col("least").alias("component_id"), "n")
    verdict = checkpointed(linked.unionByName(alone))
    # A fingerprint of very many rows meets its rows in parts; by arithmetic there are at most HOT such fingerprints.
    total = prints.count()
    hot = F.col("n") * HOT > total
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = verdict.select("__fp", "component_id", F.explode(parts).alias("__part"))
    few = F.broadcast(verdict.where(hot).select(F.col("__fp").alias("__hot")))
    own = prints.join(few, F.col("fp") == F.col("__hot"), "left")
    part = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    own = own.select("doc_id", "fp", part.alias("__own"))
    return own.join(salted, (F.col("fp") == F.col("__fp")) & (F.col("__own") == F.col("__part"))).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _samples() -> list[list[int]]:
    """Of each table the bits that it compares, as a mask a word. Sixteen tables in a row part all bits among them."""
    bits, out = 64 * WIDE, []
    for t in range(TABLES):
        turn = 2 * (t * SAMPLED // bits) + 1  # an odd step visits every bit once
        masks = [0] * WIDE
        for i in range(SAMPLED):
            at = (t * SAMPLED + i) * (77 + 46 * turn) % bits
            masks[at // 64] |= 1 << at % 64
        out.append([_signed(m) for m in masks])
    return out


def near_distance(similarity: float) -> int:
    """The limit in bits of WIDE words: SLACK deviations above the mean of two sets of that Jaccard similarity."""
    n, p = 64 * WIDE, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(n * p + SLACK * math.sqrt(n * p * (1 - p)))


def keep_one_a_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay when of each group of near duplicates one does, with the columns of docs.

    Texts are linked when their fingerprints over sets of NEAR_SHINGLE-word shingles differ in no more bits than sets of
    that Jaccard similarity mostly do; groups are what links connect. The row with the smallest identifier stays
    (null last; of repeated identifiers one row). Texts without words are one group. No rows give no rows.
    """
    rows = numbered(docs)
    own = rows.select(F.col(f"`{id_col}`").alias("__id"), "__row", F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(own.dtypes)["__id"]
    prints = checkpointed(own.mapInArrow(_wide, f"__id {kind}, __row struct<file:long,at:long>, " + ", ".join(f"{f} long" for f in FPS)))
    least = F.min(F.struct(F.isnull("__id").alias("none"), "__id", "__row")).alias("least")
    nodes = checkpointed(prints.groupBy(*FPS).agg(least).withColumn("node", F.monotonically_increasing_id()))
    keys = [
        F.xxhash64(F.lit(t), *[F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(FPS, masks, strict=True) if m]) for t, masks in enumerate(_samples())
    ]
    dealt = (
        nodes.select(F.explode(F.array(*keys)).alias("key"), *FPS, "node")
        .repartition("key")
        .sortWithinPartitions("key")
    )
    tree = components(dealt.mapInArrow(_linker(near_distance(similarity), 1, WIDE), "u long, v long"))
    node = nodes.select("least", "node").join(tree, F.col("node") == F.col("u"), "left")
    best = node.groupBy(F.coalesce("v", "node").alias("root")).agg(F.min("least").alias("least"))
    return rows.join(best.select(F.col("least.__row").alias("__kept")), F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
