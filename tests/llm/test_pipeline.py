"""Each stage of the pipeline against plain Python on its own input, and the whole over odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def flat(t):
    return SPACE.sub(" ", t or "")


def shingles(t, n=5):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "near", "benchmark", "mix"]
    for name in ("toxicity", "exact", "near", "benchmark"):
        assert STAGE[name](spark, docs, SF).columns == docs.columns
    assert STAGE["mix"](spark, docs, SF).columns == [*docs.columns, "size", "source_size", "target", "taken"]


def test_exact_stage(spark, docs, texts):
    least = {}
    for i, t in texts.items():
        least[flat(t)] = min(i, least.get(flat(t), i))
    assert ids(STAGE["exact"](spark, docs, SF)) == Counter(least.values())


def test_exact_stage_judges_rows(spark, docs_of):
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (2, "c"), (None, "a b"), (None, "d"), (None, "d"), (3, None), (4, "")]
    kept = STAGE["exact"](spark, docs_of(rows), SF).select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), flat(r.text)) for r in kept) == [("1", "a b"), ("1", "c"), ("3", ""), ("None", "d")]


def test_near_stage_finds_similar_texts_and_nothing_else(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        for copy in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(int(0.012 * len(w)) * bool(copy)):  # each changed word changes five shingles
                w[rng.randrange(len(w))] = rng.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    kept = set(ids(STAGE["near"](spark, docs_of(rows), SF)))
    firsts = {min(i for i in group if group[i] == g) for g in set(group.values())}
    assert firsts <= kept  # of every group the smallest stays, and texts without copies
    similar = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert similar and sum(b not in kept for _, b in similar) >= 0.9 * len(similar)
    for i in set(sets) - kept:
        assert max(jaccard(sets[i], sets[j]) for j in sets if j != i) >= 0.6


def test_near_stage_on_the_table(spark, docs, texts):
    kept = set(ids(STAGE["near"](spark, docs, SF)))
    sets = {i: shingles(t) for i, t in texts.items()}
    for i in set(sets) - kept:
        assert max(jaccard(sets[i], s) for j, s in sets.items() if j != i) >= 0.55
    for s in {frozenset(s) for s in sets.values()}:
        same = [i for i in sets if sets[i] == s]
        assert len(kept & set(same)) <= 1


def test_benchmark_stage(spark, docs, texts):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = TOKEN.findall(low(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1 if w else 0)}
    lengths = {len(w) for w in windows}
    clean = []
    for i, t in texts.items():
        w = TOKEN.findall(low(t))
        if not any(tuple(w[a : a + n]) in windows for n in lengths for a in range(len(w) - n + 1)):
            clean.append(i)
    assert ids(STAGE["benchmark"](spark, docs, SF)) == Counter(clean) and len(clean) < len(texts)


def test_benchmark_stage_judges_rows(spark, docs, docs_of):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    out = STAGE["benchmark"](spark, docs_of([(None, item), (None, "fine"), (1, f"x {item}"), (1, "fine too")]), SF)
    assert sorted(r.text for r in out.select("text").collect()) == ["fine", "fine too"]


def test_toxicity_stage_keeps_rows_that_say_nothing_bad(spark, docs_of):
    rows = [(i, "The cat sat on the mat. " * 1000) for i in range(3)] + [(9, None), (None, "")]
    assert STAGE["toxicity"](spark, docs_of(rows), SF).count() == 5


def test_mix_stage(spark, docs, texts):
    out = STAGE["mix"](spark, docs, SF).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, took = defaultdict(int), defaultdict(int)
    for i, t in texts.items():
        sizes[source[i]] += len(WORD.findall(t or ""))
    for r in out:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 < r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source]
        took[r.source] += r.taken
    names, total, stopped = sorted(sizes, key=lambda s: (s is None, s)), sum(sizes.values()), set()
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    for s in names:
        assert abs(took[s] - want.get(s, 3 * sizes[s])) <= 0.01 * total


def test_mix_stage_judges_rows(spark, docs_of):
    out = STAGE["mix"](spark, docs_of([(1, "a b c"), (1, "a b c d"), (None, "x"), (None, "y")], extra=False), SF).collect()
    assert len(out) == 4 and all(r.taken == r.size == len(r.text.split()) for r in out)


@pytest.fixture
def folder(spark, tmp_path, docs_of):
    def make(rows, bench=(("i1", "zebra lion tiger"),), labels=((1, 0, None), (None, 1, 1))):
        docs_of(rows).withColumn("__text", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(bench), "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make


def test_run_over_odd_rows(spark, folder):
    rows = [*ODD, (20, "Zebra, LION tiger."), (None, None), (21, "word " * 30_001)]
    out = corpus_pipeline.run(spark, folder(rows)).collect()
    got = sorted(str(r.doc_id) for r in out)
    # of the texts without words none has anything to mix; 21 is near 9, whose shingles it has
    assert got == sorted(map(str, [4, 5, 8, 9, 10])) and all(r.taken == r.size > 0 for r in out)


def test_run_over_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], (), ())).count() == 0


def test_run_over_null_labels_and_items(spark, folder):
    out = corpus_pipeline.run(spark, folder([(1, "one two"), (2, "three four")], [(None, None), ("x", "")], [(1, None, None), (2, None, 1)]))
    assert out.count() == 2


def test_run_and_entry(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and out.where("taken > 3 * size").count() == 0
    names = [*__spark_entry__.queries()]
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
