"""The operators that work on texts in batches, against brute force, and learned ones by held-out accuracy."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from odd_rows import ODD

from meshframe.llm import bytewords, html_text, language_id, simhash_dedup, substring_dedup, toxicity
from meshframe.llm.bytewords import Hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_words_of_a_column():
    texts = [None, "", " a\tb ", "ünï\x0bx", "\x85y z", "q" * 5_000_000, "last"] * 3
    got, rows = {}, 0
    for w in words_of(pa.array(texts)):
        raw = w.text.tobytes()
        for i in range(w.n_docs):
            a, b = w.bounds[i : i + 2]
            got[w.first + i] = [raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
        rows += w.n_docs
    assert rows == len(texts) and got == {i: WORD.findall(t or "") for i, t in enumerate(texts)}


LONG_TEXTS = [
    None, "x", " ".join(f"w{i % 17}" for i in range(400)), "a" * 90 + " B", " \t" * 60, "q" * 200, "é " * 80 + "z" * 100 + " end", "one two",
    " ".join(f"w{i % 17}" for i in range(30)), "lead " + "b" * 300 + " tail " * 30,
]


@pytest.mark.parametrize("overlap", [0, 1, 4, 19])
def test_long_texts_come_in_overlapping_slices(monkeypatch, overlap):
    monkeypatch.setattr(bytewords, "SLICE_BYTES", 64)
    got = {}
    for w in words_of(pa.array(LONG_TEXTS), overlap=overlap):
        raw = w.text.tobytes()
        assert not (w.more and w.n_docs > 1) and (not w.more or len(w.starts) > overlap)
        for i in range(w.n_docs):
            a, b = w.bounds[i : i + 2]
            words = [raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
            old = got.setdefault(w.first + i, [])
            assert old[w.base :] == words[: len(old) - w.base] and (not w.base or len(old) - w.base == overlap)
            old[w.base :] = words
    assert got == {i: WORD.findall(t or "") for i, t in enumerate(LONG_TEXTS)}


@pytest.mark.parametrize("size", [16, 64, 1 << 21])
def test_operators_on_slices_of_long_texts(monkeypatch, size):
    """The slices' size changes no fingerprint, window or digest."""
    ids = pa.array(range(len(LONG_TEXTS)))
    texts = pa.array(LONG_TEXTS)
    batch = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
    wide = pa.RecordBatch.from_arrays([ids, ids, texts], names=["__id", "__row", "text"])
    usual = next(simhash_dedup._wide(iter([wide])))
    monkeypatch.setattr(bytewords, "SLICE_BYTES", size)
    monkeypatch.setattr(substring_dedup, "PIECE", 2 * size)
    got = next(simhash_dedup._fingerprints(iter([batch])))
    assert [x % (1 << 64) for x in got.column(1).to_pylist()] == [fingerprint(t) for t in LONG_TEXTS]
    assert next(simhash_dedup._wide(iter([wide]))).equals(usual)

    sent = pa.Table.from_batches(substring_dedup._cut(20, 7)(iter([batch])))
    found = [substring_dedup._count(20)(sent.filter(pa.compute.equal(sent["bucket"], b))).to_pylist() for b in range(7)]
    marks = [[] for _ in LONG_TEXTS]
    for r in (r for f in found for r in f):
        marks[r["doc_id"]].append({"first": r["first"], "last": r["last"]})
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    rows = pa.RecordBatch.from_arrays([ids, texts, pa.array([m or None for m in marks], kind)], names=["doc_id", "text", "__marks"])
    done = next(substring_dedup._strip(True)(iter([rows]))).to_pylist()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in done} == brute_substrings(list(enumerate(LONG_TEXTS)))
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in done)
    assert sum(r["n_removed"] for r in done) > 350


def test_hashes_do_not_depend_on_place():
    text = np.frombuffer(b"the cat the cat sat the cat " * 1000, dtype=np.uint8)
    h = Hashes(text).of(np.array([0, 8, 20, 28 * 999, 4]), np.array([7, 15, 27, 28 * 999 + 7, 11]))
    assert len(set(h[:4].tolist())) == 1 and h[4] != h[0]


def brute_substrings(rows, n=20):
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None}, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), (d, i)) != (d, i):
                gone[i : i + n] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(docs_of):
    rng = random.Random(4)
    passages = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*passages, f"u{i}", "v " * rng.randint(0, 30)]) for _ in range(rng.randint(0, 5)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "same " * 3000), (503, "same " * 25), (504, " ".join(map(str, range(20_000)))), (505, " ".join(map(str, range(20_000))))]
    got = substring_dedup.substring_dedup(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substrings(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.substring_dedup(docs_of(rows).where("false")).count() == 0


def test_buckets_counted_in_passes_mark_the_same(docs_of):
    rng = random.Random(14)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, " ".join([*(f"u{rng.randrange(50)}" for _ in range(rng.randint(0, 40))), passage, "tail " * rng.randint(0, 40)])) for i in range(60)]
    whole = substring_dedup.repeated_stretches(docs_of(rows))
    passes = substring_dedup.repeated_stretches(docs_of(rows), windows_at_a_time=10)

    def words(df):
        return {(r.doc_id, k) for r in df.collect() for k in range(r.first, r.last)}

    assert words(whole) == words(passes) and len(words(whole)) > 59 * 80


def test_substring_dedup_of_odd_rows(odd):
    got = substring_dedup.substring_dedup(odd).collect()
    assert len(got) == len(ODD)
    want = brute_substrings(ODD)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        else:
            assert r.n_removed == 0


def fingerprint(t):
    w = WORD.findall(low(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    """values: {id: fingerprint}"""
    label = {i: i for i in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(values)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (values[a] ^ values[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs_of):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(8)]
    rows = []
    for i in range(240):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "Edit"
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "One"), (903, "one"), (904, "a b"), (905, base[0] + " tail " * 40_000)]
    got = {r.doc_id: r for r in simhash_dedup.simhash_dedup(docs_of(rows)).collect()}
    values = {i: fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in values.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(values)
    assert simhash_dedup.simhash_dedup(docs_of(rows).where("false")).count() == 0


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    v = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    group = np.arange(len(v)) % 3
    index = simhash_dedup.GrayIndex(group, v)
    i, j = index.search(np.arange(len(v)), 2)
    got = {frozenset((int(index.values[a]), int(index.values[b]))) for a, b in zip(i, j, strict=True)}
    want = {
        frozenset((int(a), int(b)))
        for n, (a, g) in enumerate(zip(v, group, strict=True))
        for b, h in zip(v[:n], group[:n], strict=True)
        if g == h and int(a ^ b).bit_count() <= 2
    }
    assert got == want and len(want) > 50


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (-5, 1001)]
    got = {r.u: r.v for r in simhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000: -5, 1001: -5}


def test_simhash_of_odd_rows(odd):
    got = simhash_dedup.simhash_dedup(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[None].component_id == 5
    kept = simhash_dedup.keep_one_a_group(odd)
    assert kept.columns == odd.columns


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_held_out_rows(tables):
    docs, _ = tables
    got = language_id.identify(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd, tables):
    model = language_id.learn(tables[0])
    got = language_id.identify(odd, model).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred in model.langs for r in got if r.doc_id not in (1, 2, 3))
    nothing = language_id.learn(tables[0].where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_language_against_a_plain_version(docs_of):
    rng = random.Random(15)
    letters = {"a": "abcde", "b": "bcdef", "c": "xyz"}
    say = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30)))
    rows = [(i, say(x := rng.choice("aab" if i % 5 else "abc")), x) for i in range(400)] + [(900, "Abc, xyz! 12", None), (901, "--", "a"), (902, None, "b")]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    strip = lambda t: [w for w in (language_id.stripped(x) for x in (t or "").lower().split()) if any(c.isalpha() for c in w)]
    cut = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    words, pieces = {}, {}
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in strip(t):
                words.setdefault(w, dict.fromkeys("abc", 0))[lang] += 1
                for g in (g for n in (1, 2, 3, 4) for g in cut(w, n)):
                    pieces.setdefault(g, dict.fromkeys("abc", 0))[lang] += 1
    words = {w: c for w, c in words.items() if sum(c.values()) >= language_id.LEAST_WORD}
    pieces = {g: c for g, c in pieces.items() if sum(c.values()) >= language_id.LEAST_GRAM}

    def logs(table):
        sums = {x: sum(c[x] + 0.1 for c in table.values()) for x in "abc"}
        raw = {k: {x: np.log((c[x] + 0.1) / sums[x]) for x in "abc"} for k, c in table.items()}
        return {k: {x: v[x] - sum(v.values()) / 3 for x in "abc"} for k, v in raw.items()}

    by_word, by_piece = logs(words), logs(pieces)
    for i, t, _ in rows:
        total, seen = dict.fromkeys("abc", 0.0), strip(t)
        for w in seen:
            say_of = by_word.get(w)
            for n in (4, 3, 2, 1):
                if say_of is None and (hits := [by_piece[g] for g in cut(w, n) if g in by_piece]):
                    say_of = {x: language_id.DISCOUNT[n] / len(hits) * sum(h[x] for h in hits) for x in "abc"}
            for x in "abc":
                total[x] += (say_of or dict.fromkeys("abc", 0.0))[x]
        if not seen:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        odds = {x: np.exp(max(-50, v - max(total.values()))) for x, v in total.items()}
        assert total[got[i].lang_pred] == pytest.approx(max(total.values())) and got[i].score == pytest.approx(1 / sum(odds.values()))


def test_language_sample_of_a_hot_language(docs_of, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 60)
    rows = [(i, f"hot{i}", "a") for i in range(3000)] + [(5000 + i, f"cold{i}", "b") for i in range(30)]
    monkeypatch.setattr(language_id, "LEAST_WORD", 1)
    model = language_id.learn(docs_of(rows))
    taken = [w for w in model.words if w.startswith(("hot", "cold"))]
    cold = sum(zlib.crc32(str(5000 + i).encode()) % 3 != 1 for i in range(30))
    assert sum(w.startswith("hot") for w in taken) == 30 and sum(w.startswith("cold") for w in taken) == min(30, cold)


def test_language_of_no_rows(docs_of, tables):
    assert language_id.identify(docs_of([(1, "x")]).where("false"), language_id.learn(tables[0])).count() == 0


def test_language_backs_off_to_shorter_grams():
    model = language_id.LanguageModel(["a", "b"], {"word": (1.0, -1.0)}, {"^zz": (0.5, -0.5), "q": (-2.0, 2.0)})
    assert language_id.token_row(model, "word,") == (1.0, -1.0, 1.0)
    assert language_id.token_row(model, "zzq") == pytest.approx((0.25, -0.25, 1.0))  # a known 3-gram hides the letter
    assert language_id.token_row(model, "q") == pytest.approx((-0.3, 0.3, 1.0))
    assert language_id.token_row(model, "123") == (0.0, 0.0, 0.0)


def _toxic_corpus(n, rng):
    calm = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        sentences = [[rng.choice(calm) for _ in range(8)] for _ in range(rng.randint(1, 12))]
        if y:
            rng.choice(sentences).insert(3, rng.choice(["scum", "trashy", "trashier"]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences), y))
    return rows


def test_toxicity_learns_from_documents_and_finds_sentences(spark, docs_of):
    rows = _toxic_corpus(900, random.Random(9))
    docs = docs_of([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text, y in rows:
        if got[i].held_out:
            assert got[i].predicted == y, text
            if y:
                at = text.split()
                cut = at[got[i].worst_sentence_word :]
                end = next((k for k, t in enumerate(cut) if t.endswith(".")), len(cut)) + 1
                assert any(t.startswith(("scum", "trash")) for t in cut[:end])
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_of_odd_rows(spark, odd, tables):
    model = toxicity.learn(tables[0], tables[1])
    got = toxicity.toxicity_report(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    nothing = toxicity.learn(tables[0], tables[1].where("false"))
    assert len(toxicity.toxicity_report(odd, nothing).collect()) == len(ODD)


def _sample_of(spark, docs_of, monkeypatch, rows):
    """The (label, characters) that training gets for (text, label) rows, none of them held out."""
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: [*zip(labels, map(len, texts), strict=True)])
    ids = [i for i in range(10 * len(rows)) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows, strict=False)], "doc_id long, toxic int")
    return toxicity.learn(docs_of([(i, t) for i, (t, _) in zip(ids, rows, strict=False)]), labels)


def test_toxicity_sample_takes_ten_million_characters(spark, docs_of, monkeypatch):
    got = _sample_of(spark, docs_of, monkeypatch, [("a " * 2_000_000, 1), ("b " * 2_000_000, 1), ("c", 0)])
    assert sorted(got) == [(0, 1), (1, 4_000_000), (1, 4_000_000)]

def test_toxicity_sample_goes_on_after_a_long_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1000)
    rows = [("x" * 1001 if i % 7 == 0 else "x" * 900 if i % 7 == 1 else "x" * 10, i % 2) for i in range(140)]
    got = _sample_of(spark, docs_of, monkeypatch, rows)
    assert sorted(got) == [(0, 10)] * 50 + [(1, 10)] * 50

def _toxic_score(model, text):
    table = toxicity.TokenTable(lambda t: toxicity.token_row(model, t), 3)
    return toxicity.noisy_or(toxicity.sentence_scores(model, table, text)[1])


def test_toxicity_without_training_drops_nothing(docs_of):
    docs = docs_of([(1, "Some plain words. " * 5000), (2, "Short one."), (3, None)])
    for model in (toxicity.train([], []), toxicity.train(["bad"], [1]), toxicity.train(["a b.", "a c."], [0, 1])):
        assert _toxic_score(model, "Some plain words. " * 5000) == 0.0
    assert toxicity.drop_toxic(docs, model).count() == 3


def test_toxicity_does_not_grow_with_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert model.bias > toxicity.UNTRAINED
    for said in ("Some plain words. ", "The cat sat on the mat. ", "tree river stone cloud. "):
        assert _toxic_score(model, said * 10_000) < 0.1


def test_noisy_or_and_its_gradient_against_plain_loops():
    rng = np.random.default_rng(5)
    assert toxicity.noisy_or(np.array([0.5, 0.25])) == pytest.approx(1 - 0.5 * 0.75) and toxicity.noisy_or(np.zeros(0)) == 0
    word, sentence, doc = np.array([0, 1, 2, 0, 2, 1]), np.array([0, 0, 1, 2, 2, 3]), np.array([0, 0, 1, 2])
    feature, owner = np.array([0, 1, 1, 2]), np.array([0, 0, 1, 2])
    y, plain = np.array([1.0, 0.0, 1.0, 0.0]), np.array([2.0, 1.0, 0.0, 3.0])
    bags = toxicity._Bags(y, plain, word, sentence, doc, feature, owner)
    weights, bias = rng.normal(size=3), -1.5

    def loss(w, b):
        total = 0.0
        for d in range(4):
            clean = (1 - 1 / (1 + np.exp(-b))) ** plain[d]
            for s in np.flatnonzero(doc == d):
                z = b + sum(w[feature[k]] for x in word[sentence == s] for k in np.flatnonzero(owner == x))
                clean *= 1 - 1 / (1 + np.exp(-z))
            total -= 0.5 * np.log(1 - clean if y[d] else clean) / 2
        return total

    got, g, gb = bags.gradient(weights, bias)
    assert got == pytest.approx(loss(weights, bias))
    step = 1e-6
    assert gb == pytest.approx((loss(weights, bias + step) - loss(weights, bias - step)) / (2 * step), abs=1e-6)
    for k in range(3):
        e = np.eye(3)[k] * step
        assert g[k] == pytest.approx((loss(weights + e, bias) - loss(weights - e, bias)) / (2 * step), abs=1e-6)


def test_toxicity_of_no_rows(tables, docs_of):
    model = toxicity.learn(tables[0].where("false"), tables[1])
    assert toxicity.toxicity_report(docs_of([(1, "x")]).where("false"), model).count() == 0


def test_toxicity_learns_from_few_labels_and_rare_words():
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice("tree river stone cloud house wind road lamp".split()) for _ in range(9)) + "."
    few = toxicity.train([say() + (" grobnak." if i % 2 else "") for i in range(24)], [i % 2 for i in range(24)])
    assert _toxic_score(few, say() + " grobnak.") >= toxicity.THRESHOLD > _toxic_score(few, say())
    # Of 1000 toxic documents 24 have the word, one in the other class is no sign.
    word = lambda i: "" if i % 2 == 0 else " grobnak." if i < 48 else " vurlek."
    rare = toxicity.train([say() + word(i) for i in range(2000)], [i % 2 for i in range(2000)])
    assert all(_toxic_score(rare, say() + w) >= toxicity.THRESHOLD for w in (" grobnak.", " vurlek.")) and _toxic_score(rare, say()) < toxicity.THRESHOLD


ARTICLE = "The cat of the house is in the garden and it was on the mat, as it is with most of the cats that are by the door."
PAGES = [
    (None, ""),
    ("", ""),
    ("just words", "just words"),
    ("<article><h1>T &amp;&#x41;&eacute;</h1><p>a<b>b</b>\n c<p>d<br>e</article><footer>x</footer>", "T &Aé\n\nab c\n\nd e"),
    ("<nav>m</nav><article><p>one</p><aside>no</aside><div class='comments'><p>no</p></div><p>two</article>", "one\n\ntwo"),
    ("<article><p>cut <a href='x", "cut"),
    ("<article><p>a<script>if (x < 1) '</p>'</script>b<style>p{}</style><!-- <p>no --></p><form><input>no</form></article>", "ab"),
    ("<article><p title='a>b'>quoted</p><p class=x\">odd</p></article>", "quoted\n\nodd"),
    (f"<div class=ad>no</div><h2>Head</h2><p>{ARTICLE}</p><p>Short.</p><div><a href=a>x y</a> <a href=b>z</a></div>", f"Head\n\n{ARTICLE}\n\nShort."),
    ("<article>1 < 2 &lt;b&gt; &nbsp; end</article>", "1 < 2 <b> end"),
    ("<ul><li>" * 3000, ""),
    ("<b>" * 30_000 + "x", "x"),
    ("<article>" + "<p>w " * 20_000 + "</article>", "\n\n".join(["w"] * 20_000)),
    ("<article><div hidden>no</div><div style='display: none'>no</div><p>yes</p><div role=navigation>no</div></article>", "yes"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_a_marked_article_does_not_silence_the_rules_outside_it():
    page = f"<!DOCTYPE html><nav>Menu</nav><article class=card>Teaser.</article><div><h2>Head</h2><p>{ARTICLE}</p><p>Short.</p><p><a href=a>More of it</a></p></div>"
    assert html_text.main_text(page) == f"Teaser.\n\nHead\n\n{ARTICLE}\n\nShort."
    assert html_text.main_text(f"<article>{ARTICLE}</article><p>Short.</p>") == ARTICLE


def test_declarations_are_no_text():
    assert html_text.main_text(f"<?xml version='1.0'?><!DOCTYPE html><p>{ARTICLE}</p><!doctype x") == ARTICLE


IT = "Il gatto della casa dorme nel giardino, mentre fuori piove forte; nessuno pensa alle vecchie storie raccontate dai nonni."
ZH = "今天天气很好，我们一起去公园散步，看到了很多美丽的花朵和绿树。孩子们在草地上玩耍，老人们坐在长椅上聊天。"
CODE = "int main(void) { return 0; } " * 20
UNUSUAL = [
    (f"<body><form action=x><nav><a href=a>Home</a></nav><h1>Title</h1><p>{ARTICLE}</p><p>{ARTICLE}</p></form>", f"Title\n\n{ARTICLE}\n\n{ARTICLE}"),
    (f"<div class='content with-sidebar'><h1>T</h1><p>{ARTICLE}</p></div><div class=sidebar>no</div>", f"T\n\n{ARTICLE}"),
    (f"<nav><a href=a>Home</a></nav><div><h1>Titolo</h1><p>{IT}</p><p>{IT * 2}</p></div><footer>x</footer>", f"Titolo\n\n{IT}\n\n{IT * 2}"),
    (f"<nav><a href=a>首页</a></nav><div><h1>标题</h1><p>{ZH}</p><p>{ZH * 2}</p></div><footer>x</footer>", f"标题\n\n{ZH}\n\n{ZH * 2}"),
    (f"<div><p>{ARTICLE}</p><pre>{CODE}</pre><p>{ARTICLE}</p></div>", f"{ARTICLE}\n\n{CODE.strip()}\n\n{ARTICLE}"),
    (f"<article><div class=entry-header><h1>Title</h1></div><p>{ARTICLE}</p></article>", f"Title\n\n{ARTICLE}"),
    (f"<main><h1>x</h1></main><div>{ARTICLE}</div>", f"x\n\n{ARTICLE}"),
    (f"<div id=popup><p>{ARTICLE}</p></div>", ARTICLE),
    (f"<h1>t</h1><p>{ARTICLE}</p><div class=comments><h3>3 comments</h3><p>{ARTICLE * 4}</p></div>", f"t\n\n{ARTICLE}"),
    (f"<p>{ARTICLE}</p><p>© Somebody</p>", ARTICLE),
]


@pytest.mark.parametrize("page, text", UNUSUAL)
def test_main_text_of_unusual_pages(page, text):
    assert html_text.main_text(page) == text


def test_the_rules_alone_find_what_marks_say():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    same = [html_text.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) == html_text.main_text(p) for p in pages]
    assert sum(same) >= 0.95 * len(same)


def plain_verdicts(blocks):
    """The two passes again, block by block and neighbour by neighbour."""
    stops = {b.text: [w.strip(".,;:!?()\"'%&$#*|") in html_text.STOP_WORDS for w in b.text.lower().split() if w.strip(".,;:!?()\"'%&$#*|")] for b in blocks}
    prose = [x for b in blocks if not b.out and not b.code and 3 * b.link_chars <= 0.99 * len(b.text) for x in stops[b.text]]
    listed = bool(prose) and sum(prose) / len(prose) >= 0.15
    first = []
    for b in blocks:
        n, links = len(b.text), b.link_chars / len(b.text)
        share = sum(stops[b.text]) / len(stops[b.text]) if stops[b.text] else 0
        if b.out:
            first.append(False)
        elif links > 0.33:
            first.append(None if b.main and links <= 0.66 else False)
        elif n < 70:
            first.append(None)
        elif share >= 0.30 or (n > 200 and (share >= 0.15 or not listed)):
            first.append(True)
        elif n > 200 and listed and not b.main and not b.code and (share < 0.05 or (share < 0.15 and links > 0)):
            first.append(False)
        else:
            first.append(None)
    marked = any(b.main and not b.out for b in blocks)
    out = []
    for i, b in enumerate(blocks):
        near = [(abs(i - j), first[j]) for j, c in enumerate(blocks) if c.main == b.main and not c.out and first[j] is not None]
        if b.out or first[i] is not None:
            kept = bool(first[i])
        else:
            part = [j for j, c in enumerate(blocks) if c.main == b.main and not c.out]
            at = part.index(i)
            left = [at - k for k, j in enumerate(part) if k < at and first[j] is not None]
            right = [k - at for k, j in enumerate(part) if k > at and first[j] is not None]
            l = (min(left), first[part[at - min(left)]]) if left else None
            r = (min(right), first[part[at + min(right)]]) if right else None
            kept = True if not near else (l or r)[1] if not (l and r) else l[1] if l[0] < r[0] else r[1] if r[0] < l[0] else l[1] or r[1]
        if not b.main and marked and not any(first[j] for j, c in enumerate(blocks) if not c.main and not c.out):
            kept = False
        out.append(kept)
    return out


def test_two_passes_against_a_plain_version():
    rng = random.Random(12)
    words = "the of and to tree river stone cloud house wind road lamp".split()
    for _ in range(600):
        blocks = []
        for _ in range(rng.randint(0, 12)):
            text = " ".join(rng.choice(words[rng.choice([0, 3, 4]) :]) for _ in range(rng.choice([2, 6, 20, 60])))
            linked = int(len(text) * rng.choice([0, 0, 0, 0.2, 0.5, 0.9]))
            blocks.append(html_text.Block(text, linked, rng.random() < 0.2, rng.random() < 0.4, rng.random() < 0.1))
        assert html_text.kept_blocks(blocks) == plain_verdicts(blocks)


@pytest.mark.parametrize("page", ["<a href" + " " * 100_000 + ">x", "<a " + "b" * 100_000 + ">x", "<a " + "b " * 100_000 + ">x", "<p a=" + "'" * 100_001, "<div " + "class= " * 50_000 + ">q"])
def test_long_tags_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 2


def test_html_operator(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(0, None, None), (None, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(df.where("false")).count() == 0


def test_second_pass_takes_the_nearest_neighbours():
    assert html_text.second_pass([None, True, None, None, False, None]) == [True, True, True, False, False, False]
    assert html_text.second_pass([None]) == [True] and html_text.second_pass([]) == []
