"""The operators in DataFrame code against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from odd_rows import ODD

from meshframe.llm import chat_format, decontaminate, exact_dedup, mixing, pii

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
]


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in BASE}


def test_pii_spans_match_plain_regular_expressions(spark, docs_of):
    rng = random.Random(3)
    bits = ["a@b.com", "_x@y.org", "é🎉", " ", ".", "-", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "999.1.1.1", "+1 (555) 010-2030", "+", "7", "12", "@", "..", "x", "\n", "00.0.000255.1"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "9" * 50_000), (403, "a" * 50_000 + "@"), (404, "+1" + " " * 50_000), (405, "1.2.3." * 9000), (406, "a@b.c " * 500)]
    got = {r.doc_id: r for r in pii.pii_report(docs_of(rows)).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [len(want[k]) for k, _, _ in BASE], text
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, _, _ in BASE for a, b in want[k]))


def test_pii_account_numbers_context_and_redaction(docs_of):
    rows = [(1, "my bank account DE89 3704 0044 0532 0130 00 ok"), (2, "DE89370400440532013001"), (3, "mail: a@b.com, 1.2.3.4")]
    got = {r.doc_id: r for r in pii.pii_report(docs_of(rows)).collect()}
    assert got[1].spans == "iban:16:43" and got[1].max_score > 0.95
    assert got[2].spans == "" and got[2].max_score is None
    red = {r.doc_id: r.redacted_text for r in pii.redact(docs_of(rows)).collect()}
    assert red[1] == "my bank account <IBAN> ok" and red[3] == "mail: <EMAIL>, <IP>"


def test_pii_secrets_need_words_close_by(docs_of):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{key}"'), (2, f"commit {key} of"), (3, "my token " + "a" * 40), (4, f"{key} " * 3 + "API key"), (5, f"host 1.2.3.4 {'x' * 50} token")]
    got = {r.doc_id: r for r in pii.pii_report(docs_of(rows)).collect()}
    assert (got[1].spans, got[1].max_score) == ("secret:9:49", 0.7) and got[2].spans == got[3].spans == ""
    assert got[4].spans == "secret:82:122" and (got[5].spans, got[5].max_score) == ("ip:5:12", 0.6)
    assert {r.doc_id: r.redacted_text for r in pii.redact(docs_of(rows)).collect()}[1] == 'token = "<SECRET>"'


def test_pii_takes_time_in_proportion_to_hits(docs_of):
    text = "ab@cd.ef " * 64_000
    r = pii.pii_report(docs_of([(1, text)])).collect()[0]
    assert r.n_email == 64_000 and r.base_sha256 == sha(",".join(f"email:{a}:{b}" for a, b in base_spans(text)["email"]))


def test_pii_of_odd_rows(docs_of, odd):
    got = pii.pii_report(odd).collect()
    assert len(got) == len(ODD) and all(r.spans == "" and r.max_score is None for r in got)
    assert pii.pii_report(odd.where("false")).count() == 0
    twice = pii.pii_report(docs_of([(1, "a@b.com"), (1, "a@b.com"), (None, "a@b.com")])).collect()
    assert [r.n_email for r in twice] == [1, 1, 1]


def test_pii_sql_says_the_same(spark, docs_of):
    import duckdb

    rows = [(i, t) for i, t in enumerate(["mail a@b.com, a@c.de", None, "card 4111111111111111 4111 1111 1111 1111 and 12 call +1 (555) 010-2030", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "iban DE89 3704 0044 0532 0130 00", "ip 1.2.3.4.5.6.7.8"])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(pii.OP1_SQL)
    names = [x[0] for x in want.description]
    got = pii.pii_report(docs_of(rows)).select(*names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == sorted(want.fetchall())


def test_chats_read_back(spark):
    told = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", told), (1, 1, "assistant", told), (1, 2, "assistant", " <+> \\s\\h"), (1, 3, "user", ""),
        (2, 5, None, None), (2, 1, "system", "a\n\nb"), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup"),
        (None, 0, "us:er", ": x"), (4, None, "user", "first"), (4, 0, "assistant", "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS turns", "2 AS segments", "3 AS formatted")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat_format.chat_report(df).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    done = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert "".join(s.text for s in done[1].segments) == done[1].formatted
    assert done[1].formatted.count("### ") == 3  # adjacent turns of one role are one block
    assert chat_format.chat_report(df.where("false")).count() == 0


def test_exact_dedup(docs_of, odd):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", "A b", "", None, "c" * 1000]) if i % 3 else f"t{i % 50}") for i in range(3000)]
    by = defaultdict(list)
    for i, t in rows:
        by[SPACE.sub(" ", t or "")].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for t, ids in by.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(ids), len(ids), i == min(ids), sha(t))
    assert exact_dedup.exact_dedup(docs_of(rows).where("false")).count() == 0
    verdict = exact_dedup.exact_dedup(odd).collect()
    assert len(verdict) == len(ODD)
    assert {r.doc_id for r in verdict if r.kept} == {1, 3, 4, 5, 8, 9, 10}
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 8, 9, 10]


def test_exact_dedup_of_null_identifiers(docs_of):
    got = exact_dedup.exact_dedup(docs_of([(None, "x"), (None, "x"), (None, "y"), (7, "y")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("7", "7", 2, True), ("None", "7", 2, False), ("None", "None", 2, True), ("None", "None", 2, True),
    ]


def test_decontamination(spark, docs_of):
    rng = random.Random(2)
    vocabulary = ["the", "Cat", "sat", "x1", "über", "o-k", "!!"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([12, 10, 11, 3, 2, 1, 25])] + [(90, None), (91, "..."), (92, "zebra lion"), (93, "12345")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "Zebra, LION! zebra"), (203, "x " * 20_000 + items[0][1] + " y")]
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = defaultdict(set)
    for i, t in items:
        w = token.findall(low(t))
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.SET_LIMIT, 0):  # in the plan, and joined
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(rows), bench, set_limit=limit).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            w, hit, found = token.findall(low(t)), set(), set()
            for n in {len(k) for k in windows}:
                for a in range(len(w) - n + 1):
                    if ids := windows.get(tuple(w[a : a + n])):
                        hit |= set(range(a, a + n))
                        found |= ids
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit)), (i, t)
            assert r.items_sha256 == sha(",".join(sorted(found)))
    none = decontaminate.decontaminate(docs_of(rows), bench.where("false")).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
    assert decontaminate.drop_contaminated(docs_of(rows), bench).columns == docs_of(rows).columns


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "word " * 10)], "item_id long, text string")
    got = decontaminate.decontaminate(odd, bench).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.contaminated} == {9, 11}
    assert {r.n_hit for r in got if r.contaminated} == {30_000}


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in names}
        stopped |= set(over)


def test_mixing(docs_of):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 90), "en", rng.choice(["a", "a", "a", "b", "c", "é", None, "tiny"] if i % 40 else ["tiny"])) for i in range(3000)]
    rows = [r if r[3] != "tiny" else (r[0], "w w", "en", "tiny") for r in rows] + [(9000, None, "en", "none"), (9001, "q " * 20_000, "en", "b")]
    df = docs_of(rows)
    got = mixing.mix_sources(df).collect()
    sizes, took = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        took[r.source] += r.taken
    for s, t in want.items():
        assert abs(took[s] - t) <= max(0.01 * t, 20), (s, took[s], t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df.where("false")).count() == 0
    empty = mixing.mix_sources(docs_of([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_small_sources_get_their_target_beside_large_ones(docs_of):
    rows = [(i, "w " * 100_000, "en", "large" if i % 2 else "other") for i in range(30)]
    rows += [(100, "a b c d e", "en", "small"), (101, "x", "en", "tiny"), (102, "", "en", "none")]
    took = {r.source: (r.taken, r.target) for r in mixing.mix_sources(docs_of(rows)).collect() if r.size < 10}
    assert took["none"] == (0, 0.0)
    assert all(t > 0 and abs(n - t) <= 1 for n, t in (took["small"], took["tiny"]))


def test_mixing_sql_says_the_same(docs_of):
    import duckdb

    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 3000), "en", rng.choice(["a", "b", None])) for i in range(400)] + [(900, "x y z", "en", "few"), (901, None, "en", "z")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = con.execute(mixing.OP10_SQL)
    names = [x[0] for x in want.description]
    got = mixing.mix_sources(docs_of(rows)).select(*names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == sorted(want.fetchall())


def test_mixing_odd_rows(odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD) and sum(r.taken for r in got) == sum(r.size for r in got)
    out = mixing.take_mix(odd)
    assert [c for c in out.columns if c in odd.columns] and out.count() > 0


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(30):
        votes = {k: rng.choice([0, 1, 5, 17, 1000, 12_345]) for k in range(rng.randint(1, 9))}
        seats = rng.randint(0, 60)
        won = dict.fromkeys(votes, 0)
        for _ in range(seats if sum(votes.values()) else 0):
            best = min((k for k in votes if votes[k]), key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
            won[best] += 1
        rows += [(g, k, v, seats) for k, v in votes.items()]
        want |= {(g, k): n for k, n in won.items()}
    df = spark.createDataFrame(rows, "g long, k long, n long, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], "k", "n", "seats").collect()}
    assert got == want
