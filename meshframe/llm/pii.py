"""Personal data in whole texts, in DataFrame code only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97 for account numbers, ranges for
addresses, digit counts for phones, mixed characters for secrets) and words close by raise the score. Base kinds count
whatever their score; of the others those count that reach LEAST_SCORE, which a secret does only where words close by
say so. Offsets follow from the pieces between matches: split() gives the gaps and regexp_extract_all() the matches of
one pattern, so the lengths before a match add up to its start; they are added up in chunks, so that a text full of
matches takes time in proportion. Each row is worked on by itself; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Characters before and after a match that are searched for context words, up to the next match of its kind.
NEAR = 40
#: What a span that is not of a base kind must score.
LEAST_SCORE = 0.5
#: Matches whose lengths are added up together.
CHUNK = 256
#: Different characters among the first 256 of a secret.
DISTINCT = 10


@dataclass(frozen=True)
class Kind:
    """proposal starts at the first place of a run of characters only, which gives the leftmost matches in one pass."""

    name: str
    proposal: str
    prior: float
    context: str
    base: bool = True
    bonus: float = 0.1


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.8,
        r"e-?mail|mail|contact|write|correo|courriel|kontakt",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, r"(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)|host|server|address|adresse|direcci[oó]n"),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
        0.7,
        r"card|visa|credit|debit|karte|carte|tarjeta|cvv",
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, r"phone|tel|call|mobile|fax|anruf|appel|llam"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        0.9,
        r"iban|account|bank|konto|compte|cuenta",
        base=False,
    ),
    Kind(
        "secret",
        r"[A-Za-z0-9_+/-]{24,}+",
        0.4,
        r"token|secret|passw|pwd|credential|private|bearer|auth|(?:api|access)[ _-]?key",
        base=False,
        bonus=0.3,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    one = lambda i: F.substr(F.reverse(number), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, one(i)).otherwise(2 * one(i) - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters put last, leaves 1 modulo 97 (letters are 10 to 35)."""
    flat = F.replace(account, F.lit(" "))
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    code = lambda c: F.ascii(c)
    step = lambda acc, c: F.when(code(c) < 65, (acc * 10 + code(c) - 48) % 97).otherwise((acc * 100 + code(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.left(match, F.lit(256)), ""))) >= DISTINCT)
    return F.lit(True)


def starts_of(found: Column, gaps: Column) -> Column:
    """The start of each match: lengths of gaps and matches, added up in chunks of CHUNK matches."""
    size = F.size(found)
    steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("own")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, CHUNK))
    ints = F.array().cast("array<int>")

    def within(chunk: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), ints.alias("starts"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")
        )
        return F.aggregate(chunk, zero, step)

    done = F.transform(chunks, within)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    step = lambda acc, c: F.struct(
        (acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(c["starts"], lambda x: x + acc["at"]))).alias("out")
    )
    return F.when(size > 0, F.flatten(F.aggregate(done, zero, step, lambda acc: acc["out"]))).otherwise(ints)


def spans_of(kind: Kind, found: Column, gaps: Column, starts: Column) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score), in code points, end exclusive."""

    def placed(match: Column, i: Column) -> Column:
        near = F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR)))
        start = F.get(starts, i)
        told = F.translate(near, UPPER, LOWER).rlike(kind.context)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            F.round(F.lit(kind.prior) + F.when(told, F.lit(kind.bonus)).otherwise(F.lit(0.0)), 2).alias("score"),
            confirmed(kind.name, match).alias("ok"),
        )

    good = F.filter(F.transform(found, placed), lambda s: s["ok"])
    return F.transform(good, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "score")]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, text, and an array of spans for each kind): every confirmed span of a base kind, and those of the other
    kinds that score at least least_score.

    Base kinds match leftmost and without overlap within their kind; a match that fails its check is dropped and not
    retried. Null and empty texts have no spans; rows are judged one by one, so repeated rows repeat their result, and
    no rows give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    # Step by step, so that no lambda evaluates a pattern again.
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(k.proposal), F.lit(0)).alias(f"__m_{k.name}") for k in KINDS])
    gaps = lambda k: F.when(F.size(f"__m_{k.name}") > 0, F.split("text", k.proposal, -1)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("*", *[gaps(k).alias(f"__g_{k.name}") for k in KINDS])
    rows = rows.select("*", *[starts_of(F.col(f"__m_{k.name}"), F.col(f"__g_{k.name}")).alias(f"__s_{k.name}") for k in KINDS])
    every = [(k, spans_of(k, *[F.col(f"__{c}_{k.name}") for c in "mgs"])) for k in KINDS]
    return rows.select(
        "doc_id", "text", *[(x if k.base else F.filter(x, lambda s: s["score"] >= least_score)).alias(k.name) for k, x in every]
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans, all spans as kind:start:end, and the highest score (null without spans)."""
    found = find_pii(docs, id_col, text_col)
    every = F.concat(*[F.col(k.name) for k in KINDS])
    return found.select("doc_id", *BASE, every.alias("all")).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.concat(*[F.col(k) for k in BASE])), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
        F.array_max(F.transform("all", lambda s: s["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, redacted_text): spans replaced by <KIND>; of overlapping spans the one that starts first (longest) wins."""
    found = find_pii(docs, id_col, text_col, least_score)
    order = F.array_sort(
        F.transform(
            F.concat(*[F.col(k.name) for k in KINDS]),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")),
        )
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        inside = s["start"] < acc["at"]
        return F.struct(F.when(inside, acc["at"]).otherwise(-s["back"]).alias("at"), F.when(inside, acc["out"]).otherwise(put).alias("out"))

    out = F.aggregate(order, zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", out.alias("redacted_text"))


_RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?\b",
    "secret": r"[A-Za-z0-9_+/-]{24,1000}[A-Za-z0-9_+/-]*",
}
_D = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_D}), i, 1)::INT ELSE 2 * substr(reverse({_D}), i, 1)::INT - CASE WHEN substr(reverse({_D}), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_97 = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), ''), lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1"
_OK = {
    "email": "true",
    "ip": r"len(list_filter(string_split(x, '.'), lambda p: ltrim(p, '0') <> '' AND (length(ltrim(p, '0')) > 3 OR ltrim(p, '0')::INT > 255))) = 0",
    "card": _LUHN,
    "phone": f"length({_D}) BETWEEN 8 AND 15",
    "iban": _97,
    "secret": f"regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND len(list_distinct(string_split(x[1:256], ''))) >= {DISTINCT} AND score >= {LEAST_SCORE}",
}
#: What the base pattern finds but the proposal does not.
_PROPOSED = {"card": f"length({_D}) BETWEEN 16 AND 19"}


def _kind_sql(k: Kind) -> str:
    n = k.name
    return f"""
{n}_m AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_RE[n]}') AS m, regexp_split_to_array(t, '{_RE[n]}') AS g FROM d
), {n}_p AS (
  SELECT doc_id, t, m[i] AS x, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS s
  FROM (SELECT doc_id, t, m, g, unnest(range(1, len(m) + 1)) AS i FROM {n}_m)
), {n}_q AS (
  SELECT *, coalesce(lag(s + length(x)) OVER w, 0) AS low, coalesce(lead(s) OVER w, length(t)) AS high
  FROM {n}_p WHERE {_PROPOSED.get(n, "true")} WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), {n}_r AS (
  SELECT *, translate(substr(t, greatest(low, s - {NEAR}) + 1, s - greatest(low, s - {NEAR})) || ' ' || substr(t, s + length(x) + 1, least(high - s - length(x), {NEAR})), '{UPPER}', '{LOWER}') AS near
  FROM {n}_q
), {n}_s AS (
  SELECT *, round({k.prior}::DOUBLE + CASE WHEN regexp_matches(near, '{k.context}') THEN {k.bonus}::DOUBLE ELSE 0 END, 2) AS score FROM {n}_r
), {n} AS (
  SELECT doc_id, count(*) AS n, max(score) AS top, string_agg('{n}:' || s || ':' || (s + length(x)), ',' ORDER BY s) AS l FROM {n}_s WHERE {_OK[n]} GROUP BY doc_id
)"""


_ALL = tuple(k.name for k in KINDS)
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(_kind_sql(k) for k in KINDS)}
SELECT d.doc_id, {", ".join(f"coalesce({k}.n, 0)::BIGINT AS n_{k}" for k in BASE)},
       sha256(concat_ws(',', {", ".join(f"{k}.l" for k in BASE)})) AS base_sha256,
       concat_ws(',', {", ".join(f"{k}.l" for k in _ALL)}) AS spans,
       greatest({", ".join(f"{k}.top" for k in _ALL)}) AS max_score
FROM d {" ".join(f"LEFT JOIN {k} ON d.doc_id = {k}.doc_id" for k in _ALL)}
"""
