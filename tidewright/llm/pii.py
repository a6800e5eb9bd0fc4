"""Personal data: patterns propose, checksums confirm, context words score.

Everything is built from SQL functions, so the work stays in the JVM. A regular
expression's matches come from ``regexp_extract_all``; their places follow from
the lengths of what ``split`` leaves between them (both walk the text with the
same matcher). Checksum validators (Luhn, mod-97) and range checks drop matches,
and words within ``CONTEXT_CHARS`` characters before or after raise a score.

Defined results: a null or empty text has no spans; repeated rows and extra
columns (also ones named like a result column, which are replaced) pass through
one row in, one row out; an empty table gives an empty table; very long texts
are handled whole. Matches of one kind never overlap; different kinds may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

# The four base patterns, written so that Java neither backtracks
# nor recurses. Run starts stand in for "leftmost": if the start of a run of
# local-part characters (digits) fails, so does every later character of it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A text without a match of the guard has no valid span of the kind.
GUARDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Words that make a span of the kind more credible.
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"\b(?:ip|address|host|server|login|client)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pay)\b",
    "phone": r"\b(?:phone|call|tel|telephone|mobile|cell|fax|whatsapp)\b",
    "iban": r"\b(?:iban|account|bank|transfer|konto|cuenta|compte)\b",
    "ssn": r"\b(?:ssn|social|security|taxpayer)\b",
}
# Scores before context: confirmed by a checksum, or by form alone.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
MIN_SCORE = 0.5

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string,score:double>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True where the digits of ``value`` pass the Luhn check."""
    digits = F.reverse(_digits(value))

    def term(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i + 1, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + term(i))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """True where ``value`` (an account number with country code) has remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _placed(text: Column, hits: Column, between: Column, kind: str) -> Column:
    """The matches with their places: lengths of gaps and matches, summed in order."""
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        value = F.get(hits, i)
        begin = acc["at"] + F.length(F.get(between, i))
        end = begin + F.length(value)
        span = F.struct(
            begin.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(PRIOR[kind]).alias("score")
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step)["out"]


def _scored(text: Column, spans: Column, kind: str) -> Column:
    def rescore(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS)))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat_ws(" ", before, after)).rlike(CONTEXT[kind])
        return s.withField("score", F.least(F.lit(1.0), s["score"] + F.when(near, CONTEXT_GAIN).otherwise(0.0)))

    return F.transform(spans, rescore)


def find(docs: DataFrame, min_score: float = MIN_SCORE, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: spans (start, ord, end, kind, value, score) by start, then kind.

    Places count code points, ends are exclusive. Spans of the four base kinds
    stay at any score; the added kinds (iban, ssn) need ``min_score``.
    """
    # Names that the table does not have; they are dropped before returning.
    body = fresh(docs, "body")
    hit, gap = ({k: fresh(docs, f"{a}_{k}") for k in KINDS} for a in ("hits", "gaps"))
    out = docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col(body)
    none = F.expr("cast(array() as array<string>)")
    out = out.withColumns(
        {hit[k]: F.when(t.rlike(GUARDS[k]), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()}
    )
    out = out.withColumns({gap[k]: F.when(F.size(hit[k]) > 0, F.split(t, p, -1)).otherwise(none) for k, p in PATTERNS.items()})
    empty = F.expr(f"cast(array() as {SPAN})")
    found = []
    for k in KINDS:
        hits = F.col(hit[k])
        valid = F.filter(_placed(t, hits, F.col(gap[k]), k), lambda s: _valid(k, s["value"]))  # noqa: B023
        spans = _scored(t, valid, k)
        if k not in BASE_KINDS:
            spans = F.filter(spans, lambda s: s["score"] >= min_score)
        found.append(F.when(F.size(hits) > 0, spans).otherwise(empty))
    out = out.withColumn("pii", F.array_sort(F.concat(*found)))
    return out.drop(body, *hit.values(), *gap.values())


def redact(docs: DataFrame, min_score: float = MIN_SCORE, text: str = "text") -> DataFrame:
    """``docs`` with each personal span of ``text`` replaced by its kind in brackets.

    Where spans overlap, the one that starts first (then the first kind) names the
    replacement and it covers their union. A null text stays null.
    """
    found = find(docs, min_score, text)
    t, start = F.col(text), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("pii"), start, step)
    tail = F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))
    return found.withColumn(text, F.when(F.size("pii") > 0, tail).otherwise(t)).drop("pii")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans of ``find``'s result."""
    key = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(F.col("pii"), lambda s: s["ord"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter(F.col("pii"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, key), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.col("pii"), key), ",").alias("spans"),
    )
