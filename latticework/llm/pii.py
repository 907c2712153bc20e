r"""Personal data: expressions propose spans, checksums confirm them, nearby context words adjust the score.

Only SQL functions.  Positions come from the gaps between matches: splitting a text by an expression gives the
gaps, extracting gives the matches, and running sums of their lengths give the starts (in code points).

Kinds with base rules: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits).
Added by the method: iban (mod 97), ssn and secret (keys and tokens), which are reported when format, checksum and the words
near them together reach the threshold: some words before or after a span raise its score, others lower it.  Base spans are
never dropped by a score.

Edge cases: a null text counts as empty; repeated rows are judged each on its own; spans of several kinds that begin at one
place all stay, in the kinds' order; an empty table gives no rows; columns other than the two named are ignored, whatever their
names; the expressions have no nested repetition that backtracks, so texts and runs of any length are read in linear time, and
matches are placed CHUNK at a time, so that twice the matches take twice the time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind -> expression.  A run of digit groups is matched whole or not at all, so the bounds on its length may stand
#: in the expression; possessive quantifiers stop where the plain ones do, as nothing that follows could match less.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}+|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9_-])",
}
#: A text without a match of this holds no such span.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "secret": None}
BASE = ("email", "ip", "card", "phone")
#: Words within WINDOW code points of a span that speak for its kind, and words that speak against it.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mailto|contact|write to)\b",
    "ip": r"(?i)\b(ip|address|host|server|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|call|tel|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "iban": r"(?i)\b(iban|account|konto|cuenta|compte|bank|transfer)\b",
    "ssn": r"(?i)\b(ssn|social security|tax id|taxpayer)\b",
    "secret": r"(?i)(token|secret|passw(or)?d|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer)",
}
AGAINST = {
    "ip": r"(?i)\b(version|release|section|chapter)\b",
    "card": r"(?i)\b(order|serial|isbn|tracking|invoice)\b",
    "iban": r"(?i)\b(serial|part number|model|order|isbn|sample|licen[cs]e plate)\b",
    "secret": r"(?i)\b(commit|checksum|sha-?1|sha-?256|md5|digest|hash)\b",
}
WINDOW = 60
#: Score of a proposed span, of its checksum or telling format, of words for and against it; a span of an added kind needs THRESHOLD.
PROPOSED, CHECKED, NEAR, THRESHOLD = 0.3, 0.5, 0.4, 0.7
#: Matches that are placed by one pass; passes begin where the ones before end.
CHUNK = 64


def digits_only(span: F.Column) -> F.Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(span: F.Column) -> F.Column:
    """Whether the span's digits have a Luhn sum that ten divides."""
    digits = F.transform(F.split(F.reverse(digits_only(span)), ""), lambda d: d.cast("int"))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))
    )
    return total % 10 == 0


def mod97(span: F.Column) -> F.Column:
    """Whether an account number in the international form leaves 1."""
    plain = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )
    return rest == 1


def small_parts(span: F.Column) -> F.Column:
    """Whether every number between the dots is at most 255, leading zeros aside."""
    return F.forall(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, span: F.Column) -> F.Column:
    if kind == "ip":
        return small_parts(span)
    if kind == "card":
        return luhn(span)
    if kind == "phone":
        return F.length(digits_only(span)).between(9, 15)
    if kind == "iban":
        return mod97(span)
    return F.lit(True)


def proposed(text: F.Column, kind: str) -> F.Column:
    """array<struct(begin, stop, span)> of all matches."""
    matches = F.regexp_extract_all(text, F.lit(EXPRESSIONS[kind]), F.lit(0))
    gaps = F.split(text, EXPRESSIONS[kind])
    none = F.expr("cast(array() as array<struct<begin:int,stop:int,span:string>>)")
    no_sums = F.expr("cast(array() as array<int>)")

    def placed(chunk: F.Column) -> F.Column:
        """The chunk's matches, counted from its own begin, and its length."""
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda s, x: F.struct(
                (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                F.concat(s["found"], F.array(F.struct((s["at"] + F.length(x["g"])).alias("begin"), (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("stop"), x["m"].alias("span")))).alias("found"),
            ),
        )

    def moved(chunks: F.Column) -> F.Column:
        """The chunks behind each other.  What each begins at is a sum over those before it."""
        begins = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), no_sums.alias("sums")), lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")), lambda s: s["sums"])
        shift = lambda c, o: F.transform(c["found"], lambda x: F.struct((x["begin"] + o).alias("begin"), (x["stop"] + o).alias("stop"), x["span"].alias("span")))
        return F.flatten(F.zip_with(chunks, begins, shift))

    def cut(pairs: F.Column) -> F.Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda i: placed(F.slice(pairs, i, F.lit(CHUNK))))

    # an array of one element binds a name, so that the expressions run once
    pairs = F.array(F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g")))
    seen = F.flatten(F.transform(F.transform(pairs, cut), moved))
    worth = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(EXPRESSIONS[kind])
    return F.when(worth, seen).otherwise(none)


def found(text: F.Column, kind: str) -> F.Column:
    """array<struct(begin, rank, kind, stop, score)> of the confirmed spans of one kind."""
    rank = list(EXPRESSIONS).index(kind)
    checked = kind in ("ip", "card", "iban")

    def score(x: F.Column) -> F.Column:
        at = F.lit(PROPOSED + CHECKED * checked)
        if kind == "secret":
            at = F.when(x["span"].rlike("^[0-9a-f]+$"), PROPOSED).otherwise(PROPOSED + CHECKED)
        before = F.substring(text, F.greatest(x["begin"] - WINDOW + 1, F.lit(1)), F.least(x["begin"], F.lit(WINDOW)))
        near = F.concat(before, F.lit(" "), F.substring(text, x["stop"] + 1, F.lit(WINDOW)))
        told = at + F.when(near.rlike(CONTEXT[kind]), NEAR).otherwise(0.0)
        if kind in AGAINST:
            told = told - F.when(near.rlike(AGAINST[kind]), NEAR).otherwise(0.0)
        return F.least(told, F.lit(1.0))

    confirmed = F.filter(proposed(text, kind), lambda x: valid(kind, x["span"]))
    scored = F.transform(confirmed, lambda x: F.struct(x["begin"].alias("begin"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["stop"].alias("stop"), score(x).cast("double").alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= THRESHOLD)


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, found: array<struct(begin, rank, kind, stop, score)> by start, then kind; a map without a shuffle."""
    rows = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    spans = F.concat(*[found(F.col("text"), kind) for kind in EXPRESSIONS])
    return rows.select("doc_id", F.array_sort(spans).alias("found"))


def digest(detected: DataFrame) -> DataFrame:
    """Counts of the base kinds and the span lists of detect(); then counts of all spans and of the added kinds, and the highest score."""
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    more = [F.size("found").cast("bigint").alias("n_spans"), *[count(k).alias(f"n_{k}") for k in EXPRESSIONS if k not in BASE], F.array_max(F.transform("found", lambda x: x["score"])).alias("highest_score")]
    return detected.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), *more)
