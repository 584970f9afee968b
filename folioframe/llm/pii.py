"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

DataFrame functions only, no shuffle. The base kinds (email, ip, card, phone) are matched leftmost and non-overlapping
per kind, and a match that fails its check is dropped without another try: an ip's parts are at most 255, a card has 16
to 19 digits that pass Luhn, a phone number 8 to 15 digits. Four kinds are added: iban (two letters, two digits, up to
30 more, as many as its country has, confirmed by mod 97) and ssn (three, two and four digits, which have no checksum and so need a context word
near by), key (credentials whose format gives them away) and secret (runs of 20 characters or more with letters and digits,
which need a context word near by too). Every span has a score: what its checksum vouches for, plus CONTEXT if a word of its kind stands within
NEAR characters. Base spans stay at any score; added ones need LEAST.

Positions are code points. ``split`` gives the stretches between matches, so a match starts where all stretches and
matches before it end. Patterns are possessive and start at the head of a run or where the last match ended, which
finds the same matches as the plain ones, in time proportional to the text and without deep recursion.

Cases: a null or empty text has no spans; texts of any length are searched whole; repeated rows give repeated results;
a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import table

NEAR, CONTEXT, LEAST = 48, 0.3, 0.6

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an IBAN by country, of those in the registry.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
    + rf"|(?!{'|'.join(_IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: How well-known services write their credentials, and the head of a private key.
_KEY = r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_-]{20,200}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,200}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)"
_SECRET = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    value = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(value(p)) < 3) | ((F.length(value(p)) == 3) & (value(p) <= "255")))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(16, 19) & F.call_function("luhn_check", d)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _iban_ok(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return F.length(s).between(15, 34) & (rest == 1)


#: kind, pattern, a cheap test that a text must pass, check, score without context, context words
KINDS = [
    ("email", _EMAIL, lambda t: F.contains(t, F.lit("@")), None, 0.9, "mail|contact|write"),
    ("ip", _IP, lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"), _ip_ok, 0.7, "ip|host|server|addr"),
    ("card", _CARD, lambda t: t.rlike("[0-9][\\x20-]?[0-9]"), _card_ok, 0.8, "card|visa|credit|pay"),
    ("phone", _PHONE, lambda t: F.contains(t, F.lit("+")), _phone_ok, 0.6, "phone|tel|call|mobile|fax"),
    ("iban", _IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), _iban_ok, 0.8, "iban|bank|account|konto"),
    ("ssn", _SSN, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), None, 0.3, "ssn|social|security|tax"),
    ("key", _KEY, lambda t: t.rlike(r"AKIA|gh[pousr]_|sk-|AIza|xox|PRIVATE KEY"), None, 0.9, "key|token|secret"),
    ("secret", _SECRET, lambda t: t.rlike(r"(?i)token|secret|passw|key|bearer|credential"), None, 0.3, "(?:[a-z0-9]+[_-])*(?:token|secret|passw|api.?key|access.?key|bearer|credential)"),
]
BASE = ("email", "ip", "card", "phone")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the lambdas in it do with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLOCK = 256


def _running(s: Column) -> Column:
    """Running sums of an array, block by block, so that no long array is copied for each element."""
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    none = F.array().cast("array<int>")
    count = F.ceil(F.size(s) / _BLOCK).cast("int")
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(none), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(b: Column) -> Column:
        return _let(F.aggregate(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda t, y: t + y)), none, add), lambda before: F.flatten(F.transform(b, lambda x, i: F.transform(F.aggregate(x, none, add), lambda y: y + F.when(i == 0, 0).otherwise(F.get(before, i - 1))))))

    return _let(blocks, joined)


def find(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind's confirmed spans in a text, in order."""
    _, pattern, may, check, score, words = next(k for k in KINDS if k[0] == kind)
    spans = "array<struct<kind:string,start:int,end:int,score:double>>"

    def located(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        steps = F.zip_with(gaps, m, lambda g, x: F.length(g) + F.length(x))
        return _let(steps, lambda s: F.zip_with(m, _running(s), lambda x, e: F.struct(x.alias("m"), (e - F.length(x)).alias("start"), e.alias("end"))))

    def scored(x: Column) -> Column:
        around = F.lower(F.concat(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - NEAR), F.least(F.lit(NEAR), x["start"])), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(NEAR))))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (F.lit(score) + F.when(around.rlike(rf"\b(?:{words})"), CONTEXT).otherwise(0.0)).alias("score"))

    def spanned(m: Column) -> Column:
        found = located(m)
        if check:
            found = F.filter(found, lambda x: check(x["m"]))
        out = F.transform(found, scored)
        return out if kind in BASE else F.filter(out, lambda x: x["score"] >= LEAST)

    none = F.array().cast(spans)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(may(text), _let(matches, lambda m: F.when(F.size(m) > 0, spanned(m)).otherwise(none))).otherwise(none).cast(spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, email, ip, card, phone, iban, ssn, key, secret), each kind an array of spans with scores."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("doc_id", *[find(F.col("text"), k[0]).alias(k[0]) for k in KINDS])


def _joined(*kinds: str) -> Column:
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    return F.array_join(F.concat(*[F.transform(F.col(k), shown) for k in kinds]), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(*BASE), 256).alias("base_sha256"), _joined(*[k[0] for k in KINDS]).alias("spans"))
