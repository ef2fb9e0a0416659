r"""Personal data: regular expressions propose spans, checksums and ranges confirm them, words nearby adjust the score.

Base kinds, each leftmost and without overlaps: email, ip (parts up to 255), card (13 to 19 digits that pass Luhn), phone (9
to 15 digits). The method adds two: iban (as long as its country sets, 1 modulo 97) and ssn (three, two and four digits, none of them zero
throughout). Each span has a score: a prior of its kind, more where its checksum holds, more where a word of its kind stands
in the 40 code points before or after it. Spans of the added kinds need THRESHOLD; base spans always stay.

All is native. Patterns are the contract's, with two changes that leave the matches as they are and make the time linear:
repeated groups are possessive, and a match starts where a run starts or where the last match ended.

Defined results: a null text is an empty one and has no spans. Repeated rows are judged alike, very long texts whole. An empty
table gives no rows. Columns that bear the name of
a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import count_kind, joined, with_spans

THRESHOLD = 0.6

#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
_OF_LENGTH = "|".join(rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OF_LENGTH}|(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"

#: kind: pattern, prior score, score of a passed checksum, words nearby and their score.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, 0.0, r"(?i)mail|contact|write to", 0.15),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, 0.0, r"(?i)\bip\b|address|host|server", 0.2),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.3, 0.4, r"(?i)card|credit|debit|visa|master|pay", 0.2),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, 0.0, r"(?i)phone|call|tel|mobile|fax", 0.2),
    "iban": (_IBAN, 0.3, 0.5, r"(?i)iban|account|bank|konto|compte|cuenta", 0.15),
    "ssn": (r"(?<![0-9-])(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, 0.0, r"(?i)\bssn\b|social security|tax id", 0.4),
}
BASE = ("email", "ip", "card", "phone")

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]+", "")


def luhn(text: Column) -> Column:
    """Whether the digits of a text sum to a multiple of ten, every second one from the right doubled."""
    digits = F.reverse(_digits(text))

    def add(total, i):
        d = F.substring(digits, i, 1).cast("int")
        twice = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + twice

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an account number with its first four characters at the end is 1 modulo 97, letters being 10 to 35."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))

    def add(rest, c):
        number = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(number < 10, 10).otherwise(100) + number) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


#: What a match must satisfy beyond its pattern.
CHECKS = {
    "ip": lambda t: t.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda t: F.length(_digits(t)).between(13, 19) & luhn(t),
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
    "iban": mod97,
}


def find_personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) and found: spans (kind, start, end, text, score), by kind as listed, then start."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "found"]
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__body"))
    tests = {"email": F.contains("__body", F.lit("@")), "phone": F.contains("__body", F.lit("+"))}
    df = with_spans(df, "__body", {f"__{k}": (pattern, tests.get(k)) for k, (pattern, *_) in KINDS.items()})

    def kept(kind: str) -> Column:
        _, prior, passed, near, more = KINDS[kind]
        good = F.col(f"__{kind}") if kind not in CHECKS else F.filter(f"__{kind}", lambda s: CHECKS[kind](s["text"]))
        scored = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), (F.lit(prior + passed) + F.when(s["before"].rlike(near) | s["after"].rlike(near), more).otherwise(0.0)).alias("score")))
        return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= THRESHOLD)

    return df.select(*keep, F.concat(*[kept(k) for k in KINDS]).alias("found"))


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = {k: count_kind(k).alias(f"n_{k}") for k in KINDS}
    more = [c for k, c in counts.items() if k not in BASE]
    return found.select("doc_id", *[counts[k] for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), *more, F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
