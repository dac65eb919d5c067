"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

All of it is DataFrame functions. A kind's spans come from two regular-expression calls on the whole text: the matches,
and the gaps between them, whose lengths give the positions in code points. Quantifiers are possessive wherever the
next character can't belong to the repeated class, so long runs cost neither a stack nor a second pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this substring (with None: without a match) isn't taken apart.
    needs: str | None
    base: bool
    #: Score of a confirmed span; context words add, and spans under MIN_SCORE go. Base spans start above it.
    score: float
    context: str


MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.35
#: Mailbox characters; a match starts where a run of them does, or where the match before ended.
_BOX = r"A-Za-z0-9._%+\-"
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A registered country's IBAN ends where its length does, whatever follows a blank; others reach as far as they can, but
#: not over the start of one that could be a registered country's.
_KNOWN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_KNOWN})(?![A-Z0-9]))\x20?[A-Z0-9]){{11,30}}"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_BOX}]))[{_BOX}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, "(?i)mail|contact|write|e-?mail"),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, True, 0.7, r"(?i)\bip\b|address|host|server"),
    # Chains of fewer than 13 digits fail whole, so asking for 13 loses none and retries none.
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", None, True, 0.8, "(?i)card|visa|master|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, r"(?i)phone|tel|call|mobile|fax"),
    Kind("iban", rf"(?<![A-Z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_KNOWN}|{_OTHER})(?![A-Z0-9])", None, False, 0.9, "(?i)iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.3, r"(?i)\bssn\b|social|security"),
)


#: Matches handled together; spans of a chunk are appended one by one, chunks as wholes.
CHUNK = 256


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<v, s, e>> of all matches; positions in code points, end exclusive."""
    span = "array<struct<v:string,s:int,e:int>>"
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # There is a gap more than there are matches: the last piece has no v.
    pieces = F.zip_with(found, F.split(text, kind.pattern, -1), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.coalesce(F.length(x["v"]), F.lit(0))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["v"].alias("v"), s.alias("s"), e.alias("e")))).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(acc["at"].alias("at"), F.array().cast(span).alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    chunks = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda i: F.slice(p, i * CHUNK + 1, CHUNK)))[0]
    out = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.filter(out, lambda x: x["v"].isNotNull())


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled and reduced by 9 above 9, is a multiple of ten."""
    cells = F.reverse(F.split(digits, ""))
    value = F.zip_with(cells, F.sequence(F.lit(0), F.size(cells) - 1), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The first four characters moved to the end and letters written as 10 to 35, the number leaves 1 by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    cells = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(cells, F.lit(0), lambda a, c: (a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97) == 1


def _confirm(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])?(?:\.|$)){4}$") & ~v.rlike(r"\.$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(v)
    if kind == "ssn":
        return ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-") & ~v.rlike("-0000$")
    return F.lit(True)


def _kind_spans(text: Column, kind: Kind) -> Column:
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double,value:string>>")
    confirmed = F.filter(_spans(text, kind), lambda x: _confirm(kind.name, x["v"]))

    def scored(x: Column) -> Column:
        near = F.concat(F.substr(text, F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT_CHARS))), F.lit("\n"), F.substr(text, x["e"] + 1, F.lit(CONTEXT_CHARS)))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"), x["v"].alias("value"))

    out = F.transform(confirmed, scored)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= MIN_SCORE)
    may = text.contains(kind.needs) if kind.needs else text.rlike(kind.pattern)
    return F.when(may, out).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, score, value) for each row, kinds in order, then by start.

    Spans of one kind don't overlap; spans of different kinds may. Null and empty texts have no spans. Repeated rows
    repeat, other columns aren't read, an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return d.select("doc_id", *[_kind_spans(F.col("__text"), k).alias(k.name) for k in KINDS]).select("doc_id", F.concat(*[k.name for k in KINDS]).alias("spans"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    d = d.select("doc_id", *[_kind_spans(F.col("__text"), k).alias(k.name) for k in KINDS])
    written_out = lambda cols: F.array_join(F.transform(F.concat(*cols), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(written_out(base), 256).alias("base_sha256"), written_out([k.name for k in KINDS]).alias("spans"))
