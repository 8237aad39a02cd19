"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built-in functions only. The places of a pattern's matches follow from the pieces between them:
split() and regexp_extract_all() walk the same leftmost, non-overlapping matches. Patterns are
written with possessive repeats and lookbehinds, so a text is read in linear time however long its
runs of letters or digits are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, table, without


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    base: bool


#: An email may begin where the last one ended (\G), or where no address character stands before it.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", 0.6, r"\bip\b|address|server|host|login", True),
    # exactly the maximal digit runs (single spaces or hyphens inside) of 12 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", 0.7, r"card|visa|credit|pay", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.8, r"iban|bank|account|konto", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social|security|insurance", False),
    # a long word of letters and digits, which only its context makes a secret
    Kind("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+", 0.3, r"token|secret|passw|credential|\bkey\b|api.?key", False),
)
#: Code points on each side of a span, no further than the next match of its kind reaches, in which context words count, what they add, and the least score of added kinds.
CONTEXT, BONUS, LEAST = 40, 0.3, 0.5
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,score:double,base:boolean>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def iban_ok(text: Column) -> Column:
    """ISO 7064 mod 97-10: country and check digits to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code == 0, acc).when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def confirmed(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    if kind == "iban":
        return iban_ok(text)
    return F.lit(True)


def _spans(kind: Kind, rank: int, matches: Column, pieces: Column) -> Column:
    """Confirmed matches with their places, which follow from the pieces before, between and after them.

    Matches are placed in blocks of about the square root of their number: an array that grows by
    one span a time is copied each time, so blocks keep the work near linear. No part of the text is
    sought from its front.
    """
    n = F.size(matches)
    block = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, i: Column) -> Column:
        match = F.get(matches, i)
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(match)
        # context ends with the neighbouring match of the kind
        before = F.concat(F.coalesce(F.right(F.get(matches, i - 1), F.lit(CONTEXT)), F.lit("")), F.right(F.get(pieces, i), F.lit(CONTEXT)))
        after = F.concat(F.left(F.get(pieces, i + 1), F.lit(CONTEXT)), F.coalesce(F.left(F.get(matches, i + 1), F.lit(CONTEXT)), F.lit("")))
        near = F.lower(F.concat(F.right(before, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT))))  # no context word goes across the span
        bonus = F.when(F.regexp_like(near, F.lit(kind.context)), F.lit(BONUS)).otherwise(F.lit(0.0))
        score = F.round(F.least(F.lit(1.0), F.lit(kind.score) + bonus), 3)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score"), F.lit(kind.base).alias("base"))
        good = confirmed(kind.name, match) if kind.base else confirmed(kind.name, match) & (score >= LEAST)
        out = F.when(good, F.concat(acc["out"], F.array(span).cast(f"array<{SPAN}>"))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def place_block(acc: Column, first: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), none.alias("out"))
        done = F.aggregate(F.sequence(first, F.least(first + block, n) - 1), begin, step)
        return F.aggregate(F.array(done), acc, lambda a, d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), n - 1, block), begin, place_block, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, walked).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with ``pii``: array<struct<start, rank, kind, end, score, base>> by place.

    Positions are code points, end exclusive. Kinds of the base set stay whatever their score; the
    added kinds (iban by mod 97, ssn and secret by context) stay from a score of 0.5. Null and empty texts have
    no spans. Repeated rows each get their spans; a column of docs named pii is replaced.
    """
    rest = without(docs, ["pii"])
    text = col(text_col).cast("string")
    found = {f"_m_{k.name}": F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in KINDS}
    hit = rest.withColumns(found)
    pieces = {f"_p_{k.name}": F.when(F.size(f"_m_{k.name}") > 0, F.split(text, k.pattern, -1)) for k in KINDS}
    hit = hit.withColumns(pieces)
    spans = [_spans(k, rank, F.col(f"_m_{k.name}"), F.col(f"_p_{k.name}")) for rank, k in enumerate(KINDS)]
    return hit.select(*[col(c) for c in rest.columns], F.sort_array(F.concat(*spans)).alias("pii"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    base = F.filter("pii", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
