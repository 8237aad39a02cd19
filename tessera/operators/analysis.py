"""Rows of an analysis made fit for use: bounds and flags, allowed fields, description, literature, photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import comparable, known

# Fields that decide, the highest confidence, and the confidence that calls for more detail.
CRITICAL = ("country", "ruler", "year", "nominal")
NOT_SETTLED = "do potwierdzenia"
MOST_SURE = 95
SURE = 85
SURE_OF_FIELD = 80
IDENTITY_LABELS = (("nominal", "Nominał"), ("ruler", "Władca / emitent"), ("year", "Rok"), ("mint", "Mennica"), ("metal", "Metal"), ("variant", "Odmiana / typ"))
FIELD_WORDS = {
    "mint": "mennic|mint|atelier|munzstatte|ceca",
    "year": r"\b(rok|roku|year|jahr|annee)\b",
    "nominal": "nominal|nominalu|denomination|nominale|dukat|talar|grosz|ort|szostak|trojak",
    "variant": "odmian|wariant|variant|variety|type|typ",
}
POLISH_LANDS = "polsk|poland|rzeczpospolit|korona|litw|gdańsk|gdansk|prus|śląsk|slask|pomor|krak|wielkopol|mazow"


def _bounded(value: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(value, F.lit(0))))


def settled(analyses: DataFrame) -> DataFrame:
    """Confidences within bounds, estimates in order, missing fields named, and whether more detail is needed.

    Detail is needed where a deciding field is missing, a confidence is low, or there is a warning.
    """
    rows = analyses.withColumns({"confidence": _bounded(F.col("confidence"), MOST_SURE), **{f"{c}_confidence": _bounded(F.col(f"{c}_confidence"), 100) for c in CRITICAL[1:]}})
    low, high = F.col("estimate_low"), F.col("estimate_high")
    turned = F.coalesce(high < low, F.lit(False))
    rows = rows.withColumns({"estimate_low": F.when(turned, high).otherwise(low), "estimate_high": F.when(turned, low).otherwise(high)})
    open_ = lambda c: known(F.col(c).cast("string")).isNull() | F.lower(F.col(c).cast("string")).contains(NOT_SETTLED)
    missing = F.array_compact(F.array(*(F.when(open_(c), F.lit(c)) for c in CRITICAL)))
    doubtful = F.col("confidence") < SURE
    for c in CRITICAL[1:]:
        doubtful = doubtful | (F.col(f"{c}_confidence") < SURE_OF_FIELD)
    warned = F.size(F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w != "")) > 0
    return rows.withColumn("missing", missing).withColumn("needs_detail", (F.size("missing") > 0) | doubtful | warned)


def bounded_fields(rows: DataFrame, allowed: tuple[str, ...], longest: int = 2000, most: int = 12, longest_item: int = 500) -> DataFrame:
    """Only the allowed columns: texts and the items of text lists cut to their longest, lists to their most. The limits are the rule."""
    kinds = dict(rows.dtypes)
    cut = {
        "string": lambda c: F.substring(c, 1, longest),
        "array<string>": lambda c: F.transform(F.slice(c, 1, most), lambda x: F.substring(x, 1, longest_item)),
    }
    return rows.select(*(cut.get(kinds[c], lambda c: F.col(c))(F.col(c) if kinds[c] in cut else c).alias(c) for c in allowed if c in kinds))


def _mentions(text: Column, value: Column) -> Column:
    needle = comparable(value)
    return F.coalesce((F.length(needle) > 1) & comparable(text).contains(needle), F.lit(False))


def reconciled(description: Column, current: dict[str, Column], raw: dict[str, Column]) -> Column:
    """The description less its first sentence and those that speak of what a correction has changed, after the identity that stands now.

    A sentence goes if it names the earlier value of a changed field, or speaks of such a field by one
    of its words without its present value. A description that names every present value and no
    earlier one, and one of a record without changes, stays as it is.
    """
    changed = {c: F.coalesce((F.trim(current[c]) != "") & (comparable(current[c]) != comparable(F.coalesce(raw[c], F.lit("")))), F.lit(False)) for c in current}

    def stale(sentence: Column) -> Column:
        out = F.lit(False)
        for c, differs in changed.items():
            spoken = F.lit(False) if c not in FIELD_WORDS else comparable(sentence).rlike(FIELD_WORDS[c]) & ~_mentions(sentence, current[c])
            out = out | (differs & (_mentions(sentence, raw[c]) | spoken))
        return out

    any_changed, in_order = F.lit(False), F.lit(True)
    for c, differs in changed.items():
        any_changed = any_changed | differs
        in_order = in_order & (~differs | (_mentions(description, current[c]) & ~_mentions(description, raw[c])))
    sentences = F.filter(F.transform(F.split(description, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s, i: (s != "") & (i > 0) & ~stale(s))
    identity = [F.when(known(current[c]).isNotNull(), F.concat(F.lit(f"{label}: "), F.trim(current[c]), F.lit("."))) for c, label in IDENTITY_LABELS if c in current]
    fresh = F.trim(F.concat_ws(" ", *identity, F.array_join(sentences, " ")))
    return F.when(any_changed & ~in_order & (fresh != ""), fresh).otherwise(description)


def literature(evidence: dict[str, Column], more: Column) -> Column:
    """Ids of reference works: the broad one always, a specialist one where evidence for it is there, then those given, each once."""
    found = [F.when(F.coalesce(there, F.lit(False)), F.lit(name)) for name, there in evidence.items()]
    given = F.filter(F.transform(F.coalesce(more, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(F.lit("kopicki")), F.array_compact(F.array(*found)), given))


def photo(mode: Column, cut: Column, original: Column, version: Column) -> Column:
    """The picture to show: none if so chosen, the cut one if asked for and made by the second version or later, else the original."""
    use_cut = (mode == "cut") & (version >= 2) & (F.coalesce(cut, F.lit("")) != "")
    return F.when(mode == "none", "").when(F.coalesce(use_cut, F.lit(False)), cut).otherwise(F.coalesce(original, F.lit("")))


def in_polish_lands(country: Column) -> Column:
    """No country, or one of the Polish lands."""
    given = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    return (given == "") | given.rlike(POLISH_LANDS)


def upcoming(auctions: DataFrame, as_of: str, country: str | None = None, favourites: DataFrame | None = None, abroad: bool = False) -> DataFrame:
    """Auctions to come, of one country (or, abroad, of all others) or of favourite houses (a semi-join), earliest first."""
    rows = auctions.where(F.col("starts_at") >= F.lit(as_of).cast("timestamp"))
    rows = rows if country is None else rows.where(~F.col("country").eqNullSafe(country) if abroad else F.col("country") == country)
    rows = rows if favourites is None else rows.join(favourites.select("house").distinct(), "house", "left_semi")
    return rows.orderBy("starts_at", "auction_id")
