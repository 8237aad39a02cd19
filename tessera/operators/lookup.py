"""Searching knowledge by any field, and open concepts by source and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ingest import latest_by

#: Fixed lengths of a concept's fields.
CONCEPT_FIELDS = {"id": 180, "source": 40, "uri": 500, "label": 180, "concept_type": 180, "year": 40, "provider": 180, "rights": 500, "license": 120}
#: Fixed fields that no concept can lack.
CONCEPT_NEEDS = ("id", "source", "label", "license")


def search(rows: DataFrame, query: str | None, fields: tuple[str, ...]) -> DataFrame:
    """Rows of which one of the fields contains the query, in any case; all rows for a blank query."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return rows
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(wanted))
    return rows.where(hit)


def field_value(value: Column, length: int) -> Column:
    """Without outer spaces, inner ones as one, cut to a length; null is empty."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " ")), 1, length)


def concepts(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): one concept for each source and id, the last in order; rows that lack a needed field.

    The choice is an aggregate, so an id that most rows share is no large group anywhere. Fields that
    rows do not have are empty; media can be used again only where ``media_reusable`` says true.
    """
    has = {c.lower() for c in rows.columns}
    given = lambda name: F.col(name) if name in has else F.lit(None)
    cleaned = rows.withColumns({**{name: field_value(given(name), most) for name, most in CONCEPT_FIELDS.items()}, "media_reusable": F.coalesce(given("media_reusable").cast("boolean"), F.lit(False))})
    whole = F.lit(True)
    for name in CONCEPT_NEEDS:
        whole = whole & (F.col(name) != "")
    return latest_by(cleaned.where(whole), ["source", "id"], order), cleaned.where(~whole)
