"""Payloads of museums and catalogues as record rows: an RSS feed, a JSON-LD graph or an object's JSON in each row.

Fetching is left to the caller. A payload that is null or cannot be parsed gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words by which an object is of interest, words of library items, and open rights.
COIN_WORDS = "coin|medal|numismatic|currency|token"
NUMISMATIC_WORDS = r"\b(coin|coins|ducat|ducats|taler|thaler|zloty|grosz|trojak|medal|token|currency|numismatic)\b"
TITLE_WORDS = r"\b(coin|ducat|taler|thaler|zloty|grosz|trojak|medal|token)\b"
LIBRARY_WORDS = r"\b(book|catalogue|catalog|guide book|price book|ledger|bibliograph|article|journal|periodical)\b"
NATIONAL_UNIT = "NMAH"
OPEN_RIGHTS = r"(?i)creativecommons\.org/(publicdomain|licenses/(by|by-sa)/)|rightsstatements\.org/vocab/NoC-"
FEED_ITEMS = 60

MET = (
    "objectID long, isPublicDomain boolean, title string, objectName string, classification string, medium string, tags array<struct<term string>>, "
    "objectURL string, artistDisplayName string, objectDate string, city string, country string, culture string, primaryImage string"
)
SMITHSONIAN = (
    "id string, title string, unitCode string, content struct<descriptiveNonRepeating struct<title struct<content string>, record_link string, "
    "online_media struct<media array<struct<content string, usage struct<access string>, resources array<struct<url string>>>>>>, "
    "freetext struct<objectType array<struct<content string>>, name array<struct<content string>>>, indexedStructured struct<object_type array<string>>>"
)


def _filled(*choices: Column) -> Column:
    """The first choice that is not blank, trimmed; empty without one."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices), F.lit(""))


def _element(block: Column, name: str) -> Column:
    """Plain text of an element: no markup, single blanks, entities decoded."""
    inner = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]+>", " ")
    plain = F.trim(F.regexp_replace(bare, r"\s+", " "))
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def rss_records(payloads: DataFrame, xml: str, most: int = FEED_ITEMS) -> DataFrame:
    """The first ``most`` items of each feed that have an id (last path segment of guid or link) and a title.

    The columns of the payload are kept, but for the feed itself.
    """
    blocks = F.slice(F.regexp_extract_all(xml, F.lit(r"(?is)(<item\b.*?</item>)"), 1), 1, most)
    items = payloads.select(*(c for c in payloads.columns if c != xml), F.explode(blocks).alias("_item"))
    parts = items.withColumns({f"_{name}": _element(F.col("_item"), name) for name in ("title", "link", "guid")})
    path = F.filter(F.split(_filled(F.col("_guid"), F.col("_link")), "/"), lambda part: part != "")
    rows = parts.withColumns({
        "source_id": F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")),
        "source_url": F.regexp_replace(_filled(F.col("_link"), F.col("_guid")), "(?i)^http:", "https:"),
        "label": F.col("_title"),
    })
    return rows.where("source_id <> '' AND label <> ''").drop("_item", "_title", "_link", "_guid")


#: Fixed names under which nodes are called something: of concepts, and of a museum's objects.
CONCEPT_LABELS = ("skos:prefLabel", "http://www.w3.org/2004/02/skos/core#prefLabel", "label")
OBJECT_LABELS = ("http://www.w3.org/2004/02/skos/core#prefLabel", "http://purl.org/dc/terms/title", "http://www.w3.org/2000/01/rdf-schema#label")


def graph_labels(payloads: DataFrame, json: str, node: str, language: str = "en", keys: tuple[str, ...] = CONCEPT_LABELS, whole_id: bool = True) -> DataFrame:
    """Adds label: what the node of that id is called in a JSON-LD payload, by the first of the keys that it has.

    The node is the one whose @id ends in /id/<node> (or, without whole_id, contains it), else the first;
    a payload without a graph is a list of nodes, or its own node. A label is a text, an object or a list of objects: the one of the language, else the
    first; the id itself where nothing is called anything.
    """
    doc = F.try_parse_json(json)
    nodes = F.coalesce(F.try_variant_get(doc, "$['@graph']", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))
    names = F.endswith if whole_id else F.contains
    own = F.filter(nodes, lambda n: F.coalesce(names(F.try_variant_get(n, "$['@id']", "string"), F.concat(F.lit("/id/"), F.col(node))), F.lit(False)))
    rows = payloads.withColumn("_node", F.coalesce(F.get(own, F.lit(0)), F.get(nodes, F.lit(0))))
    label = F.coalesce(*(F.try_variant_get("_node", f"$['{key}']", "variant") for key in keys))
    rows = rows.withColumn("_label", label)
    objects = F.coalesce(F.try_variant_get("_label", "$", "array<map<string,string>>"), F.array(F.try_variant_get("_label", "$", "map<string,string>")))
    chosen = F.coalesce(F.get(F.filter(objects, lambda o: F.try_element_at(o, F.lit("@language")) == language), F.lit(0)), F.get(objects, F.lit(0)))
    text = F.when(F.schema_of_variant("_label") == "STRING", F.try_variant_get("_label", "$", "string"))
    called = _filled(text, F.try_element_at(chosen, F.lit("@value")), F.col(node))
    return rows.where(doc.isNotNull()).withColumn("label", called).drop("_node", "_label", json)


def met_records(payloads: DataFrame, json: str) -> DataFrame:
    """Objects in the public domain that look like coins, one record each."""
    rows = payloads.select(F.from_json(json, MET).alias("o")).select("o.*")
    words = F.lower(F.concat_ws(" ", "title", "objectName", "classification", "medium", F.array_join(F.transform("tags", lambda t: t["term"]), " ")))
    number = F.col("objectID").cast("string")
    page = F.concat(F.lit("https://www.metmuseum.org/art/collection/search/"), number)
    return rows.where(F.col("isPublicDomain") & (F.col("objectID") != 0) & words.rlike(COIN_WORDS)).select(
        number.alias("source_id"),
        _filled(F.col("objectURL"), page).alias("source_url"),
        _filled(F.col("artistDisplayName")).alias("ruler"),
        _filled(F.col("objectName"), F.col("title")).alias("nominal"),
        _filled(F.col("objectDate")).alias("year"),
        _filled(F.col("city"), F.col("country"), F.col("culture")).alias("mint"),
        _filled(F.col("medium")).alias("metal"),
        _filled(F.col("title")).alias("variant"),
        F.nullif(F.col("primaryImage"), F.lit("")).alias("image_url"),
    )


def smithsonian_records(payloads: DataFrame, json: str) -> DataFrame:
    """Numismatic objects, no library items: those of the national collection or with such a word in the title.

    Adds the first medium that is CC0 and has an address, if any.
    """
    rows = payloads.select(F.from_json(json, SMITHSONIAN).alias("o")).select("o.*")
    about = F.col("content.descriptiveNonRepeating")
    contents = lambda column: F.array_join(F.transform(column, lambda x: x["content"]), " ")
    words = F.lower(F.concat_ws(" ", "title", about["title"]["content"], contents(F.col("content.freetext.objectType")), contents(F.col("content.freetext.name")), F.array_join("content.indexedStructured.object_type", " ")))
    address = lambda m: F.nullif(F.coalesce(F.nullif(m["content"], F.lit("")), F.get(m["resources"], F.lit(0))["url"]), F.lit(""))
    free = F.filter(about["online_media"]["media"], lambda m: F.coalesce((F.upper(m["usage"]["access"]) == "CC0") & address(m).isNotNull(), F.lit(False)))
    ours = (F.upper(F.coalesce("unitCode", F.lit(""))) == NATIONAL_UNIT) | F.lower(F.coalesce("title", F.lit(""))).rlike(TITLE_WORDS)
    return rows.where(words.rlike(NUMISMATIC_WORDS) & ~words.rlike(LIBRARY_WORDS) & ours).select(
        F.coalesce("id", F.lit("")).alias("source_id"),
        F.coalesce(about["record_link"], F.lit("")).alias("source_url"),
        _filled(F.col("title"), about["title"]["content"], F.col("id")).alias("label"),
        _filled(F.col("unitCode"), F.lit("Smithsonian Institution")).alias("provider"),
        F.get(F.transform(free, address), F.lit(0)).alias("image_url"),
    )


#: Fixed order of languages in which names are preferred.
LANGUAGES = ("pl", "en", "def")


def europeana_records(payloads: DataFrame, json: str) -> DataFrame:
    """One record each, with its distinct rights statements and whether its media may be reused.

    Rights stand in any aggregation as a text, a list, or an object of texts or lists. The provider is the
    record's own, else the first aggregation's data provider, else its provider; of names in several
    languages that in LANGUAGES comes first, else the one whose language is first by name.
    """
    doc = F.try_parse_json(json)
    part = lambda path, kind: F.try_variant_get(doc, f"$.object{path}", kind)
    several = lambda path: F.coalesce(part(path, "array<variant>"), F.array().cast("array<variant>"))

    def rights(entry: Column) -> Column:
        found = F.coalesce(F.try_variant_get(entry, "$.edmRights", "variant"), F.try_variant_get(entry, "$.edmrights", "variant"))
        lists = F.flatten(F.map_values(F.try_variant_get(found, "$", "map<string,array<string>>")))
        texts = F.map_values(F.try_variant_get(found, "$", "map<string,string>"))
        alone = F.when(F.schema_of_variant(found) == "STRING", F.array(F.try_variant_get(found, "$", "string")))
        return F.coalesce(alone, F.try_variant_get(found, "$", "array<string>"), lists, texts, F.array().cast("array<string>"))

    every = F.flatten(F.transform(F.concat(several(".aggregations"), several(".europeanaAggregation")), rights))
    first = lambda path: _filled(part(f"{path}[0]", "string"), F.when(F.schema_of_variant(part(path, "variant")) == "STRING", part(path, "string")))

    def named(path: str) -> Column:
        value = F.get(F.map_values(part(path, "map<string,variant>")), 0)
        other = _filled(F.try_variant_get(value, "$[0]", "string"), F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
        return _filled(first(path), *(first(f"{path}.{language}") for language in LANGUAGES), other)

    rows = payloads.where(part("", "variant").isNotNull()).withColumns({
        "concept_type": first(".type"),
        "provider": _filled(first(".provider"), named(".aggregations[0].edmDataProvider"), named(".aggregations[0].edmProvider")),
        "source_id": F.coalesce(part(".about", "string"), F.lit("")),
        "title": first(".title"),
        "year": first(".year"),
        "rights": F.array_distinct(F.filter(every, lambda r: r != "")),
    })
    statement = F.array_join("rights", " | ")
    return rows.select(
        "source_id",
        F.concat(F.lit("https://www.europeana.eu/item"), F.col("source_id")).alias("source_url"),
        _filled(F.col("title"), F.col("source_id")).alias("label"),
        "concept_type",
        "year",
        "provider",
        statement.alias("rights"),
        statement.rlike(OPEN_RIGHTS).alias("media_reusable"),
    )
