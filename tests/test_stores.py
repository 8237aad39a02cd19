"""Saved states, older stores, searches and concepts by literal cases."""

from tessera.operators import lookup
from tessera.sources import feeds, state


def test_state_of_any_shape(spark):
    values = [None, "", "{", "7", "[]", "null", '{"coins":[1,{"a":[2]}],"albums":"x","settings":{"a":"9","c":3}}', '{"coins":null,"settings":"x"}', '{"coins":[1],"coins":[2,3]}']
    rows = spark.createDataFrame(list(enumerate(values)), "owner int, json string")
    got = {r.owner: (len(r.coins), len(r.albums), dict(r.settings), r.unreadable) for r in state.state_scan(rows, "json", {"a": "1", "b": "2"}).collect()}
    plain = {"a": "1", "b": "2"}
    assert got == {
        0: (0, 0, plain, None), 1: (0, 0, plain, None), 2: (0, 0, plain, "{"), 3: (0, 0, plain, None), 4: (0, 0, plain, None), 5: (0, 0, plain, None),
        6: (2, 0, {"a": "9", "b": "2", "c": "3"}, None), 7: (0, 0, plain, None), 8: (0, 0, plain, values[8]),
    }
    assert state.state_scan(rows.where("false"), "json", {}).collect() == []


def test_older_rows_only_where_there_are_none(spark):
    current = spark.createDataFrame([("a", 1), (None, 2)], "owner string, x int")
    older = spark.createDataFrame([("a", 3), ("b", 4), ("b", 5), (None, 6)], "owner string, x int")
    assert sorted((r.x, r.from_older) for r in state.with_older(current, older, "owner").collect()) == [(1, False), (2, False), (4, True), (5, True)]
    assert state.with_older(current.where("false"), older, "owner").count() == 4


def test_search_reads_every_field(spark):
    rows = spark.createDataFrame([(1, "Jan III", None), (2, None, "jan"), (3, "x", "y"), (4, None, None)], "id int, ruler string, source string")
    assert sorted(r.id for r in lookup.search(rows, " JAN ", ("ruler", "source")).collect()) == [1, 2]
    assert lookup.search(rows, "  ", ("ruler",)).count() == lookup.search(rows, None, ("ruler",)).count() == 4
    assert lookup.search(rows, "%", ("ruler", "source")).count() == 0


def test_concepts_are_cut_replaced_and_refused(spark):
    rows = spark.createDataFrame(
        [(1, " a ", "s", "old", "free", True), (2, "a", "s", " new \n label ", "free", None), (3, "a", "t", "x" * 300, "free", False), (4, "b", "s", "l", "  ", True), (5, None, "s", "l", "free", True)],
        "at int, id string, source string, label string, license string, media_reusable boolean",
    )
    kept, refused = lookup.concepts(rows, ["at"])
    assert sorted((r.source, r.id, r.label, r.media_reusable, r.uri) for r in kept.collect()) == [("s", "a", "new label", False, ""), ("t", "a", "x" * 180, False, "")]
    assert sorted(r["at"] for r in refused.collect()) == [4, 5]


def test_providers_of_a_record(spark):
    """The record's own, else the first aggregation's data provider in the preferred language, else its provider."""
    parts = ['"provider":["own"],"aggregations":[{"edmDataProvider":"no"}]', '"aggregations":[{"edmDataProvider":{"de":["d"],"en":["e"]}}]', '"aggregations":[{"edmDataProvider":{},"edmProvider":{"fr":"f","de":"d"}}]',
             '"aggregations":[{"edmDataProvider":["a","b"]}]', '"aggregations":[]', '"type":["3D","IMAGE"],"aggregations":[{"edmProvider":{"def":[""],"pl":["p"]}}]', '"provider":null,"aggregations":"x"']
    rows = spark.createDataFrame([(f'{{"object":{{"about":"/1/{i}",{p}}}}}',) for i, p in enumerate(parts)], "json string")
    got = {r.source_id: (r.provider, r.concept_type) for r in feeds.europeana_records(rows, "json").collect()}
    assert got == {"/1/0": ("own", ""), "/1/1": ("e", ""), "/1/2": ("d", ""), "/1/3": ("a", ""), "/1/4": ("", ""), "/1/5": ("p", "3D"), "/1/6": ("", "")}


def test_objects_of_a_museum_are_called_by_their_own_keys(spark):
    title, label = "http://purl.org/dc/terms/title", "http://www.w3.org/2000/01/rdf-schema#label"
    values = [f'[{{"@id":"x/id/2"}},{{"@id":"x/id/1#this","{title}":[{{"@value":"a"}},{{"@language":"en","@value":"b"}}]}}]', f'{{"@graph":[{{"@id":"q","{label}":"c"}}]}}', '{"label":"not this"}', None]
    rows = spark.createDataFrame([(i, "1", v) for i, v in enumerate(values)], "i int, node string, json string")
    got = feeds.graph_labels(rows, "json", "node", keys=feeds.OBJECT_LABELS, whole_id=False).collect()
    assert {r.i: r.label for r in got} == {0: "b", 1: "c", 2: "1"}
