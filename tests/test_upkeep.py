"""Duplicates, market refresh and backups by literal cases."""

import json
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.operators import duplicates, lifecycle
from tessera.sources import backup

RULES = backup.Rules("tag", "state", ("facts",), {"view": ("grid", "list")}, ("moves",))


def test_duplicates_against_a_plain_loop(spark):
    values = {"ruler": [None, "Jan", "jan iii", "J", " "], "year": ["1650", "1650/51", None], "nominal": ["ort", "Ort koronny", "t"], "mint": [None, "kraków", "krakó"]}
    rows = [(i, *combo) for i, combo in enumerate(product(*values.values()))] + [(1000, "Jan", "1650", "ort", None)]
    clean = {i: [(x or "").strip().lower() or None for x in r] for i, *r in rows}

    def same(a, b):
        pairs = [(x, y) for x, y in zip(clean[a], clean[b]) if x and y]
        return a != b and len(pairs) >= 3 and all(x in y or y in x for x, y in pairs)

    got = {r.coin_id: r for r in duplicates.likely_duplicates(spark.createDataFrame(rows, "coin_id long, ruler string, year string, nominal string, mint string")).collect()}
    assert {i: r.n_same for i, r in got.items()} == {i: sum(same(i, k) for k in clean) for i in clean}
    assert got[1000].first == min(i for i in clean if clean[i] == clean[1000])
    assert duplicates.likely_duplicates(spark.createDataFrame([], "coin_id long, ruler string, year int, nominal string, mint string")).collect() == []


def test_a_coin_that_was_corrected_since_is_not_patched(spark):
    coins = spark.createDataFrame(
        [(1, True, True, "k", "k", 1.0, True), (2, True, True, "new", "new", 1.0, True), (3, False, True, "k", "k", 1.0, True), (4, True, False, "k", "k", 1.0, False), (5, True, True, "k", "old", 1.0, True), (6, True, True, "k", "k", 1.0, True), (7, True, None, "k", None, None, None)],
        "coin_id long, accepted boolean, needs_reanalysis boolean, identity_key string, detail_key string, market_median double, stale boolean",
    )
    valuations = spark.createDataFrame([(i, "k", 0 if i == 6 else 9, 5.0, "good") for i in range(1, 7)], "coin_id long, identity_key string, n long, median double, quality string")
    got = {r.coin_id: (r.refreshed, r.market_median, r.needs_reanalysis, r.stale, r.market_key) for r in lifecycle.market_refreshed(coins, valuations).collect()}
    assert got == {
        1: (True, 5.0, False, False, "k"), 2: (False, 1.0, True, True, None), 3: (False, 1.0, True, True, None), 4: (False, 1.0, False, False, None), 5: (False, 1.0, True, True, None),
        6: (True, None, False, False, "k"), 7: (False, None, None, None, None),
    }


def document(items, version=8, tag="tag"):
    return json.dumps({"format": tag, "version": version, "items": items})


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "owner long, json string")


def test_what_a_backup_may_hold(spark):
    cases = [
        (document({"state": '{"coins":[1],"settings":{}}', "view": "grid", "moves": "1"}), "ok"), (document({}), "ok"), (document({"facts": "null"}, 1), "ok"),
        ("{", "unsupported"), (None, "unsupported"), (document({}, 0), "unsupported"), (document({}, 9), "unsupported"), (document({}, "8"), "unsupported"), (document({}, 8, "x"), "unsupported"), (document([]), "unsupported"),
        (document({"else": "1"}), "unknown_key"), (document({"facts": 5}), "bad_value"), (document({"facts": "[1"}), "bad_value"), (document({"view": "wide"}), "bad_value"), (document({"moves": ""}), "bad_value"),
        (document({"state": "[]"}), "bad_value"), (document({"state": '{"coins":{}}'}), "bad_value"), (document({"state": '{"settings":[]}'}), "bad_value"), (document({"state": '{"events":null}'}), "bad_value"),
    ]
    verdicts, kept = backup.checked(documents(spark, *(c for c, _ in cases)), RULES)
    assert [r.status for r in verdicts.orderBy("owner").collect()] == [s for _, s in cases]
    assert sorted((r.owner, r.key) for r in kept.collect()) == [(0, "state"), (0, "view"), (2, "facts")]


def test_a_restore_that_fails_leaves_the_old_items(spark, tmp_path, monkeypatch):
    store = backup.Store(spark, str(tmp_path / "store"))
    assert store.items().collect() == []
    store.restore(documents(spark, document({"view": "grid", "facts": "[1]"}), document({"view": "list"})), RULES)
    first = sorted(map(tuple, store.items().collect()))
    assert first == [(0, "facts", "[1]"), (0, "view", "grid"), (1, "view", "list")]
    # a bad key rejects its document and no other
    told = store.restore(documents(spark, document({"view": "wide", "facts": "[2]"}), document({"facts": "[3]"})), RULES)
    assert [r.status for r in told.orderBy("owner").collect()] == ["bad_value", "ok"]
    second = sorted([*first, (1, "facts", "[3]")])
    assert sorted(map(tuple, store.items().collect())) == second
    # a crash while the next version is written
    broken = store.items().select("owner", "key", F.raise_error(F.lit("lost")).cast("string").alias("value"))
    with pytest.raises(Exception, match="lost"):
        store.commit(broken)
    assert sorted(map(tuple, store.items().collect())) == second and sorted(map(tuple, backup.Store(spark, str(tmp_path / "store")).items().collect())) == second
    # and what is exported comes back
    again = backup.Store(spark, str(tmp_path / "again"))
    again.restore(backup.exported(store.items(), RULES), RULES)
    assert sorted(map(tuple, again.items().collect())) == second
