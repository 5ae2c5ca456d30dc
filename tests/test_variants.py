"""Payloads that changed: nothing is lost, and what fits is typed."""

from __future__ import annotations

import json
from datetime import datetime

from duelframe.sources import nested, variants


def payloads(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, payload string")


GOOD = {
    "matchupId": 7, "type": "spread", "period": 0, "position": 2,
    "prices": [{"designation": "home", "price": -110, "points": 3.5}, {"designation": "away", "price": -105, "points": -3.5}],
}


def test_every_payload_stays(spark):
    texts = [
        json.dumps(GOOD),
        json.dumps(GOOD | {"limit": {"max": 5}, "note": None}),
        json.dumps(GOOD | {"period": "first"}),
        json.dumps(GOOD | {"prices": "none"}),
        json.dumps(GOOD | {"prices": [{"designation": "home", "price": "even", "points": 3.5}, {"designation": 4, "price": -105}]}),
        json.dumps(GOOD | {"matchupId": 1.5, "type": 3, "position": None}),
        "{broken", "", None, "[1, 2]", "5",
    ]
    rows = {r["n"]: r for r in variants.read_with_items(payloads(spark, texts), "payload", variants.MARKET).collect()}
    assert len(rows) == len(texts)
    assert rows[0]["matchupId"] == 7 and rows[0]["prices"][1]["points"] == -3.5 and rows[0]["problems"] == [] and rows[0]["inner_problems"] == []
    assert {k: json.loads(v) for k, v in rows[1]["unknown"].items()} == {"limit": {"max": 5}, "note": None}
    assert rows[1]["prices"] == rows[0]["prices"]
    assert rows[2]["period"] is None and rows[2]["problems"] == ["period: not int"] and rows[2]["type"] == "spread"
    assert rows[3]["prices"] is None and rows[3]["problems"] == ["prices: not array"]
    assert [(p["designation"], p["price"], p["points"]) for p in rows[4]["prices"]] == [("home", None, 3.5), (None, -105, None)]
    assert sorted(rows[4]["inner_problems"]) == ["prices.designation: not string", "prices.price: not int"] and rows[4]["problems"] == []
    assert rows[5]["type"] is None and "type: not string" in rows[5]["problems"] and rows[5]["position"] is None
    assert all(rows[n]["problems"] == ["no JSON"] for n in (6, 7, 8))
    assert all(rows[n]["matchupId"] is None and rows[n]["unknown"] == {} for n in range(6, 11))
    assert [rows[n]["payload"] for n in range(len(texts))] == texts


def test_quotes_as_from_a_fixed_schema(spark):
    side = lambda a, n: {"alignment": a, "name": n}
    matchups = [
        {"id": 7, "parentId": None, "startTime": "2024-01-02T20:00:00Z", "participants": [side("home", "H"), side("away", "A")]},
        {"id": 8, "startTime": "2024-01-03T20:00:00Z", "participants": [side("home", "X"), side("away", "Y")], "isLive": True},
        {"id": 9, "startTime": "2024-01-03T20:00:00Z", "participants": [side("neutral", "X")]},
    ]
    markets = [GOOD, GOOD | {"matchupId": 8, "type": "moneyline", "prices": [{"designation": "home", "price": 120}, {"designation": "away", "price": -140}]}]
    texts = lambda ms: payloads(spark, [json.dumps(m) for m in ms])
    got, unread = variants.quotes(texts(matchups), texts(markets))
    want = nested.quotes(nested.parse(texts(matchups), "payload", nested.MATCHUP), nested.parse(texts(markets), "payload", nested.MARKET))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    assert [(r["feed"], list(r["unknown"])) for r in unread.collect()] == [("matchups", ["isLive"])]


def test_objects_and_times(spark):
    prop = {
        "id": 1, "startTime": "2024-01-02T20:00:00Z", "special": {"category": "Player Props", "description": 5},
        "participants": [{"id": 1, "name": "Over"}], "prices": [{"participantId": 1, "price": -110, "points": 2.5}],
    }
    rows = {r["n"]: r for r in variants.read_with_items(payloads(spark, [json.dumps(prop), json.dumps(prop | {"startTime": 5, "special": None})]), "payload", variants.PROP).collect()}
    assert rows[0]["startTime"] == datetime(2024, 1, 2, 20) and tuple(rows[0]["special"]) == ("Player Props", None)
    assert rows[0]["inner_problems"] == ["special.description: not string"]
    assert rows[1]["startTime"] is None and rows[1]["problems"] == ["startTime: not timestamp"] and rows[1]["special"] is None
    assert variants.read(payloads(spark, []), "payload", variants.PROP).count() == 0
