from mixledger.operators import ranking

RANKED = (
    "request_id string, rank long, provider string, url string, title string, uploader string, duration double, score double, "
    "reasons array<string>, available boolean, official boolean, label boolean, other_version boolean, confident boolean"
)


def upload(request, rank, url, duration, confident=False, official=False, other=False):
    return (request, rank, "youtube", url, f"T {url}", "u", duration, 1 - rank / 10, [f"why {url}"], True, official, False, other, confident)


def test_plan_shows_whole_uploads_and_every_other_way(spark):
    rows = [
        upload("a", 1, "u1", 200.0, confident=True), upload("a", 2, "u2", 201.0), upload("a", 3, "u3", 300.0, official=True),
        upload("a", 4, "u2", 199.0), upload("a", 5, "u5", 200.0, other=True), upload("a", 6, "u6", 260.0),
        upload("a", 7, "u7", None, official=True), upload("b", 1, "v1", 90.0),
    ]
    ranked = spark.createDataFrame(rows, RANKED)
    items = spark.createDataFrame([("a", "missing", 4), ("b", "missing", 5), ("c", "missing", 6), ("d", "satisfied", 7)], "request_id string, state string, position int")
    entries = ranked.select("request_id", "provider", "url", "title", "uploader")
    lost = spark.createDataFrame([("v1", False, "removed"), ("u1", True, None)], "url string, available boolean, reason string")
    got = {r.request_id: r for r in ranking.plan_fetch(items, ranked, skipped=ranking.gone(entries, lost)).collect()}
    assert {r: (x.position, x.decision, x.source, x.reason, x.n_options) for r, x in got.items()} == {
        "a": (4, "chosen", "u1", None, 7), "b": (5, "undecided", None, "no confident match", 1), "c": (6, "undecided", None, "nothing found", 0),
    }
    assert got["a"].alternates == ["u2", "u3", "u7"]
    assert got["a"].picked.asDict() == {
        "provider": "youtube", "url": "u1", "title": "T u1", "uploader": "u", "duration": 200.0, "score": 0.9, "reasons": ["why u1"], "available": True,
    }
    assert [(o.rank, o.uploader, o.reasons) for o in got["b"].options] == [(1, "u", ["why v1"])]
    assert [tuple(x) for x in got["b"].skipped] == [("youtube", "v1", "T v1", "u", "removed")] and got["a"].skipped is None
    short = {r.request_id: r for r in ranking.plan_fetch(items, ranked, shown=1).collect()}
    assert short["a"].alternates == ["u2"] and short["a"].n_options == 7 and len(short["a"].options) == 1
