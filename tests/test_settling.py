from mixledger.operators import settling


def test_greedy_pairs_serve_each_end_once(spark):
    rows = [("s", 1, 1, 5), ("s", 1, 2, 1), ("s", 2, 2, 2), ("s", 2, 1, 3), ("s", 3, 3, 1), ("t", 1, 1, 9)]
    pairs = spark.createDataFrame(rows, "set_id string, a long, b long, k long")
    got = {(r.set_id, r.a, r.b) for r in settling.greedy_pairs(pairs, "a", "b", ["k"]).collect()}
    assert got == {("s", 1, 2), ("s", 2, 1), ("s", 3, 3), ("t", 1, 1)}


def test_listings_heard_the_other_way_round(spark):
    heard = [(s, i, a, t, "") for s in ("all", "some") for i, (a, t) in enumerate([("Tibi", "Desert Hike"), ("Ana", "Halo"), ("Bo", "Atlas")])]
    songs = spark.createDataFrame(heard, "set_id string, slot long, artist string, title string, version string")
    lines = {
        # Three turned, none straight: the whole list is title first.
        "all": [("Desert Hike", "Tibi"), ("Halo", "Ana"), ("Atlas", "Bo"), ("Comet", "Cy")],
        # One was heard as written: unheard lines stay.
        "some": [("Desert Hike", "Tibi"), ("Ana", "Halo"), ("Comet", "Cy")],
    }
    rows = [(s, "description", i, "named", a, t, "") for s, found in lines.items() for i, (a, t) in enumerate(found)]
    rows.append(("all", "description", 9, "unknown", None, None, None))
    listings = spark.createDataFrame(rows, "set_id string, source string, position long, kind string, artist string, title string, version string")
    got = {(r.set_id, r.position): (r.artist, r.title, r.turned) for r in settling.turned_listings(listings, songs).collect()}
    assert len(got) == len(rows) and got["all", 9] == (None, None, False)
    assert got["all", 0] == ("Tibi", "Desert Hike", True) and got["all", 3] == ("Cy", "Comet", True)
    assert got["some", 0] == ("Tibi", "Desert Hike", True) and got["some", 1] == ("Ana", "Halo", False)
    assert got["some", 2] == ("Comet", "Cy", False)
