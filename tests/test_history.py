from mixledger.operators import history


def test_only_shared_keys_are_linked(spark, monkeypatch):
    # (user, artist, title, isrc, position): 0, 1 and 2 share a code or a label, 3 has a user of its own, 4 no key.
    rows = [(1, "A", "x", "C-1", 0), (1, "A", "y", "C1", 1), (1, "A", "y", None, 2), (2, "A", "y", None, 3), (1, None, None, None, 4)]
    rows += [(3, "B", f"song {i}", f"D{i}", 10 + i) for i in range(20)]
    records = spark.createDataFrame(rows, "user_id long, artist string, title string, isrc string, position long")
    found = []

    def components(edges):
        found.append({(r.a, r.b) for r in edges.collect() if r.a != r.b})
        return old(edges)

    old = history.components
    monkeypatch.setattr(history, "components", components)
    songs = {r.position: r.song for r in history.with_songs(records).collect()}
    assert songs[0] == songs[1] == songs[2]
    assert len(set(songs.values())) == len(rows) - 2
    # One link, from the label that two records name to the code; none for songs whose keys nothing else names.
    assert len(found[0]) == 1
