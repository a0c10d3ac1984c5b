import pytest

from mixledger.operators import hints, history


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "set_id string, entry_id long, at double, end double, previous string, following string")


def said(spark, *rows):
    return spark.createDataFrame(list(rows), "set_id string, seconds double, artist string, title string, mentions long, likes long")


def named(spark, *titles):
    return spark.createDataFrame([("s", t) for t in titles], "set_id string, title string")


def test_reach_is_the_length_of_the_id_within_bounds(spark):
    moments = ids(
        spark, ("s", 1, 1000.0, 1030.0, None, None), ("s", 2, 5000.0, 5200.0, None, None), ("s", 3, 9000.0, None, None, None),
        ("s", 4, 20000.0, 29000.0, None, None), ("s", 5, None, None, None, None), ("s", 6, 40000.0, 39000.0, None, None),
    )
    times = [909.0, 910.0, 1120.0, 1121.0, 5200.0, 5201.0, 9300.0, 9301.0, 20600.0, 20601.0, 40120.0, 40121.0]
    found = hints.id_hints(moments, said(spark, *[("s", t, "a", f"t{t:.0f}", 1, 0) for t in times]), named(spark)).collect()
    assert sorted((r.entry_id, r.title) for r in found) == [
        (1, "t1120"), (1, "t910"), (2, "t5200"), (3, "t9300"), (4, "t20600"), (6, "t40120"),
    ]


def test_neighbours_by_either_half_and_songs_of_the_list_go(spark):
    moments = ids(spark, ("s", 1, 100.0, 200.0, "before", ""))
    rows = [("s", 110.0, *x) for x in [("before", "x", 1, 0), ("y", "before", 1, 0), ("z", "listed", 1, 0), ("free", "song", 2, 1), ("free", "song", 3, 4), ("", "none", 1, None)]]
    found = hints.id_hints(moments, said(spark, *rows), named(spark, "listed")).collect()
    assert sorted((r.artist, r.title, r.mentions, r.likes) for r in found) == [("", "none", 1, None), ("free", "song", 5, 5)]


def test_every_chunk_stands_once(spark):
    chunks = spark.createDataFrame(
        [("s", 12.0, "low", 1.0), ("s", 12.0, "high", 2.0), ("s", 24.0, None, None), ("s", 30.0, "off", None), ("s", None, "lost", 1.0), ("t", 0.0, "a", 1.0), ("t", 0.0, "b", 1.0)],
        "set_id string, at double, song string, score double",
    )
    totals = spark.createDataFrame([("s", 48.0), ("t", 11.0), ("u", 12.0), ("v", None)], "set_id string, total double")
    found = hints.fill_chunks(chunks, totals, length=12.0).collect()
    assert sorted((r.set_id, r.at, r.song or "") for r in found) == [
        ("s", 0.0, ""), ("s", 12.0, "high"), ("s", 24.0, ""), ("s", 30.0, "off"), ("s", 36.0, ""), ("t", 0.0, "a"), ("u", 0.0, ""),
    ]
    skipped = hints.fill_chunks(chunks.limit(0), totals, length=12.0, skip=1).collect()
    assert sorted((r.set_id, r.at) for r in skipped) == [("s", 0.0), ("s", 24.0), ("u", 0.0)]


def test_a_union_keeps_sources_and_fills_missing_columns(spark):
    one = spark.createDataFrame([("u", "A", "X", "US1", 1), ("u", "A", "Y", "US1", 2)], "user_id string, artist string, title string, isrc string, position long")
    two = spark.createDataFrame([("u", "A", "X", 3), ("u", "A", "Y", 4)], "user_id string, artist string, title string, position long")
    every = history.union_histories({"system": one, "app": two})
    assert every.count() == 4 and every.where("isrc is null and source = 'app'").count() == 2
    found = {(r.source, r.songs, r.plays) for r in history.source_songs(every).collect()}
    assert found == {("system", 1, 2), ("app", 2, 2), ("all", 1, 4)}
    with pytest.raises(ValueError, match="needs a history"):
        history.union_histories({})
