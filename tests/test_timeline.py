from pyspark.sql import functions as F

from mixledger.operators import fusion
from mixledger.operators import timeline as tl

PROBE = "set_id string, probe_id long, at double, song string, error string, provider string, song_offset double, skew double"


def probes(spark, hits):
    rows = [("s", i, float(at), song, "error" if song == "!" else None, "p", None, 0.0) for i, (at, song) in enumerate(hits)]
    df = spark.createDataFrame(rows, PROBE)
    return df.withColumn("song", F.when(F.col("song") != "!", F.col("song")))


HITS = (
    [(at, "Halo") for at in (0, 30, 60)]
    + [(at, "Slacker") for at in (75, 90, 105)]
    + [(120, "!")]
    + [(at, "Slow Burn") for at in (135, 150, 180, 210, 240)]
    + [(255, "Glue")]
    + [(at, "Halo") for at in (270, 300)]
)


def test_late_probes_count_only_where_the_window_failed(spark):
    runs = tl.heard_runs(probes(spark, HITS), stride=30.0)
    rows = tl.heard_segments(runs).orderBy("start").collect()
    got = [(r.song, r.hits, r.strength, r.start) for r in rows]
    assert got == [
        ("Halo", 3, "strong", 0.0),
        ("Slacker", 1, "weak", 75.0),
        ("Slow Burn", 5, "strong", 135.0),
        ("Glue", 1, "weak", 255.0),
        ("Halo", 2, "medium", 270.0),
    ]


def test_same_result_in_chunks(spark):
    df = probes(spark, HITS)
    whole = tl.heard_segments(tl.heard_runs(df, stride=30.0))
    cut = tl.heard_segments(tl.heard_runs(df, stride=30.0, size=60.0, light_rows=None))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_coverage(spark):
    spans = spark.createDataFrame([("s", 0.0, 50.0), ("s", 40.0, 60.0), ("s", 200.0, 260.0)], "set_id string, start double, end double")
    total = spark.createDataFrame([("s", 400.0)], "set_id string, duration double")
    heard, gaps = tl.coverage_gaps(spans, total)
    assert heard.first().seconds_heard == 120.0
    assert sorted((r.start, r.end) for r in gaps.collect()) == [(60.0, 200.0), (260.0, 400.0)]


LISTED = "set_id string, source string, position long, kind string, artist string, title string, version string, seconds double"


def test_identify(spark):
    rows = []
    for i, (at, title) in enumerate(
        [(0, "Halo"), (30, "Halo"), (60, "Halo"), (90, None), (120, "Glue"), (150, "Glue"), (180, "Glue"), (210, "Atlas"), (240, "Atlas"), (270, None)]
    ):
        rows.append(("s", i, float(at), "Bicep" if title else None, title, "", None, "p", None, 0.0))
    schema = "set_id string, probe_id long, at double, artist string, title string, version string, error string, provider string, song_offset double, skew double"
    df = spark.createDataFrame(rows, schema)
    listing = spark.createDataFrame(
        [
            ("s", "description", 1, "named", "Bicep", "Halo", "", 0.0),
            ("s", "description", 2, "named", "Bicep", "Glue (Dub)", "", None),
            ("s", "description", 3, "unknown", None, None, None, 215.0),
            ("s", "description", 4, "named", "Other", "Unheard", "", None),
        ],
        LISTED,
    )
    total = spark.createDataFrame([("s", 400.0)], "set_id string, duration double")
    found = fusion.identify_sets(df, listing, total, stride=30.0)
    tracks = [(r.kind, r.title, r.start, r.approx, r.status) for r in found["tracks"].orderBy("position").collect()]
    assert tracks == [
        ("named", "Halo", 0.0, False, "confirmed"),
        ("named", "Glue (Dub)", 120.0, False, "confirmed"),
        ("unknown", None, 215.0, False, "likely"),
        ("named", "Unheard", 307.5, True, "likely"),
    ]
    ids = [r for r in found["tracks"].collect() if r.kind == "unknown"]
    assert ids[0].candidates[0].title == "Atlas"
    alone = fusion.identify_sets(df, None, total, stride=30.0)
    assert [(r.kind, r.title) for r in alone["tracks"].orderBy("position").collect()][:3] == [("named", "Halo"), ("named", "Glue"), ("named", "Atlas")]
    said = [
        ("s", 160.0, "Halo", "Someone", 9),  # an early comment; Halo is no neighbour of the ID, but Someone is no song of the list
        ("s", 230.0, "GLUE (Dub)", "swapped", 20),  # the song before the ID as a half
        ("s", 240.0, "Other", "unheard", 30),  # in the list
        ("s", 120.0, "too", "early", 40),
        ("s", 336.0, "too", "late", 40),
        ("s", 335.0, "Dusky", "Yoohoo", 10),
    ]
    hints = spark.createDataFrame(said, "set_id string, at double, artist string, title string, mentions long")
    hinted = fusion.identify_sets(df, listing, total, hints, stride=30.0)["tracks"].where("kind = 'unknown'").collect()
    assert [(r.hint.artist, r.hint.title) for r in hinted] == [("Dusky", "Yoohoo")]
