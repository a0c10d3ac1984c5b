import random

from pyspark.sql import functions as F

from mixledger.functions import clock, urls
from mixledger.operators import comments, history, ingest, intervals, pages, ranking, tracklists, verify, wiki


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def parsed(spark, text):
    df = tracklists.text_lines(spark.createDataFrame([("l", text)], "id string, t string"), "id", "t")
    items, skipped, hidden = tracklists.parse_tracklists(df)
    rows = [(r.kind, r.artist, r.title, r.timestamp) for r in items.orderBy("position").collect()]
    return rows, sorted((r.line_no, r.reason) for r in skipped.collect()), [r.hidden_tracks for r in hidden.collect()]


def test_tracklist_shapes(spark):
    rows, skipped, hidden = parsed(
        spark,
        "Friday — Warm-up\n01. A - One [LABEL]\n02. B - Two [Extended Mix]\n[47:12] 03. C - Three\n04. ID - ID\nSave 12 more tracks\n05. D - Five @ 41:20",
    )
    assert rows == [
        ("named", "A", "One", None),
        ("named", "B", "Two [Extended Mix]", None),
        ("named", "C", "Three", "47:12"),
        ("unknown", None, None, None),
        ("named", "D", "Five", "41:20"),
    ]
    assert skipped == [(1, tracklists.HEADING), (6, tracklists.NO_SEPARATOR)]
    assert hidden == [12]


def test_tracklist_numbers_and_pending_time(spark):
    rows, _, _ = parsed(spark, "2 Unlimited - No Limit\n808 State - Pacific")
    assert [r[1] for r in rows] == ["2 Unlimited", "808 State"]
    rows, _, _ = parsed(spark, "1 A - One\n2 B - Two\n3 C - Three")
    assert [r[1] for r in rows] == ["A", "B", "C"]
    rows, _, _ = parsed(spark, "00:00\nA - One\n01:09\nw/ B - Two")
    assert [(r[1], r[3]) for r in rows] == [("A", "00:00"), ("B", "01:09")]


def test_clock_dates_urls(spark):
    assert one(spark, clock.clock_seconds("v"), v="1:02:03") == 3723.0
    assert one(spark, clock.clock(F.col("v").cast("double")), v="360") == "06:00"
    assert [str(d) for d in one(spark, clock.dates("v"), v="Boiler Room 05/10/2013")] == ["2013-05-10", "2013-10-05"]
    assert [str(d) for d in one(spark, clock.dates("v"), v="live, 16 Dec 2011")] == ["2011-12-16"]
    for v, key in {
        "https://youtu.be/abcdefghijk?t=3": "youtube:abcdefghijk",
        "https://www.youtube.com/watch?v=abcdefghijk&x=1": "youtube:abcdefghijk",
        "http://m.soundcloud.com/A/b/?x=1": "soundcloud.com/a/b",
        "https://facebook.com/watch?v=123": "facebook.com/watch?v=123",
        "ftp://x.y/z": None,
    }.items():
        assert one(spark, urls.url_key("v"), v=v) == key
    assert one(spark, urls.location_key("v"), v="file://localhost/C:/Music/a%20b.mp3") == "windows:C:/Music/a b.mp3"
    assert one(spark, urls.location_key("v"), v="file:///music/a+b.mp3") == "posix:/music/a+b.mp3"
    assert one(spark, urls.location_key("v"), v="file:///music/../b.mp3") is None


def test_comments(spark):
    rows = [
        ("s", 0, "2:41 - gunk / 12:00 - freedom 2", None, 5),
        ("s", 1, "yes Bicep - Glue edit", None, 1),
        ("s", 2, "Bicep - Glue 3:00", None, 2),
        ("s", 3, "Big love from Tokyo - Overmono rules", None, 0),
        ("s", 4, "3:05 what a tune", None, 0),
    ]
    df = spark.createDataFrame(rows, "set_id string, n int, text string, start_time double, like_count int")
    found = comments.parse_comments(df)
    got = sorted((r.n, r.artist, r.title, r.seconds) for r in found.collect())
    assert (0, "", "gunk", 161.0) in got and (0, "", "freedom 2", 720.0) in got
    assert (2, "Bicep", "Glue", 180.0) in got
    assert not [g for g in got if g[0] in (3, 4)]
    hints = intervals.rank_hints(comments.with_support(found), spark.createDataFrame([("s", 170.0)], "set_id string, at double"))
    assert hints.where("rank = 1").first().song in ("bicep|glue", "|gunk")


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(3)
    moments = [("s" if rng.random() < 0.7 else "t", rng.uniform(0, 3000)) for _ in range(60)]
    rows = [("s" if rng.random() < 0.7 else "t", rng.uniform(0, 3000)) for _ in range(200)]
    got = intervals.near(
        spark.createDataFrame(moments, "set_id string, at double"), spark.createDataFrame(rows, "set_id string, seconds double")
    )
    want = sorted((s, a, b) for s, a in moments for t, b in rows if s == t and a - 90 <= b <= a + 300)
    assert sorted((r.set_id, r["at"], r.seconds) for r in got.collect()) == want


def test_published_page(spark):
    schema = "set_id string, title string, uploader string, description string, chapters array<struct<start_time:double,title:string>>"
    text = "Tracklist:\n00:00 Bicep - Glue\n04:10 Four Tet - Baby\nFollow us: https://x.y\nFour Tet - DJ set at Lollapalooza\nBicep - Glastonbury 2019"
    df = spark.createDataFrame([("a", "Some set", "Channel", text, [(0.0, "Intro")]), ("b", "x", "c", "", [(1.0, "A - One"), (2.0, "B - Two"), (3.0, "C - Three")])], schema)
    rows = pages.published_tracklist(df).orderBy("set_id", "line_no").collect()
    assert [r.line for r in rows if r.set_id == "a"] == ["[00:00] Bicep - Glue", "[04:10] Four Tet - Baby"]
    assert [r.source for r in rows if r.set_id == "b"] == ["chapters"] * 3


def test_wiki(spark):
    text = (
        "== File details ==\n{|\n| 1:02:00\n|}\n{{Player|https://youtu.be/abcdefghijk}}\n== Tracklist ==\n"
        "=== CD1 ===\n# [00:45] '''[[Moodymann|KDJ]]''' - Shades<ref>x</ref>\n# [042] A - B\n# [?] C - D\n#: note\n# ...\n# [000] E - F\n[[Category:Tracklist: incomplete]]"
    )
    facts, tracks = wiki.parse_wiki_pages(spark.createDataFrame([(1, "2013-09-27 - KDJ @ Boiler Room Detroit", text)], "pageid long, title string, wikitext string"))
    got = [(r.seconds, r.label) for r in tracks.orderBy("position").collect()]
    assert got == [(45.0, "KDJ - Shades"), (2520.0, "A - B"), (None, "C - D"), (None, "E - F")]
    row = facts.first()
    assert row.lengths == [3720.0] and row.tracklist == "incomplete"
    uploads = spark.createDataFrame(
        [("u", "whatever", "x", None, "https://www.youtube.com/watch?v=abcdefghijk"), ("v", "KDJ Boiler Room Detroit", "x", 3700.0, None), ("w", "Theo Boiler Room Detroit", "x", 3700.0, None)],
        "set_id string, title string, uploader string, duration double, url string",
    )
    assert sorted((r.set_id, r.by) for r in wiki.match_pages(uploads, facts).collect()) == [("u", "link"), ("v", "title")]


def test_history(spark):
    schema = "user_id string, artist string, title string, isrc string, shazamed_at timestamp, position int"
    rows = [
        ("u", "A & B", "T", "US-1", "2024-01-02", 0),
        ("u", "B, A", "T", None, "2024-01-01", 1),
        ("u", "A & B", "T", None, "2024-01-05", 2),
        ("u", "C", "Z", None, "2024-01-03", 3),
    ]
    import datetime as dt

    df = spark.createDataFrame([(a, b, c, d, dt.datetime.fromisoformat(e), f) for a, b, c, d, e, f in rows], schema)
    songs = history.history_merge_linked(df).collect()
    assert sorted((r.title, r["count"], r.isrc) for r in songs) == [("T", 3, "US-1"), ("Z", 1, None)]


def test_history_without_titles(spark):
    schema = "user_id string, artist string, title string, isrc string, shazamed_at timestamp, position int"
    rows = [("u", None, None, f"US-{i}", None, i) for i in range(3)] + [("u", "", " ", None, None, 3), ("u", "", "", None, None, 4)]
    rows += [("u", "A", "One", "X1", None, 5), ("u", "B", "Two", "X1", None, 6), ("u", "B", "Two", "X2", None, 7), ("u", "C", "Six", "X2", None, 8)]
    songs = history.history_merge(spark.createDataFrame(rows, schema)).collect()
    # Untitled records stay apart; a chain of codes and labels is one song.
    assert sorted(r["count"] for r in songs) == [1, 1, 1, 1, 1, 4]


def test_ranking_knows_other_names(spark):
    req = [("plain", "Ann & Bob", "Halo", ""), ("mix", "Ann", "Halo (Foo Remix)", ""), ("label", "Ann", "Halo", "")]
    titles = ["Ann - Halo", "Ann - Halo (Foo RMX)", "Ann - Halo (Unplugged)", "Halo"]
    entries = [
        (r, f"{r}{i}", "soundcloud", t, "someone", 200.0, 10, ["Ann"] if i == 3 else None)
        for r, *_ in req for i, t in enumerate(titles)
    ]
    schema = "request_id string, url string, provider string, title string, uploader string, duration double, view_count long, artists array<string>"
    asked = spark.createDataFrame(req, "request_id string, artist string, title string, version string")
    got = {r.url: r for r in ranking.rank_sources(asked, spark.createDataFrame(entries, schema)).collect()}
    assert [got[f"plain{i}"].other_version for i in range(4)] == [False, True, True, False]
    assert got["plain0"].missing and "credited artist missing" in got["plain0"].reasons
    assert set(got) & {f"mix{i}" for i in range(4)} == {"mix1"} and not got["mix1"].other_version
    assert not got["label3"].missing and "remix not requested" in got["label1"].reasons


def test_long_dj_names_match(spark):
    page = (1, "2013-09-27 - One Two Three Four Five Six @ Boiler Room Detroit", "== File details ==\n{|\n| 1:02:00\n|}")
    facts, _ = wiki.parse_wiki_pages(spark.createDataFrame([page], "pageid long, title string, wikitext string"))
    uploads = spark.createDataFrame(
        [("v", "One Two Three Four Five Six Boiler Room Detroit", "x", 3720.0, None)], "set_id string, title string, uploader string, duration double, url string"
    )
    assert [(r.set_id, r.by) for r in wiki.match_pages(uploads, facts).collect()] == [("v", "title")]


def test_ranking(spark):
    req = spark.createDataFrame([("r", "Bicep", "Glue", "")], "request_id string, artist string, title string, version string")
    schema = "request_id string, url string, provider string, title string, uploader string, duration double, view_count long"
    entries = spark.createDataFrame(
        [
            ("r", "a", "youtube", "Glue", "Bicep - Topic", 270.0, 1000),
            ("r", "b", "youtube", "Bicep - Glue", "someone", 271.0, 10),
            ("r", "c", "youtube", "Bicep - Glue (Live)", "someone", 400.0, 10),
            ("r", "d", "youtube", "Bicep - Glue", "someone", 30.0, 10),
            ("r", "e", "youtube", "Other song", "Bicep", 270.0, 10),
        ],
        schema,
    )
    rows = ranking.rank_sources(req, entries).orderBy("rank").collect()
    assert [r.url for r in rows] == ["a", "b", "c"]
    assert [r.confident for r in rows] == [True, False, False] and rows[2].other_version


def test_native_diff(spark):
    tracks = spark.createDataFrame([("r1", "/m/a.mp3"), ("r2", "/m/b.mp3"), ("r3", "/m/c.mp3")], "recording_id string, path string")
    lists = spark.createDataFrame([("P", 0, "r1"), ("P", 1, "r2"), ("Q", 0, "r1"), ("Q", 1, "r2"), ("R", 0, "r1")], "playlist string, position int, recording_id string")
    xml = spark.createDataFrame([("1", "file://localhost/m/a.mp3"), ("2", "file://localhost/m/b.mp3")], "TrackID string, Location string")
    refs = spark.createDataFrame(
        [("P", "0", "0", 0, "1"), ("P", "0", "0", 1, "2"), ("Q", "1", "1", 0, "file://localhost/m/b.mp3"), ("Q", "1", "0", 1, "1")],
        "playlist string, node string, key_type string, position int, key string",
    )
    found, report = verify.native_diff(tracks, lists, xml, refs)
    assert {r.recording_id: r.state for r in found.collect()} == {"r1": "matched", "r2": "matched", "r3": "missing"}
    assert {r.playlist: (r.membership_match, r.order_match, r.problem) for r in report.collect()} == {
        "P": (True, True, None), "Q": (True, False, "order_mismatch"), "R": (False, False, "playlist_missing"),
    }


def test_errors_and_ingest(spark):
    lines = spark.createDataFrame(
        [("a", 0, "WARNING: 429 retry"), ("a", 1, "ERROR: Private video. token=abc https://u:p@x.media.com/y?sig=1"), ("b", 0, "HTTP Error 503")],
        "source string, n int, text string",
    )
    rows = {r.source: r for r in ingest.classify_errors(lines).collect()}
    assert rows["a"].code == "SOURCE_AUTH_REQUIRED" and not rows["a"].retryable
    assert "abc" not in rows["a"].clean_text and "sig=1" not in rows["a"].clean_text
    assert rows["b"].code == "SOURCE_FAILED" and rows["b"].retryable
    files = spark.createDataFrame(
        [("/a", "s1", "Bicep", "Glue", "", "x"), ("/b", "s2", None, None, None, "03 - Four Tet - Baby"), ("/c", "s3", "bicep", "glue", "", "y")],
        "path string, sha256 string, artist string, title string, version string, stem string",
    )
    recordings = spark.createDataFrame([("r1", "bicep|glue|", "Bicep", "Glue", "")], "recording_id string, identity_key string, artist string, title string, version string")
    revisions = spark.createDataFrame([("v1", "r1", "s1")], "revision_id string, recording_id string, sha256 string")
    out = ingest.ingest(files, recordings, revisions)
    assert [(r.artist, r.title, r.labels_source) for r in out["recordings"].collect()] == [("Four Tet", "Baby", "file_name")]
    assert sorted(r.sha256 for r in out["revisions"].collect()) == ["s2", "s3"]
    assert {r.path: r.revision_id for r in out["locations"].collect()}["/a"] == "v1"


def test_published_lines_are_read_once(spark):
    """Line patterns run on distinct lines only, page facts come from windows, and Unicode text still folds."""
    kind = "set_id int, title string, uploader string, description string, chapters array<struct<start_time:double,title:string>>"
    rows = [
        (1, "Somebody at X", "Café", "Intro text\n[0:00] Á - One\n[3:00] B - Twö\nRecorded live - somewhere", None),
        (2, None, None, "C - Three", [(0.0, "D - Four"), (60.0, "E - Five"), (120.0, "F - Six")]),
        (3, "T", "U", None, [(0.0, "Ø - Seven")]),
    ]
    found = pages.published_tracklist(spark.createDataFrame(rows, kind))
    got = [tuple(r) for r in found.select("set_id", "source", "line_no", "line").orderBy("set_id", "line_no").collect()]
    assert got == [
        (1, "description", 1, "[00:00] Á - One"),
        (1, "description", 2, "[03:00] B - Twö"),
        (2, "chapters", 0, "[00:00] D - Four"),
        (2, "chapters", 1, "[01:00] E - Five"),
        (2, "chapters", 2, "[02:00] F - Six"),
        (3, "chapters", 0, "[00:00] Ø - Seven"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("ArrowEvalPython") == 1


def test_lists_parse_alike_by_windows_and_by_joins(spark):
    """Small lists are read once, by windows; large ones keep the joins, and both give the same rows."""
    rnd = random.Random(5)
    lines = ["1. A - One", "2) B - Two", "3 C - Three", "07 D - Four", "E - Five", "[03:00] F - Six", "4:00", "ID", "heading", "", "12.", "G - Seven [Label]"]
    rows = [(i, n, rnd.choice(lines)) for i in range(40) for n in range(1, rnd.randrange(2, 9))]
    rows += [(99, n, f"{n} Song {n} - Title") for n in range(1, 6)] + [(98, n, f"{9 * n} Song - Title") for n in range(1, 6)]
    df = spark.createDataFrame(rows, "list_id int, line_no int, line string")
    one, other = tracklists.parse_tracklists(df), tracklists.parse_tracklists(df, light_rows=None)
    for a, b in zip(one, other):
        assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
    assert "Join" not in one[0]._jdf.queryExecution().optimizedPlan().toString()


def test_ranked_texts_are_read_once(spark):
    """Ranks are worked out on rows that are written once; no text is folded again for lengths or vouching."""
    asked = spark.createDataFrame([("q", "Bicep", "Glue", "")], "request_id string, artist string, title string, version string")
    schema = "request_id string, url string, title string, uploader string, duration double, view_count long, provider string"
    entries = spark.createDataFrame([("q", "u", "Bicep - Glue", "Bicep", 240.0, 10, "youtube")], schema)
    ranked = ranking.rank_sources(asked, entries)
    assert [(r.url, r.rank, r.confident) for r in ranked.collect()] == [("u", 1, True)]
    assert "ArrowEvalPython" not in ranked._jdf.queryExecution().optimizedPlan().toString()
