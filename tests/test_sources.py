import json
import struct

from pyspark.sql import functions as F

from mixledger.sources import readers, writers
from mixledger.streaming import jobs


def test_probes_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"set_id": "s", "at": float(t), "match": {"title": "Halo" if t < 300 else "Glue"}} for t in (0, 30, 60, 400, 430, 2000)]
    rows.insert(2, {"set_id": "s", "at": 45.0, "match": {"title": "Other"}})
    (src / "p.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + '\n{"set_id": "s", "at"')
    assert readers.read_probes(spark, str(src)).count() == 7

    def shaped(df):
        at = F.col("at") + 1e9
        return df.select("set_id", F.col("match.title").alias("song"), at.alias("at"), F.timestamp_seconds(at).alias("ts"))

    stream = shaped(readers.read_probes(spark, str(src), stream=True))
    query = (
        jobs.live_runs(stream, delay="1 second", bridge=240.0).writeStream.format("memory").queryName("runs")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination(120)
    got = sorted((r.song, r.start - 1e9, r.hits) for r in spark.table("runs").collect())
    want = [("Glue", 400.0, 2), ("Halo", 0.0, 3), ("Other", 45.0, 1)]
    assert [r for r in got if r[1] < 1000] == want

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            jobs.closed_runs(stream, delay="1 second", bridge=240.0).writeStream.format("memory").queryName("runs2")
            .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).outputMode("append").start()
        )
        query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    again = sorted((r.song, r.start - 1e9, r.hits) for r in spark.table("runs2").collect())
    assert [r for r in again if r[1] < 1000] == want


def test_late_hits_join_the_runs_they_touch():
    runs = []
    for at in (0.0, 500.0, 30.0, 1000.0, 250.0, 740.0):
        runs = jobs._placed(runs, at, 250.0)
    assert runs == [[0.0, 740.0, 5], [1000.0, 1000.0, 1]]


def test_import_keeps_late_records_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "user_id string, title string, artist string, shazamed_at timestamp"

    def add(name, days):
        (src / name).write_text("\n".join(json.dumps({"user_id": "u", "title": f"T{d}", "artist": "A", "shazamed_at": f"2024-01-{d:02d}T00:00:00Z"}) for d in days))
        jobs.import_new(spark.readStream.schema(schema).json(str(src)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)

    add("a.json", [20, 21])
    add("b.json", [2, 20, 3])
    got = sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["T2", "T20", "T21", "T3"]


def test_sessions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "p.json").write_text("\n".join(json.dumps({"set_id": "s", "song": s, "ts": f"2024-01-01T00:{m:02d}:00Z"}) for m, s in [(0, "A"), (1, "A"), (2, "A"), (40, "B")]))
    df = spark.readStream.schema("set_id string, song string, ts timestamp").json(str(src))
    query = (
        jobs.heard_sessions(df, delay="1 second").writeStream.format("memory").queryName("sessions")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination(120)
    assert [(r.song, r.hits, r.strength) for r in spark.table("sessions").collect()] == [("A", 3, "strong")]


def test_csv_and_song_rows(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text('﻿Track Name;Artist Name(s);Added At\n"One; two";A;2024-01-01T00:00:00Z\nB;C;2024-01-02T00:00:00Z\n')
    rows = readers.read_playlist_csv(spark, str(a)).orderBy("position").collect()
    assert [(r.title, r.artist, r.kind) for r in rows] == [("One; two", "A", "streaming"), ("B", "C", "streaming")]
    b = tmp_path / "b.csv"
    b.write_text("My library\n\nArtist,Title,Mix\nA,One,Dub\n")
    rows = readers.read_song_rows(spark, str(b)).collect()
    assert [(r.artist, r.title, r.version) for r in rows] == [("A", "One", "Dub")]


def test_a_folder_of_csv_files_is_read_by_the_header_of_each(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "a.csv").write_text('Title,Artist\n"One\nmore",A\nTwo,B\n')
    (folder / "b.csv").write_text('Artist;"Title";Added At\nC;Three, four;2024-01-01\n')
    (folder / "c.csv").write_text("Title,Artist\nFive,D\n")
    rows = readers.read_playlist_csv(spark, str(folder)).collect()
    assert sorted((r.file[-5:], r.position, r.artist, r.title, r.added_at, r.kind) for r in rows) == [
        ("a.csv", 0, "A", "One\nmore", None, "generic"), ("a.csv", 1, "B", "Two", None, "generic"),
        ("b.csv", 0, "C", "Three, four", "2024-01-01", "streaming"), ("c.csv", 0, "D", "Five", None, "generic"),
    ]


def test_m3u_in_order(spark, tmp_path):
    df = spark.createDataFrame([("c", i, "A", f"T{i}", "", f"/m/{i}.mp3", 60.4) for i in (2, 0, 1)], "collection_id string, position int, artist string, title string, version string, path string, duration double")
    out = tmp_path / "m3u"
    writers.write_m3u(df, str(out))
    text = "".join(p.read_text() for p in sorted((out / "collection_id=c").glob("part-*")))
    assert text.splitlines() == ["#EXTM3U", "#EXTINF:60,A - T0", "/m/0.mp3", "#EXTINF:60,A - T1", "/m/1.mp3", "#EXTINF:60,A - T2", "/m/2.mp3"]


def test_collection_xml_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("c", i, "A & B", f"T{i}", "", f"/m/{i} x.mp3", 60.4, "My <crate>") for i in range(3)], "collection_id string, position int, artist string, title string, version string, path string, duration double, name string")
    out = tmp_path / "xml"
    writers.write_collection_xml(df, str(out))
    text = "".join(p.read_text() for p in sorted((out / "collection_id=c").glob("part-*")))
    one = tmp_path / "one.xml"
    one.write_text(text)
    tracks, entries = readers.read_native_xml(spark, str(one))
    assert sorted((r.TrackID, r.Artist, r.Location) for r in tracks.collect())[0] == ("1", "A & B", "file://localhost/m/0%20x.mp3")
    assert [(r.playlist, r.key) for r in entries.orderBy("position").collect()] == [("My <crate>", "1"), ("My <crate>", "2"), ("My <crate>", "3")]


def device_file(rows_by_table, size=4096):
    """A minimal device database: a header page and one page per table."""
    kinds = list(rows_by_table)
    head = struct.pack("<III", 0, size, len(kinds)) + b"\0" * 16
    for i, kind in enumerate(kinds):
        head += struct.pack("<IIII", kind, 0, i + 1, i + 1)
    pages = [head.ljust(size, b"\0")]
    for i, kind in enumerate(kinds):
        page = bytearray(size)
        struct.pack_into("<II", page, 8, kind, 0)
        rows, offset = rows_by_table[kind], 0
        struct.pack_into("<I", page, 0x18, len(rows))
        for slot, row in enumerate(rows):
            page[0x28 + offset : 0x28 + offset + len(row)] = row
            struct.pack_into("<H", page, size - 6 - 2 * slot, offset)
            offset += len(row)
        struct.pack_into("<H", page, size - 4, (1 << len(rows)) - 1)
        pages.append(bytes(page))
    return b"".join(pages)


def text(value):
    return bytes([((len(value) + 1) << 1) | 1]) + value.encode()


def test_device_library(spark, tmp_path):
    path = text("/Contents/a.mp3")
    track = bytearray(0x5E + 42)
    for at, value in ((0x10, 1234), (0x20, 3), (0x38, 12800), (0x44, 9), (0x48, 77)):
        struct.pack_into("<I", track, at, value)
    for i in range(21):
        struct.pack_into("<H", track, 0x5E + 2 * i, len(track))
    track += path
    data = device_file(
        {
            5: [struct.pack("<II", 3, 3) + text("8A")],
            2: [struct.pack("<HHI", 0x60, 0, 9) + b"\x03\x0a" + text("Bicep")],
            0: [bytes(track)],
            7: [struct.pack("<IIIII", 0, 0, 0, 5, 0) + text("Friday")],
            8: [struct.pack("<III", 1, 77, 5)],
        }
    )
    (tmp_path / "export.pdb").write_bytes(data)
    (tmp_path / "other.pdb").write_bytes(b"not a library at all" * 9)
    lib = readers.read_device_library(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in lib["unreadable"].collect()] == ["other.pdb"]
    r = lib["tracks"].first()
    assert (r.id, r.file_size, r.bpm, r.key, r.artist, r.file_path) == (77, 1234, 128.0, "8A", "Bicep", "/Contents/a.mp3")
    assert lib["playlist_tree"].first().name == "Friday"
    assert tuple(lib["playlist_entries"].drop("path").first()) == (5, 1, 77)


def test_analysis_file(spark, tmp_path):
    name = "/Contents/x/song.mp3".encode("utf-16-be")
    ppth = b"PPTH" + struct.pack(">III", 16, 16 + len(name), len(name)) + name
    beats = b"".join(struct.pack(">HHI", 1, t, 0) for t in (12800, 12810, 100))
    pqtz = b"PQTZ" + struct.pack(">IIIII", 24, 24 + len(beats), 0, 0, 3) + beats
    pcob = b"PCOB" + struct.pack(">IIIHH", 24, 24, 1, 0, 4) + b"\0" * 4
    body = ppth + pqtz + pcob
    (tmp_path / "ANLZ0000.DAT").write_bytes(b"PMAI" + struct.pack(">II", 12, 12 + len(body)) + body)
    r = readers.read_analysis_files(spark, str(tmp_path)).first()
    assert (r.name, r.bpm, r.beats, r.hot_cues, r.memory_cues) == ("song.mp3", 128.05, 2, 4, 0)


def test_provider_replies(spark):
    rows = [
        json.dumps({"track": {"title": "Glue", "subtitle": "Bicep", "key": "1", "isrc": "gb1"}, "matches": [{"offset": 12.5, "frequencyskew": 0.01}]}),
        json.dumps({"metadata": {"music": [{"title": "Glue", "artists": [{"name": "Bicep"}], "play_offset_ms": 3000}]}}),
        json.dumps({"result": {"title": "Glue", "artist": "Bicep", "timecode": "01:05"}}),
        json.dumps({"result": None}),
    ]
    out = readers.read_provider_matches(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, json string")).orderBy("i").collect()
    assert [r.match and (r.match.provider, r.match.song_offset) for r in out] == [("shazam", 12.5), ("acrcloud", 3.0), ("audd", 65.0), None]
