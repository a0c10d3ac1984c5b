"""Readers: text, CSV, JSON lines, XML, audio inventories, vendor replies and device files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_text

# Schemas and header names of the inputs.
PROBE = (
    "set_id string, probe_id long, pass string, recognizer string, at double, window double, "
    "match struct<provider:string,track_id:string,artist:string,title:string,isrc:string,"
    "song_offset:double,skew:double,url:string>, error string"
)
SUFFIXES = ["aif", "aiff", "flac", "m4a", "mp3", "wav"]
GENERATED = ["exports", "prepared", "working"]
SONG_HEADERS = {
    "artist": ["artist", "artists", "artistname", "artistnames", "performer"],
    "title": ["title", "track", "trackname", "song", "name", "tracktitle"],
    "version": ["version", "mix", "mixname", "remix"],
    "added_at": ["addedat", "dateadded", "added"],
    "shazamed_at": ["tagtime", "shazamedat", "date"],
    "isrc": ["isrc"],
    "url": ["url", "trackuri", "shazamurl", "link"],
    "key": ["trackkey", "shazamkey"],
    "index": ["index", "no", "position"],
}
HISTORY_ONLY = {"shazamed_at", "key"}
HEADER_LINES = 20
XML_TRACK = (
    "TRACK array<struct<_TrackID:string,_Location:string,_Artist:string,_Name:string,_Mix:string,"
    "_AverageBpm:string,_Tonality:string>>, _Entries string"
)
XML_NODES = (
    "NODE struct<NODE:array<struct<_Type:string,_Name:string,_KeyType:string,_Entries:string,"
    "TRACK:array<struct<_Key:string>>,"
    "NODE:array<struct<_Type:string,_Name:string,_KeyType:string,_Entries:string,TRACK:array<struct<_Key:string>>>>>>>"
)


def read_audio_inventory(spark: SparkSession, path: str, *, hashed: bool = True) -> DataFrame:
    """path, size, mtime, ext, sha256, skip_reason. Bytes are read only when ``hashed``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = (
        F.when(~ext.isin(SUFFIXES), "unsupported")
        .when(F.col("path").rlike(r"\.app/"), "app_bundle")
        .when(F.col("path").rlike(r"/(?:" + "|".join(GENERATED) + r")/"), "generated")
        .when(F.col("length") == 0, "empty")
    )
    digest = F.when(reason.isNull(), F.sha2("content", 256)) if hashed else F.lit(None).cast("string")
    return files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), ext.alias("ext"),
        digest.alias("sha256"), reason.alias("skip_reason"),
    )


def read_tracklists(spark: SparkSession, path: str) -> DataFrame:
    """list_id (the file), line_no, line."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("list_id"), "value")
    lines = files.select("list_id", F.posexplode(F.split("value", r"\R")).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no") + 1)


def header_key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _renamed(names: list[str]) -> dict[str, str]:
    """Known column for each given header; two headers for one column are refused."""
    found: dict[str, str] = {}
    for name in names:
        for column, aliases in SONG_HEADERS.items():
            if header_key(name) in aliases or header_key(name).removesuffix("s") in aliases:
                if column in found.values():
                    raise ValueError(f"Two columns hold the {column}.")
                found[name] = column
    return found


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> the files that begin with it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
        F.monotonically_increasing_id().alias("no"),
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "no").alias("head"))
    return {r.head: r.files for r in first.groupBy("head").agg(F.array_sort(F.collect_set("file")).alias("files")).collect()}


def _header_names(spark: SparkSession, head: str, sep: str) -> list[str]:
    """The names of a header line, quoted ones with a separator inside too."""
    width = head.count(sep) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = spark.range(1).select(F.from_csv(F.lit(head), schema, {"sep": sep}).alias("r")).first().r
    names = [n for n in row]
    while names and names[-1] is None:
        names.pop()
    return [n or "" for n in names]


def read_playlist_csv(spark: SparkSession, path: str, *, sep: str | None = None) -> DataFrame:
    """file, position (from 0 in each file), artist, title, version, added_at, url, kind of playlist CSV files.

    Everything is text; a ragged row fails the read. Each file of a folder is read by its own header and the
    separator that this header uses; columns that a file lacks are null. A file is read by one task, as quoted fields
    may hold line ends. Only headers come to the driver, one row for each different one.
    """
    found = None
    for head, files in sorted(_headers(spark, path).items()):
        own = sep or max([",", "\t", ";"], key=head.count)
        names = _header_names(spark, head, own)
        if len(set(map(header_key, names))) != len(names):
            raise ValueError("Column names must be unique.")
        known = _renamed(names)
        if not {"artist", "title"} <= set(known.values()):
            raise ValueError("A playlist needs artist and title columns.")
        schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
        rows = spark.read.csv(files, schema=schema, header=True, sep=own, multiLine=True, mode="FAILFAST", encoding="UTF-8")
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_no"))
        starts = rows.groupBy("file").agg(F.min("_no").alias("_start"))
        columns = [F.col(f"c{names.index(n)}").alias(c) for n, c in known.items()]
        kind = "history" if HISTORY_ONLY & set(known.values()) else "streaming" if "added_at" in known.values() else "generic"
        placed = rows.join(starts, "file").select("file", (F.col("_no") - F.col("_start")).alias("position"), *columns, F.lit(kind).alias("kind"))
        found = placed if found is None else found.unionByName(placed, allowMissingColumns=True)
    if found is None:
        raise ValueError("A playlist needs a header.")
    return found


def read_song_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a song table whose header may come after a few title lines.

    The header is the first of the first twenty lines that names an artist and a title.
    """
    lines = spark.read.text(path).withColumn("_no", F.monotonically_increasing_id())
    for row in lines.orderBy("_no").limit(HEADER_LINES).collect():
        text = row.value.lstrip("﻿")
        sep = max([",", "\t", ";"], key=text.count)
        names = [n.strip().strip('"') for n in text.split(sep)]
        known = _renamed(names)
        if {"artist", "title"} <= set(known.values()):
            break
    else:
        raise ValueError("No line names an artist and a title column.")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    body = lines.where(F.col("_no") > row._no).select("_no", F.from_csv("value", schema, {"sep": sep}).alias("r"))
    columns = [F.col(f"r.c{names.index(n)}").alias(c) for n, c in known.items()]
    return body.where(F.col("r.c0").isNotNull()).select(F.col("_no").alias("position"), *columns)


def read_probes(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Recognition windows from JSON lines; cut-off lines and lines without a time are left out."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(f"{PROBE}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, mode="PERMISSIVE")
    rows = rows.where(F.col("at").isNotNull() & ~F.isnan("at"))
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_set_pages(pages: DataFrame, column: str = "json") -> DataFrame:
    """pages[set_id, json] as set pages with safe text."""
    schema = (
        "url string, provider string, title string, uploader string, duration_seconds double, description string, "
        "chapters array<struct<start_time:double,end_time:double,title:string>>, "
        "comments array<struct<text:string,start_time:double,like_count:long,author:string>>"
    )
    rows = pages.select("set_id", F.from_json(column, schema).alias("p")).select("set_id", "p.*")
    chapters = F.transform("chapters", lambda c: c.withField("title", safe_text(c["title"])))
    return rows.withColumns(
        {
            "title": safe_text("title"),
            "uploader": safe_text("uploader"),
            "description": safe_text("description", lines=True),
            "chapters": F.coalesce(chapters, F.array().cast("array<struct<start_time:double,end_time:double,title:string>>")),
        }
    )


def page_comments(pages: DataFrame) -> DataFrame:
    rows = pages.select("set_id", F.posexplode("comments").alias("n", "c"))
    return rows.select("set_id", "n", safe_text("c.text", lines=True).alias("text"), "c.start_time", "c.like_count", "c.author")


def read_provider_matches(replies: DataFrame, column: str = "json") -> DataFrame:
    """Three vendors' reply shapes as one ``match``: ISRC where it is first found, milliseconds as
    seconds, and the credit as an id when there is none."""
    j = F.col(column)
    get = lambda path: F.get_json_object(j, path)
    artist = F.coalesce(get("$.track.subtitle"), get("$.metadata.music[0].artists[0].name"), get("$.result.artist"))
    title = F.coalesce(get("$.track.title"), get("$.metadata.music[0].title"), get("$.result.title"))
    offset = F.coalesce(
        get("$.matches[0].offset").try_cast("double"),
        get("$.metadata.music[0].play_offset_ms").try_cast("double") / 1000,
        F.aggregate(F.split(get("$.result.timecode"), ":"), F.lit(0.0), lambda s, p: s * 60 + p.try_cast("double")),
    )
    isrc = F.coalesce(
        get("$.track.isrc"), get("$.metadata.music[0].external_ids.isrc"), get("$.result.apple_music.isrc"),
        get("$.result.spotify.external_ids.isrc"),
    )
    provider = (
        F.when(get("$.track").isNotNull(), "shazam").when(get("$.metadata").isNotNull(), "acrcloud").when(get("$.result").isNotNull(), "audd")
    )
    track = F.coalesce(get("$.track.key"), get("$.metadata.music[0].acrid"), F.lower(F.concat_ws("|", artist, title)))
    match = F.struct(
        provider.alias("provider"), track.alias("track_id"), artist.alias("artist"), title.alias("title"), F.upper(isrc).alias("isrc"),
        offset.alias("song_offset"),
        F.coalesce(get("$.matches[0].frequencyskew").try_cast("double"), F.lit(0.0)).alias("skew"),
        F.coalesce(get("$.track.url"), get("$.result.song_link")).alias("url"),
    )
    return replies.withColumn("match", F.when(title.isNotNull() & artist.isNotNull(), match))


def read_wiki_pages(replies: DataFrame, column: str = "json") -> DataFrame:
    """Page objects of a wiki API reply in search order: pageid, title, wikitext, index."""
    schema = "query struct<pages:array<struct<pageid:long,title:string,index:int,revisions:array<struct<content:string>>>>>"
    rows = replies.select(F.explode(F.from_json(column, schema)["query"]["pages"]).alias("p"))
    return rows.select("p.pageid", "p.title", F.get(F.col("p.revisions"), F.lit(0))["content"].alias("wikitext"), "p.index")


def read_native_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, playlist entries) of native collection XML, every attribute as text."""
    tracks = (
        spark.read.format("xml").option("rowTag", "COLLECTION").schema(XML_TRACK).load(path)
        .select(F.explode("TRACK").alias("t"))
        .select(*(F.col(f"t._{n}").alias(n) for n in ("TrackID", "Location", "Artist", "Name", "Mix", "AverageBpm", "Tonality")))
    )
    roots = spark.read.format("xml").option("rowTag", "PLAYLISTS").schema(XML_NODES).load(path)
    tops = roots.select(F.posexplode("NODE.NODE").alias("node", "n"))
    inner = tops.where(F.col("n._Type") == "0").select("node", F.posexplode("n.NODE").alias("sub", "m"))

    def entries(df: DataFrame, of: str, node: Column) -> DataFrame:
        return df.where(F.col(f"{of}._Type") == "1").select(
            F.col(f"{of}._Name").alias("playlist"), node.alias("node"), F.col(f"{of}._KeyType").alias("key_type"),
            F.posexplode(f"{of}.TRACK").alias("position", "r"),
        ).select("playlist", "node", "key_type", "position", F.col("r._Key").alias("key"))

    return tracks, entries(tops, "n", F.col("node").cast("string")).unionByName(
        entries(inner, "m", F.concat_ws("/", "node", "sub"))
    )


# Layout of a device library. Offsets of a page's table, next page, row count and flags,
# of its first row, and of the row groups that fill it from its end.
PAGE_SIZES = (4096, 8192, 16384)
LIST_AT, LIST_WORDS = 28, 4
KIND_WORD, NEXT_WORD = 2, 3
ROWS_AT, ROW_COUNT_MASK, FLAGS_AT, NOT_DATA = 0x18, 0x1FFF, 0x1B, 0x40
PAGE_HEADER, ROW_GROUP, GROUP_ROWS = 0x28, 0x24, 16
TABLES = {0: "tracks", 2: "artists", 5: "keys", 7: "playlist_tree", 8: "playlist_entries"}
UNREADABLE = "unreadable"


def _in_order(first: int, last: int, following: np.ndarray) -> list[int]:
    """Page numbers of one table, from its first to its last page; a loop ends it."""
    order: dict[int, None] = {}
    while first < len(following) and first not in order:
        order[first] = None
        if first == last:
            break
        first = int(following[first])
    return list(order)


def _device_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, table, page bytes) for the pages of the tables above; a file of another layout is one row."""
    for batch in batches:
        found = []
        for path, data in zip(batch["path"], batch["content"]):
            size, count = np.frombuffer(data[4:12], "<u4").tolist() if len(data) >= LIST_AT else (0, 0)
            if size not in PAGE_SIZES or len(data) < size or not 0 < count <= (size - LIST_AT) // (4 * LIST_WORDS):
                found.append((path, UNREADABLE, None))
                continue
            pages = np.frombuffer(data[: len(data) // size * size], "<u4").reshape(-1, size // 4)
            listed = pages[0, LIST_AT // 4 : LIST_AT // 4 + LIST_WORDS * count].reshape(count, LIST_WORDS)
            for kind, _, first, last in listed.tolist():
                if kind in TABLES:
                    mine = [p for p in _in_order(first, last, pages[:, NEXT_WORD]) if pages[p, KIND_WORD] == kind]
                    found += [(path, TABLES[kind], pages[p].tobytes()) for p in mine]
        yield pd.DataFrame(found, columns=["path", "table", "page"])


def _page_rows(pages: DataFrame) -> DataFrame:
    """(path, table, row): the present rows of pages, cut out by column expressions."""
    page, size = F.col("page"), F.length("page")
    data = (_uint(page, FLAGS_AT, 1).bitwiseAND(F.lit(NOT_DATA)) == 0) & (F.col("table") != UNREADABLE)
    rows = _uint(page, ROWS_AT, 4).bitwiseAND(F.lit(ROW_COUNT_MASK))
    slots = pages.where(data & (rows > 0)).withColumn("slot", F.explode(F.sequence(F.lit(0), (rows - 1).cast("int"))))
    group, bit = F.floor(F.col("slot") / GROUP_ROWS).cast("int"), F.col("slot") % GROUP_ROWS
    foot = size - group * ROW_GROUP
    present = F.expr(f"getbit(_here, slot % {GROUP_ROWS}) = 1")
    start = _uint(page, foot - 6 - bit * 2, 2) + PAGE_HEADER
    marked = slots.withColumns({"_here": _uint(page, foot - 4, 2), "_start": start.cast("int")})
    return marked.where(present).select("path", "table", F.substring("page", F.col("_start") + 1, F.length("page")).alias("row"))


def _uint(row: Column, offset: Column | int, size: int) -> Column:
    """A little-endian number inside bytes."""
    start = offset + 1 if isinstance(offset, Column) else F.lit(offset + 1)
    h = F.hex(F.substring(row, start, F.lit(size)))
    pairs = [F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).try_cast("long")


def _text(row: Column, offset: Column) -> Column:
    """A device string: short ASCII, long ASCII or long UTF-16."""
    kind = _uint(row, offset, 1)
    short = F.decode(F.substring(row, offset + 2, (F.floor(kind / 2) - 1).cast("int")), "US-ASCII")
    length = _uint(row, offset + 1, 2)
    body = F.substring(row, offset + 5, (length - 4).cast("int"))
    return (
        F.when(kind % 2 == 1, short)
        .when(kind == 0x40, F.decode(body, "US-ASCII"))
        .when(kind == 0x90, F.decode(body, "UTF-16LE"))
        .otherwise("")
    )


def read_device_library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """keys, artists, tracks, playlist_tree and playlist_entries of device databases under ``path``.

    Python only puts the pages of each file in order; rows and fields are cut out by column
    expressions. ``unreadable`` names the files with another layout.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdb").load(path)
    pages = files.select("path", "content").mapInPandas(_device_pages, "path string, table string, page binary")
    rows = _page_rows(pages)
    r = F.col("row")
    of = lambda table: rows.where(F.col("table") == table)
    keys = of("keys").select("path", _uint(r, 0, 4).alias("key_id"), _text(r, F.lit(8)).alias("key"))
    far = _uint(r, 0, 2) == 0x64
    name_at = F.when(far, _uint(r, 10, 2)).otherwise(_uint(r, 9, 1)).cast("int")
    artists = of("artists").select("path", _uint(r, 4, 4).alias("artist_id"), _text(r, name_at).alias("artist"))
    string = lambda i: _text(r, _uint(r, 0x5E + 2 * i, 2).cast("int"))
    tracks = of("tracks").select(
        "path",
        _uint(r, 0x48, 4).alias("id"),
        _uint(r, 0x10, 4).alias("file_size"),
        _uint(r, 0x20, 4).alias("key_id"),
        F.nullif(_uint(r, 0x38, 4) / 100, F.lit(0.0)).alias("bpm"),
        _uint(r, 0x44, 4).alias("artist_id"),
        string(17).alias("title"),
        string(19).alias("file_name"),
        string(20).alias("file_path"),
        string(12).alias("mix_name"),
    )
    tracks = tracks.join(keys, ["path", "key_id"], "left").join(artists, ["path", "artist_id"], "left")
    tree = of("playlist_tree").select(
        "path", _uint(r, 12, 4).alias("playlist_id"), _uint(r, 0, 4).alias("parent_id"),
        (_uint(r, 16, 4) != 0).alias("folder"), _text(r, F.lit(0x14)).alias("name"),
    )
    entries = of("playlist_entries").select(
        "path", _uint(r, 8, 4).alias("playlist_id"), _uint(r, 0, 4).alias("position"), _uint(r, 4, 4).alias("track_id")
    )
    return {
        "keys": keys,
        "artists": artists,
        "tracks": tracks,
        "playlist_tree": tree,
        "playlist_entries": entries,
        "unreadable": pages.where(F.col("table") == UNREADABLE).select("path"),
    }


def _analysis_tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tags of analysis files as (path, mtime, size, tag, header, body)."""
    for batch in batches:
        found = []
        for row in batch.itertuples():
            data = row.content
            if data[:4] != b"PMAI" or len(data) < 12:
                continue
            offset = int.from_bytes(data[4:8], "big")
            while offset + 12 <= len(data):
                header, length = struct.unpack_from(">II", data, offset + 4)
                if length < 12 or offset + length > len(data):
                    break
                found.append((row.path, row.mtime, row.length, data[offset : offset + 4].decode("latin-1"), header, data[offset : offset + length]))
                offset += length
        yield pd.DataFrame(found, columns=["path", "mtime", "size", "tag", "header", "body"])


def _tempo_list(bodies: pd.Series, headers: pd.Series) -> pd.Series:
    """Tempos of beat grids: the second of the four big-endian numbers of each eight-byte beat."""

    def tempos(body: bytes, header: int) -> list[float]:
        beats = min(int.from_bytes(body[20:24], "big"), max(0, len(body) - header) // 8)
        if not beats:
            return []
        return (np.frombuffer(body, ">u2", beats * 4, header).reshape(beats, 4)[:, 1] / 100).tolist()

    return pd.Series([tempos(b, h) for b, h in zip(bodies, headers)])


def read_analysis_files(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size, name, bpm (median tempo), beats, hot_cues, memory_cues."""
    tempos = F.pandas_udf(_tempo_list, "array<double>")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.DAT").load(path)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), "length", "content").mapInPandas(
        _analysis_tags, "path string, mtime timestamp, size long, tag string, header int, body binary"
    )
    big = lambda at, size: F.conv(F.hex(F.substring("body", at + 1, size)), 16, 10).try_cast("long")
    text = F.decode(F.substring("body", F.lit(17), big(12, 4).cast("int")), "UTF-16BE")
    name = F.regexp_extract(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("/")), "\u0000+$", ""), r"([^/]+)$", 1)
    beats = rows.where(F.col("tag") == "PQTZ").select("path", F.explode(tempos("body", "header")).alias("t")).where(F.col("t").between(20, 400))
    tempo = beats.groupBy("path").agg(F.round(F.median("t"), 2).alias("bpm"), F.count(F.lit(1)).alias("beats"))
    facts = rows.groupBy("path", "mtime", "size").agg(
        F.max(F.when(F.col("tag") == "PPTH", name)).alias("name"),
        F.sum(F.when((F.col("tag") == "PCOB") & (big(12, 4) == 1), big(18, 2)).otherwise(0)).alias("hot_cues"),
        F.sum(F.when((F.col("tag") == "PCOB") & (big(12, 4) != 1), big(18, 2)).otherwise(0)).alias("memory_cues"),
    )
    return facts.join(tempo, "path", "left").where(F.col("name").isNotNull())
