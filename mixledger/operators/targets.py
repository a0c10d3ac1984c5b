"""Can a player or an app read a track? Rules as a small table, unknown is never supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What players read. Rates in Hz, bit rates in bit/s.
LOSSY = {
    "mp3": dict(bitrate=[32_000, 320_000], extensions=[".mp3"], depths=None),
    "aac": dict(bitrate=[16_000, 320_000], extensions=[".m4a", ".aac", ".mp4"], depths=None),
}
LOSSLESS = {
    "pcm": dict(bitrate=None, extensions=[".wav", ".aif", ".aiff"], depths=[16, 24]),
    "flac": dict(bitrate=None, extensions=[".flac", ".fla"], depths=[16, 24]),
    "alac": dict(bitrate=None, extensions=[".m4a"], depths=[16, 24]),
}
HIGH_RATES = [44_100, 48_000, 88_200, 96_000]
PROFILES = {
    "cdj-3000": dict(
        lossless=HIGH_RATES, lossy=[44_100, 48_000], families=["mp3", "aac", "pcm", "flac", "alac"],
        filesystems=["FAT16", "FAT32", "exFAT", "HFS+"], unsupported_schemes=["GPT"],
    ),
    "xdj-rx3": dict(
        lossless=[44_100, 48_000], lossy=[32_000, 44_100, 48_000], families=["mp3", "aac", "pcm", "flac"],
        filesystems=["FAT16", "FAT32", "exFAT", "HFS+"], unsupported_schemes=["GPT"],
    ),
    "opus-quad": dict(
        lossless=HIGH_RATES, lossy=[44_100, 48_000], families=["mp3", "aac", "pcm", "flac", "alac"],
        filesystems=["FAT16", "FAT32", "exFAT", "HFS+"], unsupported_schemes=[],
    ),
}
RULES = (
    "profile_id string, family string, rates array<int>, min_bitrate int, max_bitrate int, "
    "depths array<int>, extensions array<string>"
)


def target_rules(spark: SparkSession) -> DataFrame:
    """One row per profile and codec family (a fixed, small table)."""
    rows = []
    for profile, p in PROFILES.items():
        for family in p["families"]:
            spec = {**LOSSY, **LOSSLESS}[family]
            low, high = spec["bitrate"] or (None, None)
            rates = p["lossy"] if family in LOSSY else p["lossless"]
            rows.append((profile, family, rates, low, high, spec["depths"], spec["extensions"]))
    return spark.createDataFrame(rows, RULES)


def assess_tracks(
    tracks: DataFrame, rules: DataFrame, *, prefix: str = "TARGET", outside: str = "UNSUPPORTED"
) -> DataFrame:
    """tracks[codec, channels, sample_rate, bit_depth, bitrate_bps, codec_profile, ext, profile_id]
    plus ``issues``. ``rules`` holds a row per profile and family, so broadcasting it is safe."""
    codec = F.lower(F.trim(F.coalesce("codec", F.lit(""))))
    pcm = r"^pcm_s?(\d+)(?:le|be)?$"
    rows = tracks.withColumns(
        {
            "_codec": codec,
            "family": F.when(codec.rlike(pcm), "pcm").otherwise(codec),
            "_pcm": F.regexp_extract(codec, pcm, 1).try_cast("int"),
        }
    ).join(F.broadcast(rules), ["profile_id", "family"], "left")

    def code(name: str, kind: str) -> Column:
        return F.lit(f"{prefix}_{name}_{outside if kind == 'bad' else kind}")

    def check(name: str, value: Column, allowed: Column, applies: Column = F.lit(True)) -> Column:
        return F.when(applies & value.isNull(), code(name, "UNKNOWN")).when(
            applies & ~F.coalesce(allowed, F.lit(False)), code(name, "bad")
        )

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    ext = F.nullif(F.lower(F.trim("ext")), F.lit(""))
    rate, depth, bitrate = positive("sample_rate"), positive("bit_depth"), positive("bitrate_bps")
    deep = F.col("depths").isNotNull()
    depth_ok = F.array_contains("depths", depth)
    encoded_ok = F.col("_pcm").isNull() | F.array_contains("depths", F.col("_pcm"))
    depth_issue = (
        F.when(~deep, None)
        .when(depth.isNull(), code("BIT_DEPTH", "UNKNOWN"))
        .when(~depth_ok | ~encoded_ok, code("BIT_DEPTH", "bad"))
        .when(F.col("_pcm") != depth, code("BIT_DEPTH", "CONFLICT"))
    )
    # An unknown stored depth of integer PCM and a bad encoded one are two findings.
    both = F.when(deep & depth.isNull() & ~encoded_ok, code("BIT_DEPTH", "bad"))
    profile = F.nullif(F.upper(F.trim("codec_profile")), F.lit(""))
    listed = F.array_compact(
        F.array(
            check("CHANNELS", positive("channels"), F.col("channels").isin(1, 2)),
            check("EXTENSION", ext, F.array_contains("extensions", ext)),
            check("SAMPLE_RATE", rate, F.array_contains("rates", rate.cast("int"))),
            depth_issue,
            both,
            check("BITRATE", bitrate, bitrate.between(F.col("min_bitrate"), F.col("max_bitrate")), F.col("min_bitrate").isNotNull()),
            check("CODEC_PROFILE", profile, profile == "LC", F.col("family") == "aac"),
        )
    )
    issues = (
        F.when(F.col("_codec") == "", F.array(code("CODEC", "UNKNOWN")))
        .when(F.col("rates").isNull(), F.array(F.lit(f"{prefix}_CODEC_{outside}" if outside == "UNSUPPORTED" else f"{prefix}_CODEC_OUTSIDE_SUBSET")))
        .otherwise(listed)
    )
    return rows.select(*tracks.columns, issues.alias("issues"))
