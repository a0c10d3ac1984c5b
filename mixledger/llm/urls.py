"""Verdicts on URLs: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of a feature, hash buckets of host and path together, and what the fit is held back by.
SIZES = (4, 5, 6)
BUCKETS = 1 << 16
STEPS, RATE, DECAY = 1000, 8.0, 1e-5
#: Probability of ``block`` for a URL none of whose n-grams was seen with either label; it stands for the bias.
PRIOR = 0.36
#: The labelled table passes through the driver; more rows than this are refused, not cut.
MAX_LABELLED = 100_000
#: Rules become one expression each, so a list of them is a parameter of this size at most.
MAX_RULES = 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query (host, path, verdict), fixed by its contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# A small labelled table: hosts and paths a reader would block (1) or allow (0). Any other can be passed instead.
LABELLED_HOSTS = {
    1: (
        "cheap-meds.test pills-online.test best-pills-shop.test generic-pharmacy.test viagra-store.test discount-pills.test "
        "casino-royal.test online-casino-bonus.test free-casino.test poker-bets.test sports-bets.test free-bets-now.test "
        "slots-jackpot.test betting-tips.test adult-videos.test xxx-adult.test adult-cams.test hot-adult-x.test sex-chat.test "
        "porn-tube.test escort-girls.test payday-loans.test fast-cash-loans.test free-iphone.test win-prizes.test "
        "replica-watches.test cheap-followers.test crack-downloads.test warez-keygen.test seo-backlinks.test "
        "banner-ads.test ads-server.test click-tracker.test popup-ads.test ad-tracking.test"
    ).split(),
    0: (
        "news.test library.test museum-guide.test university.test weather-report.test city-council.test docs.test blog.test "
        "gardening-notes.test recipes.test local-history.test open-data.test science-journal.test travel-diary.test "
        "football-club.test mountain-huts.test railway-times.test dictionary.test photo-archive.test code-forum.test "
        "health-advice.test school-lessons.test bird-watching.test bookshop.test film-reviews.test maps.test music-theory.test "
        "radio-station.test law-review.test wiki.test track-and-field.test advice-column.test adventure-club.test "
        "betterhomes.test adults-learning.test pillow-factory.test"
    ).split(),
}
LABELLED_PATHS = {
    1: "/buy-cheap-pills /casino/bonus /free-bets/signup /adult/videos /xxx/12 /win-now/claim /order/viagra /poker/slots".split(),
    0: "/ /about /en/12 /fr/34.html /de/56/ /es/78 /articles/2021/05/ /contact /2019/notes.html /index.html /guide/3".split(),
}


def labelled_urls() -> list[tuple[str, int]]:
    """Every labelled host with every path of its kind and with ordinary paths: the host decides, the path helps."""
    found = []
    for label, hosts in LABELLED_HOSTS.items():
        for i, host in enumerate(hosts):
            name = ("www." if i % 3 == 0 else "m." if i % 3 == 1 else "") + host
            found += [(f"https://{name}{path}", label) for path in (*LABELLED_PATHS[0], *LABELLED_PATHS[label])]
    found += [(f"http://{host}{path}", 1) for host in LABELLED_HOSTS[0][::4] for path in LABELLED_PATHS[1]]
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host up to ``/ ? #`` in lower case (A-Z only), the path up to ``? #``.

    Null and URLs without ``://`` give two empty strings.
    """
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule fits its host and every subdomain of it where the path starts with the rule's. Among rules of
    one length that of the longer host wins, then ``block``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be given")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    texts, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, verdict in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        texts = F.when(fits, F.lit(name + start)).otherwise(texts)
        verdicts = F.when(fits, F.lit(verdict)).otherwise(verdicts)
    return texts, verdicts


def features(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct buckets of the n-grams of one URL; host and path have grams of their own, ends are marked."""
    found = set()
    for kind, text in ((b"h", host), (b"p", path)):
        raw = b"^" + text.encode("utf-8", "surrogatepass").lower() + b"$"
        for n in SIZES:
            found.update(zlib.crc32(kind + raw[i : i + n]) % buckets for i in range(len(raw) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def _sums(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The weights of each row's features over the root of their number, added up: long URLs do not weigh more."""
    sizes = np.array([len(r) for r in rows])
    if not len(rows):
        return np.zeros(0)
    at = np.repeat(np.arange(len(rows)), sizes)
    flat = np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int64)
    return np.bincount(at, weights[flat], len(rows)) / np.sqrt(np.maximum(sizes, 1))


def fit(labelled: Sequence[tuple[str, str, int]], buckets: int = BUCKETS) -> np.ndarray:
    """Weights of the buckets and, last, the fixed bias of ``PRIOR``, from (host, path, label) rows by full gradient steps.

    Rows in which either class is missing give zero weights, hence ``allow`` for all.
    """
    y = np.array([float(r[2]) for r in labelled])
    weights = np.zeros(buckets + 1)
    weights[-1] = math.log(PRIOR / (1 - PRIOR))
    if not 0 < y.sum() < len(y):
        return weights
    rows = [features(h, p, buckets) for h, p, _ in labelled]
    sizes = np.array([len(r) for r in rows])
    flat, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    # Both classes weigh the same, however many rows each has.
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(STEPS):
        z = np.bincount(at, weights[flat], len(rows)) * scale + weights[-1]
        error = (1 / (1 + np.exp(-z)) - y) * share
        gradient = np.bincount(flat, (error * scale)[at], buckets)
        weights[:-1] -= RATE * (gradient + DECAY * weights[:-1])
    return weights


def learn(spark: SparkSession, labelled: DataFrame | None = None, buckets: int = BUCKETS) -> np.ndarray:
    """Weights from a small table (url, label), label 1 to block; none given: the table of this module.

    Rows with a null label are left out, repeated rows count once. At most ``MAX_LABELLED`` rows, else an error.
    """
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, label int")
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("label").isNotNull()).select(host.alias("h"), path.alias("p"), F.col("label").cast("int").alias("y"))
    found = rows.distinct().orderBy("h", "p", "y").limit(MAX_LABELLED + 1).collect()
    if len(found) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    return fit([tuple(r) for r in found], buckets)


def scorer(weights: np.ndarray):
    """(host, path) -> probability that the URL is to be blocked, in batches."""
    compact = weights.astype(np.float32)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = compact.astype(np.float64)
        for hosts, paths in batches:
            rows = [features(h, p, len(w) - 1) for h, p in zip(hosts, paths, strict=True)]
            yield pd.Series(1 / (1 + np.exp(-(_sums(rows, w[:-1]) + w[-1]))))

    return score


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = (),
    url_col: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score in front of nothing else than its own columns.

    The verdict is the rule's where one fits, else ``block`` where the model gives 0.5 or more. Every row is
    judged where it stands, so repeated rows get equal verdicts; a null or odd URL has an empty host and
    path and is judged by the model as such. Columns of ``pages`` that have one of the five names give way. An
    empty table gives an empty result. Only the URL is read; no shuffle.
    """
    weights = learn(pages.sparkSession, labelled)
    host, path = host_and_path(F.col(url_col))
    made = ("host", "path", "rule", "verdict", "block_score")
    rows = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in made), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = rows.withColumns({"rule": rule, "_ruled": verdict}).withColumn("block_score", scorer(weights)("host", "path"))
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("_ruled", by_model)).drop("_ruled")


def op11_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, rules=RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")
