"""Queries whose plans must not read or sort the order lines more often than they need to."""

from mixledger.plans import all_queries


def plan(spark, sf, name):
    return all_queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_same_list_numbers_the_lines_once_per_reading(spark, sf):
    # One reading for the lists and one for the newest of each fingerprint.
    assert plan(spark, sf, "same_list").count("row_number()") <= 2


def test_fingerprints_of_collections_read_no_labels(spark, sf):
    assert "p_partkey" not in plan(spark, sf, "collection_fingerprints")


def test_native_diff_adds_up_instead_of_joining_sides(spark, sf):
    assert "FullOuter" not in plan(spark, sf, "native_diff")


def test_wiki_tracks_read_pages_once(spark, sf):
    # Lines are taken apart once: a second reading for a cut or a count would do all pattern work again.
    assert plan(spark, sf, "parse_wiki_pages").count("posexplode") == 1


def test_uploads_meet_pages_by_numbers(spark, monkeypatch):
    from mixledger.operators import wiki

    pages = [(i, f"2013-09-27 - Dj Name{i} @ Boiler Room Detroit", "== File details ==\n{|\n| 1:02:00\n|}") for i in range(3)]
    facts, _ = wiki.parse_wiki_pages(spark.createDataFrame(pages, "pageid long, title string, wikitext string"))
    uploads = spark.createDataFrame(
        [(f"v{i}", f"Name{i} Boiler Room Detroit", "x", 3720.0, None) for i in range(3)], "set_id string, title string, uploader string, duration double, url string"
    )
    plans = []
    old = wiki.cut_lineage
    monkeypatch.setattr(wiki, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or old(df))
    found = {(r.set_id, r.pageid, r.by) for r in wiki.match_pages(uploads, facts).collect()}
    assert found == {(f"v{i}", i, "title") for i in range(3)}
    assert any("LeftSemi" in p for p in plans)  # phrases that name no DJ go before they are paired with words


def test_markup_that_appears_late_is_still_removed(spark):
    from pyspark.sql import functions as F

    from mixledger.operators import wiki

    lines = {
        "{{a{{b}}}}'''[[P|[[Q]]]]'''<ref>x</ref> &amp;lt; y": "[[P|Q]] < y",
        "{<ref/>{x}} [http://a.b c] <br/>d​  e": "c d e",
        "[[<ref>z</ref>A|B]] ''C''": "B C",
        "plain": "plain",
        "": "",
    }
    rows = wiki.plain_markup(spark.createDataFrame([(k,) for k in lines], "line string"), "body", F.col("line"))
    assert {r.line: r.body for r in rows.collect()} == lines
