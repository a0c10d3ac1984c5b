import pytest
from pyspark.sql import functions as F

from mixledger.functions.labels import clean_key, key_order, with_forms
from mixledger.operators import lists
from mixledger.operators.matching import check_lists, check_states, other_mixes

CATALOG = "recording_id string, revision_id string, identity_key string, artist string, title string, version string, sha256 string"
ITEM = (
    "list_id string, position int, item_id string, kind string, artist string, title string, version string, "
    "also array<struct<artist:string,title:string,version:string,source:string>>"
)


def forms(spark, *labels):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(labels)], "i int, artist string, title string, version string")
    return [r.asDict() for r in with_forms(df).orderBy("i").collect()]


@pytest.mark.parametrize(
    "one, other, key, same",
    [
        (("A", "Rain (Extended Mix)", ""), ("A", "Rain", "Extended Mix"), "label_key", True),
        (("A", "The Bells (Original Mix)", ""), ("A", "The Bells", ""), "label_key", True),
        (("A", "Me Myself and I", ""), ("A", "Me, Myself & I", ""), "label_key", True),
        (("A", "Me Myself and I", ""), ("A", "Me, Myself & I", ""), "label_key_exact", False),
        (("A", "Bad Love (Antdot & Maz (BR) Remix)", ""), ("A", "Bad Love (Antdot & Maz Remix)", ""), "label_key", True),
        (("Max Dean, Luke Dean, Jamie Jones", "T", ""), ("Jamie Jones & Max Dean x Luke Dean", "T", ""), "credit_key", True),
        (("A feat. B", "T", ""), ("A", "T (feat. B)", ""), "credit_key", True),
        (("A, B", "T", ""), ("A", "T", ""), "credit_key", False),
        (("Maz (BR)", "T", ""), ("Maz", "T", ""), "credit_key", True),
        (("STRASSE", "T", ""), ("straße", "T", ""), "identity_key", True),
        (("!!!", "T", ""), ("???", "T", ""), "identity_key", False),
        (("A", "Night Bus (Radio Edit)", ""), ("A", "Night Bus", "Dub"), "base_key", True),
    ],
)
def test_forms(spark, one, other, key, same):
    a, b = forms(spark, one, other)
    assert (a[key] == b[key]) is same


def run(spark, catalog, items, changed=(), resolutions=None, **limits):
    held = spark.createDataFrame(
        [(r, f"v{r}", k or f"{a}|{t}|{v}", a, t, v, f"sha{r}") for r, a, t, v, k in catalog], CATALOG
    )
    places = held.select("revision_id", F.concat(F.lit("/m/"), "recording_id").alias("path"), F.lit(True).alias("managed"))
    inventory = held.select(
        F.concat(F.lit("/m/"), "recording_id").alias("path"),
        F.when(F.col("recording_id").isin(*changed, "-"), "other").otherwise(F.col("sha256")).alias("sha256"),
        F.lit("readable").alias("status"),
    )
    asked = spark.createDataFrame(items, ITEM)
    if resolutions is not None:
        resolutions = spark.createDataFrame(resolutions, "list_id string, item_id string, recording_id string, revision_id string")
    return check_lists(asked, held, places, inventory, resolutions, **limits)


def item(i, artist, title, version="", also=None, kind="named"):
    return ("L", i, f"i{i}", kind, artist, title, version, also)


def test_states(spark):
    catalog = [
        ("1", "Bicep", "Glue", "", None),
        ("2", "Jamie Jones, Max Dean", "Hot", "", None),
        ("3", "Two", "Same", "", None),
        ("4", "Two", "Same", "", None),
        ("5", "Gone", "Song", "", None),
        ("6", "Robert Glasper", "Cherish", "", None),
        ("7", "X", "Me Myself and I", "", None),
        ("8", "X", "Me, Myself & I", "", None),
        ("9", "File", "Name", "", "provisional:abc"),
        ("10", "Bicep", "Glue", "Dub", None),
    ]
    items = [
        item(1, "bicep", "GLUE (Original Mix)"),
        item(2, "Max Dean & Jamie Jones", "Hot"),
        item(3, "Two", "Same"),
        item(4, "Gone", "Song"),
        item(5, "Robert Glasper Experiment", "Cherish"),
        item(6, "X", "Me, Myself & I"),
        item(7, "File", "Name"),
        item(8, "Bicep", "Glue", "Live"),
        item(9, "Nobody", "Nothing"),
        item(10, None, None, None, None, "unknown"),
        item(11, "Wrong", "Glue", "", [("Nope", "Glue", "", "x"), ("Bicep", "Glue", "", "list")]),
        item(12, "Max Dean", "Hot"),
    ]
    rows = {r.item_id: r for r in run(spark, catalog, items, changed=["5"]).collect()}
    states = {k: r.state for k, r in rows.items()}
    assert states == {
        "i1": "satisfied", "i2": "satisfied", "i3": "ambiguous", "i4": "unavailable", "i5": "missing", "i6": "satisfied",
        "i7": "satisfied", "i8": "missing", "i9": "missing", "i10": "unknown", "i11": "satisfied", "i12": "missing",
    }
    assert rows["i6"].accepted.recording_id == "8"
    assert [c.identity_match for c in rows["i5"].candidates] == ["similar_credits"]
    assert {c.identity_match for c in rows["i8"].candidates} == {"different_version"}
    assert rows["i7"].candidates[0].identity_match == "file_name_labels"
    assert rows["i11"].matched_as.source == "list"
    assert [c.identity_match for c in rows["i12"].candidates] == ["similar_credits"]


def test_counts_are_whole_and_choice_resolves(spark):
    catalog = [(str(i), "A", "T", "", None) for i in range(30)]
    rows = run(spark, catalog, [item(1, "A", "T")]).collect()
    assert rows[0].state == "ambiguous" and rows[0].exact_count == 30 == len(rows[0].candidates)
    rows = run(spark, catalog, [item(1, "A", "T")], max_candidates=20).collect()
    assert rows[0].exact_count == 30 and rows[0].candidates_truncated and len(rows[0].candidates) == 20
    rows = run(spark, catalog, [item(1, "A", "T")], resolutions=[("L", "i1", "3", "v3")]).collect()
    assert rows[0].state == "satisfied" and rows[0].accepted.basis == "operator_selection"


def test_counts_duplicates_and_crate(spark):
    catalog = [("1", "A", "One", "", None), ("2", "B", "Two", "Dub", None)]
    items = [item(1, "A", "One"), item(2, "a", "one!"), item(3, "B", "Two"), item(4, "C", "Three"), item(5, None, None, None, None, "unknown")]
    checked = run(spark, catalog, items)
    counts = lists.list_counts(checked).first().asDict()
    assert counts == {"list_id": "L", "owned": 2, "missing": 1, "other_mix": 1, "maybe": 0, "ids": 1, "to_check": 0, "in_crate": 1}
    dup = {r.item_id: r.duplicate_of for r in lists.duplicate_of(spark.createDataFrame(items, ITEM)).collect()}
    assert dup["i2"] == "i1" and dup["i1"] is None and dup["i5"] is None
    crate = lists.collect_lists(checked).collect()
    assert [(r.recording_id, r.position) for r in crate] == [("1", 0)]


def test_keys(spark):
    df = spark.createDataFrame([("8A",), ("10B",), ("Am",), ("H",), (None,)], "k string")
    good = [r.k for r in df.select(clean_key("k").alias("k")).collect()]
    assert good == ["8A", "10B", "Am", None, None]
    order = [r.k for r in df.where("k is not null").orderBy(key_order("k")).collect()]
    assert order == ["8A", "10B", "Am", "H"]


def test_states_without_candidates_equal_the_full_check(spark):
    """``check_states`` gives the states, counts and labels of ``check_lists``, also for copies and shared revisions."""
    rows = [
        ("1", "v1", None, "Bicep", "Glue", ""),
        ("2", "v2", None, "Bicep", "Glue", "Dub"),
        ("3", "v2", None, "Bicep", "Glue", ""),  # one revision under two labels is no other version
        ("4", "v4", None, "Two", "Same", ""),
        ("5", "v5", None, "Two", "Same", ""),
        ("5", "v5", None, "Two", "Same", ""),
        ("6", "v6", None, "Robert Glasper", "Cherish", ""),
        ("7", "v7", None, "X", "Me Myself and I", ""),
        ("8", "v8", None, "X", "Me, Myself & I", ""),
        ("9", "v9", "provisional:abc", "File", "Name", ""),
        ("10", "v10", None, "Gone", "Song", ""),
        ("11", "v11", None, "Mix", "Only", "VIP"),
        ("12", "v12", None, "Mix", "Only", "Dub"),
    ] + [(f"c{i}", f"w{i}", None, "Many", "Copies", "Edit" if i % 2 else "") for i in range(400)]
    held = spark.createDataFrame(
        [(r, v, k or f"{a}|{t}|{x}", a, t, x, f"sha{v}") for r, v, k, a, t, x in rows], CATALOG
    )
    places = held.select("revision_id", F.concat(F.lit("/m/"), "revision_id").alias("path"), F.lit(True).alias("managed")).distinct()
    inventory = places.select(
        "path",
        F.when(F.col("revision_id") == "v10", "other").otherwise(F.concat(F.lit("sha"), "revision_id")).alias("sha256"),
        F.lit("readable").alias("status"),
    )
    asked = [
        ("Bicep", "Glue", ""), ("Bicep", "Glue", "Dub"), ("bicep", "GLUE (Original Mix)", ""), ("Two", "Same", ""),
        ("Robert Glasper Experiment", "Cherish", ""), ("X", "Me Myself & I", ""), ("X", "Me, Myself and I", ""), ("File", "Name", ""),
        ("Gone", "Song", ""), ("Mix", "Only", "Live"), ("Many", "Copies", ""), ("Many", "Copies", "Edit"), ("Many", "Copies", "Dub"),
        ("Nobody", "Nothing", None), ("Bicep", "Glue", "Rework"),
    ]
    items = spark.createDataFrame(
        [("L", i, f"i{i}", "unknown" if i == 0 else "named", *x) for i, x in enumerate([asked[0], *asked])],
        "list_id string, position int, item_id string, kind string, artist string, title string, version string",
    )
    full = lists.set_table(check_lists(items, held, places, inventory)).orderBy("position").collect()
    states = check_states(items, held, places, inventory)
    assert lists.set_table(states).orderBy("position").collect() == full
    of = lambda match: F.size(F.filter("candidates", lambda c: c["identity_match"] == match)).cast("long")
    facts = ["position", "state", "accepted", "exact_count"]
    found = check_lists(items, held, places, inventory)
    want = found.select(*facts, of("different_version").alias("r"), of("similar_credits").alias("m")).orderBy("position").collect()
    got = states.select(*facts, F.col("related_total").alias("r"), F.col("maybe_total").alias("m")).orderBy("position").collect()
    assert got == want
    assert lists.list_counts(states).collect() == lists.list_counts(found).collect()
    assert not any("array" in kind for name, kind in states.dtypes)  # no row grows with the copies of its label


def test_summary_names_the_recordings_of_a_list(spark):
    accepted = "struct<recording_id:string,revision_id:string>"
    rows = [("L", "satisfied", ("r2", "v2")), ("L", "satisfied", ("r1", "v1")), ("L", "satisfied", ("r2", "v9")),
            ("L", "missing", None), ("M", "unknown", None)]
    checked = spark.createDataFrame(rows, f"list_id string, state string, accepted {accepted}")
    got = {r.list_id: r for r in lists.list_summary(checked).collect()}
    assert got["L"].unique_satisfied_recording_ids == ["r1", "r2"] and got["L"].unique_satisfied_recordings == 2
    assert got["M"].unique_satisfied_recording_ids == [] and got["M"].unknown == got["M"].unresolved == 1


def test_shopping_list_shows_all_mixes_times_and_searches(spark):
    catalog = [("1", "Bicep", "Glue", "Dub"), ("2", "Bicep", "Glue (Radio Edit)", ""), ("3", "Bicep", "Glue", "Dub"), ("4", "Bicep", "Glue", ""),
               ("5", "Robert Glasper", "Cherish", ""), ("6", "Own", "Song", "")]
    held = spark.createDataFrame([(r, f"v{r}", f"{a}|{t}|{v}", a, t, v, f"sha{r}") for r, a, t, v in catalog], CATALOG)
    places = held.select("revision_id", F.concat(F.lit("/m/"), "recording_id").alias("path"), F.lit(True).alias("managed"))
    inventory = held.select(F.concat(F.lit("/m/"), "recording_id").alias("path"), "sha256", F.lit("readable").alias("status"))
    asked = [("named", "Bicep", "Glue", "Rework", "1:00"), ("named", "Robert Glasper Experiment", "Cherish", "", "2:00"),
             ("named", "A & B*~", "New feat. C (Original Mix) [LABEL]", "", "3:00"), ("unknown", None, None, None, "4:00"), ("named", "Own", "Song", "", "5:00")]
    items = spark.createDataFrame(
        [("L", i, f"i{i}", *x) for i, x in enumerate(asked)],
        "list_id string, position int, item_id string, kind string, artist string, title string, version string, timestamp string",
    )
    for check in (check_lists, check_states):
        table = lists.set_table(check(items, held, places, inventory))
        mixes = other_mixes(table.where("own = 'other_mix'"), held)
        got = lists.shopping_list(table, mixes).orderBy("position").collect()
        assert [(r.section, r.timestamp, r.you_own, r.mixes) for r in got] == [
            ("other mix", "1:00", "Bicep - Glue (Dub)", ["Dub", "Radio Edit", "Glue"]), ("maybe", "2:00", "Robert Glasper - Cherish", None),
            ("missing", "3:00", None, None), ("ids", "4:00", None, None),
        ]
        assert got[2].shop == {
            "beatport": "https://www.beatport.com/search?q=A+%26+B%2A~+New",
            "bandcamp": "https://bandcamp.com/search?q=A+%26+B%2A~+New&item_type=t",
            "traxsource": "https://www.traxsource.com/search?term=A+%26+B%2A~+New",
        }
        assert got[0].shop["beatport"].endswith("?q=Bicep+Glue+Rework") and got[3].shop is None
