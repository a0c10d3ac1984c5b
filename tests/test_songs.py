import random
from difflib import SequenceMatcher

from mixledger.operators import songs
from pyspark.sql import functions as F


def test_labels_as_shown(spark):
    cases = [
        ("A", "Bad Love (Antdot & Maz (BR) Remix)", "", "Bad Love", "Antdot & Maz (BR) Remix"),
        ("A", "Halo (Club Mix) [Mixed]", "", "Halo", "Club Mix"),
        ("A", "Halo - Extended Mix", "", "Halo", "Extended Mix"),
        ("A", "Halo (feat. Live Band)", "", "Halo (feat. Live Band)", ""),
        ("A", "Halo (Part Two)", "", "Halo (Part Two)", ""),
        ("A", "Halo - Part Two", "", "Halo - Part Two", ""),
        ("A", "Halo (Dub)", "VIP", "Halo (Dub)", "VIP"),
        ("A", "[Mixed]", "", "[Mixed]", ""),
        ("A", None, None, "", ""),
    ]
    frame = spark.createDataFrame([c[:3] for c in cases], "artist string, title string, version string")
    got = frame.select(songs.display_label(F.col("artist"), F.col("title"), F.col("version")).alias("d")).select("d.*").collect()
    assert [(r.title, r.version) for r in got] == [c[3:] for c in cases]


def test_likeness_of_spellings():
    def song(names, core, text=None):
        return sorted(names), core, text or " ".join([*names, core])

    assert songs.likeness_of(song(["ana"], "halo"), song(["ana"], "halo")) == 1.0
    assert songs.likeness_of(song(["ana", "bo"], "halo"), song(["ana"], "halo")) == 0.9
    assert songs.likeness_of(song(["armand val helden"], "halo"), song(["armand van helden"], "halo")) == 0.9
    assert songs.likeness_of(song(["robert glasper"], "halo"), song(["robert glasper experiment"], "halo")) == 0.9
    assert songs.likeness_of(song(["ana"], "halo"), song(["bo"], "halo")) == 0.6
    assert songs.likeness_of(song(["stif mayer"], "antdot mirage"), song(["antdot"], "mirage")) == 0.8
    assert songs.likeness_of(song(["antdot"], "bad love"), song(["antdot"], "love")) == 0.0
    assert songs.likeness_of(song(["ana"], "mirrage"), song(["ana"], "mirage")) == 0.7
    assert songs.likeness_of(song(["bo"], "mirrage"), song(["ana"], "mirage")) == 0.0
    assert songs.likeness_of(song(["ana"], "song number 12"), song(["ana"], "song number 13")) == 0.0
    assert songs.likeness_of(song(["ana"], ""), song(["ana"], "")) == 0.0


def spelled(rnd, word):
    at = rnd.randrange(len(word))
    return rnd.choice([word, word, word[:at] + word[at + 1 :], word[:at] + rnd.choice("abcdef") + word[at:], word[:at] + "x" + word[at + 1 :]])


def test_every_alike_pair_is_found(spark):
    rnd = random.Random(7)
    artists = ["Ana Lima", "Bo & Cy", "Stif Mayer", "Ana Limma", "Cy", "Ana Lima Trio", ""]
    titles = ["Mirage", "Bad Love", "Love", "Song Number 12", "Song Number 13", "Halo", "Intro", "A", "Desert Hike", "Bo Halo", "Cy", "ééé çà"]
    made = []
    for i in range(140):
        title = spelled(rnd, rnd.choice(titles))
        title += rnd.choice(["", "", " (Extended Mix)", " [Mixed]", " - Dub", " (feat. Cy)", " Bo", " Ana Lima"])
        made.append((i, rnd.choice("xy"), rnd.choice(artists), title, rnd.choice(["", "", "VIP"])))
    frame = spark.createDataFrame(made, "id long, set_id string, artist string, title string, version string")
    left, right = frame.where("id < 70"), frame.where("id >= 70")
    known = {r.id: (list(r.names), r.core, r.text) for r in songs.with_song(frame).collect()}
    assert len(known) == len(made)
    for on in ([], ["set_id"]):
        for least in (songs.SAME_TITLE, songs.CLOSE):
            want = set()
            for a in made[:70]:
                for b in made[70:]:
                    score = songs.likeness_of(known[a[0]], known[b[0]])
                    if score >= least and (not on or a[1] == b[1]):
                        want.add((a[0], b[0], score))
            got = {(r.left_id, r.right_id, r.likeness) for r in songs.same_songs(left, right, on, least).collect()}
            assert got == want and len({s for *_, s in want}) >= 4
    assert songs.same_songs(left.limit(0), right).count() == 0


def test_close_titles_always_share_a_rare_gram(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 14))) for _ in range(150)]
    words = sorted({w for word in words for w in (word, spelled(rnd, word))} - {""})
    frame = spark.createDataFrame([(w,) for w in words], "core string")
    got = {(r.core, r.other) for r in songs.similar_titles(frame, frame, []).collect()}
    close = {(a, b) for a in words for b in words if SequenceMatcher(None, a, b).ratio() >= songs.RATIO}
    assert close <= got and len(got) < len(words) ** 2 / 3
