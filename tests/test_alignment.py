import itertools
import random

from mixledger.operators import alignment


def best(pairs):
    """The highest (score, tie) of a set of pairs in rising order, by dynamic programming over all cells."""
    entries, plays = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    weight = {(e, p): (s, t) for e, p, s, t in pairs}
    row = [(0, 0)] * (len(plays) + 1)
    for e in entries:
        new = [(0, 0)]
        for j, p in enumerate(plays):
            options = [row[j + 1], new[j]]
            if (e, p) in weight:
                s, t = weight[e, p]
                options.append((row[j][0] + s, row[j][1] + t))
            new.append(max(options))
        row = new
    return row[-1]


def every_choice(pairs):
    """The same by trying every subset."""
    found = (0, 0)
    for n in range(1, len(pairs) + 1):
        for some in itertools.combinations(sorted(pairs), n):
            if all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(some)):
                found = max(found, (sum(p[2] for p in some), sum(p[3] for p in some)))
    return found


def sample(seed):
    rnd = random.Random(seed)
    sets = {}
    for s in range(40):
        n, m = rnd.randrange(1, 12), rnd.randrange(1, 12)
        cells = rnd.sample([(e, p) for e in range(n) for p in range(m)], min(n * m, rnd.choice([1, 4, 9, 30])))
        sets[f"s{s}"] = [(e, p, rnd.choice([60, 70, 80, 90, 100]), rnd.randrange(-10, 10)) for e, p in cells]
    # A long set whose entries stay near their plays falls into pieces.
    sets["long"] = [(e, e + d, rnd.choice([60, 100]), -abs(d)) for e in range(300) for d in (-2, 0, 1) if rnd.random() < 0.6 and e + d >= 0]
    return sets


def check(spark, sets, **how):
    rows = [(s, *p) for s, pairs in sets.items() for p in pairs]
    frame = spark.createDataFrame(rows + rows[:3], "set_id string, entry long, play long, score long, tie long")
    got = {}
    for r in alignment.align(frame, **how).collect():
        got.setdefault(r.set_id, []).append((r.entry, r.play, r.score, r.tie))
    for s, pairs in sets.items():
        mine = sorted(got[s])
        assert set(mine) <= set(pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(mine))
        assert (sum(p[2] for p in mine), sum(p[3] for p in mine)) == best(pairs), s
    return frame


def test_alignment_is_the_best_one(spark):
    sets = sample(1)
    for pairs in sets.values():
        if len(pairs) <= 9:
            assert best(pairs) == every_choice(pairs)
    frame = check(spark, sets)
    numbers = alignment.pieces(frame).where("set_id = 'long'").select("piece").distinct().count()
    assert numbers > 10
    assert alignment.align(frame.limit(0)).count() == 0


def test_the_same_when_every_set_is_large(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ENTRIES", 7)
    check(spark, sample(2), light_rows=None)
