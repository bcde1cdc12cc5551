"""Diffs and fingerprints of surfaces against sets and plain hashing."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from groundwork.operators import surface

COLUMNS = "repo string, type string, subtype string, value string, file string, line_no int"


def made(rng, n):
    return [(rng.choice("ab"), rng.choice(("api_route", "env_var")), rng.choice(("GET", "")), f"v{rng.randrange(12)}", f"f{rng.randrange(4)}", i) for i in range(n)]


def test_diff_equals_sets(spark):
    rng = random.Random(9)
    for n in (0, 25, 60):
        old, new = made(rng, 40), made(rng, n)
        files = [{k: {r[4] for r in g} for k, g in itertools.groupby(sorted(x), lambda r: r[:4])} for x in (old, new)]
        want = {}
        for k in files[0].keys() | files[1].keys():
            a, b = files[0].get(k, set()), files[1].get(k, set())
            change = "added" if not a else "removed" if not b else "moved" if k[1] == "api_route" and not a & b else None
            if change:
                want[k] = change
        a, b = (spark.createDataFrame(x, COLUMNS) for x in (old, new))
        for x, y in ((a, b), (surface.finding_places(a), surface.finding_places(b))):
            rows = surface.diff_surface(x, y).collect()
            assert len(rows) == len(want) and {tuple(r)[:4]: r.change for r in rows} == want


def test_places_add_up(spark):
    f = spark.createDataFrame(made(random.Random(3), 300), COLUMNS)
    places = surface.finding_places(f)
    one = surface.group_findings(places)
    assert one.agg(F.sum("places")).first()[0] == 300 and one.agg(F.sum("n_files")).first()[0] == places.count()
    assert not any(t.startswith("array") for _, t in [*places.dtypes, *one.dtypes])


def tree(digests, levels):
    """A fingerprint by plain loops."""
    sha = lambda rows: hashlib.sha256("\n".join(h for _, h in sorted(rows)).encode()).hexdigest()
    level = [(d, d) for d in set(digests)]
    for n in (*levels, 0):
        level = [(p, sha(g)) for p, g in ((p, list(g)) for p, g in itertools.groupby(sorted(level), lambda x: x[0][:n]))]
    return level[0][1]


def test_fingerprint_is_of_the_set(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)]
    rows = [("big", d) for d in digests] + [("one", digests[0]), ("two", digests[0]), ("two", digests[0])]
    for levels in ((6, 3), (2,), (3, 2, 1)):
        got = {}
        for turn in (rows, rows[::-1] + rows[:7]):
            d = spark.createDataFrame(turn, "repo string, h string").repartition(3)
            got[len(got)] = dict(surface.digest_tree(d, "repo", levels=levels).collect())
        assert got[0] == got[1] == {"big": tree(digests, levels), "one": tree(digests[:1], levels), "two": tree(digests[:1], levels)}
    less = dict(surface.digest_tree(spark.createDataFrame(rows[1:], "repo string, h string"), "repo").collect())
    assert less["big"] != tree(digests, (6, 3)) and surface.digest_tree(spark.createDataFrame([], "repo string, h string"), "repo").count() == 0


def test_groups_list_all_their_files(spark):
    made_ = made(random.Random(4), 300)
    want = {}
    for r in made_:
        files = want.setdefault(r[:4], {})
        files[r[4]] = min(r[5], files.get(r[4], r[5]))
    got = surface.group_findings(surface.finding_places(spark.createDataFrame(made_, COLUMNS))).collect()
    assert {tuple(r)[:4]: r.files for r in got} == {k: ",".join(f"{f}:{n}" for f, n in sorted(v.items())) for k, v in want.items()}
