import hashlib

import numpy as np
import pytest

from creditmill.llm import shallot
from creditmill.llm.shallot import Best, Centroids, centroid_clusters, step

SCHEMA = "vec_id long, embedding array<double>, v string, a int, distance int, cluster string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, "c") for i, v in rows], SCHEMA)


def plain(rows, k=8, rounds=10, dim=64):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and abs(c) < 1 << 17 for c in v)]
    x = np.array([np.floor(1024 * np.array(v)) for _, v in good]).astype(np.int64).reshape(-1, dim)
    name = lambda at: (hashlib.sha256(f"3:{good[at][0]}".encode()).hexdigest(), x[at].astype("<i4").tobytes())
    order = sorted((at for at in range(len(x)) if good[at][0] is not None), key=name)
    places = x[order[:k]].copy()

    def nearest():
        squares = ((x[:, None] - places[None]) ** 2).sum(2)
        a = squares.argmin(1)
        return a, squares[np.arange(len(x)), a]

    for _ in range(rounds):
        a, _ = nearest()
        for j in range(len(places)):
            if (a == j).any():
                places[j] = x[a == j].sum(0) // (a == j).sum()
    a, d = nearest()
    digest = [hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest() for p in places]
    return sorted(((i, int(j), int(s), int(d[a == j].sum()), int(d.sum()), digest[j]) for (i, _), j, s in zip(good, a, d, strict=True)), key=repr)


def found(spark, rows, **options):
    return sorted(map(tuple, centroid_clusters(table(spark, rows), **options).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(11, 64))
    return [(int(i), (centers[i % 11] + rng.normal(size=64) * 0.4).tolist()) for i in range(900)]


def test_against_plain_version(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_more_centroids_few_components_and_many_ties(spark, monkeypatch):
    monkeypatch.setattr(shallot, "CHUNK", 50)
    rng = np.random.default_rng(8)
    grid = [(i, (rng.integers(-4, 5, 2) / 1024).tolist()) for i in range(600)]
    for k, rounds in ((1, 3), (2, 5), (25, 6), (8, 0)):
        assert found(spark, grid, k=k, rounds=rounds, dim=2) == plain(grid, k, rounds, 2)


def test_odd_rows(spark, rows):
    v = rows[0][1]
    odd = [(900, None), (901, []), (902, v[:63]), (903, [*v, 1.0]), (904, [None, *v[1:]]), (905, [NAN, *v[1:]]), (906, [-INF, *v[1:]])]
    odd += [(907, [1e200, *v[1:]]), (None, v), (None, None), (5, v), (5, v), (-3, [0.0] * 64), (908, [-1e-9] * 64)]
    some = rows[:60] + odd
    assert found(spark, some) == plain(some)


def test_fewer_rows_than_centroids_and_none(spark, rows):
    assert found(spark, rows[:3]) == plain(rows[:3])
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []
    same = [(i, [0.5] * 64) for i in range(20)]
    assert found(spark, same) == plain(same)  # equal starts: all but the first stay empty
    assert {r[1] for r in found(spark, same)} == {0}


def test_search_equals_full_scan_and_skips():
    """Whatever is remembered, the search ends with the two nearest; bounds leave most vectors alone."""
    rng = np.random.default_rng(9)
    x = (np.repeat(rng.normal(size=(20, 6)) * 4000, 100, axis=0) + rng.normal(size=(2000, 6)) * 150).astype(np.int64)
    places = x[::100].copy()
    before = Centroids(places)
    a, b, da, db = before.first(x)
    for remembered in ((a, b), (b, a), (rng.permuted(np.tile(np.arange(20), (2000, 1)), axis=1)[:, :2].T)):
        one, two = np.array(remembered[0]), np.array(remembered[1])
        got = before.search(x, one, two, before.squares(x, one))
        assert all((g == w).all() for g, w in zip(got, (a, b, da, db), strict=True))
    after = Centroids(places + rng.integers(-40, 40, places.shape), places)
    new = step(x, after, a, b, np.sqrt(da.astype(float)), np.sqrt(db.astype(float)))
    want = after.first(x)
    assert (new[0] == want[0]).all() and new[4].mean() < 0.2
    assert (new[2] >= np.sqrt(want[2]) * (1 - 1e-12)).all()
    others = np.array([np.delete(((v - after.places) ** 2).sum(1), j).min() for v, j in zip(x, new[0], strict=True)])
    assert (new[3] <= np.sqrt(others) * (1 + 1e-12)).all()


def test_ball_visits_few_centroids(monkeypatch):
    rng = np.random.default_rng(10)
    places = (rng.normal(size=(100, 3)) * 9000).astype(np.int64)
    x = places[rng.integers(0, 100, 3000)] + rng.integers(-500, 500, (3000, 3))
    centroids, offers = Centroids(places), []
    a, b, da, _ = centroids.first(x)
    plain_offer = Best.offer
    monkeypatch.setattr(Best, "offer", lambda self, who, square, j: offers.append(len(who)) or plain_offer(self, who, square, j))
    centroids.search(x, a, b, da)
    assert sum(offers) < 3000 * 20
