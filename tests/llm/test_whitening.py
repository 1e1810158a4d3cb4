import numpy as np
import pytest

from creditmill.llm import whitening
from creditmill.llm.whitening import whitening_report

SCHEMA = "vec_id long, embedding array<double>, at long, x string, part int, w int, component string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "c") for i, v in rows], SCHEMA)


def report(spark, rows, **options):
    return sorted(map(tuple, whitening_report(table(spark, rows), **options).collect()), key=repr)


def plain(rows, components=8):
    """Per row kept: id, deviation, whitened values up to signs; and shares of the spread."""
    x = np.array([np.floor(1024 * np.array(v)) + 100_000 for _, v in rows]).astype(np.int64)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    c = (n * x - sums) / n
    covariance = c.T @ c / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return deviation, c @ axes / np.sqrt(values), values / np.trace(covariance)


def check(got, rows):
    deviation, w, share = plain(rows)
    k = w.shape[1]
    assert len(got) == len(rows) * k
    by_id = {(r[0], r[1]): r for r in got}
    mine = np.array([[by_id[i, j + 1][4] for j in range(k)] for i, _ in rows])
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-6
    for at, (i, _) in enumerate(rows):
        for j in range(k):
            _, _, n, own, _, explained, error = by_id[i, j + 1]
            assert (n, own) == (len(rows), deviation[at]) and abs(explained / share[j] - 1) < 1e-6 and error < 1e-6


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(12, 12))
    return [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 12)) @ spread + 9)]


def test_against_plain_version(spark, rows):
    check(report(spark, rows), rows)


def test_many_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST", 16)
    monkeypatch.setattr(whitening, "MOST", 32)
    monkeypatch.setattr(whitening, "GROUP", 2)
    check(report(spark, rows), rows)


def test_fewer_components_than_asked(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))]
    check(report(spark, rows), rows)


def test_large_common_part_costs_no_digits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (v + 1e6).tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))]
    check(report(spark, rows), rows)


def test_odd_rows_are_left_out(spark, rows):
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [NAN] * 12), (904, [1.0] * 11 + [INF]), (905, [1.0] * 11), (906, [1e300] * 12)]
    assert {r[0] for r in report(spark, rows + odd)} == {i for i, _ in rows}


def test_copies_and_missing_ids_count(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 3.0]), (2, [0.0, 0.0])]
    got = report(spark, rows)
    assert len(got) == 8 and {r[2] for r in got} == {4} and sum(r[0] is None for r in got) == 2


def test_components_without_variance(spark):
    got = report(spark, [(i, [1.0, 2.0, 3.0]) for i in range(4)])
    assert {r[3:] for r in got} == {(0, None, 0.0, 0.0)}
    line = report(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])
    assert all((r[4] is None) == (r[1] > 1) for r in line) and max(r[6] for r in line) < 1e-6
    assert report(spark, [(1, [4.0, 5.0])]) == [(1, j, 1, 0, None, 0.0, 0.0) for j in (1, 2)]


def test_nothing(spark):
    assert report(spark, []) == [] and report(spark, [(1, None)]) == []


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float((-1) ** i * (1 << 39)), float(i)]) for i in range(6)]
    got = report(spark, rows)
    assert {r[3] for r in got} == {None}
    wide = whitening.whitened(table(spark, rows)).collect()
    deviation, _, _ = plain(rows)
    assert {(r.vec_id, int(r.deviation)) for r in wide} == {(i, d) for (i, _), d in zip(rows, deviation, strict=True)}
