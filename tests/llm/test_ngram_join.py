import random
import time

import numpy as np
import pyarrow as pa
import pytest

from creditmill.llm import ngram_join
from creditmill.llm.ngram_join import InvertedLists, keep_one_of_each, linked, near_duplicates
from tests.llm import brute
from tests.llm.fixtures import documents, empty, odd_texts, words


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=repr)


def expected(rows):
    named = brute.near_duplicates([r for r in rows if r[0] is not None])
    alone = lambda t: next(iter(brute.near_duplicates([(0, t)]).values()))[0]
    return sorted(((i, *(named[i] if i is not None else (alone(t), None))) for i, t in rows), key=repr)


def test_odd_rows(spark):
    assert found(documents(spark, odd_texts())) == expected(odd_texts())


def test_empty_table(spark):
    assert found(empty(spark)) == []


@pytest.fixture(scope="module")
def family():
    """A chain of near copies, a star of them, and a passage that unrelated texts share."""
    rnd, rows = random.Random(3), []
    base = words(120, 1)
    for i in range(30):
        rows.append((i, " ".join(base)))
        base = base[:]
        base[rnd.randrange(120)] = f"new{i}"
    star = words(150, 2)
    for i in range(100, 160):
        own = star[:]
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(150)] = f"o{rnd.random()}"
        rows.append((i, " ".join(own)))
    passage = words(60, 3)
    rows += [(200 + i, " ".join(words(80, 50 + i) + passage)) for i in range(25)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [60_000, 1000])
def test_groups_whole_and_in_blocks(spark, monkeypatch, family, group):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group)
    assert found(documents(spark, family)) == expected(family)


def test_threshold_is_met_exactly(spark):
    # 12 words, 8 shingles; the other lacks the last two: 8 of 10 is 80 percent, 7 of 9 is less
    rows = [(1, " ".join(words(14))), (2, " ".join(words(12))), (3, " ".join(words(11)))]
    assert found(documents(spark, rows)) == expected(rows)
    assert expected(rows)[1][2] == 1


def test_one_of_each_stays(spark):
    docs = documents(spark, odd_texts())
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        [i for i, _, c in expected(odd_texts()) if i == c], key=repr
    )


def test_search_equals_counting():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40))).astype(np.uint64) for _ in range(80)]
    index = InvertedLists(sets, [len(s) for s in sets], 60)
    for q in sets:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))]
        assert sorted(index.partners(q, len(q))) == want
    ties = brute.Ties(range(80))
    for a in range(80):
        for b in index.partners(sets[a], len(sets[a])):
            ties.join(a, b)
    mine = brute.Ties(range(80))
    for a, b in linked(sets, [len(s) for s in sets], 60):
        mine.join(a, b)
    assert [mine.root(i) for i in range(80)] == [ties.root(i) for i in range(80)]


def test_search_with_shingles_the_index_lacks():
    held = np.array([5, 9, 20], np.uint64)
    assert InvertedLists([held], [3], 60).partners(np.array([3, 5, 6, 7, 9], np.uint64), 5) == []  # 2 of 6
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40))).astype(np.uint64) for _ in range(80)]
    index = InvertedLists(sets[:8], [len(s) for s in sets[:8]], 40)
    some = 0
    for q in sets:
        q = np.union1d(q, rng.integers(60, 70, 3).astype(np.uint64))
        want = [k for k, s in enumerate(sets[:8]) if 100 * len(np.intersect1d(q, s)) >= 40 * len(np.union1d(q, s))]
        assert sorted(index.partners(q, len(q))) == want
        some += len(want)
    assert some
    lone = np.arange(0, 60, 2, dtype=np.uint64)  # every other shingle of the query is absent
    assert InvertedLists([lone], [30], 60).partners(np.arange(60, dtype=np.uint64), 60) == []


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    one, two, three = (" ".join(words(60, salt)) for salt in (21, 22, 23))
    near = one.replace(words(60, 21)[30], "changed")
    rows = [(1, one), (5, near), (5, two), (6, three), (6, three), (6, three.upper()), (7, three), (8, two)]
    kept = sorted((r.doc_id, r.text.lower()) for r in keep_one_of_each(documents(spark, rows)).collect())
    assert kept == [(1, one), (5, two), (6, three)]


def test_shingles_that_differ_in_their_upper_bits_only_stay_apart():
    """Hashes whose upper bits fall into one part are not cut to the lower ones."""
    parts, keys = 8, np.array([5, 5 + (8 << 48), 77, 77], np.uint64)
    to = (keys >> np.uint64(48)) % np.uint64(parts)
    block = ngram_join._blocks(parts, to, np.array([11, 12, 13]), np.array([1, 2, 1]), np.array([0, 1, 1, 2]), keys, None)
    assert ngram_join._read(pa.Table.from_batches([block]))[3].tolist() == keys.tolist()
    shared = ngram_join._count_occurrences(parts)(pa.Table.from_batches([block]))
    items, _, counts, found, _ = ngram_join._read(shared)
    assert sorted(items.tolist()) == [12, 13] and counts.tolist() == [1, 1] and set(found.tolist()) == {77}


def test_many_small_sets_are_linked_in_near_linear_time():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(400_000, 5, replace=False)).astype(np.uint64) for _ in range(9_000)]
    sets += [sets[i].copy() for i in range(1_000)]
    began = time.process_time()
    edges = linked(sets, [5] * len(sets), 80)
    assert time.process_time() - began < 5
    assert sorted(tuple(sorted(e)) for e in edges) == [(i, 9_000 + i) for i in range(1_000)]


def test_columns_named_like_those_of_the_join(spark):
    text = " ".join(words(60))
    docs = documents(spark, [(1, text), (2, text), (2, text), (3, "other words here")])
    docs = docs.withColumnsRenamed({"id": "__id", "item": "__version", "h1": "__stays"})
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    twice = keep_one_of_each(docs.where("doc_id = 2"))
    assert [r.doc_id for r in twice.collect()] == [2]


@pytest.mark.parametrize("group", [60_000, 1000])
def test_sets_that_share_their_first_hash_stay_apart(spark, monkeypatch, family, group):
    whole = ngram_join._set_hashes
    monkeypatch.setattr(ngram_join, "_set_hashes", lambda tokens: (whole(tokens)[0] % 7, whole(tokens)[1]))
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group)
    rows = family + [(i, t) for i, t in odd_texts() if i is None or i >= 1000]
    rows += [(900 + i, t) for i, (_, t) in enumerate(family[:5])]
    assert ngram_join._items(documents(spark, rows), 5).select("item").distinct().count() == 7
    assert found(documents(spark, rows)) == expected(rows)
    kept = sorted(r.doc_id for r in keep_one_of_each(documents(spark, family)).collect())
    assert kept == sorted(i for i, _, c in expected(family) if i == c)


def test_blocks_meet_their_queries_in_batches(spark, monkeypatch):
    """A long chain of near copies is a large group in which a pivot ties few members."""
    batches, inner = [], ngram_join._in_blocks

    def spied(held, queries, percent):
        batches.append((held.select("block").distinct().count(), queries.count()))
        return inner(held, queries, percent)

    monkeypatch.setattr(ngram_join, "_in_blocks", spied)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 400)
    base, rows = words(100, 7), []
    for i in range(70):
        rows.append((i, " ".join(base)))
        base = [*base[:i], f"step{i}", *base[i + 1 :]]
    rows += [(100 + i, " ".join(words(60, 300 + i) + base[:40])) for i in range(20)]
    assert found(documents(spark, rows)) == expected(rows)
    (blocks, asked), = batches
    assert blocks > 4 and asked * 96 > 4 * 400
