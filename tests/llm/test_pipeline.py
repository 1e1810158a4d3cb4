"""The pipeline and the registered queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from creditmill.llm import ngram_join, oracles, queries, quality_rules
from creditmill.llm.common import components, in_slices, stored
from tests.llm.fixtures import documents, empty, odd_texts, words


def corpus():
    rows = [(i, " ".join(words(90, i)) + ".", "en", "a") for i in range(150)]
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 3), "en", "b") for i in range(20)]  # near copies
    rows += [(300 + i, " ".join(w + "***" for w in words(80, 400 + i)), "en", "a") for i in range(5)]
    notice = "\nThis notice stands in many documents."
    rows += [(400 + i, " ".join(words(90, 900 + i)) + "." + notice, "en", "c") for i in range(10)]
    return rows + [(1000 + k, t, "en", "z") for k, (_, t) in enumerate(odd_texts())]


def test_stages_in_a_row(spark, sf_dir):
    docs = documents(spark, corpus())
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stored(stage(spark, docs, sf_dir))
        assert done.columns == docs.columns and done.dtypes == docs.dtypes
        docs = done
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert list(seen) == ["quality_rules", "line_dedup", "ngram_join", "span_dedup"]
    assert {*range(150), *range(200, 220), *range(400, 410)} <= set(seen["quality_rules"])
    assert not {300, 301, 302, 303, 304, 1004, 1005} & set(seen["quality_rules"])
    lines = seen["line_dedup"]
    assert lines[400].text.endswith("documents.") and not lines[401].text.endswith("documents.")
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert not set(range(200, 220)) & set(seen["ngram_join"]) and set(range(150)) <= set(seen["ngram_join"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(seen["span_dedup"])


def test_empty_documents(spark, sf_dir):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])


@pytest.mark.parametrize("stage", ["quality_rules", "ngram_join", "span_dedup", "packing"])
def test_batches_of_a_stage_are_bounded(spark, sf_dir, stage):
    own = spark.newSession()
    dict(corpus_pipeline.STAGES)[stage](own, documents(own, [(1, "a text")]), sf_dir)
    texts = own.range(0, 6000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 300).alias("text"))
    sizes = [r.n for r in texts.mapInArrow(batch_sizes, "n long").collect()]
    assert sum(sizes) > 4 * corpus_pipeline.BATCH_BYTES and max(sizes) < 1.1 * corpus_pipeline.BATCH_BYTES


def test_a_bound_of_the_caller_stays(spark, sf_dir):
    own = spark.newSession()
    own.conf.set(BATCHES, "1000b")
    corpus_pipeline.packing(own, documents(own, [(1, "a text")]), sf_dir)
    assert own.conf.get(BATCHES) == "1000b"


def test_rows_do_not_depend_on_batches(spark, sf_dir):
    found = []
    for bound in ("67108864b", "500b"):
        own = spark.newSession()
        own.conf.set(BATCHES, bound)
        docs, stages = documents(own, corpus()), []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(own, docs, sf_dir))
            stages.append(sorted((tuple(r) for r in docs.collect()), key=repr))
        pieces = corpus_pipeline.STAGES[-1][1](own, docs, sf_dir).drop("sequence_id", "offset")
        found.append([*stages, sorted((tuple(r) for r in pieces.collect()), key=repr)])
    assert found[0] == found[1]


def test_blocks_go_back_in_slices():
    half = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000).astype(np.uint64)
    keys, owner = np.concatenate([half, half]), np.repeat(np.arange(20_000), 100)  # every key in two items
    dealt = [ngram_join._blocks(n, keys % np.uint64(n), np.arange(20_000), np.full(20_000, 100), owner, keys, None) for n in (1, 50)]
    pieces = list(in_slices(dealt[1]))
    assert len(pieces) > 5 and pa.Table.from_batches(pieces).equals(pa.Table.from_batches([dealt[1]]))
    counted = ngram_join._count_occurrences(50)(pa.Table.from_batches([dealt[0]])).to_batches()
    assert sum(b.nbytes for b in counted) > 15_000_000
    assert all(b.nbytes < 1.5 * (1 << 21) for b in [*pieces, *counted])


def test_arrays_of_texts_are_bounded():
    texts = pa.array([" ".join(words(400, i)) for i in range(4000)])
    assert texts.nbytes > 1 << 22
    tracemalloc.start()
    counts = quality_rules.text_counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts["n_words"].tolist() == [400] * 4000 and peak < 50_000_000


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(oracles.ORACLES) <= set(queries.QUERIES)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 500), (None, 3), (159, 200), (300, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in [*range(100, 160), 200, 300]} | {500: 500}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
