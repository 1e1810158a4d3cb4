from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from creditmill.llm.quality_rules import COUNTS, bucket, judged, keep_good, measured, text_counts, thresholds
from tests.llm.fixtures import documents, empty, odd_texts, tokens, words


def plain_counts(text):
    w = tokens(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def test_counts():
    texts = [t for _, t in odd_texts()] + ["a a a a b\na a a a b\n\n a a\n", "x y z x y z # <b> é\n", "\n\n", "é\né\né"]
    got = text_counts(pa.array(texts))
    assert list(zip(*(got[c].tolist() for c in COUNTS), strict=True)) == [plain_counts(t) for t in texts]


def corpus():
    good = [(i, " ".join(words(80 + i % 40, i)), "en", "a" if i % 3 else None) for i in range(300)]
    marked = [(1000 + i, " ".join(w + "***" for w in words(90, i)), "en", "a") for i in range(20)]
    few = [(2000 + i, " ".join(words(100, 700 + i)), "xx", "rare") for i in range(3)] + [(2100, " ".join(w + "###" for w in words(100, 3)), "xx", "rare")]
    return [*good, *marked, *few, (3000, None, None, None), (3001, "", "en", "a"), (3002, "one two", "en", "a"), (None, " ".join(words(90, 4)), "en", "a")]


def test_verdicts(spark):
    rows = {r.doc_id: r for r in judged(documents(spark, corpus())).collect()}
    assert len(rows) == len(corpus())
    assert all(rows[i].kept and not rows[i].base_failed for i in range(300))
    assert not any(rows[1000 + i].kept or rows[1000 + i].base_failed for i in range(20))
    assert all(rows[2000 + i].kept for i in range(3)) and not rows[2100].kept  # judged by the merged sketch of all
    assert all(rows[i].base_failed and not rows[i].kept for i in (3000, 3001, 3002))
    assert rows[None].kept


def test_thresholds_follow_the_group(spark):
    tagged = [(5000 + i, " ".join(w + ("#" if k % 4 == i % 3 else "") for k, w in enumerate(words(90, i))), "en", "tags") for i in range(150)]
    rows = [r for r in corpus() if r[0] is not None and r[0] < 2000] + tagged
    limits = {(r.lang, r.source): r.symbols_high for r in thresholds(measured(documents(spark, rows))).collect()}
    assert limits["en", "tags"] > 200 > limits["en", "a"]
    kept = {r.doc_id for r in judged(documents(spark, rows)).where("kept").collect()}
    assert {r[0] for r in tagged} <= kept and not kept & {1000 + i for i in range(20)}


def test_buckets_keep_five_bits(spark):
    rows = spark.range(0, 5000).withColumn("b", bucket(F.col("id"))).collect()
    assert all(r.b <= r.id < r.b + max(1, r.b // 16 + 1) for r in rows)


def test_filter(spark):
    docs = documents(spark, corpus())
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged(docs).where("kept").collect()}


def test_empty_table(spark):
    assert judged(empty(spark)).collect() == []


def test_rows_of_one_id_or_none_are_judged_one_by_one(spark):
    good, other = " ".join(words(90, 4)), " ".join(words(95, 5))
    more = [(None, None, "en", "a"), (None, "too short", "en", "a"), (7, "too short", "en", "a"), (8, other, "en", "a"), (8, other, None, None)]
    docs = documents(spark, corpus() + more).withColumnRenamed("id", "a.b")
    kept = keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert texts.count((None, good)) == 1 and [t for i, t in texts if i == 7] == [corpus()[7][1]]
    assert sorted(t for i, t in texts if i == 8) == sorted([corpus()[8][1], other, other])
    assert (None, None) not in texts and (None, "too short") not in texts


def test_filter_measures_once_and_keeps_columns_of_any_name(spark):
    docs = documents(spark, corpus()).withColumnsRenamed({"id": "key_1", "item": "key_2", "h1": "kept"})
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == judged(docs).where("kept").count()


def test_thresholds_are_quantiles_of_the_sketch(spark):
    # 200 documents: 94 % have no symbol, 6 % have 250 per thousand; repeats grow from 0 to 398 per thousand.
    rows = [("en", "a", 500, 2600, 125 if i >= 188 else 0, 0, i, 10) for i in range(200)]
    rows += [("en", "b", 500, 2600, 50 + i % 50, 0, 0, 10) for i in range(200)]
    counts = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    limits = {r.source: r for r in thresholds(counts).collect()}
    assert limits["a"].symbols_high == 4  # four buckets of one: 90 in 100 have none
    assert limits["b"].symbols_high == 144 + 4 * (184 + 8 - 144)  # median 148, ninth decile 188, in their buckets
    assert limits["a"].repeats_high == 192 + 2 * (384 + 16 - 192) and limits["b"].repeats_high == 2
    assert limits["a"].word_length_high - 512 == 512 - limits["a"].word_length_low == 5 * 32
