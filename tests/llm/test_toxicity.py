import random
import zlib

import pytest
from pyspark.sql import functions as F

from creditmill.llm.toxicity import in_held_out_third, learnt, toxicity, train
from tests.llm.fixtures import documents, empty

INSULTS = ["blurgh", "krampok", "zuwidel", "fovnique"]


def text(rnd, insult=None):
    syllables = ["ta", "ren", "lo", "mi", "sa", "ne", "du", "ri", "bel", "con"]
    out = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(10, 120))]
    if insult:
        out.insert(rnd.randrange(len(out)), insult)
        out.insert(rnd.randrange(len(out)), insult)
    return " ".join(out) + "."


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    return [(i, text(rnd, rnd.choice(INSULTS) if i % 4 == 0 else None), int(i % 4 == 0)) for i in range(700)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_scores_of_documents_not_learnt_from(spark, corpus):
    docs = documents(spark, [(i, t) for i, t, _ in corpus] + [(900, None), (901, ""), (None, "tarenlo"), (902, INSULTS[0].upper()), (0, corpus[0][1])])
    labels = spark.createDataFrame([(i, None, y) for i, _, y in corpus] + [(5000, 1, 1), (None, 1, 1), (902, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(corpus) + 5
    got = {r.doc_id: r for r in rows}
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [(got[i].predicted, y) for i, _, y in corpus if held_out(i)]
    assert sum(p for p, y in unseen if y) >= 0.95 * sum(y for _, y in unseen)
    assert sum(p for p, y in unseen if not y) <= 0.03 * len(unseen)
    assert got[900].score == got[901].score < 0.5 and got[902].score > got[900].score


def test_labels_of_the_held_out_third_are_not_used(spark, corpus):
    docs = documents(spark, [(i, t) for i, t, _ in corpus])
    one = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 1 - y if held_out(i) else y) for i, _, y in corpus], "doc_id long, toxic int")
    assert sorted(toxicity(docs, one).collect()) == sorted(toxicity(docs, two).collect())
    ids = spark.range(50).select("id", in_held_out_third(F.col("id")).alias("h")).collect()
    assert all(r.h == held_out(r.id) for r in ids)


def test_gapped_and_inserted_letters(corpus):
    scorer, rnd = train([t for _, t, _ in corpus], [y for _, _, y in corpus]), random.Random(3)
    forms = {"plain": lambda w: w, "signs": "-".join, "blanks": " ".join, "capitals": str.upper, "letter": lambda w: w[:3] + "x" + w[3:]}
    for name, change in forms.items():
        found = scorer.probability([text(rnd, change(rnd.choice(INSULTS))) for _ in range(100)])
        assert (found >= 0.7).mean() >= (0.6 if name == "letter" else 0.9), name
    assert (scorer.probability([text(rnd) for _ in range(300)]) >= 0.7).mean() <= 0.03


def test_without_labels(spark):
    docs = documents(spark, [(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity(empty(spark), none).collect() == []


def test_letters_of_a_rarer_script_count():
    rnd = random.Random(9)
    wide = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõö"  # more letters than have codes of their own
    latin = lambda n: " ".join("".join(rnd.choice(wide) for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    syllables = ["та", "рен", "ло", "ми", "са", "не", "ду", "ри", "бел", "кон"]

    def cyrillic(insult=None):
        out = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(10, 60))]
        if insult:
            out.insert(rnd.randrange(len(out)), insult)
        return " ".join(out) + "."

    insults = ["хъюжга", "щыцэф", "гжобъя"]
    rows = [(latin(120), 0) for _ in range(300)] + [(cyrillic(insults[i % 3] if i % 2 else None), i % 2) for i in range(240)]
    scorer = train([t for t, _ in rows], [y for _, y in rows])
    assert (scorer.probability([cyrillic(insults[i % 3]) for i in range(100)]) >= 0.7).mean() >= 0.9
    assert (scorer.probability([cyrillic() for _ in range(100)]) >= 0.7).mean() <= 0.05
    codes, starts = scorer.letters.codes(["щ", "Щ", "-"])
    assert codes[starts[0]] == codes[starts[1]] > 1 and codes[starts[2]] == 0


def test_labels_of_other_tables_take_no_place_in_the_sample(spark, corpus):
    docs = documents(spark, [(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int")
    strangers = spark.range(10_000, 14_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    alone, among = learnt(docs, labels, 60), learnt(docs, labels.union(strangers), 60)
    assert alone is not None and among is not None
    texts = [t for _, t, _ in corpus[:50]]
    assert alone.probability(texts).tolist() == among.probability(texts).tolist()
