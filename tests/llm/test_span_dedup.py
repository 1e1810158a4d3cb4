import random

from creditmill.llm.span_dedup import drop_repeated_spans, span_report
from tests.llm import brute
from tests.llm.fixtures import documents, empty, odd_texts


def found(docs, **options):
    return sorted(((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in span_report(docs, **options).collect()), key=repr)


def expected(rows, **options):
    named = brute.spans([r for r in rows if r[0] is not None], **options)
    free = lambda t: (len(brute.sentences(t)[1]), 0, t)
    return sorted(((i, *(named[i] if i is not None else free(t))) for i, t in rows), key=repr)


def test_odd_rows(spark):
    rows = odd_texts()
    assert found(documents(spark, rows)) == expected(rows)
    assert any(r[2] for r in expected(rows))


def test_longer_runs(spark):
    rows = [(1, "A b c d. E f g h. I j k l. M n o p."), (2, "X y z. E f g h. I j k l. M n o p. Q."), (3, "E f g h. I j k l. R s.")]
    for run, least in ((2, 8), (3, 8), (1, 4), (2, 1), (2, 100)):
        assert found(documents(spark, rows), run=run, least=least) == expected(rows, run=run, least=least)


def test_shared_openings_stay(spark):
    rows = [(i, f"A shared line opens them. It is short.\nThen {i} comes text number {i}. And {i} more.") for i in range(5)]
    assert all(r[2] == 0 for r in found(documents(spark, rows)))


def test_passage_inside_other_text_goes_and_the_rest_stays(spark):
    passage = " ".join(f"Sentence number {i} of the passage has some words." for i in range(6))
    rows = [(1, f"First start. {passage} First end."), (2, f"Second start\n{passage}\nSecond end.")]
    got = {r[0]: r[3] for r in found(documents(spark, rows))}
    assert got[1] == rows[0][1]
    assert got[2] == "Second start\nSecond end."


def test_columns_pass_through(spark):
    docs = documents(spark, odd_texts())
    done = drop_repeated_spans(docs)
    assert done.columns == docs.columns and done.count() == docs.count()


def test_empty_table(spark):
    assert found(empty(spark)) == []


def test_column_names_of_any_kind(spark):
    docs = documents(spark, odd_texts()[:3]).withColumnRenamed("pos", "a name, with: signs").withColumnRenamed("id", "a.b")
    assert drop_repeated_spans(docs).columns == docs.columns
    assert drop_repeated_spans(docs).count() == 3


def every_run(rows, run=2, least=15):
    """Per id: the words that are left once every repeated run and every repeated long sentence is gone."""
    own = {i: [tuple(w.lower() for w in s.split()) for s in t.split("|")] for i, t in rows}
    spans = lambda s: [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if (b - a == 1 or b - a >= run) and sum(map(len, s[a:b])) >= least]
    first = {}
    for i in sorted(own):
        for a, b in spans(own[i]):
            first.setdefault(tuple(own[i][a:b]), (i, a))
    out = {}
    for i, s in own.items():
        gone = {k for a, b in spans(s) if first[tuple(s[a:b])] != (i, a) for k in range(a, b)}
        out[i] = (len(s), len(gone), " ".join(w for k, x in enumerate(s) if k not in gone for w in x))
    return out


def test_short_closing_sentences_of_a_passage_go(spark):
    said = lambda n, salt: " ".join(f"p{salt}x{k}" for k in range(n)) + "."
    passage = [said(20, 1), said(20, 2), said(5, 3), said(4, 4)]
    rows = [(i, " ".join([said(9, 10 * i + 5), *passage, said(30, 10 * i + 6)])) for i in range(1, 4)]
    assert [r[2] for r in found(documents(spark, rows))] == [0, 4, 4]


def test_every_repeated_run_goes(spark):
    rnd = random.Random(11)
    said = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([1, 2, 4, 6, 12, 20]))) + "."
    pool = [[said() for _ in range(rnd.randrange(2, 9))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [said() for _ in range(rnd.randrange(4))]
        for _ in range(rnd.randrange(4)):
            own = rnd.choice(pool)
            a = rnd.randrange(len(own))
            parts += [*own[a : a + rnd.randrange(1, 9)], *[said() for _ in range(rnd.randrange(3))]]
        rows.append((i, "|".join(parts or [said()])))
    for run, least in ((2, 15), (3, 8), (1, 5)):
        want = every_run(rows, run, least)
        got = {r[0]: (r[1], r[2], " ".join(r[3].split())) for r in found(documents(spark, [(i, t.replace("|", " ")) for i, t in rows]), run=run, least=least)}
        assert got == want
