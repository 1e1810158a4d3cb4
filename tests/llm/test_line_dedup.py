import hashlib

from creditmill.llm.line_dedup import dedup_lines, drop_repeated_lines, line_report
from tests.llm.fixtures import documents, empty, odd_texts

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=10, min_docs=2):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = [holders.get(key(x), set()) if len(key(x)) >= min_chars else set() for x in lines]
        kept = [x for x, h in zip(lines, own, strict=True) if i is None or len(h) < min_docs or min(h) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_plain_version_with_odd_rows(spark):
    rows = [*odd_texts(), (20, "A shared line\nown\n  a SHARED line\t"), (21, "a shared line \nmore\nown"), (22, "a shared line\n" * 500 + "z")]
    assert sorted(map(tuple, line_report(documents(spark, rows)).collect()), key=repr) == plain(rows)


def test_threshold_counts_documents_not_lines(spark):
    rows = [(1, "the same line\nthe same line\nthe same line"), (2, "the same line"), (3, "other")]
    found = {r.doc_id: r.n_dropped for r in line_report(documents(spark, rows), min_docs=3).collect()}
    assert found == {1: 0, 2: 0, 3: 0}
    assert sorted(map(tuple, line_report(documents(spark, rows)).collect())) == plain(rows)


def test_columns_pass_through(spark):
    docs = documents(spark, odd_texts())
    done = drop_repeated_lines(docs)
    assert done.columns == docs.columns and done.count() == docs.count()


def test_empty_table(spark):
    assert line_report(empty(spark)).collect() == []


def test_no_python_on_the_path(spark):
    plan = dedup_lines(documents(spark, odd_texts()))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_column_names_of_any_kind(spark):
    docs = documents(spark, odd_texts()[:3]).withColumnRenamed("pos", "a name, with: signs").withColumnRenamed("id", "a.b")
    assert drop_repeated_lines(docs).columns == docs.columns
    assert drop_repeated_lines(docs).count() == 3
