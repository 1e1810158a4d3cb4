"""Small tables with every odd case: nulls, empty and long texts, copies, clashing column names."""

import re

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, id string, item long, h1 int, runs string, row string, component int"


def documents(spark, texts):
    """``texts``: (doc_id, text) pairs or (doc_id, text, lang, source)."""
    rows = []
    for doc_id, text, *rest in texts:
        lang, source = rest or ("en", "a")
        rows.append((doc_id, text, lang, source, len(text or ""), 1, "x", 2, 3, "r", "w", 4))
    return spark.createDataFrame(rows, SCHEMA)


def words(n, salt=0):
    return [f"w{(i * 7919 + salt * 104729) % 99991}" for i in range(n)]


def odd_texts():
    base = words(60)
    near = base[:30] + ["changed"] + base[31:]
    sentence = "One two three four five. Six seven eight nine ten! Is it eleven twelve thirteen?"
    return [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "short text"),
        (8, "SHORT  text"),
        (9, " ".join(words(3000, 5))),
        (10, "x" * 30_000),
        (11, f"{sentence}\nOwn line of this document.\n{sentence}"),
        (12, f"Another beginning here, quite long. {sentence} The end of it, also long enough."),
        (13, "ünï \x00 cödé <|endoftext|> 😀 日本\r\nline\n\nline"),
        (None, " ".join(base)),
        (None, None),
        (14, " ".join(words(3000, 5)[:2900] + words(60, 9))),
    ]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pages_schema():
    return T._parse_datatype_string("page_id long, url string, html string, payload int, sha1 string, file string")
