"""Odd documents shared by the tests: nulls, empty and long texts, repeated rows, extra and clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside
CLASHING = ("id", "draw", "fold", "key", "rep", "block", "n", "size", "bucket", "digest", "component", "kept_id", "mixed_id", "next",
            "found_secrets", "scanned_text", "th", "spans", "p", "target", "copies", "uid", "v", "query", "asked", "score", "kept", "part")


def odd_documents(spark):
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", None, 3),
            (5, "one two three", "en", "b", 13), (6, "one two three", "en", "b", 13), (7, long, "de", "b", len(long)),
            (7, long, "de", "b", len(long)), (8, long + " end", "de", "c", len(long) + 4), (9, "é" * 70_000, "fr", "c", 70_000),
            (None, "no id here at all", "es", "c", 17), (None, None, None, None, None), (10, "tab nbsp em 😀 emoji", "fr", "", 20)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(docs, *own):
    return docs.withColumns({c: F.lit(1) for c in CLASHING if c not in docs.columns and c not in own})
