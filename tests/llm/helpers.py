"""Small tables that hold the awkward cases."""

from __future__ import annotations

# columns that the operators use inside or return
CLASHING = ["n_words", "size", "score", "rank", "block", "length", "node", "kept", "digest", "target", "n_tokens",
            "s", "rule", "verdict", "weight", "vector", "component"]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHING)

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
LINE = "The quick brown fox jumps over the lazy dog and runs on through the quiet field until it rests."


def doc(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * len(CLASHING))


EDGE_DOCS = [
    doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "one"), doc(5, "two words"), doc(6, LINE), doc(7, LINE),
    doc(7, LINE), doc(8, LINE + "\n" + LINE, source=None), doc(9, LONG, source="b"), doc(10, "x" * 200_000, lang=None),
    doc(None, LINE), doc(None, None, source=None), doc(11, "naïve café 日本語 🙂   nbsp   wide", source="é"),
    doc(12, "<s> </s> <|endoftext|> ▁▁ a  b   c ", source="b"), doc(13, "### $$$ !!! ||| ***"),
    doc(14, "\n\n\n" + LINE + "\n\n"), doc(15, "a b c a b c a b c"),
]


def edge_docs(spark, rows=None):
    return spark.createDataFrame(EDGE_DOCS if rows is None else rows, DOC_SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
