"""Small document tables for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names used inside the operators.
CLASHING = "doc_id long, text string, words int, fp long, size int, id long, line string, root string, rank int, score double"


def docs(spark, rows):
    """Documents of (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "5", "6", 7, 8.0) for i, t in rows], CLASHING)


def words(n, seed=0):
    """``n`` made-up words."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("bcdfglmnprstvz"[x // 7**k % 14] + "aeiou"[x // 5**k % 5] for k in range(1 + x // 13 % 3)))
    return out


#: Nulls, empty and blank texts, ties, repeated rows, a very long text.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, "null id text"), (None, None), (4, "same words here"),
           (4, "same words here"), (5, "same words here"), (6, "word " * 60_000), (7, "é😀 ñ x"), (8, "!!! ...")]
