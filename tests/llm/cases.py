"""Documents with every awkward case, and helpers."""

import re

LONG = " ".join(f"w{i}" for i in range(20000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score string, a string, docs string, nth string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").lower())


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source); the other columns have names that operators use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", "y", "z", None, "q") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (None, None), (4, LONG), (5, LONG), (6, "one"), (6, "one"),
    (7, "ein Wört, zwei wörter"), (8, "x" * 100_000), (9, "!!! ???"), (-3, "minus three"), (10, "日本語 テキスト 😀"),
]
