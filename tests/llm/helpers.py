"""Small tables with awkward rows, and plain word rules to compare with."""

import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def sentence(seed, n, vocabulary=5000):
    """n words that follow from the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(f"w{(x >> 33) % vocabulary}")
    return " ".join(out)


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DOC)


def awkward(rows):
    """Nulls, empty and blank texts, one very long text, odd characters."""
    return [
        *rows,
        (9001, None, None, None),
        (9002, "", "en", "s"),
        (9003, " \t\n ", None, "s"),
        (9004, sentence(5, 30_000), "en", None),
        (9005, "Ünïcödé 漢字 \x00 nul\u00a0space \u2003em 😀", "de", ""),
        (None, "a row without an id", "en", "s"),
    ]
