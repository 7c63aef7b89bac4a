"""Small tables with the awkward rows, and plain Python versions of what the operators compute."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=()):
    """rows of (doc_id, text[, lang[, source]]); extra: names of clashing further columns."""
    full = []
    for r in rows:
        r = (*r, None, None)[:4]
        full.append((*r, None if r[1] is None else len(r[1]), *("x" for _ in extra)))
    return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in extra))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return BLANK.findall(text or "")


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
