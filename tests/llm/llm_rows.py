"""Rows and plain-Python versions that the tests share."""

import re


SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag string, row int, kept string, score double, `a.b` string, _text int, shard string"


def words(text):
    return SPACE.findall((text or "").translate(UP))


def shingles(text, width=5):
    own = words(text)
    return frozenset(tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))) if own else frozenset()


def prose(rng, n):
    return " ".join(rng.choice(["der", "rest", "thion", "Ca", "ñosé", "of", "x"]) + rng.choice(["a", "en", "ist", "ö"]) * rng.randint(0, 3) for _ in range(n))


def row(doc_id, text, lang="en", source="s", n_chars=1):
    return (doc_id, text, lang, source, n_chars, "t", 1, "k", 0.5, "dot", 2, "sh")
