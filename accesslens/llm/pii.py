"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers;
looser ones propose further spans. Five labelers vote for, against or not at
all on every proposal: the pattern it came from, its structure (check digit,
ranges), a gazetteer of endings and number prefixes, the words before it, and
what it touches. How reliable each labeler is comes from expectation
maximisation over the vote patterns, without any marked data. A logistic
classifier over features of the span and its surroundings is then fitted to
the estimated labels and has the last word on loose spans; base spans stay.

Vote patterns and features take few values, so their counts, at most some
thousand rows for any corpus, are all that the fits need; they are counted
over all documents in Spark. Every pattern runs in time linear in the text.

Defined results: null texts are empty; repeated rows are treated alike; an
empty table gives no rows; extra columns do not matter. Positions are code
points, ends exclusive. Of overlapping loose spans the first wins, and none
overlaps a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LOOSE_PHONE = re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])")
AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?", re.IGNORECASE)
SAID_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63})+", re.IGNORECASE)
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

#: Words that speak for a kind when they stand before a span, and words that speak against any.
CUES = {"email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "address", "from"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile", "contact")}
AGAINST = ("version", "isbn", "order", "invoice", "release", "build", "serial", "part", "token", "hash", "id")
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu co".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6")

LABELERS = 5


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of address characters before it; the same matches as scanning from the left."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if at > done and text[at - 1] in LOCAL and (domain := DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers at a time of each chain of numbers with dots."""
    found = []
    for chain in NUMBERS.finditer(text):
        if chain.group().count(".") < 3:
            continue
        at, parts = chain.start(), chain.group().split(".")
        while len(parts) >= 4:
            end = at + sum(map(len, parts[:4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[:4]):
                found.append((at, end))
            at, parts = end + 1, parts[4:]
    return found


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The base spans by kind and start, and digit runs that fit no card."""
    cards, others = [], []
    for run in DIGITS.finditer(text):
        if run.end() - run.start() < 13:
            continue
        digits = run.group().replace(" ", "").replace("-", "")
        (cards if 16 <= len(digits) <= 19 and passes_luhn(digits) else others).append(run.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    groups = (emails(text), addresses(text), cards, phones)
    return [(k, a, b) for k, spans in zip(KINDS, groups, strict=True) for a, b in spans], others


def loose_spans(text: str, base: list[tuple[str, int, int]], runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Proposals beside the base spans, none overlapping another."""
    found = [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
    for a, b in runs:
        digits = text[a:b].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 15:
            found.append(("card", a, b))
    for at in AT.finditer(text):
        if said := SAID_DOMAIN.match(text, at.end()):
            start = at.start()
            while start > 0 and at.start() - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < at.start():
                found.append(("email", start, said.end()))
    if text.count(":") >= 3:
        found += [("ip", *m.span()) for m in COLONS.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    kept: list[tuple[str, int, int]] = []
    i, end = 0, 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and (i == len(taken) or taken[i][0] >= b):
            kept.append((kind, a, b))
            end = b
    return kept


def judged(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, int]:
    """The votes on a span (base 3, 1 is none) and its features (mixed base: kind, shape, left, right, cue, length)."""
    span, before = text[a:b], text[max(0, a - 40) : a].lower()
    digits = [c for c in span if "0" <= c <= "9"]
    words = re.findall(r"[a-z@]+", before)[-4:]
    cue = 1 if any(w.startswith(CUES[kind]) for w in words) else -1 if any(w in AGAINST for w in words) else 0
    left, right = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    glued = left.isalnum() or right.isalnum()
    if kind == "email":
        sound = 1 if re.search(r"[A-Za-z]{2,}$", span) else -1
        known = 1 if re.split(r"[^a-z]+", span.lower())[-1] in ENDINGS else 0
    elif kind == "ip":
        sound = 1 if strict or "::" not in span else -1
        known = 1 if span.startswith(("10.", "192.168.", "172.16.", "2001:", "fe80:")) else 0
    elif kind == "card":
        sound = 1 if passes_luhn("".join(digits)) else -1
        known = 1 if "".join(digits).startswith(CARD_STARTS) else -1
    else:
        sound = 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        known = 1 if span.startswith(("+1", "+3", "+4", "+5", "(")) else 0
    votes = 0
    for vote in (1 if strict else 0, sound, known, cue, -1 if glued else 1):
        votes = votes * 3 + vote + 1

    def around(c: str) -> int:
        return 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3

    shape = 2 * (sound > 0) + (known > 0)
    code = 0
    for value, base in ((KINDS.index(kind), 4), (shape, 4), (around(left), 4), (around(right), 4), (cue + 1, 3), (min(len(span) // 8, 3), 4)):
        code = code * base + value
    return votes, code


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())]))


def proposals(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and all spans with votes and features. Written."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for scalar in part.column("_text"):
                text = scalar.as_py()
                base, runs = base_spans(text)
                loose = loose_spans(text, base, runs)
                out.append(
                    [
                        dict(zip(("kind", "start", "end", "votes", "code", "base"), (k, a, b, *judged(text, k, a, b, strict), strict), strict=True))
                        for spans, strict in ((base, True), (loose, False)) for k, a, b in spans
                    ]
                )
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, SPAN)], names=["doc_id", "spans"])

    rows = docs.select("doc_id", text_of().alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,votes:int,code:int,base:boolean>>"), "proposals")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation: the chance of each vote of each labeler given the truth, and the chance that each pattern is true."""
    truth = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.1, 0.9)
    chance = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        for y, weight in enumerate(((1 - truth) * counts, truth * counts)):
            for l in range(LABELERS):
                chance[y, l] = np.bincount(votes[:, l], weight, 3) + 1
            chance[y] /= chance[y].sum(axis=1, keepdims=True)
        prior = (np.dot(truth, counts) + 1) / (counts.sum() + 2)
        log = [np.log(p) + sum(np.log(chance[y, l, votes[:, l]]) for l in range(LABELERS)) for y, p in enumerate((1 - prior, prior))]
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return chance, truth


def decoded(codes: np.ndarray, bases: tuple[int, ...]) -> np.ndarray:
    out = []
    for base in reversed(bases):
        out.append(codes % base)
        codes = codes // base
    return np.stack(out[::-1], axis=1)


FEATURES = (4, 4, 4, 4, 3, 4)


def one_hot(codes: np.ndarray) -> np.ndarray:
    values = decoded(codes, FEATURES)
    parts = [np.eye(base)[values[:, k]] for k, base in enumerate(FEATURES)]
    pair = np.eye(FEATURES[0] * FEATURES[1])[values[:, 0] * FEATURES[1] + values[:, 1]]
    return np.concatenate([*parts, pair, np.ones((len(codes), 1))], axis=1)


def classifier(codes: np.ndarray, truth: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic span classifier, by Newton steps on the estimated labels."""
    x = one_hot(codes)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (counts * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (counts * (p - truth)) + ridge * w)
    return w


def learn(found: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """Labeler reliabilities and classifier weights from the counts over all proposals."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.votes", "s.code").agg(F.count("*").alias("n")).orderBy("votes", "code").toPandas()
    if counts.empty:
        return np.zeros((2, LABELERS, 3)), None
    votes = decoded(counts["votes"].to_numpy(np.int64), (3,) * LABELERS)
    n = counts["n"].to_numpy(np.float64)
    chance, truth = reliabilities(votes, n)
    return chance, classifier(counts["code"].to_numpy(np.int64), truth, n)


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans`` (kind, start, end, base), by kind and start: all base spans, and the loose ones
    that the classifier gives at least ``least``."""
    found = proposals(docs)
    _, weights = learn(found)
    if weights is None:
        accepted = F.lit(False)
    else:
        p = 1 / (1 + np.exp(-np.clip(one_hot(np.arange(int(np.prod(FEATURES)))) @ weights, -30, 30)))
        good = [int(c) for c in np.flatnonzero(p >= least)]
        table = F.lit("".join("1" if c else "0" for c in np.isin(np.arange(len(p)), good)))

        def accepts(code):
            return F.substr(table, code + 1, F.lit(1)) == "1"

    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    kept = F.filter("spans", lambda s: s["base"] | (accepts(s["code"]) if weights is not None else accepted))
    listed = F.sort_array(F.transform(kept, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))))
    return found.select("doc_id", F.transform(listed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))
