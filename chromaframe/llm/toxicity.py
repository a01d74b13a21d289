"""Toxic style descriptions, by a learned lexicon found through folded spellings."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m",
              "т": "t", "н": "h", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
              "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
#: One sign stands for both letters, so spelling them alike makes either reading match.
ALIKE = {"l": "i"}

#: Lengths of the word beginnings that may be terms ("abcd*"), for inflected and compound forms.
STEMS = (4, 5)

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("hits", T.IntegerType()), T.StructField("weight", T.DoubleType())])


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the calibration of (1, log weight, density)."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    calibration: tuple[float, float, float]


def make_folder():
    """The function that gives a text's folded words."""
    glyphs = str.maketrans({**HOMOGLYPHS, **{k: None for k in map(chr, range(0x300, 0x370))}, "​": None, "‌": None, "‍": None, "﻿": None, "­": None})
    digits = str.maketrans({**DIGITS, **ALIKE})
    signs = str.maketrans(SIGNS)
    inner = re.compile(r"(?<=[a-z0-9])[@$!|€£]+(?=[a-z0-9])|(?<![^\s])[@$€£](?=[a-z0-9])")
    spelled = re.compile(r"(?<![^\W_])[^\W_](?:([.\-_*~])[^\W_])(?:\1[^\W_])+(?![^\W_])")
    word = re.compile(r"[^\W_]+")
    single = re.compile(r"[.\-_*~][^\W_][.\-_*~]")
    mixed = re.compile(r"(?<![^\W_])[^\W\d_]*+\d[^\W_]*")
    run = re.compile(r"([^\W\d_])\1\1+")
    apart = re.compile(r"[.\-_*~]")
    digit = re.compile(r"\d")

    def fold(text: str | None) -> list[str]:
        t = (text or "").lower()
        if not t.isascii():
            t = unicodedata.normalize("NFKD", t).lower().translate(glyphs)
        if any(s in t for s in SIGNS):
            t = inner.sub(lambda m: m[0].translate(signs), t)
        if single.search(t):
            t = spelled.sub(lambda m: apart.sub("", m[0]), t)
        if digit.search(t):  # numbers stay numbers
            t = mixed.sub(lambda m: m[0] if m[0].isdecimal() else m[0].translate(digits), t)
        for letter, other in ALIKE.items():
            t = t.replace(letter, other)
        if any(c * 3 in t for c in set(t) if c.isalpha()):
            t = run.sub(r"\1", t)
        return word.findall(t)
    return fold


def sample_labels(labelled: DataFrame, style_key: str, toxic: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of each class, picked by a hash of the key."""
    n = {r[toxic]: r["count"] for r in labelled.groupBy(toxic).count().collect()}
    pick = F.pmod(F.xxhash64(F.col(style_key).cast("string"), F.lit(23)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = lambda v: F.lit(min(1.0, max_rows / max(1, n.get(v, 0))))
    return labelled.where(pick < F.when(F.col(toxic) == 1, rate(1)).otherwise(rate(0)))


def _counted(sample: DataFrame, description: str, toxic: str, keys) -> pd.DataFrame:
    """Number of toxic and of clean texts that have each key; ``keys(words)`` lists a text's keys."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, sums = make_folder(), {0: Counter(), 1: Counter()}

        def flush():
            for y, c in sums.items():
                if c:
                    yield pd.DataFrame({"key": list(c), "toxic": y, "n": list(c.values())})
                    c.clear()
        for part in parts:
            for text, y in zip(part["text"], part["toxic"]):
                sums[y].update(set(keys(fold(text))))
                if len(sums[y]) > 200_000:
                    yield from flush()
        yield from flush()
    rows = sample.select(F.col(description).alias("text"), (F.col(toxic) == 1).cast("int").alias("toxic"))
    return rows.mapInPandas(count, "key string, toxic int, n long").groupBy("key").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))


def fit_lexicon(labelled: DataFrame, style_key: str = "style_key", description: str = "description", toxic: str = "toxic",
                max_rows: int = 20_000, max_terms: int | None = None, min_texts: int = 4, min_share: float = 0.005, exceptions: Sequence[str] = ()) -> Lexicon:
    """Weighted terms, exception phrases and calibration from rows labelled 0 or 1.

    The fit reads a bounded sample of about ``max_rows`` rows per class, picked by a
    hash of the key. A term is a folded word, or beginning of words, in at least ``min_texts`` and ``min_share`` of
    the toxic texts whose log odds are positive beyond two and a half standard errors (with ``max_terms``, the heaviest; ties by spelling). A phrase of a
    term and its neighbour that clean texts have at least ``min_texts`` times, and ten times as often
    as toxic ones, is an exception, besides those given. Null labels and texts teach nothing, repeated rows share their key's fate, and an
    empty table gives a lexicon without terms.
    """
    rows = labelled.where(F.col(toxic).isNotNull()).select(style_key, description, toxic)
    sample = sample_labels(rows, style_key, toxic, max_rows)
    totals = {r["y"]: r["n"] for r in sample.groupBy((F.col(toxic) == 1).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_all, good_all = totals.get(True, 0), totals.get(False, 0)
    weight = F.log((F.col("bad") + 0.5) / (bad_all + 1.0)) - F.log((F.col("good") + 0.5) / (good_all + 1.0))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    words = _counted(sample, description, toxic, lambda ws: [k for w in set(ws) for k in (w, *(w[:n] + "*" for n in STEMS if len(w) > n))]).where(F.col("bad") >= max(min_texts, min_share * bad_all)).withColumn("w", weight)
    top = words.where((F.col("w") > 2.5 * error) & (F.col("w") > 2.5)).orderBy(F.desc("w"), "key")
    top = (top if max_terms is None else top.limit(max_terms)).collect()  # at most the sample's words
    terms = {r["key"]: float(r["w"]) for r in top}
    known = set(terms)

    def phrases(ws):
        hit = [w in known or any(w[:n] + "*" in known for n in STEMS) for w in ws]
        return [f"{ws[i]} {ws[i + 1]}" for i in range(len(ws) - 1) if hit[i] or hit[i + 1]]
    benign: list[str] = []
    if known:
        found = _counted(sample, description, toxic, phrases).where((F.col("good") >= min_texts) & (F.col("good") >= 10 * F.col("bad")))
        found = found.orderBy(F.desc("good"), "key")
        benign = [r["key"] for r in (found if max_terms is None else found.limit(max_terms)).collect()]
    fold = make_folder()
    lexicon = Lexicon(terms, tuple(sorted({*benign, *(" ".join(fold(e)) for e in exceptions)} - {""})), (0.0, 0.0, 0.0))
    scored = _scored(sample, lexicon, description).select(F.col(toxic).alias("y"), "__hit.*").groupBy(
        (F.col("y") == 1).cast("double").alias("y"), F.round("strength", 2).alias("a"), F.round("density", 3).alias("d")).count().toPandas()
    return Lexicon(terms, lexicon.exceptions, _calibrate(scored))


def _calibrate(rows: pd.DataFrame, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression on (1, strength, density) by Newton steps; slopes are not negative."""
    if rows.empty:
        return (-3.0, 1.0, 0.0)
    x = np.column_stack([np.ones(len(rows)), rows["a"], rows["d"]]).astype(float)
    y, n = rows["y"].to_numpy(float), rows["count"].to_numpy(float)
    b = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(hess, x.T @ (n * (y - p)) - np.array([1e-6, ridge, ridge]) * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(0.0, float(b[1])), max(0.0, float(b[2]))


def _scored(styles: DataFrame, lexicon: Lexicon, description: str) -> DataFrame:
    """Adds ``__hit``: strength (log of summed weights) and density (weight a hundred words, log), hits and weight."""
    shared = styles.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions))  # words of the bounded sample
    kind = T.StructType([T.StructField("strength", T.DoubleType()), T.StructField("density", T.DoubleType()),
                         T.StructField("hits", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    @F.pandas_udf(kind)
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        terms, exceptions = shared.value
        fold, machine = make_folder(), ahocorasick.Automaton()
        for t, w in terms.items():
            key = f" {t[:-1]}" if t.endswith("*") else f" {t} "
            machine.add_word(key, (len(key), w))
        for e in exceptions:
            machine.add_word(f" {e} ", (len(e) + 2, None))
        machine.make_automaton() if len(machine) else None

        def one(text):
            words = fold(text)
            line = f" {' '.join(words)} "
            found = list(machine.iter(line)) if len(machine) else []
            # Of the exception phrases that begin no later than a hit, the one that reaches farthest decides.
            spared = sorted((end - n, end) for end, (n, w) in found if w is None)
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            hits = {}  # of the terms that begin at one word, the heaviest
            for end, (n, w) in found:
                k = bisect_right(starts, end - n)
                if w is not None and not (k and reach[k - 1] >= end):
                    hits[end - n] = max(w, hits.get(end - n, 0.0))
            total = sum(hits.values())
            return np.log1p(total), np.log1p(100 * total / max(20, len(words))), len(hits), total
        for texts in parts:
            yield pd.DataFrame([one(t) for t in texts], columns=kind.names)
    return styles.withColumn("__hit", match(F.col(description).cast("string")))


def score_styles(styles: DataFrame, lexicon: Lexicon, description: str = "description") -> DataFrame:
    """Style descriptions with ``score`` (0 to 1), ``hits`` and ``weight``.

    The whole text is folded (case, marks, look-alike letters, digits and signs within words,
    spelled-out and stretched words) and matched against the lexicon by an Aho-Corasick machine; a
    hit inside an exception phrase does not count. The summed weight and its density per
    hundred words give the score by the fitted calibration. Null and empty texts score
    as texts without a hit. Row by row: copies and repeated rows score alike;
    columns named like the new ones are replaced.
    """
    keep = [c for c in styles.columns if c not in RESULT.names]
    b0, b1, b2 = lexicon.calibration
    z = F.lit(b0) + F.lit(b1) * F.col("__hit.strength") + F.lit(b2) * F.col("__hit.density")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return _scored(styles, lexicon, description).select(*keep, score.alias("score"), F.col("__hit.hits").alias("hits"), F.col("__hit.weight").alias("weight"))
