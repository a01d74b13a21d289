"""Languages of style descriptions, as mixtures fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 1 << 15
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("mixture", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the probability of each hashed n-gram in each of them (n-grams x languages)."""

    langs: tuple[str, ...]
    grams: np.ndarray


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter pairs and triples of a text in lower case, with counts; words are set off by one blank."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters[code], code, 32).astype(np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    a, b, c = code[:-2], code[1:-1], code[2:]
    pair = (a * np.uint32(2654435761) + b * np.uint32(40503) + np.uint32(97)) >> np.uint32(17)
    triple = (a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ c * np.uint32(3266489917)) >> np.uint32(17)
    n = np.bincount(pair, minlength=DIM) + np.bincount(triple, minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64)


def fit_languages(labelled: DataFrame, description: str = "description", lang: str = "lang", style_key: str = "style_key",
                  max_rows: int = 3000, max_languages: int | None = None, smooth: float = 0.5) -> LanguageModel:
    """N-gram frequencies per language from labelled rows.

    The fit reads a bounded sample: about ``max_rows`` rows of each language, picked by a hash of
    the key; repeated rows share its fate. All labels are learned, or the ``max_languages`` most frequent ones (ties: by name).
    Only counts of hashed n-grams (at most 32,768 per language) reach the driver, so labels should be a
    list of languages, not free text. Rows without a label or a letter teach nothing; without any row the model knows no language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(description).isNotNull())
    sizes = rows.groupBy(lang).count().orderBy(F.desc("count"), lang)
    sizes = (sizes if max_languages is None else sizes.limit(max_languages)).collect()
    names = tuple(sorted(r[lang] for r in sizes))
    if not names:
        return LanguageModel((), np.zeros((DIM, 0), np.float32))
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col(lang) == r[lang], F.lit(min(1.0, max_rows / r["count"]))).otherwise(rate)
    pick = F.pmod(F.xxhash64(F.col(style_key).cast("string"), F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(pick < rate).select(F.col(lang).alias("lang"), F.col(description).alias("text"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = letter_table(), {}
        for part in parts:
            for name, text in zip(part["lang"], part["text"]):
                at, n = gram_counts(text, letters)
                sums.setdefault(name, np.zeros(DIM))[at] += n
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": name, "gram": at.astype("int32"), "n": n[at]})
    counted = sample.mapInPandas(count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = np.full((DIM, len(names)), smooth)
    np.add.at(grams, (counted["gram"].to_numpy(np.int64), np.array([names.index(x) for x in counted["lang"]], np.int64)), counted["n"].to_numpy(float))
    return LanguageModel(names, (grams / grams.sum(axis=0)).astype(np.float32))


def mixture(p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` that best explain the counts ``n``, and the log likelihood."""
    share, total = start / start.sum(), n.sum()
    for _ in range(rounds):
        mixed = p @ share
        share = share * (p.T @ (n / mixed)) / total
    return share, float(n @ np.log(p @ share))


def choose_languages(p: np.ndarray, n: np.ndarray, penalty: float = 4.0, rounds: int = 12) -> list[tuple[int, float]]:
    """Language numbers with shares, largest first: the set whose penalised likelihood is highest.

    Sets grow by the shares of the full mixture and start from the best single language; each language
    more must gain ``penalty`` times the logarithm of the n-gram count.
    """
    single = n @ np.log(p)
    best = int(single.argmax())
    full, _ = mixture(p, n, np.ones(p.shape[1]), rounds)
    order = [best, *[int(i) for i in np.argsort(-full, kind="stable") if i != best]]
    chosen, shares, value = [best], np.ones(1), float(single[best])
    cost = penalty * np.log(n.sum() + 1)
    for i in order[1:]:
        if full[i] < 0.01:
            break
        tried = [*chosen, i]
        share, like = mixture(p[:, tried], n, np.maximum(full[tried], 1e-3), rounds)
        if like - value <= cost:
            break
        chosen, shares, value = tried, share, like
    return sorted(((c, float(s)) for c, s in zip(chosen, shares)), key=lambda x: (-x[1], x[0]))


def mixed_languages(styles: DataFrame, model: LanguageModel, description: str = "description", background: bool = False) -> DataFrame:
    """Style descriptions with ``lang_pred``, ``score`` and ``mixture``; with ``background`` also ``unknown``.

    Expectation-maximisation finds each description's share of every known language from
    n-gram likelihoods over the whole text; a penalised likelihood selects
    the languages in ``mixture``. ``lang_pred`` has the largest share, ``score`` is that share. With ``background`` the
    mixture has one component more that finds every n-gram equally likely: its share,
    ``unknown``, is what no known language explains (noise, other scripts), and where it takes all, ``lang_pred`` is
    the likeliest language with score 0. Null texts, texts without a letter, and any text under an empty model are
    ``und`` with score 0, no mixture and ``unknown`` 1. Row by row: ties, copies and repeated rows change nothing; columns
    named like the new ones are replaced.
    """
    known = styles.sparkSession.sparkContext.broadcast((model.langs, model.grams))  # 32,768 x languages
    schema = T.StructType([*RESULT.fields, *([T.StructField("unknown", T.DoubleType())] if background else [])])

    @F.pandas_udf(schema)
    def infer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, grams = known.value
        letters = letter_table()

        def one(text):
            at, n = gram_counts(text, letters) if text and langs else ((), ())
            if not len(at):
                return UNKNOWN, 0.0, [], 1.0
            p = grams[at].astype(np.float64)
            found = choose_languages(np.hstack([p, np.full((len(at), 1), 1.0 / DIM)]) if background else p, n)
            unknown = sum(s for i, s in found if i == len(langs))
            found = [(i, s) for i, s in found if i < len(langs)] or [(int((n @ np.log(p)).argmax()), 0.0)]
            return langs[found[0][0]], min(1.0, found[0][1]), [{"lang": langs[i], "share": s} for i, s in found], min(1.0, unknown)
        for texts in parts:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score", "mixture", "unknown"])[schema.names]
    keep = [c for c in styles.columns if c not in schema.names]
    return styles.withColumn("__found", infer(F.col(description).cast("string"))).select(*keep, "__found.*")
