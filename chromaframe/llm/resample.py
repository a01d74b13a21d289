"""Drawing style descriptions whose words look like a set of target descriptions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.llm.base import text_of
from chromaframe.scale import cut_lineage, rank_within

#: Longer words are left to the tail, so that the broadcast head is bounded in bytes.
HEAD_BYTES = 64
#: A task hands on its counts when it holds this many words.
HELD = 500_000


def words_of(text: str) -> list[bytes]:
    """Runs of digits, a-z and non-ASCII characters after lower-casing A-Z, as UTF-8."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode("utf-8", "surrogatepass").lower())


class Head(dict):
    """Buckets of frequent words; any other word takes its CRC directly and is not kept."""

    def __init__(self, words: list[bytes], buckets: int):
        super().__init__((w, zlib.crc32(w) % buckets) for w in words)
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word) % self.buckets


class States(dict):
    """CRC states of frequent words with the blank after them: a pair goes on from there."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, zlib.crc32(w + b" ")) for w in words)

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word + b" ")


class PairHead(dict):
    """Buckets of frequent pairs; any other pair continues the state of its first word."""

    def __init__(self, pairs: list[bytes], states: States, buckets: int):
        super().__init__(((a, b), zlib.crc32(b, states[a]) % buckets) for a, b in (p.split(b" ") for p in pairs))
        self.states, self.buckets = states, buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(pair[1], self.states[pair[0]]) % self.buckets


class Features:
    """Bucket numbers of all features of a text, from a shared head vocabulary."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int, max_words: int):
        self.words, self.max_words = Head(words, buckets), max_words
        self.pairs = PairHead(pairs, States(words), buckets)

    def of(self, words: list[bytes]) -> list[int]:
        found = list(map(self.words.__getitem__, words))
        if self.max_words > 1:
            found += map(self.pairs.__getitem__, zip(words, words[1:]))
        return found


def frequent_features(styles: DataFrame, description: str, head_words: int, head_pairs: int, max_words: int) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words and pairs of all descriptions, counted exactly; at most ``head_words`` and ``head_pairs``, in whole steps of counts."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def handed():
            return pd.DataFrame({"feature": list(held.keys()), "pair": [b" " in f for f in held], "n": list(held.values())})
        for part in parts:
            for text in part["text"]:
                words = words_of(text)
                held.update(w for w in words if len(w) <= HEAD_BYTES)
                if max_words > 1:
                    held.update(a + b" " + b for a, b in zip(words, words[1:]) if len(a) + len(b) <= HEAD_BYTES)
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        if held:
            yield handed()
    sums = (styles.select(text_of(description).alias("text")).mapInPandas(count, "feature binary, pair boolean, n long")
            .groupBy("feature", "pair").agg(F.sum("n").alias("n")))
    sums = cut_lineage(sums.withColumn("step", F.floor(F.log2("n") * 16).cast("int")))
    # At most 1,024 steps of counts: the head takes whole steps, so only words of the head are sent.
    steps = sums.groupBy("pair", "step").agg(F.count(F.lit(1)).alias("words")).collect()

    def top(pair: bool, most: int) -> list[bytes]:
        least, room = None, most
        for r in sorted((r for r in steps if r["pair"] == pair), key=lambda r: -r["step"]):
            room -= r["words"]
            if room < 0:
                break
            least = r["step"]
        return [] if least is None else [bytes(r["feature"]) for r in sums.where((F.col("pair") == pair) & (F.col("step") >= least)).select("feature").collect()]
    return top(False, head_words), top(True, head_pairs) if max_words > 1 else []


def bucket_gains(styles: DataFrame, targets: DataFrame, description: str, target_description: str, head, buckets: int, max_words: int) -> np.ndarray:
    """Gain of each bucket: 1,000 x the floored log ratio of its smoothed target and corpus shares.

    Totals cover every description. Each task sums its own features by bucket, so at most ``buckets`` rows leave it.
    """

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, sums = Features(*head.value, buckets, max_words), np.zeros((2, buckets), np.int64)
        for part in parts:
            for text, target in zip(part["text"], part["target"]):
                sums[int(target)] += np.bincount(np.array(made.of(words_of(text)), np.int64), minlength=buckets)
        at = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"bucket": at, "s": sums[0, at], "t": sums[1, at]})
    both = (styles.select(text_of(description).alias("text"), F.lit(0).alias("target"))
            .unionByName(targets.select(text_of(target_description).alias("text"), F.lit(1).alias("target"))))
    sums = both.mapInPandas(total, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _noise(key: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel draw, decided by seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample_styles(styles: DataFrame, targets: DataFrame, style_key: str = "style_key", description: str = "description",
                    target_description: str = "description", percent: int = 10, buckets: int = 10_000, max_words: int = 1,
                    least_words: int = 20, seed: int = 2024, head_words: int = 50_000, head_pairs: int = 50_000) -> DataFrame:
    """One row per style description: ``style_key``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Features are all runs of up to ``max_words`` (1 or 2) words, repeats counted, hashed into ``buckets`` by CRC-32. A description's
    ``weight`` is the floored mean gain of its features (none: 0), a bucket's gain the log ratio of its share
    in ``targets`` to its share in all descriptions. ``score`` adds Gumbel noise decided by seed and key: the
    highest scores are a draw without replacement in proportion to the exponential of the weight. Of the descriptions with
    ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn and ranked 1, 2, 3 ...;
    the others have a null rank. Ties go to the smaller key, then to lower counts.

    Frequent words and pairs are counted over all rows and broadcast with their CRC states and buckets (at
    most ``head_words`` and ``head_pairs`` of 64 bytes each); whatever is not among them takes its CRC directly, so the head
    changes the cost only. Null descriptions have no words, null keys draw as the empty key and sort first, repeated rows are
    rows of their own, an empty table gives none, empty targets give every bucket its smoothed share. Long texts are read whole; other columns are ignored.
    """
    if max_words not in (1, 2):
        raise ValueError("max_words is 1 or 2")
    sc = styles.sparkSession.sparkContext
    head = sc.broadcast(frequent_features(styles, description, head_words, head_pairs, max_words))
    gains = sc.broadcast(bucket_gains(styles, targets, description, target_description, head, buckets, max_words))

    @F.pandas_udf("words long, n_features long, weight long")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made, gain = Features(*head.value, buckets, max_words), gains.value
        for texts in parts:
            out = []
            for text in texts:
                words = words_of(text)
                at = np.array(made.of(words), np.int64)
                out.append((len(words), len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
            yield pd.DataFrame(out, columns=["words", "n_features", "weight"])
    rows = styles.select(F.col(style_key).alias("__id"), weigh(text_of(description)).alias("w")).select("__id", "w.*")
    rows = rows.withColumn("score", F.col("weight") + _noise(F.col("__id"), seed)).withColumn("__able", F.col("words") >= least_words)
    ranked = rank_within(rows, ["__able"], ["__id", "n_features", "weight"], -F.col("score"), total="__all")
    drawn = F.col("__able") & (F.col("rank") <= F.floor(F.col("__all") * percent / 100))
    return ranked.select(F.col("__id").alias(style_key), "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))
