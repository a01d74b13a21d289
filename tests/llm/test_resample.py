"""Resampling of style descriptions against a plain statement of the rule."""

import hashlib
import math
import random
import re
import zlib

import pytest

from chromaframe.llm.resample import Features, resample_styles, words_of


def plain(styles, targets, percent, buckets, max_words, least, seed):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        runs = [" ".join(words[i:i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]
    s, t = [0] * buckets, [0] * buckets
    for _, text in styles:
        for b in features(text)[1]:
            s[b] += 1
    for text in targets:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in styles:
        n, at = features(text)
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = [(*r[:4], i + 1 if i < percent * len(able) // 100 else None) for i, r in enumerate(able)]
    return sorted(drawn + [(*r[:4], None) for r in rows if not r[4]], key=str)


def some_styles(n, seed):
    rnd = random.Random(seed)
    vocab = ["Warm", "cool", "hair", "ÜBER", "Ära", "sky_9", "x", "skin-tone", "日本", "éclair", "a" * 90, "tint", "42"]
    words = lambda: " ".join(rnd.choice(vocab[:4] if rnd.random() < 0.4 else vocab) for _ in range(rnd.randrange(0, 40)))
    return [(i, words()) for i in range(n)]


@pytest.mark.parametrize("max_words", [1, 2])
def test_draw_equals_the_plain_rule(spark, max_words):
    styles = some_styles(150, 5)
    styles += [(3, styles[3][1]), (3, "other text " * 15), (900, None), (901, ""), (None, "warm hair " * 12), (902, "warm sky " * 20_000), (903, styles[7][1])]
    targets = ["warm hair and warm SKIN tone", None, "", "éclair tint"]
    df = spark.createDataFrame(styles, "style_key long, description string").repartition(4)
    # Columns named like inner ones are ignored.
    df = df.selectExpr("*", "'r' AS rank", "1 AS score", "2 AS words", "3 AS __id")
    goal = spark.createDataFrame([(t,) for t in targets], "description string")
    for head in (3, 1000):
        got = resample_styles(df, goal, percent=30, buckets=64, max_words=max_words, least_words=10, seed=9, head_words=head, head_pairs=head)
        assert got.columns == ["style_key", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(styles, targets, 30, 64, max_words, 10, 9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "style_key long, description string")
    some = spark.createDataFrame([(1, "a b c"), (2, "d")], "style_key long, description string")
    assert resample_styles(none, some).count() == 0
    rows = resample_styles(some, none, percent=100, least_words=1, buckets=16).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2]
    with pytest.raises(ValueError):
        resample_styles(some, some, max_words=3)


def test_head_and_tail_agree():
    words = words_of("the Red hair the red sky ÄÖ 9")
    whole = Features(words, [b"the red", b"red hair"], 1000, 2).of(words)
    assert whole == Features([], [], 1000, 2).of(words) == [zlib.crc32(w) % 1000 for w in words] + [zlib.crc32(a + b" " + b) % 1000 for a, b in zip(words, words[1:])]
