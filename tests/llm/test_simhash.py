import random

import numpy as np
import xxhash

from chromaframe.llm.simhash import DIRECT, fingerprint_links, one_per_component, similar_styles


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = " ".join(f"tone{rng.randrange(500)}" for _ in range(600))
    rows = [(1, base), (2, base.upper()), (3, base + " hue"), (4, "plain flat fill"), (5, None), (6, "  "), (7, "two words"), (8, "two words"),
            (9, "Ürban É" * 3), (10, " ".join(f"x{rng.randrange(90)}" for _ in range(5000)))]
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "style_key long, description string, component_id string")
    got = {r.style_key: (r.fp, r.component_id) for r in similar_styles(df).collect()}
    prints = {k: brute_print(t) for k, t in rows}
    assert {k: v[0] for k, v in got.items()} == {k: signed(v) for k, v in prints.items()}
    near = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2
    low = {k: k for k in prints}
    for _ in prints:
        low = {k: min(low[m] for m in prints if near(k, m)) for k in prints}
    assert {k: v[1] for k, v in got.items()} == low
    assert got[2][1] == 1 and got[6][1] == 5 and got[8][1] == 7
    kept = one_per_component(df)
    assert kept.columns == df.columns and {r.style_key for r in kept.collect()} == set(low.values())


def test_links_equal_brute_force(spark):
    rng = random.Random(9)
    crowd = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 3, 7, (1 << 64) - 1}
    values |= {crowd ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(4))) for _ in range(4 * DIRECT)}
    values |= {v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for v in list(values)[:200]}
    v = np.array(sorted(values), dtype=np.uint64)
    want = {tuple(sorted((signed(int(a)), signed(int(b))))) for i, a in enumerate(v) for b in v[i + 1:] if int(a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(signed(int(x)),) for x in v], "fp long")
    for direct in (DIRECT, 4):
        assert {(r.a, r.b) for r in fingerprint_links(df, direct).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "style_key long, description string")
    assert similar_styles(df).count() == 0 and one_per_component(df).count() == 0
