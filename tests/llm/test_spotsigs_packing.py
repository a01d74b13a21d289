import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaframe.llm.packing import Encoder, Lexical, pack_styles
from chromaframe.llm.queries import tokenizer_path
from chromaframe.llm.spotsigs import fingerprint_against, fingerprint_files, jaccard, likeness, partition_of, signatures, with_next


def test_signatures_and_likeness(spark):
    text = "the quick line of the page is drawn with a soft brush and the ink stays dark in every panel of the book"
    assert len(signatures(None)) == len(signatures(" .. ")) == 0 and len(signatures("brush")) == 1
    assert len(signatures("only content words here")) > 0 or len(signatures("panel brush line")) > 0
    a, b = signatures(text), signatures(text + " where it ends")
    assert jaccard(a, a) == 1 and 0.6 < jaccard(a, b) < 1 and jaccard(a, b, 0.99) == 0 and jaccard(a[:0], a) == 0 and jaccard(a[:0], a[:0]) == 1
    assert all(abs(partition_of(n) - partition_of(m)) <= 1 for n in range(1, 300) for m in range(int(n * 0.8 + 0.999), n))
    df = spark.createDataFrame([("a", text, text), ("b", None, ""), ("c", text * 2000, text), ("d", text, "")], "path string, text string, fingerprint string")
    two = fingerprint_files(fingerprint_files(df.withColumnRenamed("fingerprint", "other")), "other", "fp2")
    got = {r.path: r for r in two.withColumn("near", likeness(F.col("fingerprint"), F.col("fp2"))).collect()}
    assert got["a"].near == 1 and got["a"].fingerprint == got["d"].fingerprint and got["b"].near == 1 and got["d"].near == 0
    both = {r.path: r for r in fingerprint_against(df.withColumnRenamed("fingerprint", "other"), "text", ("other", "text")).collect()}
    assert all(both[p].fingerprint == got[p].fingerprint and both[p].against[0].near == got[p].near and both[p].against[1].near == 1 for p in got)
    assert fingerprint_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_with_next(spark, n):
    rng = random.Random(n)
    keys = rng.sample(range(-50, 100_000), n)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "key long, text string").repartition(5)
    order = sorted(keys)
    want = {k: f"t{order[(i + 1) % n]}" for i, k in enumerate(order)}
    assert {r.key: r.next_text for r in with_next(df, "key", "text").collect()} == want


def test_with_next_empty_null_and_ties(spark):
    df = spark.createDataFrame([(None, "n"), (3, "b"), (3, "a"), (4, None)], "key long, text string")
    got = sorted((str(r.key), str(r.text), r.next_text) for r in with_next(df, "key", "text").collect())
    assert got == [("3", "a", "b"), ("3", "b", ""), ("4", "None", "n"), ("None", "n", "a")]
    assert with_next(df.limit(0), "key", "text").count() == 0


def test_encoder_equals_tokenizer():
    rng, tk = random.Random(2), Tokenizer.from_file(tokenizer_path())
    enc = Encoder(tokenizer_path(), 2, remember=50)
    signs = ["the", "Page's", "é", "é", " ", "　", "\x1c", "\x85", " ", "\n", "<|endoftext|>", "<|", "12", "!?", "İ", "Σ", "色", "🎨", "​", "ß", "'s"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == [*tk.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_encoder_learns_words_of_many_texts_together():
    plain = Tokenizer.from_file(tokenizer_path())
    enc = Encoder(tokenizer_path(), 2, remember=3)
    texts = ["", "  ", "One two", "two<|endoftext|>three one", "It's\x1cISN'T\u00a0so", "\u00c9a\u0301 \u4f60\u597d", "One two"]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode_all(texts)]
        assert got == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert enc.encode_all([]) == []


def test_neighbours_share_rare_terms():
    docs = [np.array(d) for d in ([1, 2, 3, 9], [4, 5, 9], [3, 2, 9, 7], [8, 9], [6, 9], [10, 9])]
    assert Lexical(docs).neighbours(0)[0] == 2 and 0 not in Lexical(docs).neighbours(0)


def test_packing_round_trip(spark):
    rng = random.Random(5)
    words = [f"tone{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 900))) for _ in range(120)] + [None, "", "same", "same", " ".join(words * 60)]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)] + [(3, "again", "x")], "style_key long, description string, tokens string")
    tk = Tokenizer.from_file(tokenizer_path())
    want = sorted([*tk.encode(t or "", add_special_tokens=False).ids, 2] for t in [*texts, "again"])
    for size in (24 << 20, 100_000):
        rows = pack_styles(df, tokenizer_path(), shard_bytes=size, block_tokens=20_000).collect()
        docs, seqs = defaultdict(list), defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
            docs[r.style_key, r.tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
            assert r.length == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) >= 0
        for pieces in seqs.values():
            assert [p[0] for p in sorted(pieces)] == [0, *np.cumsum([p[1] for p in sorted(pieces)])[:-1].tolist()]
            total = sum(p[1] for p in pieces)
            assert total == pieces[0][2] and (total == 4096 or total & (total - 1) == 0)
        got = []
        for (_, total), pieces in docs.items():
            ids = [x for _, part in sorted(pieces, key=lambda p: p[0]) for x in part]
            got += [ids[i:i + total] for i in range(0, len(ids), total)]
        assert sorted(got) == want
    assert pack_styles(df.limit(0), tokenizer_path()).count() == 0


def test_names_that_clash(spark):
    from chromaframe.llm.simhash import similar_styles
    rows = [(2 ** 60 + i, None if i == 1 else f"text number {i} of the table", i, "g") for i in range(6)] + [(None, "lone", 7, "g")]
    df = spark.createDataFrame(rows, "style_key long, description string, part int, guest string").selectExpr("*", "style_key AS start", "style_key AS fp", "'old' AS next_text")
    led = with_next(df, "style_key", "description").orderBy("style_key").collect()
    assert [r.next_text for r in led][:2] == ["text number 0 of the table", ""] and [r.part for r in led] == [7, 0, 1, 2, 3, 4, 5]
    packed = pack_styles(df, tokenizer_path(), "start")
    assert "start_key" in packed.columns and {r.start_key for r in packed.collect()} == {r[0] for r in rows}
    alike = similar_styles(df, "fp")
    assert alike.columns == ["fp_key", "fp", "component_id"] and {r.fp_key for r in alike.collect()} == {r[0] for r in rows}
