"""The trie of edit histories against a dictionary of beginnings, and the radix tree alone."""

import hashlib
import random

import pytest

from chromaframe.llm import edit_trie as T


def plain(histories):
    """histories: page -> list of (kind, payload)."""
    nodes = {}
    for page, steps in histories.items():
        for d in range(len(steps) + 1):
            nodes.setdefault(tuple(steps[:d]), []).append(page)
    words = lambda s: len([w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in s).split(" ") if w])
    kids = {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * words(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = sorted(m for m in members if len(histories[m]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, histories, pages=None, parts=6):
    rows = [(p, i + 1, k, v) for p, steps in histories.items() for i, (k, v) in enumerate(steps)]
    random.Random(1).shuffle(rows)
    steps = spark.createDataFrame(rows, "page long, pos long, kind string, payload string").repartition(parts)
    known = spark.createDataFrame([(p,) for p in histories], "page long") if pages is None else pages
    return sorted(map(tuple, T.edit_trie(steps, known).collect()), key=str)


def some_histories(seed, n=120, deep=9):
    rnd = random.Random(seed)
    tools = [("brush", "red hair"), ("brush", ""), ("", "brush"), ("fill", "soft  blue\tsky\n"), ("erase", "a b c")]
    out = {i * 7 - 50: [rnd.choice(tools[:2] if rnd.random() < 0.7 else tools) for _ in range(rnd.randrange(0, deep))] for i in range(n)}
    # A third of all pages has one history.
    return out | {5000 + i: [("fill", "base"), ("brush", "red hair"), ("brush", "red hair")] for i in range(n // 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_the_beginnings(spark, seed, monkeypatch):
    histories = some_histories(seed)
    assert run(spark, histories) == plain(histories)
    monkeypatch.setattr(T, "RUN", 5)  # many small trees, so that nearly every node lies on a border
    monkeypatch.setattr(T, "DIGEST_BLOCK", 4)
    assert run(spark, histories) == plain(histories)


def test_long_histories_go_on_in_layers(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    histories = some_histories(3, 40, 14)
    long = [("brush", f"edit {i}") for i in range(20)]
    histories |= {9001: long, 9002: long, 9003: long[:17] + [("fill", "end")], 9004: long[:6], 9005: [("x", str(i)) for i in range(16)]}
    assert run(spark, histories) == plain(histories)


def test_numbering_and_forks(spark):
    edits = [(1, 2, "b", "two"), (1, None, "a", None), (1, 1, None, "one"), (2, 5, "z", "x"), (2, 5, "y", "x"), (None, 1, "k", "v"), (40, 1, "q", "w")]
    df = spark.createDataFrame(edits, "page_id int, seq int, kind string, payload string").selectExpr("*", "'c' AS pos", "'d' AS page", "1 AS rank")
    steps = T.number_edits(df)
    assert sorted(map(tuple, steps.collect())) == [(1, 1, "a", ""), (1, 2, "", "one"), (1, 3, "b", "two"), (2, 1, "y", "x"), (2, 2, "z", "x"), (40, 1, "q", "w")]
    pages = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (40, 30, 1)], "page long, base long, take long")
    forked = T.forked_edits(steps, pages)
    assert sorted(map(tuple, forked.collect())) == [(1, 1, "y", "x"), (1, 2, "z", "x"), (2, 1, "a", ""), (2, 2, "z", "x")]
    got = T.edit_trie(forked, pages.select("page")).where("depth = 0").first()
    assert (got.page_id, got.n_pages, got.n_children, got.ends_sha256) == (1, 3, 2, hashlib.sha256(b"40").hexdigest())


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], "page long, pos long, kind string, payload string")
    assert T.edit_trie(none).count() == 0
    root = T.edit_trie(none, spark.createDataFrame([(4,), (3,)], "page long")).collect()
    assert len(root) == 1 and tuple(root[0])[:7] == (3, 0, None, 2, 0, 1, 0) and root[0].ends_sha256 == hashlib.sha256(b"3,4").hexdigest()


def test_radix_tree_layouts():
    rnd = random.Random(8)
    keys = sorted({bytes([rnd.randrange(256)]) + rnd.randbytes(rnd.randrange(0, 4)) for _ in range(3000)})
    tree = T.RadixTree()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    found, stack, kinds = {}, [(tree.root, b"")], set()
    while stack:
        node, at = stack.pop()
        kinds.add(type(node.slots).__name__)
        if node.row is not None:
            found[at + node.path] = node.row
        stack.extend((k, at + node.path) for k in node.slots.each())
    assert found == {k: i for i, k in enumerate(keys)} and kinds == {"Small", "Indexed", "Full"}
