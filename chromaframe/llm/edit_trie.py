"""Shared beginnings of page edit histories, as a trie over fixed-width edit ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.llm.base import join_small
from chromaframe.scale import cut_lineage, rank_within

#: Bytes of an edit id: the beginning of a SHA-256, compared as a big-endian number.
WIDTH = 16
#: Edits of a history that one key holds; longer histories go on in the next layer.
CHUNK = 64
#: Keys that one tree holds; a task builds one after another over its sorted keys.
RUN = 20_000
#: Page ids of this range share a row before their digest is made.
DIGEST_BLOCK = 1024
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = ("prefix binary, depth int, edge boolean, id binary, parent binary, parent_low long, above array<binary>, low long, n long, "
        "children long, leaves long, saved long, words long, ends long, end_low long, end_id binary")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def number_edits(edits: DataFrame, page_id: str = "page_id", seq: str = "seq", kind: str = "kind", payload: str = "payload") -> DataFrame:
    """``page``, ``pos`` (1, 2, ...), ``kind``, ``payload``: the edits of each page by ``seq``, null first, then by kind and payload.

    Null kinds and payloads become empty; edits without a page belong to no history and are left out.
    """
    rows = edits.where(F.col(page_id).isNotNull()).select(
        F.col(page_id).cast("long").alias("page"), F.col(seq).alias("seq"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((kind, "kind"), (payload, "payload"))])
    block = F.floor(F.col("seq") / 256)  # a long history is ranked in blocks; null sorts first
    out = rank_within(rows, ["page"], [F.col("seq").asc_nulls_first(), "kind", "payload"], block, rank="pos")
    return out.select("page", "pos", "kind", "payload")


def forked_edits(steps: DataFrame, pages: DataFrame) -> DataFrame:
    """Histories of pages that were forked from a base page: its first ``take`` edits, then the page's own after its first ``take``.

    ``pages`` has ``page``, ``base`` and ``take`` (one row a page). A base with fewer edits lends all it has, an absent one none.
    """
    lens = steps.groupBy(F.col("page").alias("base")).agg(F.max("pos").alias("len"))
    plan = pages.join(lens, "base", "left").withColumn("lent", F.least("take", F.coalesce("len", F.lit(0).cast("long")))).drop("len")
    plan = cut_lineage(plan)
    most = plan.agg(F.max("take")).first()[0] or 0
    first = steps.where(F.col("pos") <= most).withColumnRenamed("page", "base")
    borrowed = plan.where("lent > 0").select("page", "base", "lent").join(first, "base").where(F.col("pos") <= F.col("lent"))
    own = steps.join(plan.select("page", "take", "lent"), "page").where(F.col("pos") > F.col("take"))
    own = own.withColumn("pos", F.col("pos") - F.col("take") + F.col("lent"))
    return borrowed.select("page", "pos", "kind", "payload").unionByName(own.select("page", "pos", "kind", "payload"))


class Small:
    """Children in two parallel lists: layouts of 4 and of 16."""

    __slots__ = ("at", "kids", "most")

    def __init__(self, most: int = 4):
        self.at, self.kids, self.most = bytearray(), [], most

    def get(self, byte: int):
        i = self.at.find(byte)
        return self.kids[i] if i >= 0 else None

    def put(self, byte: int, child):
        i = self.at.find(byte)
        if i >= 0:
            self.kids[i] = child
            return self
        if len(self.kids) == self.most:
            grown = Small(16) if self.most == 4 else Indexed()
            for b, k in zip(self.at, self.kids):
                grown.put(b, k)
            return grown.put(byte, child)
        self.at.append(byte)
        self.kids.append(child)
        return self

    def each(self):
        return self.kids


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("at", "kids")

    def __init__(self):
        self.at, self.kids = bytearray(b"\xff" * 256), []

    def get(self, byte: int):
        i = self.at[byte]
        return self.kids[i] if i != 255 else None

    def put(self, byte: int, child):
        i = self.at[byte]
        if i != 255:
            self.kids[i] = child
            return self
        if len(self.kids) == 48:
            grown = Full()
            for b, i in enumerate(self.at):
                if i != 255:
                    grown.put(b, self.kids[i])
            return grown.put(byte, child)
        self.at[byte] = len(self.kids)
        self.kids.append(child)
        return self

    def each(self):
        return self.kids


class Full:
    """A slot for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, child):
        self.kids[byte] = child
        return self

    def each(self):
        return [k for k in self.kids if k is not None]


class Node:
    """A node with the compressed path that leads to it; ``row`` is the key that ends here."""

    __slots__ = ("path", "slots", "row")

    def __init__(self, path: bytes, row: int | None = None):
        self.path, self.slots, self.row = path, Small(), row


class RadixTree:
    """Adaptive radix tree: path compression, and child layouts that grow from 4 over 16 and 48 to 256."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.row = row
                return
            child = node.slots.get(key[at])
            if child is None:
                node.slots = node.slots.put(key[at], Node(key[at:], row))
                return
            path, rest = child.path, key[at:at + len(child.path)]
            if path != rest:
                same = next((i for i, (a, b) in enumerate(zip(path, rest)) if a != b), len(rest))
                fork = Node(path[:same])
                child.path = path[same:]
                fork.slots = fork.slots.put(child.path[0], child)
                node.slots = node.slots.put(key[at], fork)
                child = fork
            node, at = child, at + len(child.path)


def _digest(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:WIDTH]


def run_nodes(rows: list[dict]) -> list[tuple]:
    """The nodes of one run of sorted distinct keys, as rows of ``NODE``; only depths of whole edits give nodes.

    Every member of a node is in the run unless the node lies on the path of the run's first or last
    key. Such a node is an ``edge``: its counts leave out other edges and are
    completed by the other runs that have it.
    """
    tree, fulls = RadixTree(), [bytes(r["prefix"]) + bytes(r["key"]) for r in rows]
    for i, key in enumerate(fulls):
        tree.insert(key, i)
    last, out = len(rows) - 1, []
    # What a finished subtree tells: first and last row, n, low, plain nodes on top, edges on top, leaves, saved.
    told: dict[int, tuple] = {}
    stack = [(tree.root, 0, False)]
    while stack:
        node, start, seen = stack.pop()
        end = start + len(node.path)
        if not seen:
            stack.append((node, start, True))
            stack.extend((k, end, False) for k in node.slots.each())
            continue
        parts = [told.pop(id(k)) for k in node.slots.each()]
        row = rows[node.row] if node.row is not None else None
        lo = min([p[0] for p in parts] + ([node.row] if row else []), default=0)
        hi = max([p[1] for p in parts] + ([node.row] if row else []), default=last)
        n = sum(p[2] for p in parts) + (row["n"] if row else 0)
        low = min([p[3] for p in parts] + ([row["low"]] if row else []), default=0)
        tops, edges = [t for p in parts for t in p[4]], [t for p in parts for t in p[5]]
        leaves, saved = sum(p[6] for p in parts), sum(p[7] for p in parts)
        for at in range(end - end % WIDTH, max(start, WIDTH), -WIDTH):
            edge, full = lo == 0 or hi == last, fulls[lo]
            ends = row if row and at == end else None
            children = len(tops) + (ends["carry_children"] if ends else 0)
            leaves += ends["carry_leaves"] if ends else 0
            saved += ends["carry_saved"] if ends else 0
            words = int(rows[lo]["words"][at // WIDTH - 2])
            if not edge:
                leaves, saved = max(leaves, 1) if not children else leaves, saved + (n - 1) * words
            me = len(out)
            depth, name = at // WIDTH - 1, _digest(full[:at]) if edge else None
            above = [_digest(full[:a]) for a in range(2 * WIDTH, at, WIDTH)] if edge else None
            out.append([rows[lo]["prefix"], depth, edge, name, above[-1] if above else None, rows[lo]["root_low"] if depth == 1 else 0, above, low, n,
                        children, leaves, saved, words, ends["ends"] if ends else 0, ends["end_low"] if ends else 0, ends["end_id"] if ends else None])
            for t in tops:
                out[t][4], out[t][5] = name, 0 if edge else low
            # An edge keeps its sums to itself; a plain node hands them on.
            tops, edges = ([], [me]) if edge else ([me], [])
            if edge:
                leaves = saved = 0
        told[id(node)] = (lo, hi, n, low, tops, edges, leaves, saved)
    return out


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, held = [c.split()[0] for c in NODE.split(", ")], []

    def made(rows):
        nodes = run_nodes(rows)
        for at in range(0, len(nodes), 10_000):
            yield pd.DataFrame(nodes[at:at + 10_000], columns=names)
    for part in parts:
        for r in part.to_dict("records"):
            held.append(r)
            if len(held) == RUN:
                yield from made(held)
                held = []
    if held:
        yield from made(held)


def layer_nodes(keys: DataFrame) -> DataFrame:
    """Nodes below the prefixes of a layer: ``prefix``, ``depth`` (edits after the prefix) and the counts of whole subtrees.

    ``keys`` has one row for each distinct (prefix, key). Sorted ranges of them become trees run by run;
    nodes on the border of runs (at most two paths each) are then added up, with what lies below them.
    """
    dealt = keys.repartitionByRange("prefix", "key").sortWithinPartitions("prefix", "key")
    nodes = cut_lineage(dealt.mapInPandas(_runs, NODE))
    plain, edge = nodes.where("NOT edge"), nodes.where("edge")
    met = edge.groupBy("id").agg(*[F.first(c).alias(c) for c in ("prefix", "depth", "parent", "above", "words")], F.min("parent_low").alias("root_low"),
                                 *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("low").alias("low"),
                                 *[F.max(c).alias(c) for c in ("ends", "end_low", "end_id")])
    met = cut_lineage(met)
    below = met.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    met = met.join(below, "id", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    lows = cut_lineage(met.select(F.col("id").alias("parent"), F.col("low").alias("up")))
    met = met.withColumns({"leaves": F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long"),
                           "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")})
    met = cut_lineage(met)
    sums = met.select(F.explode(F.concat("above", F.array("id"))).alias("id"), "leaves", "saved").groupBy("id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = met.drop("leaves", "saved").join(sums, "id").withColumn("parent_low", F.col("root_low"))
    columns = ["prefix", "depth", "parent", "parent_low", "low", "n", "children", "leaves", "saved", "ends", "end_low", "end_id"]
    every = plain.select(*columns).unionByName(whole.select(*columns))
    placed = every.where("parent IS NULL").unionByName(
        join_small(every.where("parent IS NOT NULL"), lows, ["parent"], F.xxhash64("prefix", "low", "depth")).withColumn("parent_low", F.col("up")).drop("up"))
    return placed.drop("parent")


def end_digests(ends: DataFrame) -> DataFrame:
    """``end_id`` and the SHA-256 of its comma-joined page ids in ascending order.

    The hash of a list is sequential, so one end's ids pass through one task, in
    order and without being held; blocks of neighbouring ids are joined before they are sent.
    """
    block = F.floor(F.col("page") / DIGEST_BLOCK)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ",")  # at most DIGEST_BLOCK ids
    blocks = ends.groupBy("end_id", block.alias("block")).agg(joined.alias("ids"))

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, made = None, None
        for part in parts:
            done = []
            for end, ids in zip(part["end_id"], part["ids"]):
                if end != name:
                    if made:
                        done.append((name, made.hexdigest()))
                    name, made = end, hashlib.sha256(ids.encode())
                else:
                    made.update(b"," + ids.encode())
            if done:
                yield pd.DataFrame(done, columns=["end_id", "digest"])
        if made:
            yield pd.DataFrame([(name, made.hexdigest())], columns=["end_id", "digest"])
    dealt = blocks.repartition("end_id").sortWithinPartitions("end_id", "block")
    return dealt.select("end_id", "ids").mapInPandas(digest, "end_id binary, digest string")


def _hash16(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * WIDTH))


def edit_trie(steps: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per distinct beginning of the pages' edit histories.

    ``steps`` has ``page`` (a whole number), ``pos`` (1, 2, ... without gaps), ``kind`` and ``payload``; ``pages`` has all
    pages, those without an edit too (by default those of ``steps``). Of every node: ``page_id`` (its smallest member, a
    member being a page whose history starts so), ``depth`` (0: the root, without an edit), ``parent_page_id`` (null at the root), ``n_pages``,
    ``n_children``, ``n_leaves`` (childless nodes in its subtree, itself included), ``saved_tokens`` (over
    its subtree, members less one times words of the last payload) and ``ends_sha256`` (of the comma-joined ids of the pages that end here).
    Null kinds and payloads count as empty, null pages are left out; an empty table gives no rows; other columns are ignored.

    Every edit becomes a 16-byte id. The ids of up to 64 edits are a key; equal keys are counted
    first, and adaptive radix trees over sorted ranges of distinct keys give the nodes. A history longer than that goes on in a
    further layer, under the id of its beginning, as long as it shares it; what a page has alone needs no tree. So a key is bounded,
    however long a history is. Layers are summed from the deepest up.
    """
    rows = steps.where(F.col("page").isNotNull()).select(
        "page", F.floor((F.col("pos") - 1) / CHUNK).cast("long").alias("layer"), "pos",
        _hash16(F.char_length(F.coalesce("kind", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("kind", F.lit("")), F.coalesce("payload", F.lit(""))).alias("edit"),
        word_count(F.coalesce("payload", F.lit(""))).alias("words"))
    each = F.array_sort(F.collect_list(F.struct("pos", F.hex("edit").alias("edit"), "words")))  # at most CHUNK edits
    chunks = rows.groupBy("page", "layer").agg(each.alias("e"), F.max("pos").alias("last"))
    chunks = cut_lineage(chunks.select("page", "layer", "last", F.unhex(F.array_join(F.transform("e", lambda x: x["edit"]), "")).alias("key"),
                                       F.transform("e", lambda x: x["words"]).alias("words")))
    lens = cut_lineage(chunks.groupBy("page").agg(F.max("last").alias("edits")))
    known = (lens.select("page") if pages is None else pages.where(F.col("page").isNotNull()).select(F.col("page").cast("long").alias("page")).distinct())
    known = known.join(lens, "page", "left").withColumn("edits", F.coalesce("edits", F.lit(0).cast("long")))
    known = cut_lineage(known)
    everyone = known.agg(F.min("page").alias("low"), F.count(F.lit(1)).alias("n")).first()

    # Down: who shares a beginning of whole layers goes on together, who is alone leaves.
    live = (chunks.where("layer = 0").join(known, "page")
            .select("page", F.lit(bytes(WIDTH)).alias("prefix"), F.lit(everyone["low"]).cast("long").alias("root_low"), "key", "words", (F.col("edits") > F.col("last")).alias("more")))
    layers, tails, ends = [], [], [known.where("edits = 0").select("page", F.lit(bytes(WIDTH)).alias("end_id"))]
    while True:
        live = cut_lineage(live.withColumn("end_id", _hash16("prefix", "key")))
        if live.isEmpty():
            break
        done = ~F.col("more")
        keys = cut_lineage(live.groupBy("end_id").agg(
            *[F.first(c).alias(c) for c in ("prefix", "key", "words", "root_low")], F.count(F.lit(1)).alias("n"), F.min("page").alias("low"),
            F.count_if(done).alias("ends"), F.coalesce(F.min(F.when(done, F.col("page"))), F.lit(0)).alias("end_low"),
            F.count_if(F.col("more")).alias("onward"), F.max(F.when(F.col("more"), F.col("page"))).alias("only")))
        layers.append(keys)
        ends.append(live.where(done).select("page", "end_id"))
        here = len(layers)
        tails.append(keys.where("onward = 1").select(F.col("only").alias("page"), F.col("end_id").alias("from_id"), F.lit(here).alias("from_layer"), F.col("low").alias("up")))
        together = keys.where("onward > 1").select("end_id", F.col("low").alias("root_low"))
        onward = live.where("more").select("page", "end_id").join(together, "end_id")
        live = (onward.join(chunks.where(F.col("layer") == here), "page").join(known, "page")
                .select("page", F.col("end_id").alias("prefix"), "root_low", "key", "words", (F.col("edits") > F.col("last")).alias("more")))

    # Up: what lies below a layer's last edits counts for the nodes above it.
    columns = ["low", "depth", "parent_low", "n", "children", "leaves", "saved", "ends", "end_low", "end_id"]
    found, carry = [], None
    for number in range(len(layers) - 1, -1, -1):
        alone = tails[number].select(F.col("from_id").alias("end_id"), *[F.lit(v).cast("long").alias(f"carry_{c}") for c, v in (("children", 1), ("leaves", 1), ("saved", 0))])
        carry = alone if carry is None else alone.unionByName(carry)
        keys = layers[number].join(carry, "end_id", "left").withColumns({f"carry_{c}": F.coalesce(f"carry_{c}", F.lit(0).cast("long")) for c in ("children", "leaves", "saved")})
        nodes = cut_lineage(layer_nodes(keys.drop("onward", "only")))
        carry = cut_lineage(nodes.where("depth = 1").groupBy(F.col("prefix").alias("end_id")).agg(
            F.count(F.lit(1)).alias("carry_children"), F.sum("leaves").alias("carry_leaves"), F.sum("saved").alias("carry_saved")))
        found.append(nodes.withColumn("depth", (F.col("depth") + number * CHUNK).cast("long")).select(*columns))
    top = known.agg(F.min("page").alias("low"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("edits") == 0).alias("ends"), F.min(F.when(F.col("edits") == 0, F.col("page"))).alias("end_low"))
    below = (carry if carry is not None else known.limit(0).select(*[F.lit(0).cast("long").alias(f"carry_{c}") for c in ("children", "leaves", "saved")]))
    below = below.agg(*[F.coalesce(F.sum(f"carry_{c}"), F.lit(0)).alias(c) for c in ("children", "leaves", "saved")])
    root = top.where("n > 0").crossJoin(F.broadcast(below)).select(
        "low", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_low"), "n", "children", F.greatest("leaves", F.lit(1)).alias("leaves"), "saved",
        "ends", "end_low", F.lit(bytes(WIDTH)).alias("end_id"))
    found.append(root)
    for t in tails:
        own = chunks.join(t, "page").where(F.col("layer") >= F.col("from_layer")).join(known, "page")
        own = own.select("page", "edits", "up", "from_layer", F.posexplode("words").alias("i", "w"), "layer")
        depth = F.col("layer") * CHUNK + F.col("i") + 1
        is_last = depth == F.col("edits")
        found.append(own.select(
            F.col("page").alias("low"), depth.alias("depth"), F.when(depth == F.col("from_layer") * CHUNK + 1, F.col("up")).otherwise(F.col("page")).alias("parent_low"),
            F.lit(1).cast("long").alias("n"), F.when(is_last, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
            F.when(is_last, 1).otherwise(0).cast("long").alias("ends"), F.when(is_last, F.col("page")).alias("end_low"), F.lit(None).cast("binary").alias("end_id")))
    nodes = reduce(DataFrame.unionByName, found)
    # Most nodes end no page or one.
    many = reduce(DataFrame.unionByName, [e.join(n, "end_id") for e, n in zip(ends, [root.where("ends > 1").select("end_id"), *[k.where("ends > 1").select("end_id") for k in layers]])])
    nodes = join_small(nodes.withColumn("many", F.when(F.col("ends") > 1, F.col("end_id"))), end_digests(many).withColumnRenamed("end_id", "many"), ["many"], F.xxhash64("low", "depth"), "left")
    digest = F.when(F.col("ends") == 0, F.lit(NOTHING)).when(F.col("ends") == 1, F.sha2(F.col("end_low").cast("string"), 256)).otherwise(F.col("digest"))
    return nodes.select(F.col("low").alias("page_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_low").alias("parent_page_id"), F.col("n").alias("n_pages"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"))
