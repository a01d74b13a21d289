"""Packing style descriptions into token windows, each seed followed by its lexical neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.base import text_of

PIECES = "start long, length long, tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


#: Texts of ASCII and Latin letters fall into the tokenizer's own pieces (contractions, letters, digits, signs), whose ids follow each other.
FAST = re.compile("[\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, piece by piece with a bounded memory of pieces.

    Most texts are cut into the tokenizer's own pieces after lower-casing, as it does itself. Others are cut at
    ASCII white space, which it drops. Either way a text's ids are those of its parts.
    """

    def __init__(self, path: str, end_id: int, remember: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember, self.known = remember, {}
        self.end = int(end_id).to_bytes(4, "little")
        self.mark = next((t.content for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items(), reverse=True) if t.special), None)
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else None
        self.odd = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Words with letters and signs in any order: each between two special tokens."""
        if self.mark:
            plain = [w for w in words if not self.odd.search(w)]
            for at in range(0, len(plain), 4000):
                some = plain[at:at + 4000]
                ids = self._ids(self.mark + self.mark.join(some))
                marks = np.flatnonzero(np.frombuffer(ids, "<u4") == self.mark_id)
                starts, ends = (marks * 4 + 4).tolist(), [*(marks[1:] * 4).tolist(), len(ids)]
                self.known.update((w, ids[a:b]) for w, a, b in zip(some, starts, ends))
        for w in words:
            if w not in self.known:
                self.known[w] = self._ids(w)

    def learn_letters(self, words: list[str]) -> None:
        """Words of small letters: each ends with the token that closes it."""
        for at in range(0, len(words), 4000):
            some = words[at:at + 4000]
            ids = self._ids(" ".join(some))
            ends = ((np.flatnonzero(self.closes[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                self.learn(some)  # a tokenizer with other word ends
                continue
            self.known.update((w, ids[a:b]) for w, a, b in zip(some, [0, *ends], ends))

    def parts(self, text: str) -> list[str]:
        if FAST.fullmatch(text) and not self.odd.search(text):
            return PIECE.findall(text.lower())
        # str.split also cuts at four separators that the tokenizer keeps.
        return re.split("[ \t\n\r\x0b\x0c]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; parts not seen before are encoded together."""
        cut = [self.parts(t) for t in texts]
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        missing = {w for words in cut for w in words if w not in known}
        letters = [w for w in missing if w.isalpha() and FAST.fullmatch(w)]
        self.learn_letters(letters)
        self.learn([w for w in missing if w not in known])
        return [b"".join(map(known.__getitem__, words)) + self.end for words in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def worker_encoder(path: str, end_id: int, remember: int) -> Encoder:
    """One encoder a Python worker: tasks that follow each other keep its words."""
    import sys
    import types

    held = sys.modules.setdefault("chromaframe_worker", types.ModuleType("chromaframe_worker")).__dict__
    name = (path, end_id, remember)
    if name not in held:
        held[name] = Encoder(path, end_id, remember)
    return held[name]


class Lexical:
    """BM25 over the documents of a block; terms are token ids."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, common: float = 0.2):
        self.terms = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(d) for d in docs], float)
        term = np.concatenate([t for t, _ in self.terms]) if docs else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in self.terms])
        tf = np.concatenate([n for _, n in self.terms]).astype(float) if docs else np.zeros(0)
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        top = int(term[-1]) + 2 if len(term) else 1
        self.first = np.searchsorted(term, np.arange(top))
        df = np.diff(self.first)
        self.idf = np.where(df > 0, np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), 0.0)
        self.usable = (df > 1) & (df <= max(2, common * len(docs)))
        self.weight = self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.doc] / max(1.0, sizes.mean()))) if len(term) else tf

    def neighbours(self, seed: int, most_terms: int = 48) -> np.ndarray:
        """Documents that share the seed's rarest terms, best first (ties: in order)."""
        t = self.terms[seed][0]
        t = t[self.usable[t]]
        t = t[np.argsort(-self.idf[t], kind="stable")][:most_terms]
        if not len(t):
            return np.zeros(0, np.int64)
        at = np.concatenate([np.arange(self.first[x], self.first[x + 1]) for x in t])
        score = np.bincount(self.doc[at], self.weight[at], minlength=len(self.terms))
        score[seed] = 0
        best = np.flatnonzero(score)
        return best[np.argsort(-score[best], kind="stable")]


class Windows:
    """Lays documents one after another into windows; ``close`` cuts the rest into powers of two."""

    def __init__(self, window: int, base: int):
        self.window, self.base, self.number, self.open, self.rows = window, base, 0, [], []
        self.filled = 0

    def room(self) -> int:
        return self.window - self.filled

    def add(self, key, ids: np.ndarray) -> bool:
        """True if the document ran over into the next window."""
        at, over = 0, False
        while at < len(ids):
            n = min(len(ids) - at, self.room())
            self.open.append((key, at, ids[at:at + n], len(ids)))
            self.filled += n
            at += n
            if self.filled == self.window:
                self._emit(self.open, self.window)
                self.open, self.filled, over = [], 0, at < len(ids)
        return over

    def _emit(self, pieces, size: int) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), total, self.base + self.number, offset, size, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.number += 1

    def close(self) -> None:
        pieces, left = self.open, self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            taken, need = [], size
            while need:
                key, start, ids, total = pieces[0]
                n = min(need, len(ids))
                taken.append((key, start, ids[:n], total))
                pieces = pieces[1:] if n == len(ids) else [(key, start + n, ids[n:], total), *pieces[1:]]
                need -= n
            self._emit(taken, size)
            left -= size
        self.open, self.filled = [], 0

    def take(self) -> list:
        rows, self.rows = self.rows, []
        return rows


def pack_block(keys: list, docs: list[np.ndarray], windows: Windows) -> None:
    """Lay out a block: a seed, then its unused neighbours until the window is full.

    A document that runs over opens the next window and is its seed.
    """
    index, used, free, seed = Lexical(docs), np.zeros(len(docs), bool), 0, None
    while True:
        if seed is None:
            while free < len(docs) and used[free]:
                free += 1
            if free == len(docs):
                return
            seed, used[free] = free, True
            windows.add(keys[seed], docs[seed])
        chosen, seed_next = index.neighbours(seed), None
        for d in chosen[~used[chosen]]:
            used[d] = True
            if windows.add(keys[d], docs[d]):
                seed_next = int(d)
                break
            if windows.filled == 0:
                break
        seed = seed_next


def pack_styles(styles: DataFrame, tokenizer_path: str, style_key: str = "style_key", description: str = "description", window: int = 4096,
                end_id: int = 2, shard_bytes: int = 24 << 20, block_tokens: int = 1_500_000, block_docs: int = 4096,
                remember: int = 450_000) -> DataFrame:
    """Descriptions cut into pieces of token sequences: one row per piece.

    Returns ``style_key``, ``start`` (tokens of its document before the piece), ``length``,
    ``tokens`` (of the document, end token included), ``sequence_id``, ``offset`` (within the
    sequence), ``sequence_tokens`` and ``ids`` (little-endian 32-bit). Null texts count as empty and have
    the end token alone; repeated rows and keys are documents of their own; other columns are ignored; a key column called like
    a result column comes back with ``_key`` behind its name;
    an empty table gives no rows.

    Shards are ranges of a hash of the text's first word of seven letters or more, and then of the key: copies of a text
    mostly meet, lengths do not matter, and one frequent word is still split. A shard is read in blocks of at most
    ``block_tokens`` tokens or ``block_docs`` texts (and one text more), each with its own inverted index;
    the open window goes on into the next block. A shard's last window is cut into powers of two,
    which need no padding. Sequence numbers start from the shard's number times 2^32. A Python worker remembers the ids
    of about ``remember`` parts of texts, also after its task; fewer cost time and spare memory.
    """
    rows = styles.select(F.col(style_key).alias("key"), text_of(description).alias("text"))
    # Only the dealing uses this; whatever it is, every token is packed. The first long word is found early in a text, and
    # its hash, unlike a largest or smallest word, does not depend on how long the text is.
    rows = rows.withColumns({"__word": F.xxhash64(F.regexp_extract("text", r"\p{L}{7,}", 0)), "__mix": F.xxhash64("key", "text")})
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    shards = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "__word", "__mix").sortWithinPartitions("__word", "__mix", "key")
    key_type = rows.schema["key"].dataType.simpleString()
    # Whole numbers travel as text: one null among them would make pandas round the others.
    as_text = isinstance(rows.schema["key"].dataType, (T.IntegralType, T.DecimalType))
    passed = "string" if as_text else key_type

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, windows = worker_encoder(tokenizer_path, end_id, remember), Windows(window, TaskContext.get().partitionId() << 32)

        def handfuls(part):
            """Texts of about a million characters at a time, and one text more."""
            sizes = part["text"].str.len()
            for _, some in part.groupby((sizes.cumsum() - sizes) // 1_000_000):
                yield some
        names = ["key", *[c.split()[0] for c in PIECES.split(", ")]]
        keys, docs, held = [], [], 0

        def ready():
            done = windows.take()
            for at in range(0, len(done), 2000):
                yield pd.DataFrame(done[at:at + 2000], columns=names)
        for part in parts:
            for some in handfuls(part):
                for key, ids in zip(some["key"], encoder.encode_all(list(some["text"]))):
                    keys.append(None if pd.isna(key) else key)
                    docs.append(np.frombuffer(ids, "<u4"))
                    held += len(docs[-1])
                    if held >= block_tokens or len(docs) >= block_docs:
                        pack_block(keys, docs, windows)
                        keys, docs, held = [], [], 0
                        yield from ready()
        pack_block(keys, docs, windows)
        windows.close()
        yield from ready()
    out = shards.select(F.col("key").cast(passed).alias("key"), "text").mapInPandas(pack, f"key {passed}, {PIECES}")
    pieces = [c.split()[0] for c in PIECES.split(", ")]
    return out.select(F.col("key").cast(key_type).alias(f"{style_key}_key" if style_key in pieces else style_key), *pieces)
