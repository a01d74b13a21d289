"""SpotSigs fingerprints of audited files, and their likeness."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.base import shuffle_width, text_of

# Common words of English, German, French and Spanish.
ANCHORS = frozenset("""a about after all also an and are as at be been but by can could for from had has have he her his in into is it its
no not of on one only or other she so than that the their them then there these they this to was we were what when which who will with would you
als am auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie sind und von war
wie wird zu zum zur au aux avec ce ces dans de du elle est et il la le les leur ne nous par pas plus pour qu que qui sa se ses son sont sur un
une vous al como con cual del desde el ella en entre era esta este ha hay las lo los más muy para pero por sin sobre su sus y ya""".split())
CHAIN = 2
GAP = 8


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's spot signatures.

    Each common word anchors the chain of the next two words that are not common. A word with
    no common word among the eight before it is an anchor too, so texts without any have signatures.
    """
    import re
    import zlib

    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return np.zeros(0, np.uint32)
    known: dict[str, int] = {}
    code = np.fromiter((known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for w in words), np.uint64, len(words))
    common = np.fromiter((w in ANCHORS for w in words), bool, len(words))
    content, at = np.flatnonzero(~common), np.arange(len(words))
    last = np.maximum.accumulate(np.where(common, at, -GAP - 1))
    anchors = at[common | (at - last > GAP)]
    after = np.searchsorted(content, anchors, side="right")
    follows = (after < len(content)) | ~common[anchors]
    anchors, after = anchors[follows], after[follows]
    if not len(anchors):
        anchors, after = at, np.full(len(at), len(content))
    chained = np.append(code[content], np.zeros(1, np.uint64))  # a chain may end with the text
    h = code[anchors]
    for step in range(CHAIN):
        h = (h ^ chained[np.minimum(after + step, len(chained) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def partition_of(size: int, threshold: float = 0.8) -> int:
    """Sets whose Jaccard can reach the threshold differ by one partition at most: bounds grow by its inverse."""
    return 0 if size <= 0 else 1 + int(np.floor(np.log(size) / np.log(1 / threshold) + 1e-9))


def jaccard(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without comparing where their sizes keep it below ``floor``. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < floor * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    value = both / (small + large - both)
    return value if value >= floor else 0.0


def written(s: np.ndarray) -> str:
    """Length partition, then the signature set: ``p<partition>:<8 hex digits each, ascending>``."""
    return f"p{partition_of(len(s))}:{s.astype('>u4').tobytes().hex()}"


@F.pandas_udf(T.StringType())
def spot_fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([written(signatures(t)) for t in texts], dtype=object)


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two fingerprints (0 to 1), pruned below ``floor`` by partition, then by length; null if one is null."""
    @F.pandas_udf(T.DoubleType())
    def compare(left: pd.Series, right: pd.Series) -> pd.Series:
        def parse(f):
            return np.frombuffer(bytes.fromhex(f.partition(":")[2]), ">u4").astype(np.uint32)

        def one(x, y):
            if x is None or y is None:
                return None
            if x == y:
                return 1.0
            if floor >= 0.8 and abs(int(x[1:x.index(":")]) - int(y[1:y.index(":")])) > 1:
                return 0.0
            return jaccard(parse(x), parse(y), floor)
        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")
    return compare(a, b)


def fingerprint_files(files: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Audited files with the SpotSigs fingerprint of their whole text.

    Equal texts have equal fingerprints; null counts as empty, whose set is empty. Row by row:
    ties and repeated rows change nothing; a column named like ``fingerprint`` is replaced.
    """
    return files.withColumn(fingerprint, spot_fingerprint(text_of(text)))


def fingerprint_against(files: DataFrame, text: str, others: Sequence[str], floor: float = 0.0,
                        shown: Sequence[str] | None = None) -> DataFrame:
    """Audited files with the ``fingerprint`` of ``text``, and ``against``: fingerprint and likeness of each other text.

    Like ``fingerprint_files`` and ``likeness`` on every pair, but each text is read once and no
    fingerprint travels back to be compared; with ``shown``, only the texts named there give theirs. Null texts count as empty, texts of any length
    are read whole, repeated rows stay, an empty table gives none. Columns named like the new ones are replaced.
    """
    near = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("near", T.DoubleType())])
    kind = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("against", T.ArrayType(near))])

    show = [shown is None or o in shown for o in others]

    @F.pandas_udf(kind)
    def compare(own: pd.Series, rest: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, *other in zip(own, *(rest[c] for c in rest.columns)):
            s, sets = signatures(t), [signatures(o) for o in other]
            out.append((written(s), [{"fingerprint": written(o) if seen else None, "near": jaccard(s, o, floor)} for o, seen in zip(sets, show)]))
        return pd.DataFrame(out, columns=kind.names)
    keep = [c for c in files.columns if c not in kind.names]
    made = compare(text_of(text), F.struct(*[text_of(o).alias(f"o{i}") for i, o in enumerate(others)]))
    return files.withColumn("__made", made).select(*keep, "__made.*")


def range_part(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are not above the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    at_most = lambda vals: F.size(F.filter(vals, lambda b: b <= key))
    coarse = at_most(F.array(*[F.lit(c[0]) for c in chunks]))
    fine = F.get(F.array(*[F.array(*[F.lit(v) for v in c]) for c in chunks]), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + at_most(fine))


def with_next(files: DataFrame, key: str, text: str, name: str = "next_text") -> DataFrame:
    """Each row with the text of the next row by ``key`` (a whole number) and text; the last has the first row's.

    Rows are dealt to ranges of keys, bounded by approximate quantiles; the first key of a range
    visits the range before too, so each range is a window of its own and texts are
    shuffled once. A null key stands before all others. The one row of a table is its own next.
    A column named like ``name`` is replaced; an empty table gives no rows.
    """
    parts = 2 * shuffle_width(files)
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    quantiles = files.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"]
    bounds = sorted(set(quantiles or []))
    own = files.withColumn("__order", order).withColumn("__part", range_part(F.col("__order"), bounds).cast("int"))
    # One row per range: at most twice the shuffle width.
    firsts = {r["p"]: r["f"] for r in own.groupBy(F.col("__part").alias("p")).agg(F.min("__order").alias("f")).collect()}
    present = sorted(firsts)
    before = {firsts[p]: present[i - 1] for i, p in enumerate(present)}  # the first range's goes to the last
    guest = F.lit(None).cast("int")
    for first, part in before.items():
        guest = F.when(F.col("__order") == first, F.lit(part)).otherwise(guest) if len(before) <= 8 else guest
    if len(before) > 8:
        guest = F.try_element_at(F.create_map(*[F.lit(v) for pair in before.items() for v in pair]), F.col("__order")).cast("int")
    seats = F.array(F.struct(F.col("__part").alias("__seat"), F.lit(False).alias("__guest")), F.struct(guest.alias("__seat"), F.lit(True).alias("__guest")))
    dealt = own.select(*files.columns, "__order", F.inline(F.filter(seats, lambda s: s["__seat"].isNotNull())))
    # A guest comes after its host range, also where the first row visits the last.
    turn = W.partitionBy("__seat").orderBy("__guest", "__order", text)
    # The plain column is led: an expression would travel through the shuffle beside it.
    keep = [c for c in files.columns if c != name]
    return dealt.withColumn("__next", F.lead(text).over(turn)).where("NOT __guest").select(*keep, F.coalesce("__next", F.lit("")).alias(name))
