"""File listings: unique names, inventories, fragments, stale entries, catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.scale import cut_lineage, rank_within, sum_before

_GROUP = ["folder", "stem", "ext"]


def _suffixed(n: Column) -> Column:
    return F.concat(F.col("stem"), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit("")), F.col("ext"))


def _nth_free(requests: DataFrame, taken: DataFrame, width: int) -> DataFrame:
    """Give the k-th request of a name its k-th free number.

    With the taken numbers t_1 < t_2 < ..., it is k plus how many i have t_i - i < k. That
    count is a rank in the union of both lists, so no name is handled in one task.
    """
    req = rank_within(requests, _GROUP, ["seq"], F.floor(F.col("seq") / width), "k")
    t = rank_within(taken, _GROUP, ["n"], F.floor(F.col("n") / width), "i")
    marks = (req.select(*_GROUP, F.col("k").alias("at"), F.lit(0).alias("kind"), "k", "seq")
             .unionByName(t.select(*_GROUP, (F.col("n") - F.col("i")).alias("at"), F.lit(1).alias("kind"),
                                   F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("seq"))))
    ranked = rank_within(marks, _GROUP, ["at", "kind"], F.floor(F.col("at") / width), "pos").where("kind = 0")
    return ranked.select(*_GROUP, "seq", F.col("pos").alias("n"))


def unique_names(requests: DataFrame, taken: DataFrame, width: int = 65_536) -> DataFrame:
    """A name per request that overwrites nothing: stem, stem_2, stem_3, ... in ``seq`` order.

    ``requests``: folder, stem, ext, seq (unique). ``taken``: folder, name. A generated
    name that meets another stem's name goes to the earlier request; the other moves on.
    """
    base = requests.select(*_GROUP, F.col("seq").cast("long").alias("seq"))
    # A taken name reads as a stem alone or as a stem with a number, for each suffix asked for in its folder.
    suffixes = base.select("folder", "ext").distinct()
    names = taken.select("folder", "name").distinct().join(suffixes, "folder").where(F.col("name").endswith(F.col("ext")))
    body = F.expr("substring(name, 1, length(name) - length(ext))")
    number = r"^(.*)_([2-9]|[1-9][0-9]{1,17})$"
    plain = F.struct(F.col("__body").alias("stem"), F.lit(1).cast("long").alias("n"))
    numbered = F.when(F.col("__body").rlike("(?s)" + number), F.struct(
        F.regexp_extract("__body", "(?s)" + number, 1).alias("stem"), F.regexp_extract("__body", "(?s)" + number, 2).cast("long").alias("n")))
    read = names.withColumn("__body", body).select("folder", "ext", F.inline(F.filter(F.array(plain, numbered), lambda v: v.isNotNull())))
    hit = read.join(base.select(*_GROUP).distinct(), _GROUP)
    used = cut_lineage(hit.select(*_GROUP, "n").distinct())
    while True:  # every round fixes the earliest contested request of each name
        named = cut_lineage(_nth_free(base, used, width).withColumn("name", _suffixed(F.col("n"))))
        # Equal names come from different stems only; the earliest request keeps one.
        owner = named.groupBy("folder", "name").agg(F.min("seq").alias("__first"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
        lost = cut_lineage(named.join(owner, ["folder", "name"]).where("seq > __first").select(*_GROUP, "n").distinct())
        if lost.isEmpty():
            return named.select("folder", "stem", "ext", "seq", "name")
        used = cut_lineage(used.unionByName(lost).distinct())


def artifact_inventory(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Expected against present: exists, size, ready. ``specs``: key, filename, min_bytes."""
    f = files.groupBy("filename").agg(F.max("size").alias("size"))
    return specs.join(f, "filename", "left").select(
        "key", "filename", F.col("size").isNotNull().alias("exists"), F.coalesce("size", F.lit(0)).alias("size"),
        (F.col("size").isNotNull() & (F.coalesce("size", F.lit(0)) >= F.col("min_bytes"))).alias("ready"),
        F.round(F.coalesce("size", F.lit(0)) / 1048576, 2).alias("size_mb"))


def missing_artifacts(inventory: DataFrame) -> DataFrame:
    return inventory.where(~F.col("ready")).select("key")


def total_size_mb(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.round(F.coalesce(F.sum("size_mb"), F.lit(0.0)), 2).alias("total_mb"))


def content_digests(spark, path: str) -> DataFrame:
    """SHA-256 and size of every file under a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


#: Characters of encoded text in a piece: a multiple of four, so that every piece decodes on its own.
PIECE = 4 * 49_152


def _fragments(parts: DataFrame, keys: Sequence[str], name: str, body: str) -> DataFrame:
    """Numbered fragments without white space; other names are no fragments."""
    d = parts.withColumn("__n", F.regexp_extract(name, r"([0-9]+)\.b64$", 1)).where("__n <> ''")
    clean = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\s+", "")
    return d.select(*keys, F.col("__n").cast("long").alias("__n"), F.col(name).alias("__name"), clean.alias("__b"))


def chunk_pieces(parts: DataFrame, keys: Sequence[str] = ("payload_id",), name: str = "name", body: str = "body",
                 max_bytes: int | None = None, piece: int = PIECE) -> DataFrame:
    """The payloads of numbered base64 fragments as ordered pieces: keys, ``piece``, ``offset``, ``encoded``, ``bytes``.

    Fragments follow each other by number, then by name. A fragment's place in its payload is a sum over the fragments
    before, taken in blocks of numbers; the text is cut at multiples of ``piece`` (a multiple of four)
    characters and each piece decoded alone, so neither a row nor a task ever holds a payload. ``offset`` counts decoded bytes.
    ``bytes`` is null where a piece is no base64; padding is only right at the very end. Payloads over ``max_bytes`` encoded bytes give no pieces.
    """
    if piece % 4 or piece <= 0:
        raise ValueError("piece is a positive multiple of four")
    keys = list(keys)
    d = _fragments(parts, keys, name, body)
    total = d.groupBy(*keys).agg(F.sum(F.char_length("__b")).alias("__all"), F.sum(F.octet_length("__b")).alias("__size"))
    if max_bytes is not None:
        total = total.where(F.col("__size") <= max_bytes)
    at = sum_before(d, keys, ["__n", "__name", "__b"], F.floor(F.col("__n") / 1024), F.char_length("__b"), "__from").where("__b <> ''")
    end = F.col("__from") + F.char_length("__b")
    at = at.select(*keys, "__from", "__b", F.explode(F.sequence(F.floor(F.col("__from") / piece), F.floor((end - 1) / piece))).alias("piece"))
    start = F.greatest(F.col("piece") * piece - F.col("__from"), F.lit(0))
    stop = (F.col("piece") + 1) * piece - F.col("__from")
    cut = at.select(*keys, "piece", (F.col("__from") + start).alias("__from"), F.substring("__b", (start + 1).cast("int"), (stop - start).cast("int")).alias("__b"))
    # At most ``piece`` characters meet here.
    text = cut.groupBy(*keys, "piece").agg(F.expr("listagg(__b, '') WITHIN GROUP (ORDER BY __from)").alias("encoded"))
    text = text.join(total, keys)
    last = F.col("piece") == F.floor((F.col("__all") - 1) / piece)
    sound = F.when(last, F.col("encoded").rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.char_length("encoded") % 4 == 0)).otherwise(F.col("encoded").rlike("^[A-Za-z0-9+/]*$"))
    return text.select(*keys, "piece", (F.col("piece") * (piece // 4 * 3)).alias("offset"), "encoded", F.when(sound, F.unbase64("encoded")).alias("bytes"))


def reassemble_chunks(parts: DataFrame, keys: Sequence[str] = ("payload_id",), name: str = "name", body: str = "body",
                      max_bytes: int | None = None, piece: int = PIECE) -> DataFrame:
    """One row per payload of numbered fragments: ``fragments``, ``bytes`` (encoded), ``pieces``, ``encoded``, ``decoded_bytes``, ``state``.

    ``encoded`` is the whole text, which the 2 GB of a string bound (``chunk_pieces`` is the form without that limit). ``state`` is
    ok, not decodable, or oversized (over ``max_bytes``: not gathered, ``encoded`` is null). An empty payload is ok.
    """
    keys = list(keys)
    size = _fragments(parts, keys, name, body).groupBy(*keys).agg(F.sum(F.octet_length("__b")).alias("bytes"), F.count(F.lit(1)).alias("fragments"))
    found = chunk_pieces(parts, keys, name, body, max_bytes, piece).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pieces"), F.expr("listagg(encoded, '') WITHIN GROUP (ORDER BY piece)").alias("encoded"), F.sum(F.octet_length("bytes")).alias("__decoded"), F.count_if(F.col("bytes").isNull()).alias("__bad"))
    out = size.join(found, keys, "left")
    over = F.lit(False) if max_bytes is None else F.col("bytes") > max_bytes
    state = F.when(over, "oversized").when(F.col("__bad") > 0, "not decodable").otherwise("ok")
    decoded = F.when(state == "ok", F.coalesce("__decoded", F.lit(0)).cast("long"))
    text = F.when(~over, F.coalesce("encoded", F.lit("")))
    return out.select(*keys, "fragments", "bytes", F.coalesce("pieces", F.lit(0).cast("long")).alias("pieces"), text.alias("encoded"), decoded.alias("decoded_bytes"), state.alias("state"))


# Patterns of abandoned cache entries and their age limit in hours.
STALE_PATTERNS = (r"_session_cache_", r"_pages_")
STALE_HOURS = 24


def expire_stale(entries: DataFrame, now: Column, hours: int = STALE_HOURS, patterns: Sequence[str] = STALE_PATTERNS,
                 name: str = "name", modified: str = "modified") -> DataFrame:
    """Entries of the known patterns older than the age limit at ``now``."""
    known = F.lit(False)
    for p in patterns:
        known = known | F.col(name).rlike(p)
    return entries.where(known & (F.col(modified) < now - F.expr(f"INTERVAL {max(1, hours)} HOURS")))


def catalog_list(files: DataFrame, name: str = "filename", body: str = "body", suffix: str = ".ccstyle") -> DataFrame:
    """Sorted listing; the display name falls back to the stem of an unreadable or unnamed body."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    shown = F.coalesce(F.get_json_object(body, "$.name"), stem)
    return files.where(F.col(name).endswith(suffix)).select(name, shown.alias("display_name")).orderBy(name)
