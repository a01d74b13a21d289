"""Which download sources to take: rules first, then a character language model of the addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.llm.base import UPPER, LOWER, join_small
from chromaframe.scale import cut_lineage

ALLOW, BLOCK = "allow", "block"
#: Start and end of an address in the model.
START, END = "\x02", "\x03"
#: A character that no context has seen has this probability.
FLOOR = 1.0 / 256.0
#: Log ratios count in millionths, so that sums are whole numbers; the threshold in thousandths.
MICRO, BIN = 1_000_000, 1_000
#: Every fifth labelled address (by hash) calibrates the threshold, the others fit the models.
PARTS = 5

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits: its host or a subdomain, and a path that starts with its own."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _windows(text: Column, order: int) -> Column:
    """For each character and the end mark: the ``order`` characters that end with it."""
    chars = F.regexp_extract_all(F.concat(F.lit(START * (order - 1)), text, F.lit(END)), F.lit("(?s)."), F.lit(0))
    # The outer lambda holds the characters, so that they are cut once per text.
    held = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - order), lambda i: F.concat(*[F.get(c, i + k) for k in range(order)])))
    return F.get(held, F.lit(0))


def _parts(window: Column, order: int) -> Column:
    """The grams that end a window (``g1`` ...) and their contexts (``c1`` ...), by length of the gram."""
    each = []
    for k in range(1, order + 1):
        gram = F.substring(window, order - k + 1, k)
        each += [F.struct(F.lit(f"g{k}").alias("part"), gram.alias("gram")),
                 F.struct(F.lit(f"c{k}").alias("part"), F.substring(window, order - k + 1, k - 1).alias("gram"))]
    return F.array(*each)


def _log_ratio(counts: Column, order: int, strength: float) -> Column:
    """Millionths of ln P(accepted) - ln P(rejected) of a window's last character.

    Each order is smoothed by the one below; a context that was never seen leaves the lower order as it is.
    """
    accepted, rejected = F.lit(FLOOR), F.lit(FLOOR)
    for k in range(1, order + 1):
        gram, context = counts[f"g{k}"], counts[f"c{k}"]
        n = lambda c, side: F.coalesce(c[side], F.lit(0)).cast("double")
        accepted = (n(gram, "a") + F.lit(strength) * accepted) / (n(context, "a") + F.lit(strength))
        rejected = (n(gram, "r") + F.lit(strength) * rejected) / (n(context, "r") + F.lit(strength))
    return F.round((F.log(accepted) - F.log(rejected)) * F.lit(float(MICRO))).cast("long")


def address_scores(texts: DataFrame, order: int = 5, strength: float = 2.0) -> DataFrame:
    """``text`` and ``score`` of every row of ``texts`` (text, a, r, fit) outside the fit.

    ``a`` and ``r`` count the accepted and rejected rows of an address; those of the fit
    teach two Markov models of up to ``order`` - 1 preceding characters. ``score`` is the floored mean log
    ratio of a text's characters, in millionths. The models are tables that grow with the input: windows are counted,
    their grams and contexts summed, and only the distinct windows that some text needs are scored.
    """
    seen = (texts.where("fit").select("a", "r", F.explode(_windows(F.col("text"), order)).alias("w"))
            .groupBy("w").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    grams = (seen.select("a", "r", F.explode(_parts(F.col("w"), order)).alias("p"))
             .groupBy("p.part", "p.gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    asked = cut_lineage(texts.where("NOT fit").select("text").distinct())
    places = asked.select("text", F.explode(_windows(F.col("text"), order)).alias("w"))
    need = places.select("w").distinct().select("w", F.explode(_parts(F.col("w"), order)).alias("p")).select("w", "p.part", "p.gram")
    met = join_small(need, grams, ["part", "gram"], F.col("w"), "left", max_rows=200_000)
    held = met.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("a", "r")))).alias("m"))  # 2 x order entries
    ratios = held.select("w", _log_ratio(F.col("m"), order, strength).alias("ratio"))
    scored = join_small(places, ratios, ["w"], F.col("text"), max_rows=200_000)
    return scored.groupBy("text").agg(F.floor(F.sum("ratio") / F.count(F.lit(1))).cast("long").alias("score"))


def calibrated_threshold(scored: DataFrame) -> DataFrame:
    """One row, ``least``: the lowest score, in thousandths, that is accepted.

    ``scored`` has ``score`` and the accepted and rejected rows ``a`` and ``r``. Of all bins, the one that parts the two
    best (share of accepted kept less share of rejected kept; ties: nearest zero, then lower); the threshold lies
    half way to the next lower bin. Without rows of both kinds it is zero. Scores are counted in at most 60,001 bins before they meet.
    """
    at = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-30_000)), F.lit(30_000)).cast("long")
    bins = scored.groupBy(at.alias("bin")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    pair = F.struct("bin", "a", "r")
    one = bins.agg(F.sort_array(F.collect_list(pair), asc=False).alias("bins"), F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"),
                     F.lit(None).cast("struct<gain:double,near:bigint,low:bigint,bin:bigint>").alias("best"))

    def step(s, b):
        a, r = s["a"] + b["a"], s["r"] + b["r"]
        gain = F.try_divide(a, F.col("all_a")) - F.try_divide(r, F.col("all_r"))  # null without rows of both kinds
        now = F.struct(gain.alias("gain"), (-F.abs(b["bin"])).alias("near"), (-b["bin"]).alias("low"), b["bin"].alias("bin"))
        return F.struct(a.alias("a"), r.alias("r"), F.when(s["best"].isNull() | (now > s["best"]), now).otherwise(s["best"]).alias("best"))
    one = one.withColumn("best", F.aggregate("bins", start, step, lambda s: s["best"]["bin"]))
    below = F.array_max(F.filter(F.transform("bins", lambda b: b["bin"]), lambda b: b < F.col("best")))
    least = F.coalesce(F.floor((F.col("best") + below + 1) / 2), F.col("best"))
    return one.select(F.when((F.col("all_a") > 0) & (F.col("all_r") > 0), least).otherwise(F.lit(0)).cast("long").alias("least"))


def judge_sources(downloads: DataFrame, rules: Sequence[Rule], source_url: str = "source_url", order: int = 5, strength: float = 2.0,
                  default: str = ALLOW) -> DataFrame:
    """Download records with ``host``, ``path``, ``rule``, ``verdict`` and ``score``.

    ``rules`` is a short list of (verdict, host, path) that is written into the plan; a rule fits its host and all
    subdomains when the address's path starts with the rule's, and the longest decides. Addresses under
    a rule are the examples: two smoothed variable-order character models, of accepted and of rejected ones, give every
    other address a length-normalised log-likelihood difference (``score``, millionths per character; null
    under a rule), and a threshold calibrated on a fifth of the examples decides. The models read the address
    from its host on, without the scheme; an address without ``://`` is read whole.

    Null and empty addresses have empty host and path and no rule, and are judged like an empty
    text. Without accepted or without rejected examples for the fit, ``default`` is the verdict. Repeated
    addresses are scored once and keep their rows; an empty table gives none. Columns named like the new
    ones are replaced. Long addresses are read whole.
    """
    new = ("host", "path", "rule", "verdict", "score")
    keep = [c for c in downloads.columns if c not in new]
    url = F.col(source_url).cast("string")
    rows = downloads.withColumn("__url", url).withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    rows = rows.withColumn("__rule", matching_rule(F.col("__host"), F.col("__path"), rules))
    after = F.regexp_extract(F.col("__url"), r"^(?s).*?://[^/?#]*(.*)$", 1)
    text = F.when(F.col("__url").contains("://"), F.concat("__host", after)).otherwise(F.coalesce("__url", F.lit("")))
    rows = rows.withColumn("__text", text)
    label = F.col("__rule.verdict")
    examples = rows.groupBy(F.col("__text").alias("text"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    own = lambda v: F.when(F.col("label") == v, F.col("n")).otherwise(F.lit(0)).cast("long")
    part = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % PARTS
    texts = cut_lineage(examples.select("text", own(ALLOW).alias("a"), own(BLOCK).alias("r"), F.col("label").isNull().alias("asked"),
                                        (F.col("label").isNotNull() & (part != 0)).alias("fit")))
    scores = cut_lineage(address_scores(texts, order, strength))
    held_out = texts.where("NOT asked AND NOT fit").join(scores, "text")
    known = texts.where("fit").agg(F.coalesce((F.sum("a") > 0) & (F.sum("r") > 0), F.lit(False)).alias("known"))
    # One row of two values.
    decision = calibrated_threshold(held_out).crossJoin(F.broadcast(known))
    asked = texts.where("asked").select("text").join(scores, "text").crossJoin(F.broadcast(decision))
    said = F.when(~F.col("known"), F.lit(default)).when(F.floor(F.col("score") / BIN) >= F.col("least"), F.lit(ALLOW)).otherwise(F.lit(BLOCK))
    asked = asked.select(F.col("text").alias("__text"), said.alias("__said"), "score")
    free = label.isNull()
    out = rows.select(*keep, "__host", "__path", "__rule", F.when(free, F.col("__text")).alias("__text")).join(asked, "__text", "left")
    return out.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"),
                      F.coalesce(label, "__said").alias("verdict"), "score")
