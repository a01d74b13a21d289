"""The operators over the given tables: each query maps a table to an operator and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaframe.llm.edit_trie import edit_trie, forked_edits, number_edits
from chromaframe.llm.exact import exact_groups
from chromaframe.llm.language import fit_languages, mixed_languages
from chromaframe.llm.mixing import mix_styles
from chromaframe.llm.packing import pack_styles
from chromaframe.llm.resample import resample_styles
from chromaframe.llm.secrets import BASE, confirm_secrets
from chromaframe.llm.shards import shard_pages
from chromaframe.llm.simhash import fingerprint_hex, similar_styles
from chromaframe.llm.sources_filter import ALLOW, BLOCK, judge_sources
from chromaframe.llm.spotsigs import fingerprint_against, with_next
from chromaframe.llm.toxicity import fit_lexicon, sample_labels, score_styles
from chromaframe.llm.wrappers import extract_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", f"""
WITH n AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text", keep="last")
    return out.withColumnRenamed("body_sha256", "text_sha256")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shard_pages(docs, "doc_id", (1.0,) * 16, (1.0,) * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: The five named sources count twice; every other source has the weight 1.
MIX_WEIGHTS = {f"src{i}": 2.0 for i in range(5)}
MIX_SEED = 17

MIX_SQL = f"""
WITH RECURSIVE w AS (
  SELECT source, count(*) AS n, CAST(CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 2.0 ELSE 1.0 END AS DOUBLE) AS weight
  FROM documents GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * CAST((SELECT sum(n) FROM w) AS DOUBLE) / n AS rate FROM w),
p AS (SELECT source, greatest(CAST(ceil(rate / CAST(8.0 AS DOUBLE)) AS INT), 1) AS parts, rate FROM r),
cdf AS (
  SELECT source, 0 AS k, rate / parts AS lam, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM p
  UNION ALL
  SELECT source, k + 1, lam, p * lam / (k + 1), c + p * lam / (k + 1) FROM cdf WHERE k < 63),
u AS (
  SELECT doc_id, d.source, part, CAST(CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(part AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)
         / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(generate_series(1, p.parts)) AS part)),
t AS (SELECT doc_id, u.source, CAST(count(*) AS BIGINT) AS times FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND u.u >= cdf.c GROUP BY doc_id, u.source),
x AS (SELECT doc_id, source, CAST(unnest(generate_series(0, times - 1)) AS INT) AS copy FROM t)
SELECT x.doc_id, x.source, copy, substr(md5('{MIX_SEED}-place:' || coalesce(CAST(x.doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)), 1, 16) AS place,
  sha256(coalesce(text, '')) AS text_sha256 FROM x JOIN documents d ON d.doc_id = x.doc_id"""


@query("op6_mixing", MIX_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are repeated and shuffled; a digest tells what has arrived."""
    mixed = mix_styles(table(spark, sf_dir, "documents"), MIX_WEIGHTS, 1.0, "doc_id", "source", seed=MIX_SEED)
    return mixed.select("doc_id", "source", "copy", "place", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_styles(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = confirm_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("doc_id", "findings")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    line = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def _crc_part(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_crc_part(3) != 1).select("doc_id", "toxic").where("toxic IS NOT NULL")
    # About 20,000 labels of each class, the fit's own bound: texts stay where they are.
    labels = sample_labels(labels, "doc_id", "toxic", 20_000)
    lexicon = fit_lexicon(docs.join(F.broadcast(labels), "doc_id"), "doc_id", "text", "toxic")
    out = score_styles(docs, lexicon, "text")
    return out.select("doc_id", (_crc_part(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(_crc_part(4) != 2), "text", "lang", "doc_id")
    out = mixed_languages(docs.drop("lang"), model, "text")
    return out.select("doc_id", (_crc_part(4) == 2).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    docs = docs.withColumn("edited", edited)
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256))
    docs = fingerprint_against(docs, "text", ("edited", "next_text"), shown=("edited",))
    return docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("against")[0]["fingerprint"].alias("edited_fingerprint"),
                       F.col("against")[0]["near"].alias("near_edited"), F.col("against")[1]["near"].alias("near_next"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_styles(table(spark, sf_dir, "documents"), tokenizer_path(), "doc_id", "text")
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
                      "sequence_id", "offset", "sequence_tokens")


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "html", "text")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: DuckDB has no CRC-32: the table of the polynomial, then the bytes of a hexadecimal text one by one.
CRC_SQL = """crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_sql(word: str) -> str:
    """Unsigned CRC-32 of a text in UTF-8; ``crc`` (t) must be in scope."""
    octets = f"list_transform(range(1, length({word}_hex) // 2 + 1), lambda i: CAST('0x' || substr({word}_hex, 2 * i - 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])))"


RESAMPLE_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
w AS (SELECT word, hex(encode(word)) AS word_hex FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
k AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM w, crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
g AS (
  SELECT i AS bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000))::DOUBLE
                                           / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))::DOUBLE)) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON i = s.bucket LEFT JOIN t ON i = t.bucket),
x AS (SELECT row, sum(n) AS n, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY row),
v AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (row)),
r AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS pos, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM v)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN able AND pos <= 10 * n // 100 THEN pos END::BIGINT AS rank FROM r"""


@query("op11_resampling", RESAMPLE_SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_styles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text",
                           percent=10, buckets=10_000, max_words=1, least_words=20, seed=2024)


URL_RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))


def _ratio_sql(order: int = 5, strength: float = 2.0) -> str:
    """ln P(accepted) - ln P(rejected) of a window's last character, from the joined counts of its grams and contexts."""
    def side(s: str) -> str:
        p = "(1.0::DOUBLE / 256.0::DOUBLE)"
        for k in range(1, order + 1):
            p = f"((coalesce(g{k}.{s}, 0)::DOUBLE + {strength}::DOUBLE * {p}) / (coalesce(c{k}.{s}, 0)::DOUBLE + {strength}::DOUBLE))"
        return p
    return f"CAST(round((ln({side('a')}) - ln({side('r')})) * 1000000.0::DOUBLE) AS BIGINT)"


_ORDERS = range(1, 6)
_GRAMS = ",\n".join(f"g{k} AS (SELECT substr(w, {6 - k}, {k}) AS gram, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1),\n"
                    f"c{k} AS (SELECT substr(w, {6 - k}, {k - 1}) AS gram, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1)" for k in _ORDERS)
_MET = " ".join(f"LEFT JOIN g{k} ON g{k}.gram = substr(w, {6 - k}, {k}) LEFT JOIN c{k} ON c{k}.gram = substr(w, {6 - k}, {k - 1})" for k in _ORDERS)
_RULES_SQL = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in URL_RULES)

URL_SQL = f"""
WITH rules AS ({_RULES_SQL}),
u AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT row, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS label
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row),
l AS (SELECT u.*, rule, label, CASE WHEN contains(url, '://') THEN host || regexp_extract(url, '^(?s).*?://[^/?#]*(.*)$', 1) ELSE url END AS text FROM u LEFT JOIN m USING (row)),
texts AS (
  SELECT text, label IS NULL AS asked, sum(CASE WHEN label = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN label = 'block' THEN 1 ELSE 0 END) AS r,
         label IS NOT NULL AND CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 5 <> 0 AS fit
  FROM l GROUP BY text, label),
ch AS (SELECT text, asked, fit, a, r, repeat(chr(2), 4) || text || chr(3) AS padded FROM texts),
win AS (SELECT text, asked, fit, a, r, unnest(list_transform(range(1, length(text) + 2), lambda i: substr(padded, i, 5))) AS w FROM ch),
seen AS (SELECT w, sum(a) AS a, sum(r) AS r FROM win WHERE fit GROUP BY w),
{_GRAMS},
places AS (SELECT DISTINCT text FROM texts WHERE NOT fit),
pw AS (SELECT text, unnest(list_transform(range(1, length(text) + 2), lambda i: substr(repeat(chr(2), 4) || text || chr(3), i, 5))) AS w FROM places),
ratios AS (SELECT w, {_ratio_sql()} AS ratio FROM (SELECT DISTINCT w FROM pw) {_MET}),
scores AS (SELECT text, CAST(floor(sum(ratio)::DOUBLE / count(*)::DOUBLE) AS BIGINT) AS score FROM pw JOIN ratios USING (w) GROUP BY text),
bins AS (SELECT greatest(least(CAST(floor(score / 1000.0::DOUBLE) AS BIGINT), 30000), -30000) AS bin, sum(a) AS a, sum(r) AS r
         FROM texts JOIN scores USING (text) WHERE NOT asked AND NOT fit GROUP BY 1),
cut AS (SELECT bin, sum(a) OVER w::DOUBLE / nullif((SELECT sum(a) FROM bins), 0)::DOUBLE - sum(r) OVER w::DOUBLE / nullif((SELECT sum(r) FROM bins), 0)::DOUBLE AS gain
        FROM bins WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
best AS (SELECT bin FROM cut WHERE gain IS NOT NULL ORDER BY gain DESC, abs(bin), bin LIMIT 1),
least_bin AS (SELECT coalesce((SELECT coalesce(floor((bin + (SELECT max(bin) FROM bins WHERE bins.bin < best.bin) + 1) / 2.0), bin) FROM best), 0) AS b),
known AS (SELECT coalesce(sum(a) > 0 AND sum(r) > 0, false) AS known FROM texts WHERE fit)
SELECT page_id, host, path, rule,
       coalesce(label, CASE WHEN NOT known THEN 'allow' WHEN floor(score / 1000.0::DOUBLE) >= b THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN label IS NULL THEN score END AS score
FROM l LEFT JOIN scores USING (text), least_bin, known"""


@query("op12_url_filter", URL_SQL)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_sources(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, "url")
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


TRIE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS id, hex(encode(CAST(conv_id AS VARCHAR))) AS id_hex FROM t),
p AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("id")} % 4 AS take FROM ids, crc),
q AS (SELECT p.*, least(take, coalesce(len, 0)) AS lent FROM p LEFT JOIN (SELECT conv_id AS base, max(pos) AS len FROM t GROUP BY conv_id) USING (base)),
s AS (
  SELECT q.conv_id, t.pos, turn, words FROM q JOIN t ON t.conv_id = base AND pos <= lent
  UNION ALL
  SELECT q.conv_id, t.pos - take + lent, turn, words FROM q JOIN t ON t.conv_id = q.conv_id AND pos > take),
chain AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node, 0::BIGINT AS words FROM q
  UNION ALL
  SELECT chain.conv_id, s.pos, sha256(node || turn), s.words FROM chain JOIN s ON s.conv_id = chain.conv_id AND s.pos = chain.depth + 1),
ends AS (SELECT conv_id, max_by(node, depth) AS node FROM chain GROUP BY conv_id),
n AS (SELECT node, min(depth) AS depth, min(conv_id) AS low, count(*) AS n, any_value(words) AS words FROM chain GROUP BY node),
up AS (SELECT DISTINCT c.node, b.node AS parent FROM chain c JOIN chain b ON c.conv_id = b.conv_id AND c.depth = b.depth + 1),
kids AS (SELECT parent AS node, count(*) AS kids FROM up GROUP BY parent),
anc AS (SELECT n.node, chain.node AS top FROM n JOIN chain ON chain.conv_id = n.low AND chain.depth <= n.depth),
sums AS (SELECT top AS node, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * words) AS saved
         FROM anc JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY top),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM ends GROUP BY node)
SELECT n.low AS conv_id, n.depth, m.low AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM n LEFT JOIN up USING (node) LEFT JOIN n m ON m.node = up.parent LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node LEFT JOIN e ON e.node = n.node"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = number_edits(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    page = F.col("page")
    pages = steps.select("page").distinct().select("page", (page - page % 20).alias("base"), (F.crc32(page.cast("string")) % 4).alias("take"))
    out = edit_trie(forked_edits(steps, pages), pages)
    return out.select(F.col("page_id").alias("conv_id"), "depth", F.col("parent_page_id").alias("parent_conv_id"), F.col("n_pages").alias("n_convs"),
                      "n_children", "n_leaves", "saved_tokens", "ends_sha256")
