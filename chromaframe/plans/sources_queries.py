"""Queries over sources, documents and file listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.plans.registry import query
from chromaframe.sources import files as FS
from chromaframe.sources import pages as PG
from chromaframe.sources import projects as PJ


@query("natural_order", """
WITH p AS (SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS f FROM pages)
SELECT page_id, folder, array_to_string([CASE WHEN regexp_matches(z, '^[0-9]') THEN '0' || lpad(CAST(length(regexp_replace(z, '^0+([0-9])', '\\1')) AS VARCHAR), 4, '0') || regexp_replace(z, '^0+([0-9])', '\\1')
  ELSE '1' || lower(z) END for z in regexp_extract_all(f, '([0-9]+|[^0-9]+)')], '|') AS natural_key FROM p""")
def _(t):
    return PG.natural_order(t.pages, "url").select("page_id", "folder", F.concat_ws("|", "natural_key").alias("natural_key"))


_ARRIVALS = "SELECT o_orderkey AS seq, CAST(o_custkey AS INT) AS page_key FROM orders"


@query("register_new", f"""
WITH i AS ({_ARRIVALS}), e AS (SELECT DISTINCT CAST(l_suppkey * 10 AS INT) AS page_key FROM lineitem)
SELECT page_key, min(seq) AS seq FROM i WHERE page_key NOT IN (SELECT page_key FROM e) GROUP BY 1""")
def _(t):
    incoming = t.orders.selectExpr("o_orderkey AS seq", "CAST(o_custkey AS INT) AS page_key")
    return PG.register_new(t.lineitem.selectExpr("CAST(l_suppkey * 10 AS INT) AS page_key"), incoming, "page_key", "seq")


@query("remove_pages", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return PG.remove_pages(t.customer, gone, "c_custkey").select("c_custkey")


def _project_tables(t):
    c = t.conversations
    pages = c.select(F.col("conv_id").alias("project_id"), F.col("turn").cast("int").alias("page_ord"),
                     F.concat(F.lit("/books/"), F.col("conv_id"), F.lit("/page_"), F.col("turn"), F.lit(".png")).alias("path"),
                     F.when(F.col("turn") % 2 == 0, F.lit("ai.png")).alias("ai_result"),
                     F.create_map(F.lit("text"), F.col("text")).alias("diagnostics"),
                     F.create_map((F.col("turn") * 7).cast("string"), (F.col("conv_id") % 24).cast("int")).alias("forced_character_matches"))
    hints = c.select(F.col("conv_id").alias("project_id"), F.col("turn").cast("int").alias("page_ord"),
                     F.when(F.col("role") == "user", "manual").otherwise("auto").alias("kind"),
                     F.explode(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int"))).alias("hint_ord"), "text").select(
        "project_id", "page_ord", "kind", "hint_ord", (F.col("hint_ord") / 4.0).alias("x_norm"), F.lit(0.5).alias("y_norm"),
        F.array(F.lit(1), F.lit(2), F.length("text") % 256).alias("rgb"), F.lit("manual").alias("source"))
    chars = c.groupBy(F.col("conv_id").alias("project_id"), (F.col("turn") % 2).cast("int").alias("char_id")).agg(
        F.concat(F.lit("c"), F.count(F.lit(1))).alias("name"), F.create_map(F.lit("hair"), F.lit("#112233")).alias("colors"))
    settings = c.groupBy(F.col("conv_id").alias("project_id")).agg(F.lit("turns").alias("key"), F.max("turn").cast("string").alias("value"))
    return pages, hints, chars, settings


def _docs(t):
    pages, hints, chars, settings = _project_tables(t)
    return PJ.save_project(pages, hints, chars, settings)


@query("save_project", """
WITH c AS (SELECT conv_id AS project_id, count(*) AS n, max(turn) AS m, min(turn) AS f FROM conversations GROUP BY 1)
SELECT project_id, n AS pages, '/books/' || project_id || '/page_' || f || '.png' AS first_path, CAST(m AS VARCHAR) AS turns, '3' AS version FROM c""")
def _(t):
    d = _docs(t)
    at = lambda p: F.get_json_object("body", p)
    return d.select("project_id", F.json_array_length(at("$.pages")).cast("long").alias("pages"), at("$.pages[0].path").alias("first_path"),
                    at("$.settings.turns").alias("turns"), at("$.version").alias("version"))


@query("load_project_pages", """
SELECT conv_id AS project_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS page_ord, '/books/' || conv_id || '/page_' || turn || '.png' AS path,
  CASE WHEN turn % 2 = 0 THEN '/base/' || conv_id || '/ai.png' END AS ai_result, text FROM conversations""")
def _(t):
    d = PJ.load_project(_docs(t), base=F.concat(F.lit("/base/"), F.col("project_id")))["pages"]
    return d.select("project_id", "page_ord", "path", "ai_result", F.try_element_at("diagnostics", F.lit("text")).alias("text"))


@query("load_project_children", """
WITH c AS (SELECT conv_id AS project_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS page_ord FROM conversations),
h AS (SELECT *, CAST(unnest(generate_series(0, turn % 3)) AS INT) AS hint_ord FROM c)
SELECT 'hint' AS part, project_id, page_ord, hint_ord AS a, CAST(length(text) % 256 AS INT) AS b FROM h
UNION ALL SELECT 'forced', project_id, page_ord, CAST(turn * 7 AS INT), CAST(project_id % 24 AS INT) FROM c
UNION ALL SELECT 'character', conv_id, NULL, CAST(turn % 2 AS INT), CAST(count(*) AS INT) FROM conversations GROUP BY conv_id, turn % 2""")
def _(t):
    d = PJ.load_project(_docs(t))
    nil = F.lit(None).cast("int")
    hints = d["hints"].select(F.lit("hint").alias("part"), "project_id", "page_ord", F.col("hint_ord").alias("a"), F.get("rgb", F.lit(2)).alias("b"))
    forced = d["forced"].select(F.lit("forced").alias("part"), "project_id", "page_ord", F.col("anchor_id").alias("a"), F.col("char_id").alias("b"))
    chars = d["characters"].select(F.lit("character").alias("part"), "project_id", nil.alias("page_ord"), F.col("char_id").alias("a"),
                                   F.substring("name", 2, 9).cast("int").alias("b"))
    return hints.unionByName(forced).unionByName(chars)


_PIECES = """
c AS (SELECT conv_id AS project_id, turn, role, text FROM conversations),
h AS (SELECT project_id, CAST(unnest(generate_series(0, turn % 3)) AS INT) AS hint_ord FROM c),
pt AS (SELECT project_id, 'pages' AS part, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT project_id, 'hints', count(*) FROM h GROUP BY 1
  UNION ALL SELECT project_id, 'characters', count(DISTINCT turn % 2) FROM c GROUP BY 1 UNION ALL SELECT project_id, 'settings', 1 FROM c GROUP BY 1),
pc AS (SELECT project_id, part, unnest(range(CAST(ceil(n / 3.0) AS BIGINT))) AS piece, n FROM pt)"""


@query("project_pieces", f"""
WITH {_PIECES}
SELECT project_id, part, piece, CAST(least(3, n - 3 * piece) AS BIGINT) AS "rows", 'ok' AS state FROM pc
UNION ALL SELECT project_id, 'manifest', 0, CAST(sum(n) AS BIGINT), 'ok' FROM pt GROUP BY project_id""")
def _(t):
    pieces = PJ.save_pieces(*_project_tables(t), size=3)
    return pieces.join(PJ.piece_states(pieces), "project_id").select("project_id", "part", "piece", "rows", "state")


@query("load_project_pieces", """
WITH c AS (SELECT conv_id AS project_id, turn, role, text FROM conversations), h AS (SELECT *, CAST(unnest(generate_series(0, turn % 3)) AS INT) AS hint_ord FROM c)
SELECT 'page' AS part, project_id, CAST(turn AS INT) AS a, CAST(turn * 7 AS INT) AS b, CAST(project_id % 24 AS DOUBLE) AS v, '/books/' || project_id || '/page_' || turn || '.png' AS s,
  text || CASE WHEN turn % 2 = 0 THEN 'ai.png' ELSE '' END AS t FROM c
UNION ALL SELECT 'hint', project_id, CAST(turn AS INT), hint_ord, hint_ord / CAST(4 AS DOUBLE) + 0.5 * (length(text) % 256), CASE WHEN role = 'user' THEN 'manual' ELSE 'auto' END, 'manual' FROM h
UNION ALL SELECT 'character', project_id, CAST(turn % 2 AS INT), CAST(count(*) AS INT), 0, 'c' || count(*), '#112233' FROM c GROUP BY project_id, turn % 2
UNION ALL SELECT 'setting', project_id, NULL, NULL, 0, 'turns', CAST(max(turn) AS VARCHAR) FROM c GROUP BY project_id""")
def _(t):
    tables = _project_tables(t)
    ddl = lambda d: ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in d.schema if f.name != "project_id")
    d = PJ.load_pieces(PJ.save_pieces(*tables, size=3), dict(zip(("pages", "hints", "characters", "settings"), map(ddl, tables))))
    nil, none = F.lit(None).cast("int"), F.lit(0.0)
    anchor = F.map_keys("forced_character_matches")[0]
    pages = d["pages"].select(F.lit("page").alias("part"), "project_id", F.col("page_ord").alias("a"), anchor.cast("int").alias("b"),
                              F.map_values("forced_character_matches")[0].cast("double").alias("v"), F.col("path").alias("s"),
                              F.concat(F.try_element_at("diagnostics", F.lit("text")), F.coalesce("ai_result", F.lit(""))).alias("t"))
    hints = d["hints"].select(F.lit("hint").alias("part"), "project_id", F.col("page_ord").alias("a"), F.col("hint_ord").alias("b"),
                              (F.col("x_norm") + F.col("y_norm") * F.get("rgb", F.lit(2))).alias("v"), F.col("kind").alias("s"), F.col("source").alias("t"))
    chars = d["characters"].select(F.lit("character").alias("part"), "project_id", F.col("char_id").alias("a"), F.substring("name", 2, 9).cast("int").alias("b"), none.alias("v"),
                                   F.col("name").alias("s"), F.try_element_at("colors", F.lit("hair")).alias("t"))
    settings = d["settings"].select(F.lit("setting").alias("part"), "project_id", nil.alias("a"), nil.alias("b"), none.alias("v"), F.col("key").alias("s"), F.col("value").alias("t"))
    return pages.unionByName(hints).unionByName(chars).unionByName(settings)


_GRID = """
g AS (SELECT page_id, CAST(i % 32 AS INT) AS x, CAST(i // 32 AS INT) AS y FROM (SELECT DISTINCT page_id FROM px) p, range(1024) r(i)),
full_px AS (SELECT g.page_id, g.x, g.y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM g LEFT JOIN px ON px.page_id = g.page_id AND px.x = g.x AND px.y = g.y)"""
_GRAY = "CAST(floor((299 * r + 587 * full_px.g + 114 * b + 500) / 1000.0) AS INT) AS gray, r, full_px.g AS g, b"


@query("explode_pixels", f"WITH {_GRID} SELECT page_id, x, y, {_GRAY} FROM full_px")
def _(t):
    return PG.explode_pixels(PG.pack_pixels(t.px, 32, 32))


def _containers(t):
    """Raw rasters of four pages each; every seventh page has no header, which hides those behind it, and some last ones are cut short."""
    raw = F.concat(F.encode(F.lit("P6\n# page\n32 32\n255\n"), "US-ASCII"), F.col("image.data"))
    cut = F.when(F.col("page_id") % 7 == 5, F.concat(F.encode(F.lit("lost"), "US-ASCII"), raw)).when(F.col("page_id") % 12 == 3, F.substring(raw, 1, 2000)).otherwise(raw)
    page = PG.pack_pixels(t.px.select("page_id", "x", "y", F.col("b").alias("r"), "g", F.col("r").alias("b")), 32, 32).select("page_id", cut.alias("raw"))  # a raster has red first
    files = page.groupBy(F.floor(F.col("page_id") / 4).alias("file")).agg(F.array_sort(F.collect_list(F.struct("page_id", "raw"))).alias("p"))
    body = F.aggregate(F.col("p"), F.unhex(F.lit("")), lambda acc, v: F.concat(acc, v["raw"]))
    return files.select(F.col("file").cast("string").alias("path"), F.col("p")["page_id"].alias("pages"), body.alias("content"))


_READ = f"""{_GRID},
pg AS (SELECT page_id, page_id // 4 AS file, row_number() OVER (PARTITION BY page_id // 4 ORDER BY page_id) - 1 AS nth FROM (SELECT DISTINCT page_id FROM px) z),
bad AS (SELECT file, min(nth) AS first_bad, arg_min(CASE WHEN page_id % 7 = 5 THEN 'no raster' ELSE 'cut short' END, nth) AS reason FROM pg WHERE page_id % 7 = 5 OR page_id % 12 = 3 GROUP BY file)"""


@query("read_rasters", f"WITH {_READ} SELECT full_px.page_id, x, y, {_GRAY} FROM full_px JOIN pg ON full_px.page_id = pg.page_id LEFT JOIN bad ON bad.file = pg.file WHERE nth < coalesce(first_bad, 9)")
def _(t):
    files = _containers(t)
    good, _ = PG.read_rasters(files)
    names = files.select("path", F.posexplode("pages").alias("nth", "page_id"))
    return PG.explode_pixels(good.join(names, ["path", "nth"]))


@query("rejected_rasters", f"WITH {_READ} SELECT CAST(file AS VARCHAR) AS path, CAST(first_bad AS INT) AS nth, reason FROM bad")
def _(t):
    return PG.read_rasters(_containers(t))[1].select("path", "nth", "reason")


@query("migrate_style", """
SELECT c_custkey, CASE WHEN coalesce(nullif(c_custkey % 6, 0), 1) < 4 THEN 4 ELSE CAST(c_custkey % 6 AS INT) END AS version,
  CASE WHEN c_custkey % 5 = 0 THEN 0.5 WHEN coalesce(nullif(c_custkey % 6, 0), 1) < 4 THEN 0.2 END AS ambience,
  CASE WHEN c_custkey % 7 = 0 THEN 9 WHEN coalesce(nullif(c_custkey % 6, 0), 1) < 4 THEN 0 END AS revision,
  CASE WHEN coalesce(nullif(c_custkey % 6, 0), 1) < 4 THEN 'style v' || coalesce(nullif(c_custkey % 6, 0), 1) || ' -> v4' ELSE '' END AS notes FROM customer""".replace("0.5 WHEN", "CAST(0.5 AS DOUBLE) WHEN"))
def _(t):
    scope = F.struct(F.lit(False).alias("character_rendering"), F.lit(True).alias("background_rendering"), F.lit(0.5).alias("global_ambience"))
    d = t.customer.select("c_custkey", (F.col("c_custkey") % 6).cast("int").alias("version"),
                          F.when(F.col("c_custkey") % 5 == 0, scope).alias("style_scope"),
                          F.when(F.col("c_custkey") % 7 == 0, 9).alias("revision"))
    m = PJ.migrate_schema(d, "style")
    return m.select("c_custkey", "version", F.col("style_scope.global_ambience").alias("ambience"), "revision", F.concat_ws(";", "notes").alias("notes"))


@query("migrate_palette", """
WITH v AS (SELECT c_custkey, CAST(coalesce(nullif(c_custkey % 6, 0), 1) AS INT) AS v FROM customer)
SELECT c_custkey, CASE WHEN v < 5 THEN 5 ELSE v END AS version, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.9 WHEN v < 4 THEN 0.48 END AS DOUBLE) AS min_match_score,
  CASE WHEN v < 5 THEN CASE WHEN c_custkey % 2 = 0 THEN '#00ff00' ELSE '#abcdef' END WHEN c_custkey % 2 = 0 THEN '#00ff00' END AS hair_slot,
  CASE WHEN v < 5 THEN '#123456' END AS eye_slot, CAST((CASE WHEN v < 4 THEN 1 ELSE 0 END) + (CASE WHEN v < 5 THEN 1 ELSE 0 END) AS INT) AS steps FROM v""")
def _(t):
    have = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("hair"), F.array(F.lit("#00ff00"))))
    colors = F.create_map(F.lit("hair"), F.lit("#ABCDEF"), F.lit("eyes"), F.lit("#123456"))
    d = t.customer.select("c_custkey", (F.col("c_custkey") % 6).cast("int").alias("version"),
                          F.when(F.col("c_custkey") % 3 == 0, 0.9).alias("min_match_score"), *[
                              F.lit(None).cast("double").alias(c) for c in ("min_margin", "min_semantic_conf")],
                          F.lit(None).cast("int").alias("revision"),
                          F.array(F.struct(F.lit(1).alias("char_id"), colors.alias("colors"), have.alias("color_slots"))).alias("characters"))
    m = PJ.migrate_schema(d, "palette").withColumn("s", F.get("characters", F.lit(0))["color_slots"])
    slot = lambda k: F.get(F.try_element_at("s", F.lit(k)), F.lit(0))
    return m.select("c_custkey", "version", "min_match_score", slot("hair").alias("hair_slot"), slot("eyes").alias("eye_slot"),
                    F.size("notes").alias("steps"))


@query("migrate_project", """
WITH v AS (SELECT conv_id, turn, CAST(coalesce(nullif(conv_id % 4, 0), 1) AS INT) AS v FROM conversations)
SELECT conv_id, CASE WHEN v < 3 THEN 3 ELSE v END AS version, count(*) AS pages, count(*) FILTER (WHERE turn % 2 = 0 OR v < 2) AS with_diagnostics,
  CAST((CASE WHEN v < 2 THEN 1 ELSE 0 END) + (CASE WHEN v < 3 THEN 1 ELSE 0 END) AS INT) AS steps FROM v GROUP BY conv_id, v""")
def _(t):
    page = F.struct(F.col("turn").alias("ord"), F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("a"), F.lit("b"))).alias("diagnostics"),
                    F.lit(None).cast("map<string,int>").alias("forced_character_matches"))
    d = t.conversations.groupBy("conv_id").agg(PJ.sorted_by(F.collect_list(F.struct(F.col("turn"), page.alias("p"))), "turn").alias("x")).select(
        "conv_id", (F.col("conv_id") % 4).cast("int").alias("version"), F.transform("x", lambda v: v["p"]).alias("pages"))
    m = PJ.migrate_schema(d, "project")
    return m.select("conv_id", "version", F.size("pages").cast("long").alias("pages"),
                    F.size(F.filter("pages", lambda p: p["diagnostics"].isNotNull())).cast("long").alias("with_diagnostics"), F.size("notes").alias("steps"))


@query("unique_names", """
WITH r AS (SELECT 'f' || (l_suppkey % 7) AS folder, 'page' || (l_partkey % 9) AS stem, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
q AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY seq) AS k, count(*) OVER (PARTITION BY folder, stem) AS c FROM r),
tk AS (SELECT DISTINCT 'f' || (p_size % 7) AS folder, 'page' || (p_partkey % 9) AS stem, CAST(p_partkey % 50 + 1 AS BIGINT) AS n FROM part WHERE p_size % 3 = 0),
g AS (SELECT folder, stem, max(c) AS c FROM q GROUP BY 1, 2), s AS (SELECT folder, stem, unnest(generate_series(1, c + 60)) AS n FROM g),
f AS (SELECT s.*, row_number() OVER (PARTITION BY s.folder, s.stem ORDER BY s.n) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.folder = s.folder AND tk.stem = s.stem AND tk.n = s.n))
SELECT q.folder, q.seq, q.stem || CASE WHEN f.n > 1 THEN '_' || f.n ELSE '' END || '.png' AS name FROM q JOIN f ON q.folder = f.folder AND q.stem = f.stem AND q.k = f.k""")
def _(t):
    req = t.lineitem.selectExpr("concat('f', l_suppkey % 7) AS folder", "concat('page', l_partkey % 9) AS stem", "'.png' AS ext",
                                "l_orderkey * 10 + l_linenumber AS seq")
    taken = t.part.selectExpr(
        "concat(CASE WHEN p_size % 3 = 0 THEN 'f' ELSE 'g' END, p_size % 7) AS folder",
        "concat('page', p_partkey % 9, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat('_', p_partkey % 50 + 1) END, '.png') AS name")
    return FS.unique_names(req, taken, 4096).select("folder", "seq", "name")


_SPECS = "SELECT p_partkey AS key, 'file_' || p_partkey AS filename, CAST(p_size * 1000 AS BIGINT) AS min_bytes FROM part"
_FILES = "SELECT CASE WHEN l_partkey % 4 = 1 THEN 'spare_' ELSE 'file_' END || l_partkey AS filename, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem"
_INV = f"""
WITH s AS ({_SPECS}), f AS (SELECT filename, max(size) AS size FROM ({_FILES}) z GROUP BY 1),
i AS (SELECT key, f.size IS NOT NULL AS exists_, coalesce(size, 0) AS size, size IS NOT NULL AND size >= min_bytes AS ready, round(coalesce(size, 0) / 1048576.0, 2) AS mb FROM s LEFT JOIN f ON s.filename = f.filename)"""


def _inventory(t):
    return FS.artifact_inventory(t.spark.sql(_SPECS.replace("FROM part", "FROM {part}"), part=t.part),
                                 t.spark.sql(_FILES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem))


@query("artifact_inventory", _INV + ' SELECT key, exists_ AS "exists", size, ready, CAST(mb AS DOUBLE) AS size_mb FROM i')
def _(t):
    return _inventory(t).select("key", "exists", "size", "ready", "size_mb")


@query("missing_artifacts", _INV + " SELECT key FROM i WHERE NOT ready")
def _(t):
    return FS.missing_artifacts(_inventory(t))


@query("total_size_mb", _INV + " SELECT CAST(round(sum(mb), 2) AS DOUBLE) AS total_mb FROM i")
def _(t):
    return FS.total_size_mb(_inventory(t))


_PAYLOADS = """
p AS (SELECT conv_id AS payload_id, turn, CASE WHEN conv_id % 5 = 0 THEN text ELSE replace(base64(encode(text[1:3 * (length(text) // 3)])), '=', 'A') END AS body FROM conversations),
g AS (SELECT payload_id, count(*) AS fragments, string_agg(regexp_replace(body, '\\s+', '', 'g'), '' ORDER BY turn) AS enc FROM p GROUP BY 1)"""


def _payload_parts(t):
    ascii_only = F.expr("substring(text, 1, 3 * CAST(floor(length(text) / 3) AS INT))")
    body = F.when(F.col("conv_id") % 5 == 0, F.col("text")).otherwise(
        F.replace(F.base64(F.encode(ascii_only, "UTF-8")), F.lit("="), F.lit("A")))
    return t.conversations.select(F.col("conv_id").alias("payload_id"),
                                  F.concat(F.lit("x/part-"), F.col("turn"), F.lit(".b64")).alias("name"), body.alias("body"))


@query("reassemble_chunks", f"""
WITH {_PAYLOADS}
SELECT payload_id, fragments, CAST(strlen(enc) AS BIGINT) AS bytes, CAST(ceil(length(enc) / 512.0) AS BIGINT) AS pieces, enc AS encoded,
  CASE WHEN payload_id % 5 <> 0 THEN CAST(octet_length(from_base64(enc)) AS BIGINT) END AS decoded_bytes, CASE WHEN payload_id % 5 = 0 THEN 'not decodable' ELSE 'ok' END AS state FROM g""")
def _(t):
    return FS.reassemble_chunks(_payload_parts(t), piece=512)


@query("chunk_pieces", f"""
WITH {_PAYLOADS}, s AS (SELECT payload_id, enc, unnest(range(CAST(ceil(length(enc) / 512.0) AS BIGINT))) AS piece FROM g),
c AS (SELECT payload_id, piece, substr(enc, piece * 512 + 1, 512) AS encoded FROM s)
SELECT payload_id, piece, piece * 384 AS "offset", encoded, CASE WHEN payload_id % 5 <> 0 THEN sha256(from_base64(encoded)) END AS digest FROM c""")
def _(t):
    d = FS.chunk_pieces(_payload_parts(t), piece=512)
    # Plain text has pieces that look like base64 by chance only if it has no stops and blanks.
    return d.select("payload_id", "piece", "offset", "encoded", F.when(F.col("payload_id") % 5 != 0, F.sha2("bytes", 256)).alias("digest"))


@query("expire_stale", """
SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND ts < TIMESTAMP '2024-01-12 00:00:00' - INTERVAL 24 HOURS""")
def _(t):
    e = t.events.selectExpr("event_id", "ts AS modified", "CASE event_type WHEN 'click' THEN 'app_session_cache_1' WHEN 'error' THEN 'app_pages_2' ELSE 'other' END AS name")
    return FS.expire_stale(e, F.expr("TIMESTAMP_NTZ '2024-01-12 00:00:00'")).select("event_id")


@query("catalog_list", """
SELECT 's' || c_custkey || '.ccstyle' AS filename, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey ELSE c_name END AS display_name FROM customer WHERE c_custkey % 4 <> 0""")
def _(t):
    d = t.customer.selectExpr(
        "concat('s', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '.txt' ELSE '.ccstyle' END) AS filename",
        "CASE WHEN c_custkey % 6 = 0 THEN '{broken' WHEN c_custkey % 3 = 0 THEN '{}' ELSE concat('{\"name\": \"', c_name, '\"}') END AS body")
    return FS.catalog_list(d)
