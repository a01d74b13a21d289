"""Project documents: loading into tables, saving back, version upgrades."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe import schema as SC
from chromaframe.scale import cut_lineage, rank_within


def parse_projects(docs: DataFrame, project: str, body: str, *keep: str) -> DataFrame:
    """project, the columns to keep, doc (typed), broken (true when the text is no project document)."""
    d = docs.select(project, *keep, F.from_json(body, SC.PROJECT, {"mode": "PERMISSIVE"}).alias("doc"))
    return d.withColumn("broken", F.col("doc").isNull() | F.col("doc.version").isNull() & F.col("doc.pages").isNull())


def _resolve(base: Column | None, value: str) -> Column:
    v = F.col(value)
    if base is None:
        return v
    return F.when(v.isNotNull() & (v != ""), F.when(v.startswith("/"), v).otherwise(F.concat(base, F.lit("/"), v)))


def load_project(docs: DataFrame, project: str = "project_id", body: str = "body", base: Column | None = None) -> dict[str, DataFrame]:
    """Tables of a project document: pages, hints, forced, characters, memories, scene, settings, broken.

    ``base`` is the project's folder, to which relative file names are resolved. Each
    table prunes the parse to the fields it reads.
    """
    src = docs if base is None else docs.withColumn("__base", base)
    d = parse_projects(src, project, body, *(["__base"] if base is not None else []))
    keep = [project] + (["__base"] if base is not None else [])
    root = F.col("__base") if base is not None else None
    p = d.select(*keep, F.posexplode("doc.pages").alias("page_ord", "page"))
    files = ("ai_result", "result", "filter_base", "semantic_hair_positive", "semantic_hair_negative")
    pages = p.select(*keep, "page_ord", "page.*").select(
        project, "page_ord", "path", *[_resolve(root, f).alias(f) for f in files],
        F.coalesce("diagnostics", F.create_map().cast("map<string,string>")).alias("diagnostics"), "diagnostics_file")

    def tagged(kind):
        items = F.coalesce(f"page.hints.{kind}_hints", F.array().cast(f"array<{SC.HINT}>"))
        return F.transform(items, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("hint_ord"), h.alias("hint")))
    both = F.concat(tagged("auto"), tagged("manual"))
    hints = p.select(project, "page_ord", F.inline(both)).select(project, "page_ord", "kind", "hint_ord", "hint.*")
    hints = hints.withColumn("rgb", F.coalesce("rgb", "color", F.array(F.lit(128), F.lit(128), F.lit(128)))).drop("color")
    forced = p.select(project, "page_ord", F.explode("page.forced_character_matches").alias("anchor", "char_id")).select(
        project, "page_ord", F.col("anchor").cast("int").alias("anchor_id"), "char_id")
    characters = d.select(project, F.inline("doc.character_library.characters"))
    memories = d.select(project, F.explode("doc.character_memories").alias("label_key", "m")).select(
        project, "label_key", "m.label", "m.max_slots", "m.tone_tolerance", F.explode_outer("m.slots").alias("slot")).select(
        project, "label_key", "label", "max_slots", "tone_tolerance", "slot.*")
    scene = d.where("doc.scene_palette IS NOT NULL").select(project, F.explode("doc.scene_palette.colors").alias("label", "color"))
    settings = d.select(project, F.explode("doc.settings").alias("key", "value"))
    return {"pages": pages, "hints": hints, "forced": forced, "characters": characters, "memories": memories, "scene": scene,
            "settings": settings, "broken": d.where("broken").select(project)}


def sorted_by(packed: Column, field: str) -> Column:
    """Sort an array of structs by one field (the rest may hold maps, which have no order)."""
    return F.array_sort(packed, lambda p, q: F.when(p[field] < q[field], -1).when(p[field] > q[field], 1).otherwise(0))


def _gather(df: DataFrame, project: str, order: str, value: Column, name: str) -> DataFrame:
    packed = sorted_by(F.collect_list(F.struct(F.col(order), value.alias("__v"))), order)
    return df.groupBy(project).agg(F.transform(packed, lambda s: s["__v"]).alias(name))


def save_project(pages: DataFrame, hints: DataFrame | None = None, characters: DataFrame | None = None,
                 settings: DataFrame | None = None, project: str = "project_id") -> DataFrame:
    """One JSON document per project, children in page order: project, body.

    Inverse of ``load_project``. A project is one document by definition, so its pages
    meet in one row; write the result with Spark's writer, which publishes on success.
    """
    if hints is not None:
        spec = F.struct(*[F.col(c) for c in ("x_norm", "y_norm", "rgb", "radius_norm", "strength", "source", "region_id", "semantic",
                                             "character_id", "confidence", "priority") if c in hints.columns])
        h = hints.groupBy(project, "page_ord").agg(*[
            sorted_by(F.collect_list(F.when(F.col("kind") == k, F.struct("hint_ord", spec.alias("h")))), "hint_ord").alias(f"__{k}")
            for k in ("auto", "manual")])
        h = h.select(project, "page_ord", F.struct(
            F.lit(4).alias("version"), F.transform("__auto", lambda v: v["h"]).alias("auto_hints"),
            F.transform("__manual", lambda v: v["h"]).alias("manual_hints")).alias("hints"))
        pages = pages.join(h, [project, "page_ord"], "left")
    fields = [c for c in pages.columns if c not in (project, "page_ord")]
    doc = _gather(pages, project, "page_ord", F.struct(*fields), "pages")
    parts = [F.lit(3).alias("version"), F.col("pages")]
    if characters is not None:
        lib = _gather(characters, project, "char_id", F.struct(*[c for c in characters.columns if c != project]), "__chars")
        doc = doc.join(lib, project, "left")
        parts.append(F.when(F.col("__chars").isNotNull(), F.struct(F.lit(5).alias("version"), F.col("__chars").alias("characters")))
                     .alias("character_library"))
    if settings is not None:
        st = settings.groupBy(project).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))
        doc = doc.join(st, project, "left")
        parts.append(F.col("settings"))
    return doc.select(project, F.to_json(F.struct(*parts)).alias("body"))


# --- projects in pieces -------------------------------------------------------

#: Rows of a piece. A piece is a JSON array, a few hundred kilobytes of text at most in practice.
PIECE_ROWS = 256
#: How the rows of each part follow each other.
PARTS = {"pages": ("page_ord",), "hints": ("page_ord", "kind", "hint_ord"), "characters": ("char_id",), "settings": ("key",)}


def _range_of(part: str) -> Column:
    """Grows with the order of the part and splits a large project, and a page with many hints, into ranges."""
    if part == "hints":
        return F.struct("page_ord", "kind", F.floor(F.col("hint_ord") / 4096).alias("range"))
    if part == "settings":
        return F.substring("key", 1, 2)
    return F.floor(F.col("page_ord" if part == "pages" else "char_id") / 4096)


def save_pieces(pages: DataFrame, hints: DataFrame | None = None, characters: DataFrame | None = None, settings: DataFrame | None = None,
                project: str = "project_id", size: int = PIECE_ROWS) -> DataFrame:
    """Projects as documents in pieces: ``project``, ``part``, ``piece``, ``rows``, ``crc``, ``body``.

    A part's rows, in order, are cut into pieces of ``size``; each is a JSON array, so no row holds a
    project or a page's hints, however large. The row of part ``manifest`` names every part with its rows, pieces and sum
    of checksums. Columns are kept as they are; see ``load_pieces``.
    """
    out = []
    for part, df in (("pages", pages), ("hints", hints), ("characters", characters), ("settings", settings)):
        if df is None:
            continue
        ranked = rank_within(df, [project], list(PARTS[part]), _range_of(part))
        fields = F.struct(*[c for c in df.columns if c != project])
        rows = ranked.select(project, "rank", F.floor((F.col("rank") - 1) / size).alias("piece"), F.to_json(fields).alias("__row"))
        texts = F.array_sort(F.collect_list(F.struct("rank", "__row")))  # at most ``size`` rows
        body = F.concat(F.lit("["), F.array_join(F.transform(texts, lambda r: r["__row"]), ","), F.lit("]"))
        out.append(rows.groupBy(project, "piece").agg(F.count(F.lit(1)).alias("rows"), body.alias("body")).select(
            project, F.lit(part).alias("part"), "piece", "rows", F.crc32("body").alias("crc"), "body"))
    pieces = cut_lineage(reduce(DataFrame.unionByName, out))
    sums = pieces.groupBy(project, "part").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("pieces"), F.sum("crc").alias("crc"))
    listed = F.array_sort(F.collect_list(F.struct("part", "rows", "pieces", "crc")))  # at most four parts
    manifest = sums.groupBy(project).agg(F.to_json(F.struct(F.lit(3).alias("version"), listed.alias("parts"))).alias("body"), F.sum("rows").alias("rows"))
    manifest = manifest.select(project, F.lit("manifest").alias("part"), F.lit(0).cast("long").alias("piece"), "rows", F.crc32("body").alias("crc"), "body")
    return pieces.unionByName(manifest)


def piece_states(pieces: DataFrame, project: str = "project_id") -> DataFrame:
    """``project`` and ``state``: ok, incomplete (a part does not add up to its manifest) or no manifest."""
    parts = "struct<version: int, parts: array<struct<part: string, rows: bigint, pieces: bigint, crc: bigint>>>"
    want = pieces.where("part = 'manifest'").select(project, F.inline(F.from_json("body", parts)["parts"]))
    sound = F.crc32("body") == F.col("crc")
    have = pieces.where("part <> 'manifest'").groupBy(project, "part").agg(
        F.sum("rows").alias("h_rows"), F.count(F.lit(1)).alias("h_pieces"), F.sum("crc").alias("h_crc"), F.bool_and(sound).alias("sound"))
    met = want.join(have, [project, "part"], "full")
    fits = F.coalesce((F.col("rows") == F.col("h_rows")) & (F.col("pieces") == F.col("h_pieces")) & (F.col("crc") == F.col("h_crc")) & F.col("sound"), F.lit(False))
    state = met.groupBy(project).agg(F.bool_and(fits).alias("__fits"), F.bool_or(F.col("rows").isNotNull()).alias("__named"))
    return state.select(project, F.when(~F.col("__named"), "no manifest").when(F.col("__fits"), "ok").otherwise("incomplete").alias("state"))


def load_pieces(pieces: DataFrame, schemas: Mapping[str, str], project: str = "project_id") -> dict[str, DataFrame]:
    """The tables of a document in pieces; ``schemas`` has the columns of each part, without the project, as DDL.

    Every piece is parsed on its own; which pieces a table needs is a filter on ``part``.
    """
    read = lambda part, ddl: pieces.where(F.col("part") == part).select(project, F.inline(F.from_json("body", f"array<struct<{ddl}>>")))
    return {part: read(part, ddl) for part, ddl in schemas.items()}


def _notes(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda v: v.isNotNull())


def migrate_schema(df: DataFrame, kind: str) -> DataFrame:
    """Upgrade style, palette or project rows; absent fields get defaults, ``notes`` lists the steps.

    A pure projection: present values are never replaced.
    """
    v = F.coalesce(F.col("version"), F.lit(1))
    v = F.when(v == 0, 1).otherwise(v)
    if kind == "style":
        old = v < 4
        scope = F.struct(F.lit(True).alias("character_rendering"), F.lit(True).alias("background_rendering"),
                         F.lit(0.20).alias("global_ambience"))
        return df.withColumns({
            "style_scope": F.when(old, F.coalesce("style_scope", scope)).otherwise(F.col("style_scope")),
            "revision": F.when(old, F.coalesce("revision", F.lit(0))).otherwise(F.col("revision")),
            "notes": _notes(F.when(old, F.concat(F.lit("style v"), v, F.lit(" -> v4")))),
            "version": F.when(old, 4).otherwise(v)})
    if kind == "palette":
        old, slots = v < 4, v < 5

        def fill(name, value):
            return F.when(old, F.coalesce(F.col(name), F.lit(value))).otherwise(F.col(name))

        def with_slots(c):
            have = F.coalesce(c["color_slots"], F.create_map().cast("map<string,array<string>>"))
            colors = F.coalesce(c["colors"], F.create_map().cast("map<string,string>"))
            new = F.map_filter(F.transform_values(colors, lambda k, x: F.array(F.lower(x))),
                               lambda k, x: ~F.map_contains_key(have, k))
            return c.withField("color_slots", F.map_concat(have, new))
        return df.withColumns({
            "min_match_score": fill("min_match_score", 0.48), "min_margin": fill("min_margin", 0.055),
            "min_semantic_conf": fill("min_semantic_conf", 0.32), "revision": fill("revision", 0),
            "characters": F.when(slots, F.transform("characters", with_slots)).otherwise(F.col("characters")),
            "notes": _notes(F.when(old, F.concat(F.lit("palette v"), v, F.lit(" -> v4"))), F.when(slots, F.lit("palette v4 -> v5"))),
            "version": F.when(slots, 5).otherwise(v)})
    if kind == "project":
        first, second = v < 2, v < 3

        def page(p):
            empty_s, empty_i = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,int>")
            return (p.withField("diagnostics", F.coalesce(p["diagnostics"], empty_s))
                    .withField("forced_character_matches", F.coalesce(p["forced_character_matches"], empty_i)))
        return df.withColumns({
            "pages": F.when(first, F.transform("pages", page)).otherwise(F.col("pages")),
            "notes": _notes(F.when(first, F.concat(F.lit("project v"), v, F.lit(" -> v2"))), F.when(second, F.lit("project v2 -> v3"))),
            "version": F.when(second, 3).otherwise(v)})
    raise ValueError(f"unknown kind: {kind}")
