"""Explicit schemas of the nested records."""

from __future__ import annotations

HINT = ("struct<x_norm: double, y_norm: double, rgb: array<int>, color: array<int>, radius_norm: double, strength: double, "
        "source: string, region_id: int, semantic: string, character_id: int, confidence: double, priority: int>")

PAGE = (f"struct<path: string, hints: struct<version: int, auto_hints: array<{HINT}>, manual_hints: array<{HINT}>>, "
        "ai_result: string, result: string, filter_base: string, diagnostics: map<string, string>, "
        "forced_character_matches: map<string, int>, diagnostics_file: string, semantic_hair_positive: string, "
        "semantic_hair_negative: string>")

CHARACTER = ("struct<char_id: int, name: string, hair_tone: double, hits: int, hair_hist: array<double>, hair_aspect: double, "
             "hair_area_frac: double, appearance_embedding: array<float>, lineart_embedding: array<float>, "
             "reference_samples: int, manual: boolean, colors: map<string, string>, color_slots: map<string, array<string>>>")

LIBRARY = (f"struct<version: int, max_characters: int, min_match_score: double, min_margin: double, min_semantic_conf: double, "
           f"revision: int, characters: array<{CHARACTER}>>")

SLOT = "struct<slot_id: int, tone: double, color_hex: string, name: string, locked: boolean, hits: int>"

MEMORY = f"struct<label: string, max_slots: int, tone_tolerance: double, slots: array<{SLOT}>>"

SCENE = "struct<name: string, colors: map<string, string>, strength: double, revision: int>"

PROJECT = (f"struct<version: int, pages: array<{PAGE}>, character_library: {LIBRARY}, "
           f"character_memories: map<string, {MEMORY}>, scene_palette: {SCENE}, settings: map<string, string>>")

STYLE_SCOPE = "struct<character_rendering: boolean, background_rendering: boolean, global_ambience: double>"
