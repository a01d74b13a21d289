"""Named queries and, next to each, the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaframe.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to views and tables: ``t.px``, ``t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its oracle text."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def r6(col, name: str):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, 6).alias(name)


# --- oracle snippets (DuckDB: later items may use earlier aliases) -----------

def lab_cols(r: str, g: str, b: str, p: str = "", quantise: bool = True) -> str:
    def lin(c):
        return (f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 "
                f"ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END")

    def f(t):
        return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116.0 END"
    q = (lambda e: f"floor({e} + 0.5)") if quantise else (lambda e: e)
    return (f"CAST({lin(r)} AS DOUBLE) AS {p}lr, CAST({lin(g)} AS DOUBLE) AS {p}lg, CAST({lin(b)} AS DOUBLE) AS {p}lb, "
            f"(0.412453 * {p}lr + 0.357580 * {p}lg + 0.180423 * {p}lb) / 0.950456 AS {p}xx, "
            f"0.212671 * {p}lr + 0.715160 * {p}lg + 0.072169 * {p}lb AS {p}yy, "
            f"(0.019334 * {p}lr + 0.119193 * {p}lg + 0.950227 * {p}lb) / 1.088754 AS {p}zz, "
            f"{f(p + 'xx')} AS {p}fx, {f(p + 'yy')} AS {p}fy, {f(p + 'zz')} AS {p}fz, "
            f"{q(f'(CASE WHEN {p}yy > 0.008856 THEN 116 * cbrt({p}yy) - 16 ELSE 903.3 * {p}yy END) * 255.0 / 100.0')} AS {p}lab_l, "
            f"{q(f'500.0 * ({p}fx - {p}fy) + 128')} AS {p}lab_a, "
            f"{q(f'200.0 * ({p}fy - {p}fz) + 128')} AS {p}lab_b")


def hsv_cols(r: str, g: str, b: str, p: str = "") -> str:
    return (f"greatest({r}, {g}, {b}) AS {p}val, {p}val - least({r}, {g}, {b}) AS {p}span, "
            f"CASE WHEN {p}span = 0 THEN 0.0 WHEN {p}val = {r} THEN CAST({g} - {b} AS DOUBLE) / {p}span "
            f"WHEN {p}val = {g} THEN CAST({b} - {r} AS DOUBLE) / {p}span + 2.0 "
            f"ELSE CAST({r} - {g} AS DOUBLE) / {p}span + 4.0 END AS {p}sext, "
            f"floor({p}sext * 30.0 + 0.5) AS {p}hraw, "
            f"CASE WHEN {p}hraw < 0 THEN {p}hraw + 180 ELSE {p}hraw END AS {p}hue, "
            f"CASE WHEN {p}val = 0 THEN 0.0 ELSE floor({p}span * CAST(255.0 AS DOUBLE) / {p}val + 0.5) END AS {p}sat")


def rgb_cols(l: str, a: str, b: str, p: str = "o_") -> str:
    def inv(t):
        return f"CASE WHEN {t} > 0.206893 THEN {t} * {t} * {t} ELSE ({t} - 16.0 / 116.0) / 7.787 END"

    def gamma(m):
        c = f"greatest(0.0, least(1.0, {p}x * {m[0]} + {p}y * {m[1]} + {p}z * {m[2]}))"
        return (f"CAST(floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 "
                f"ELSE 1.055 * pow({c}, 1 / CAST(2.4 AS DOUBLE)) - 0.055 END) * 255.0 + 0.5) AS INT)")
    return (f"CAST({l} AS DOUBLE) * (100.0 / CAST(255.0 AS DOUBLE)) AS {p}li, "
            f"CASE WHEN {p}li > 0.008856 * 903.3 THEN ({p}li + 16) / 116 ELSE {p}li / 903.3 * 7.787 + 16.0 / 116.0 END AS {p}fy, "
            f"({a} - 128) / CAST(500.0 AS DOUBLE) + {p}fy AS {p}fx, {p}fy - ({b} - 128) / CAST(200.0 AS DOUBLE) AS {p}fz, "
            f"CAST({inv(p + 'fx')} AS DOUBLE) * 0.950456 AS {p}x, CAST({inv(p + 'fy')} AS DOUBLE) AS {p}y, CAST({inv(p + 'fz')} AS DOUBLE) * 1.088754 AS {p}z, "
            f"{gamma((3.240479, -1.537150, -0.498535))} AS {p}r, "
            f"{gamma((-0.969256, 1.875991, 0.041556))} AS {p}g, "
            f"{gamma((0.055648, -0.204043, 1.057311))} AS {p}b")


def hex_sql(r: str, g: str, b: str) -> str:
    def two(c):
        return f"lpad(lower(to_hex(CAST(greatest(0, least(255, {c})) AS BIGINT))), 2, '0')"
    return f"('#' || {two(r)} || {two(g)} || {two(b)})"
