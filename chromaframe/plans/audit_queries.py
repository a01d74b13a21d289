"""Queries over text and path audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.operators import audit as X
from chromaframe.plans.registry import query

# The given documents hold assignments rather than vendor keys, so one pattern is added.
ASSIGNED = ("assigned secret", r"(?i)(?:token|secret|password|api_key|apikey)\s*[=:]\s*[\"'][^\"'\s]{8,}[\"']",
            ("token", "secret", "password", "api_key", "apikey"))
_PATTERNS = (*X.SECRET_PATTERNS, ASSIGNED)


def _re2(rule: str) -> str:
    """Look-around is stated as a boundary group; RE2 has none."""
    return (rule.replace("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])").replace("(?<![A-Z0-9])", "(?:^|[^A-Z0-9])")
            .replace("(?![A-Z0-9])", "(?:$|[^A-Z0-9])").replace("'", "''"))


_SECRETS = " UNION ".join(f"SELECT doc_id, '{n}' AS category FROM documents WHERE regexp_matches(text, '{_re2(r)}')" for n, r, _ in _PATTERNS)


@query("secret_scan", _SECRETS)
def _(t):
    return X.secret_scan(t.documents, "doc_id", "text", _PATTERNS)


@query("scan_coverage", """SELECT count(*) AS documents, count(*) FILTER (WHERE text IS NULL) AS without_text, count(text) AS scanned,
  CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents""")
def _(t):
    return X.scan_coverage(t.documents, "text")


# Home paths planted from the row itself, since the given texts hold none.
_PATHS = """concat(text, chr(10), CASE doc_id % 9 WHEN 0 THEN '/Users/' || source || '/work' WHEN 1 THEN 'open /home/' || lang || '_user/notes' WHEN 2 THEN 'C:\\Users\\' || source || '\\docs'
  WHEN 3 THEN 'PATTERN /home/abc/def' WHEN 4 THEN '/home/runner/x' WHEN 5 THEN '/Users/用户名/x' WHEN 6 THEN 'c:\\users\\' || lang || '1\\z' || chr(10) || '/home/' || lang || 'zz' ELSE 'plain' END)"""


_HOMES = f"""
WITH d AS (SELECT doc_id, {_PATHS} AS body FROM documents),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM d),
k AS (SELECT *, CASE WHEN regexp_matches(line, '/Users/[^/\\s"'']+') AND NOT regexp_matches(line, '/Users/(Shared|runner|USER|username|yourname|path|用户名)(/|$)') THEN 'macOS home path' END AS m,
  CASE WHEN regexp_matches(line, '/home/[^/\\s"'']+') AND NOT regexp_matches(line, '/home/(runner|USER|username|yourname|path)(/|$)') THEN 'Linux home path' END AS u,
  CASE WHEN regexp_matches(line, '(?i)[A-Z]:\\\\Users\\\\[^\\\\\r\n"'']+') THEN 'Windows home path' END AS w FROM l WHERE NOT regexp_matches(lower(line), 're\\.compile|regex|pattern')),
h AS (SELECT doc_id, unnest([m, u, w]) AS category, n FROM k)
SELECT doc_id, category, CAST(min(n) AS INT) AS line FROM h WHERE category IS NOT NULL GROUP BY 1, 2"""


@query("home_path_scan", _HOMES)
def _homes(t):
    d = t.documents.withColumn("body", F.expr(_PATHS.replace("\\", "\\\\")))
    return X.home_path_scan(d, "doc_id", "body")


_URLPATH = ("CASE page_id % 11 WHEN 0 THEN '/.env.local' WHEN 1 THEN '/.env.example' WHEN 2 THEN '/cache/a.png' WHEN 3 THEN '/models/G.PTH' WHEN 4 THEN '/generator.zip' "
            "WHEN 5 THEN '/b.JPG' WHEN 6 THEN '/weights/x.ckpt' WHEN 7 THEN '/.key' WHEN 8 THEN '/env/credentials.json' ELSE '' END")


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


@query("path_policy", f"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || {_URLPATH} AS path FROM pages),
s AS (SELECT *, lower(regexp_replace(path, '/+$', '')) AS raw, string_split(raw, '/') AS parts, parts[-1] AS name, regexp_extract(name, '^.*[^/](\\.[^./]+)$', 1) AS suf FROM p),
u AS (SELECT page_id, unnest([CASE WHEN starts_with(name, '.env') AND name NOT IN {_in(X.ALLOWED_ENV)} THEN 'environment file' END, CASE WHEN name IN {_in(X.FORBIDDEN_NAMES)} THEN 'credential or local file' END,
  CASE WHEN list_has_any(parts, [{', '.join(f"'{v}'" for v in X.FORBIDDEN_DIRS)}]) THEN 'runtime or generated path' END, CASE WHEN suf IN {_in(X.FORBIDDEN_SUFFIXES)} THEN 'private or runtime file' END,
  CASE WHEN suf IN {_in(X.MEDIA_SUFFIXES)} THEN 'unreviewed image' END, CASE WHEN name = 'generator.zip' THEN 'generator model' END,
  CASE WHEN suf IN {_in(X.MODEL_SUFFIXES)} AND list_has_any(parts, [{', '.join(f"'{v}'" for v in X.MODEL_DIRS)}]) THEN 'model weight or cache' END]) AS rule FROM s)
SELECT page_id, rule FROM u WHERE rule IS NOT NULL""")
def _(t):
    d = t.pages.select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.expr(_URLPATH)).alias("path"))
    return X.path_policy(d, "path").select("page_id", "rule")


_HISTPATH = ("CASE page_id % 9 WHEN 0 THEN '/.env.old' WHEN 1 THEN '/Secrets.yaml' WHEN 2 THEN '/models/G.PTH' WHEN 3 THEN '/models/a/b.pt' WHEN 4 THEN '/generator.zip' "
             "WHEN 5 THEN '/x.key' WHEN 6 THEN '/secretary.txt' WHEN 7 THEN '/service-account.json' ELSE '/.key' END")
_HISTORY = f"""
WITH p AS (SELECT page_id, lower(regexp_replace(url, '^[a-z]+://', '') || {_HISTPATH}) AS path FROM pages),
u AS (SELECT page_id, unnest([CASE WHEN regexp_matches(path, '(^|/)(\\.env(\\.[^/]*)?|credentials?(\\.[^/]*)?|secrets?(\\.[^/]*)?|service-account(\\.[^/]*)?|[^/]+\\.(pem|p12|pfx|key|ccproject|ccpalette|ccscene|ccstyle))$') THEN 'sensitive-history-path' END,
  CASE WHEN regexp_matches(path, '(^|/)(generator\\.zip|(models|weights|checkpoints)/[^/]+\\.(pt|pth|ckpt|safetensors))$') THEN 'checkpoint-in-history' END]) AS rule FROM p)
SELECT page_id, rule FROM u WHERE rule IS NOT NULL"""


@query("history_path_policy", _HISTORY)
def _history(t):
    d = t.pages.select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.expr(_HISTPATH)).alias("path"))
    return X.history_path_policy(d, "path").select("page_id", "rule")


_CATEGORY = "CASE " + " ".join(f"WHEN detail = '{k}' THEN '{v}'" for k, v in X.CATEGORY_OF.items()) + " ELSE detail END"
_FINDINGS = f"""
SELECT CAST(place AS VARCHAR) AS place, {_CATEGORY} AS category, detail FROM (
  SELECT doc_id AS place, category AS detail FROM ({_SECRETS}) s UNION ALL SELECT doc_id, category FROM ({_HOMES}) h UNION ALL SELECT page_id, rule FROM ({_HISTORY}) p) a"""


def _findings(t):
    return X.audit_findings(("doc_id", X.secret_scan(t.documents, "doc_id", "text", _PATTERNS), "category"),
                            ("doc_id", _homes(t), "category"), ("page_id", _history(t), "rule"))


@query("audit_findings", _FINDINGS)
def _(t):
    return _findings(t)


@query("audit_gate", f"""
WITH p AS (SELECT category, count(*) AS findings FROM (SELECT DISTINCT * FROM ({_FINDINGS}) x) f GROUP BY 1)
SELECT category, findings, 'fatal' AS severity, false AS passed FROM p
UNION ALL SELECT '(all)', CAST(coalesce(sum(findings), 0) AS BIGINT), CASE WHEN count(*) > 0 THEN 'fatal' ELSE 'none' END, count(*) = 0 FROM p""")
def _(t):
    return X.audit_gate(_findings(t))


@query("distinct_content", "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY text")
def _(t):
    return X.distinct_content(t.documents, "text", "source", "doc_id").select("doc_id", "source", "copies")


_BODY = ("CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN '  {\"Error\": 1}' || html WHEN 2 THEN '' WHEN 3 THEN 'version https://git-lfs.github.com/spec/v1 x' WHEN 4 THEN 'body ' || html "
         "ELSE 'sorry, Access Denied ' || html END")


@query("error_payload", f"""
WITH b AS (SELECT page_id, {_BODY} AS raw, lower(ltrim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS h FROM pages)
SELECT page_id, CASE WHEN length(raw) = 0 THEN 'empty' WHEN starts_with(h, 'version https://git-lfs.github.com/spec/v1') THEN 'pointer'
  WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') OR starts_with(h, '<?xml') THEN 'web page'
  WHEN regexp_matches(h, '^[{{\\[]') AND regexp_matches(substring(h, 1, 1024), 'error|message|not found|expired') THEN 'json error'
  WHEN regexp_matches(substring(h, 1, 2048), 'jwt: expired|access denied|rate limit exceeded|repository not found|page not found') THEN 'access message' END AS reason FROM b""")
def _(t):
    return t.pages.select("page_id", X.error_payload(F.expr(_BODY)).alias("reason"))
