"""URL filters: rules by host and path, and block decisions that spread to aliases.

Method. Canonical links and immediate redirects in a page's html are edges between addresses. Their
connected components are sets of aliases. An address with no rule of its own is blocked if an alias is
blocked by a rule and no alias is allowed by one: an explicit allow takes precedence. Everything else is
allowed.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and has no
aliases; null html has no edges; repeated pages are judged row by row; an empty table gives an empty
result. Rules are a policy of at most MAX_RULES entries, checked, and are part of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import connected_components
from tidegrid.session import materialize

MAX_RULES = 1000
# The rules (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Links that declare an alias, in either order of attributes; the address is the first group that matched.
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)|<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)[^>]*\brel\s*=\s*["']?canonical\b"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\bcontent\s*=\s*["']?\s*\d+\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""
#: The same in either order of attributes; REFRESH itself is part of the SQL.
REFRESH_EITHER = REFRESH + r"""|<meta\b[^>]*\bcontent\s*=\s*["']?\s*\d+\s*;\s*url\s*=\s*["']?([^"'\s>]+)[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""
ABC, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, ABC)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into the plan")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The shortest come first and are wrapped by longer ones; of equals, an allow is outermost.
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment. Null without `://`."""
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def resolved(to: Column, host: Column, path: Column) -> Column:
    """The full form of a link on a page at host and path, by RFC 3986; null for other schemes such as mailto."""
    ref = F.regexp_replace(to, r"(?s)#.*$", "")
    own, query = F.regexp_extract(ref, r"(?s)^[^?]*", 0), F.regexp_extract(ref, r"(?s)\?.*$", 0)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    parts = F.split(merged, "/")
    # The first part is empty, for the leading slash, and stays.
    up = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda x, y: F.when(y == "..", up(x)).when(y == ".", x).otherwise(F.concat(x, F.array(y))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    full = F.when(own == "", F.concat(path, query)).otherwise(F.concat(F.array_join(kept, "/"), query))
    out = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
    return out.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(ref != "", F.concat(F.lit("http://"), host, full))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: addresses that a page declares to be one. Relative links count from the page's host and path."""
    u, h = F.col(url), F.col(html)
    both = lambda p: F.transform(F.regexp_extract_all(h, F.lit(p), F.lit(0)), lambda x: F.concat(F.regexp_extract(x, p, 1), F.regexp_extract(x, p, 2)))
    some = h.rlike("(?i)canonical|http-equiv")
    found = pages.filter(some & u.contains("://")).select(address(u).alias("src"), host_of(u).alias("own"), path_of(u).alias("path"), F.explode(F.concat(both(CANONICAL), both(REFRESH_EITHER))).alias("to"))
    full = resolved(F.col("to"), F.col("own"), F.col("path"))
    return found.select("src", address(full).alias("dst")).filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def blocked_addresses(edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """address: those whose component has a blocked member and no allowed one."""
    cc = connected_components(edges)
    parts = F.split("node", r"(?=[/?])", 2)
    host, rest = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))
    judged = cc.withColumn("v", rule_for(host, F.regexp_extract(rest, r"(?s)^([^?]*)", 1), rules)["verdict"])
    bad = judged.groupBy("component").agg(F.max(F.col("v") == "block").alias("block"), F.max(F.col("v") == "allow").alias("allow"))
    bad = bad.filter(F.col("block") & ~F.coalesce("allow", F.lit(False))).select("component")
    return judged.join(bad, "component", "left_semi").select(F.col("node").alias("blocked"))


def judge(pages: DataFrame, carry: Column, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """doc (the carried struct), host, path, rule, verdict: one row per page."""
    u = F.col(url)
    p = pages.select(carry.alias("doc"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    edges = materialize(alias_edges(pages, url, html), "alias-edges")
    if edges.isEmpty():  # nothing to spread
        return p.select("doc", "host", "path", "r.rule", F.coalesce("r.verdict", F.lit("allow")).alias("verdict"))
    bad = blocked_addresses(edges, rules)
    own = p.filter(F.col("r").isNotNull()).select("doc", "host", "path", "r.rule", "r.verdict")
    rest = p.filter(F.col("r").isNull()).withColumn("address", address(F.col("url")))
    rest = rest.join(bad, F.col("address") == F.col("blocked"), "left")
    rest = rest.select("doc", "host", "path", "r.rule", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return own.unionByName(rest)


def op3_query(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return judge(pages, F.struct("page_id")).select("doc.page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "allow"), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)
    judged = lambda t: f"SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS v FROM {t}"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    link = "CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || host || x END"
    split = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{ABC}')"
    addr = lambda u: f"CASE WHEN contains({u}, '://') THEN {split(u)} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
    return f"""
    WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, html, {split("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r AS ({judged("p")}),
    links AS (SELECT url, host, unnest(list_concat(list_transform(regexp_extract_all(html, {q(CANONICAL)}), lambda y: regexp_extract(y, {q(CANONICAL)}, 1) || regexp_extract(y, {q(CANONICAL)}, 2)), regexp_extract_all(html, {q(REFRESH)}, 1))) AS x FROM p WHERE contains(url, '://')),
    e0 AS (SELECT {addr("url")} AS src, {addr(f"({link})")} AS dst FROM links),
    e AS (SELECT src AS a, dst AS b FROM e0 WHERE dst IS NOT NULL UNION SELECT dst, src FROM e0 WHERE dst IS NOT NULL),
    reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    nodes AS (SELECT a, b, regexp_extract(b, '^([^/?]*)', 1) AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM reach),
    bad AS (SELECT a FROM ({judged("nodes")}) GROUP BY a HAVING bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false))
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
    FROM r LEFT JOIN bad ON bad.a = {addr("r.url")}"""


SQL = _sql()
