"""URL decisions by host and path rules, carried over to aliases.

URLs that name one page stand for each other: those with one normal form (scheme, fragment, tracking
parameters and a last slash aside), and those that a canonical link or a refresh leads to. Aliases
are the connected components over these edges. A page that no rule fits takes its component's
decision: allow, if any member is allowed by a rule; else block, if any is blocked; else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut
from tapeloom.llm.components import connected_components

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does. Rules are
    configuration: each adds one condition."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """Host, path without a last slash, and the query without tracking parameters."""
    query = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]*|ref|fbclid|gclid)(=|$)")), "&")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _target(html: Column, tag: str, mark: str, value: str) -> Column:
    tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)(<{tag}\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(mark))
    return F.regexp_extract(F.coalesce(F.get(tags, F.lit(0)), F.lit("")), value, 1)


def _resolved(target: Column, url: Column) -> Column:
    """An absolute target; null for none. Relative ones count from ``url``."""
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when((t == "") | t.rlike("(?i)^(javascript|mailto|data|#)"), F.lit(None).cast("string"))
        .when(F.instr(t, "://") > 0, t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), t))
    )


def decide_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path, fits no rule, has no alias (its
    component is null) and is allowed. Null html has no links. Repeated rows stay, other columns are
    ignored, an empty table gives no rows.
    """
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    canonical = _target(html, "link", r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""")
    refresh = _target(html, "meta", r"""(?i)http-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""")
    real = F.instr(F.coalesce(url, F.lit("")), "://") > 0
    known = pages.select("page_id", url, host_of(url).alias("host"), path_of(url).alias("path"), F.when(real, normal_form(url)).alias("node"),
                         F.when(real, F.filter(F.array(_resolved(canonical, url), _resolved(refresh, url)), lambda t: t.isNotNull())).alias("targets"))
    judged = cut(known.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).drop("url"), "pages")
    links = judged.filter(F.size("targets") > 0).select("node", F.explode("targets").alias("target"))
    comps = connected_components(links.select(F.col("node").alias("a"), normal_form(F.col("target")).alias("b")))
    # A link's target counts by its own rule, though it may be no page of the table.
    targets = links.select(normal_form(F.col("target")).alias("node"), rule_of(host_of(F.col("target")), path_of(F.col("target")), rules).alias("fits"))
    told = judged.select("node", "fits").unionByName(targets).filter("fits is not null and node is not null")
    by_node = told.groupBy("node").agg(F.bool_or(F.col("fits.verdict") == "allow").alias("allow"))
    member = F.coalesce("component", "node").alias("component")
    by_comp = by_node.join(comps, "node", "left").select(member, "allow").groupBy("component").agg(F.bool_or("allow").alias("allow"))
    placed = judged.join(comps, "node", "left").select("page_id", "host", "path", "fits", member)
    carried = F.when(F.coalesce("allow", F.lit(True)), "allow").otherwise("block")
    return placed.join(by_comp, "component", "left").select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", carried).alias("verdict"), "component")
