"""robots.txt as data (S5) and the fetch test against it.

Each robots file is one row; its lines become one string of kinds, in which a
single search finds the first ``User-agent: *`` group with rules (the group a
``*`` crawler obeys), so parsing needs no shuffle and no fold.  URLs are then tested against their own
host's rules: first matching rule in file order wins, no match allows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.urls import let

_RULE_T = "array<struct<line_no:int,allow:boolean,prefix:string>>"


def _unquote(x: Column) -> Column:
    """urllib.parse.unquote: %XX decoded, '+' kept, malformed escapes literal."""
    fixed = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(fixed), x)


def _line(raw: Column, i: Column) -> Column:
    """A line as (kind, line_no, allow, prefix): ``b`` blank, ``s`` an agent line for ``*``, ``a`` one for others, ``r`` a rule;
    other lines (comments, unknown keys) have no kind."""
    def build(content):
        key = F.lower(F.regexp_replace(F.substring_index(content, ":", 1), r"^\s+|\s+$", ""))
        val = _unquote(F.regexp_replace(F.regexp_extract(content, r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", ""))
        kind = (F.when(raw == "", "b").when(~content.contains(":"), "")
                .when(key == "user-agent", F.when(val == "*", "s").otherwise("a"))
                .when(key.isin("allow", "disallow"), "r").otherwise(""))
        return F.struct(kind.alias("kind"), i.alias("line_no"), ((key == "allow") | (val == "")).alias("allow"),
                        val.alias("prefix"))
    return let(F.regexp_replace(F.regexp_replace(raw, "#.*$", ""), r"^\s+|\s+$", ""), build)


#: The first run of agent lines that names ``*`` and goes straight on to rules, and those rules.  It starts only where a run of
#: agent lines starts and gives nothing back, so that a file is read once.
_STAR_GROUP = "(?<![as])(a*+s[as]*+)(r++)"


def robots_rules_column(body) -> Column:
    """Rules of the effective ``*`` group of one robots file, in file order.

    A group is a run of agent lines and the rules after it, up to a blank or another agent line; so the rules are neighbours
    among the lines that have a kind, and one search over the string of kinds finds them, whatever the number of rules."""
    lines = F.split(F.coalesce(body, F.lit("")) if not isinstance(body, str) else F.col(body), r"\r\n|\r|\n", -1)
    told = F.filter(F.transform(lines, _line), lambda x: x["kind"] != "")

    def pick(told):
        def rules(kinds):
            start = F.regexp_instr(kinds, F.lit(_STAR_GROUP)) + F.length(F.regexp_extract(kinds, _STAR_GROUP, 1))
            n = F.length(F.regexp_extract(kinds, _STAR_GROUP, 2))
            return F.when(n > 0, F.transform(F.slice(told, F.greatest(start, F.lit(1)), n), lambda x: F.struct(
                x["line_no"].alias("line_no"), x["allow"].alias("allow"), x["prefix"].alias("prefix")))
            ).otherwise(F.array().cast(_RULE_T))
        return let(F.array_join(F.transform(told, lambda x: x["kind"]), ""), rules)
    return let(told, pick)


def parse_robots(files: DataFrame) -> DataFrame:
    """``files(host, status, body)`` -> ``robots(host, line_no, allow, prefix)``.

    2xx/3xx: parsed; 401/403 and 5xx: deny everything (one rule ``allow=false,
    prefix=''``); other 4xx: no rules (allow).  Hosts with no row at all
    (unreachable robots.txt) are allowed by the filter."""
    st = F.col("status")
    deny = F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(False).alias("allow"), F.lit("").alias("prefix")))
    rules = (F.when(st.isin(401, 403) | (st >= 500), deny)
             .when(st >= 400, F.array().cast(_RULE_T))
             .otherwise(robots_rules_column(F.col("body"))))
    return (files.select("host", F.explode(rules).alias("r"))
            .select("host", "r.line_no", "r.allow", "r.prefix"))


def robots_target(url) -> Column:
    """What a rule prefix is matched against: unquoted path;params?query."""
    def build(p):
        t = F.concat(p["path"], F.when(p["params"] != "", F.concat(F.lit(";"), p["params"])).otherwise(F.lit("")),
                     F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")))
        t = _unquote(t)
        return F.when(t == "", F.lit("/")).otherwise(t)
    return let(U.url_parts(url), build)


def host_rule_lists(robots: DataFrame) -> DataFrame:
    """One row per host with its rules in file order (bounded by the size of
    one robots file)."""
    return (robots.groupBy("host")
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "allow", "prefix"))).alias("rules")))


def robots_filter(urls: DataFrame, robots: DataFrame, url_col: str = "norm_url",
                  exempt_col: str | None = None) -> DataFrame:
    """Adds ``robots_allowed``.  Rules are joined by the URL's own host
    (equi-join on a small per-host table); the first rule whose prefix starts
    the target decides; no rule allows; ``exempt_col`` (the seed) is always
    allowed."""
    lists = host_rule_lists(robots)
    u = urls.withColumn("_host", U.authority(url_col))
    j = u.join(lists.withColumnRenamed("host", "_host"), "_host", "left")
    return j.withColumn("robots_allowed", _allowed_expr(url_col, exempt_col)).drop("_host", "rules")


@lru_cache(maxsize=16)
def _allowed_expr(url_col: str, exempt_col: str | None) -> Column:
    target = robots_target(F.col(url_col))
    first = let(target, lambda t: F.try_element_at(
        F.filter(F.coalesce(F.col("rules"), F.array().cast("array<struct<line_no:int,allow:boolean,prefix:string>>")),
                 lambda r: t.startswith(r["prefix"])), F.lit(1)))
    allowed = F.coalesce(first["allow"], F.lit(True))
    if exempt_col:
        allowed = allowed | (F.col(url_col) == F.col(exempt_col))
    return allowed
