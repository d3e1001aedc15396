"""Rewriting pages for offline viewing.

A page keeps its token array; ``transform`` maps every token: ``<a href>``
to the local page path, asset attributes to the local file when the asset
was fetched, every srcset entry, ``<style>`` bodies through ``rewrite_css``,
and SRI attributes removed.  Only tags that change are re-serialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ASSET_ATTRS, ASSET_RELS
from ..functions import css as C
from ..functions import html as H
from ..functions import urls as U
from ..functions.urls import let
from . import extract as X

SRI_ATTRS = ["integrity", "crossorigin"]
SRI_TAGS = ["script", "link", "style"]


def _path(absu: Column, named: Column, parts: Column | None = None, up: Column | None = None) -> Column:
    """A3: how a URL is referred to; ``named`` holds those that are not stored
    where the URL alone says.  Others are referred to from the root, ``up`` from
    the page."""
    path = U.file_path(absu, parts=parts)
    return F.coalesce(F.try_element_at(named, absu), path if up is None else F.concat(up, path))


def _srcset_rewrite(v: Column, base: Column, bp: Column, named: Column, mapped, up) -> Column:
    def entry(e):
        toks = F.when(e["url"].isNotNull(), F.concat(
            F.array(U.let(mapped(U.resolve_parts(bp, base, e["url"])), lambda a: _path(a, named, up=up))),
            F.slice(e["tokens"], 2, F.greatest(F.size(e["tokens"]) - 1, F.lit(0))))).otherwise(e["tokens"])
        return F.array_join(toks, " ")
    return F.array_join(F.transform(H.srcset_entries(v), entry), ", ")


def _rewrite_attrs(name: Column, attrs: Column, base: Column, bp: Column, fetched: Column, named: Column,
                   mapped, up) -> Column:
    """New attribute list of an asset tag (first occurrence of each asset
    attribute is considered, as a DOM would)."""
    attr_list = F.coalesce(F.try_element_at(H.asset_attr_map(), name), F.array().cast("array<string>"))
    lnames = F.transform(attrs, lambda a: F.lower(a["name"]))
    rel = F.coalesce(H.split_ws(H.attr_of(attrs, "rel")), F.array().cast("array<string>"))
    link_ok = F.arrays_overlap(rel, F.array(*[F.lit(r) for r in ASSET_RELS]))

    def one(a, i):
        ln = F.lower(a["name"])
        v = a["value"]
        first = F.array_position(lnames, ln) == (i + 1)
        eligible = first & F.array_contains(attr_list, ln) & v.isNotNull() & (v != "") & ~v.startswith("data:")
        new_v = (F.when(~eligible, F.lit(None).cast("string"))
                 .when(ln.isin(X.SRCSET_ATTRS), _srcset_rewrite(v, base, bp, named, mapped, up))
                 .when((name == "link") & ~link_ok, F.lit(None).cast("string"))
                 .otherwise(F.try_element_at(fetched, U.resolve_parts(bp, base, v))))
        return let(new_v, lambda nv: F.when(nv.isNotNull() & (nv != v), F.struct(
            a["name"].alias("name"), H.quote_attr(nv).alias("raw"), nv.alias("value"))).otherwise(a))

    return let(F.transform(attrs, one), lambda out: F.when(
        name.isin(SRI_TAGS), H.drop_attrs(out, SRI_ATTRS)).otherwise(out))


def _rewrite_anchor(attrs: Column, base: Column, bp: Column, seed_netloc: Column, follow: bool, named: Column,
                    mapped, up) -> Column:
    lnames = F.transform(attrs, lambda a: F.lower(a["name"]))

    def target(a, absu, p):
        keep = (p["scheme"].isin("http", "https") & ((p["netloc"] == seed_netloc) | F.lit(follow))
                & U.is_html_parts(p))
        return F.when(keep, let(_path(absu, named, p, up), lambda lp: F.struct(
            a["name"].alias("name"), H.quote_attr(lp).alias("raw"), lp.alias("value")))).otherwise(a)

    def one(a, i):
        v = a["value"]
        first = (F.lower(a["name"]) == "href") & (F.array_position(lnames, F.lit("href")) == (i + 1))
        return F.when(first & v.isNotNull() & (v != ""), let(
            mapped(U.resolve_parts(bp, base, v)),
            lambda absu: let(U.url_parts(absu), lambda p: target(a, absu, p)))).otherwise(a)
    return F.transform(attrs, one)


def rewrite_tokens(tokens: Column, base: Column, seed: Column, fetched: Column,
                   follow_domains: bool = False, named: Column | None = None, map_url=None,
                   up: Column | None = None, name_css: bool = False) -> Column:
    """Map each token of a page to its offline form (see module doc).
    ``named`` (URL -> path) goes before the path that a URL has by itself;
    ``map_url`` is applied to links and srcset entries (``fetched`` is keyed
    by the URLs as the page gives them).  ``up`` leads from the page's file to
    the root, where references are to be relative; those of ``fetched`` and
    ``named`` are taken as they are.  ``name_css``: they hold for ``<style>``
    blocks too."""
    named = F.create_map().cast("map<string,string>") if named is None else F.coalesce(
        named, F.create_map().cast("map<string,string>"))
    mapped = map_url or (lambda c: c)
    asset_tags = [t for t, _ in ASSET_ATTRS]
    fetched = F.coalesce(fetched, F.create_map().cast("map<string,string>"))
    # base and seed parsed once per page
    per_page = F.struct(U.url_parts(base).alias("bp"), U.authority(seed).alias("sn"))
    return let(per_page, lambda pp: _rewrite_all(tokens, base, pp["bp"], pp["sn"], fetched, follow_domains,
                                                 asset_tags, named, mapped, up, name_css))


def _rewrite_all(tokens, base, bp, sn, fetched, follow_domains, asset_tags, named, mapped, up, name_css):
    def one(t):
        def tag(info):
            st, name, attrs = info["st"], info["name"], info["attrs"]
            new_attrs = (F.when(name == "a", _rewrite_anchor(attrs, base, bp, sn, follow_domains, named, mapped, up))
                         .when(name.isin(asset_tags + ["style"]),
                               _rewrite_attrs(name, attrs, base, bp, fetched, named, mapped, up))
                         .otherwise(attrs))
            new_st = let(new_attrs, lambda na: F.when(na == attrs, st).otherwise(H.rebuild_tag(st, na)))
            rest = F.substring(t, F.length(st) + 1, F.lit(2147483647))
            css = H.element_text(t, "style")
            style_rest = F.concat(C.rewrite_css(css, base, named, up) if name_css else C.rewrite_css(css, base),
                                  F.regexp_extract(t, r"(?is)</style\s*+>$", 0))
            return F.concat(new_st, F.when(name == "style", style_rest).otherwise(rest))
        return F.when(H.is_start_tag(t, ["a", "style"] + asset_tags), let(
            F.struct(H.start_tag(t).alias("st"), H.tag_name(t).alias("name"), H.attributes(t).alias("attrs")),
            tag)).otherwise(t)

    return F.transform(tokens, one)


def fetched_maps(assets: DataFrame, fetched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per page, ``map<abs_url, local_path>`` of the assets that exist in
    ``fetched(abs_url)``; the path uses the first content-type hint (A2/A3)."""
    keys = list(keys or ["page_id"])
    d = X.distinct_assets(assets, keys)
    hit = d.join(fetched.select("abs_url").distinct(), "abs_url", "left_semi")
    return (hit.withColumn("local_path", U.file_path(F.col("abs_url"), F.col("content_type")))
            .groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(F.struct("abs_url", "local_path"))).alias("fetched")))


def rewrite_pages(pages: DataFrame, fetched: DataFrame | None = None, base_col: str = "url",
                  seed_col: str | None = None, follow_domains: bool = False,
                  keys: list[str] | None = None) -> DataFrame:
    """``(*keys, html)`` rewritten.  ``fetched(abs_url)`` lists assets
    that were downloaded (now or in an earlier run); others keep their URL."""
    keys = list(keys or ["page_id"])
    p = pages
    if fetched is not None:
        tok = X.with_tokens(pages) if "tokens" not in pages.columns else pages
        maps = fetched_maps(X.extract_assets(tok, base_col=base_col, keep=[k for k in keys if k != "page_id"]),
                            fetched, keys)
        # join the small per-page maps to the raw page, tokenise after the
        # join: token arrays are larger than the HTML and never shuffled
        p = p.join(maps, keys, "left")
    else:
        p = p.withColumn("fetched", F.lit(None).cast("map<string,string>"))
    if "tokens" not in p.columns:
        p = X.with_tokens(p)
    seed = F.col(seed_col) if seed_col else F.col(base_col)
    out = rewrite_tokens(F.col("tokens"), F.col(base_col), seed, F.col("fetched"), follow_domains)
    return p.select(*keys, F.array_join(out, "").alias("html"))
