"""Row generators over pages: the corpus view, links, assets, meta refresh,
style blocks and CSS references.

Per page, the rows are built as a filtered array of structs and then
``inline``-d.  Keeping the filter inside the array (instead of a ``where``
after a projection) stops Catalyst from pushing the predicate below the
projection and evaluating the URL expressions twice.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ASSET_ATTRS, ASSET_RELS, SKIP_HREF_PREFIXES
from ..functions import css as C
from ..functions import html as H
from ..functions import urls as U
from ..functions.urls import let

ASSET_TAGS = [t for t, _ in ASSET_ATTRS]
SRCSET_ATTRS = ["srcset", "data-srcset"]


def corpus(pages: DataFrame) -> DataFrame:
    """One row per normalised URL: ``(norm_url, page_id, url, html)``; the
    lowest ``page_id`` wins when the corpus holds several copies.  Only keys
    are aggregated; the html stays where it was read, and the losing pages are
    taken out by their id."""
    keys = pages.select("page_id", U.normalize_url("url").alias("norm_url"))
    copies = (keys.groupBy("norm_url").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    losers = keys.join(copies, "norm_url").where("page_id != first").select("page_id")
    return pages.join(losers, "page_id", "left_anti").select(
        U.normalize_url("url").alias("norm_url"), "page_id", "url", "html")


def with_tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Tokenise once; later operators read the ``tokens`` column."""
    return pages.withColumn("tokens", H.tokenize_html(html_col))


def _tokens(df: DataFrame) -> Column:
    return F.col("tokens") if "tokens" in df.columns else H.tokenize_html("html")


def _link_row(bp: Column, base: Column, seed_netloc: Column, follow: bool, tok: Column, i: Column) -> Column:
    def with_href(h):
        ok = h.isNotNull() & (h != "")
        for p in SKIP_HREF_PREFIXES:
            ok = ok & ~h.startswith(p)
        return let(U.resolve_parts(bp, base, h), lambda a: let(U.url_parts(a), lambda p: F.struct(
            i.alias("pos"), h.alias("href"), a.alias("abs_url"),
            U.normalize_parts(p).alias("norm_url"),
            (ok & p["scheme"].isin("http", "https") & (F.lit(follow) | (p["netloc"] == seed_netloc))
             & U.is_html_parts(p)).alias("keep"))))
    return let(H.attr_value(tok, "href"), with_href)


def extract_links(pages: DataFrame, base_col: str = "url", seed_col: str | None = None,
                  follow_domains: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``<a href>`` links in document order that a crawl would follow:
    ``(*keep, page_id, pos, href, abs_url, norm_url)``.

    Skips empty hrefs and ``#`` / ``javascript:`` / ``mailto:``; resolves
    against ``base_col``; keeps http(s) targets on the same domain (netloc of ``seed_col``, default
    the page itself) or all when ``follow_domains``; keeps HTML-like targets.
    Duplicates are retained (``pos`` is the index among ``<a>`` tags)."""
    keep = list(keep or [])
    rows = link_rows("tokens" if "tokens" in pages.columns else None, base_col, seed_col, follow_domains)
    return (pages.select(*keep, "page_id", F.inline(rows))
            .drop("keep"))


@lru_cache(maxsize=64)
def link_rows(tokens_col: str | None, base_col: str, seed_col: str | None, follow_domains: bool) -> Column:
    """The per-page link-row expression, built once per signature: Column
    trees are reusable across DataFrames, and building them is many JVM
    calls (this matters in the crawl loop, which re-plans every level)."""
    base = F.col(base_col)
    seed = F.col(seed_col) if seed_col else base
    toks = F.col(tokens_col) if tokens_col else H.tokenize_html("html")
    a_tags = F.filter(toks, lambda t: H.is_start_tag(t, ["a"]))
    # base and seed are parsed once per page, each link once
    per_page = F.struct(U.url_parts(base).alias("bp"), U.authority(seed).alias("sn"))
    return let(per_page, lambda pp: F.filter(
        F.transform(a_tags, lambda t, i: _link_row(pp["bp"], base, pp["sn"], follow_domains, t, i)),
        lambda r: r["keep"]))


def _rel_tokens(attrs: Column) -> Column:
    return F.coalesce(H.split_ws(H.attr_of(attrs, "rel")), F.array().cast("array<string>"))


def _asset_rows(tok: Column, ti: Column) -> Column:
    """All asset references of one start tag, in attribute order."""
    def per_tag(a):
        rel = _rel_tokens(a["attrs"])
        link_ok = F.arrays_overlap(rel, F.array(*[F.lit(r) for r in ASSET_RELS]))
        is_css = F.array_contains(rel, "stylesheet")
        hint = (F.when(a["name"] == "script", F.lit("application/javascript"))
                .when((a["name"] == "link") & is_css, F.lit("text/css"))
                .when((a["name"] == "link") & (F.array_contains(rel, "icon")
                                               | F.array_contains(rel, "shortcut icon")),
                      F.lit("image/x-icon"))
                .otherwise(F.lit(None).cast("string")))
        tag_rank = F.try_element_at(H.asset_tag_rank_map(), a["name"])

        def per_attr(attr, ai):
            def with_value(v):
                def entry(e):
                    return F.struct(tag_rank.alias("tag_rank"), ti.alias("tag_pos"), ai.alias("attr_rank"),
                                    e["idx"].alias("srcset_idx"), a["name"].alias("tag"), attr.alias("attr"),
                                    e["url"].alias("raw"), F.lit(None).cast("string").alias("content_type"),
                                    F.lit(False).alias("is_stylesheet"))
                single = F.array(F.struct(
                    tag_rank.alias("tag_rank"), ti.alias("tag_pos"), ai.alias("attr_rank"),
                    F.lit(-1).alias("srcset_idx"), a["name"].alias("tag"), attr.alias("attr"),
                    v.alias("raw"), hint.alias("content_type"),
                    ((a["name"] == "link") & is_css).alias("is_stylesheet")))
                empty = F.filter(single, lambda x: F.lit(False))
                return (F.when(v.isNull() | (v == "") | v.startswith("data:"), empty)
                        .when(attr.isin(SRCSET_ATTRS),
                              F.transform(F.filter(H.srcset_entries(v), lambda e: e["url"].isNotNull()), entry))
                        .when((a["name"] == "link") & ~link_ok, empty)
                        .otherwise(single))
            return let(H.attr_of(a["attrs"], attr), with_value)

        attrs_for_tag = F.try_element_at(H.asset_attr_map(), a["name"])
        return F.flatten(F.transform(attrs_for_tag, per_attr))

    return let(F.struct(H.tag_name(tok).alias("name"), H.attributes(tok).alias("attrs")), per_tag)


def extract_assets(pages: DataFrame, base_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Asset references of each page (no domain filter):
    ``(*keep, page_id, tag_rank, tag_pos, attr_rank, srcset_idx, tag, attr, raw,
    abs_url, content_type, is_stylesheet, local_path)``.

    Order of discovery is ``(tag_rank, tag_pos, attr_rank, srcset_idx)``: tag
    type first, then document order, then attribute order."""
    keep = list(keep or [])
    asset_toks = F.filter(_tokens(pages), lambda t: H.is_start_tag(t, ASSET_TAGS))
    rows = F.flatten(F.transform(asset_toks, lambda t, i: _asset_rows(t, i)))
    out = pages.select(*keep, "page_id", F.col(base_col).alias("_base"), F.inline(rows))
    out = out.withColumn("abs_url", U.resolve_url("_base", "raw"))
    return (out.withColumn("local_path", U.file_path(F.col("abs_url"), F.col("content_type")))
            .drop("_base"))


def distinct_assets(assets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One download per (page, abs_url); the first content-type hint in
    discovery order wins, even when it is NULL."""
    keys = list(keys or ["page_id"])
    order = F.struct("tag_rank", "tag_pos", "attr_rank", "srcset_idx")
    return (assets.where(~F.col("abs_url").startswith("data:"))
            .groupBy(*keys, "abs_url")
            .agg(F.min_by(F.struct("content_type", "is_stylesheet"), order).alias("f"),
                 F.min(order).alias("first_ref"))
            .select(*keys, "abs_url", "f.content_type", "f.is_stylesheet", "first_ref"))


def extract_meta_refresh(pages: DataFrame, base_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Target of the first ``<meta http-equiv=refresh>`` of each page that has
    a ``url=`` in its content: ``(*keep, page_id, pos=-1, abs_url, norm_url)``."""
    keep = list(keep or [])
    rows = refresh_rows("tokens" if "tokens" in pages.columns else None, base_col)
    return pages.select(*keep, "page_id", F.inline(rows))


@lru_cache(maxsize=8)
def refresh_rows(tokens_col: str | None, base_col: str) -> Column:
    toks = F.col(tokens_col) if tokens_col else H.tokenize_html("html")
    metas = F.filter(F.filter(toks, lambda t: H.is_start_tag(t, ["meta"])),
                     lambda t: F.lower(H.attr_value(t, "http-equiv")) == "refresh")
    content = H.attr_value(F.try_element_at(metas, F.lit(1)), "content")
    target = F.regexp_extract(content, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1)

    def row(t):
        return U.let(U.resolve_url(F.col(base_col), t), lambda a: F.struct(
            F.lit(-1).alias("pos"), a.alias("abs_url"), U.normalize_url(a).alias("norm_url")))
    # no target: no row
    return F.transform(F.filter(F.array(target), lambda t: t != ""), row)


def extract_style_blocks(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Text of every non-empty ``<style>`` element: ``(*keep, page_id, pos, css)``."""
    keep = list(keep or [])
    styles = F.filter(_tokens(pages), lambda t: H.is_start_tag(t, ["style"]))
    blocks = F.filter(F.transform(styles, lambda t, i: F.struct(i.alias("pos"), H.element_text(t, "style").alias("css"))),
                      lambda s: s["css"] != "")
    return pages.select(*keep, "page_id", F.inline(blocks))


def extract_css_refs(styles: DataFrame, css_col: str = "css", base_col: str = "base",
                     keep: list[str] | None = None) -> DataFrame:
    """``url()`` (non-``data:``) and ``@import`` references of stylesheets:
    ``(*keep, kind, ref_pos, raw, abs_url, local_path)``; url pass first."""
    keep = list(keep or [])
    urls = F.transform(C.css_url_refs(css_col), lambda r, i: F.struct(
        F.lit("url").alias("kind"), i.alias("ref_pos"), r.alias("raw")))
    imports = F.transform(C.css_import_refs(css_col), lambda r, i: F.struct(
        F.lit("import").alias("kind"), i.alias("ref_pos"), r.alias("raw")))
    refs = F.filter(F.concat(urls, imports), lambda r: ~((r["kind"] == "url") & r["raw"].startswith("data:")))
    out = styles.select(*keep, F.col(base_col).alias("_base"), F.inline(refs))
    out = out.withColumn("abs_url", U.resolve_url("_base", "raw"))
    return out.withColumn("local_path", U.file_path(F.col("abs_url"))).drop("_base")
