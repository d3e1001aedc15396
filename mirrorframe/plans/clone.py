"""C1 ``clone_site``: crawl -> hooks -> assets -> downloads (classified,
byte-budgeted) -> rewrite -> snapshot files (last writer per path), for many
seeds at once.  F1-F3 plugin hooks are plain Column/DataFrame functions.

References are read from the chosen pages once, into a narrow table.  All
policies work on keys, orders and sizes; bodies and html are joined last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import css as C
from ..functions import urls as U
from ..operators import extract as X
from ..operators.policy import block_private, classify_asset, null_safe, offered_budget
from ..operators.rewrite import rewrite_tokens
from ..operators.snapshot import last_writer, latest_answers, merge_snapshot, path_map, plan_downloads
from ..operators.stylesheets import sheet_closure, sheet_edges
from ..session import Scratch
from .crawl import crawl


@dataclass
class Hooks:
    """F1 ``after_html(url, html) -> html`` before rewriting; F2
    ``map_url(url) -> url`` on every discovered URL; F3
    ``export(site_files)`` after the clone."""

    after_html: Callable[[Column, Column], Column] | None = None
    map_url: Callable[[Column], Column] | None = None
    export: Callable[[DataFrame], None] | None = None


#: The order in which a crawl meets its references: page, kind of tag, place on the page, attribute, srcset entry, and the
#: reference inside a downloaded stylesheet (-1: the file itself).
ORDER = ["crawl_rank", "tag_rank", "tag_pos", "attr_rank", "srcset_idx", "sheet_ref"]
#: A sheet's imports come after its other references, and what its imported sheets refer to after those, by level: places on a sheet
#: are places in an array and so below this.
AFTER = 1 << 31


@dataclass
class Clone:
    """A run's files, all that write a path (``written``) and those that stay,
    and the snapshot that the next run starts from.  The plan that rewrites
    the files is built only where they are asked for."""

    build: Callable[[], DataFrame]
    snapshot: DataFrame | None

    @property
    def written(self) -> DataFrame:
        return self.build()

    @property
    def files(self) -> DataFrame:
        return last_writer(self.written, ["crawl_id"], "write_seq")


def accepted_responses(responses: DataFrame, max_asset_size: int) -> DataFrame:
    """One accepted answer per URL, the latest by ``attempt`` and ``ts`` (where
    the table has them; else by the hash of the body): ``(abs_url, size, _rk)``
    names the rows of ``responses`` that ``with_body`` returns;
    ``answered_type`` is its Content-Type, if the table has it."""
    rows = _ranked_responses(responses, max_asset_size)
    kind = F.col("content_type") if "content_type" in responses.columns else F.lit(None).cast("string")
    return rows.groupBy("abs_url").agg(F.max("_rk").alias("_rk"), F.max_by("size", "_rk").alias("size"),
                                       F.max_by(kind, "_rk").alias("answered_type"))


def _ranked_responses(responses: DataFrame, max_asset_size: int) -> DataFrame:
    by = [F.col(c) for c in ("attempt", "ts") if c in responses.columns]
    return (responses.where(classify_asset("status", "size", url="url", max_asset_size=max_asset_size) == "accept")
            .withColumn("_rk", F.struct(*by, F.md5("body").alias("hash")))
            .withColumnRenamed("url", "abs_url"))


def with_body(files: DataFrame, responses: DataFrame, max_asset_size: int) -> DataFrame:
    """``files(abs_url, _rk, ...)`` with the body of that answer."""
    bodies = _ranked_responses(responses, max_asset_size).select("abs_url", "_rk", "body")
    wanted = files.select("abs_url", "_rk").distinct()
    bodies = bodies.join(wanted, ["abs_url", "_rk"], "left_semi").dropDuplicates(["abs_url", "_rk"])
    return files.join(bodies, ["abs_url", "_rk"])


def clone_site(pages: DataFrame, seeds: DataFrame, cfg: CrawlConfig | None = None,
               responses: DataFrame | None = None, robots: DataFrame | None = None,
               sitemap_urls: DataFrame | None = None, hooks: Hooks | None = None,
               dns: DataFrame | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """Snapshot files ``(crawl_id, local_path, kind, source_url, content,
    write_seq)`` of ``clone_run``."""
    out = clone_run(pages, seeds, cfg, responses, robots, sitemap_urls, hooks, dns, snapshot).files
    if hooks is not None and hooks.export is not None:
        hooks.export(out)
    return out


def clone_run(pages: DataFrame, seeds: DataFrame, cfg: CrawlConfig | None = None,
              responses: DataFrame | None = None, robots: DataFrame | None = None,
              sitemap_urls: DataFrame | None = None, hooks: Hooks | None = None,
              dns: DataFrame | None = None, snapshot: DataFrame | None = None) -> Clone:
    """One run over many sites.

    ``responses(url, status, content_type, body, size)`` are the asset answers
    (only 'accept' outcomes are stored, within the byte budget), with ``etag,
    last_modified, attempt, ts`` if there are any.  ``snapshot`` lists files of
    an earlier run, which are referred to and not stored again; where it has
    validators (``snapshot.SNAPSHOT``) a file is stored again if the server
    sent it anew, and not if it answered 304 or failed.  Pages, downloaded
    assets, stylesheets (their ``url()``/``@import`` rewritten) and files
    referenced from CSS are written; the last write of a path wins.  Only
    http(s) URLs off private hosts are downloaded.  ``Clone.snapshot`` is the
    earlier snapshot merged with this run's answers, of files that were asked
    for and, where accepted, stored (None without ``responses``)."""
    cfg = cfg or CrawlConfig()
    hooks = hooks or Hooks()
    spark = pages.sparkSession
    after = None
    with Scratch(spark, "clone") as scratch:
        got = crawl(pages, seeds, cfg, robots=robots, sitemap_urls=sitemap_urls, keep_html=True, dns=dns,
                    map_url=hooks.map_url)
        if hooks.after_html is not None:
            got = got.withColumn("html", hooks.after_html(F.col("norm_url"), F.col("html")))
        got = scratch.keep(got.select("crawl_id", "page_id", "norm_url", "seed_url", "crawl_rank", "html"))
        refs = scratch.table(_references(got, cfg, hooks))

        files = refs.where("kind = 'file'")
        allowed = block_private(files.select("abs_url").where(U.valid_scheme("abs_url")).distinct(), "abs_url", dns)
        if cfg.block_private:
            allowed = allowed.where(~F.col("is_private"))
        allowed = scratch.table(allowed.select("abs_url"))
        plan = plan_downloads(files.join(allowed, "abs_url", "left_semi"), order=ORDER)
        plan = scratch.table(plan.select("crawl_id", "abs_url", "content_type", "is_stylesheet", "first_ref.*"))
        have = snapshot.select(F.col("url").alias("abs_url")).distinct() if snapshot is not None else None
        met, sheets_read = None, None
        if responses is not None:
            answers = scratch.table(accepted_responses(responses, cfg.max_asset_size))
            if have is not None and {"etag", "last_modified"} & set(snapshot.columns):
                have = have.join(answers.select("abs_url"), "abs_url", "left_anti")
            have = scratch.table(have) if have is not None else None
            stored, met, sheets_read = _downloads(plan, answers, responses, have, cfg, hooks, dns, scratch)
            stored = scratch.keep(stored)
            latest = scratch.table(latest_answers(responses, cfg.max_asset_size))
            after = scratch.keep(_next_snapshot(snapshot, latest, plan, met, stored))
        else:
            stored = scratch.keep(plan.where(F.lit(False)).withColumn("size", F.lit(0).cast("long"))
                                  .withColumn("_rk", F.struct(F.lit("").alias("hash"))))
        # A3: one path per URL, for links, assets and files
        every = refs.select("crawl_id", F.col("abs_url").alias("url"), "content_type", F.struct(
            "crawl_rank", F.when(F.col("kind") == "file", 0).otherwise(1).alias("kind_rank"), *ORDER[1:]).alias("seq"))
        own_names = cfg.use_response_type or cfg.external_prefix or cfg.relative
        if cfg.external_prefix or cfg.relative:
            every = every.unionByName(got.select("crawl_id", F.col("norm_url").alias("url"), F.lit(None).cast("string").alias(
                "content_type"), F.struct("crawl_rank", F.lit(2).alias("kind_rank"), *[
                    F.lit(0).cast(refs.schema[c].dataType).alias(c) for c in ORDER[1:]]).alias("seq")))
        if own_names and met is not None:
            every = every.unionByName(met.select("crawl_id", F.col("abs_url").alias("url"), "content_type", F.struct(
                "crawl_rank", F.lit(0).alias("kind_rank"), *ORDER[1:]).alias("seq")))
        said = None
        if cfg.use_response_type and responses is not None:
            said = (stored.join(answers.select("abs_url", "answered_type"), "abs_url")
                    .select(F.col("abs_url").alias("url"), F.col("answered_type").alias("content_type")))
        homes = got.select("crawl_id", U.authority("seed_url").alias("seed_netloc")).distinct() if cfg.external_prefix else None
        named = scratch.keep(path_map(every, said, homes, whole=cfg.relative))
        stored = stored.join(named.withColumnRenamed("url", "abs_url"), ["crawl_id", "abs_url"], "left").withColumn(
            "local_path", F.coalesce("local_path", U.file_path(F.col("abs_url"), F.col("content_type"))))

        # J5 per page: references that are there, now or from before, and paths that a hint has decided
        there = stored.select("crawl_id", "abs_url", "local_path")
        if have is not None:
            old = (plan.join(have, "abs_url", "left_semi")
                   .join(named.withColumnRenamed("url", "abs_url").withColumnRenamed("local_path", "_named"),
                         ["crawl_id", "abs_url"], "left")
                   .select("crawl_id", "abs_url", F.coalesce("_named", U.file_path(
                       F.col("abs_url"), F.col("content_type"))).alias("local_path")))
            there = there.unionByName(old).dropDuplicates(["crawl_id", "abs_url"])
        # how the page's file, or the stylesheet's, refers to a path
        places = got.select("crawl_id", "page_id", F.col("norm_url").alias("url")).join(
            named.withColumnRenamed("local_path", "_named"), ["crawl_id", "url"], "left").select(
            "crawl_id", "page_id", F.coalesce("_named", U.file_path(F.col("url"))).alias("_own"))

        def refer(rows, own, keys):
            if not cfg.relative:
                return rows
            return rows.join(own, keys).withColumn("local_path", U.relative_path(F.col("_own"), F.col("local_path"))).drop("_own")

        maps = (refer(files.select("crawl_id", "page_id", "abs_url", "ref_url").distinct().join(there, ["crawl_id", "abs_url"]),
                      places, ["crawl_id", "page_id"])
                .groupBy("crawl_id", "page_id")
                .agg(F.map_from_entries(F.collect_set(F.struct("ref_url", "local_path"))).alias("fetched")))
        names = (refer(refs.select("crawl_id", "page_id", F.col("abs_url").alias("url")).distinct()
                       .join(named, ["crawl_id", "url"]), places, ["crawl_id", "page_id"])
                 .groupBy("crawl_id", "page_id")
                 .agg(F.map_from_entries(F.collect_set(F.struct("url", "local_path"))).alias("named")))
        maps = scratch.keep(maps.join(names, ["crawl_id", "page_id"], "full_outer"))
        sheet_names = None
        if own_names and met is not None:
            # the same per stylesheet, of what it refers to itself
            own = stored.select("crawl_id", F.col("abs_url").alias("via"), F.col("local_path").alias("_own"))
            sheet_names = scratch.keep(
                refer(met.select("crawl_id", "via", F.col("abs_url").alias("url")).distinct()
                      .join(named, ["crawl_id", "url"]), own, ["crawl_id", "via"])
                .groupBy("crawl_id", F.col("via").alias("abs_url"))
                .agg(F.map_from_entries(F.collect_set(F.struct("url", "local_path"))).alias("named")))

    def written() -> DataFrame:
        tok = X.with_tokens(got.join(maps, ["crawl_id", "page_id"], "left"))
        tok = tok.join(named.select("crawl_id", F.col("url").alias("norm_url"), F.col("local_path").alias("_named")),
                       ["crawl_id", "norm_url"], "left")
        place = F.coalesce("_named", U.file_path(F.col("norm_url")))
        html = F.array_join(rewrite_tokens(F.col("tokens"), F.col("norm_url"), F.col("seed_url"), F.col("fetched"),
                                           cfg.follow_domains, F.col("named"), hooks.map_url,
                                           F.col("_up") if cfg.relative else None, own_names), "")
        if cfg.relative:
            tok = tok.withColumn("_up", U.up_to_root(place))
        # a page is written after its references
        page_seq = F.struct(F.col("crawl_rank").cast("long").alias("r"), F.lit(1).alias("phase"), *[
            F.lit(0).cast(refs.schema[c].dataType).alias(c) for c in ORDER[1:]], F.col("norm_url").alias("u"))
        out = tok.select("crawl_id", place.alias("local_path"), F.lit("page").alias("kind"), F.col("norm_url").alias("source_url"),
                         F.encode(html, "UTF-8").alias("content"), page_seq.alias("write_seq"))
        if responses is not None:
            bodies = with_body(stored, responses, cfg.max_asset_size)
            is_sheet = F.col("is_stylesheet")
            if cfg.css_depth > 1:  # sheets that sheets import are read, and so rewritten, too
                bodies = bodies.join(sheets_read, ["crawl_id", "abs_url"], "left")
                is_sheet = is_sheet | F.col("read").isNotNull()
            if sheet_names is not None:
                bodies = bodies.join(sheet_names, ["crawl_id", "abs_url"], "left")
            css = C.rewrite_css(C.decode_css(F.col("body")), F.col("abs_url"),
                                F.coalesce("named", F.create_map().cast("map<string,string>")) if sheet_names is not None else None,
                                U.up_to_root(F.col("local_path")) if cfg.relative else None)
            seq = F.struct(F.col("crawl_rank").cast("long").alias("r"), F.lit(0).alias("phase"), *ORDER[1:],
                           F.col("abs_url").alias("u"))
            out = out.unionByName(bodies.select(
                "crawl_id", "local_path", F.lit("asset").alias("kind"), F.col("abs_url").alias("source_url"),
                F.when(is_sheet, F.encode(css, "UTF-8")).otherwise(F.col("body")).alias("content"), seq.alias("write_seq")))
        return out

    return Clone(written, after)


def _next_snapshot(old: DataFrame | None, latest: DataFrame, plan: DataFrame, met: DataFrame,
                   stored: DataFrame) -> DataFrame:
    """The snapshot after the run.  Answers to URLs that no page or stored
    sheet refers to are none of this run; an accepted file beyond the budget
    is not stored, so what was known of it stays."""
    asked = plan.select(F.col("abs_url").alias("url")).union(met.select("abs_url")).distinct()
    kept = stored.select(F.col("abs_url").alias("url"), F.lit(True).alias("_stored")).distinct()
    mine = latest.join(asked, "url", "left_semi").join(kept, "url", "left")
    lost = (F.col("outcome") == "accept") & F.col("_stored").isNull()
    return merge_snapshot(old, mine.withColumn("outcome", F.when(lost, "over_budget").otherwise(F.col("outcome"))))


def _references(got: DataFrame, cfg: CrawlConfig, hooks: Hooks) -> DataFrame:
    """Every reference of the chosen pages: files (assets and what ``<style>``
    blocks refer to) and links.  ``ref_url``: the URL as the page gives it;
    ``abs_url``: after the F2 hook."""
    tok = X.with_tokens(got)
    keep = ["crawl_id", "crawl_rank"]
    assets = X.extract_assets(tok, base_col="norm_url", keep=keep).withColumn("kind", F.lit("file"))
    styles = X.extract_style_blocks(tok, keep=[*keep, "norm_url"])
    css = X.extract_css_refs(styles, base_col="norm_url", keep=[*keep, "page_id", "pos"])
    css = css.select(*keep, "page_id", F.lit("file").alias("kind"), F.lit(99).alias("tag_rank"), F.col("pos").alias("tag_pos"),
                     _place(F.col("kind"), F.col("ref_pos")).alias("attr_rank"),
                     F.lit(-1).alias("srcset_idx"), "abs_url", F.lit(None).cast("string").alias("content_type"),
                     F.lit(False).alias("is_stylesheet"))
    links = X.extract_links(tok, base_col="norm_url", seed_col="seed_url", follow_domains=cfg.follow_domains, keep=keep)
    links = links.select(*keep, "page_id", F.lit("link").alias("kind"), F.lit(100).alias("tag_rank"),
                         F.col("pos").cast("int").alias("tag_pos"), F.lit(0).alias("attr_rank"), F.lit(-1).alias("srcset_idx"),
                         "abs_url", F.lit(None).cast("string").alias("content_type"), F.lit(False).alias("is_stylesheet"))
    rows = assets.select(*css.columns).unionByName(css).unionByName(links)
    mapped = hooks.map_url(F.col("abs_url")) if hooks.map_url else F.col("abs_url")
    return rows.withColumn("ref_url", F.col("abs_url")).withColumn("abs_url", mapped).withColumn(
        "sheet_ref", F.lit(-1).cast("long")).where(~F.col("abs_url").startswith("data:"))


def _place(kind: Column, ref_pos: Column) -> Column:
    """Place of a stylesheet's reference: ``url()`` first, then imports."""
    return F.when(kind == "url", ref_pos.cast("long")).otherwise(ref_pos.cast("long") + AFTER)


def _downloads(plan: DataFrame, answers: DataFrame, responses: DataFrame, have: DataFrame | None, cfg: CrawlConfig,
               hooks: Hooks, dns: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files that are stored: planned ones with an accepted answer, not
    there yet, and within the byte budget; what a stored stylesheet refers to
    comes right after it, under the same rules, and is not read further than
    ``cfg.css_depth``.  Beside them what the sheets refer to (``via``: the
    sheet), answered or not, and the sheets that were read."""
    def fresh(df):
        return df if have is None else df.join(have, "abs_url", "left_anti")
    direct = scratch.table(fresh(plan.join(answers, "abs_url")))
    tops = direct.where("is_stylesheet")
    read = tops.select("crawl_id", "abs_url")
    if cfg.css_depth > 1:
        # every accepted sheet's references once; the sheets that each crawl reads; what they refer to
        bodies = with_body(answers, responses, cfg.max_asset_size)
        bodies = bodies.where(F.coalesce(F.col("answered_type"), F.lit("")).startswith("text/css")).unionByName(
            with_body(tops.select("abs_url", "_rk", "size", "answered_type").distinct(), responses, cfg.max_asset_size))
        edges = scratch.table(sheet_edges(bodies.dropDuplicates(["abs_url"]).select(
            F.col("abs_url").alias("url"), C.decode_css(F.col("body")).alias("css"))))
        closed = scratch.table(sheet_closure(tops.select("crawl_id", F.col("abs_url").alias("url"), F.struct(*ORDER).alias("seq")),
                                             edges, cfg.css_depth))
        read = closed.select("crawl_id", F.col("url").alias("abs_url"))
        inner = closed.join(edges, F.col("url") == F.col("sheet")).join(
            tops.select(F.col("crawl_id"), F.col("abs_url").alias("root"), *ORDER[:-1]), ["crawl_id", "root"])
        # 2^31 places a sheet: sheets of a level follow by their rank, levels by the highest bits
        place = F.when(F.col("level") == 0, _place(F.col("kind"), F.col("ref_pos"))).otherwise(
            F.lit(2 * AFTER) * (F.col("level").cast("long") * (1 << 20) + F.col("rank")) + _place(F.col("kind"), F.col("ref_pos")))
        inner = inner.select("crawl_id", F.col("root").alias("sheet"), F.col("sheet").alias("via"), *ORDER[:-1],
                             place.alias("sheet_ref"), F.col("target").alias("abs_url"))
    else:
        sheets = with_body(tops, responses, cfg.max_asset_size)
        sheets = sheets.select("crawl_id", *ORDER, F.col("abs_url").alias("sheet"), C.decode_css(F.col("body")).alias("css"))
        inner = X.extract_css_refs(sheets, base_col="sheet", keep=["crawl_id", *ORDER[:-1], "sheet"])
        inner = inner.select("crawl_id", "sheet", F.col("sheet").alias("via"), *ORDER[:-1],
                             _place(F.col("kind"), F.col("ref_pos")).alias("sheet_ref"), "abs_url")
    if hooks.map_url:
        inner = inner.withColumn("abs_url", hooks.map_url(F.col("abs_url")))
    inner = block_private(inner.where(U.valid_scheme("abs_url")), "abs_url", dns)
    if cfg.block_private:
        inner = inner.where(~F.col("is_private"))
    met = scratch.table(inner.drop("host", "ip", "is_private").withColumn("content_type", F.lit(None).cast("string")).withColumn(
        "is_stylesheet", F.lit(False)))
    inner = fresh(met.drop("via").join(answers, "abs_url"))
    every = scratch.table(direct.withColumn("sheet", F.lit(None).cast("string")).unionByName(inner.select(*direct.columns, "sheet")))
    # of a URL that a sheet refers to at several places, in several roles, one row a place
    every = scratch.table(every.dropDuplicates(["crawl_id", "abs_url", *ORDER]))
    chosen = offered_budget(every, "crawl_id", "abs_url", [*ORDER, "abs_url"], "sheet", "size", cfg.max_asset_size,
                            cfg.max_total_bytes)
    stored = null_safe(every.drop("sheet"), chosen, ["crawl_id", "abs_url", *ORDER], "left_semi")
    return stored.drop("answered_type"), met, scratch.keep(read.distinct().withColumn("read", F.lit(True)))


def progress_log(crawled: DataFrame, max_pages: int) -> DataFrame:
    """One progress event per saved page: (crawl_id, pages_cloned,
    max_pages, current_url)."""
    return crawled.select("crawl_id", F.col("crawl_rank").alias("pages_cloned"),
                          F.lit(max_pages).alias("max_pages"), F.col("norm_url").alias("current_url"))
