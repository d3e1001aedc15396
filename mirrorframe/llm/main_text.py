"""Main text of web pages by equivalence-class template deduction.

The pages of a host are taken as filled-in copies of templates.  Each page is read into tokens: its elements, told apart by
their path, and its text blocks, told apart by path and words.  A text block stands in a slot: the article it is part of, or
else its nearest container.  Text and slot form an equivalence class where, on nearly all different pages of the host that hold
the slot (or on those of them that share one layout, the elements directly below the body), the text occurs equally often:
as often as its own element or the slot, or a fixed number of times.  Support is counted among the pages that hold the slot,
so that empty pages, error pages and pages of another layout say nothing about it.  A class is valid from enough different
pages on, twice as many inside what a page names its article; its text belongs to a template, and all other text fills
slots.  Slots inside parts that frame a page (menus, page
headers, footers, sidebars, notices, adverts, forms, comments) go; of the rest the article's slots make the main text, and where a
page names none, the container that holds most of the host's slot text does.

Pages that name no article have their slots judged by class: the containers of a host with one path and one shape (text in
paragraphs, in list items or bare) are a class, and the one with most text outside links is the main one.  A class from enough
different pages on frames the page if most of its text is links (menus), or if it stands on nearly as many pages as the main one
with one or two short blocks (adverts, notices, imprints).  Text of such a container goes unless it lies inside one of the main class.
"""
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from mirrorframe.llm.common import Scratch

#: Different pages on which text must occur equally often before it counts as template (twice as many inside an article).
MIN_PAGES = 5
#: Least share of these pages in the different pages that hold the text's slot.
MIN_SHARE = 0.9
#: A class of short containers has at most this many blocks a container, and less than this share of the main class's characters.
SHORT_BLOCKS, SHORT_SHARE = 2, 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![^\s\"'])(hidden)(?![^\s/])", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
_LIST, _PROSE, _BARE = 1, 2, 4  # where a container's text stands
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figcaption figure".split())
_CLOSES = {  # an opening tag ends an open one of these, up to the nearest of the others
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"body", "caption", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}

#: Elements, roles and class or id words of the parts that frame a page.
_FRAME_TAGS = frozenset(
    "head nav footer aside form button select datalist script style noscript template iframe object embed svg canvas dialog "
    "menu search audio video map math title textarea input label fieldset noembed noframes".split())
_FRAME_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar "
                         "toolbar status tooltip".split())
_FRAME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads advert adverts advertisement "
    "advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond discussion search pagination pager toolbar toast paywall "
    "masthead topbar skip copyright".split())
_COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
_TAKES_BACK = frozenset("has with no without".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, hidden in _ATTR.findall(text):
        out.setdefault((name or hidden).lower(), entities.unescape(a or b or c))
    return out


def _frames(tag: str, attrs: dict[str, str], in_article: bool) -> str | None:
    """Why an element is no part of the main text."""
    if tag in _FRAME_TAGS:
        return "tag"
    if tag in ("html", "body", "main", "article"):
        words = set(_WORD.findall(attrs.get("class", "")))
        return "comments" if tag == "article" and {w.lower() for w in words} & _COMMENT_WORDS else None
    if tag == "header" and not in_article:
        return "tag"
    if attrs.get("role", "").lower() in _FRAME_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" \
            or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return "role"
    for name in attrs.get("class", "").split() + attrs.get("id", "").split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & _TAKES_BACK:
            continue
        if words & _COMMENT_WORDS:
            return "comments"
        if words & _FRAME_WORDS or ("header" in words and not in_article):
            return "words"
    return None


class Page:
    """A page's tokens: ``elements`` (path -> count), ``slots`` (paths of its containers), ``layout`` (a hash of the elements
    directly below the body) and ``blocks`` of text outside the framing parts, in page order, each (words, path, containers
    from the outside in, path of the outermost article or 0, number of the container).  ``parts`` are the containers, 0 the page:
    [path, container around it, where text stands, characters, characters in links, blocks]."""

    def __init__(self, html: str):
        self.elements: Counter = Counter()
        self.blocks: list[tuple[str, int, tuple[int, ...], int, int]] = []
        self.parts: list[list[int]] = [[0, 0, 0, 0, 0, 0]]
        self.slots: set[int] = set()
        self.top: set[int] = set()
        self.article = False
        # open elements: (tag, path, why it is no main text, path of the outermost article around it, containers, number of the
        # nearest one, inside a link)
        self.stack: list[tuple[str, int, str | None, int, tuple[int, ...], int, bool]] = [("", 0, None, 0, (), 0, False)]
        self.run: list[str] = []
        self.linked = 0
        at = 0
        while True:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            if not m["tag"]:
                continue
            tag = m["tag"].lower()
            if m["end"]:
                self._close(tag)
                continue
            self._open(tag, m["attrs"])
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        self._flush()
        self.layout = _signed(xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "big") for x in sorted(self.top))))
        if self.elements or self.blocks:
            self.slots.add(0)

    def _text(self, text: str) -> None:
        if self.stack[-1][2] is None:
            self.run.append(entities.unescape(text))
            if self.stack[-1][6]:
                self.linked += len(" ".join(self.run[-1].split()))

    def _flush(self) -> None:
        if self.run:
            words = " ".join("".join(self.run).split())
            linked, self.run, self.linked = self.linked, [], 0
            if words:
                _, path, _, article, containers, number, _ = self.stack[-1]
                self.blocks.append((words, path, containers, article, number))
                part = self.parts[number]
                part[2] |= self._stands()
                part[3:] = part[3] + len(words), part[4] + linked, part[5] + 1

    def _stands(self) -> int:
        """Whether the block that ends here is a list item, a paragraph or the like, or bare text of its container."""
        for tag, *_ in reversed(self.stack):
            if tag in ("li", "dt", "dd", "ul", "ol", "dl"):
                return _LIST
            if tag in _LEAF:
                return _PROSE
            if tag in _BLOCK:
                break
        return _BARE

    def classes(self) -> list[int]:
        """The class of each container: a hash of its path and of where its text stands."""
        return [_signed(xxhash.xxh3_64_intdigest(bytes((part[2],)), part[0])) for part in self.parts]

    def _pop_to(self, i: int) -> None:
        if any(x[0] in _BLOCK for x in self.stack[i:]):
            self._flush()
        del self.stack[i:]

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return
        if tag in _BLOCK:
            self._flush()

    def _open(self, tag: str, attr_text: str) -> None:
        if tag in _ENDS_P:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == "p":
                    self._pop_to(i)
                    break
                if self.stack[i][0] in _BLOCK:
                    break
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in ends:
                    self._pop_to(i)
                    break
                if self.stack[i][0] in stops:
                    break
        attrs = _attributes(attr_text) if attr_text.strip() else {}
        if tag in _BLOCK:
            self._flush()
        elif tag in ("br", "wbr", "img") and self.stack[-1][2] is None and tag == "br":
            self.run.append(" ")
        if tag == "body":  # whatever the head left open
            self._pop_to(1)
        body = tag == "main" or tag == "article"
        why = _frames(tag, attrs, self.stack[-1][3])
        if body and why is None and not self.article:
            for i in range(1, len(self.stack)):  # the article does not stand in a menu or an advert: their end is missing
                if self.stack[i][2] is not None:
                    if self.stack[i][2] != "comments":
                        self._pop_to(i)
                    break
        _, parent, outer, article, containers, number, link = self.stack[-1]
        name = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}" if attrs else tag
        path = xxhash.xxh3_64_intdigest(_DIGITS.sub("0", name).encode("utf-8", "surrogatepass"), parent)
        self.elements[path] += 1
        if self.stack[-1][0] in ("", "html", "body") and tag not in ("html", "head", "body"):
            self.top.add(path)
        if tag in _VOID:
            return
        if body and outer is None and why is None:
            self.article, article = True, article or path
        if tag in _BLOCK and tag not in _LEAF:
            containers = (*containers, path)
            if (outer or why) is None:
                self.slots.add(path)
                self.parts.append([path, number, 0, 0, 0, 0])
                number = len(self.parts) - 1
        self.stack.append((tag, path, outer or why, article, containers, number, link or tag == "a"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_token(words: str, path: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(words.encode("utf-8", "surrogatepass"), path))


def _in_layout(token: int, layout: int) -> int:
    return _signed((token * 0x9E3779B97F4A7C15 ^ layout) & ((1 << 64) - 1))


def _tokens(pages: DataFrame) -> DataFrame:
    """Rows (host, page, layout, kind, slot, token, within, n, even, chars, links, blocks): per page and token.  Kinds: slot, text
    (inside: text inside an article), container, part (a class of containers, of pages that name no article).  within is the token
    told apart by layout; even: it occurs as often as its own element or its slot."""
    kinds = pa.schema([("host", pa.string()), ("page", pa.int64()), ("layout", pa.int64()), ("kind", pa.string()),
                       ("slot", pa.int64()), ("token", pa.int64()), ("within", pa.int64()), ("n", pa.int64()),
                       ("even", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("blocks", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = html.as_py()
                page, seen = Page(text), _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
                key = (host, seen, page.layout)
                out += [(*key, "slot", _signed(k), 0, 0, 1, 0, 0, 0, 0) for k in page.slots]
                inside = {b[3] for b in page.blocks if b[3]}
                texts = Counter((b[1], b[3] or (b[2][-1] if b[2] else 0), _word_token(b[0], b[1])) for b in page.blocks)
                out += [(*key, "inside" if slot in inside else "text", _signed(slot), k, _in_layout(k, page.layout), n,
                         int(n in (page.elements[path], page.elements[slot])), 0, 0, 0) for (path, slot, k), n in texts.items()]
                size: Counter = Counter()
                for words, _, containers, _, _ in page.blocks:
                    if containers:
                        size[containers[-1]] += len(words)
                out += [(*key, "container", 0, _signed(k), 0, 1, 0, n, 0, 0) for k, n in size.items()]
                parts: dict[int, list[int]] = {}
                for k, part in zip(page.classes(), () if page.article else page.parts):
                    if part[5]:
                        parts[k] = [a + b for a, b in zip(parts.get(k, (0, 0, 0, 0)), (1, *part[3:]))]
                out += [(*key, "part", 0, k, 0, n, 0, chars, links, blocks) for k, (n, chars, links, blocks) in parts.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return pages.mapInArrow(emit, "host string, page long, layout long, kind string, slot long, token long, within long, "
                                  "n long, even long, chars long, links long, blocks long")


def deduce(pages: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per host: ``template_text`` (tokens of text that belongs to a template of all pages, or, told apart by layout, of
    one layout; the latter inverted too, for pages of a layout too rare to tell; the other layouts, inverted; classes of containers
    that frame a page, and the main class, inverted) and ``body`` (the container with most text outside the framing parts).  pages: host, html (not null)."""
    # a page that is there several times counts once
    seen = scratch.table(_tokens(pages).dropDuplicates(["host", "page", "kind", "slot", "token"]).groupBy(
        "host", "layout", "kind", "slot", "token", "within", "n").agg(
        F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("even", "chars", "links", "blocks")]), "tokens")

    def shared(*among: str) -> DataFrame:
        """Texts that occur equally often on nearly all pages among those that hold their slot."""
        slots = seen.filter("kind = 'slot'").groupBy(*among, "slot").agg(F.sum("pages").alias("of")).filter(
            F.col("of") >= min_pages)
        texts = seen.filter("kind IN ('text', 'inside')").groupBy(*among, "kind", "slot", "token", "n").agg(
            F.sum("pages").alias("pages"), F.sum("even").alias("even"), F.max("within").alias("within")).groupBy(
            *among, "kind", "slot", "token").agg(
            F.greatest(F.max("pages"), F.sum("even")).alias("pages"), F.max("within").alias("within")).filter(
            F.col("pages") >= F.when(F.col("kind") == "inside", 2 * min_pages).otherwise(min_pages))
        return texts.join(slots, [*among, "slot"]).filter(F.col("pages") >= min_share * F.col("of"))

    layouts = seen.filter("kind = 'slot' AND slot = 0").groupBy("host", "layout").agg(F.sum("pages").alias("of")).filter(
        F.col("of") >= min_pages)
    found = shared("host").select("host", F.array("token").alias("t")).unionByName(
        shared("host", "layout").select("host", F.array("within", F.bitwise_not("token")).alias("t"))).unionByName(
        layouts.select("host", F.array(F.bitwise_not("layout")).alias("t")))
    parts = seen.filter("kind = 'part'").groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum(F.col("n") * F.col("pages")).alias("parts"),
        *[F.sum(c).alias(c) for c in ("chars", "links", "blocks")])
    main = parts.groupBy("host").agg(F.max_by(F.struct("token", "pages", "parts", "chars"),
                                              F.struct(F.col("chars") - F.col("links"), "token")).alias("main"))
    short = (F.col("pages") >= min_share * F.col("main.pages")) & (F.col("blocks") <= SHORT_BLOCKS * F.col("parts")) & (
        F.col("chars") / F.col("parts") < SHORT_SHARE * F.col("main.chars") / F.col("main.parts"))
    frames = parts.filter(F.col("pages") >= min_pages).join(main, "host").filter(
        (F.col("token") != F.col("main.token")) & ((2 * F.col("links") > F.col("chars")) | short))
    found = found.unionByName(frames.select("host", F.array("token", F.bitwise_not("main.token")).alias("t")))
    template = scratch.table(found.select("host", F.explode("t").alias("token")), "classes").groupBy("host").agg(
        F.collect_set("token").alias("template_text"))
    body = seen.filter("kind = 'container'").groupBy("host", "token").agg(F.sum("chars").alias("chars")).groupBy("host").agg(
        F.max_by("token", F.struct("chars", "token")).alias("body"))
    return scratch.keep(body.join(template, "host", "full"), "templates")


def extract(html: str, template: set[int], body: int | None) -> str:
    """The main text of a page under its host's templates."""
    page = Page(html)
    blocks = page.blocks
    if template:
        rare = ~page.layout not in template
        tokens = [_word_token(b[0], b[1]) for b in blocks]
        blocks = [b for b, k in zip(blocks, tokens) if not (
            k in template or _in_layout(k, page.layout) in template or rare and ~k in template)]
    if page.article:
        return "\n".join(b[0] for b in blocks if b[3])
    if template:
        classes, frames = page.classes(), []
        for k, (_, around, *_) in zip(classes, page.parts):  # containers come after the one around them
            main = ~k in template or bool(frames) and frames[around] is None
            frames.append(None if main else k in template)
        blocks = [b for b in blocks if not frames[b[4]]] or blocks
    inside = [b[0] for b in blocks if any(_signed(c) == body for c in b[2])]
    return "\n".join(inside or [b[0] for b in blocks])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: the id, the url and ``text``, blocks of the main text joined by line feeds (empty if none).

    Null html is empty.  Pages without a host in their url (or without a url) are taken as pages of one nameless host.
    Repeated rows each return, and count once as different pages of a host; null and empty pages do not count.
    Other columns are not read.
    """

    @arrow_udf("string")
    def text_of(html: pa.Array, template: pa.Array, body: pa.Array) -> pa.Array:
        last, known = None, set()
        out = []
        for h, t, b in zip(html, template, body.to_pylist()):
            tokens = t.as_py() or ()
            if tokens != last:
                last, known = tokens, set(tokens)
            out.append(extract(h.as_py(), known, b))
        return pa.array(out, pa.string())

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    with Scratch(pages.sparkSession, "maintext") as scratch:
        templates = deduce(rows.select("host", "html"), scratch, min_pages)
    return rows.join(templates, "host", "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), text_of("html", "template_text", "body").alias("text"))
