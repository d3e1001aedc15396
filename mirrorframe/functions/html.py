"""HTML as a lossless token array, read and rewritten with built-in array and
regex functions (no parser library, no Python UDF).

A page is tokenised once into ``array<string>``: comments, whole raw-text
elements (``<script>``, ``<style>``, ``<title>``, ``<textarea>``), start/end
tags, doctype and text runs.
Joining the tokens gives back the input byte for byte, so untouched parts of
a page are never re-serialised.
"""

from __future__ import annotations

import html as _html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ASSET_ATTRS
from .urls import _c, let

RAW_TEXT = "script|style|title|textarea"
# Possessive quantifiers keep the Java regex engine from deep backtracking on
# long attribute values / text runs.  In a tag a quote opens a value only right
# after '=', so an apostrophe inside an unquoted value is an ordinary character.
_IN_TAG = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TOKEN_PATTERN = (
    r"(?is)<!--.*?-->"
    rf"|<({RAW_TEXT})(?=[\s/>]){_IN_TAG}>.*?(?:</\1\s*+>|\z)"
    rf"|</?[a-z]{_IN_TAG}>"
    r"|<![^>]*+>"
    r"|[^<]++"
    r"|<"
)
_TAG_NAME = r"^<([A-Za-z][^\s/>]*)"
_TAG_BODY = r"(?s)^<[A-Za-z][^\s/>]*(.*?)/?>$"
_ATTR = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""


def tokenize_html(html) -> Column:
    """Page -> array of lossless tokens (``array_join(tokens, '') == html``)."""
    h = _c(html)
    return F.when(h.isNull(), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(h, F.lit(TOKEN_PATTERN), 0))


def tag_name(tok) -> Column:
    """Lower-cased element name of a start tag token, '' otherwise."""
    return F.lower(F.regexp_extract(_c(tok), _TAG_NAME, 1))


def is_start_tag(tok, names: list[str] | None = None) -> Column:
    t = _c(tok)
    if names is None:
        return t.rlike(r"^<[A-Za-z]")
    alt = "|".join(names)
    return t.rlike(rf"(?i)^<(?:{alt})(?:[\s/>])")


# A text as character references and what lies between them.  In an attribute a
# name without ';' counts only if neither a letter, a digit nor '=' follows.
_REFS = r"&#[0-9]++;?|&#[xX][0-9A-Fa-f]++;?|&[A-Za-z][A-Za-z0-9]*+;|&[A-Za-z][A-Za-z0-9]*+(?!=)|[^&]++|&"


def _named_refs() -> Column:
    """name -> characters of every named reference, as one literal map."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _numbered_refs() -> Column:
    """What the numbers that name no character themselves stand for."""
    odd = {n: _html.unescape(f"&#{n};") for n in [0, 13, *range(0x80, 0xA0)]}
    return F.from_json(F.lit(json.dumps(odd)), "map<string,string>")


def _char(number: Column) -> Column:
    """Code point -> character; no character -> U+FFFD."""
    ok = (number < 0xD800) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.coalesce(F.try_element_at(_numbered_refs(), number.cast("string")),
                      F.when(ok, F.decode(utf32, "UTF-32")).otherwise(F.lit("\ufffd")))


def unescape(v) -> Column:
    """Character references decoded: numeric, and all named ones."""
    def one(t):
        digits = F.regexp_extract(t, r"^&#(?:[xX]0*([0-9A-Fa-f]{1,8})|0*([0-9]{1,10}));?$", 0)
        value = F.when(digits.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10)
                       ).otherwise(F.regexp_extract(t, "^&#([0-9]+)", 1)).try_cast("long")
        return (F.when(t.startswith("&#") & (F.length(t) > 2), _char(F.coalesce(value, F.lit(0x110000).cast("long"))))
                .when(t.startswith("&"), F.coalesce(F.try_element_at(_named_refs(), F.substring(t, 2, 64)), t))
                .otherwise(t))
    return let(_c(v), lambda x: F.when(
        x.contains("&"), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_REFS), 0), one), "")).otherwise(x))


def _unquote(raw: Column) -> Column:
    return F.regexp_replace(raw, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")


def start_tag(tok) -> Column:
    """The start tag of a token; for a whole raw-text element only its opening
    tag (the body is never read as attributes)."""
    t = _c(tok)
    return F.when(t.rlike(rf"(?i)^<(?:{RAW_TEXT})(?=[\s/>])"),
                  F.regexp_extract(t, rf"(?is)^<(?:{RAW_TEXT})(?=[\s/>]){_IN_TAG}>", 0)).otherwise(t)


def attributes(tok) -> Column:
    """array<struct<name, raw, value>> of a start tag, in source order.
    ``raw`` keeps the quotes as written; ``value`` is unquoted and unescaped."""
    def pairs(nr):
        return F.transform(nr["names"], lambda n, i: let(F.try_element_at(nr["raws"], i + 1), lambda raw: F.struct(
            n.alias("name"), raw.alias("raw"), unescape(_unquote(raw)).alias("value"))))

    def build(body):
        return let(F.struct(F.regexp_extract_all(body, F.lit(_ATTR), 1).alias("names"),
                            F.regexp_extract_all(body, F.lit(_ATTR), 2).alias("raws")), pairs)
    return let(F.regexp_extract(start_tag(tok), _TAG_BODY, 1), build)


def attr_of(attrs: Column, name: str) -> Column:
    """Value of the first attribute called ``name`` (case-insensitive), else NULL."""
    hit = F.filter(attrs, lambda a: F.lower(a["name"]) == name)
    return F.when(F.size(hit) > 0, F.try_element_at(hit, F.lit(1))["value"])


def attr_value(tok, name: str) -> Column:
    return attr_of(attributes(tok), name)


def rebuild_tag(tok, attrs: Column) -> Column:
    """Serialise a start tag from its attribute list (used only for tags that
    changed), keeping the original element name and a closing '/>'."""
    t = _c(tok)
    name = F.regexp_extract(t, _TAG_NAME, 1)
    close = F.when(t.endswith("/>"), F.lit("/>")).otherwise(F.lit(">"))
    parts = F.transform(attrs, lambda a: F.concat(
        F.lit(" "), a["name"], F.when(a["raw"] != "", F.concat(F.lit("="), a["raw"])).otherwise(F.lit(""))))
    return F.concat(F.lit("<"), name, F.array_join(parts, ""), close)


def quote_attr(value) -> Column:
    v = F.replace(F.replace(_c(value), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('"'), v, F.lit('"'))


def set_attr(attrs: Column, name: str, value: Column) -> Column:
    """Replace the first attribute ``name`` with ``value`` (quoted)."""
    first = F.array_position(F.transform(attrs, lambda a: F.lower(a["name"])), F.lit(name))
    return F.transform(attrs, lambda a, i: F.when(
        (i + 1) == first, F.struct(a["name"].alias("name"), quote_attr(value).alias("raw"),
                                   value.alias("value"))).otherwise(a))


def drop_attrs(attrs: Column, names: list[str]) -> Column:
    return F.filter(attrs, lambda a: ~F.lower(a["name"]).isin(names))


def element_text(tok, name: str) -> Column:
    """Body of a raw-text element token (``<style>…</style>``)."""
    return F.regexp_extract(_c(tok), rf"(?is)^<{name}(?=[\s/>]){_IN_TAG}>(.*?)(?:</{name}\s*+>)?$", 1)


def asset_attr_map() -> Column:
    """tag -> array of asset attributes, as a literal map."""
    kv = []
    for tag, attrs in ASSET_ATTRS:
        kv += [F.lit(tag), F.array(*[F.lit(a) for a in attrs])]
    return F.create_map(*kv)


def asset_tag_rank_map() -> Column:
    kv = []
    for i, (tag, _) in enumerate(ASSET_ATTRS):
        kv += [F.lit(tag), F.lit(i)]
    return F.create_map(*kv)


def split_ws(s) -> Column:
    """Python ``str.split()``: whitespace runs, no empty items."""
    return F.filter(F.split(_c(s), r"\s+"), lambda x: x != "")


def srcset_entries(value) -> Column:
    """srcset -> array<struct<idx, tokens, url>>; url NULL for empty or
    ``data:`` entries (they are kept as written)."""
    parts = F.split(_c(value), ",", -1)
    return F.transform(parts, lambda p, i: let(split_ws(p), lambda t: F.struct(
        i.alias("idx"), t.alias("tokens"),
        F.when((F.size(t) > 0) & ~F.try_element_at(t, F.lit(1)).startswith("data:"), F.try_element_at(t, F.lit(1)))
        .alias("url"))))
