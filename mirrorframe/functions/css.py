"""CSS ``url()`` / ``@import`` references: extraction and rewriting as
column expressions.  Rewriting splits the stylesheet into a lossless array of
(match | gap) pieces and maps only the matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CSS_IMPORT_PATTERN, CSS_URL_PATTERN
from .urls import _c, file_path, let, resolve_url

# Lossless piece patterns: a reference, a run that cannot start one, or the
# single lead character.
_URL_PIECES = r"(?s)" + CSS_URL_PATTERN + r"|[^u]++|u"
_IMPORT_PIECES = r"(?s)" + CSS_IMPORT_PATTERN + r"|[^@]++|@"
_FULL_URL = r"(?s)^" + CSS_URL_PATTERN + r"$"
_FULL_IMPORT = r"(?s)^" + CSS_IMPORT_PATTERN + r"$"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def css_url_refs(css) -> Column:
    """Stripped ``url(...)`` targets in order (``data:`` included)."""
    return F.transform(F.regexp_extract_all(_c(css), F.lit(r"(?s)" + CSS_URL_PATTERN), 1), _strip)


def css_import_refs(css) -> Column:
    return F.transform(F.regexp_extract_all(_c(css), F.lit(r"(?s)" + CSS_IMPORT_PATTERN), 1), _strip)


def rewrite_css(css, base, named=None, up=None) -> Column:
    """Every non-``data:`` ``url()`` becomes ``url("<local path>")``, then every
    ``@import "x"`` becomes ``@import "<local path>"`` (download success does
    not matter).  ``named`` (URL -> reference) goes before the path that a URL
    has by itself, to which ``up`` leads from the file that holds the text."""
    b = _c(base)

    def place(ref):
        url = resolve_url(b, ref)
        path = file_path(url) if up is None else F.concat(up, file_path(url))
        return path if named is None else F.coalesce(F.try_element_at(named, url), path)

    def url_piece(p):
        inner = _strip(F.regexp_extract(p, _FULL_URL, 1))
        return F.when(p.rlike(_FULL_URL) & ~inner.startswith("data:"),
                      F.concat(F.lit('url("'), place(inner), F.lit('")'))).otherwise(p)

    def import_piece(p):
        inner = _strip(F.regexp_extract(p, _FULL_IMPORT, 1))
        return F.when(p.rlike(_FULL_IMPORT),
                      F.concat(F.lit('@import "'), place(inner), F.lit('"'))).otherwise(p)

    def pass2(text):
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_IMPORT_PIECES), 0), import_piece), "")

    c = _c(css)
    pass1 = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_URL_PIECES), 0), url_piece), "")
    return F.when(c.isNull(), c).otherwise(let(pass1, pass2))


def decode_css(body) -> Column:
    """Bytes -> text: UTF-8 when valid, else Latin-1."""
    b = _c(body)
    return F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).otherwise(
        F.decode(b, "ISO-8859-1"))
