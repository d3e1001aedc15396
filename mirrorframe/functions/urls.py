"""URL, path and scheme functions as native Spark Column expressions.

All of these compose built-in functions (regexp, arrays, higher-order
functions, md5), so they stay inside the JVM and Catalyst can push filters
that use them.  Semantics follow Python's ``urllib.parse`` (urlparse, urljoin,
urlunparse, unquote_plus) and ``posixpath`` (splitext, normpath), which is
what the page-to-file mapping is defined against.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONTENT_TYPE_EXT, KNOWN_EXTS, PAGE_EXTS

# Scheme lists of the standard library's urllib.parse (fixed values).
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
               "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
               "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
                 "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
               "rtspu", "sip", "sips", "mms", "sftp", "tel"]

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REST_RE = r"(?s)^(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PARAMS_RE = r"(?s)^((?:.*/)?[^;/]*)(?:;([^/]*))?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clean(url: Column) -> Column:
    # urlsplit: lstrip C0 controls and space, drop tab/CR/LF everywhere
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a one-element
    ``transform``), so nested URL functions do not re-expand their inputs."""
    return F.transform(F.array(value), body)[0]


def url_parts(url, default_scheme: Column | str | None = None) -> Column:
    """urlparse as a struct<scheme, netloc, path, params, query, fragment>.

    Missing components are empty strings (as in the standard library).
    ``default_scheme`` is used when the URL has none (urljoin needs it)."""
    if default_scheme is None:
        dflt = F.lit("")
    else:
        dflt = F.lit(default_scheme) if isinstance(default_scheme, str) else default_scheme

    def split(u):
        has_scheme = u.rlike(_SCHEME_RE)
        scheme = F.when(has_scheme, F.lower(F.regexp_extract(u, _SCHEME_RE, 1))).otherwise(dflt)
        rest = F.when(has_scheme, F.regexp_replace(u, _SCHEME_RE, "")).otherwise(u)
        return let(F.struct(scheme.alias("scheme"), rest.alias("rest")), lambda s: let(
            F.struct(s["scheme"].alias("scheme"),
                     F.regexp_extract(s["rest"], _REST_RE, 1).alias("netloc"),
                     F.regexp_extract(s["rest"], _REST_RE, 2).alias("path0"),
                     F.regexp_extract(s["rest"], _REST_RE, 3).alias("query"),
                     F.regexp_extract(s["rest"], _REST_RE, 4).alias("fragment")),
            finish))

    def finish(t):
        split_params = t["scheme"].isin(USES_PARAMS) & t["path0"].contains(";")
        path = F.when(split_params, F.regexp_extract(t["path0"], _PARAMS_RE, 1)).otherwise(t["path0"])
        params = F.when(split_params, F.regexp_extract(t["path0"], _PARAMS_RE, 2)).otherwise(F.lit(""))
        return F.struct(t["scheme"].alias("scheme"), t["netloc"].alias("netloc"), path.alias("path"),
                        params.alias("params"), t["query"].alias("query"),
                        t["fragment"].alias("fragment"))

    return let(_clean(_c(url)), split)


def url_unparse(scheme: Column, netloc: Column, path: Column, params: Column,
                query: Column, fragment: Column) -> Column:
    """urlunparse: re-attach params, then urlunsplit."""
    def build(a):
        p = a["p"]
        with_netloc = F.concat(
            F.lit("//"), a["netloc"],
            F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p))
        u = (F.when(a["netloc"] != "", with_netloc)
             .when(p.startswith("//"), F.concat(F.lit("//"), p))
             .when((a["scheme"] != "") & a["scheme"].isin(USES_NETLOC) & ((p == "") | p.startswith("/")),
                   F.concat(F.lit("//"), p))
             .otherwise(p))
        u = F.when(a["scheme"] != "", F.concat(a["scheme"], F.lit(":"), u)).otherwise(u)
        u = F.when(a["query"] != "", F.concat(u, F.lit("?"), a["query"])).otherwise(u)
        return F.when(a["fragment"] != "", F.concat(u, F.lit("#"), a["fragment"])).otherwise(u)

    p = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
    return let(F.struct(scheme.alias("scheme"), netloc.alias("netloc"), p.alias("p"),
                        query.alias("query"), fragment.alias("fragment")), build)


def normalize_parts(p: Column) -> Column:
    """normalize_url of an already parsed URL (struct from ``url_parts``)."""
    path = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return url_unparse(p["scheme"], p["netloc"], path, p["params"], p["query"], F.lit(""))


def normalize_url(url) -> Column:
    """Drop the fragment, strip all trailing '/' from the path (empty -> '/'),
    keep query and ;params."""
    return let(url_parts(url), normalize_parts)


def _remove_dot_segments(segments: Column) -> Column:
    """The urljoin segment walk: '..' pops (ignored when empty), '.' skipped."""
    walked = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    last = F.try_element_at(segments, F.lit(-1))
    return F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)


def resolve_parts(b: Column, base: Column, ref: Column) -> Column:
    """urljoin with the base already parsed (``b`` = ``url_parts(base)``)."""
    def join(r):
        scheme = r["scheme"]
        netloc = F.when(scheme.isin(USES_NETLOC) & (r["netloc"] == ""), b["netloc"]).otherwise(r["netloc"])
        own_authority = url_unparse(scheme, r["netloc"], r["path"], r["params"], r["query"], r["fragment"])
        inherit = url_unparse(scheme, netloc, b["path"], b["params"],
                              F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"])
        base_parts = F.split(b["path"], "/", -1)
        base_dir = F.when(F.try_element_at(base_parts, F.lit(-1)) != "",
                          F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(base_parts)
        rel_segs = F.split(r["path"], "/", -1)

        def clean_merged(merged):
            n = F.size(merged)
            inner = F.filter(F.slice(merged, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
            return F.when(n >= 2, F.concat(F.slice(merged, 1, 1), inner, F.slice(merged, -1, 1))).otherwise(merged)

        segments = F.when(r["path"].startswith("/"), rel_segs).otherwise(
            let(F.concat(base_dir, rel_segs), clean_merged))
        resolved = let(F.array_join(let(segments, _remove_dot_segments), "/"),
                       lambda x: F.when(x == "", F.lit("/")).otherwise(x))
        merged_url = url_unparse(scheme, netloc, resolved, r["params"], r["query"], r["fragment"])
        return (F.when((scheme != b["scheme"]) | ~scheme.isin(USES_RELATIVE), ref)
                .when(scheme.isin(USES_NETLOC) & (r["netloc"] != ""), own_authority)
                .when((r["path"] == "") & (r["params"] == ""), inherit)
                .otherwise(merged_url))

    return (F.when(base.isNull() | ref.isNull(), F.lit(None).cast("string"))
            .when(base == "", ref)
            .when(ref == "", base)
            .otherwise(let(url_parts(ref, default_scheme=b["scheme"]), join)))


def resolve_url(base, ref) -> Column:
    """urljoin(base, ref) as a column expression."""
    base, ref = _c(base), _c(ref)
    return let(url_parts(base), lambda b: resolve_parts(b, base, ref))


def splitext_ext(path) -> Column:
    """posixpath.splitext(path)[1]: extension of the last component, where a
    leading run of dots does not start an extension."""
    last = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.regexp_extract(last, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def authority(url) -> Column:
    """netloc of a URL (port, userinfo and case kept)."""
    return url_parts(url)["netloc"]


def host_of(url) -> Column:
    """Lower-cased host name without userinfo and port (urlparse().hostname)."""
    n = authority(url)
    h = F.regexp_replace(n, r"^.*@", "")
    h = F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(h, r":[^:]*$", ""))
    return F.when(h == "", F.lit(None).cast("string")).otherwise(F.lower(h))


def same_domain(url, seed) -> Column:
    """netloc equality with the seed's netloc (scheme ignored)."""
    return authority(url) == authority(seed)


def is_html_parts(p: Column) -> Column:
    """is_html_link of an already parsed URL."""
    def build(path):
        ext = splitext_ext(path)
        return (path == "") | (path == "/") | ~ext.isin(KNOWN_EXTS) | ext.isin(PAGE_EXTS)
    return let(F.lower(p["path"]), build)


def is_html_link(url) -> Column:
    """True unless the (lower-cased) path ends in a known non-page extension."""
    return is_html_parts(url_parts(url))


def valid_scheme(url) -> Column:
    return url_parts(url)["scheme"].isin("http", "https")


def ensure_scheme(url) -> Column:
    u = F.trim(_c(url))
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(
        F.concat(F.lit("https://"), u))


def unquote_plus(s) -> Column:
    """'+' -> ' ' and %XX decoding; malformed escapes stay literal."""
    return let(_c(s), lambda x: F.coalesce(
        F.try_url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25")), x))


def mime_ext(content_type) -> Column:
    """MIME (before ';', trimmed, lower-cased) -> extension, default '.html'."""
    mime = F.lower(F.trim(F.split(_c(content_type), ";", 2)[0]))
    m = F.create_map(*[x for kv in CONTENT_TYPE_EXT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, mime), F.lit(".html"))


def local_path(url, content_type=None, parts: Column | None = None) -> Column:
    """Relative file path for a URL (host and query not part of the path).
    ``parts`` may pass an already parsed URL (``url_parts``)."""
    if content_type is None:
        ct = F.lit(None).cast("string")
    else:
        ct = F.lit(content_type) if isinstance(content_type, str) else _c(content_type)

    def build(a):
        lp, ext, has_ext = a["lp"], a["ext"], a["ext"] != ""
        known = has_ext & F.lower(ext).isin(KNOWN_EXTS)
        no_hint = (F.when(lp.endswith("/"), F.concat(lp, F.lit("index.html")))
                   .otherwise(F.concat(lp, F.lit(".html"))))
        with_hint = F.when(~has_ext, F.concat(lp, mime_ext(a["ct"]))).otherwise(lp)
        has_hint = a["ct"].isNotNull() & (a["ct"] != "")
        return F.when(known, lp).when(has_hint, with_hint).otherwise(no_hint)

    def from_path(path):
        lp = F.when((path == "") | (path == "/"), F.lit("index.html")).otherwise(
            F.regexp_replace(path, "^/+", ""))
        return let(lp, lambda x: let(F.struct(x.alias("lp"), splitext_ext(x).alias("ext"), ct.alias("ct")), build))

    path = F.split(unquote_plus(parts["path"] if parts is not None else url_parts(url)["path"]), r"\?", 2)[0]
    return let(path, from_path)


def safe_path(local) -> Column:
    """Keep a relative path inside the output root.

    A path that climbs above the root (or is absolute) becomes
    ``md5(path)[:16] + ext``; a component longer than 200 characters becomes
    ``md5(component)[:16] + its ext``.  Backslashes count as separators."""
    def walk_of(swapped):
        return F.aggregate(
            F.split(swapped, "/", -1),
            F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("esc")),
            lambda acc, s: F.when((s == "") | (s == "."), acc)
            .when(s == "..", F.when(F.size(acc["parts"]) > 0,
                                    F.struct(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1).alias("parts"),
                                             acc["esc"].alias("esc")))
                  .otherwise(F.struct(acc["parts"].alias("parts"), F.lit(True).alias("esc"))))
            .otherwise(F.struct(F.concat(acc["parts"], F.array(s)).alias("parts"), acc["esc"].alias("esc"))))

    def build(p):
        swapped = F.regexp_replace(p, r"\\", "/")
        return let(walk_of(swapped), lambda w: finish(p, swapped, w))

    def finish(p, swapped, w):
        escaped = w["esc"] | swapped.startswith("/")
        hashed = F.concat(F.substring(F.md5(p), 1, 16), splitext_ext(p))
        parts = F.transform(w["parts"], lambda s: F.when(
            F.length(s) > 200, F.concat(F.substring(F.md5(s), 1, 16), splitext_ext(s))).otherwise(s))
        rel = F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))
        return F.when(escaped, hashed).otherwise(rel)

    p = _c(local)
    return F.when(p.isNull(), F.lit(None).cast("string")).otherwise(let(p, build))


def file_path(url, content_type=None, parts: Column | None = None) -> Column:
    """local_path followed by safe_path: where a URL is stored in a snapshot."""
    return safe_path(local_path(url, content_type, parts))


def external_path(url, content_type, seed_netloc) -> Column:
    """Where a URL of another authority than the seed's is stored:
    ``_external/<authority>/`` before its own path (characters that file
    systems mind, such as the port's colon, as ``_``); else as ``file_path``."""
    def build(p):
        own = local_path(url, content_type, p)
        place = F.regexp_replace(F.lower(p["netloc"]), r"[^a-z0-9.-]", "_")
        away = (p["netloc"] != "") & (p["netloc"] != _c(seed_netloc))
        return F.when(away, F.concat(F.lit("_external/"), place, F.lit("/"), safe_path(own))).otherwise(safe_path(own))
    return let(url_parts(url), build)


def relative_path(own, target) -> Column:
    """The reference from the file ``own`` to the file ``target`` of the same
    snapshot: up from the folder of ``own`` to the longest common folder,
    then down (posixpath.relpath of two files)."""
    def build(v):
        here, there = v["here"], v["there"]
        n = F.least(F.size(here), F.size(there) - 1)
        same = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                           lambda i: F.get(here, i - 1) == F.get(there, i - 1))
        return let(F.array_position(same, F.lit(False)), lambda miss: let(
            F.when(miss == 0, F.greatest(n, F.lit(0))).otherwise(miss.cast("int") - 1), lambda k: F.concat(
                F.repeat(F.lit("../"), F.size(here) - k),
                F.array_join(F.slice(there, k + 1, F.size(there) - k), "/"))))

    folder = F.regexp_extract(_c(own), r"^(.*)/[^/]*$", 1)
    here = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/", -1))
    return let(F.struct(here.alias("here"), F.split(_c(target), "/", -1).alias("there")), build)


def up_to_root(own) -> Column:
    """The reference from the file ``own`` to the root of its snapshot."""
    return F.repeat(F.lit("../"), F.size(F.split(_c(own), "/", -1)) - 1)


# Month names and zone names (hours from UTC) of HTTP dates (fixed values).
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
_DATES = [  # pattern, and which of its groups are day, month and year
    (r"(?i)(\d{1,2})[ -]+([a-z]{3})[a-z]*[ -]+(\d{4}|\d{2})\s+" + _CLOCK, (1, 2, 3, 4)),
    (r"(?i)^[a-z]{3,9},?\s+([a-z]{3})\s+(\d{1,2})\s+" + _CLOCK + r"\s+(\d{4})", (2, 1, 6, 3)),
]


def http_date(value) -> Column:
    """An HTTP date (RFC 1123, RFC 850 or asctime form, with a named or
    numeric zone; none is UTC) as a timestamp, whatever the session's zone."""
    v = _c(value)
    month = F.create_map(*[x for i, m in enumerate(_MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    zone = F.create_map(*[x for k, h in _ZONES.items() for x in (F.lit(k), F.lit(h * 3600))])

    def form(pattern, groups):
        d, m, y, clock = groups
        get = lambda i: F.regexp_extract(v, pattern, i).try_cast("int")
        year = get(y)
        year = F.when(F.length(F.regexp_extract(v, pattern, y)) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)
        return F.try_make_timestamp(
            year, F.try_element_at(month, F.lower(F.regexp_extract(v, pattern, m))), get(d), get(clock), get(clock + 1),
            F.coalesce(get(clock + 2), F.lit(0)).cast("decimal(8,6)"), F.lit("UTC"))

    sign = F.when(F.regexp_extract(v, r"([+-])\d{4}\s*$", 1) == "-", -1).otherwise(1)
    hhmm = F.regexp_extract(v, r"[+-](\d{4})\s*$", 1)
    offset = F.coalesce(
        F.when(hhmm != "", sign * (F.substring(hhmm, 1, 2).cast("int") * 3600 + F.substring(hhmm, 3, 2).cast("int") * 60)),
        F.try_element_at(zone, F.upper(F.regexp_extract(v, r"([A-Za-z]{3})\s*$", 1))), F.lit(0))
    return F.coalesce(*[form(*x) for x in _DATES]) - F.make_interval(secs=offset)


def retry_after_seconds(value, now) -> Column:
    """Retry-After header -> seconds: a number as is, an HTTP-date as
    max(0, date - now), anything else NULL."""
    v = F.trim(_c(value))
    num = v.try_cast("double")
    delta = F.unix_micros(http_date(v)) / 1e6 - F.unix_micros(_c(now).cast("timestamp")) / 1e6
    return (F.when((v == "") | v.isNull(), F.lit(None).cast("double"))
            .when(num.isNotNull(), num)
            .when(delta.isNotNull(), F.greatest(F.lit(0.0), delta))
            .otherwise(F.lit(None).cast("double")))


def progress_pct(pages_cloned, max_pages, status=None) -> Column:
    """Progress bar value: JS Math.round(100*cloned/max), 0 when max<=0,
    100 for finished jobs."""
    pc, mp = _c(pages_cloned), _c(max_pages)
    pct = F.when(mp > 0, F.floor(pc / mp * 100.0 + 0.5)).otherwise(F.lit(0)).cast("int")
    if status is None:
        return pct
    return F.when(_c(status) == "done", F.lit(100)).otherwise(pct)
