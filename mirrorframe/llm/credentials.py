"""Secret scans with multipart credential linking, in DataFrame functions only.

Three base kinds are reported wherever they stand.  Weak candidates (mixed tokens that may be secrets, assigned account
names, endpoints) are common in clean text; they become findings only where complementary parts of a credential co-occur:
the candidates are interval-joined to the identifiers, secrets and endpoints within a scope of ``scope`` code points around
them in the same document, and a candidate stays if its neighbours complete it.  A secret is completed by an identifier, by a
service it opens (host:port, database URL, URL with a login), or by any other web URL if a key word stands near too; but what is
itself a piece of a web URL is completed by an identifier only.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.urls import let
from mirrorframe.llm.common import Scratch

#: Base kinds in the order in which equal starts are listed: (kind, role, pattern, group that is measured, least length).
BASE = [
    ("assign", "secret",
     r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", "secret", r"[0-9a-f]{16,}", 0, 16),
]
_ENDPOINT = (
    r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp|ftp)://[A-Za-z0-9_.:@/%?&=-]{4,}"
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![0-9])"
    # a name of three parts and a port, or of two and a port of four digits or more (file:line is none)
    r"|(?<![A-Za-z0-9.-])(?:localhost|(?=[A-Za-z0-9-]{1,63}\.(?:[A-Za-z0-9-]{1,63}\.[A-Za-z]|[A-Za-z][A-Za-z0-9-]{0,62}:[0-9]{4}))"
    r"[A-Za-z0-9.-]{3,253}+):[0-9]{2,5}(?![0-9])")
_LOGIN, _PORT = r"https?://[^/@?]*@", r"https?://[^/@?]*:[0-9]{2,5}(?![0-9])"
#: Weak kinds, listed after them: (kind, role, pattern, what the match must hold besides).
WEAK = [
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-]|\.[A-Za-z0-9+/_-])",
     [r"[A-Z]", r"[a-z]", r"[0-9]"]),
    ("weak_identifier", "identifier",
     r"""(?i:(?<![a-z0-9])(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""",
     []),
    # three sorts of endpoints, told apart by the text of the match: no match is of two
    ("endpoint", "service", _ENDPOINT, [rf"^(?!https?://)|^{_LOGIN}"]),
    ("endpoint", "port", _ENDPOINT, [rf"^(?!{_LOGIN}){_PORT}"]),
    ("endpoint", "url", _ENDPOINT, [r"^https?://", rf"^(?!{_LOGIN}|{_PORT})"]),
    # completes others, and is never reported itself
    ("key_word", "key_word",
     r"(?i:(?<![a-z0-9])(?:api|(?:api)?keys?|tokens?|bearer|secrets?|passw(?:or)?ds?|pwd|credentials?|o?auth|authorization|webhook)"
     r"(?![a-z0-9]))", []),
]
ROLES = ["identifier", "secret", "service", "port", "url", "key_word"]
SPAN = "array<struct<start:int,end:int,rank:int>>"
_BUCKET = 512


def _running(values: Column, add) -> Column:
    """Running sums (or maxima) of an array, by doubling: as many passes over it as its length has binary digits, so that
    a text with very many matches takes time nearly in proportion to them."""
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
                    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(passes, values, lambda acc, p: let(F.pow(F.lit(2.0), p).cast("int"), lambda k: F.transform(
        acc, lambda x, i: F.when(i >= k, add(x, F.get(acc, i - k))).otherwise(x))))


def matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0, holds=()) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, then those of them that pass.

    The gaps between the matches and the matches themselves, both as the JVM's regex engine cuts them, add up to places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.split(text, pattern, -1), hits] + ([F.regexp_extract_all(text, F.lit(pattern), F.lit(group))] if group else [])
    sized = F.transform(F.arrays_zip(*[p.alias(f"c{i}") for i, p in enumerate(parts)]), lambda x: F.struct(
        F.char_length(x["c0"]).alias("gap"), F.char_length(x["c1"]).alias("hit"),
        F.char_length(x[f"c{2 if group else 1}"]).alias("size"), x["c1"].alias("text")))

    def passes(x):
        ok = x["hit"].isNotNull() & (x["size"] >= least)
        for p in holds:
            ok = ok & x["text"].rlike(p)
        return ok

    def placed(s):
        ends = _running(F.transform(s, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(s, lambda x, i: F.struct(
            (F.get(e, i) - x["hit"]).alias("start"), F.get(e, i).alias("end"), F.lit(rank).alias("rank"),
            passes(x).alias("ok"))))

    kept = F.transform(F.filter(let(sized, placed), lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"], x["rank"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in [*BASE, *WEAK]])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"]))), lambda x: F.concat_ws(
        ":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def findings(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
             scope: int = 200) -> DataFrame:
    """One row per input row: ``doc_id, doc, hash, base, extra`` (spans of the base kinds, and of the weak ones that
    complementary parts complete).  doc and hash identify the document: its id (null as the smallest long) and a hash of the
    text; rows that agree in both are alike in their findings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [matches(F.col("t"), p, i, g, n) for i, (_, _, p, g, n) in enumerate(BASE)]
    weak = [matches(F.col("t"), p, len(BASE) + i, holds=h) for i, (_, _, p, h) in enumerate(WEAK)]
    each = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       F.xxhash64(text).alias("hash"), text.alias("t"))
    each = scratch.keep(each.select("doc_id", "doc", "hash", F.concat(*base).alias("base"), F.concat(*weak).alias("weak")),
                        "parts")
    roles = F.array(*[F.lit(k[1]) for k in [*BASE, *WEAK]])
    # no document without a weak part that may be reported takes part in the join
    parts = each.filter(F.exists("weak", lambda x: x["rank"] != len(BASE) + len(WEAK) - 1)).select("doc", "hash", F.explode(F.concat("base", "weak")).alias("s")).select(
        "doc", "hash", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.rank").alias("rank"),
        F.element_at(roles, F.col("s.rank") + 1).alias("role")).distinct()
    near = parts.filter((F.col("rank") >= len(BASE)) & (F.col("role") != "key_word")).withColumn("bucket", F.explode(F.sequence(
        F.floor((F.col("start") - scope) / _BUCKET), F.floor((F.col("end") + scope) / _BUCKET))))
    other = parts.select("doc", "hash", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("role2"),
                         F.explode(F.sequence(F.floor(F.col("start") / _BUCKET), F.floor((F.col("end") - 1) / _BUCKET))
                                   ).alias("bucket"))
    joined = near.join(other, ["doc", "hash", "bucket"]).filter(
        (F.col("role") != F.col("role2")) & (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope))
    apart = (F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start"))
    met = joined.groupBy("doc", "hash", "start", "end", "rank", "role").agg(
        *[F.max((F.col("role2") == r) & (apart if r == "key_word" else F.lit(True))).alias(r) for r in ROLES],
        F.max(F.col("role2").isin("port", "url") & ~apart).alias("in_url"))
    opens = ~F.col("in_url") & (F.col("service") | F.col("port") | (F.col("url") & F.col("key_word")))
    complete = (F.when(F.col("role") == "secret", F.col("identifier") | opens)
                .when(F.col("role") == "identifier", F.col("secret")).otherwise(F.col("identifier") & F.col("secret")))
    extra = met.filter(complete).groupBy("doc", "hash").agg(
        F.collect_list(F.struct("start", "end", "rank")).alias("extra"))
    extra = scratch.keep(extra, "extra")
    return each.drop("weak").join(extra, ["doc", "hash"], "left").select(
        "doc_id", "doc", "hash", "base", F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Null and empty texts have no spans.  A null id stays null; repeated rows each return; other columns are not read.
    ``spans`` lists kind:start:end of all findings by start, then by kind in the order of BASE and WEAK.
    """
    with Scratch(docs.sparkSession, "credentials") as scratch:
        found = findings(docs, scratch, id_col, text_col, scope)
    count = lambda i: F.size(F.filter("base", lambda x: x["rank"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "extra")).alias("spans"))


#: Code points of a piece of text in which places are looked up: a place in a long text is found by counting from its start.
_PIECE = 4096


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with the spans replaced by the mark, overlapping ones by a single one."""

    def between(pieces, a, b):
        """Code points a to b, end exclusive."""
        whole = F.transform(F.sequence((a / _PIECE).cast("int"), (F.greatest(a, b - 1) / _PIECE).cast("int")), lambda p: F.substring(
            F.get(pieces, p), F.greatest(a - p * _PIECE, F.lit(0)) + 1, b - F.greatest(a, p * _PIECE)))
        return F.when(b > a, F.array_join(whole, "")).otherwise("")

    def joined(v):
        s, tops, pieces = v["spans"], v["tops"], v["pieces"]
        # a span opens a gap before it where it starts behind all earlier ones
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(tops, i - 1)))
        before = F.transform(heads, lambda i: F.concat(between(
            pieces, F.when(i == 0, 0).otherwise(F.get(tops, i - 1)), F.get(s, i)["start"]), F.lit(mark)))
        return F.concat(F.array_join(before, ""), between(pieces, F.get(tops, F.size(s) - 1), v["size"]))

    ordered = F.array_sort(spans)
    return let(F.struct(ordered.alias("spans"), _running(F.transform(ordered, lambda x: x["end"]), F.greatest).alias("tops"),
                        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"),
                        F.char_length(text).alias("size")), joined)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars",
           mark: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """The input rows, columns in order, with every finding in the text replaced by ``mark`` (overlapping ones by a single
    one).  ``n_chars_col``, if the table has it, is counted anew where the text changes.  Null texts stay null."""
    with Scratch(docs.sparkSession, "credentials") as scratch:
        found = findings(docs, scratch, id_col, text_col, scope)
        spans = scratch.keep(found.select("doc", "hash", F.concat("base", "extra").alias("spans")).filter(
            F.size("spans") > 0).dropDuplicates(["doc", "hash"]), "spans")
    merged = _marked(F.col(text_col), F.col("__spans"), mark)
    rows = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn(
        "__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    held = rows.join(spans.select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("spans").alias("__spans")),
                     ["__doc", "__hash"], "left").withColumn(
        "__text", F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(merged))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("__text").alias(c))
        elif c == n_chars_col:
            out.append(F.when(F.col("__spans").isNull(), F.col(c)).otherwise(
                F.char_length("__text").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(c))
    return held.select(*out)
