"""Quality rules by repetition coverage.

For several n-gram lengths the operator measures how many of a text's word characters lie inside n-grams that the text
holds twice or more, and how many lie on lines that repeat an earlier line; a symbol share completes the rules.  Windows are compared by rolling hashes over
64-bit word hashes, in numpy, one text at a time; no row is shuffled.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: n-gram length -> largest share of word characters inside duplicated n-grams of that length.  Long clean texts repeat short
#: n-grams, so their limits are wider.  From 8 words on the base rule decides: any limit below it rejects good texts first.
NGRAM_LIMITS = {2: 0.70, 3: 0.60, 4: 0.55, 5: 0.50, 6: 0.48, 7: 0.46}
#: Largest share of word characters on lines that repeat an earlier line.
LINE_LIMIT = 0.30
#: Most symbols per word.
SYMBOL_LIMIT = 0.1
#: Base rules: fewest words, and the largest percentage of words in 8-word windows found twice or more.
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\v\f\r"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(29)
_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "dup_line_share double, dup_ngram_shares array<double>, base_failed boolean, kept boolean")


def covered(windows: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a window of n words whose hash occurs twice or more."""
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    edge = np.zeros(n_words + 1, np.int32)
    if same.any():
        hit = np.zeros(len(windows), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        starts = np.flatnonzero(hit)
        edge[starts] += 1
        edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> dict:
    """Signals of one text (null counts as empty)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_line_chars += len(line) - sum(map(line.count, _SPACES))
        else:
            seen.add(line)
    lengths = sorted({*NGRAM_LIMITS, REPEAT_WINDOW})
    shares, repeated = dict.fromkeys(NGRAM_LIMITS, 0.0), 0
    if n > lengths[0]:
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        hashes = (hashes ^ (hashes >> _MIX)) * _MUL
        sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
        rolled, size = hashes, 1
        for k in lengths:
            if n <= k:
                break
            while size < k:  # one word more: the window without it, moved, plus the new word
                rolled = rolled[:-1] * _MUL + hashes[size:]
                size += 1
            mask = covered(rolled, k, n)
            if k == REPEAT_WINDOW:
                repeated = int(mask.sum())
            if k in shares:
                shares[k] = float(sizes[mask].sum()) / chars
    line_share = dup_line_chars / chars if chars else 0.0
    symbols = sum(map(text.count, _SYMBOLS))
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeated, "dup_line_share": line_share, "dup_ngram_shares": list(shares.values()),
        "base_failed": failed,
        "kept": not failed and symbols <= SYMBOL_LIMIT * n and line_share <= LINE_LIMIT and all(shares[k] <= v for k, v in NGRAM_LIMITS.items()),
    }


def quality(text: Column) -> Column:
    """A struct of the signals and the verdict ``kept`` for a text column."""
    kind = pa.struct([
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()), ("dup_line_share", pa.float64()),
        ("dup_ngram_shares", pa.list_(pa.float64())), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    @arrow_udf(_SCHEMA)
    def signals(texts: pa.Array) -> pa.Array:
        return pa.array([measure(x.as_py()) for x in texts], kind)

    return signals(text)


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the signals of its whole text.

    Null and empty texts have no words and fail the base rules; a null id stays null; repeated rows are judged each on
    its own; other columns, whatever their names, are not read.
    """
    q = docs.select(F.col(id_col), quality(F.col(text_col)).alias("q"))
    return q.select(id_col, "q.*")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows, all columns unchanged, whose text passes the base rules and the coverage limits."""
    return docs.filter(quality(F.col(text_col))["kept"])
