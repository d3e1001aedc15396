"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language accepts exactly the substrings of that text.  A text is parsed into
phrases, each the longest match from where the last one ended; the fewer phrases it needs per character, times the bits
that a place in the labelled text takes, the closer the language.  Texts are folded first: letters in lower case, one space
for anything else.

The labelled sample is bounded (``train_chars`` folded characters a language); everything else covers all rows.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Folded characters that are parsed on their own: long texts are cut into pieces of this size, all of which count.
PIECE = 512
_built: dict = {}
_folds = np.zeros(0x110000, np.int32)  # code point -> folded code point, 0: not looked up yet


def _fold_table(points: np.ndarray) -> np.ndarray:
    for p in np.unique(points[_folds[points] == 0]).tolist():
        low = chr(p).lower()
        _folds[p] = ord(low[0]) if low[0].isalpha() else 32
    return _folds[points]


def folded(text: str) -> np.ndarray:
    """Folded code points, without spaces at the ends or in a row; empty if there is no letter."""
    out = _fold_table(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32))
    space = out == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = out[keep]
    if len(out) and out[0] == 32:
        out = out[1:]
    if len(out) and out[-1] == 32:
        out = out[:-1]
    return out


class Transitions:
    """Transitions of an automaton as a double array: that of a state and a letter lies in ``cells`` at the state's ``base`` plus
    the letter, with the state as its owner.  Its size follows the number of transitions, not states times letters."""

    def __init__(self, out: list[dict[int, int]], letters: int):
        degree = np.array([len(x) for x in out], np.int64)
        letter = np.fromiter((c for x in out for c in x), np.int64, int(degree.sum()))
        target = np.fromiter((to for x in out for to in x.values()), np.int64, len(letter))
        first = np.concatenate(([0], np.cumsum(degree)))
        self.base = np.zeros(len(out), np.int64)
        self.cells = np.full(letters + 4 * len(letter) + 64, -1, np.int64)  # owner << 32 | target; -1: free
        rng = np.random.default_rng(0)
        for d in np.unique(degree[degree > 0])[::-1].tolist():  # states with many transitions take their places first
            left, rounds = np.flatnonzero(degree == d), 0
            while len(left):
                rounds += 1
                if rounds % 32 == 0:
                    self.cells = np.concatenate((self.cells, np.full(len(letter) + letters, -1, np.int64)))
                base = rng.integers(0, len(self.cells) - letters, len(left))
                edges = first[left][:, None] + np.arange(d)
                places = base[:, None] + letter[edges]
                free = (self.cells[places] < 0).all(axis=1)
                _, earliest = np.unique(places[free], return_index=True)  # a place that several want goes to the first
                got = np.flatnonzero(free)[np.bincount(earliest // d, minlength=int(free.sum())) == d]
                self.base[left[got]] = base[got]
                self.cells[places[got]] = left[got][:, None] << 32 | target[edges[got]]
                left = np.delete(left, got)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The state after each state's letter, 0 if there is none."""
        cell = self.cells[self.base[state] + letter]
        return np.where(cell >> 32 == state, cell & 0xFFFFFFFF, 0)


def suffix_automaton(text: list[int], letters: int) -> Transitions:
    """The automaton of all substrings of ``text``; state 0 is the start, and 0 as a target is none."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return Transitions(nxt, letters)


def phrases(table: Transitions, pieces: np.ndarray) -> np.ndarray:
    """Phrases that each row of ``pieces`` needs (letters, -1 past a row's end; rows by length, the longest first)."""
    lengths = (pieces >= 0).sum(axis=1)
    count, state = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    columns = np.ascontiguousarray(pieces.T)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        c = columns[t, :n]
        to = table.step(state[:n], c)
        lost = np.flatnonzero(to == 0)
        if len(lost):  # the match ends: a phrase begins with this letter
            inside = state[lost] > 0  # at the start of a phrase an unknown letter is a phrase of its own
            count[lost[inside]] += 1
            to[lost] = table.step(np.zeros(len(lost), np.int64), c[lost])
            unknown = lost[to[lost] == 0]
            count[unknown[t + 1 < lengths[unknown]]] += 1
        state[:n] = to
    return count


class Model:
    """Automata of the labelled samples: {language: folded text}."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        chars = sorted({ord(c) for s in samples.values() for c in s})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no sample
        self.letter[chars] = np.arange(1, len(chars) + 1)
        self.bits = [math.log2(max(2, len(samples[x]))) for x in self.languages]
        self.tables = [suffix_automaton(self.letter[[ord(c) for c in samples[x]]].tolist(), len(chars) + 1)
                       for x in self.languages]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the least normalised phrases; the score is how far the second is behind."""
        rows, owner = [], []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            points = folded(text) if text else ()
            sizes[i] = len(points)
            letters = self.letter[points] if len(points) else ()
            for at in range(0, len(points), PIECE):
                rows.append(letters[at:at + PIECE])
                owner.append(i)
        totals = np.zeros((len(self.languages), len(texts)), np.float64)
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        for at in range(0, len(order), 4096):  # bounded memory, whatever the batch
            part = order[at:at + 4096]
            block = np.full((len(part), len(rows[part[0]])), -1, np.int32)
            for k, i in enumerate(part):
                block[k, :len(rows[i])] = rows[i]
            who = np.array([owner[i] for i in part])
            for k, table in enumerate(self.tables):
                np.add.at(totals[k], who, phrases(table, block))
        out = []
        for i in range(len(texts)):
            if not sizes[i] or not self.languages:
                out.append(("und", 0.0))
                continue
            cost = [totals[k, i] * b / sizes[i] for k, b in enumerate(self.bits)]
            best = min(range(len(cost)), key=lambda k: (cost[k], self.languages[k]))
            rest = [c for k, c in enumerate(cost) if k != best]
            out.append((self.languages[best], 1.0 - cost[best] / min(rest) if rest else 1.0))
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_chars: int, train_docs: int) -> dict[str, str]:
    """Folded labelled text by language: of each language the ``train_docs`` documents with the smallest hash of their id,
    in that order, as many as ``train_chars`` characters hold (one that does not fit ends there).

    Ids are picked first, from narrow rows; only the picked texts come to the driver: languages x ``train_docs`` rows.
    """
    from pyspark.sql import Window

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    by_hash = Window.partitionBy("lang").orderBy("h")
    picked = rows.select("lang", "h").withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= train_docs)
    picked = picked.select("lang", "h").distinct()
    texts: dict[str, dict[int, str]] = {}
    for r in rows.select("lang", "h", F.substring("text", 1, 2 * train_chars).alias("text")).join(
            F.broadcast(picked), ["lang", "h"]).toLocalIterator():
        held = texts.setdefault(r.lang, {})
        held[r.h] = min(held.get(r.h, r.text), r.text)
    out = {}
    for lang, held in texts.items():
        text = " ".join("".join(map(chr, folded(held[h]).tolist())) for h in sorted(held))[:train_chars].strip()
        if text:
            out[lang] = text
    return out


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_chars: int = 40_000, train_docs: int = 60) -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred`` and ``score`` (0 to 1).

    Learns from ``train`` (text and non-null language) only.  Null texts and texts without a letter are ``und`` with score
    0, as is everything if there is nothing to learn from; ties go to the first language in alphabetical order; with one
    language the score is 1.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(sample(train, id_col, text_col, lang_col, train_chars, train_docs))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @arrow_udf("lang_pred string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        if _built.get("of") != held.value:
            _built.update(of=held.value, model=Model(held.value))
        model, out = _built["model"], []
        for at in range(0, len(texts), 2000):
            out += model.predict(texts.slice(at, 2000).to_pylist())
        return pa.array([{"lang_pred": a, "score": min(1.0, max(0.0, b))} for a, b in out], kind)

    return docs.select(F.col(id_col), guess(F.col(text_col)).alias("g")).select(id_col, "g.lang_pred", "g.score")
