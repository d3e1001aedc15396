"""Conversation trie, ranked search and n-gram join against brute force, with nulls, ties, repeats, empties, clashing columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorframe.llm import jaccard, ranking, trie
from mirrorframe.llm.common import Scratch

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- trie -----------------------------------------------------------------------------------------------------------------

def _trees(draw):
    n = draw(st.integers(1, 300))
    kinds = draw(st.lists(st.booleans(), min_size=n, max_size=n))
    bits, depth = [1], 1
    for deeper in kinds:
        if deeper or depth == 1:
            bits.append(1)
            depth += 1
        else:
            bits.append(0)
            depth -= 1
    return bits + [0] * depth


@settings(max_examples=60, deadline=None)
@given(st.composite(_trees)())
def test_findclose_and_rank_equal_a_stack(bits):
    close, stack = {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    opens = np.flatnonzero(bits)
    shape = trie.Parentheses(np.array(bits))
    closes = shape.findclose(opens)
    assert closes.tolist() == [close[i] for i in opens]
    assert shape.rank(closes).tolist() == [sum(bits[:c]) for c in closes]
    text = "".join("(" if b else ")" for b in bits)
    assert shape.leaf_pairs(opens, closes).tolist() == [text[o:c + 1].count("()") for o, c in zip(opens, closes)]


def _brute_trie(members: dict):
    """members: conv_id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, path in members.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    out = []
    for n, of in nodes.items():
        inside = [m for m in nodes if m[:len(n)] == n]
        ends = sorted(c for c in of if len(members[c]) == len(n))
        out.append((min(of), len(n), min(nodes[n[:-1]]) if n else None, len(of), kids[n],
                    sum(kids[m] == 0 for m in inside),
                    sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in inside if m),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[1], r[3]) for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + path[h:]
    return out


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 130), *range(200, 215), 7, 450, -3, -120]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8]) + 1):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bc", "Ünï"])))
    rows += [(300 + i, t, "user", "same") for i in range(9) for t in range(7)]       # copies
    rows += [(500, t, "user", f"long {t % 3}") for t in range(60)] + [(501, t, "user", f"long {t % 3}") for t in range(57)]
    rows += [(600, None, None, None), (600, None, "user", "x"), (600, 1, "user", None), (600, 1, "user", "tie"), (600, 1, "user", "tie")]
    rows += [(None, 0, "user", "belongs to none"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [2, 1000])
def test_trie_equals_brute_force(on_workers, shard_rows):
    rows = _conversations(3)
    table = on_workers.createDataFrame([(*r, 1, "clash") for r in rows],
                                       "conv_id long, turn long, role string, text string, depth int, key string")
    with Scratch(on_workers, "t") as s:
        members, turns = trie.shared_openings(trie.turns_in_order(table, s), s)
        got = trie.prefix_trie(members, turns, s, shard_rows)
        got = sorted((tuple(r) for r in got.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)
    assert got == _brute_trie(_rebuilt(rows))


def test_trie_of_no_conversations_is_empty(on_workers):
    table = on_workers.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    with Scratch(on_workers, "t") as s:
        members, turns = trie.shared_openings(trie.turns_in_order(table, s), s)
        assert trie.prefix_trie(members, turns, s).collect() == []


def test_ids_of_a_hot_node_are_hashed_in_pieces(on_workers):
    ids = list(range(-5, 30_000))
    ends = on_workers.createDataFrame([(bytearray(b"k"), i) for i in ids] + [(bytearray(b"j"), 4)], "key binary, conv_id long")
    with Scratch(on_workers, "t") as s:
        got = {bytes(r.key): r.ends_sha256 for r in trie._id_hashes(ends, s).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"j": hashlib.sha256(b"4").hexdigest()}


# --- ranked search --------------------------------------------------------------------------------------------------------

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_UP))


def _brute_search(docs, items, k):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(w(t) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in _terms(text) if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [1 << 17, 8])
def test_search_equals_brute_force(on_workers, block_terms):
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "the", "of", "ÉTÉ", "été", "x1", "naïve", *(f"w{i}" for i in range(40))])
    text = lambda n: rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randint(0, n)))
    docs = [(i, text(30)) for i in range(300)] + [(None, "w1 w2"), (None, None), (7, "w1"), (7, "w1"), (400, ""), (401, "w3 " * 5000)]
    docs += [(1000 - i, "tie w5") for i in range(30)]
    items = [(i, text(8)) for i in range(12)] + [(3, "w5 w5 w5"), (3, "w5 w5 w5"), (20, None), (21, "?!"), (22, "absent"), (None, "w1")]
    table = on_workers.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, item_id string, n int").repartition(5)
    queries = on_workers.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = ranking.search(table, queries, k=20, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == _brute_search(docs, items, 20)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_in_empty_tables(on_workers):
    none = on_workers.createDataFrame([], "doc_id long, text string")
    some = on_workers.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(none, some).collect() == []
    assert ranking.search(some.withColumnRenamed("item_id", "doc_id"), some.limit(0)).collect() == []


def test_column_tiles_stay_exact(monkeypatch):
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 50, rng.integers(1, 200)) for _ in range(300)]
    weight = rng.integers(0, 40_000, 50)
    monkeypatch.setattr(ranking, "EXACT", 200_000 * ranking.IMPACT_BOUND)  # some single columns are over this, and are halved
    tiles = ranking.item_tiles(items, weight)
    whole = np.zeros((300, 50))
    for number, tile in enumerate(tiles):
        for columns, weights in tile:
            assert weights.sum(axis=1).max() * ranking.IMPACT_BOUND < ranking.EXACT
            np.add.at(whole, (slice(number * ranking.TILE_ITEMS, number * ranking.TILE_ITEMS + len(weights)), columns), weights)
    assert whole.tolist() == [(np.bincount(i, minlength=50) * weight).tolist() for i in items]


# --- n-gram join ----------------------------------------------------------------------------------------------------------

def _gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UP))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute_classes(docs):
    sets = [_gram_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def _near_copies(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]
    passage = fresh(60)
    texts = [fresh(rng.randint(1, 120)) for _ in range(60)] + [fresh(30) + passage + fresh(rng.randint(0, 60)) for _ in range(40)]
    base = fresh(150)
    for _ in range(60):                            # a group of near copies, some over the bound and some under
        copy = list(base)
        for i in rng.sample(range(150), rng.randint(0, 7)):
            copy[i] = "edit" + str(rng.randint(0, 9))
        texts.append(copy)
    chain = fresh(100)
    for _ in range(25):                            # each like the one before, ends unlike
        chain = chain[4:] + fresh(4)
        texts.append(chain)
    for n in (1, 2, 4, 5, 6, 9):
        short = fresh(n)
        texts += [short, short, short + ["more"], [w.upper() for w in short]]
    rows = [" ".join(t) for t in texts]
    docs = [(rng.randint(-40, 10_000), t) for t in rows]
    docs += [(3, None), (4, ""), (5, " \n"), (None, rows[0]), (None, rows[101]), (None, "lonely text"), (9, rows[0]), (9, rows[0]),
             (77, "long " * 3000 + "tail"), (78, "LONG " * 3000 + "tail"), (79, " ".join(f"v{i}" for i in range(4000)))]
    rng.shuffle(docs)
    return docs


def test_join_equals_brute_force(on_workers):
    docs = _near_copies(11)
    table = on_workers.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, key int").repartition(6)
    got = jaccard.near_classes(table)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == _brute_classes(docs)


def test_join_of_an_empty_table(on_workers):
    assert jaccard.near_classes(on_workers.createDataFrame([], "doc_id long, text string")).collect() == []


def test_gram_sets_are_those_of_the_words():
    known = jaccard._WordHashes()
    for t in [None, "", " ", "a", "a b", "a b c d e", "A B c d e f", "a " * 50, "x y z " * 9]:
        assert len(jaccard.gram_set(t and t.encode(), 5, known)) == len(_gram_set(t))
    same = jaccard.gram_set(b"One two\tthree four five six", 5, known)
    assert same.tolist() == jaccard.gram_set(b"one TWO three  four five six", 5, known).tolist()
    assert not set(same.tolist()) & set(jaccard.gram_set(b"one two three", 5, known).tolist())
