"""Ranked search, periodic runs and the n-gram join against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from texts_for_tests import prose

from gatewell.llm import fragments
from gatewell.llm.fragments import ngram_join
from gatewell.llm.periods import periodic_runs, runs_of
from gatewell.llm.queries import _rewound
from gatewell.llm.ranked import ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(texts, items, top=20):
    held = {k: Counter(terms_of(t)) for k, t in texts.items()}
    held = {k: c for k, c in held.items() if c}
    total, mass = len(held), sum(sum(c.values()) for c in held.values())
    df = Counter(t for c in held.values() for t in c)
    found = set()
    for item, text in items.items():
        scores = []
        for k, c in held.items():
            m = 100 - 25 + (25 * sum(c.values()) * total) // mass
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms_of(text) if c[t])
            if score > 0:
                scores.append((-score, k))
        found |= {(item, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scores)[:top])}
    return found


@pytest.fixture(scope="module")
def items():
    some = {k: " ".join(prose(k, 12) + prose(999, 4) * 2) for k in range(10, 50)}
    return some | {0: None, 1: "", 2: "ONE one", 3: "absent", 4: "é ß é", 5: ". ! ?"}


def as_items(spark, items):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in items.items()],
                                 "item_id bigint, text string, doc_id string, slot int")


@pytest.mark.parametrize("owners, bundle, top", [(4, 128, 20), (1, 5, 3), (3, 1, 100)])
def test_search_against_brute_force(spark, docs, texts, items, owners, bundle, top):
    found = ranked_search(docs, as_items(spark, items), owners=owners, bundle=bundle, top=top)
    rows = found.collect()
    assert len(rows) == len(set(rows))
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows} == brute_search(texts, items, top)


def test_search_lets_go_only_what_is_out_of_reach(spark):
    """Many documents with the frequent terms only, few with rare ones, in one block."""
    words = [f"w{k}" for k in range(40)]
    texts = {d: " ".join(w for k, w in enumerate(words) if (d * 7 + k * k) % (k + 1) < 2)
             for d in range(600)}
    items = {k: " ".join(words[k:k + 20]) for k in range(0, 20, 4)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    found = ranked_search(frame, as_items(spark, items), top=5).collect()
    assert {tuple(r) for r in found} == brute_search(texts, items, 5)


def test_search_ties_repeats_nulls_and_empty_tables(spark, docs, nothing, items):
    rows = [(7, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (9, "c"), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (None, "c")], "item_id bigint, text string")
    found = [tuple(r)[:3] for r in ranked_search(frame, asked).collect()]
    assert sorted(found, key=str) == [(1, 1, 3), (1, 2, 3), (1, 3, 7), (1, 4, None), (None, 1, 9)]
    some = as_items(spark, items)
    assert ranked_search(nothing, some).count() == 0
    assert ranked_search(docs, some.where("item_id < 0")).count() == 0


def brute_runs(words, least_length=6, least_exponent=4):
    n, found = len(words), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.append((i, j - i + q, q))
            i = j
    found = [(s, l, q) for s, l, q in found if l >= max(least_length, least_exponent * q)]
    return sorted(r for r in found if not any(
        t[2] < r[2] and t[0] <= r[0] and t[0] + t[1] >= r[0] + r[1] for t in found))


def brute_collapsed(words, runs):
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_rows(spark, texts):
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()],
                                  "doc_id bigint, text string, runs int, id string")
    return {r.doc_id: r for r in periodic_runs(frame).collect()}


def run_texts():
    found = {0: None, 1: "", 2: " \t\x0b ", 3: "a " * 5, 4: "a " * 6, 5: "A a " * 8, 6: "é é\x00 " * 9}
    draw = np.random.default_rng(7)
    for k in range(10, 160):  # few words and repeated stretches, so that runs meet and overlap
        words = []
        while len(words) < 60:
            stretch = [chr(97 + c) for c in draw.integers(0, 3, draw.integers(1, 7))]
            words += stretch * int(draw.integers(1, 9))
        found[k] = " ".join(words)
    found[200] = "x " * 5000
    found[201] = ("a b " * 700 + "c ") * 5
    return found


def test_runs_against_brute_force(spark):
    texts = run_texts()
    rows = run_rows(spark, texts)
    assert len(rows) == len(texts)
    some = 0
    for k, text in texts.items():
        words = WORD.findall(text or "")
        want = brute_runs(words) if len(words) < 4000 else [(0, 5000, 1)] if k == 200 else None
        got = [tuple(r) for r in rows[k].runs]
        assert rows[k].n_words == len(words)
        if want is not None:
            assert got == want, k
            assert rows[k].collapsed == brute_collapsed(words, want)
            some += len(want)
    assert some > 200
    assert (0, 7005, 1401) in [tuple(r) for r in rows[201].runs]


def test_runs_of_other_bounds():
    draw = np.random.default_rng(3)
    for _ in range(300):
        words = draw.integers(0, 2, draw.integers(0, 40)).astype(np.uint64)
        for length, exponent in ((2, 2), (5, 3)):
            got = runs_of(words, np.array([0, len(words)]), length, exponent)
            assert [tuple(r[1:]) for r in got.tolist()] == brute_runs(words.tolist(), length, exponent)


def test_runs_of_empty_tables_and_repeated_rows(spark, nothing):
    assert periodic_runs(nothing).count() == 0
    rows = spark.createDataFrame([(None, "a " * 9), (1, "b " * 9), (1, "b " * 9)],
                                 "doc_id bigint, text string")
    assert sorted((len(r.runs), r.collapsed) for r in periodic_runs(rows).collect()) == [
        (1, "a"), (1, "b"), (1, "b")]


def test_rewound_documents(spark, folder):
    from zlib import crc32

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    given = {r.doc_id: r.text for r in docs.collect()}
    for r in _rewound(docs).collect():
        h = crc32(str(r.doc_id).encode())
        words = WORD.findall(given[r.doc_id] or "")
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert WORD.findall(r.text or "") == words


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 3:
        return {tuple(words[k:k + 3]) for k in range(len(words) - 2)}
    return {tuple(words)} if words else set()


def brute_join(rows):
    """Per row (id, text): the size of its set and the smallest id of its component."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def joined(frame):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(frame).collect())


def test_join_against_all_pairs(docs, texts):
    assert joined(docs) == brute_join(list(texts.items()))


def test_join_of_hot_groups(spark):
    """Chains of small changes, members near the core but not near each other, and sets just below
    and just above the threshold."""
    core, rows = prose(1, 200), []
    for k in range(120):
        words = list(core)
        for j in range(k % 5):
            words[(37 * k + 41 * j) % 200] = f"own{k}x{j}"
        rows.append((k, " ".join(words)))
    chain = prose(2, 150)
    for k in range(60):  # each is near the next one, the first and the last are far apart
        chain = list(chain)
        chain[(2 * k) % 150] = f"step{k}"
        rows.append((1000 + k, " ".join(chain)))
    passage = prose(3, 100)
    for k in range(80):  # most of the text is shared, and still not enough
        rows.append((2000 + k, " ".join(passage + prose(5000 + k, 7 + k % 5))))
    for k in range(40):
        rows.append((3000 + k, " ".join(prose(4, 90 + k))))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want = brute_join(rows)
    assert len({c for _, _, c in want}) > 50
    assert joined(frame) == want


def test_join_does_not_rest_on_the_order(docs, texts, monkeypatch):
    """Any order and any fragments give the same result."""
    def backwards(source, size, n):
        return np.arange(1 << fragments.COUNTER_BITS, dtype=np.uint32)[::-1].copy(), np.array([5, 5])

    monkeypatch.setattr(fragments, "_order_of", backwards)
    assert joined(docs) == brute_join(list(texts.items()))


def test_join_repeated_ids_nulls_and_empty_tables(spark, nothing):
    some, other = " ".join(prose(1, 50)), " ".join(prose(2, 50))
    rows = [(5, some), (5, other), (9, other.upper()), (7, some), (7, some), (1, None), (2, ""),
            (3, "a b"), (4, "A  b"), (6, "b a")]
    frame = spark.createDataFrame([*rows, (None, some), (None, None)], "doc_id bigint, text string")
    want = brute_join(rows) + Counter([(None, 48, None), (None, 0, None)])
    assert joined(frame) == want
    assert ngram_join(nothing).count() == 0
