"""Exact, near, suffix and chunk dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewell.llm.chunks import LEAST_RUN, chunk_dedup, cut_points, gear_hashes, GEAR
from gatewell.llm.components import components
from gatewell.llm.exact import exact_duplicates, normalised
from gatewell.llm.near import BANDS, ROWS, estimated, near_duplicates, shingle_sets, sketches
from gatewell.llm.sorting import maybe_repeated
from gatewell.llm.suffixes import suffix_dedup, with_equal
from gatewell.llm.textcode import Texts, texts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


def arrow(texts):
    import pyarrow as pa

    return texts_of(pa.array(texts, pa.string()))


def test_normalised_lowers_ascii_only(spark):
    chars = [chr(c) for c in [*range(1, 0x3000), *range(0xA640, 0xA7FF), *range(0xFF00, 0xFFEF),
                              *range(0x10400, 0x10450), *range(0x1E900, 0x1E950)]]
    rows = spark.createDataFrame([(c + "AbZ",) for c in chars], "t string")
    bad = [r.t for r in rows.select("t", normalised(F.col("t")).alias("n")).collect()
           if r.n != low(r.t)]
    assert bad == []


def test_exact_against_groups(docs, texts):
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[low(t)].append(k)
    found = exact_duplicates(docs, carry=["lang", "key"]).collect()
    assert len(found) == len(texts)
    for r in found:
        same = groups[low(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.key == r.doc_id and r.lang == "en"


def test_exact_same_head_and_length(spark):
    rows = spark.createDataFrame([(1, "a" * 200 + "b"), (2, "a" * 200 + "c"), (3, "a" * 200 + "B")],
                                 "doc_id bigint, text string")
    found = {r.doc_id: r.keep_id for r in exact_duplicates(rows, slots=1).collect()}
    assert found == {1: 3, 2: 2, 3: 3}


def test_exact_null_ids_and_repeated_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "x"), (None, "y"), (5, "X"), (7, "z"), (7, "z")],
                                 "doc_id bigint, text string")
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept)
                    for r in exact_duplicates(rows).collect()), key=repr)
    assert found == sorted([(None, 5, 2, False), (None, None, 1, True), (5, 5, 2, True),
                            (7, 7, 2, True), (7, 7, 2, True)], key=repr)
    assert exact_duplicates(nothing).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if len(words) >= 5:
        return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_against_all_pairs(docs, texts, tile):
    found = near_duplicates(docs, tile=tile).collect()
    want = brute_components(texts)
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_chain_without_a_common_neighbour(spark):
    """Neighbours of a chain are linked, its ends are not; all are one component."""
    words = [f"w{k}" for k in range(240)]
    rows = [(k, " ".join(words[6 * k:6 * k + 60])) for k in range(20)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(
        dict(rows))


def test_near_pair_whose_buckets_all_have_other_leaders(spark):
    """Short earlier documents quote the pair, each what makes up one band that both share."""
    base = [f"w{k}" for k in range(400)]
    left, right = base + [f"a{k}" for k in range(50)], base + [f"b{k}" for k in range(50)]
    runs = [" ".join(base[k:k + 5]) for k in range(396)]
    single = sketches(shingle_sets(arrow(runs))[0], np.arange(len(runs) + 1))
    whole = sketches(*shingle_sets(arrow([" ".join(left), " ".join(right)])))
    rows = [(1000, " ".join(left)), (1001, " ".join(right))]
    for band in range(BANDS):
        at = range(band * ROWS, (band + 1) * ROWS)
        if all(whole[0, r] == whole[1, r] for r in at):
            quoted = [np.flatnonzero(single[:, r] == whole[0, r]) for r in at]
            if all(len(q) for q in quoted):
                rows.append((band, " ".join(f"{runs[q[0]]} q{band}" for q in quoted)))
    assert len(rows) > 10
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(
        dict(rows))


def test_near_odd_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"),
                                  (4, None)], "doc_id bigint, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect()),
                   key=repr)
    assert found == sorted([(None, None, True), (3, 3, True), (3, 3, True), (4, 4, True)], key=repr)
    assert near_duplicates(nothing).count() == 0


def test_sketches_estimate_similarity():
    """Independent pairs of sets: no bias, and a spread of about 1 / sqrt(4 * registers)."""
    draw, errors = np.random.default_rng(1), []
    for shift in range(0, 900, 30):
        pool = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
        a, b = np.sort(pool[:1000]), np.sort(pool[shift:1000 + shift])
        regs = sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        true = (1000 - shift) / (1000 + shift)
        got = estimated(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0]
        errors.append(got - true)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.15


def test_sketch_of_a_union_is_the_merged_sketch():
    draw = np.random.default_rng(2)
    a, b = (np.sort(draw.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    regs = sketches(np.concatenate([a, b, both]), np.array([0, 500, 1000, 1000 + len(both)]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(5, 5), (1, None)]
    found = {r.node: r.root for r in
             components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {k: 100 for k in range(101, 141)} | {k: 7 for k in range(20, 60)}
    assert found == want


def test_sorting_keeps_all_repeated_keys(spark):
    rows = [(k % 50, k) for k in range(400)] + [(1000 + k, k) for k in range(300)]
    frame = spark.createDataFrame(rows, "k bigint, v bigint")
    kept = {(r.k, r.v) for r in maybe_repeated(frame, "k", "v").collect()}
    assert {r for r in rows if r[0] < 50} <= kept and len(kept) < 450


def brute_spans(texts, span=200):
    bodies = {k: (t or "").encode() for k, t in texts}
    seen = Counter()
    for b in bodies.values():
        seen.update(b[p:p + span] for p in range(len(b) - span + 1))
    found = {}
    for k, b in bodies.items():
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p:p + span]] > 1:
                gone[p:p + span] = b"\1" * span
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        found[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return found


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_suffixes_against_all_windows(spark, docs, texts, partitions):
    """Also with many small partitions, so that groups go on in others."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffix_dedup(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_spans(list(texts.items()))
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want


def test_suffixes_of_repeated_and_null_rows(spark, nothing):
    body = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(260))
    rows = spark.createDataFrame([(1, body), (1, body), (None, "z" * 50), (2, None)],
                                 "doc_id bigint, text string")
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup(rows).collect()), key=repr)
    assert found == sorted([(1, 260, 260), (1, 260, 260), (None, 50, 0), (2, 0, 0)], key=repr)
    assert suffix_dedup(nothing).count() == 0


def test_with_equal_is_exact():
    draw = np.random.default_rng(3)
    tokens = [draw.integers(0, 3, 500).astype(np.uint64) for _ in range(5)]
    rows = list(zip(*[t.tolist() for t in tokens]))
    seen = Counter(rows)
    assert with_equal(tokens).tolist() == [seen[r] > 1 for r in rows]


def test_gear_hash_rolls():
    data = np.random.default_rng(4).integers(0, 256, 300).astype(np.uint8)
    value, rolled = 0, []
    for b in data:
        value = ((value << 1) + int(GEAR[b])) % (1 << 32)
        rolled.append(value)
    assert gear_hashes(data).tolist() == rolled


def test_cuts_move_with_the_text(texts):
    body = (texts[72] or "").encode()
    alone = cut_points(Texts(np.frombuffer(body, np.uint8), np.array([0, len(body)])))
    moved = b"something else " * 5 + body
    shifted = cut_points(Texts(np.frombuffer(moved, np.uint8), np.array([0, len(moved)]))) - 75
    assert set(alone[3:]) <= set(shifted) and len(alone) > 50
    joint = cut_points(Texts(np.frombuffer(b"x" * 90 + body, np.uint8), np.array([0, 90, 90 + len(body)])))
    assert set(joint[joint >= 90] - 90) == set(alone)


def test_chunks_against_brute_force(docs, texts):
    places, sizes = defaultdict(list), {}
    for k, t in texts.items():
        body = arrow([t])
        starts = cut_points(body)
        for a, b in zip(starts, np.append(starts[1:], len(body.data))):
            places[body.data[a:b].tobytes()].append((k, int(a)))
            sizes[k, int(a)] = int(b - a)
    flags = {place: place == min(all_) for all_ in places.values() if len(all_) > 1 for place in all_}
    found = chunk_dedup(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        body = (texts[r.doc_id] or "").encode()
        runs, last = [], None
        for (k, a), first in sorted(flags.items()):
            if k == r.doc_id:
                if last != a:
                    runs.append([])
                runs[-1].append((a, first))
                last = a + sizes[k, a]
        gone, repeated = bytearray(len(body)), 0
        for run in runs:
            total = sum(sizes[r.doc_id, a] for a, _ in run)
            if total >= LEAST_RUN:
                repeated += total
                for a, first in run:
                    if not first:
                        gone[a:a + sizes[r.doc_id, a]] = b"\1" * sizes[r.doc_id, a]
        kept = bytes(x for x, g in zip(body, gone) if not g)
        assert (r.n_bytes, r.n_repeated, r.n_removed, r.kept_sha256) == (
            len(body), repeated, sum(gone), hashlib.sha256(kept).hexdigest())


def test_chunks_catch_shared_passages(docs, texts, nothing):
    found = {r.doc_id: r for r in chunk_dedup(docs).collect()}
    sharing = [k for k in range(10, 40) if k % 3 == 0]
    assert all(found[k].n_repeated > 150 for k in sharing)
    assert sum(found[k].n_removed > 150 for k in sharing) >= len(sharing) - 1
    alone = [k for k in range(13, 40) if k % 3]
    assert all(found[k].n_removed == 0 for k in alone)
    assert chunk_dedup(nothing).count() == 0


def test_short_copies_are_repeated_chunks(spark):
    docs = spark.createDataFrame([(1, "short copy"), (2, "short copy"), (3, "short copy"), (4, "other")],
                                 "doc_id bigint, text string")
    found = {r.doc_id: (r.n_repeated, r.n_removed) for r in chunk_dedup(docs).collect()}
    assert found == {1: (10, 0), 2: (10, 10), 3: (10, 10), 4: (0, 0)}
