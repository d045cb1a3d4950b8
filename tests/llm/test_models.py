"""Classifier, language model, packing, decontamination, licenses and personal data."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from texts_for_tests import prose
from gatewell.llm.contamination import contaminated
from gatewell.llm.licenses import BLOCK, STRIDE, TEMPLATES, THRESHOLD, license_scan, template_words
from gatewell.llm.ngram_lm import backoff_scores
from gatewell.llm.packing import best_fit_packing, best_two_fit, cuts
from gatewell.llm.quality import Settings, quality_scores
from gatewell.llm.queries import QUERIES, vocabulary
from gatewell.llm.sanitise import base_spans, private_spans, sanitised

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


# ---- quality -----------------------------------------------------------------------------------

def labelled(n=1500):
    docs, labels = [], []
    for k in range(n):
        words = prose(k, 40)
        good = k % 3 != 0
        if not good:
            words[5:5] = [["awful", "vile", "foul"][k % 2], "!!"]
        source = "clean" if good == (k % 10 != 0) else "dirty"
        docs.append((k, " ".join(words), source))
        if k % 2 == 0:
            labels.append((k, int(good or k % 6 == 0), int(k % 6 == 0)))
    return docs, labels


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in quality_scores(frame, marks).collect()}
    assert len(found) == len(docs)
    unseen = [k for k in range(len(docs)) if k % 2]
    right = sum(found[k].accepted == (k % 3 != 0) for k in unseen)
    assert right / len(unseen) > 0.98
    assert all(0 <= r.quality_score <= 1 for r in found.values())


def test_classifier_learns_from_metadata_alone(spark):
    docs = [(k, "", "bad" if k % 4 == 0 else "fine") for k in range(800)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    marks = frame.where("doc_id % 2 = 0").select(
        "doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    found = quality_scores(frame, marks, metadata=("source",)).where("doc_id % 2 = 1").collect()
    assert all(r.accepted == (r.source == "fine") for r in found)


def test_classifier_bounds_and_odd_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.quality_score > 0.99 for r in quality_scores(docs, none).collect()} == {True}
    one = spark.createDataFrame([(10, 0, 0), (11, None, 1), (None, 1, 0)],
                                "doc_id bigint, quality int, toxic int")
    assert {r.accepted for r in quality_scores(docs, one).collect()} == {False}
    assert quality_scores(nothing, one).count() == 0
    odd = spark.createDataFrame([(None, None, "en"), (3, "x", None), (3, "x", None)],
                                "doc_id bigint, text string, lang string")
    assert quality_scores(odd, one).count() == 3
    rows, labels = labelled(600)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    small = quality_scores(frame, marks, settings=Settings(labelled_rows=150, pool_rows=50),
                           keep=["doc_id"])
    assert small.columns == ["doc_id", "quality_score", "accepted"] and small.count() == 600


# ---- language model ----------------------------------------------------------------------------

def brute_scores(texts, order, alpha=0.4):
    words = {k: words_of(t) for k, t in texts.items()}
    grams = {k: [Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
                 for n in range(1, order + 1)] for k, w in words.items()}
    whole = [sum((g[n] for g in grams.values()), Counter()) for n in range(order)]
    total = sum(map(len, words.values()))
    found = {}
    for k, w in words.items():
        def others(gram):
            return whole[len(gram) - 1][gram] - grams[k][len(gram) - 1][gram]
        score = 0.0
        for i in range(len(w)):
            value = math.log(max(others((w[i],)), 0.5) / max(total - len(w), 1))
            for n in range(2, min(order, i + 1) + 1):
                gram = tuple(w[i - n + 1:i + 1])
                value = (math.log(others(gram) / others(gram[:-1])) if others(gram) > 0
                         else math.log(alpha) + value)
            score += value
        found[k] = (len(w), score)
    return found


@pytest.mark.parametrize("order, chunk, part", [(2, 4 << 20, 16 << 20), (3, 2000, 700)])
def test_backoff_against_counters(docs, texts, order, chunk, part):
    found = backoff_scores(docs, order=order, chunk_bytes=chunk, part_bytes=part).collect()
    want = brute_scores(texts, order)
    assert len(found) == len(texts)
    for r in found:
        assert r.n_words == want[r.doc_id][0]
        assert r.log_score == pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9)
        assert (r.mean_log_score is None) == (r.n_words == 0)


def test_registered_model_has_contexts_of_two_words(spark, docs, texts, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_scores(texts, 3)
    for r in QUERIES["op6_language_model"](spark, str(tmp_path)).collect():
        assert r.log_score == pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9)


def test_backoff_odd_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)],
                                 "doc_id bigint, text string")
    found = backoff_scores(rows).collect()
    assert sorted((r.n_words, r.n_seen) for r in found) == [(0, 0), (2, 1), (2, 1), (2, 1)]
    assert backoff_scores(nothing).count() == 0


# ---- packing -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


ODD = ["", " ", "  a", "a  b", "a\n b", "a \n b", " x y", "it's 'tis don't 's", "<|endoftext|> hi",
       "a" * 5000 + " b", "日本 語 ✓ é", "tab\t x", "trail ", "1 2,3 4.5", "a  b", "a  b",
       "x \n\n y\n\n", "\x1c a \x1db", "a\x85 b \x85c", "  \n", "é è ê " * 900, None]


def test_packing_round_trip(spark, texts, plain):
    bodies = {**texts, **{1000 + k: t for k, t in enumerate(ODD)}}
    docs = spark.createDataFrame([(k, t) for k, t in bodies.items()], "doc_id bigint, text string")
    found = best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), capacity=256, buckets=3).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for k, text in bodies.items():
        ids, at = plain(text), 0
        total += len(ids)
        mine = sorted(pieces[k], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        for r in mine:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 256 or len(mine) == 1)
        assert all(r.length == 256 for r in mine[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-total // 256) * 1.1 + 1


def test_packing_repeated_null_and_no_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (1, "a")],
                                 "doc_id bigint, text string")
    found = best_fit_packing(rows, vocabulary("byte_bpe_50k.json"), capacity=4).collect()
    assert Counter((r.sequence_id, r.offset) for r in found) == {
        (s, o): 1 for s in {r.sequence_id for r in found} for o in (0, 2)}
    assert best_fit_packing(nothing, vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_patterns_use_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    for length in draw.integers(1, 101, draw.integers(1, 400)):
        counts[length] += draw.integers(1, 5)
    used = np.zeros(101, np.int64)
    bins = 0
    for lengths, times in best_two_fit(counts):
        assert sum(lengths) <= 100 and times > 0
        bins += times
        for length in lengths:
            used[length] += times
    assert (used == counts).all()
    assert bins >= -(-int((np.arange(101) * counts).sum()) // 100)


def test_second_fit_beats_the_greedy_fill():
    """Greedy: 6 + 3 leaves 1. The 3 is given back for 2 + 2, which fill the bin."""
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert best_two_fit(counts)[0] == ([6, 2, 2], 1)


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)] and cuts(8, 4) == [(0, 4), (4, 4)] and cuts(4, 4) == [(0, 4)]


# ---- decontamination ---------------------------------------------------------------------------

def brute_hits(docs, items, window=13):
    known = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            known[tuple(words[k:k + size])].add(str(item))
    found = {}
    for k, text in docs.items():
        words, hit, ids = words_of(text), set(), set()
        for size in {len(g) for g in known}:
            for p in range(len(words) - size + 1):
                if tuple(words[p:p + size]) in known:
                    hit.update(range(p, p + size))
                    ids |= known[tuple(words[p:p + size])]
        found[k] = (len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words))
    return found


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contamination_against_all_windows(spark, docs, texts, limit):
    """Also with both joins as shuffles."""
    items = [(k, " ".join(prose(k, 150)[20 + k:60 + k])) for k in range(10, 20)]
    items += [(1, "x401 x402"), (2, "one"), (3, ""), (4, None), (5, " ".join(prose(5, 4000)[100:113])),
              (6, " ".join(prose(5, 4000)[3000:3012])), (7, "A. B, c!"), (9, "not there at all"),
              (21, items[0][1]), (None, items[1][1]), (22, "e " * 30)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = contaminated(docs, frame, broadcast_rows=limit).collect()
    want = brute_hits(texts, [i for i in items if i[0] is not None])
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in found} == want
    assert all(r.n_items == len(r.items) for r in found)


def test_contamination_odd_rows(spark, docs, texts, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated or r.n_hit for r in contaminated(docs, none).collect())
    items = spark.createDataFrame([("z", "a b c")], "item_id string, text string")
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in contaminated(rows, items).collect()) == [
        (0, 3), (1, 3), (1, 3)]
    assert contaminated(nothing, items).count() == 0


# ---- licenses ----------------------------------------------------------------------------------

def brute_licenses(text):
    words = words_of(text)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    starts, labels = [], set()
    for phrase, label in phrases.items():
        parts = phrase.split()
        here = [k for k in range(len(words)) if words[k:k + len(parts)] == parts]
        starts += here
        labels |= {label} if here else set()
    best, more = 0.0, set()
    for at in range(0, max(len(words) - STRIDE, 1), STRIDE):
        block = set(words[at:at + BLOCK])
        for label, template in TEMPLATES.items():
            tokens = template_words(template)
            share = len(block & tokens) / len(tokens)
            if share >= THRESHOLD:
                more.add(label)
                best = max(best, share)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if starts else best)


def test_licenses_against_brute_force(spark, texts):
    bodies = dict(texts)
    pad = prose(77, 300)
    for k, (label, template) in enumerate(TEMPLATES.items()):
        parts = template.split()
        bodies[100 + k] = " ".join(pad[:31 * k] + parts + pad[:50])
        bodies[200 + k] = " ".join(pad[:17 * k] + parts[:-max(1, len(parts) // 6)] + pad)
        bodies[300 + k] = " ".join(pad[:5 * k] + parts[:len(parts) // 2] + pad)
        bodies[400 + k] = template.upper()
    bodies[500] = "CC BY, cc-by. cc by cc by; General\nPublic License All rights reserved"
    bodies[501] = "the license under the license of the"
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in bodies.items()],
                                 "doc_id bigint, text string, key int, label string")
    found = license_scan(docs).collect()
    assert len(found) == len(bodies)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels,
                r.score) == brute_licenses(bodies[r.doc_id]), bodies[r.doc_id]


def test_licenses_odd_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by"), (1, None)],
                                 "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_base, r.labels) for r in license_scan(rows).collect()) == [
        (0, 1, "cc-by"), (1, 0, ""), (1, 1, "cc-by"), (1, 1, "cc-by")]
    assert license_scan(nothing).count() == 0


# ---- personal data -----------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_private(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


PRIVATE = [
    "mail a.b+c@x-y.co.uk, then d@e.f@g.h and i@j._k@l.m; @n.o p@ q@r", "4111 1111 1111 1111 1234",
    "4111-1111-1111-1111", "4111 1111  1111 1111", "4111111111111111 5500005555555559 1-2-3", "1.2.3.4.5.6.7.8",
    "256.1.1.1 0255.001.00000.9 1.2.3 999.1.2.3.4 12.34.56.78.", "+49 (30) 123-45.67 8 +1 +12345678 +1 23",
    "+123456789012345678 +1...............2 é😀 +44 20 7946 0958 z@é.com ü@a.de", "0" * 40, "9" * 3000,
    "a" * 3000 + "@b.c", "1." * 2000, "x@" + "y." * 1500 + "z", "+1" + "(" * 2000, None, "",
    "378282246310005 6011111111111117 3530111333300000", "😀 a@b.cc 😀 10.0.0.1"]


def test_private_base_spans_against_patterns(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(PRIVATE)],
                                 "doc_id bigint, text string, key int")
    for r in private_spans(docs).collect():
        want = brute_private(PRIVATE[r.doc_id])
        assert r.base_spans == ",".join(want), PRIVATE[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(w.startswith(kind + ":") for w in want) for kind in PLAIN]
        assert r.spans.startswith(r.base_spans)


def test_terms_that_reveal_an_entity(spark):
    rows = [(k, f"{' '.join(prose(k, 30))} reach Zebulon via z@corp.example today") for k in range(3)]
    rows += [(10 + k, f"{' '.join(prose(k, 30))} today reach out via somebody") for k in range(40)]
    rows += [(90, "zebulon elsewhere"), (91, "today q@w.example")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    found = {r.doc_id: r for r in private_spans(docs).collect()}
    for k in range(3):
        terms = [s.split(":") for s in found[k].spans.split(",") if s.startswith("term:")]
        shown = {texts[k][int(a):int(b)] for _, a, b in terms}
        assert "Zebulon" in shown and "today" not in shown and "reach" not in shown
    assert found[90].spans == "" and "term" not in found[91].spans


def test_term_is_tested_with_every_entity(spark):
    """The hotline is beside the name more often, but only the person's address is revealed by it."""
    rows = []
    for k in range(90):
        text = " ".join(prose(k, 12))
        text += " Weatherby" * (k < 10) + " w@corp.example" * (k < 9) + " help@desk.example" * (k < 30)
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in private_spans(docs).collect()}
    at = {k: t.find("Weatherby") for k, t in rows}
    assert all(f"term:{at[k]}:{at[k] + 9}" in found[k] for k in range(9))


def test_revealing_term_is_found_beyond_the_reach(spark):
    far = " ".join(f"{k}{k}" for k in range(1000, 1100))
    rows = [(k, f"Zebulon via z@corp.example {far} zebulon, {far} ZEBULON") for k in range(3)]
    rows += [(10 + k, " ".join(prose(k, 30))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in private_spans(docs).collect()}
    for k in range(3):
        at = [m.start() for m in re.finditer("zebulon", rows[k][1].lower())]
        assert len(at) == 3 and all(f"term:{a}:{a + 7}" in found[k].split(",") for a in at)


def test_private_odd_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id bigint, text string")
    assert [(r.n_email, r.spans) for r in private_spans(rows).collect()] == [(1, "email:0:5")] * 3
    assert private_spans(nothing).count() == 0
    text = spark.createDataFrame([("call +49 30 1234567 or a@b.c now",)], "t string")
    assert text.select(sanitised(F.col("t"), base_spans(F.col("t")))).first()[0] == (
        "call [private] or [private] now")
