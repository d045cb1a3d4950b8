"""Near duplicates by SetSketch registers, bands of them, a likelihood estimate and a full check."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.components import components
from gatewell.llm.sorting import whole_groups
from gatewell.llm.textcode import (
    NON_SPACE, mixed, run_edges, run_hashes, signed, slices, texts_of, whole_starts, words_of,
)
from gatewell.session import materialize

SHINGLE = 5
SHARED, OF = 75, 100     # documents are linked when 100 * intersection >= 75 * union
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
# The closer to 1, the less often registers of unrelated sets agree by chance: at 1.02 in 1 of 200
# cases, so a band of theirs agrees in 6 of 10**10.
BASE = 1.02
LOWEST = 200             # added to a register, so that it is not negative
# An estimate this far below the threshold is off by more than six standard deviations.
LEAST_ESTIMATE = 0.52
TILE = 1024
TILE_SHINGLES = 1_000_000   # so that tiles of long texts have fewer of them
_GRID = np.linspace(0.0, 1.0, 101)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    words = words_of(texts, NON_SPACE)
    counts = words.counts()
    start = whole_starts(words.first, SHINGLE)
    text, value = [words.text[start]], [run_hashes(words.hashes, SHINGLE)[start]]
    for size in range(1, SHINGLE):  # a text of fewer words is one shingle
        alone = np.flatnonzero(counts == size)
        if len(alone):
            text.append(alone)
            value.append(run_hashes(words.hashes, size)[words.first[:-1][alone]])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[fresh], value[fresh]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers, one row per set.

    Every element is the source of a Poisson process of events in exponential time; an event has a
    random register. A register's minimum is the time of its first event from any element, so it
    is exponential with a rate of the number of elements; minima of a union are minima of minima.
    Times are truncated where all registers have had an event but for a chance of 1 in 10**5.
    The register keeps the time's place on an exponential scale.
    """
    n_sets = len(first) - 1
    sizes = np.diff(first)
    owner = np.repeat(np.arange(n_sets), sizes)
    limit = (math.log(REGISTERS) + 12) / np.maximum(sizes, 1)
    least = np.full(n_sets * REGISTERS, np.inf)
    alive, time, step = np.arange(len(values)), np.zeros(len(values)), 0
    while len(alive):
        step += 1
        draw = mixed(values[alive] + mixed(np.array([step], np.uint64))[0])
        time = time - np.log(((draw >> np.uint64(16)).astype(np.float64) + 1) / 2.0 ** 48) / REGISTERS
        stay = time <= limit[owner[alive]]
        alive, time, draw = alive[stay], time[stay], draw[stay]
        register = ((draw & np.uint64(0xFFFF)) * np.uint64(REGISTERS)) >> np.uint64(16)
        np.minimum.at(least, owner[alive] * REGISTERS + register.astype(np.int64), time)
    with np.errstate(divide="ignore"):
        place = np.floor(1 - np.log(least) / math.log(BASE)) + LOWEST
    return np.clip(place, 0, 65535).astype("<u2").reshape(n_sets, REGISTERS)


def estimated(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray
              ) -> np.ndarray:
    """Likeliest similarity of pairs of sets, from their registers and sizes taken together."""
    above = (left > right).sum(axis=1)[:, None]
    below = (left < right).sum(axis=1)[:, None]
    equal = REGISTERS - above - below
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    grid = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    more, less = chance(u - v * grid), chance(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(np.maximum(p, 1e-12)), 0.0)
                 for n, p in ((above, more), (below, less), (equal, 1 - more - less))]
    best = np.argmax(sum(parts), axis=1)
    return grid[np.arange(len(grid)), best]


_PROFILE = ("id bigint, n bigint, f1 bigint, f2 bigint, sketch binary")


def _profiles(batches):
    """Sketched and passed on slice by slice, so a task never holds more than one slice's elements."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            value, first = shingle_sets(texts)
            sums = []
            for seed in (1, 2):  # a set's name: sums over its elements, in any order
                total = np.zeros(len(value) + 1, np.uint64)
                np.cumsum(mixed(value ^ mixed(np.array([seed], np.uint64))[0]), out=total[1:])
                sums.append(pa.array(signed(total[first[1:]] - total[first[:-1]])))
            flat = np.ascontiguousarray(sketches(value, first)).tobytes()
            n, width = part.num_rows, 2 * REGISTERS
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(first)), *sums,
                 pa.Array.from_buffers(pa.binary(), n, [
                     None, pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32)),
                     pa.py_buffer(flat)])],
                names=["id", "n", "f1", "f2", "sketch"])


def _registers(column) -> np.ndarray:
    return np.frombuffer(texts_of(column).data.tobytes(), "<u2").reshape(-1, REGISTERS)


def _tile_links(batches):
    """Links within tiles of groups between documents of different components.

    Candidates agree in a band and have a high enough estimate; they are confirmed here on full
    sets. Of several links between the same two components one is enough, so components that were
    joined in the tile are not compared again.
    """
    for table in whole_groups(batches, ["leader", "i", "j"]):
        table = table.combine_chunks()
        cols = {c: table[c].to_numpy() for c in ("leader", "i", "j", "block", "rep", "root", "n")}
        sketch = _registers(table["sketch"])
        body = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) \
            else table["text"]
        name = mixed(mixed(cols["leader"].view(np.uint64))
                     + (cols["i"] * (1 << 31) + cols["j"]).astype(np.uint64))
        edges = run_edges(name)
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = {c: v[lo:hi] for c, v in cols.items()}
            left = np.flatnonzero(part["block"] == part["i"][0])
            right = np.flatnonzero(part["block"] == part["j"][0])
            if len(left) == 0 or len(right) == 0 or part["root"].min() == part["root"].max():
                continue
            u, v = _links_of_tile(part, left, right, sketch[lo:hi], body.slice(lo, hi - lo))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _links_of_tile(part, left, right, sketch, body) -> tuple[list[int], list[int]]:
    values, first = shingle_sets(texts_of(body))
    known, code = np.unique(values, return_inverse=True)
    size = np.diff(first)
    mark = np.zeros(len(known), bool)
    root, rep = part["root"].copy(), part["rep"]
    same_block = part["i"][0] == part["j"][0]
    bands = sketch.reshape(len(sketch), BANDS, ROWS)
    u, v = [], []
    for x in left:
        other = right[(root[right] != root[x]) & ((rep[right] > rep[x]) | (not same_block))]
        if len(other) == 0:
            continue
        other = other[(bands[other] == bands[x]).all(axis=2).any(axis=1)]
        if len(other) == 0:
            continue
        ok = estimated(np.broadcast_to(sketch[x], (len(other), REGISTERS)), sketch[other],
                       np.full(len(other), float(part["n"][x])), part["n"][other].astype(float))
        other = other[ok >= LEAST_ESTIMATE]
        if len(other) == 0:
            continue
        mark[code[first[x]:first[x + 1]]] = True
        both = np.array([np.count_nonzero(mark[code[first[y]:first[y + 1]]]) for y in other])
        mark[code[first[x]:first[x + 1]]] = False
        linked = other[OF * both >= SHARED * (size[x] + size[other] - both)]
        for y in linked:
            if root[y] != root[x]:
                u.append(int(rep[x]))
                v.append(int(rep[y]))
                root[root == root[y]] = root[x]
    return u, v


def _confirmed(batches):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            left, l_first = shingle_sets(texts)
            right, r_first = shingle_sets(texts_of(part.column("text_v")))
            ok = np.zeros(part.num_rows, bool)
            for k in range(part.num_rows):
                a, b = left[l_first[k]:l_first[k + 1]], right[r_first[k]:r_first[k + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[k] = both > 0 and OF * both >= SHARED * (len(a) + len(b) - both)
            yield part.select(["u", "v"]).filter(pa.array(ok))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    tile: int = TILE) -> DataFrame:
    """Per document: n_shingles, component_id (smallest id reachable over links) and kept.

    Words are runs of anything but white space after lower-casing A-Z; a document's set are its
    distinct runs of five words, or its whole sequence if it has fewer. Documents are linked when
    100 * intersection >= 75 * union, confirmed on full sets.

    1. Each set gets a sketch; equal sets are one node from here on, whatever their number.
    2. Nodes that agree in all registers of a band share a bucket. At the threshold, a pair shares
       none of the bands with a chance below 1 in 10**7.
    3. A bucket's smallest node is its leader. Each node is first compared with the leader it
       shares most bands with.
    4. All nodes that share a bucket with the same leader are a group, so nodes that share any bucket
       are in a group together. Groups that still hold several components are compared in tiles of bounded
       size, each in one task. What agrees in a band and is likely is confirmed there, and only
       links between different components leave the task. So no link that matters is lost.

    Pairs are confirmed on the texts of both; no bucket, set or component is gathered on the driver.

    Null or empty texts have no shingles, link with nothing and are kept. Rows with a null id are
    returned as kept with a null component_id and link with nothing. Rows that repeat an id are
    one node, whatever their texts. An empty table gives no rows.
    """
    source = docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"),
                         F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    profiles = materialize(source.mapInArrow(_profiles, _PROFILE), "near-profiles")
    sets = materialize(
        profiles.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "near-sets")
    links = _links(source, sets, tile)
    roots = components(links)
    named = materialize(
        sets.select("f1", "f2", "rep").join(roots, sets["rep"] == roots["node"], "left")
        .select("f1", "f2", F.coalesce("root", "rep").alias("component")), "near-roots")
    full = profiles.where("n > 0 AND id IS NOT NULL").join(named, ["f1", "f2"])
    lone = profiles.where("n = 0 OR id IS NULL").withColumn("component", F.col("id"))
    return (full.select("id", "n", "component").unionByName(lone.select("id", "n", "component"))
            .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
                    F.col("component").alias("component_id"),
                    F.col("id").eqNullSafe(F.col("component")).alias("kept")))


def _links(source: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """Confirmed links between nodes that join the same components as all links do."""
    bands = sets.select("rep", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)]))
        .alias("key"))
    buckets = (bands.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("other"))
               .where("leader < other").select("key", "leader"))
    stars = materialize(
        bands.join(buckets, "key").where("rep > leader")
        .groupBy(F.col("rep").alias("u"), F.col("leader").alias("v"))
        .agg(F.count(F.lit(1)).alias("bands")), "near-stars")
    nodes = stars.select(F.col("u").alias("id")).unionByName(
        stars.select(F.col("v").alias("id"))).distinct()
    # One row per node, whatever repeats its id.
    # Texts meet their nodes in a shuffle at every size, so that the plan does not change with it.
    texts = materialize(source.join(nodes.hint("merge"), "id", "left_semi").groupBy("id")
                        .agg(F.min("text").alias("text")), "near-texts")

    best = stars.groupBy("u").agg(
        F.max(F.struct(F.col("bands"), (-F.col("v")).alias("least"))).alias("top"))
    left = texts.select(F.col("id").alias("u"), "text")
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    links = materialize(
        best.select("u", (-F.col("top.least")).alias("v")).join(left, "u").join(right, "v")
        .select("u", "v", "text", "text_v").mapInArrow(_confirmed, "u bigint, v bigint"),
        "near-links")
    roots = components(links)

    group = stars.select(F.col("v").alias("leader"), F.col("u").alias("rep")).unionByName(
        stars.select(F.col("v").alias("leader"), F.col("v").alias("rep")).distinct())
    group = group.join(roots, F.col("rep") == F.col("node"), "left").select(
        "leader", "rep", F.coalesce("root", "rep").alias("root"))
    group = materialize(group.join(sets.select("rep", "n"), "rep"), "near-groups")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n") / TILE_SHINGLES))
    split = (group.groupBy("leader")
             .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks"))
             .where("lo < hi").select("leader", "blocks"))
    spread = (group.join(split, "leader")
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
              .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
              .select("leader", F.least("block", "c").alias("i"), F.greatest("block", "c").alias("j"),
                      "block", "rep", "root", "n"))
    full = texts.join(sets.select(F.col("rep").alias("id"), "sketch"), "id")
    found = (spread.join(full, spread["rep"] == full["id"]).drop("id")
             .repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
             .mapInArrow(_tile_links, "u bigint, v bigint"))
    return links.unionByName(materialize(found, "near-links"))
