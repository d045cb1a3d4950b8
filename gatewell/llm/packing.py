"""Best-fit packing of token sequences: best-two-fit over the histogram of lengths.

Pieces of one length are interchangeable, so the bins can be planned on how many pieces there are of
each length. That histogram has at most ``capacity`` entries whatever the number of documents; it
is the only thing the driver sees. The plan is a list of bin patterns with how often each is used,
and the pieces find their places by their rank among those of their length.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gatewell.functions import quoted
from gatewell.llm.textcode import NON_SPACE, Texts, ranges_hashes, slices
from gatewell.session import materialize

CAPACITY = 2048
END_ID = 0
CACHE_ENTRIES = 500_000
RANK_ROWS = 50_000
_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bucket", pa.int64())])
_PIECES_SQL = ("id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bucket bigint")


class TokenCoder:
    """Token ids of texts.

    A byte-level tokenizer of this kind splits before every space that is followed by anything but
    white space, so what lies between such places has the same ids in every text. Those units are
    told apart by a hash, their ids are kept in a table of bounded size, and only units that are
    new are encoded.

    The vocabulary is read from the file of the ``tokenizers`` library, whose ids they are. Units are
    encoded by ``tiktoken`` over that vocabulary, which gives the same ids in less time; very long
    units go to ``tokenizers`` itself.
    """

    LONG_UNIT = 400

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        place = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(place[c] for c in token): number
                 for token, number in content["model"]["vocab"].items() if token not in special}
        self._line = ranks[b"\n"]
        self._coder = tiktoken.Encoding(
            "units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._entries = entries
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._pool = [np.zeros(0, np.uint32)]
        self._places = [np.zeros((0, 2), np.int64)]  # where a unit's ids are in the pool, how many
        self._used = 0

    def _learn(self, names: list[int], units: list[bytes]) -> None:
        """Add the ids of new units to the pool.

        Those without a line break are put into one text with line breaks between them: a break
        before a space is a token of its own, so it shows where the next unit begins.
        """
        plain, other = [], []
        for k, unit in enumerate(units):
            alone = unit[:1] != b" " or len(unit) > self.LONG_UNIT or b"\n" in unit
            (other if alone else plain).append(k)
        if plain:
            joined = b"\n".join([units[k] for k in plain]).decode()
            ids = np.array(self._coder.encode_ordinary(joined), dtype=np.uint32)
            breaks = np.flatnonzero(ids == self._line)
            begin = np.concatenate(([0], breaks + 1))
            self._add([names[k] for k in plain], ids, begin, np.append(breaks, len(ids)) - begin)
        if other:
            found = [self._coder.encode_ordinary(units[k].decode())
                     if len(units[k]) <= self.LONG_UNIT else
                     self._tokenizer.encode(units[k].decode(), add_special_tokens=False).ids
                     for k in other]
            size = np.array([len(f) for f in found], np.int64)
            ids = np.array(list(chain.from_iterable(found)), dtype=np.uint32)
            self._add([names[k] for k in other], ids, np.cumsum(size) - size, size)

    def _add(self, names: list[int], ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        count = len(self._known)
        self._known.update(zip(names, range(count, count + len(names))))
        self._pool.append(ids)
        self._places.append(np.stack([begin + self._used, size], axis=1))
        self._used += len(ids)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        if len(self._known) > self._entries:
            self._forget()
        begin, end = _units(texts)
        hashes = ranges_hashes(texts.data, begin, end)
        names, at, code = np.unique(hashes, return_index=True, return_inverse=True)
        names = names.tolist()
        known = self._known
        new = [k for k, name in enumerate(names) if name not in known]
        body = texts.data.tobytes()
        for k in range(0, len(new), 5000):
            some = new[k:k + 5000]
            self._learn([names[i] for i in some], [body[begin[at[i]]:end[at[i]]] for i in some])
        if len(names) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        self._pool = [np.concatenate(self._pool)]
        self._places = [np.concatenate(self._places)]
        place = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        first, size = self._places[0][place[code]].T
        ends = np.cumsum(size)
        ids = self._pool[0][np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]
        bounds = np.concatenate(([0], ends))[np.searchsorted(begin, texts.bounds)]
        return ids, bounds


# First bytes of all characters beyond ASCII that are white space, and of some that are not.
_MAYBE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)


def _units(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    data, n = texts.data, len(texts.data)
    solid = NON_SPACE.copy()
    solid[list(_MAYBE_SPACE)] = False
    solid[0x1C:0x20] = False
    cut = np.zeros(n + 1, bool)
    cut[:n - 1] = (data[:-1] == 0x20) & solid[data[1:]] if n else False
    ends = texts.bounds[1:]
    cut[ends[ends > 0] - 1] = False  # a space at the end of a text, whatever the next text is
    cut[texts.bounds[:-1]] = True
    cut[n] = False
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], n)
    return begin[end > begin], end[end > begin]


# How the tokenizer splits a text before it merges bytes (a fixed value of its vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_coders: dict[str, TokenCoder] = {}


def coder(path: str) -> TokenCoder:
    if path not in _coders:
        _coders[path] = TokenCoder(path)
    return _coders[path]


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a sequence; only the first may be shorter than the rest."""
    first = total - capacity * (-(-total // capacity) - 1)
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, id_column: str, text_column: str,
                 capacity: int, buckets: int) -> DataFrame:
    def rows_of(batches):
        encode = coder(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for part, texts in slices(batch, "text"):
                ids, bounds = encode(texts)
                for k, ident in enumerate(part.column("id").to_pylist()):
                    coded = ids[bounds[k]:bounds[k + 1]].astype("<u4").tobytes() + end
                    for piece, (start, length) in enumerate(cuts(len(coded) // 4, capacity)):
                        crc = zlib.crc32(coded[4 * start:4 * (start + length)])
                        rows.append((ident, piece, start, length, crc, crc % buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows), _PIECES)] if rows else
                [pa.array([], t.type) for t in _PIECES], schema=_PIECES)
    return (docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"),
                        F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
            .mapInArrow(rows_of, _PIECES_SQL))


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, how many bins) for ``counts[length]`` pieces of each length.

    A bin starts with the longest piece left and takes the longest that still fits, again and
    again. Then its smallest piece is given back if two unpacked pieces fill the room it leaves
    more tightly. The same pattern is used as often as the counts allow, so that the number of
    patterns depends on the number of lengths, not of pieces.
    """
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    patterns: list[tuple[list[int], int]] = []
    while True:
        present = np.flatnonzero(left)
        if len(present) == 0:
            return patterns
        used: dict[int, int] = {}
        room = capacity
        spare = left.copy()
        while room > 0:
            fits = np.flatnonzero(spare[:room + 1])
            if len(fits) == 0:
                break
            longest = int(fits[-1])
            take = min(room // longest, int(spare[longest]))
            used[longest] = used.get(longest, 0) + take
            spare[longest] -= take
            room -= take * longest
        smallest = min(used)
        if room and len(used) + used[smallest] > 2:
            pair = _closest_pair(spare, smallest, smallest + room)
            if pair:
                used[smallest] -= 1
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        used = {length: n for length, n in used.items() if n}
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        patterns.append(([length for length in sorted(used, reverse=True)
                          for _ in range(used[length])], times))


def _closest_pair(spare: np.ndarray, above: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over ``above`` and at most ``room``."""
    present = np.flatnonzero(spare[:room])
    if len(present) == 0:
        return None
    at = np.searchsorted(present, room - present, side="right") - 1
    ok = at >= 0
    first, second = present[ok], present[at[ok]]
    lone = (first == second) & (spare[first] < 2)
    # A single piece cannot be taken twice; its next smaller partner may do.
    at = np.where(lone, at[ok] - 1, at[ok])
    first, at = first[at >= 0], at[at >= 0]
    if len(first) == 0:
        return None
    total = first + present[at]
    best = int(np.argmax(total))
    return (int(first[best]), int(present[at[best]])) if total[best] > above else None


def _places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length and place in a pattern: the ranks that go there, and to which sequences."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, rank + times, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    return rows


def best_fit_packing(docs: DataFrame, tokenizer: str, id_column: str = "doc_id",
                     text_column: str = "text", capacity: int = CAPACITY,
                     buckets: int | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    A document's ids are those of the tokenizer file, then id 0. Only documents of more than
    ``capacity`` ids are cut. Pieces are numbered from 0; sequences are filled without gaps.

    Ranks within a length are taken in buckets by a checksum of the piece's ids and the buckets'
    counts are summed up, so a length that very many pieces share is not sorted in one task. The
    pieces of many equal documents share checksum and length; a running number in the written
    table spreads them.

    Null and empty texts are the end id alone. Rows with a null or repeated id are packed as any
    other row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer, id_column, text_column, capacity, 1 << 30)
    pieces = materialize(
        pieces.withColumn("number", F.monotonically_increasing_id()), "packing-pieces")
    if buckets is None:
        buckets = max(8, pieces.count() // RANK_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = _places(best_two_fit(counts))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    ranked = (pieces.withColumn("rank", F.row_number().over(
                  Window.partitionBy("length", "bucket").orderBy("number")) - 1)
              .join(sizes.select("length", "bucket", before.alias("before")), ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("before")))
    return _placed(spark, ranked, places, id_column)


def _placed(spark, ranked: DataFrame, places: list[tuple], id_column: str) -> DataFrame:
    """Look up each rank in the plan. The plan's size depends on the capacity alone."""
    table = np.array(places, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    plan = spark.sparkContext.broadcast(table)
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    schema = _PIECES_SQL.rsplit(",", 1)[0] + ", sequence_id bigint, offset bigint"

    def rows_of(batches):
        lengths, first, _, sequence, offset = plan.value.T
        # Length and rank as one number; ranks stay below 2**48.
        order = (lengths << 48) | first
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            wanted = (batch.column("length").to_numpy().astype(np.int64) << 48) | rank
            at = np.searchsorted(order, wanted, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(rows_of, schema).withColumnRenamed(
        "id", id_column)
