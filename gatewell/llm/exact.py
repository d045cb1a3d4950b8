"""Exact duplicates by progressive refinement: length, then a hash of the head, then the full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters beyond ASCII that a full lower-casing may change: all but those of classes without
# capitals. Characters that the running Java does not know are among them.
MAYBE_CAPITALS = (r"[\x{80}-\x{10FFFF}&&[^\p{Ll}\p{Lo}\p{Lm}\p{M}\p{Nd}\p{No}\p{P}\p{Sc}\p{Sk}"
                  r"\p{Sm}\p{Z}]]")
HEAD_CHARS = 128
# The heads that may need their full texts are kept as marks in this many slots. The broadcast of
# the marks has at most this many rows, whatever the size of the input.
SLOTS = 1 << 17


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty.

    Most texts have no other capitals; then the built-in lower-casing does just that. It is far
    faster than going through the letters one by one, which is left to the rest.
    """
    text = F.coalesce(text, F.lit(""))
    by_letter = text
    for upper, lower in zip(UPPER, LOWER):
        by_letter = F.replace(by_letter, F.lit(upper), F.lit(lower))
    return F.when(text.rlike(MAYBE_CAPITALS), by_letter).otherwise(F.lower(text))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     carry: Sequence[str] = (), head_chars: int = HEAD_CHARS,
                     slots: int = SLOTS) -> DataFrame:
    """One row per input row: ``id_column``, the ``carry`` columns, keep_id, group_size and kept.

    Rows are equal when their texts are identical after lower-casing A-Z; the row with the largest
    id stays.

    1. One scan takes the length and a hash of the first ``head_chars`` characters. Lengths that
       occur once are settled.
    2. Among the others, a pair of length and head hash that occurs once is settled.
    3. A second scan hashes whole texts, but only of rows whose pair is in a marked slot. Texts
       themselves are never shuffled: all shuffles carry lengths, hashes and ids.

    Counts are combined before each shuffle. The joins that bring group results back to the rows
    read written tables, so adaptive execution splits the part of a text with very many copies.

    Null texts count as empty. A null id never beats another one; a group of null ids only has a
    null keep_id and keeps all its rows. Rows that repeat both id and text are the same document:
    each is returned and they stay or go together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = normalised(F.col(quoted(text_column)))
    names = [id_column, *carry]

    def located(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(quoted(id_column)).alias("_id"),
            *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry)],
            F.octet_length(text).alias("_length"),
            F.xxhash64(F.substring(text, 1, head_chars)).alias("_head"),
            text.alias("_text"))

    pairs = (located(docs).groupBy("_length", "_head").agg(F.count(F.lit(1)).alias("_rows")))
    pairs = materialize(pairs, "exact-heads")
    lengths = pairs.groupBy("_length").agg(F.sum("_rows").alias("_all")).where("_all > 1")
    slot = F.pmod(F.xxhash64("_length", "_head"), F.lit(slots))
    survivors = pairs.where("_rows > 1").join(lengths, "_length", "left_semi")
    marks = survivors.select(slot.alias("_slot")).distinct().withColumn("_open", F.lit(True))

    digest = F.when(F.col("_open"), F.unhex(F.sha2("_text", 256)))
    carried = [f"_c{i}" for i in range(len(carry))]
    rows = (located(docs).withColumn("_slot", slot)
            .join(F.broadcast(marks), "_slot", "left")
            .select("_id", *carried, "_length", digest.alias("_digest")))
    rows = materialize(rows, "exact-rows")
    groups = (rows.where(F.col("_digest").isNotNull()).groupBy("_length", "_digest")
              .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
              .where("_size > 1"))
    groups = materialize(groups, "exact-groups")

    open_rows = rows.where(F.col("_digest").isNotNull()).join(groups, ["_length", "_digest"], "left")
    settled = (rows.where(F.col("_digest").isNull())
               .withColumns({"_keep": F.col("_id"), "_size": F.lit(1).cast("bigint")}))
    wanted = ["_id", *carried, "_keep", "_size"]
    both = open_rows.select(*wanted).unionByName(settled.select(*wanted))
    size = F.coalesce("_size", F.lit(1).cast("bigint"))
    keep = F.when(size > 1, F.col("_keep")).otherwise(F.col("_id"))
    return both.select(
        *[F.col(c).alias(n) for c, n in zip(["_id", *carried], names)],
        keep.alias("keep_id"), size.alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"))
