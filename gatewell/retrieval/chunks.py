"""Cutting documents into overlapping pieces for an index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 512,
                    overlap: int = 64) -> DataFrame:
    """Pieces of ``size`` characters; each starts ``overlap`` before the end of the one before.

    The last piece ends with the text, and the text is covered to its end. Map-only. The text is
    cut once into strides and the pieces are put together from neighbouring strides, so the work
    grows with the length of a text and not with its square.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    stride = size - overlap
    reach = math.ceil(size / stride)  # strides a piece extends over
    length = F.length(text)
    pieces = F.greatest(F.ceil((length - size) / F.lit(stride)), F.lit(0)) + 1
    strides = docs.where(length > 0).select(
        F.col(key), pieces.cast("int").alias("_pieces"),
        F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("_strides"))
    cut = F.transform(F.sequence(F.lit(1), F.col("_pieces")), lambda i: F.substring(
        F.array_join(F.slice("_strides", i, F.lit(reach)), ""), F.lit(1), F.lit(size)))
    return strides.select(key, F.posexplode(cut).alias("chunk_no", "text")).withColumn(
        "chunk_no", F.col("chunk_no").cast("bigint"))
