"""Ranked keyword search over a document table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gatewell.operators.ranking import top_per_group
from gatewell.session import materialize


def terms_of(query: str) -> list[str]:
    """Words are runs of letters in any script."""
    return sorted({t for t in re.split(r"[\W\d_]+", query.lower()) if t})


def words_wanted(queries: Sequence[str]) -> tuple[dict[str, list[str]], list[str]]:
    """The words of each query, and all of them."""
    wanted = {q: terms_of(q) for q in queries if terms_of(q)}
    words = sorted({t for terms in wanted.values() for t in terms})
    if not words:
        raise ValueError("no words in the queries")
    return wanted, words


def keyword_search(docs: DataFrame, key: str, text: str, queries: Sequence[str],
                   top: int = 10) -> DataFrame:
    """The best documents per query by the sum of tf * ln(N / df) over its words.

    Queries are a short list given by the caller. One pattern finds all their words, and no text
    is shuffled, only counts and the best rows per query and task.
    """
    wanted, words = words_wanted(queries)
    # A word counts where no letter stands before or after it.
    pattern = r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"
    hits = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    found = docs.select(F.col(key), F.explode(hits).alias("_word"))
    # Stored, so that the texts are read once: how often each query word occurs, per document. The
    # words of a document meet in its own task, so one row per document is shuffled.
    counts = materialize(found.groupBy(key).agg(*[
        F.count_if(F.col("_word") == w).alias(f"tf{i}") for i, w in enumerate(words)]), "search")
    return ranked(counts, docs.count(), wanted, words, key, top)


def ranked(counts: DataFrame, total: int, wanted: dict[str, list[str]], words: list[str], key: str,
           top: int) -> DataFrame:
    """The best documents per query, from how often each word occurs in a document (tf0, tf1, ...)."""
    # One row: in how many documents each query word occurs.
    frequency = counts.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(words))]).first()
    per_word = {w: (total, frequency[i]) for i, w in enumerate(words)}

    def score(terms: list[str]):
        parts = [F.col(f"tf{words.index(t)}").cast("double")
                 * F.log(F.lit(float(per_word[t][0])) / F.lit(float(per_word[t][1])))
                 for t in terms if per_word[t][1] > 0]
        return F.round(sum(parts[1:], parts[0]), 6) if parts else F.lit(0.0)

    def occurrences(terms: list[str]):
        found = [F.col(f"tf{words.index(t)}") for t in terms]
        return sum(found[1:], found[0])

    rows = [F.struct(F.lit(q).alias("query"), occurrences(terms).alias("hits"),
                     score(terms).alias("score")) for q, terms in wanted.items()]
    scored = counts.select(key, F.inline(F.array(*rows))).where("hits > 0")
    return top_per_group(scored, ["query"], [F.col("score").desc(), F.col(key).asc()], top, "rank")
