"""Personal data by patterns, and terms that reveal it by how often they occur beside it.

All of it is column expressions, grouping and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.session import materialize

# What may stand in the local part of an address.
_LOCAL = "A-Za-z0-9._%+-"
_HOST = "A-Za-z0-9-"
# Patterns of the kinds, in the order in which spans are listed. A run is taken whole and without
# backtracking, from its first character or from where the last match ended. That finds the same
# as trying every start, in one pass over the text and without recursion.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",   # shorter runs never pass
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without this string has no match of the kind.
NEEDED = {"email": "@", "phone": "+", "ip": "."}
TERM = "term"
KINDS = [*PATTERNS, TERM]

_LETTER = r"A-Za-z\x{80}-\x{10FFFF}"
TERM_PATTERN = rf"(?<![0-9{_LETTER}])[{_LETTER}]{{4,}}+(?![0-9])"
WORD_PATTERN = rf"[^{_LETTER}]+"


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as revealing an entity."""

    reach: int = 80            # characters to either side of a mention
    least_documents: int = 2   # with the term beside the entity
    share: float = 0.5         # of the documents with the term, more than this have it there
    bits: float = 3.0          # pointwise mutual information with the entity


DISCLOSURE = Disclosure()


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points, end exclusive."""
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc, k):
        end = acc["at"] + F.length(values[k])
        found = F.struct(acc["at"].alias("start"), end.alias("end"), values[k].alias("value"))
        return F.struct((end + F.length(between[k + 1])).alias("at"),
                        F.concat(acc["found"], F.array(found)).alias("found"))
    return F.when(F.size(values) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(values) - 1),
        F.struct(F.length(between[0]).alias("at"), empty.alias("found")), step,
        lambda acc: acc["found"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, less 9 if that has two digits."""
    def weight(digit, k):
        doubled = digit.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)
    parts = F.transform(F.split(F.reverse(digits), ""), weight)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return value.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _of_kind(text: Column, number: int, kind: str, pattern: str) -> Column:
    present = text.rlike(pattern)
    if kind in NEEDED:
        present = text.contains(NEEDED[kind]) & present
    spans = F.filter(located(text, pattern), lambda m: _valid(kind, m["value"]))
    return F.when(present, F.transform(spans, lambda m: F.struct(
        F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        m["value"].alias("value"))))


def base_spans(text: Column) -> Column:
    """All valid matches of all kinds: (kind, start, end, value), by kind and start."""
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return F.concat(*[F.coalesce(_of_kind(text, number, kind, pattern), empty)
                      for number, (kind, pattern) in enumerate(PATTERNS.items())])


def _count(number: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{kind}")


def _beside(text: Column, span: Column, base: Column, reach: int) -> Column:
    """Terms beside a span, outside all spans: (term, start, end)."""
    left_at = F.greatest(span["start"] - reach, F.lit(0))
    left = F.substr(text, left_at + 1, span["start"] - left_at)
    right = F.substr(text, span["end"] + 1, F.lit(reach))

    def shifted(context, offset, cut_first, cut_last):
        # A term at the outer edge of the context may be cut short.
        whole = F.filter(located(context, TERM_PATTERN), lambda m: ~(
            (cut_first & (m["start"] == 0)) | (cut_last & (m["end"] == F.length(context)))))
        return F.transform(whole, lambda m: F.struct(
            F.lower(m["value"]).alias("term"), (m["start"] + offset).alias("start"),
            (m["end"] + offset).alias("end")))
    terms = F.concat(shifted(left, left_at, left_at > 0, F.lit(False)),
                     shifted(right, span["end"], F.lit(False), F.length(right) == reach))
    return F.filter(terms, lambda t: ~F.exists(
        base, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))


def _held(text: Column) -> Column:
    """All terms of a text in lower case, their lengths, and the lengths of what lies between."""
    terms = F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0))
    return F.struct(F.transform(terms, F.lower).alias("terms"),
                    F.transform(terms, F.length).alias("sizes"),
                    F.transform(F.split(text, TERM_PATTERN, -1), F.length).alias("gaps"))


def _places(held: Column, terms: Column, base: Column) -> Column:
    """Where these terms stand, outside all spans: (kind, start, end)."""
    def summed(lengths, n):
        return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x)

    def place(k):
        start = summed(held["gaps"], k + 1) + summed(held["sizes"], k)
        return F.struct(F.lit(KINDS.index(TERM)).alias("kind"), start.alias("start"),
                        (start + F.get(held["sizes"], k)).alias("end"))
    numbers = F.transform(held["terms"], lambda t, k: F.when(F.array_contains(terms, t), k))
    return F.filter(F.transform(F.array_compact(numbers), place), lambda t: ~F.exists(
        base, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  disclosure: Disclosure = DISCLOSURE) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_spans and spans ("kind:start:end", ...).

    The patterns find addresses, IP numbers, card numbers and phone numbers; matches that fail
    their test are dropped. Each value found is a protected entity. A term (four letters or more,
    in lower case) within ``reach`` characters of a mention reveals the entity if at least
    ``least_documents`` documents have it there, if these are more than ``share`` of all documents
    that have the term anywhere, and if its mutual information with the entity is at least
    ``bits``. All its places in documents that mention the entity are spans of kind "term".

    Document counts of terms are taken over all documents and combined before each shuffle. A term
    can pass with several entities, so every pair of a term and an entity is tested. Texts are
    never shuffled.

    Null and empty texts have no spans. Rows with a null or repeated id are judged by their own
    text; rows that repeat both are one document in the counts. An empty table gives no rows.
    """
    ident, text = F.col(quoted(id_column)), F.col("body")
    body = docs.select(ident.alias("id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("body"))
    found = (body.withColumn("base", base_spans(text))
             .withColumn("key", F.xxhash64("id", "body")))
    mentions = F.transform("base", lambda s: F.struct(
        F.xxhash64(s["kind"], F.lower(s["value"])).alias("entity"),
        _beside(text, s, F.col("base"), disclosure.reach).alias("beside")))
    rows = materialize(found.select(
        "id", "key", "base", F.when(F.size("base") > 0, mentions).alias("mentions"),
        F.when(F.size("base") > 0, _held(text)).alias("held")), "private-rows")

    beside = (rows.where("mentions IS NOT NULL").select("key", F.explode("mentions").alias("m"))
              .select("key", "m.entity", F.explode("m.beside").alias("t"))
              .select("key", "entity", "t.term", "t.start", "t.end"))
    revealing = materialize(_revealing(body, rows, beside, disclosure), "private-terms")
    places = (beside.join(revealing, ["term", "entity"])
              .groupBy("key").agg(F.collect_set(F.struct(
                  F.lit(KINDS.index(TERM)).alias("kind"), "start", "end")).alias("near")))
    # Beyond the reach, the terms are looked for in the documents that mention the entity.
    told = (rows.where("mentions IS NOT NULL")
            .select("key", F.explode(F.array_distinct("mentions.entity")).alias("entity"))
            .join(revealing, "entity").groupBy("key").agg(F.collect_set("term").alias("told")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base = F.transform("base", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    terms = F.array_union(F.coalesce("near", none), F.coalesce(
        F.when(F.col("told").isNotNull(), _places(F.col("held"), F.col("told"), F.col("base"))), none))
    every = F.concat(base, F.array_sort(terms))
    counts = [_count(number, kind) for number, kind in enumerate(PATTERNS)]
    return (rows.drop("mentions").join(places, "key", "left").join(told, "key", "left")
            .select(F.col("id").alias(id_column), *counts, _listed(F.col("base")).alias("base_spans"),
                    _listed(every).alias("spans")))


def _revealing(body: DataFrame, rows: DataFrame, beside: DataFrame, d: Disclosure) -> DataFrame:
    """(term, entity) pairs that pass the disclosure test."""
    together = (beside.select("term", "entity", "key").distinct().groupBy("term", "entity")
                .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= d.least_documents))
    words = F.array_distinct(F.split(F.lower("body"), WORD_PATTERN))
    everywhere = (body.select(F.explode(words).alias("term")).where(F.length("term") >= 4)
                  .groupBy("term").agg(F.count(F.lit(1)).alias("documents")))
    entities = (rows.where("mentions IS NOT NULL").select("key", F.explode("mentions.entity").alias("entity"))
                .distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("mentioned")))
    total = rows.count()
    share = F.col("n") / F.greatest("documents", "n")
    return (together.join(everywhere, "term").join(entities, "entity")
            .where((share > d.share)
                   & (F.log2(share * total / F.col("mentioned")) >= d.bits))
            .select("term", "entity"))


def sanitised(text: Column, spans: Column, replacement: str = "[private]") -> Column:
    """The text with its spans (structs with start and end, any order) replaced; overlaps merge."""
    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        kept = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], kept, F.lit(replacement)))
                        .otherwise(acc["out"]).alias("out"))
    return F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"),
                                                           s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
