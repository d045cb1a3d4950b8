"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.llm.chunks import chunk_dedup
from gatewell.llm.contamination import contaminated
from gatewell.llm.exact import exact_duplicates, normalised
from gatewell.llm.fragments import ngram_join
from gatewell.llm.licenses import license_scan
from gatewell.llm.near import near_duplicates
from gatewell.llm.ngram_lm import ORDER, backoff_scores
from gatewell.llm.packing import best_fit_packing
from gatewell.llm.periods import periodic_runs
from gatewell.llm.quality import quality_scores
from gatewell.llm.ranked import ranked_search
from gatewell.llm.sanitise import private_spans
from gatewell.llm.shipping import ship
from gatewell.llm.suffixes import suffix_dedup
from gatewell.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(function):
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(load(spark, folder, "documents"), load(spark, folder, "labels"),
                          keep=["doc_id"]).withColumnRenamed("accepted", "kept")


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return exact_duplicates(docs, carry=["text_sha256"])


SQL["op2_exact_dedup"] = """
    WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM texts WINDOW w AS (PARTITION BY body)"""


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(load(spark, folder, "documents").select("doc_id", "text"),
                         load(spark, folder, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing(load(spark, folder, "documents").select("doc_id", "text"),
                            vocabulary("byte_bpe_50k.json"))


@query
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(load(spark, folder, "documents").select("doc_id", "text"))


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(load(spark, folder, "documents").select("doc_id", "text"))


@query
def op10_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup(load(spark, folder, "documents").select("doc_id", "text"))


@query
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(load(spark, folder, "documents").select("doc_id", "text"))


@query
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_scores(load(spark, folder, "documents").select("doc_id", "text"), order=ORDER)


@query
def op7_private(spark: SparkSession, folder: str) -> DataFrame:
    found = private_spans(load(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _rewound(docs: DataFrame) -> DataFrame:
    """One document in ten, by the checksum of its id, repeats a part of itself up to its end.

    The words of such a text are joined by one space; the others stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    docs = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(
        h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("words"))
    docs = docs.withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    again = F.expr("flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) AS int)))")
    whole = F.slice(F.concat(F.expr("slice(words, 1, a)"), again), F.lit(1), F.col("n"))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " "))
                       .otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(_rewound(load(spark, folder, "documents").select("doc_id", "text")))
    first = F.expr("""aggregate(runs, cast(null AS struct<start: bigint, length: bigint,
        period: bigint>), (best, r) -> if(best IS NULL OR r.length * best.period >
        best.length * r.period, r, best))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, "
                   "'\n')), '')")
    found = found.withColumn("top", first)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length",
        "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# The checksum is worked out bit by bit; -1 stands for a step by one bit.
SQL["op12_periodic_runs"] = r"""
    WITH marks AS (
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(doc_id::VARCHAR, ''),
            lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda s, x: CASE WHEN x >= 0 THEN xor(s, x)
                ELSE xor(s >> 1, 3988292384::BIGINT * (s & 1)) END), 4294967295::BIGINT) AS h,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS given
        FROM documents),
    places AS (SELECT *, h // 10 AS g, len(given) AS n, (h // 10) % len(given) AS a FROM marks),
    steps AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places),
    words AS (
        SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN given[a + (i - a) % p + 1]
            ELSE given[i + 1] END AS word, n
        FROM (SELECT *, unnest(range(n)) AS i FROM steps)),
    equal AS (
        SELECT l.doc_id, l.i, r.i - l.i AS q,
            l.i - row_number() OVER (PARTITION BY l.doc_id, r.i - l.i ORDER BY l.i) AS island
        FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.word = r.word AND l.i < r.i
            AND 4 * (r.i - l.i) <= l.n),
    stretches AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length
        FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (
        SELECT doc_id, start, length, q AS period FROM stretches s WHERE NOT EXISTS (
            SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q
                AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
    tops AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period
                || chr(10), '' ORDER BY start, period) AS lines,
            first(struct_pack(start := start, length := length, period := period)
                ORDER BY length::DOUBLE / period DESC, start, period) AS top
        FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body
        FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length,
        top.period AS period, 1000 * top.length // top.period AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
    FROM documents LEFT JOIN tops USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(load(spark, folder, "documents").select("doc_id", "text"),
                         load(spark, folder, "benchmark").select("item_id", "text"))


SQL["op11_ranked_search"] = r"""
    WITH given AS (
        SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(
            coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    totals AS (SELECT count(*) AS total, sum(len(terms))::BIGINT AS mass
               FROM given WHERE len(terms) > 0),
    asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        GROUP BY item_id, term),
    held AS (
        SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM given)
        WHERE term IN (SELECT term FROM asked) GROUP BY place, term),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT
                    AS w FROM held, totals GROUP BY term),
    spread AS (SELECT place, doc_id, 100 - 25 + (25 * len(terms) * total) // mass AS m
               FROM given, totals),
    scored AS (
        SELECT item_id, place, doc_id,
            sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN spread USING (place)
        GROUP BY item_id, place, doc_id),
    ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id
            ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20"""


@query
def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(load(spark, folder, "documents").select("doc_id", "text"))


# The smallest id is handed on along links until nothing changes.
SQL["op13_ngram_join"] = r"""
    WITH RECURSIVE given AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
            WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(len(words) - 2),
                lambda i: array_to_string(words[i + 1:i + 3], ' ')) END) AS gram FROM given),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS u, b.doc_id AS v
        FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
        JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id
        HAVING 100 * count(*) >= 90 * (any_value(s.n) + any_value(t.n) - count(*))),
    reach AS (
        SELECT doc_id AS id, doc_id AS other FROM given
        UNION SELECT id, v FROM reach JOIN links ON u = other)
    SELECT g.doc_id, coalesce(s.n, 0) AS n_shingles, r.least AS component_id
    FROM given g JOIN (SELECT id, min(other) AS least FROM reach GROUP BY id) r ON r.id = g.doc_id
    LEFT JOIN sizes s ON s.doc_id = g.doc_id"""
