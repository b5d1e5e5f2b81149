"""The operators over the driver tables, with production parameters and the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemend.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    def call(spark: SparkSession, folder: str) -> DataFrame:
        return run(prepare(spark), folder)

    call.__name__, call.__doc__ = run.__name__, run.__doc__
    QUERIES[run.__name__] = call
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_best_fit_packing(spark, folder):
    """Pieces of all documents in sequences of at most 4096 tokens."""
    from treemend.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_path())


@query
def op5_secret_scans(spark, folder):
    """Secrets in every whole text of documents."""
    from treemend.llm.secrets import secret_report

    return secret_report(table(spark, folder, "documents"))


@query
def op9_source_mix(spark, folder):
    """All documents mixed to target weights of their sources."""
    from treemend.llm.mixing import mix_report

    return mix_report(table(spark, folder, "documents"))


@query
def op3_simhash_near_dedup(spark, folder):
    """Near-duplicate components of all documents."""
    from treemend.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query
def op7_language_id(spark, folder):
    """The language of every whole text of documents, learned outside the held-out fold."""
    from treemend.llm.common import held_out, learnable
    from treemend.llm.langid import fit_languages, language_column

    docs = table(spark, folder, "documents")
    predict = language_column(fit_languages(docs.where(learnable(docs.doc_id)).select("lang", "text")))
    scored = docs.select("doc_id", held_out(docs.doc_id).alias("held_out"), predict(docs.text).alias("_p"))
    return scored.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), "_p.score", "_p.rejected")


@query
def op2_quality_classifier(spark, folder):
    """Quality scores of every whole text of documents, learned from labels outside the held-out fold."""
    from treemend.llm.common import held_out, learnable
    from treemend.llm.quality import score_quality

    scored = score_quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"), learnable)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_exact_top_k(spark, folder):
    """The 5 highest integer inner products of every 50th vector against all others."""
    from treemend.llm.topk import top_k

    return top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


@query
def op10_nearest_neighbours(spark, folder):
    """The 20 nearest vectors found for every 20th vector."""
    from treemend.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


# The test tables carry no crawl days and no list. Both come from the pages: a page's day from its number, and a
# list whose keys are the pages' own domains and paths, added and dropped on days drawn from the key's hash.
_DAYS = 730
_START = "2023-01-01"


def _drawn(key: str, at: int) -> str:
    """Two bytes of the key's MD5 as a number, in Spark SQL."""
    return f"cast(conv(substr(md5({key}), {at}, 4), 16, 10) as int)"


def dated_list(pages):
    """key, category, day, action: about an eighth of all domains and path prefixes, up to three changes each."""
    from treemend.llm.urls import host_of, keys_of, path_of

    keys = pages.select(F.explode(keys_of(host_of(F.col("url")), path_of(F.col("url")))).alias("key")).distinct()
    listed = keys.where(f"{_drawn('key', 1)} % 8 = 0").withColumn("category", F.when(F.instr("key", "/") > 0, "path").otherwise("domain"))
    steps = F.expr("explode(array(named_struct('i', 5, 'a', 'add'), named_struct('i', 9, 'a', 'drop'), named_struct('i', 13, 'a', 'add')))")
    day = f"date_add(date'{_START}', {_drawn('key', 'cast(s.i as int)')} % {_DAYS})"
    return listed.withColumn("s", steps).select("key", "category", F.expr(day).alias("day"), F.col("s.a").alias("action"))


@query
def op8_url_filters(spark, folder):
    """Every page's URL judged against the list entries active on its fetch day."""
    from treemend.llm.urls import filter_urls

    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(f"date_add(date'{_START}', cast(pmod(page_id * 37, {_DAYS}) as int))"))
    judged = filter_urls(captures, dated_list(pages))
    return judged.select("row.page_id", "row.url", F.col("row.fetched").alias("fetched"), F.col("n_hits").cast("int").alias("n_hits"), "reasons", "blocked")


_KEYS = r"""
    SELECT url, unnest(list_distinct(list_concat(
        list_transform(generate_series(1, greatest(1, len(labels) - 1)), lambda i: array_to_string(labels[i:], '.')),
        CASE WHEN path = '' THEN [] ELSE list_transform(generate_series(1, least(len(segments), 3)), lambda i: host || '/' || array_to_string(segments[1:i], '/')) END
    ))) AS key
    FROM (
        SELECT url, host, path, string_split(host, '.') AS labels, string_split_regex(path, '/+') AS segments
        FROM (
            SELECT DISTINCT url,
                lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::\d*)?(?:[/?#]|$)', 1)) AS host,
                regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path
            FROM pages WHERE url IS NOT NULL
        ) WHERE host <> ''
    )"""
ORACLES["op8_url_filters"] = f"""
WITH keys AS MATERIALIZED ({_KEYS}),
events AS (
    SELECT key, category, day, max(action) AS action FROM (
        SELECT key, CASE WHEN contains(key, '/') THEN 'path' ELSE 'domain' END AS category, s.a AS action,
            DATE '{_START}' + CAST(CAST('0x' || substr(md5(key), s.i, 4) AS INTEGER) % {_DAYS} AS INTEGER) AS day
        FROM (SELECT DISTINCT key FROM keys), (SELECT unnest([{{'i': 5, 'a': 'add'}}, {{'i': 9, 'a': 'drop'}}, {{'i': 13, 'a': 'add'}}]) AS s)
        WHERE CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) % 8 = 0
    ) GROUP BY key, category, day
),
changes AS (
    SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY key, category ORDER BY day) AS was FROM events)
    WHERE action <> coalesce(was, 'drop')
),
spans AS (
    SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS upto FROM changes) WHERE action = 'add'
),
captures AS (SELECT page_id, url, DATE '{_START}' + CAST((page_id * 37) % {_DAYS} AS INTEGER) AS fetched FROM pages),
hits AS (
    SELECT c.url, c.fetched, count(DISTINCT s.category || ':' || s.key) AS n,
        array_to_string(list_sort(list(DISTINCT s.category || ':' || s.key)), ',') AS reasons
    FROM (SELECT DISTINCT url, fetched FROM captures) c JOIN keys USING (url) JOIN spans s USING (key)
    WHERE s.day <= c.fetched AND (s.upto IS NULL OR c.fetched < s.upto)
    GROUP BY c.url, c.fetched
)
SELECT page_id, url, fetched, CAST(coalesce(n, 0) AS INTEGER) AS n_hits, coalesce(reasons, '') AS reasons, n IS NOT NULL AS blocked
FROM captures LEFT JOIN hits USING (url, fetched)
"""


@query
def op6_substring_dedup(spark, folder):
    """All documents without the words of 35-word windows that occur elsewhere."""
    from treemend.llm.substrings import remove_repeats

    return remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op13_tokenizer_alignment(spark, folder):
    """The byte-level and the piece tokenizer aligned over every whole text of documents."""
    import public_tokenizers

    from treemend.llm.alignment import alignment_report

    return alignment_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_license_scans(spark, folder):
    """Licence phrases and templates in every whole text of documents."""
    from treemend.llm.licenses import license_spans

    return license_spans(table(spark, folder, "documents")).drop("spans")


@query
def op11_source_divergence(spark, folder):
    """Distances between the term shares of all sources of a language, and the terms each source has most in excess."""
    from treemend.llm.divergence import divergence

    return divergence(table(spark, folder, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS MATERIALIZED (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
tokens AS MATERIALIZED (SELECT lang, source, id, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
sources AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept k USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS MATERIALIZED (
    SELECT s.lang, s.source, k.term, c.n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
    FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(max(f.value), 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
    ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    GROUP BY a.lang, a.source, b.source
),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
) WHERE rank <= 200
"""
