"""One query for each operator, over its whole table with production parameters, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table over as many partitions as there are cores, if it has fewer row groups: small tables lie in one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest

    return digest(dealt(table(spark, sf_dir, "documents")), vocabulary_file("piece_bpe_32k.model"), n=4)


@query
def op2_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitpack import read_shards, write_shards

    manifest = write_shards(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), vocabulary=49_408, end_id=1, cuts="word")
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_packages, write_packages

    return read_packages(write_packages(table(spark, sf_dir, "pages"), least=0))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(dealt(table(spark, sf_dir, "documents")))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(dealt(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "severity", "host_rate", "host_verdict")


@query
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_neighbours, with_groups

    docs = table(spark, sf_dir, "documents")
    return with_groups(docs, compare_neighbours(docs))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, labelled_urls, train

    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(dealt(table(spark, sf_dir, "documents")))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    cut = pieces(dealt(table(spark, sf_dir, "documents")), vocabulary_file("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return pack(cut, capacity=2048)


@query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import clusters

    return clusters(dealt(table(spark, sf_dir, "documents")), k=4, num=85, den=100)


@query
def op10_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; all links are found for it."""
    from .jaccard import join

    return join(dealt(table(spark, sf_dir, "documents")), k=4, num=85, den=100)[1]


#: Base 32 of a SHA-1: four letters for each five hex digits.
_FIVE = "CAST('0x' || substr(s, 5 * k + 1, 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} >> {b}) & 31 AS INTEGER) + 1, 1)"
_FOUR = " || ".join(_LETTER.format(v=_FIVE, b=b) for b in (15, 10, 5, 0))

ORACLE_SQL["op3_warc"] = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {" || ".join("(" + _FOUR.replace("5 * k + 1", str(5 * k + 1)) + ")" for k in range(8))} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  coalesce(nullif(url, ''), 'urn:page:' || CAST(page_id AS VARCHAR)) AS url
FROM d"""

ORACLE_SQL["op10_jaccard"] = """WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM t WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS gram FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 85 * (a.n + b.n - m)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT t.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(min(r.y), t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN r ON r.x = t.doc_id GROUP BY t.doc_id"""
