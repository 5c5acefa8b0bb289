"""One query per operator over its whole table, and the SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, decontaminate, fill_middle, language_model, near_dedup, pii, quality, substring_dedup, suffix_dedup, toxicity, warc
from .text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function=None, *, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add(function) if function else add


def tokenizer(name: str) -> str:
    """Where the file of a public tokenizer lies."""
    import public_tokenizers  # only these queries need it

    return public_tokenizers.path(name)


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# Windows of 35 words as text; a word goes if a window over it occurs twice.
_PASSAGES = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, s, array_to_string(w[s : s + 34], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
twice AS (SELECT t FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT r, list_distinct(flatten(list(range(s, s + 35)))) AS g FROM windows JOIN twice USING (t) GROUP BY 1),
kept AS (SELECT doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""


@query(sql=_PASSAGES)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


# Base32 by fives of bits of the hexadecimal digest.
_ARCHIVED = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT page_id, first, strlen(h) AS n, sha1(h) || '0' AS x FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(x, i * 5 // 4 + 1, 2) AS INTEGER) >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


@query(sql=_ARCHIVED)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Windows of 400 bytes by their hexadecimal digits; a byte goes if a window over it occurs twice.
_REPEATED = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, CAST(2 * s + 1 AS BIGINT), 800)) AS m FROM (SELECT r, h, unnest(range(0, strlen(h) // 2 - 399)) AS s FROM d)),
twice AS (SELECT m FROM w GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT r, s FROM w SEMI JOIN twice USING (m)),
edge AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM edge),
span AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM run GROUP BY r, g),
part AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM span),
cut AS (SELECT r, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS k
    FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, strlen(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN h ELSE k || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""


@query(sql=_REPEATED)
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), digest=True)


# Units are code points, which DuckDB's substr counts as well.
_FILLED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
    OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


@query(sql=_FILLED)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return align.report(table(spark, sf_dir, "documents"), *paths)
