"""The operators as registered queries, with their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark, d):
    from .exact_dedup import exact_dedup
    return exact_dedup(read(spark, d, "documents")).drop("chain")


from .mixing import ORACLE_SQL as _MIX_SQL  # noqa: E402


@query(_MIX_SQL)
def op2_mix(spark, d):
    from .mixing import mix
    return mix(read(spark, d, "documents"))


@query()
def op5_byte_bpe(spark, d):
    from .byte_bpe import token_digests
    return token_digests(read(spark, d, "documents"))


@query()
def op9_quality_classifier(spark, d):
    from .quality_classifier import classify
    return classify(read(spark, d, "documents"), read(spark, d, "labels"))


@query()
def op10_near_dedup(spark, d):
    from .near_dedup import near_dedup
    return near_dedup(read(spark, d, "documents"), width=2)


from .url_filter import oracle_sql as _url_sql  # noqa: E402


@query(_url_sql())
def op8_url_filter(spark, d):
    from .url_filter import filter_urls
    return filter_urls(read(spark, d, "pages"))


@query()
def op7_quality_rules(spark, d):
    from .quality_rules import judge
    return judge(read(spark, d, "documents"), read(spark, d, "labels"))


@query()
def op3_html_text(spark, d):
    from .html_text import main_text
    return main_text(read(spark, d, "pages"))


@query()
def op4_token_counts(spark, d):
    from .token_counts import count_tokens
    return count_tokens(read(spark, d, "documents"))


@query()
def op6_line_dedup(spark, d):
    from .line_dedup import EDITS, SHORT_EDITS, line_dedup
    return line_dedup(read(spark, d, "documents"), edits=EDITS, short_edits=SHORT_EDITS)


@query()
def op11_token_files(spark, d):
    from .token_files import token_files
    return token_files(read(spark, d, "documents"))


from .merkle import ORACLE_SQL as _MERKLE_SQL  # noqa: E402


@query(_MERKLE_SQL)
def op12_merkle(spark, d):
    from .merkle import merkle_manifest
    return merkle_manifest(read(spark, d, "documents"))


from .spelling import ORACLE_SQL as _SPELLING_SQL  # noqa: E402


@query(_SPELLING_SQL)
def op13_spelling(spark, d):
    from .spelling import spelling_variants
    return spelling_variants(read(spark, d, "documents"))
