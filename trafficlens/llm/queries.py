"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.byte_bpe import digests
from trafficlens.llm.embedding_dedup import embedding_dedup
from trafficlens.llm.exact_dedup import exact_dedup
from trafficlens.llm.language_id import identify
from trafficlens.llm.mixing import mix
from trafficlens.llm.simhash import simhash_dedup
from trafficlens.llm.suffix_dedup import substring_dedup
from trafficlens.llm.token_count import count_tokens
from trafficlens.llm.url_filter import filter_urls, parse_rule
from trafficlens.llm.util import checkpoint
from trafficlens.llm.warc_fixity import RECORDS_PER_FILE, audit, lay_out, warc_record
from trafficlens.session import table

BYTE_RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]

#: Parameters of the mixture: levels of the tree, target weights of its nodes, budget as a part of all tokens.
MIX_DOMAINS = ("web", "forum", "reference")
MIX_WEIGHTS = {
    ("web",): 3, ("forum",): 2, ("reference",): 2,
    ("web", "en"): 4, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 2,
    ("forum", "en"): 2, ("reference", "en"): 2,
    ("web", "en", "src0"): 2,
}
MIX_SHARE = 0.6
MIX_EPOCHS = 4
MIX_SEED = 17


def mix_levels():
    """domain / language / source; a source's number names its domain, sources without a number are "reference"."""
    number = F.expr("try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS int) % 3")
    domain = F.when(number == 0, "web").when(number == 1, "forum").otherwise("reference")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \\t\\n\\r]+"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(
        table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, word_count(),
        total=F.col("__all") * F.lit(MIX_SHARE), max_epochs=MIX_EPOCHS, seed=MIX_SEED,
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), [parse_rule(r) for r in RULES])


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = exact_dedup(table(spark, sf_dir, "documents"))
    return named.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files of RECORDS_PER_FILE records, audited against a replica with damage in known places.

    The replica lacks the records of pages whose id has an MD5 that begins with "07", and has one byte of the
    records changed whose MD5 begins with "7". Every record comes back with what the audit says of it."""
    pages = table(spark, sf_dir, "pages")
    record = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    mark = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    file = F.coalesce(F.floor(F.col("page_id") / F.lit(RECORDS_PER_FILE)), F.lit(-1)).cast("string")
    laid = lay_out(
        pages.select(
            "page_id", file.alias("warc_file"), F.octet_length(record).cast("long").alias("warc_length"),
            F.sha2(record, 256).alias("whole"), F.sha2(F.regexp_replace(record, "^WARC/1.0", "WARC/1.~"), 256).alias("broken"),
            mark.alias("mark"),
        ),
        "warc_file", ["page_id", "whole"], "warc_length",
    )
    laid = checkpoint(laid)
    at = ["warc_file", "warc_offset", "warc_length"]
    primary = laid.select(*at, F.col("whole").alias("digest"))
    damaged = F.when(F.col("mark").startswith("7"), F.col("broken")).otherwise(F.col("whole"))
    replica = laid.where(~F.col("mark").startswith("07")).select(*at, damaged.alias("digest"))
    found = audit(primary, replica).select(*at, "status")
    return laid.join(found, at, "left").select(
        "page_id", *at, F.col("whole").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status")
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def mixture_sql() -> str:
    """The mixture of op4_mixture as SQL: the same tree, level by level, with one running sum for each leaf."""
    levels = ["domain", "lang", "source"]

    def weight(depth: int) -> str:
        own = sorted((k, w) for k, w in MIX_WEIGHTS.items() if len(k) == depth)
        cases = [f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(levels, k))} THEN {w}" for k, w in own]
        return f"CASE {' '.join(cases)} ELSE 1 END" if cases else "1"

    ctes = [
        f"""flat AS (
            SELECT doc_id,
                   CASE TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) % 3
                        WHEN 0 THEN '{MIX_DOMAINS[0]}' WHEN 1 THEN '{MIX_DOMAINS[1]}' ELSE '{MIX_DOMAINS[2]}' END AS domain,
                   coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS n_tokens
            FROM documents)""",
        "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM flat GROUP BY ALL)",
        f"b0 AS (SELECT CAST(floor(CAST(sum(tokens) AS BIGINT) * CAST({MIX_SHARE} AS DOUBLE)) AS DOUBLE) AS budget FROM leaves)",
    ]
    for d in (1, 2, 3):
        node, parent = ", ".join(levels[:d]), ", ".join(levels[: d - 1])
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"{by} ORDER BY cap / w, {levels[d - 1]}"
        ctes += [
            f"k{d} AS (SELECT {node}, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS cap, CAST({weight(d)} AS BIGINT) AS w FROM leaves GROUP BY {node})",
            f"""f{d} AS (
            SELECT k{d}.*, budget,
                   (budget - CAST(coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) * w
                   / CAST(sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fair
            FROM k{d} {f"JOIN b{d - 1} USING ({parent})" if parent else "CROSS JOIN b0"})""",
            f"""b{d} AS (
            SELECT {node}, CASE WHEN cap <= fair THEN CAST(cap AS DOUBLE) ELSE
                   (budget - CAST(coalesce(sum(CASE WHEN cap <= fair THEN cap END) OVER ({by}), 0) AS DOUBLE)) * w
                   / CAST(sum(CASE WHEN NOT cap <= fair THEN w END) OVER ({by}) AS DOUBLE) END AS budget
            FROM f{d})""",
        ]
    ctes += [
        f"""plan AS (
            SELECT domain, lang, source, tokens AS leaf_tokens, CAST(floor(budget) AS BIGINT) AS leaf_budget,
                   CASE WHEN tokens > 0 THEN least(CAST(floor(budget) AS BIGINT) // tokens, {MIX_EPOCHS}) ELSE 0 END AS epochs
            FROM leaves JOIN b3 USING (domain, lang, source))""",
        f"""run AS (
            SELECT flat.*, leaf_tokens, leaf_budget, epochs,
                   sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || epochs || ':' || doc_id), doc_id, n_tokens
                                       ROWS UNBOUNDED PRECEDING) <= leaf_budget - epochs * leaf_tokens
                   AND n_tokens > 0 AND epochs < {MIX_EPOCHS} AS in_last_epoch
            FROM flat JOIN plan USING (domain, lang, source))""",
    ]
    return (
        "WITH " + ",\n        ".join(ctes)
        + """
        SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget,
               CAST(CASE WHEN n_tokens > 0 THEN epochs ELSE 0 END AS BIGINT) AS full_epochs, in_last_epoch,
               CAST(CASE WHEN n_tokens > 0 THEN epochs ELSE 0 END + CAST(in_last_epoch AS INT) AS BIGINT) AS copies
        FROM run"""
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_count": op3_token_count,
    "op4_mixture": op4_mixture,
    "op5_url_filter": op5_url_filter,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixture": mixture_sql(),
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.w FROM r JOIN l ON l.u = r.reached),
        c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op9_warc_fixity": """
        WITH r AS (
            SELECT page_id, coalesce(CAST(page_id // 1000 AS VARCHAR), '-1') AS warc_file, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS mark,
                   'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
                   || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(CAST(page_id AS VARCHAR), '')
                   || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
                   || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
            FROM pages),
        h AS (SELECT *, strlen(rec) AS warc_length, sha256(rec) AS record_sha256 FROM r)
        SELECT page_id, warc_file,
               CAST(coalesce(sum(warc_length) OVER (PARTITION BY warc_file ORDER BY page_id, record_sha256
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS warc_offset,
               warc_length, record_sha256,
               CASE WHEN mark LIKE '07%' THEN 'missing' WHEN mark LIKE '7%' THEN 'corrupt' ELSE 'ok' END AS status
        FROM h""",
}
