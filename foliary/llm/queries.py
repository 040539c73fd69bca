"""The operators of this subpackage over the synthetic tables, and their SQL where there is any."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import delta_rollup, int8_neardup, label_shards, langid_nb, pii_weak, pu_quality, sparse_suffix, template_decontam
from foliary.llm.common import Workspace, held_out, load
from foliary.llm.simhash_covering import simhash_groups
from foliary.llm.transducer_bpe import Encoder, Vocabulary, encode_documents

#: A tokenizer file; the driver reads it.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

LONG_SPACE = re.compile(r"\s{2000}")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_weak.find_spans(load(spark, sf_dir, "documents"))
    def count(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{pii_weak.KINDS[kind]}")

    return found.select(
        F.col("id").alias("doc_id"), *map(count, range(4)), F.sha2(pii_weak.listing("base"), 256).alias("base_sha256"), pii_weak.listing("spans").alias("spans")
    )


def op2_int8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = int8_neardup.near_duplicates(load(spark, sf_dir, "embeddings"), 0.98)
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = langid_nb.identify(docs, langid_nb.fit_on_training_rows(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op4_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_suffix.repeated_passages(load(spark, sf_dir, "documents"), 50)
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("spans").alias("n_spans"), "n_words", listed.alias("spans"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(load(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_shards.shard_documents(load(spark, sf_dir, "documents"), 8)
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), any_case=True)


def op8_token_count_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the second and third sent twice: all documents; word counts revised to leave out lone marks; later copies gone.

    n_docs and n_tokens are the totals after all batches, the columns with _loaded those of all documents as they came.
    """
    work = Workspace(spark, "tokens")
    vocabulary = spark.sparkContext.broadcast(Vocabulary(BYTE_BPE))
    ranks = spark.sparkContext.broadcast(token_ranks(BYTE_BPE_RANKS))

    def counters():
        import tiktoken

        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        careful = Encoder(vocabulary.value, None, special=False)

        def bpe(text: str) -> int:
            # The library's pattern search gives up on very long white space.
            if LONG_SPACE.search(text):
                return next(iter(careful.encode_batch([text])))[0].count(b",") + 1
            return len(fast.encode_ordinary(text))

        return {
            "bpe": bpe,
            "words": lambda text: len(text.split()),
            "revised": lambda text: sum(any(map(str.isalnum, w)) for w in text.split()),
        }

    counts = work.write(delta_rollup.measure(load(spark, sf_dir, "documents"), counters, ["bpe", "words", "revised"]), "counts")

    def under(rows: DataFrame, tokenizer: str, column: str) -> DataFrame:
        return rows.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(column).alias("n_tokens"))

    bpe, words, revised = ("byte_bpe_50k/1", "bpe"), ("words/1", "words"), ("words/1", "revised")
    changed, gone = counts.where("words <> revised"), delta_rollup.later_copies(counts, work)
    store = delta_rollup.DeltaStore(spark, f"{work.root}/store")
    store.commit("load", delta_rollup.inserts(under(counts, *bpe).unionByName(under(counts, *words))))
    for _ in range(2):
        store.commit("revise", delta_rollup.revisions(under(changed, *words), under(changed, *revised)))
        store.commit("copies", delta_rollup.deletes(under(gone, *bpe).unionByName(under(gone, *revised))))
    sums = ["n_docs", "n_tokens"]
    none = [F.lit(0).cast("long").alias(c) for c in sums]
    keys = ["tokenizer", "lang", "source", "level"]
    last = store.rollup().select(*keys, *sums, *[c.alias(f"{n}_loaded") for n, c in zip(sums, none, strict=True)])
    loaded = store.rollup(["load"]).select(*keys, *none, *[F.col(c).alias(f"{c}_loaded") for c in sums])
    return last.unionByName(loaded).groupBy(*keys).agg(*[F.sum(c).alias(c) for n in sums for c in (n, f"{n}_loaded")])


def token_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pu_quality.score_documents(docs, pu_quality.fit(docs, load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_int8_embedding_near_dedup": op2_int8_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_sparse_suffix_dedup": op4_sparse_suffix_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_label_propagation_shards": op6_label_propagation_shards,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_token_count_deltas": op8_token_count_deltas,
    "op9_pu_quality": op9_pu_quality,
    "op10_transducer_bpe": op10_transducer_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op2_int8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n
            FROM embeddings WHERE label IS NOT NULL
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
    """,
    "op4_sparse_suffix_dedup": r"""
        WITH texts AS (
            SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(text,
                '[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS ws
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
        ), words AS (SELECT doc_id, r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM texts WHERE len(ws) >= 50),
        runs AS (SELECT doc_id, r, i, list(hash(w)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS run FROM words),
        windows AS (SELECT doc_id, i, hash(run) AS h FROM runs WHERE len(run) = 50),
        shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        starts AS (SELECT DISTINCT doc_id, i FROM windows JOIN shared USING (h)),
        marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS opens FROM starts),
        numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
        spans AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY doc_id, k)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_words, string_agg(s || ':' || e, ',' ORDER BY s) AS spans
        FROM spans GROUP BY doc_id
    """,
}
