"""The numbered operators as named queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import bwt_dedup, byte_bpe, conversation_trie, cover_tree, html_text, language_id, line_dedup, packing, quality_rules, secret_scan, sentence_piece, simhash, token_alignment
from tablewright.llm.common import written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is(value: str) -> Callable:
    return lambda x: x == value


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of rules learned from all labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = written(quality_rules.statistics(docs).drop("text"), "counts")
    labels = quality_rules.labels_of(table(spark, sf_dir, "labels"))
    rules = quality_rules.learn(written(counted.join(labels, "doc_id"), "labelled"))
    return counted.select(
        "doc_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        quality_rules.base_failed().alias("base_failed"),
        (~quality_rules.base_failed() & quality_rules.verdict(rules)).alias("kept"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, each document ended by id 1."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, "doc_id", "text", path, public_tokenizers.PATTERN, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, or nearly repeat, an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, "doc_id", "text").select("doc_id", "n_lines", "n_removed", "text")


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 200-byte strings that repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bwt_dedup.dedup(docs, "doc_id", "text", 200)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    told = language_id.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs", "other")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document, through a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.findings(docs, "text", into="found").select("doc_id", "found")
    base = F.filter("found", lambda x: x["rank"] < len(secret_scan.BASE))
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(rule.kind))).cast("long").alias(f"n_{rule.kind}") for rule in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.round_trip(docs, "text", path, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by a merge-type model, with an end id, and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = sentence_piece.round_trip(docs.select("doc_id", "text"), "text", public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared beginning of rebuilt conversations, with subtree totals."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document, and how common its linked pairs of ids are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    done = token_alignment.align(docs, "text", a, public_tokenizers.PATTERN, b)
    return done.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_cover_tree": op4_cover_tree,
    "op5_simhash": op5_simhash,
    "op6_bwt_dedup": op6_bwt_dedup,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_text": op9_html_text,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_sentence_piece": op11_sentence_piece,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_alignment": op13_token_alignment,
}

#: For the secret kinds, in their order: pattern, and the least length of group 2.
SQL_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
)


def _secrets_sql() -> str:
    parts = []
    for rank, (kind, pattern, least) in enumerate(SQL_RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        long = f"length(regexp_extract(m[i], {p}, 2)) >= {least}" if least else "true"
        parts.append(
            f"select doc_id, row, {rank} as rank, '{kind}' as kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as start, length(m[i]) as n"
            f" from (select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, row, regexp_extract_all(text, {p}) as m, string_split_regex(text, {p}) as g from t where regexp_matches(text, {p}))) where {long}"
        )
    listed = "string_agg(kind || ':' || start || ':' || (start + n), ',' order by start, rank)"
    counts = ", ".join(f"count(*) filter (where rank = {k})::bigint as n_{kind}" for k, (kind, _, _) in enumerate(SQL_RULES[:3]))
    return (
        f"with t as (select doc_id, row_number() over () as row, coalesce(text, '') as text from documents), s as ({' union all '.join(parts)}),"
        f" a as (select row, {counts}, {listed} as spans, {listed} filter (where rank < 3) as base from s group by row)"
        " select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,"
        " sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join a using (row)"
    )


#: The others cannot be said in SQL as a whole (learned models, tokens, XXH64, banding); brute force tests them.
ORACLES: dict[str, str] = {
    "op8_secret_scan": _secrets_sql(),
    "op4_cover_tree": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
 u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as n from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
 l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
 where a.n > 0 and b.n > 0 and list_inner_product(a.e, b.e) / a.n / b.n >= 0.93),
 r as (select vec_id, vec_id as c from embeddings union select r.vec_id, l.b from r join l on r.c = l.a)
 select r.vec_id, (select count(*) from l where l.a = r.vec_id)::bigint as n_links, min(c) as component_id, r.vec_id = min(c) as kept from r group by r.vec_id""",
}
