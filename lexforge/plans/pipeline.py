"""End to end: questions and a corpus in, answers and audited artefacts out.

All questions go through every stage together; a question that fails a stage leaves as a
row with an error code, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..governance import RAG_METHODS, Profile, require_right
from ..operators import chunking, evidence, index, prompting, retrieval
from ..operators.rerank import Reranker, noop
from ..runtime import stored

RETRIEVAL_ERROR, PROMPT_ERROR, GENERATION_ERROR = "RETRIEVAL_ERROR", "PROMPT_ERROR", "GENERATION_ERROR"


@dataclass
class Run:
    """The tables of one run; those of retrieval are None for ``direct``."""

    hits: DataFrame | None
    deduplicated: DataFrame | None
    packed: DataFrame | None
    prompts: DataFrame
    answers: DataFrame
    predictions: DataFrame


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame | None, profile: Profile, rerank: Reranker = noop) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, their de-duplication with what the top k cut off, packed evidence) of the questions."""
    chunks = stored(chunks)
    found = retrieval.bm25(questions, index.build(chunks), profile.candidates, profile.k1, profile.b)
    hits = stored(rerank(found.join(chunks.select("chunk_id", "document_id", "source_path"), "chunk_id")))
    judged = evidence.deduplicate(hits, chunks, profile.overlap_threshold)
    limited = evidence.cut_to(judged, profile.evidence_top_k).select("id", "chunk_id", "included")
    kept = stored(judged.join(limited, ["id", "chunk_id"], "left"))
    chosen = kept.where("included").select("id", "chunk_id", "rank")
    return hits, kept, stored(evidence.pack(chosen, chunks, documents, profile.evidence_chars, profile.per_document))


def run(
    questions: DataFrame,
    documents: DataFrame | None,
    profile: Profile,
    template: prompting.Template,
    generate: Callable[[DataFrame], DataFrame] = prompting.mock_generate,
    rerank: Reranker = noop,
    chunks: DataFrame | None = None,
    limit: int | None = None,
) -> Run:
    """Answers for (id, question).  ``direct`` needs no corpus; the other methods need documents or chunks.

    ``limit`` takes the first so many questions by id.  Extractive readers have a run of their
    own (``operators.reader``) and are refused here.
    """
    require_right(profile.split, "inference")
    if profile.method not in RAG_METHODS:
        raise ValueError(f"{profile.method} is not generated: use the reader")
    if (profile.method == "hybrid_rag") == (rerank is noop):
        raise ValueError("hybrid_rag needs a reranker, other methods none")
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be positive")
        questions = questions.orderBy("id").limit(limit)
    hits = kept = packed = None
    reasons = None
    if profile.method == "direct":
        prompts = questions.select("id", prompting.render(template, F.col("question")).alias("prompt"), F.lit(None).cast("string").alias("error_code"))
    else:
        if chunks is None:
            if documents is None:
                raise ValueError("a corpus is needed")
            chunks = chunking.chunk_documents(documents, profile.chunk_max_chars, profile.chunk_overlap_chars, profile.chunk_min_chars)
        hits, kept, packed = retrieve(questions, chunks, documents, profile, rerank)
        if profile.method == "hybrid_rag":
            reasons = hits.groupBy("id").agg(F.min("fallback_reason").alias("fallback_reason"))
        shown = evidence.render(packed).select("id", F.when(F.col("evidence") != "", F.col("evidence")).alias("evidence"))
        retrieved = hits.select("id").distinct().withColumn("_hit", F.lit(True))
        rows = questions.join(shown, "id", "left").join(retrieved, "id", "left")
        error = F.when(F.col("_hit").isNull(), F.lit(RETRIEVAL_ERROR)).when(F.col("evidence").isNull(), F.lit(PROMPT_ERROR))
        prompts = rows.select("id", F.when(F.col("evidence").isNotNull(), prompting.render(template, F.col("question"), F.col("evidence"))).alias("prompt"), error.alias("error_code"))
    prompts = stored(prompts)
    answers = stored(generate(prompts.where("error_code is null")))
    done = prompts.select("id", F.col("error_code").alias("_early")).join(answers, "id", "left")
    done = done.join(reasons, "id", "left") if reasons is not None else done.withColumn("fallback_reason", F.lit(None).cast("string"))
    clean = prompting.clean_answer(F.coalesce("raw_answer", F.lit("")))
    code = F.coalesce("_early", "error_code", F.when(clean == "", F.lit(GENERATION_ERROR)))
    predictions = done.select(
        "id", F.when(code.isNull(), clean).alias("answer"), F.lit(profile.method).alias("method"),
        F.when(code.isNull(), "success").otherwise("error").alias("status"), code.alias("error_code"), "fallback_reason", "latency_ms",
    )
    return Run(hits, kept, packed, prompts, answers, stored(predictions))


def retrieval_records(run: Run, questions: DataFrame, profile: Profile) -> DataFrame:
    """One nested row per question: its hits, their de-duplication, what was packed, and whether reranking was used."""
    hit = F.struct("rank", "chunk_id", "document_id", "source_path", "bm25_score", "rerank_score")
    raw = run.hits.groupBy("id").agg(
        F.array_sort(F.collect_list(hit)).alias("raw_hits"),
        F.struct(F.bool_or("used").alias("used"), F.array_sort(F.collect_set("fallback_reason")).alias("fallback_reasons")).alias("reranker"),
    )
    judged = run.deduplicated.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "kept", "duplicate_of", "reason", "overlap_ratio"))).alias("deduplication"),
        F.array_sort(F.collect_list(F.when(F.col("kept") & ~F.col("included"), F.struct("rank", "chunk_id")))).alias("limited"),
    )
    packed = evidence.render(run.packed).select("id", F.struct("included_ids", "truncated_ids", "dropped_reasons", "evidence").alias("packed_evidence"))
    codes = run.predictions.select("id", "status", "error_code")
    rows = questions.select("id", "question").join(codes, "id").join(raw, "id", "left").join(judged, "id", "left").join(packed, "id", "left")
    return rows.select(
        F.lit("lexforge.retrieval.1").alias("schema_version"), "id", F.lit(profile.method).alias("method"), F.sha2("question", 256).alias("query_sha256"),
        F.lit(profile.fingerprint).alias("index_fingerprint"), F.lit(profile.candidates).alias("top_k"), F.lit(profile.evidence_top_k).alias("evidence_top_k"),
        "raw_hits", "deduplication", F.transform("limited", lambda x: x["chunk_id"]).alias("top_k_limited_ids"), "packed_evidence", "reranker", "status", "error_code",
    )


def generation_records(run: Run, profile: Profile, template: prompting.Template) -> DataFrame:
    """One row per prompt that was sent: digests, provider, outcome; no answer text."""
    p = run.prompts.where("error_code is null").select("id", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("prompt_chars"))
    return p.join(run.answers, "id", "left").select(
        "id", F.lit(profile.method).alias("method"), F.lit(template.name).alias("template"), F.lit(template.version).alias("template_version"), F.lit(template.sha256).alias("template_sha256"),
        "prompt_sha256", "prompt_chars", F.lit(profile.generator).alias("provider"), F.lit(profile.model).alias("model"),
        "status", "error_code", "retries", "latency_ms", F.coalesce(F.col("error_code").isin(*prompting.RETRIED), F.lit(False)).alias("retryable"),
    )


def counts(predictions: DataFrame, *by: str) -> DataFrame:
    """Cases, successes, errors, error and fallback rates, sorted reasons and mean latency, for each group."""
    n = F.count(F.lit(1))
    latency = F.avg("latency_ms") if "latency_ms" in predictions.columns else F.lit(None).cast("double")
    return predictions.groupBy(*by).agg(
        n.alias("n_cases"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "error").alias("n_errors"),
        (F.count_if(F.col("status") == "error") / n).alias("error_rate"), (F.count("fallback_reason") / n).alias("fallback_rate"),
        F.array_sort(F.collect_set("fallback_reason")).alias("fallback_reasons"), latency.alias("mean_latency_ms"),
    )
