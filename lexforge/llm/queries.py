"""The queries of the training-data problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, cutoff, distinct, encode, leak, lookalike, mix, nearcopy, overlap, split


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": answers.p1_found,
        "p1_rates": answers.p1_rates,
        "p2_found": split.p2_found,
        "p2_pieces": split.p2_pieces,
        "p3_found": lookalike.p3_found,
        "p3_forms": lookalike.p3_forms,
        "p4_found": leak.p4_found,
        "p4_leaks": leak.p4_leaks,
        "p5_found": distinct.p5_found,
        "p5_scores": distinct.p5_scores,
        "p6_found": nearcopy.p6_found,
        "p6_groups": nearcopy.p6_groups,
        "p7_found": overlap.p7_found,
        "p7_coverage": overlap.p7_coverage,
        "p7_report": overlap.p7_report,
        "p8_ids": encode.p8_ids,
        "p9_mix": mix.p9_mix,
        "p9_report": mix.p9_report,
        "p10_found": cutoff.p10_found,
        "p10_rates": cutoff.p10_rates,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL says on whole tables; the rest is tested against brute force or a library."""
    return {
        "p2_found": """
with l as (select field, max_size from split_limits)
select distinct 'document' kind, id from legal_documents, l where field = 'legal_documents.passage' and length(passage) > max_size
union
select distinct 'chunk' kind, chunk_id id from legal_chunks, l where field = 'legal_chunks.raw_text' and length(raw_text) > max_size
""",
        "p5_found": """
with t as (select distinct chunk_id, u.term term, u.tf tf from (select chunk_id, unnest(term_frequencies) u from indexed_documents) x)
select distinct chunk_id, term from t where tf >= 3 and term in (select term from t group by term having count(distinct chunk_id) <= 3)
""",
    }
