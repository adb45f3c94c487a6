"""Answer evaluation: alignment, METEOR, ROUGE-L, exact match and F1, error report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import bounded_preview, eval_text, eval_tokens, word_tokens
from ..schemas import require

# The diagnostic types a reviewer may assign to a case.
ERROR_TYPES = (
    "DATA_SCHEMA_ERROR", "CONTEXT_LOAD_ERROR", "CHUNK_BOUNDARY_ERROR", "RETRIEVAL_MISS", "RIGHT_DOCUMENT_WRONG_CHUNK",
    "WRONG_DOCUMENT_VERSION", "RERANKING_REGRESSION", "EVIDENCE_TRUNCATION", "MISSING_REQUIRED_ITEM", "UNSUPPORTED_ADDITION",
    "WRONG_ARTICLE_CITATION", "TEMPORAL_CONFUSION", "OVER_VERBOSE", "UNDER_SPECIFIED", "FORMAT_ERROR", "EMPTY_ANSWER",
    "GENERATION_FAILURE", "REFERENCE_STYLE_VARIATION", "OTHER",
)


def alignment_issues(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, issue): 'missing', 'extra' or 'duplicate' ids of (id, answer) on either side."""
    r = references.groupBy("id").agg(F.count(F.lit(1)).alias("n_reference"))
    p = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("n_prediction"))
    both = r.join(p, "id", "full")
    issue = F.filter(
        F.array(
            F.when(F.col("n_prediction").isNull(), F.lit("missing")),
            F.when(F.col("n_reference").isNull(), F.lit("extra")),
            F.when((F.col("n_prediction") > 1) | (F.col("n_reference") > 1), F.lit("duplicate")),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("id", F.explode(issue).alias("issue"))


def align(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, reference, prediction); the query fails unless both sides hold the same ids, once each."""
    r = references.select("id", F.col("answer").alias("reference"), F.lit(1).alias("_r"))
    p = predictions.select("id", F.col("answer").alias("prediction"), F.lit(1).alias("_p"))
    once = F.count(F.lit(1)).over(Window.partitionBy("id")) == 1
    whole = r.join(p, "id", "full").withColumn("_once", once)
    whole = require(whole, F.col("_r").isNotNull() & F.col("_p").isNotNull() & F.col("_once"), "references and predictions do not align")
    return whole.select("id", "reference", "prediction")


def matched(reference: list[str], prediction: list[str]) -> tuple[int, int]:
    """(matches, chunks): the k-th occurrence of a token in the prediction matches the k-th in the reference; a chunk starts where the matched reference positions jump."""
    where: dict[str, list[int]] = {}
    for r in range(len(reference) - 1, -1, -1):
        where.setdefault(reference[r], []).append(r)
    matches, chunks, before = 0, 0, -2
    for token in prediction:
        if places := where.get(token):
            r = places.pop()
            matches, chunks, before = matches + 1, chunks + (r != before + 1), r
    return matches, chunks


def _meteor() -> Column:
    """METEOR of the columns matches, chunks, precision, recall."""
    below = F.col("recall") + 9.0 * F.col("precision")
    mean = F.when(below > 0, 10.0 * F.col("precision") * F.col("recall") / below).otherwise(F.lit(0.0))
    penalty = F.when(F.col("chunks") > 1, 0.5 * F.pow(F.col("chunks") / F.col("matches"), F.lit(3.0))).otherwise(F.lit(0.0))
    return mean * (1.0 - penalty)


def compared(cases: DataFrame, *kept: str, lcs: bool = True) -> DataFrame:
    """(id, kept columns, nr, np, matches, chunks, lcs) of cases (id, reference_tokens, prediction_tokens); a narrow map, null where tokens are."""
    names = ("nr", "np", "matches", "chunks", "lcs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # token lists as Python objects take many times their bytes
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for a, b in zip(batch.column("reference_tokens").to_pylist(), batch.column("prediction_tokens").to_pylist()):
                    rows.append((None,) * 5 if a is None or b is None else (len(a), len(b), *matched(a, b), lcs_length(a, b) if lcs else None))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", *kept)] + [pa.array(x, pa.int64()) for x in zip(*rows)], names=["id", *kept, *names])

    chosen = cases.select("id", *kept, "reference_tokens", "prediction_tokens")
    return chosen.mapInArrow(run, StructType([*(chosen.schema[c] for c in ("id", *kept)), *(StructField(n, LongType()) for n in names)]))


def _rates(counted: DataFrame) -> DataFrame:
    m = F.col("matches")
    precision = F.when(F.col("np") > 0, m / F.col("np")).otherwise(F.lit(0.0))
    recall = F.when(F.col("nr") > 0, m / F.col("nr")).otherwise(F.lit(0.0))
    return counted.withColumn("precision", precision).withColumn("recall", recall)


def meteor(cases: DataFrame) -> DataFrame:
    """(id, matches, chunks, precision, recall, meteor) of cases (id, reference_tokens, prediction_tokens)."""
    rated = _rates(compared(cases, lcs=False)).select("id", "matches", "chunks", "precision", "recall")
    return rated.withColumn("meteor", _meteor())


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence; the rows of the table are bit vectors, so a row costs len(b) / 64 words."""
    where: dict[str, int] = {}
    for j, token in enumerate(b):
        where[token] = where.get(token, 0) | 1 << j
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    for token in a:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _rouge_l() -> Column:
    return F.when(F.col("lcs") > 0, 2.0 * F.col("lcs") / (F.col("nr") + F.col("np"))).otherwise(F.lit(0.0))


def rouge_l(cases: DataFrame) -> DataFrame:
    """(id, lcs, rouge_l): F1 of the longest common token subsequence."""
    return compared(cases).select("id", "lcs", _rouge_l().alias("rouge_l"))


def score_cases(aligned: DataFrame, *kept: str) -> DataFrame:
    """(id, kept columns, status, meteor, rouge_l): empty predictions, then empty references, are not scored.

    A case is compared where it stands: no row per token and no join, whatever the texts.
    """
    p, r = eval_text(F.coalesce("prediction", F.lit(""))), eval_text(F.coalesce("reference", F.lit("")))
    status = F.when(p == "", "empty_prediction").when(r == "", "empty_reference").otherwise("scored")
    cases = aligned.select("id", *kept, status.alias("status"), "reference", "prediction")
    scored = F.col("status") == "scored"
    cases = cases.select("id", *kept, "status", F.when(scored, eval_tokens(F.col("reference"))).alias("reference_tokens"), F.when(scored, eval_tokens(F.col("prediction"))).alias("prediction_tokens"))
    rated = _rates(compared(cases, *kept, "status"))
    return rated.select("id", *kept, "status", F.when(scored, _meteor()).alias("meteor"), F.when(scored, _rouge_l()).alias("rouge_l"))


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Means over scored cases and counts per status, for each group."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.col("status") == "scored").alias("n_scored"),
        F.count_if(F.col("status") == "empty_prediction").alias("n_empty_prediction"),
        F.count_if(F.col("status") == "empty_reference").alias("n_empty_reference"),
        F.avg("meteor").alias("meteor"),
        F.avg("rouge_l").alias("rouge_l"),
    )


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))


def exact_match_f1(aligned: DataFrame) -> DataFrame:
    """(id, exact_match, token_f1) over folded word runs; two empty answers match."""
    t = aligned.select("id", word_tokens(F.coalesce("reference", F.lit(""))).alias("r"), word_tokens(F.coalesce("prediction", F.lit(""))).alias("p"))
    both = multiset_overlap(F.col("r"), F.col("p"))
    f1 = F.when((F.size("r") == 0) & (F.size("p") == 0), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size("r") + F.size("p")))
    return t.select("id", (F.array_join("r", " ") == F.array_join("p", " ")).cast("double").alias("exact_match"), f1.alias("token_f1"))


def retrieval_status(packed: DataFrame) -> DataFrame:
    """(id, retrieval_status, previews) of (id, status, blocks array<struct<rank, chunk_id, document_id, block>>)."""
    state = F.when(F.col("status") != "success", F.col("status")).when(F.col("blocks").isNull(), "no_packed_evidence").when(F.size("blocks") == 0, "miss").otherwise("success")
    previews = F.transform(
        "blocks",
        lambda b: F.struct(b["rank"].alias("rank"), b["chunk_id"].alias("chunk_id"), b["document_id"].alias("document_id"), bounded_preview(b["block"]).alias("preview")),
    )
    return packed.select("id", state.alias("retrieval_status"), previews.alias("previews"))


def error_report(scores: DataFrame, references: DataFrame, predictions: DataFrame, retrieval: DataFrame, error_types: DataFrame | None = None) -> DataFrame:
    """One row per scored or unscored case, worst first: unscored ones, then METEOR, ROUGE-L, id.

    Scores are ordered by their first nine decimals: the same fraction computed along another
    path may differ in its last bits, and such cases are equal.  Predictions and retrieval rows may be missing; ``error_types`` (id, error_type) must name
    known diagnostic types.
    """
    joined = (
        scores.join(references.select("id", F.col("answer").alias("reference")), "id", "left")
        .join(predictions.select("id", F.col("answer").alias("prediction")), "id", "left")
        .join(retrieval, "id", "left")
        .withColumn("retrieval_status", F.coalesce("retrieval_status", F.lit("not_available")))
    )
    if error_types is not None:
        known = require(error_types, F.col("error_type").isin(*ERROR_TYPES), "unknown error type")
        joined = joined.join(known.groupBy("id").agg(F.array_sort(F.collect_set("error_type")).alias("error_types")), "id", "left")
    meteor_9, rouge_9 = F.round("meteor", 9), F.round("rouge_l", 9)
    return ranked_whole(joined, [meteor_9.asc_nulls_first(), F.coalesce(rouge_9, F.lit(-1.0)).asc(), F.col("id").asc()], "place")


def ranked_whole(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Global row numbers without one task for all rows: a range sort, then offsets of its partitions."""
    from ..runtime import stored

    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        placed.join(F.broadcast(starts.select("_part", "_start")), "_part")  # one row per partition
        .withColumn(name, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint"))
        .drop("_at", "_part", "_start")
    )


def markdown_cell(text: Column) -> Column:
    """Escaped for a Markdown table."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(escaped, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>"))


# The columns of the report.
REPORT_COLUMNS = ("rank", "id", "meteor", "rouge_l", "error_type", "retrieval_status", "evidence_previews", "prediction", "reference")
REPORT_HEAD = (
    "| rank | id | METEOR | ROUGE-L | error_type | retrieval | evidence previews | prediction | reference |",
    "|---:|---|---:|---:|---|---|---|---|---|",
)


def report_table(report: DataFrame, error_type: str = "OTHER") -> DataFrame:
    """The report's nine columns as they are written to CSV."""
    shown = F.transform(F.coalesce("previews", F.array().cast("array<struct<rank:int,chunk_id:string,document_id:string,preview:string>>")), lambda b: F.concat_ws(" ", F.concat(F.lit("["), b["rank"].cast("string"), F.lit("]")), b["chunk_id"], b["preview"]))
    kind = F.coalesce(F.array_join("error_types", ", "), F.lit(error_type)) if "error_types" in report.columns else F.lit(error_type)
    return report.select(
        F.col("place").alias("rank"), "id", "meteor", "rouge_l", kind.alias("error_type"), "retrieval_status", F.array_join(shown, "\n").alias("evidence_previews"), "prediction", "reference",
    )


def markdown_lines(report: DataFrame, about: dict[str, str]) -> DataFrame:
    """(line_no, line) of the whole Markdown report: title, facts, head and a row per case."""
    table = report_table(report)
    top = ["# Retrieval/Generation Error Report", "", *[f"- {k}: `{v}`" for k, v in about.items()], f"- cases: `{report.count()}`", "", *REPORT_HEAD]
    metric = lambda c: F.coalesce(F.format_string("%.6f", c), F.lit(""))
    cells = [
        F.col("rank").cast("string"), markdown_cell(F.col("id")), F.when(F.col("meteor").isNotNull(), metric("meteor")), F.when(F.col("rouge_l").isNotNull(), metric("rouge_l")),
        markdown_cell(F.col("error_type")), markdown_cell(F.col("retrieval_status")), markdown_cell(F.col("evidence_previews")),
        markdown_cell(F.coalesce(F.when(F.col("prediction") != "", F.col("prediction")), F.lit("<missing>"))), markdown_cell(F.col("reference")),
    ]
    rows = table.select((F.col("rank") + len(top)).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |")).alias("line"))
    head = report.sparkSession.createDataFrame([(n + 1, line) for n, line in enumerate(top)], "line_no bigint, line string")
    return head.unionByName(rows)


def metrics_report(scores: DataFrame, **about: str) -> dict:
    """What a metrics file holds: version, facts, counts and macro means (driver: one row)."""
    row = macro(scores).first().asDict()
    return {"schema_version": "lexforge.metrics.1", **about, **row}
