"""``python -m lexforge COMMAND``: exit code 2 where a contract is broken."""

from __future__ import annotations

import argparse
import sys


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lexforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check_config(a) -> None:
    from .governance import Profile

    print(Profile.read(a.config).fingerprint)


def validate_data(a) -> None:
    from .operators.audit import question_profile
    from .sources import files

    spark = _spark()
    parsed = files.read_questions(spark, a.questions, a.split, answers=a.split in ("train", "warmup"))
    files.problems(parsed).groupBy("code").count().orderBy("code").show(truncate=False)
    question_profile(files.good(parsed)).show(truncate=False)
    if files.problems(parsed).limit(1).count():
        raise ValueError("the question file has problems")


def _corpus(spark, path: str):
    from .sources import files

    return files.corpus(files.read_context_zip(spark, path) if path.lower().endswith(".zip") else files.read_context_folder(spark, path))


def build_index(a) -> None:
    from .governance import Profile
    from .operators import chunking, index
    from .sources import cache

    spark, p = _spark(), Profile.read(a.config)
    depends = {"profile": p.fingerprint, "corpus": a.corpus, "chunker_version": chunking.VERSION}
    status, reason, chunks = cache.read_chunks(spark, a.cache, **depends)
    print("chunk cache:", status, reason or "")
    if status != "hit":
        cache.write_chunks(chunking.chunk_documents(_corpus(spark, a.corpus), p.chunk_max_chars, p.chunk_overlap_chars, p.chunk_min_chars), a.cache, overwrite_stale=a.rebuild, **depends)
        chunks = cache.read_chunks(spark, a.cache, **depends)[2]
    print(index.store(index.build(chunks), a.cache, overwrite=a.rebuild, profile=p.fingerprint))


def inspect_retrieval(a) -> None:
    """Shows hits with names, labels and previews; answers are not read."""
    from .governance import Profile, require_right
    from .operators import chunking, index, retrieval
    from .runtime import stored
    from .sources import files

    p = Profile.read(a.config)
    require_right(p.split, "inspect_retrieval")
    spark = _spark()
    questions = files.read_inference_questions(spark, a.questions, p.split)
    if a.limit:
        questions = questions.limit(int(a.limit))
    documents = stored(_corpus(spark, a.corpus))
    chunks = stored(chunking.chunk_documents(documents, p.chunk_max_chars, p.chunk_overlap_chars, p.chunk_min_chars))
    hits = retrieval.bm25(questions, index.build(chunks), p.candidates, p.k1, p.b)
    for row in retrieval.inspect(hits, chunks, documents).orderBy("id", "rank").toJSON().toLocalIterator():
        print(row)


def _generator(p):
    """The generation client of a profile; the key is read from the variable it names."""
    import os
    from functools import partial

    from .operators import prompting

    if p.generator == "mock":
        return prompting.mock_generate
    client = partial(prompting.ChatClient, p.url, p.model, os.environ.get(p.key_variable) if p.key_variable else None, p.max_tokens, p.timeout, style=p.generator, needs_key=bool(p.key_variable))
    return lambda prompts: prompting.generate(prompts, client)


def run(a) -> None:
    from .governance import Profile, run_id
    from .operators import chunking, prompting, rerank
    from .plans import pipeline
    from .runtime import release, stored
    from .sources import files, sinks

    spark, p = _spark(), Profile.read(a.config)
    template = prompting.Template.read(a.template, "template", "1")
    questions = files.read_inference_questions(spark, a.questions, p.split)
    documents = chunks = None
    if p.method != "direct":
        documents = stored(_corpus(spark, a.corpus))
        chunks = stored(chunking.chunk_documents(documents, p.chunk_max_chars, p.chunk_overlap_chars, p.chunk_min_chars))
    ranker = rerank.for_profile(p.reranker, p.model, questions, chunks)
    done = pipeline.run(questions, documents, p, template, _generator(p), ranker, chunks, int(a.limit) if a.limit else None)
    name = run_id(p.method)
    sinks.write_json_lines(done.predictions, f"{a.output}/{name}/predictions", "id")
    sinks.write_json_lines(pipeline.generation_records(done, p, template), f"{a.output}/{name}/generation", "id")
    if done.hits is not None:
        sinks.write_json_lines(pipeline.retrieval_records(done, questions, p), f"{a.output}/{name}/retrieval", "id")
    summary = pipeline.counts(done.predictions).first().asDict() | {"run_id": name, "profile": p.fingerprint, "template": template.sha256}
    print(sinks.write_json(f"{a.output}/{name}", "summary.json", summary))
    release(spark)


def read(a) -> None:
    """Extractive reading of a case file with a checkpoint on disk."""
    from .operators import reader
    from .sources import files, sinks

    spark = _spark()
    cases = files.fail_on(files.read_reader_csv(spark, a.cases))
    train = files.fail_on(files.read_reader_csv(spark, a.train)).select(files.F.col("id").alias("case_id"), files.F.col("row").alias("pos"), "context") if a.train else None
    done = reader.run(cases.select("id", "question", "context"), reader.local(a.checkpoint, a.manifest), "tuned_bm25_reader" if a.train else "finetuned_reader", train)
    sinks.write_json_lines(done.predictions, f"{a.output}/predictions", "id")
    sinks.write_json_lines(done.candidates, f"{a.output}/candidates", "id", "position")


def few_shot(a) -> None:
    from .plans import fewshot

    spark = _spark()
    answers, scores = fewshot.run(fewshot.load(spark, a.questions), [])
    answers.write.mode("errorifexists").json(a.output)
    scores.show(truncate=False)


def self_check(a) -> None:
    """A small run of each method with mock parts; stops at the first that fails."""
    from .governance import Profile, reference_policy
    from .operators import prompting, rerank
    from .plans import pipeline

    spark = _spark()
    questions = spark.createDataFrame([("1", "Mức phạt là bao nhiêu?")], "id string, question string")
    documents = spark.createDataFrame([("d", "Luật", "Điều 1. Mức phạt\nMức phạt là 5 triệu đồng.", "a/b.json", None, "h", None)], "id string, name string, passage string, source_path string, source_member string, content_hash string, link string")
    direct, rag = prompting.Template("direct", "1", "{question}"), prompting.Template("rag", "1", "{evidence}\n{question}")
    checks = {
        "reference policy": lambda: reference_policy()["pass"],
        "direct": lambda: pipeline.counts(pipeline.run(questions, None, Profile(method="direct"), direct).predictions).first()["n_success"] == 1,
        "bm25_rag": lambda: pipeline.counts(pipeline.run(questions, documents, Profile(), rag).predictions).first()["n_success"] == 1,
        "hybrid_rag": lambda: pipeline.counts(pipeline.run(questions, documents, Profile(method="hybrid_rag", reranker="mock"), rag, rerank=rerank.create("mock")).predictions).first()["n_success"] == 1,
    }
    for number, (name, check) in enumerate(checks.items(), start=1):
        print(f"[{number}/{len(checks)}] {name}")
        if not check():
            raise ValueError(f"{name} failed")
        print("PASS", name)


def evaluate(a) -> None:
    from .governance import require_references
    from .operators import evaluation
    from .sources import files, sinks

    require_references(a.split, a.reference_access)  # before a file is opened
    spark = _spark()
    aligned = evaluation.align(files.fail_on(files.read_eval_records(spark, a.references)), files.fail_on(files.read_eval_records(spark, a.predictions)))
    report = evaluation.metrics_report(evaluation.score_cases(aligned), split=a.split)
    print(sinks.write_report(a.output, report, overwrite=a.overwrite) if a.output else report)


def create_submission(a) -> None:
    from .operators import submission
    from .sources import files, sinks

    spark = _spark()
    expected = files.fail_on(files.read_target_ids(spark, a.questions)).select("id", "pos")
    rows = files.fail_on(files.read_predictions(spark, a.predictions)).select("id", "answer").join(expected, "id", "left")
    data = submission.to_json([(r["id"], r["answer"]) for r in submission.payload(expected, rows).toLocalIterator()])
    sinks.write_once(a.output, submission.MEMBER, data)
    print(sinks.write_once(a.output, "submission.zip", submission.to_zip(data)))


def validate_submission(a) -> None:
    from .operators import submission
    from .sources import files

    expected = [r["id"] for r in files.fail_on(files.read_target_ids(_spark(), a.questions)).orderBy("pos").toLocalIterator()]
    issues = submission.check_file(a.submission, expected)
    for code, id_ in issues:
        print(code, id_)
    if issues:
        raise ValueError(f"{len(issues)} issues")


COMMANDS = {
    check_config: ["config"],
    validate_data: ["questions", "split"],
    build_index: ["config", "corpus", "cache", "--rebuild"],
    inspect_retrieval: ["config", "questions", "corpus", "--limit="],
    run: ["config", "questions", "template", "output", "--corpus=", "--limit="],
    read: ["cases", "checkpoint", "manifest", "output", "--train="],
    few_shot: ["questions", "output"],
    self_check: [],
    evaluate: ["references", "predictions", "split", "reference_access", "--output=", "--overwrite"],
    create_submission: ["questions", "predictions", "output"],
    validate_submission: ["questions", "submission"],
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexforge")
    commands = parser.add_subparsers(required=True)
    for function, names in COMMANDS.items():
        sub = commands.add_parser(function.__name__.replace("_", "-"))
        for name in names:
            if name.endswith("="):
                sub.add_argument(name[:-1])
            elif name.startswith("--"):
                sub.add_argument(name, action="store_true")
            else:
                sub.add_argument(name)
        sub.set_defaults(function=function)
    args = parser.parse_args(argv)
    try:
        args.function(args)
    except (ValueError, PermissionError, FileExistsError, FileNotFoundError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0
