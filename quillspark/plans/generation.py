"""Answers in stages: evidence is judged, an answer drafted until its citations hold, reviewed, and put together."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language
from ..operators import evaluate
from ..sources import tables

Generator = Callable[[str, dict], str]
SPOKEN = "stage string, seconds double, ok boolean, text string, error string"
RETRIES = 2

# fixed values: what is answered where the sources don't suffice, and the headings of an answer
BOUNDARY = {"zh": "根据现有文献无法回答此问题。", "en": "Based on the available literature, this question cannot be answered."}
HEADINGS = {"zh": ("核心答案", "证据总结", "参考文献"), "en": ("Core Answer", "Evidence Summary", "References")}


def directives(lang: str) -> str:
    """What an answer in a language must keep to; languages that aren't known are answered in Chinese."""
    lang = lang if lang in BOUNDARY else "zh"
    core, evidence, _ = HEADINGS[lang]
    rules = [
        f'If the sources are not enough, answer with this sentence and nothing else: "{BOUNDARY[lang]}"',
        "Mark every statement of fact with the source it is from, as [来源 N]; use only numbers that stand in the sources.",
        "Add no facts, figures, doses or mechanisms that the sources do not hold.",
        f"Use these headings as they stand: ## {core}, then ## {evidence}.",
        "Spell an abbreviation out where it comes first.",
        {"zh": "Answer in Chinese.", "en": "Answer in English."}[lang],
    ]
    return "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))


def speak(rows: DataFrame, stage: str, generator: Generator, fields: dict[str, Column], key: str = "query_id", structured: bool = False) -> DataFrame:
    """``rows`` with ``said``: what the generator answers to ``fields`` (SPOKEN), row by row.  Rows whose call fails carry the error.  With ``structured``
    an answer must be JSON, which is repaired; one that isn't is no success."""
    names = list(fields)
    asked = rows.select(F.col(key).alias("key"), *(c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key_, *values in frame.itertuples(index=False):
                began, text, error = time.monotonic(), None, None
                try:
                    text = generator(stage, {"key": key_, **dict(zip(names, values))})
                    text = evaluate.repaired_json(text) if structured else (text or "").strip()
                except Exception as e:  # a generator may fail in any way; that is the row's result
                    error = str(e)
                out.append((key_, stage, round(time.monotonic() - began, 2), bool(text), text, error))
            yield pd.DataFrame(out, columns=["key", "stage", "seconds", "ok", "text", "error"])

    said = asked.mapInPandas(run, f"key {asked.schema['key'].dataType.simpleString()}, {SPOKEN}")
    return said.select(F.col("key").alias(key), F.struct("stage", "seconds", "ok", "text", "error").alias("said"))


def _kept(rows: DataFrame, path: str, name: str) -> DataFrame:
    """A stage's rows as written, so that no generator is asked twice for what it has answered."""
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return rows.sparkSession.read.parquet(f"{path}/{name}")


def drafts(rows: DataFrame, generator: Generator, path: str, retries: int = RETRIES, key: str = "query_id") -> DataFrame:
    """An answer for each row: key, draft, attempts, passes, error, seconds.

    rows: key, query, context, valid_ids, directives, with unique keys.  Only rows whose citations don't hold go round again, with a note of what was wrong,
    ``retries`` times at most; then citations that don't exist are taken out.  Rows whose call fails don't go round again.
    """
    left, done = rows.withColumn("note", F.lit("")), []
    for attempt in range(retries + 1):
        fields = {c: F.col(c) for c in ("query", "context", "directives", "note")}
        said = _kept(speak(left, "answer", generator, fields, key), path, f"answer-{attempt}")
        got = left.join(said, key).withColumn("draft", F.col("said.text"))
        boundary = F.coalesce(F.col("draft").isin(*BOUNDARY.values()), F.lit(False))
        checked = evaluate.check_citations(got, F.col("valid_ids"), boundary, "draft").withColumn("failed", F.col("said.error").isNotNull())
        final = F.col("failed") | F.col("passes") | F.lit(attempt == retries)
        stripped = F.when(F.col("passes"), F.col("draft")).otherwise(evaluate.strip_citations(F.col("draft"), F.col("invalid_ids")))
        tries = F.lit(attempt) + F.when(F.col("passes") | F.col("failed"), 0).otherwise(1)
        done.append(checked.where(final).select(key, stripped.alias("draft"), tries.cast("int").alias("attempts"), (F.col("passes") & ~F.col("failed")).alias("passes"), F.col("said.error").alias("error"), F.col("said.seconds").alias("seconds")))
        left = checked.where(~final).withColumn("note", evaluate.retry_note(F.col("invalid_ids"), F.col("missing_citations"))).select(*rows.columns, "note")
        left = _kept(left, path, f"again-{attempt}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def staged(rows: DataFrame, generator: Generator, judge: bool = True, review: bool = True, retries: int = RETRIES, key: str = "query_id") -> DataFrame:
    """Questions with their sources to answers: key, query, answer, draft, attempts, passes, valid_ids, evaluation, review, stages, error.

    rows: key, query, blocks (array of struct<citation_id, block>).  The generator is asked as ``generator(stage, fields)`` for
    "evaluate" (JSON with ``irrelevant``, a list of source numbers to leave out, unless that would leave none), "answer" (``drafts``), "review" (JSON with
    ``overall_verdict``) and, where that is "revise", "assemble".  Whatever comes of that, citations that don't exist are taken out at the end.  A stage that fails is left out.
    stages: stage, seconds and success, in order.  Every stage's answers are written below the shared folder, so a lost executor asks nothing again.
    """
    spark = rows.sparkSession
    path = tables.workspace(spark, "generation")
    joined = lambda b: F.array_join(F.transform(F.array_sort(b), lambda x: x["block"]), "\n")
    ids = lambda b: F.transform(b, lambda x: x["citation_id"].cast("long"))
    lang = language(F.col("query"))
    own = rows.select(key, "query", F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType)).alias("blocks"), F.when(lang == "zh", directives("zh")).otherwise(directives("en")).alias("directives"))
    steps = []

    def step(part: DataFrame, name: str, success: Column) -> None:
        steps.append(part.select(key, F.struct(F.lit(len(steps)).alias("i"), F.lit(name).alias("stage"), F.col("said.seconds").alias("seconds"), success.alias("ok")).alias("step")))

    evaluation = F.lit(None).cast("string")
    if judge:
        some = own.where(F.size("blocks") > 0)
        said = _kept(speak(some, "evaluate", generator, {"query": F.col("query"), "context": joined(F.col("blocks"))}, key, structured=True), path, "evaluate")
        step(said, "evidence_evaluation", F.col("said.ok"))
        out_ = F.coalesce(F.from_json(F.get_json_object("said.text", "$.irrelevant"), "array<int>"), F.array().cast("array<int>"))
        kept = F.filter("blocks", lambda b: ~F.array_contains(out_, b["citation_id"].cast("int")))
        own = own.join(said, key, "left").withColumn("blocks", F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))).withColumn("evaluation", F.col("said.text")).drop("said")
    else:
        own = own.withColumn("evaluation", evaluation)
    own = own.withColumns({"context": joined(F.col("blocks")), "valid_ids": ids(F.col("blocks"))})
    drafted = _kept(own.join(drafts(own.select(key, "query", "context", "valid_ids", "directives"), generator, path, retries, key), key), path, "drafts")
    steps.append(drafted.select(key, F.struct(F.lit(len(steps)).alias("i"), F.lit("answer_generation").alias("stage"), F.col("seconds"), (F.coalesce("draft", F.lit("")) != "").alias("ok")).alias("step")))
    if review:
        fields = {c: F.col(c) for c in ("query", "context", "draft")}
        said = _kept(speak(drafted.where("draft <> ''"), "review", generator, fields, key, structured=True), path, "review")
        step(said, "critical_review", F.col("said.ok"))
        drafted = drafted.join(said, key, "left").withColumn("review", F.col("said.text")).drop("said")
        revise = F.get_json_object("review", "$.overall_verdict") == "revise"
        again = _kept(speak(drafted.where(revise), "assemble", generator, {c: F.col(c) for c in ("query", "draft", "review", "directives")}, key), path, "assemble")
        verdict = drafted.where(F.col("draft") != "").join(again, key, "left")
        step(verdict.withColumn("said", F.struct(F.coalesce("said.seconds", F.lit(0.0)).alias("seconds"), F.coalesce("said.ok", F.lit(False)).alias("ok"))), "final_assembly", F.when(F.coalesce(F.get_json_object("review", "$.overall_verdict"), F.lit("")) == "revise", F.col("said.ok")).otherwise(F.col("review").isNotNull()))
        drafted = drafted.join(again, key, "left").withColumn("answer", F.coalesce(F.nullif("said.text", F.lit("")), "draft")).drop("said")
    else:
        drafted = drafted.withColumns({"review": F.lit(None).cast("string"), "answer": F.col("draft")})
    wrong = F.filter("cited_ids", lambda i: ~F.array_contains("valid_ids", i))
    checked = evaluate.check_citations(drafted.withColumnRenamed("passes", "_passes"), F.col("valid_ids"), F.lit(False), "answer")
    checked = checked.withColumn("answer", evaluate.strip_citations(F.col("answer"), wrong))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    stages = every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("step")), lambda s: F.struct(s["stage"].alias("stage"), s["seconds"].alias("seconds"), s["ok"].alias("ok"))).alias("stages"))
    return checked.join(stages, key, "left").select(key, "query", "answer", "draft", "attempts", F.col("_passes").alias("passes"), "valid_ids", "evaluation", "review", "stages", "error")


def indexed(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their place in the batch, from 0, in the order given, so that answers can be put back in order; places are counted
    within ranges of ``order`` and shifted by the ranges before, never in one task."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    kept = _kept(ranged, tables.workspace(rows.sparkSession, "indexed"), "rows")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, shifts = 0, {}
    for p, n in sizes:
        shifts[p], before = before, before + n
    shift = F.create_map(*(F.lit(x) for p, s in shifts.items() for x in (p, s))) if shifts else F.expr("cast(map() as map<bigint, int>)")
    return kept.withColumn("index", (F.try_element_at(shift, part) + F.col("_at") - F.shiftleft(part, 33)).cast("long")).drop("_at")


def sources(blocks: Column) -> Column:
    """The list of sources of an answer as JSON, by number."""
    return F.to_json(F.array_sort(blocks))


def scripted(stage: str, fields: dict) -> str:
    """A generator for tests and checks that does as the key's remainder by 5 says: 0 cites well, 1 does so when told and is revised, 2 never does, 3 fails, 4 judges nothing."""
    n = int(fields["key"]) % 5
    if stage == "evaluate":
        return "no judgement" if n == 4 else '```json\n{"irrelevant": [3],}\n```'
    if stage == "answer":
        if n == 3:
            raise ValueError("out of reach")
        return f"{fields['query'][:20].strip()} [来源 {1 if n in (0, 4) or n == 1 and fields['note'] else 7}]"
    if stage == "review":
        return json.dumps({"overall_verdict": "revise" if n == 1 else "accept"})[: -1 if n == 2 else None]
    return f"{fields['draft']} Revised [来源 3]"
