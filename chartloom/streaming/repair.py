"""Repair rounds of survey answers as a run that stops by itself.

Every round asks the open cases, commits the answers, checks them and commits
what is wrong. Clean cases leave; the others are asked again with all
corrections so far, or held after the last round. Answers and violations are
committed per round, so a killed run goes on with the round it was in and asks
no case twice for the same round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.operators import survey
from chartloom.schemas import ADJUDICATION
from chartloom.session import reliable_checkpoint
from chartloom.streaming import committed

_ANSWERED = ("phenotype_status", "condition_present", "confidence_score", "clinical_rationale", "primary_criteria_met", "key_evidence", "inference_backend")
ANSWER = T.StructType([T.StructField("case_id", T.StringType()), *(f for f in ADJUDICATION.fields if f.name in _ANSWERED)])
# The store has a column "attempt" of its own, for tries to write a round.
VIOLATION = T.StructType([*(T.StructField(n, T.StringType()) for n in ("case_id", "check", "message")), T.StructField("round", T.IntegerType())])


@dataclass
class Repaired:
    """``results`` has the columns of ``ANSWER`` with ``state`` (passed or held) and ``attempt``."""

    results: DataFrame
    violations: DataFrame


def repair(
    prepared: survey.SurveyCases, prompts: DataFrame, answer: Callable[[DataFrame, int], DataFrame], store: str, run_ts: str, max_attempts: int = 3,
) -> Repaired:
    """Ask, check and ask again until every case passed or is held.

    ``prompts``: ``case_id, prompt`` of all cases. ``answer`` gets the open
    prompts and the round and returns one row of ``ANSWER`` a case; a case
    without a row counts as a failed answer of that round.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be positive")
    spark = prompts.sparkSession
    facts = reliable_checkpoint(survey.case_facts(prepared))
    asked, ended = prompts.select("case_id", "prompt"), []

    def committed_round(part: str, schema: T.StructType, attempt: int, make: Callable[[], DataFrame]) -> DataFrame:
        folder, run_id = f"{store}/{part}", f"round-{attempt}"
        if committed.commits(spark, folder).filter(F.col("run_id") == run_id).isEmpty():
            committed.append_run(make(), folder, run_id, run_ts, schema)
        return committed.results(spark, folder, schema).filter(F.col("run_id") == run_id).drop("run_id")

    for attempt in range(1, max_attempts + 1):
        questions = asked
        answers = committed_round("answers", ANSWER, attempt, lambda: questions.select("case_id").join(answer(questions, attempt), "case_id", "left"))
        found = committed_round("violations", VIOLATION, attempt, lambda: survey.round_violations(answers, prepared, attempt, facts).withColumnRenamed("attempt", "round"))
        history = committed.results(spark, f"{store}/violations", VIOLATION).filter(F.col("round") <= attempt).drop("run_id").withColumnRenamed("round", "attempt")
        outcome = survey.close_round(answers, found, history, attempt, max_attempts)
        ended += [df.withColumns({"state": F.lit(state), "attempt": F.lit(attempt)}) for df, state in ((outcome.passed, "passed"), (outcome.held, "held"))]
        asked = reliable_checkpoint(outcome.prompts.select("case_id", "prompt"))
        if asked.isEmpty():
            break
    results = ended[0]
    for part in ended[1:]:
        results = results.unionByName(part)
    return Repaired(results, history)
