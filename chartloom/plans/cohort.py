"""The whole staged abstraction of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators import abstraction, charts, facts
from chartloom.schemas import PANEL_NOTE, with_missing
from chartloom.functions import values
from chartloom.session import reliable_checkpoint


def abstract_cohort(
    notes: DataFrame, visits: DataFrame, measurements: DataFrame, drugs: DataFrame, cultures: DataFrame, run_ts: str,
    institution: str = "", strict_rise: bool = False, answers: abstraction.StageAnswers | None = None,
    backend: str = "keyword_rules", model: str | None = None,
) -> abstraction.Abstraction:
    """Survey rows, adjudications and evidence of every visit.

    Without ``answers`` the built-in rules answer all stages. Facts and note
    signals are narrow (a row per visit, a row per note) and read several times,
    so they are checkpointed; texts and measurements are read once.
    """
    typed = with_missing(notes, PANEL_NOTE)
    note_times = typed.select(
        values.visit_key(F.col("visit_occurrence_id")).alias("vid"), charts.note_moment(typed).alias("moment"))
    tables = facts.chart_tables(visits, measurements, drugs, cultures, note_times, institution)
    measured = tables.measurements.select("vid").union(tables.drugs.select("vid")).union(tables.cultures.select("vid")).distinct()
    fact_rows = facts.structured_facts(tables.anchors, tables.measurements, tables.drugs, tables.cultures, strict_rise)
    fact_rows = reliable_checkpoint(
        fact_rows.join(measured.withColumn("has_structured", F.lit(True)), "vid", "left")
        .withColumn("has_structured", F.coalesce("has_structured", F.lit(False)))
    )
    panels = charts.panel_notes(notes, tables.anchors)

    def lines(holding=None) -> DataFrame:
        return charts.structured_lines(tables.measurements, tables.cultures, tables.drugs, tables.anchors, holding)

    if answers is None:
        # Lines without a signal leave no trace in an answer, so they meet no reference time.
        signals = reliable_checkpoint(abstraction.visit_signals(reliable_checkpoint(abstraction.piece_signals(panels, lines(abstraction.may_signal)))))
        answers = abstraction.rule_answers(signals, fact_rows)
    else:
        answers = abstraction.grounded_answers(answers, charts.stage_pieces(panels, lines()))
    return abstraction.merge(fact_rows, answers, facts.provenance(fact_rows, tables.cultures), run_ts, backend, model)
