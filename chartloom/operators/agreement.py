"""Agreement between human and model answers.

Every metric is one aggregate of counts followed by arithmetic on those counts,
so all of it combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions import values
from chartloom.functions.text import strip
from chartloom.operators import quality

COUNTS = ("tp", "fp", "fn", "tn")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def binary_counts(human: Column, model: Column) -> list[Column]:
    """tp, fp, fn, tn over pairs with both answers known."""
    return [
        _count(human & model).alias("tp"),
        _count(~human & model).alias("fp"),
        _count(human & ~model).alias("fn"),
        _count(~human & ~model).alias("tn"),
    ]


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Agreement figures from tp, fp, fn, tn.

    Without pairs every figure is 0. A share with nothing to divide by is 100.
    Kappa without chance disagreement is 1 for full agreement, else 0.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in COUNTS)
    n = tp + fp + fn + tn
    po = (tp + tn) / n
    pe = (tp + fn) / n * ((tp + fp) / n) + (tn + fp) / n * ((tn + fn) / n)
    kappa = F.when(F.abs(1 - pe) > 1e-9, (po - pe) / (1 - pe)).when(po == 1, 1.0).otherwise(0.0)

    def share(part: Column, whole: Column) -> Column:
        return F.when(n == 0, 0.0).when(whole > 0, F.round(part / whole * 100, 1)).otherwise(100.0)

    kept = [c for c in counts.columns if c not in COUNTS]
    return counts.select(
        *kept,
        n.cast("bigint").alias("total_evaluated"),
        F.when(n == 0, 0.0).otherwise(F.round(po * 100, 1)).alias("overall_agreement_pct"),
        F.when(n == 0, 0.0).otherwise(F.round(kappa, 3)).alias("cohens_kappa"),
        share(tp, tp + fn).alias("sensitivity"),
        share(tn, tn + fp).alias("specificity"),
        share(tp, tp + fp).alias("ppv"),
        share(tn, tn + fn).alias("npv"),
        *(F.col(c).cast("bigint").alias(c) for c in COUNTS),
    )


def binary_agreement(pairs: DataFrame, human: str = "human_positive", model: str = "llm_positive",
                     by: Sequence[str] = ()) -> DataFrame:
    """One row of figures, or one per group of ``by``."""
    counts = binary_counts(F.col(human).cast("boolean"), F.col(model).cast("boolean"))
    return binary_metrics(pairs.groupBy(*by).agg(*counts))


def confidence_stratum(confidence: Column) -> Column:
    text = strip(confidence.cast("string"))
    return F.when(text.isin("4", "5"), "high_confidence_4_5").when(text.isin("1", "2", "3"), "low_confidence_1_3")


def stratified_agreement(pairs: DataFrame, confidence: str = "conf1", human: str = "human_positive",
                         model: str = "llm_positive") -> DataFrame:
    """Agreement for surely and less surely answered cases."""
    rows = pairs.withColumn("stratum", confidence_stratum(F.col(confidence))).filter(
        F.col("stratum").isNotNull() & F.col(human).isNotNull() & F.col(model).isNotNull()
    )
    return binary_agreement(rows, human, model, by=["stratum"])


LABELS = ("1", "2", "3")


def _cell(human: str, model: str) -> str:
    return f"cell_{human}_{model}"


def gate_cells(pairs: DataFrame, human: str = "h_gate", model: str = "l_gate") -> DataFrame:
    """The nine cells of the three-way table as one row."""
    h, l = F.col(human), F.col(model)
    return pairs.agg(*(_count((h == a) & (l == b)).alias(_cell(a, b)) for a in LABELS for b in LABELS))


def gate_matrix(cells: DataFrame) -> DataFrame:
    """The table in long form, empty cells included."""
    rows = [
        F.struct(F.lit(a).alias("human"), F.lit(b).alias("model"), F.col(_cell(a, b)).alias("n"))
        for a in LABELS for b in LABELS
    ]
    return cells.select(F.explode(F.array(*rows)).alias("cell")).select("cell.*")


def gate_figures(cells: DataFrame) -> DataFrame:
    """Paired n, agreement, plain kappa and kappa weighted along no-unsure-yes."""
    grid = {(a, b): F.col(_cell(a, b)).cast("double") for a in LABELS for b in LABELS}
    total = sum(grid.values())
    row = {a: sum(grid[a, b] for b in LABELS) for a in LABELS}
    col = {b: sum(grid[a, b] for a in LABELS) for b in LABELS}
    expected = {(a, b): row[a] * col[b] / total for a in LABELS for b in LABELS}
    po = sum(grid[a, a] for a in LABELS) / total
    pe = sum(expected[a, a] for a in LABELS) / total
    plain = F.when(F.abs(1 - pe) > 1e-9, F.round((po - pe) / (1 - pe), 3)).when(
        F.abs(po - 1) <= 1e-9, 1.0).otherwise(0.0)
    place = {"2": 0, "3": 1, "1": 2}
    weight = {(a, b): abs(place[a] - place[b]) / 2 for a in LABELS for b in LABELS}
    seen = sum(weight[k] * grid[k] for k in grid)
    chance = sum(weight[k] * expected[k] for k in grid)
    weighted = F.when(F.abs(chance) > 1e-9, F.round(1 - seen / chance, 3)).when(
        F.abs(seen) <= 1e-9, 1.0).otherwise(0.0)

    def known(value: Column) -> Column:
        return F.when(total == 0, 0.0).otherwise(value)

    return cells.select(
        total.cast("bigint").alias("paired_n"),
        known(F.round(po * 100, 1)).alias("overall_agreement_pct"),
        known(plain).alias("unweighted_kappa"),
        known(weighted).alias("linear_weighted_kappa"),
    )


# ------------------------------------------------------------------ survey rows of two reviewers
def join_keys(human: DataFrame, model: DataFrame) -> list[str]:
    """``vid``, plus institution and record where both sides fill them throughout. One small aggregate per side."""
    optional = ["institution_v3", "record_id"]

    def filled(rows: DataFrame) -> set[str]:
        def gaps(column: str) -> Column:
            if column not in rows.columns:
                return F.count(F.lit(1)).alias(column)
            return F.count_if(F.coalesce(strip(F.col(column).cast("string")), F.lit("")) == "").alias(column)

        counts = rows.agg(*(gaps(c) for c in optional)).first()
        return {c for c in optional if not counts[c]}

    both = filled(human) & filled(model)
    return [c for c in optional if c in both] + ["vid"]


def pair_rows(human: DataFrame, model: DataFrame, keys: Sequence[str] | None = None, strict: bool = True) -> DataFrame:
    """Full outer join of both sides: columns ``h_*``, ``l_*`` and ``side``.

    Repeated keys would be counted as further encounters, so they stop the job
    unless ``strict`` is off; ``quality.survey_key_violations`` lists them.
    """
    keys = list(keys or join_keys(human, model))
    if strict:
        quality.require_clean(quality.survey_key_violations(human, keys, "human").unionByName(quality.survey_key_violations(model, keys, "model")))

    def prepared(rows: DataFrame, prefix: str) -> DataFrame:
        clean = [strip(F.col(k).cast("string")).alias(f"{prefix}key_{k}") for k in keys]
        return rows.select(*clean, *(F.col(c).cast("string").alias(prefix + c) for c in rows.columns))

    h, l = prepared(human, "h_"), prepared(model, "l_")
    match = [F.col(f"h_key_{k}") == F.col(f"l_key_{k}") for k in keys]
    side = (
        F.when(F.col("l_key_vid").isNull(), "human_only").when(F.col("h_key_vid").isNull(), "model_only")
        .otherwise("matched")
    )
    wanted = ("institution_v3", "record_id", "conf1", "sepsis_ync_v3", "sepsis_uncertain_v3", "sep3_v3", "sep6_v3",
              "sep7_v3", "sep_day_v3", "sep_dt_v3", "sep_days", *fixed.AGREEMENT_ITEMS)
    joined = h.join(l, match, "full_outer").withColumn("side", side)
    for name in wanted:
        for prefix in ("h_", "l_"):
            if prefix + name not in joined.columns:
                joined = joined.withColumn(prefix + name, F.lit(None).cast("string"))
    return joined.withColumns(
        {
            "h_gate": values.gate_code(F.col("h_sepsis_ync_v3")),
            "l_gate": values.gate_code(F.col("l_sepsis_ync_v3")),
            "h_follow": values.gate_code(F.col("h_sepsis_uncertain_v3")),
            "l_follow": values.gate_code(F.col("l_sepsis_uncertain_v3")),
            "h_resolved": values.resolved_gate(F.col("h_sepsis_ync_v3"), F.col("h_sepsis_uncertain_v3")),
            "l_resolved": values.resolved_gate(F.col("l_sepsis_ync_v3"), F.col("l_sepsis_uncertain_v3")),
        }
    ).withColumn("shared_open", F.coalesce(F.col("h_resolved") & F.col("l_resolved"), F.lit(False)))


def key_counts(pairs: DataFrame) -> DataFrame:
    """Matched and one-sided encounters, and branches both sides opened."""
    return pairs.agg(
        _count(F.col("side") == "matched").alias("matched_encounters"),
        _count(F.col("side") == "human_only").alias("human_only_encounters"),
        _count(F.col("side") == "model_only").alias("llm_only_encounters"),
        _count((F.col("side") == "matched") & F.col("shared_open")).alias("shared_open_branch_n"),
    )


def matched(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("side") == "matched")


def resolved_agreement(pairs: DataFrame) -> DataFrame:
    """Agreement after the follow-up question, and how often it stays open."""
    rows = matched(pairs)
    counts = rows.agg(
        *binary_counts(F.col("h_resolved"), F.col("l_resolved")),
        _count(F.col("h_resolved").isNull()).alias("unresolved_human_n"),
        _count(F.col("l_resolved").isNull()).alias("unresolved_llm_n"),
    )
    return binary_metrics(counts)


def item_agreement(pairs: DataFrame, items: Sequence[str] = fixed.AGREEMENT_ITEMS) -> DataFrame:
    """Agreement per checkbox and on culture sign inside shared open branches."""
    cells = [
        F.struct(
            F.lit(item).alias("field"),
            values.yes_no(F.col("h_" + item)).alias("h"),
            values.yes_no(F.col("l_" + item)).alias("l"),
            F.lit(None).cast("double").alias("overlap"),
        )
        for item in items
    ]
    hc, lc = values.culture_positive(F.col("h_sep3_v3")), values.culture_positive(F.col("l_sep3_v3"))
    overlap = values.jaccard(values.organism_tokens(F.col("h_sep3_v3")), values.organism_tokens(F.col("l_sep3_v3")))
    cells.append(
        F.struct(F.lit("sep3_v3_positive").alias("field"), hc.alias("h"), lc.alias("l"),
                 F.when(hc & lc, overlap).alias("overlap"))
    )
    rows = matched(pairs).filter("shared_open").select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    counts = rows.groupBy("field").agg(
        *binary_counts(F.col("h"), F.col("l")),
        F.count(F.lit(1)).alias("shared_branch_n"),
        _count(F.col("l").isNull()).alias("llm_missing_count"),
        _count(F.col("h").isNull()).alias("human_missing_count"),
        F.round(F.avg("overlap"), 3).alias("organism_jaccard_mean"),
    )
    return binary_metrics(counts)


def median_of(rows: DataFrame, value: str, levels: int = 10) -> DataFrame:
    """Exact median from counts per distinct value.

    Values are counted before the shuffle and put in ``2 ** levels`` ranges of
    about as many distinct values each, whatever their size; the bounded table of
    range counts tells which ranges hold the middle, and values are ordered
    within those only.
    """
    counts = rows.select(F.col(value).alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    size = 1 << levels
    # The limits only deal out the work; the result does not depend on how near they are.
    limits = counts.agg(F.percentile_approx("v", [k / size for k in range(1, size)], 8 * size).alias("limits")).scalar()
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(levels))))
    bounded = counts.withColumn("limits", limits)
    place = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get("limits", at + s - 1) < F.col("v"), s).otherwise(0))
    ranged = bounded.select("v", "n", place.alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("size"))
    starts = totals.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("all"), "size")
    middle = starts.filter((F.col("start") < F.floor(F.col("all") / 2) + 1) & (F.col("start") + F.col("size") >= F.floor((F.col("all") + 1) / 2)))
    upto = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(middle.select("range", "start", "all"), "range").select("v", "n", (F.col("start") + F.sum("n").over(upto)).alias("last"), "all")
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    first = F.col("last") - F.col("n") + 1
    return placed.agg(
        ((F.max(F.when((first <= low) & (low <= F.col("last")), F.col("v")))
          + F.max(F.when((first <= high) & (high <= F.col("last")), F.col("v")))) / 2).alias("median")
    )


def numeric_columns(h: str = "h_", l: str = "l_") -> dict[str, Column]:
    """Errors of the quantitative answers of a pair; null when a side is silent."""

    def number(side: str, name: str) -> Column:
        return values.first_number(F.col(side + name))

    hs, ls = values.number_list(F.col(h + "sep7_v3")), values.number_list(F.col(l + "sep7_v3"))
    both = (F.size(hs) > 0) & (F.size(ls) > 0)
    hours = [
        number(side, "sep_days") * 24 + values.clock_minutes(F.col(side + "sep_dt_v3")) / 60 for side in (h, l)
    ]
    return {
        "lactate_error": F.abs(number(h, "sep6_v3") - number(l, "sep6_v3")),
        "score_day0_error": F.when(both, F.abs(F.get(hs, F.lit(0)) - F.get(ls, F.lit(0)))),
        "score_peak_error": F.when(both, F.abs(F.array_max(hs) - F.array_max(ls))),
        "rise_day_error": F.abs(number(h, "sep_day_v3") - number(l, "sep_day_v3")),
        "onset_day_error": F.abs(number(h, "sep_days") - number(l, "sep_days")),
        "onset_hour_error": F.abs(hours[0] - hours[1]),
    }


def error_figures(rows: DataFrame, errors: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per named error: n, mean, share exact and share within a tolerance."""
    cells = [
        F.struct(F.lit(name).alias("metric"), error.cast("double").alias("e"), F.lit(float(limit)).alias("limit"))
        for name, (error, limit) in errors.items()
    ]
    long = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    n = F.count("e")

    def pct(condition: Column) -> Column:
        return F.when(n > 0, F.round(100.0 * _count(condition) / n, 1))

    return long.groupBy("metric").agg(
        n.alias("paired_n"),
        F.round(F.avg("e"), 3).alias("mean_error"),
        pct(F.col("e") == 0).alias("exact_pct"),
        pct(F.col("e") <= F.col("limit") + 1e-9).alias("within_pct"),
    )


def numeric_agreement(pairs: DataFrame) -> DataFrame:
    """Lactate, score and timing errors inside shared open branches.

    The tolerance of ``within_pct`` is 0.2 for lactate and 1 elsewhere. The
    median is given for lactate.
    """
    rows = matched(pairs).filter("shared_open")
    errors = numeric_columns()
    limits = {"lactate_error": 0.2}
    figures = error_figures(rows, {k: (c, limits.get(k, 1.0)) for k, c in errors.items()})
    middle = median_of(rows.select(errors["lactate_error"].alias("e")), "e").select(
        F.lit("lactate_error").alias("metric"), F.round("median", 3).alias("median_error")
    )
    return figures.join(middle, "metric", "left")


def evidence_lookup(evidence: DataFrame) -> DataFrame:
    """First evidence of each field and of each visit, one row per visit.

    ``evidence_order`` gives the order when the table has it. The map has one
    entry per field name of the instrument.
    """
    order = F.col("evidence_order") if "evidence_order" in evidence.columns else F.struct("source_ref", "evidence_quote")
    item = F.struct(F.col("evidence_quote").alias("quote"), F.col("source_ref").alias("ref"))
    key = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("record_id", "vid", "field_name")]
    per_field = evidence.select(*key, order.alias("place"), item.alias("item")).groupBy(
        "record_id", "vid", "field_name"
    ).agg(F.min(F.struct("place", "item")).alias("first"))
    return per_field.groupBy("record_id", "vid").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", F.col("first.item")))).alias("by_field"),
        F.min("first").getField("item").alias("any_field"),
    )


def discrepancies(pairs: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Every difference between both sides, with the model's evidence for it."""
    errors = numeric_columns()
    opened = F.col("shared_open")

    def row(condition: Column, field: str, human: Column, model: Column) -> Column:
        cell = F.struct(F.lit(field).alias("field"), F.coalesce(human, F.lit("")).alias("human_value"),
                        F.coalesce(model, F.lit("")).alias("llm_value"))
        return F.when(F.coalesce(condition, F.lit(False)), cell)

    def flag(value: Column) -> Column:
        return F.when(value, "1").when(~value, "0")

    def raw(name: str) -> tuple[Column, Column]:
        return F.col("h_" + name), F.col("l_" + name)

    both_unsure = (F.col("h_gate") == "3") & (F.col("l_gate") == "3")
    hc, lc = (values.culture_positive(c) for c in raw("sep3_v3"))
    cells = [
        row(F.col("h_gate") != F.col("l_gate"), "sepsis_ync_v3", F.col("h_gate"), F.col("l_gate")),
        row(both_unsure & ~F.col("h_follow").eqNullSafe(F.col("l_follow")), "sepsis_uncertain_v3",
            F.col("h_follow"), F.col("l_follow")),
        row(F.col("h_resolved") != F.col("l_resolved"), "gate_resolved", flag(F.col("h_resolved")),
            flag(F.col("l_resolved"))),
    ]
    for item in fixed.AGREEMENT_ITEMS:
        h, l = (values.yes_no(c) for c in raw(item))
        cells.append(row(opened & (h != l), item, flag(h), flag(l)))
    cells.append(row(opened & (hc != lc), "sep3_v3_positive", *raw("sep3_v3")))
    for error, limit, name in (
        ("lactate_error", 0.2, "sep6_v3"), ("score_peak_error", 1.0, "sep7_v3"),
        ("rise_day_error", 0.0, "sep_day_v3"), ("onset_day_error", 0.0, "sep_days"),
    ):
        cells.append(row(opened & (errors[error] > limit), name, *raw(name)))

    def either(name: str) -> Column:
        return F.coalesce(F.nullif(F.col("h_" + name), F.lit("")), F.col("l_" + name), F.lit(""))

    long = matched(pairs).select(
        either("institution_v3").alias("institution_v3"), either("record_id").alias("record_id"),
        either("vid").alias("vid"),
        strip(F.coalesce("l_record_id", F.lit(""))).alias("e_record"), strip(F.col("l_vid")).alias("e_vid"),
        F.coalesce("h_conf1", F.lit("")).alias("clinician_conf1"),
        F.explode(F.array_compact(F.array(*cells))).alias("cell"),
    ).select("*", "cell.*")
    found = F.lit(None).cast("struct<quote:string,ref:string>")
    if evidence is not None:
        first = evidence_lookup(evidence).withColumnsRenamed({"record_id": "e_record", "vid": "e_vid"})
        long = long.join(first, ["e_record", "e_vid"], "left")
        found = F.coalesce(
            F.col("by_field")[F.col("field")], F.col("by_field")[F.split("field", "___")[0]], F.col("any_field")
        )
    return long.withColumn("found", found).select(
        "institution_v3", "record_id", "vid", "field", "human_value", "llm_value", "clinician_conf1",
        values.discrepancy_category(F.col("field")).alias("discrepancy_category"),
        F.coalesce("found.quote", F.lit("")).alias("llm_evidence_quote"),
        F.coalesce("found.ref", F.lit("")).alias("llm_source_ref"),
    )


def evaluate(human: DataFrame, model: DataFrame, evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """All comparisons of two survey tables, as small metric tables."""
    pairs = pair_rows(human, model)
    cells = gate_cells(matched(pairs))
    resolved = matched(pairs).select(
        F.col("h_resolved").alias("human_positive"), F.col("l_resolved").alias("llm_positive"),
        F.col("h_conf1").alias("conf1"),
    )
    return {
        "keys": key_counts(pairs),
        "gate_matrix": gate_matrix(cells),
        "gate": gate_figures(cells),
        "resolved": resolved_agreement(pairs),
        "by_confidence": stratified_agreement(resolved),
        "items": item_agreement(pairs),
        "numeric": numeric_agreement(pairs),
        "discrepancies": discrepancies(pairs, evidence),
    }


def report(results: dict[str, DataFrame], shown: int = 20) -> str:
    """Markdown text. Only metric rows and ``shown`` discrepancies are collected."""

    def table(name: str, order: Sequence[str] = ()) -> str:
        df = results[name].orderBy(*order) if order else results[name]
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.collect()]
        return "\n".join(lines)

    total = results["discrepancies"].count()
    first = results["discrepancies"].orderBy("institution_v3", "record_id", "vid", "field").limit(shown).collect()
    parts = ["# Agreement of human and model survey answers", "## Encounters", table("keys"),
             "## Three-way gate", table("gate"), table("gate_matrix", ["human", "model"]),
             "## Gate after follow-up", table("resolved"), table("by_confidence", ["stratum"]),
             "## Items in shared open branches", table("items", ["field"]),
             "## Quantities and timing", table("numeric", ["metric"]), f"## Discrepancies ({total})"]
    parts += [
        f"- record `{r.record_id}`, visit `{r.vid}`, `{r.field}`: human `{r.human_value}`, "
        f"model `{r.llm_value}` ({r.discrepancy_category})"
        for r in first
    ]
    return "\n\n".join(parts) + "\n"
