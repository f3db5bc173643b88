"""SQL text shared by several checks."""

from __future__ import annotations

from chartloom.operators.rules import RuleSet

EDGE = r"[^\p{L}\p{N}_]"
COUNTS = """sum(CASE WHEN h AND m THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT h AND m THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN h AND NOT m THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT h AND NOT m THEN 1 ELSE 0 END) AS tn"""


def agreement(counts: str, keep: str = "") -> str:
    """Agreement figures from a SELECT with tp, fp, fn, tn."""
    keep = keep + ", " if keep else ""

    def share(part: str, whole: str) -> str:
        return f"CASE WHEN n = 0 THEN 0.0 WHEN {whole} > 0 THEN round({part} / ({whole}) * 100, 1) ELSE 100.0 END"

    return f"""SELECT {keep}CAST(n AS BIGINT) AS total_evaluated,
      CASE WHEN n = 0 THEN 0.0 ELSE round((tp + tn) / n * 100, 1) END AS overall_agreement_pct,
      CASE WHEN n = 0 THEN 0.0 WHEN abs(1 - pe) > 1e-9 THEN round(((tp + tn) / n - pe) / (1 - pe), 3)
           WHEN tp + tn = n THEN 1.0 ELSE 0.0 END AS cohens_kappa,
      {share("tp", "tp + fn")} AS sensitivity, {share("tn", "tn + fp")} AS specificity,
      {share("tp", "tp + fp")} AS ppv, {share("tn", "tn + fn")} AS npv,
      CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
      FROM (SELECT *, (tp + fn) / n * ((tp + fp) / n) + (tn + fp) / n * ((tn + fn) / n) AS pe
            FROM (SELECT *, tp + fp + fn + tn AS n
                  FROM (SELECT * REPLACE (CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(coalesce(fp, 0) AS DOUBLE) AS fp,
                        CAST(coalesce(fn, 0) AS DOUBLE) AS fn, CAST(coalesce(tn, 0) AS DOUBLE) AS tn) FROM ({counts}))))"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _portable(pattern: str) -> str:
    """Word edges written so that they work for every language."""
    out = pattern
    while out.startswith(r"\b"):
        out = out[2:]
    while out.endswith(r"\b"):
        out = out[:-2]
    return out


def rule_lines(notes: str, rules: RuleSet) -> str:
    """Evidence lines of a rule set: visit, note, line and quote.

    ``notes`` selects note_id, visit_occurrence_id, note_datetime, note_text.
    Each pattern is tried in order on its first occurrence.
    """
    def negated(window: str) -> str:
        tests = []
        for pattern in rules.negative:
            head = rf"(^|{EDGE})" if pattern.startswith(r"\b") else ""
            tail = rf"({EDGE}|$)" if pattern.endswith(r"\b") else ""
            inner = _portable(pattern).replace(r")\b.*(", rf")({EDGE}|$).*(").replace(r"transfer\b.*", rf"transfer({EDGE}.*|)")
            tests.append(f"regexp_matches({window}, {_quoted('(?s)' + head + '(' + inner + ')' + tail)})")
        return " OR ".join(tests)

    cases = []
    for number, pattern in enumerate(rules.positive):
        core = _portable(pattern)
        found = rf"(?s)^(.*?(?:^|{EDGE}))({core})(?:{EDGE}|$)"
        at = f"length(regexp_extract(low, {_quoted(found)}, 1))"
        hit = f"regexp_extract(low, {_quoted(found)}, 2)"
        end = f"({at} + length({hit}))"
        high = f"{end if rules.from_match_end else at} + {rules.after}"
        window = f"substr(low, greatest({at} - {rules.before}, 0) + 1, {high} - greatest({at} - {rules.before}, 0))"
        low, stop = f"greatest({at} - 50, 0)", f"{end} + 70"
        quote = (f"CASE WHEN {low} > 0 THEN '...' ELSE '' END || trim(substr(line, {low} + 1, {stop} - {low}))"
                 f" || CASE WHEN {stop} < length(line) THEN '...' ELSE '' END")
        term = hit if rules.show_terms else str(number)
        cases.append(
            f"WHEN regexp_matches(low, {_quoted(found)}) AND NOT ({negated(window)}) "
            f"THEN {{'term': CAST({term} AS VARCHAR), 'quote': {quote}}}"
        )
    skip = " AND ".join(f"NOT contains(low, {_quoted(s)})" for s in rules.skipped_lines) or "true"
    return f"""SELECT visit_occurrence_id, note_id, note_datetime, line_no, hit.term AS term, hit.quote AS quote
      FROM (SELECT *, CASE WHEN NOT ({skip}) THEN NULL {' '.join(cases)} END AS hit
            FROM (SELECT *, lower(line) AS low
                  FROM (SELECT visit_occurrence_id, note_id, note_datetime, trim(unnest(string_split(note_text, chr(10)))) AS line,
                        generate_subscripts(string_split(note_text, chr(10)), 1) AS line_no FROM ({notes}))))
      WHERE hit IS NOT NULL"""


def rule_decisions(notes: str, visits: str, rules: RuleSet) -> str:
    """One row per visit: status, confidence, first three quotes joined."""
    return f"""WITH noted AS ({notes}), visited AS ({visits}), ev AS ({rule_lines('SELECT * FROM noted', rules)}),
      kept AS (SELECT visit_occurrence_id, string_agg(quote, ' | ' ORDER BY note_datetime, note_id, line_no) AS quotes
        FROM (SELECT *, row_number() OVER (PARTITION BY visit_occurrence_id ORDER BY note_datetime, note_id, line_no) AS place
              FROM ev) WHERE place <= 3 GROUP BY 1),
      has AS (SELECT DISTINCT visit_occurrence_id FROM noted WHERE regexp_matches(note_text, '\\S'))
      SELECT v.visit_occurrence_id, v.person_id, k.quotes IS NOT NULL AS condition_present,
        CASE WHEN h.visit_occurrence_id IS NULL THEN 'INDETERMINATE_INSUFFICIENT_DATA'
             WHEN k.quotes IS NOT NULL THEN 'CONFIRMED_POSITIVE' ELSE 'CONFIRMED_NEGATIVE' END AS phenotype_status,
        CASE WHEN h.visit_occurrence_id IS NULL THEN 0.0 WHEN k.quotes IS NOT NULL THEN {rules.scores[0]}
             ELSE {rules.scores[1]} END::DOUBLE AS confidence_score,
        coalesce(k.quotes, '') AS quotes
      FROM visited v LEFT JOIN has h USING (visit_occurrence_id) LEFT JOIN kept k USING (visit_occurrence_id)"""
