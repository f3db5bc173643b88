import pytest
from pyspark.sql import functions as F

from chartloom.operators import survey
from chartloom.streaming import committed, repair
from tests.test_survey import DICT, ROWS, SCHEMA, fields, result, rows  # noqa: F401


@pytest.fixture(scope="module")
def prepared(rows, fields):  # noqa: F811
    return survey.prepare_cases(rows, fields)


GOOD = result("S02-P01", "CONFIRMED_POSITIVE", ["[O002] sep3_v3 (current stay): sepsis from coli"])
BAD = result("S04-P01", "SUSPECTED_PROBABLE", ["[O001] sep4_v3 (current stay): Yes"])
UNKNOWN = result("S04-P01", "INDETERMINATE_INSUFFICIENT_DATA")


def run(spark, prepared, store, rounds, calls, max_attempts=3):
    prompts = spark.createDataFrame([("S02-P01", "p"), ("S04-P01", "p")], "case_id string, prompt string")

    def answer(asked, attempt):
        calls.append((attempt, sorted(r.case_id for r in asked.collect())))
        made = rounds[attempt - 1]
        if isinstance(made, Exception):
            raise made
        return spark.createDataFrame(made, SCHEMA)

    out = repair.repair(prepared, prompts, answer, store, "t", max_attempts)
    return {r.case_id: (r.state, r.attempt, r.phenotype_status) for r in out.results.collect()}, out.violations.count()


def test_stops_when_all_pass_and_goes_on_after_a_crash(spark, prepared, tmp_path):
    calls, store = [], str(tmp_path / "s")
    with pytest.raises(RuntimeError):
        run(spark, prepared, store, [[GOOD, BAD], RuntimeError("killed")], calls)
    done, wrong = run(spark, prepared, store, [RuntimeError("asked twice"), [UNKNOWN]], calls)
    assert calls == [(1, ["S02-P01", "S04-P01"]), (2, ["S04-P01"]), (2, ["S04-P01"])]
    assert done == {"S02-P01": ("passed", 1, "CONFIRMED_POSITIVE"), "S04-P01": ("passed", 2, "INDETERMINATE_INSUFFICIENT_DATA")} and wrong == 1
    assert committed.commits(spark, f"{store}/answers").count() == 2


def test_failed_and_missing_answers_are_held(spark, prepared, tmp_path):
    calls = []
    done, wrong = run(spark, prepared, str(tmp_path / "s"), [[BAD], [GOOD]], calls, max_attempts=2)
    assert done["S02-P01"] == ("passed", 2, "CONFIRMED_POSITIVE")
    assert done["S04-P01"][:2] == ("held", 2) and wrong == 3


def test_lines_of_patients_with_many_observations_stay_apart(spark):
    lines = spark.createDataFrame([(7, "f", "x"), (1234, "f", "x")], "observation long, field string, response string")
    got = [r[0] for r in lines.select(survey.observation_line(F.lit(survey.CURRENT))).collect()]
    assert got == ["[O007] f (current stay): x", "[O1234] f (current stay): x"]
