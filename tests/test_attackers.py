import pytest

from tests.test_plans import FOLDER, equal_sql


@pytest.mark.parametrize("name", ["risk_a2", "risk_counterfactual"])
def test_linkage_has_both_attackers(spark, name):
    rows = equal_sql(spark, name, FOLDER)
    if name == "risk_a2":
        assert sorted((r.attacker_model, r.p) for r in rows) == [(m, p) for m in ("realistic", "worst_case") for p in (1, 2, 3, 4)]
