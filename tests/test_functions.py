import math

import numpy as np
import pytest

from larkspur.functions import dist, labels, naming


@pytest.mark.parametrize("name, plain", [("patientID", "patient_id"), ("OSMonths", "os_months"), ("FollowUpDays", "follow_up_days"), ("tumor-stage", "tumor_stage"), ("Patient Number", "patient_number"), ("  __x__ ", "x"), ("", "")])
def test_normalized_names(name, plain):
    assert naming.normalized(name) == plain


def test_types_by_name():
    assert naming.semantic_type("os_months").scores["Survival"] == pytest.approx(0.75)
    assert naming.semantic_type("event_type").type == "Survival"
    assert naming.semantic_type("xyz").type is None
    assert naming.survival_role("os_event").type == "Event"
    assert naming.survival_role("date_diagnosis").type == "DateTime From"
    assert naming.names_identifier("user_id") and not naming.names_identifier("l_orderkey")
    assert naming.names_date("update") and not naming.names_date("ts")


def test_labels():
    assert labels.p_label(0.0004) == "P<0.001"
    assert labels.p_label(0.004) == "P=0.004" and labels.p_label(0.004, legacy=True) == "P<0.001"
    assert labels.p_label(0.0499) == "P=0.0499" and labels.p_label(0.05) == "P=0.05"
    assert "20% lower" in labels.hazard_text(0.8, "a", "b") and "50% higher" in labels.hazard_text(1.5, "a", "b")
    assert labels.median_label(math.inf, 3, math.inf) == "not reached (95% CI 3.00 - not reached)"
    assert labels.number(None) == labels.MISSING and labels.integer(1234.0) == "1,234"


def test_tails():
    assert dist.chi2_tail(0.2937239551, 1) == pytest.approx(0.5878439558, abs=1e-9)
    assert dist.chi2_tail(1.2360025672, 4) == pytest.approx(math.exp(-0.6180012836) * 1.6180012836, abs=1e-12)
    assert dist.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert dist.kolmogorov_tail(0.274, 10) == pytest.approx(1 - 0.6284796154565043, abs=1e-9)
    assert dist.lilliefors_tail(0.886 / math.sqrt(100) + 0.0005, 100) == pytest.approx(0.05, abs=0.006)
    assert dist.anderson_tail(0.1, 50) == 0.15 and dist.anderson_tail(9, 50) == 0.01


def test_shapiro_against_the_published_example():
    # Royston's weights of men: the data of Shapiro and Wilk (1965), for which W = 0.79.
    w, p = dist.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)


def test_shapiro_of_normal_scores():
    w, p = dist.shapiro_wilk(np.array([dist.NORMAL.inv_cdf((i - 0.375) / 40.25) for i in range(1, 41)]))
    assert w > 0.99 and p > 0.9
    assert dist.shapiro_wilk(np.array([1.0, 2.0, 4.0]))[0] == pytest.approx(0.9643, abs=1e-3)
