"""The calibration curve on many rows and with wrong labels."""

import numpy as np

from taxolens.llm.common import logistic_on_bins


def test_curve_rises_at_any_number_of_rows():
    for scale in (1, 10, 1000, 10**6):
        rows = [(-6.0, 900 * scale, 6 * scale), (2.0, 30 * scale, scale), (5.0, 3 * scale, 10 * scale),
                (12.0, scale, 60 * scale), (14.9, scale, 40 * scale)]
        a, b = logistic_on_bins(rows)
        p = 1 / (1 + np.exp(-(a * np.array([-6.0, 2.0, 12.0]) + b)))
        assert p[0] < 0.05 and p[1] < 0.5 and p[2] > 0.7, (scale, a, b)


def test_one_class_or_no_rows():
    assert logistic_on_bins([])[0] == 0.0 and logistic_on_bins([(1.0, 5, 0)])[0] == 0.0
