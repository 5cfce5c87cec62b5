import math

import numpy as np
import pytest

from hushframe.account import events, pld, rdp
from hushframe.account.calibrate import calibrate_noise, calibrate_steps, epsilon
from hushframe.functions import special


def test_published_anchors():
    assert round(pld.epsilon([events.poisson(3.0, 512, 0.1)], 1e-6), 2) == 3.77
    assert round(calibrate_noise(lambda s: events.poisson(s, 512, 0.1), 1.0, 1e-6, low=5, high=20, tolerance=1e-4), 2) == 9.66
    assert calibrate_steps(lambda t: events.poisson(3.0, t, 0.1), 2.0, 1e-6, most=512) == 155


def test_gaussian_matches_its_closed_form():
    from hushframe.operators.audit import gaussian_delta, gaussian_epsilon

    assert pld.epsilon([events.gaussian(2.0, 4)], 1e-5) == pytest.approx(gaussian_epsilon(1.0, 1e-5), rel=2e-3)
    assert pld.delta([events.gaussian(1.0)], 1.0) == pytest.approx(gaussian_delta(1.0, 1.0), rel=2e-2)
    assert rdp.epsilon([events.gaussian(2.0, 4)], 1e-5) >= gaussian_epsilon(1.0, 1e-5)


@pytest.mark.parametrize("event", [events.gaussian, lambda s: events.poisson(s, 128, 0.01), lambda s: events.fixed_size(s, 128, 1000, 16), lambda s: events.banded(s, 128, 16, 0.16), lambda s: events.truncated(s, 128, 0.01, 1000, 16)])
def test_round_trip_and_monotone(event):
    sigma = calibrate_noise(event, 1.0, 1e-6, accountant="rdp", low=0.5, high=50)
    assert epsilon([event(sigma)], 1e-6, "rdp") == pytest.approx(1.0, abs=1e-4)
    found = [epsilon([event(s)], 1e-6, "rdp") for s in (1.0, 2.0, 4.0)]
    assert found == sorted(found, reverse=True)
    assert all(x >= 0 for x in found)


def test_orders_agree_and_rates_matter():
    assert rdp.poisson_gaussian(3.0001, 2.0, 0.1) == pytest.approx(rdp.poisson_gaussian(3, 2.0, 0.1), rel=1e-3)
    assert rdp.poisson_gaussian(4, 2.0, 1.0) == 4 / 8
    assert rdp.epsilon([events.poisson(1.0, 10, 0.0)], 1e-6) < 1e-1
    assert rdp.epsilon([events.gaussian(0.0)], 1e-6) == math.inf


def test_arguments():
    with pytest.raises(ValueError):
        events.poisson(-1.0, 1, 0.5)
    with pytest.raises(ValueError):
        events.poisson(1.0, 1, 1.5)
    with pytest.raises(ValueError):
        events.fixed_size(1.0, 1, 10, 11)
    assert events.zcdp_rho(0) == math.inf


@pytest.mark.parametrize(("n", "batch"), [(1, 64), (1, 1), (10, 64), (1000, 16)])
def test_a_row_drawn_with_replacement_may_fill_the_batch(n, batch):
    event = events.fixed_size(300.0, 3, n, batch, replace=True)
    for order in (2, 3, 8):
        # What the row in all slots, replaced by another, gives on its own; at n = 1 it always is.
        assert rdp.of_event(event, order) >= 3 * rdp.fixed_gaussian(order, 300.0 / batch, 1 - (1 - 1 / n) ** batch) * (1 - 1e-9)
    if n == 1:
        assert rdp.of_event(event, 4) == pytest.approx(3 * 2 * 4 * batch**2 / 300.0**2)
    assert rdp.of_event(events.fixed_size(1.0, 1, n, 0, replace=True), 2) == 0


def test_special_functions():
    assert special.beta_cdf(0.3, 2, 5) == pytest.approx(sum(special.math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2, 7)))
    assert special.beta_ppf(special.beta_cdf(0.2, 3, 7), 3, 7) == pytest.approx(0.2)
    assert special.binom_sf(3, 10, 0.4) == pytest.approx(sum(math.exp(special.binom_logpmf(k, 10, 0.4)) for k in range(4, 11)))
    assert special.norm_logcdf(-40) == pytest.approx(-804.608442, rel=1e-6)
    assert special.norm_ppf(special.norm_cdf(1.3)) == pytest.approx(1.3)
    assert special.logsumexp(np.array([[0.0, 0.0], [-np.inf, 1.0]]), axis=1) == pytest.approx([math.log(2), 1.0])
    assert special.log_diff(2.0, 1.0) == pytest.approx(math.log(math.e**2 - math.e))
    assert special.golden(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-6)
    with pytest.raises(ValueError):
        special.log_diff(1.0, 2.0)
