"""Tail probabilities against published tables and closed forms."""

import math

import pytest

from tallygrid.functions import special as s


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (2.042, 30, 0.05), (3.169, 10, 0.01), (1.96, 1e7, 0.05)])
def test_t(t, df, p):
    assert s.t_two_sided(t, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("x,df,p", [(3.841, 1, 0.05), (18.307, 10, 0.05), (23.209, 10, 0.01), (124.342, 100, 0.05)])
def test_chi2(x, df, p):
    assert s.chi2_upper(x, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("f,a,b,p", [(4.96, 1, 10, 0.05), (2.98, 10, 10, 0.05), (3.32, 2, 30, 0.05)])
def test_f(f, a, b, p):
    assert s.f_upper(f, a, b) == pytest.approx(p, rel=5e-3)


def test_closed_forms():
    for x in (0.1, 1.0, 7.5, 60.0):
        assert s.chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert s.t_two_sided(x, 1) == pytest.approx(1 - 2 / math.pi * math.atan(x), rel=1e-9)
        assert s.chi2_upper(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
    assert s.normal_two_sided(1.959964) == pytest.approx(0.05, rel=1e-5)


@pytest.mark.parametrize("x,p", [(1.358, 0.05), (1.628, 0.01), (1.224, 0.10)])
def test_kolmogorov(x, p):
    assert s.kolmogorov_upper(x) == pytest.approx(p, rel=5e-3)


def test_kolmogorov_ends():
    assert s.kolmogorov_upper(0) == 1.0
    assert s.kolmogorov_upper(0.2999) == pytest.approx(s.kolmogorov_upper(0.3001), abs=1e-4)
    assert s.kolmogorov_upper(5) < 1e-20
