import pytest

from chronoloom.functions.kernels import next_good_fft_size
from chronoloom.specs import PLAIN, parse, parse_all, plain_names


def test_plain_names():
    assert len(PLAIN) == 50 and len(plain_names()) == len(set(plain_names())) == 85
    for name, others in PLAIN.items():
        assert {parse(x).name for x in (name, *others)} == {name}


@pytest.mark.parametrize(
    "text,name",
    [
        ("paa-6-2", "paa-6-2"), ("c3-2", "c3-2"), ("value__c3__lag_3", "c3-3"), ("autocorr-4", "autocorr-4"), ("partial_autocorr-2", "partial_autocorr-2"), ("time_reversal_asymmetry-1", "time_reversal_asymmetry-1"),
        ("value__time_reversal_asymmetry_statistic__lag_2", "time_reversal_asymmetry-2"), ("fft_coeff-3-angle", "fft_coeff-3-angle"), ("approx_entropy-2-0.5", "approx_entropy-2-0.5"), ("agg_linear_trend-rvalue-5-var", "agg_linear_trend-rvalue-5-var"),
        ('value__agg_linear_trend__attr_"intercept"__chunk_len_10__f_agg_"max"', "agg_linear_trend-intercept-10-max"), ("quantile-0.10", "quantile-0.1"), ("value__quantile__q_0.9", "quantile-0.9"), ("index_mass_quantile-0.5", "index_mass_quantile-0.5"),
        ("value__index_mass_quantile__q_0.3", "index_mass_quantile-0.3"), ("max_langevin_fixed_point-3-30", "max_langevin_fixed_point-3-30"), ("value__max_langevin_fixed_point__m_3__r_30", "max_langevin_fixed_point-3-30"),
        ("mean_n_absolute_max-7", "mean_n_absolute_max-7"), ("value__mean_n_absolute_max__number_of_maxima_7", "mean_n_absolute_max-7"), ("wavelet-2-1", "wavelet-2-1"), ("spectrogram-1-2", "spectrogram-1-2"), ("human_range_energy", "human_range_energy-100"),
        ("torque_Wavelet absolute mean_104.17Hz", None), ("torque_Spectrogram mean coefficient_322.58Hz", None),
    ],
)
def test_parameters(text, name):
    spec = parse(text)
    assert spec.name == name or name is None
    assert parse(spec.name) == spec


@pytest.mark.parametrize("text", ["", "nope", "paa-2", "paa-2-2", "autocorr-0", "partial_autocorr-0", "fft_coeff-1-x", "quantile-2", "quantile--0.1", "agg_linear_trend-slope-0-mean", "agg_linear_trend-slope-5-sum", "c3-x", "c3-70000"])
def test_unknown_names(text):
    with pytest.raises(ValueError):
        parse(text)


def test_requests_keep_order_without_repeats():
    assert [s.name for s in parse_all(["std", "mean", "std_dev"])] == ["std_dev", "mean"]


def test_fft_sizes():
    assert [next_good_fft_size(n) for n in (0, 1, 20, 11, 13, 22, 100, 1000)] == [1, 1, 20, 16, 16, 32, 100, 1000]
