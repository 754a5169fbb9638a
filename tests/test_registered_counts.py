"""The registered model and intervals run with the reference's counts: 250 rounds, 400 resamples."""

import pytest

from tidemark.operators import linear, metrics
from tidemark.plans import catalogue


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, module, function, count, value", [("boosted_classifier", linear, "boosted", "iterations", 250), ("bootstrap_ci", metrics, "bootstrap", "n_boot", 400)])
def test_counts(spark, data, monkeypatch, name, module, function, count, value):
    def seen(*args, **kw):
        raise Seen(kw[count])

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(Seen) as e:
        catalogue.queries()[name](spark, data)
    assert e.value.args == (value,)
