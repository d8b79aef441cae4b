"""Registered queries pass the whole job to their operators."""

import inspect

import pytest

from basketry.operators import cluster, density, text
from basketry.plans import queries

SF_DIR = "/root/testdata/sf0.001"


class Called(Exception):
    pass


def arguments(spark, monkeypatch, module, name, query):
    signature = inspect.signature(getattr(module, name))

    def caught(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, caught)
    with pytest.raises(Called) as found:
        queries()[query](spark, SF_DIR)
    return found.value.args[0]


def test_cluster_queries_run_the_whole_job(spark, monkeypatch):
    sweep = arguments(spark, monkeypatch, density, "dbscan_sweep", "i13_dbscan_sweep")
    assert len(sweep["metrics"]) * len(sweep["min_samples"]) * len(sweep["fractions"]) == 24 and sweep["sample_size"] is None
    mixture = arguments(spark, monkeypatch, cluster, "gaussian_mixture", "i14_gaussian_mixture")
    aic = arguments(spark, monkeypatch, cluster, "aic_curve", "i15_aic_curve")
    assert all(len(a["df"].first()["vector"]) == 64 for a in (mixture, aic))
    for ks in (aic["ks"], arguments(spark, monkeypatch, cluster, "k_curve", "i05_k_curve")["ks"]):
        assert len(ks) > 5 and list(ks) == list(range(min(ks), max(ks) + 1))


def test_svd_query_has_the_vocabulary_of_the_corpus_size(spark, monkeypatch):
    svd = arguments(spark, monkeypatch, text, "svd", "h08_svd_of_tfidf")
    assert svd["vectors"].first()["features"].size > 2000
