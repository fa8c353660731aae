"""The pipeline goes on while its fits run."""

import threading

from churnscope import queries as Q
from churnscope.config import QUERY_ROUNDS
from churnscope.plans import pipeline as P
from tests.conftest import SF001


def test_the_pipeline_goes_on_while_the_explainer_is_fitted(spark, monkeypatch):
    begun = threading.Event()

    def explainer(*a):
        assert begun.wait(30), "the pipeline waits for the explainer"
        return "explainer"

    def pipeline(*a, fits, **kw):
        assert fits["model"] == "model"
        begun.set()
        assert (fits["cv"], fits.get("explainer"), fits.get("other")) == ("cv", "explainer", None)
        return {"customer_risk_scores": spark.range(3)}

    for name, f in (("split_of", lambda *a: None), ("model_of", lambda *a: "model"), ("cv_of", lambda *a: "cv"), ("explainer_of", explainer)):
        monkeypatch.setattr(Q, name, f)
    monkeypatch.setattr(P, "run_pipeline", pipeline)
    assert Q.REGISTRY[f"M15_pipeline_scores_{QUERY_ROUNDS}_rounds"](spark, SF001).count() == 3
