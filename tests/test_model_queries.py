"""The registered model queries run the full sizes but for the ensemble's rounds, which their ids name."""

from dataclasses import replace

from churnscope import queries as Q
from churnscope.config import DEFAULT, QUERY, QUERY_ROUNDS
from churnscope.plans import explain as X
from churnscope.plans import model as M
from churnscope.plans import pipeline as P
from churnscope.plans import segments as S
from tests.conftest import SF001


class Sizes(Exception):
    pass


def test_model_queries_take_the_full_sizes(spark, monkeypatch):
    """Every fit of a registered query gets its sizes; the pipeline cross-validates, explains and writes."""
    assert QUERY == replace(DEFAULT, boost=replace(DEFAULT.boost, max_iter=QUERY_ROUNDS))
    r = f"_{QUERY_ROUNDS}_rounds"
    seen = []

    def stop(name):
        def fit(*args, **kw):
            seen.append((name, [a for a in (*args, *kw.values()) if hasattr(a, "boost")]))
            raise Sizes
        return fit

    monkeypatch.setattr(Q, "_TABLES", dict(Q._TABLES))
    for module, name in ((M, "fit_calibrated"), (M, "cross_validate"), (S, "segment"), (X, "fit_explainer"), (P, "run_baseline")):
        monkeypatch.setattr(module, name, stop(name))
    for k in [k for k in Q._TABLES if k[1] in ("model", "cv", "explainer", "model_scored", "contrib", "segments")]:
        del Q._TABLES[k]
    for query, fit, sizes in (("M2_kmeans_segments", "segment", DEFAULT), ("M12_model_scores" + r, "fit_calibrated", QUERY), ("S4_model_roundtrip_scores" + r, "fit_calibrated", QUERY),
                              ("M14_whatif_scores" + r, "fit_calibrated", QUERY), ("M9_cross_validate" + r, "cross_validate", QUERY), ("M13_contributions", "fit_explainer", DEFAULT),
                              ("M15_pipeline_scores" + r, "fit_calibrated", QUERY), ("M15_baseline_pipeline", "run_baseline", DEFAULT)):
        try:
            Q.REGISTRY[query](spark, SF001)
        except Sizes:
            pass
        assert seen.pop() == (fit, [sizes]) and not [x for x in seen if x[0] != "segment"], query
        seen.clear()


def test_metrics_and_pipeline_have_cross_validation(spark, monkeypatch):
    monkeypatch.setattr(Q, "_TABLES", dict(Q._TABLES))
    monkeypatch.setattr(M, "cross_validate", lambda cust, cfg: spark.createDataFrame([(0, 0.75), (1, 0.85)], "fold int, auc double"))
    monkeypatch.setattr(Q, "model_scored_of", lambda spark, sf_dir, source="orders": M.split_flag(Q.scored_of(spark, sf_dir, source)))
    row = Q.REGISTRY[f"M8_M10_model_metrics_{QUERY_ROUNDS}_rounds"](spark, SF001).first()
    assert (row["cv_auc_mean"], row["cv_auc_std"]) == (0.8, 0.05)
    kw = {}
    monkeypatch.setattr(P, "run_pipeline", lambda *a, **k: kw.update(k) or {"customer_risk_scores": spark.range(1)})
    for name in ("model_of", "explainer_of"):
        monkeypatch.setattr(Q, name, lambda *a, name=name: name)
    Q.REGISTRY[f"M15_pipeline_scores_{QUERY_ROUNDS}_rounds"](spark, SF001)
    assert kw["out_dir"] and kw["fits"]["model"] == "model_of" and kw["fits"]["explainer"] == "explainer_of" and kw["fits"]["cv"].count() == 2
    assert kw.get("cross_validation", True) and kw.get("explain", True)
