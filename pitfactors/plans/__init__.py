"""Registered queries: every operator applied to the driver's tables."""

import importlib

MODULES = ["sources_q", "joins_q", "features_q", "events_q", "conditions_q", "evaluation_q", "scoring_q", "regimes_q", "nav_q", "claims_q", "documents_q"]


def load():
    from pitfactors.plans import catalogue

    for name in MODULES:
        importlib.import_module(f"pitfactors.plans.{name}")
    return dict(catalogue.QUERIES), dict(catalogue.ORACLES)
