"""Import every query module so their ``@register`` calls populate REGISTRY."""

from __future__ import annotations

from buyerlens.plans import (queries_eval, queries_features, queries_models,  # noqa: F401
                             queries_profile)
from buyerlens.plans.registry import REGISTRY


def all_queries():
    return dict(REGISTRY)
