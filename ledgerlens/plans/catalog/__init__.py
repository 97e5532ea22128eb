"""All registered queries. Importing this package fills the registry."""

from ledgerlens.plans.catalog import domains, inputs, learned, market, profiles, relational, samples, scores, text, transactions  # noqa: F401
from ledgerlens.plans.registry import QUERIES  # noqa: F401
