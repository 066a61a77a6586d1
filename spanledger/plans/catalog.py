"""All named queries. Importing a plan module registers its queries."""

from spanledger.plans import audit_plans, corpus_plans, relational_plans, sequence_plans, source_plans, text_plans  # noqa: F401
from spanledger.plans.base import ORACLES, QUERIES  # noqa: F401
