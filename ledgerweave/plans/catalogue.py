"""All queries of the reference's operators; importing a module registers its queries."""

from ledgerweave.plans import custody, events, extras, features, labelling, networks, relational, scoring, streams  # noqa: F401
from ledgerweave.plans.base import ORACLES, QUERIES  # noqa: F401
