"""All queries of the library, by name."""

from weftgraph.plans import evidence, graph, homologs, lifecycle, profiles, relational, scalars, sources, temporal, vectors  # noqa: F401
from weftgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
