"""The registered log queries and their twins in SQL: ``queries.QUERIES`` and ``queries.ORACLES``."""

from emberlog.plans import queries, intake, keeping  # noqa: F401, I001  (the later ones register theirs with the first)
