"""Registered queries over the given tables (see ``registry``).

Importing this package fills ``registry.QUERIES`` and ``registry.ORACLE``.
"""

from sievekit.plans import editing, learning, mining, relational, reporting, scoring, storage, textual  # noqa: F401
from sievekit.plans.registry import ORACLE, QUERIES  # noqa: F401
