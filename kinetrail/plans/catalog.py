"""All registered queries of the episodic operators, with their SQL."""

from . import builds, catalog_rows, datasets, episodes, rounds, tables, training_rows  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
from .training_rows import flagship  # noqa: F401
