"""All registered queries of the library, and their SQL."""

from palimpsest.plans import context, evaluation, instances, joins, metrics, perturb, quality, retrieval, sets, sources, streams, text  # noqa: F401
from palimpsest.plans.registry import QUERIES, SQL  # noqa: F401
