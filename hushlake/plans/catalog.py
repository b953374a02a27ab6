"""All named queries, loaded in the order in which they are listed."""

from hushlake.plans import masking  # noqa: F401  isort: skip
from hushlake.plans import logs, statistics  # noqa: F401  isort: skip
from hushlake.plans import documents_json, configuration, routes  # noqa: F401  isort: skip
from hushlake.plans import streams, stored  # noqa: F401  isort: skip
from hushlake.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
