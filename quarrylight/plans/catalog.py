"""All registered queries."""

from quarrylight.plans import (  # noqa: F401
    catalog_answers,
    catalog_learning,
    catalog_normalize,
    catalog_ops,
    catalog_records,
    catalog_search,
    catalog_urls,
    catalog_views,
)
from quarrylight.plans.registry import QUERIES, oracles  # noqa: F401
