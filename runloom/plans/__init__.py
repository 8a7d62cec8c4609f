"""All registered queries; importing this package fills the catalog."""

from runloom.plans import learn_queries, scalar_queries, select_queries, state_queries  # noqa: F401
from runloom.plans.catalog import QUERIES, SQL, SURVEY_IDS  # noqa: F401
