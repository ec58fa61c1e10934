"""Every operator bound to the driver's tables, each with the same result in plain SQL."""

from bindings.common import QUERIES, SQL  # noqa: F401
from bindings import (  # noqa: F401
    auditing, catalogue, filling, forms, intake, live, measures, parsing, ranges, resolving, stored, voting)
