"""What can be wrong with a statement, and the texts that say so (fixed values)."""

from __future__ import annotations


class StatementError(ValueError):
    """A statement that can't be parsed or makes no sense on its metric."""


class NotFound(StatementError):
    """A metric that doesn't exist."""


class SchemaMismatch(ValueError):
    """A written record that doesn't fit its metric's schema."""


NO_AGGREGATION_GROUP_BY = "cannot execute a groupField by query without an aggregation"
MORE_FIELDS_GROUP_BY = "cannot execute a groupField by query with more than a aggregateField"
MORE_FIELDS_DISTINCT = "cannot execute a select distinct projecting more than one field"
NO_GROUP_BY_AGGREGATION = "cannot execute a query with a non global aggregation without a groupBy field"
GROUP_BY_DISTINCT = "cannot execute a query with a group by and a distinct clause"
SIMPLE_AGGREGATION_NOT_ON_TAG = "cannot execute a groupBy query grouping by a field that is not a tag"
AGGREGATION_NOT_ALLOWED = "Count And Count Distinct Aggregation can be applied to the value and to a tag. Other aggregations can be applied only on the value"
MULTIPLE_COUNT_AGGREGATIONS = "Only one Count and one Count Distinct is allowed"
SORT_DIMENSION_NOT_IN_GROUP = "cannot sort group by query result by a field not in group by clause"
GRACE_PERIOD_NOT_ALLOWED = "grace period clause is allowed only in temporal group by queries"


def field_missing(*fields: str) -> str:
    return f"field {fields[0]} does not exist" if len(fields) == 1 else f"field [{','.join(fields)}] does not exist"


def not_usable(operator: str, allowed: str) -> str:
    return f"cannot use {operator} operator on dimension different from {allowed}"
