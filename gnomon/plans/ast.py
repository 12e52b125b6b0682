"""Statements as data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


class Node:
    def to_dict(self) -> dict:
        """The statement as plain data, each node with its kind."""

        def plain(x):
            if isinstance(x, Node):
                return {"kind": type(x).__name__} | {k: plain(getattr(x, k)) for k in x.__dataclass_fields__}
            if isinstance(x, (list, tuple)):
                return [plain(y) for y in x]
            return dict(x) if isinstance(x, dict) else x

        return plain(self)


@dataclass(frozen=True)
class Now(Node):
    """The query's current time plus ``offset_ms``."""

    offset_ms: int = 0


Term = Now | int | float | str


@dataclass(frozen=True)
class Compare(Node):
    field: str
    op: str  # = > >= < <=
    term: Term


@dataclass(frozen=True)
class Between(Node):
    field: str
    low: Term
    high: Term


@dataclass(frozen=True)
class Like(Node):
    field: str
    pattern: str


@dataclass(frozen=True)
class IsNull(Node):
    field: str


@dataclass(frozen=True)
class Not(Node):
    of: "Expr"


@dataclass(frozen=True)
class And(Node):
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class Or(Node):
    left: "Expr"
    right: "Expr"


Expr = Compare | Between | Like | IsNull | Not | And | Or


@dataclass(frozen=True)
class Item(Node):
    """A selected field, or an aggregate of one ('value' for ``*``)."""

    field: str
    agg: str | None = None  # count sum min max avg first last
    distinct: bool = False


@dataclass(frozen=True)
class Interval(Node):
    ms: int
    quantity: int
    unit: str


@dataclass(frozen=True)
class Order(Node):
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Select(Node):
    metric: str
    items: tuple[Item, ...] | None  # None: all
    distinct: bool = False
    where: Expr | None = None
    group: str | Interval | None = None
    order: Order | None = None
    since_ms: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Insert(Node):
    metric: str
    value: int | float
    timestamp: int | None = None
    dimensions: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Delete(Node):
    metric: str
    where: Expr


@dataclass(frozen=True)
class Drop(Node):
    metric: str


@dataclass(frozen=True)
class ShowNamespaces(Node):
    pass


@dataclass(frozen=True)
class ShowMetrics(Node):
    pass


@dataclass(frozen=True)
class Use(Node):
    namespace: str


@dataclass(frozen=True)
class Describe(Node):
    metric: str


__all__ = [k for k in list(globals()) if k[0].isupper()] + ["asdict"]
