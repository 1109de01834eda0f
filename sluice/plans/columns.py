"""Plans: which source column is read as which type, in which notation, under which rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from sluice.functions.constraints import Constraints
from sluice.functions.doors import DateOptions
from sluice.functions.numbers import NumFormat
from sluice.types import INTEGERS, REALS, SPARK_TYPE, AmbiguousColumn, DeclarationError, Door, NoColumn, PlanError

WIDEST = 1 << 20


class Header:
    """A header's names in order, as they are: never trimmed, never folded."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def ordinal(self, name: str) -> int:
        """The first column of that name."""
        try:
            return self.names.index(name)
        except ValueError:
            raise NoColumn(f"the header has no {name!r}") from None

    def require(self, name: str) -> int:
        """The only column of that name."""
        first = self.ordinal(name)
        if name in self.names[first + 1 :]:
            raise AmbiguousColumn(name, first, self.names.index(name, first + 1))
        return first


@dataclass(frozen=True)
class Column:
    """One column of a plan. source: the ordinal or the header's name; name: what the result calls it."""

    source: int | str
    door: Door = Door.TEXT
    name: str | None = None
    form: NumFormat | None = None
    precision: str | None = None
    order: str | None = None
    epoch: int | None = None
    dates: DateOptions | None = None
    tokens: tuple[str, ...] | None = None
    constraints: Constraints | None = None
    decimal: tuple[int, int] = (38, 10)

    def options(self) -> dict:
        d = self.door
        out: dict = {}
        if d in INTEGERS or d in REALS:
            out["form"] = self.form
        if d is Door.DECIMAL:
            out["precision"], out["scale"] = self.decimal
        if d is Door.UNIX:
            out["precision"] = self.precision
        if d in (Door.DATE_ORDERED, Door.DATETIME):
            out["order"] = self.order
        if d is Door.EXCEL_SERIAL:
            out["epoch"] = self.epoch
        if d in (Door.TIMESTAMP, Door.DATE, Door.DATE_ORDERED, Door.DATETIME):
            out["options"] = self.dates
        return {k: v for k, v in out.items() if v is not None}

    @property
    def spark_type(self) -> str:
        return f"decimal({self.decimal[0]},{self.decimal[1]})" if self.door is Door.DECIMAL else SPARK_TYPE[self.door]


def bind(plan: Sequence[Column], header: Header | None = None, width: int | None = None) -> list[Column]:
    """The plan with ordinals for sources and a name for every column; raises what cannot be honoured."""
    out: list[Column] = []
    names: set[str] = set()
    for i, column in enumerate(plan):
        source = column.source
        if isinstance(source, str):
            if header is None:
                raise PlanError(i, "a name needs a header")
            source = header.require(source)
        if not 0 <= source < WIDEST:
            raise PlanError(i, f"no such ordinal: {source}")
        limit = len(header.names) if header is not None and width is None else width
        if limit is not None and source >= limit:
            raise PlanError(i, f"ordinal {source} is past the header's {limit} columns")
        given = {"form": column.form is not None and not (column.door in INTEGERS or column.door in REALS), "precision": column.precision is not None and column.door is not Door.UNIX, "order": column.order is not None and column.door not in (Door.DATE_ORDERED, Door.DATETIME), "epoch": column.epoch is not None and column.door is not Door.EXCEL_SERIAL}
        if wrong := [k for k, bad in given.items() if bad]:
            raise PlanError(i, f"a {column.door.value} column takes no {wrong[0]}")
        if column.constraints is not None:
            try:
                column.constraints.check(column.door)
            except DeclarationError as e:
                raise PlanError(i, str(e)) from None
        name = column.name or (column.source if isinstance(column.source, str) else header.names[source] if header is not None and source < len(header.names) else f"c{source}")
        base, k = name, 2
        while name in names:
            name, k = f"{base}_{k}", k + 1
        names.add(name)
        out.append(replace(column, source=source, name=name))
    return out


def named(**columns: Door | Column | Mapping) -> list[Column]:
    """A plan by header names: ``named(id=Door.I32, note=Column("Note"))``."""
    return [replace(v, name=v.name or k) if isinstance(v, Column) else Column(k, v, k) for k, v in columns.items()]
