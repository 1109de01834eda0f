"""The closed vocabularies of verdicts, and what a wrong declaration raises."""

from __future__ import annotations

from enum import Enum

# The names that a reader of verdicts meets.
REASONS = ("empty", "malformed", "out_of_range", "violation")
ORIGINS = ("cell", "token", "padded", "uncached")
KEYWORDS = ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "enum")
FAILURES = ("unclosed_quote", "column_count", "row_too_long", "not_a_zip", "container", "encrypted", "method", "missing_part", "xml", "deflate", "not_a_workbook", "shared_string", "too_large", "iwa", "encoding")
SUGGESTED = ("resolved", "ambiguous", "unresolved")


class Door(str, Enum):
    """The type that a column's cells are cast to."""

    BOOL = "bool"
    I8 = "i8"
    I16 = "i16"
    I32 = "i32"
    I64 = "i64"
    U8 = "u8"
    U16 = "u16"
    U32 = "u32"
    U64 = "u64"
    F32 = "f32"
    F64 = "f64"
    DECIMAL = "decimal"
    UUID = "uuid"
    TIMESTAMP = "timestamp"
    UNIX = "unix"
    EXCEL_SERIAL = "excel_serial"
    DATE = "date"
    DATE_ORDERED = "date_ordered"
    DATETIME = "datetime"
    TIME = "time"
    DURATION = "duration"
    TEXT = "text"


INTEGERS = {Door.I8: (-(1 << 7), (1 << 7) - 1), Door.I16: (-(1 << 15), (1 << 15) - 1), Door.I32: (-(1 << 31), (1 << 31) - 1), Door.I64: (-(1 << 63), (1 << 63) - 1), Door.U8: (0, (1 << 8) - 1), Door.U16: (0, (1 << 16) - 1), Door.U32: (0, (1 << 32) - 1), Door.U64: (0, (1 << 64) - 1)}
REALS = (Door.F32, Door.F64, Door.DECIMAL)

#: Spark's type for the values of each door.
SPARK_TYPE = {
    Door.BOOL: "boolean", Door.I8: "tinyint", Door.I16: "smallint", Door.I32: "int", Door.I64: "bigint",
    Door.U8: "smallint", Door.U16: "int", Door.U32: "bigint", Door.U64: "decimal(20,0)",
    Door.F32: "float", Door.F64: "double", Door.DECIMAL: "decimal(38,10)", Door.UUID: "string",
    Door.TIMESTAMP: "timestamp", Door.UNIX: "timestamp", Door.EXCEL_SERIAL: "timestamp", Door.DATE: "date",
    Door.DATE_ORDERED: "date", Door.DATETIME: "timestamp_ntz", Door.TIME: "bigint", Door.DURATION: "bigint", Door.TEXT: "string",
}


class DeclarationError(ValueError):
    """A plan, dialect or option that cannot be honoured; raised before anything is read."""


class PlanError(DeclarationError):
    def __init__(self, column: int, why: str):
        super().__init__(f"plan column {column}: {why}")
        self.column = column


class AmbiguousColumn(DeclarationError):
    def __init__(self, name: str, first: int, second: int):
        super().__init__(f"the header has {name!r} at {first} and at {second}")
        self.positions = first, second


class NoColumn(DeclarationError):
    pass


class NoSheet(DeclarationError):
    pass


class StructuralFailure(RuntimeError):
    """Raised by require_intact(): an input broke after its intact rows."""


class CheckedColumn(TypeError):
    """A plain value was asked of a column with constraints, whose violations it cannot tell."""
