"""How text is delimited; declared, never found out."""

from __future__ import annotations

from dataclasses import dataclass

from sluice.types import DeclarationError

ENCODINGS = ("utf-8", "windows-1252", "latin-1", "utf-16le")


@dataclass(frozen=True)
class Dialect:
    """short_rows: reject or pad. long_rows: reject, report or truncate. tokens: exact cells that stand for no value."""

    separator: str = ","
    quoting: bool = True
    has_header: bool = True
    skip_blank_lines: bool = True
    skip: int = 0
    header_row: int = 0
    short_rows: str = "reject"
    long_rows: str = "reject"
    tokens: tuple[str, ...] = ()
    encoding: str = "utf-8"
    longest_record: int = 1 << 30

    def __post_init__(self):
        if len(self.separator) != 1 or not self.separator.isascii() or self.separator in '"\r\n':
            raise DeclarationError("a separator is one ASCII character other than a quote or a line end")
        if self.short_rows not in ("reject", "pad") or self.long_rows not in ("reject", "report", "truncate"):
            raise DeclarationError("no such policy for rows")
        if self.encoding not in ENCODINGS:
            raise DeclarationError(f"no such encoding: {self.encoding}")
        if self.skip < 0 or self.header_row < 0 or self.longest_record < 1:
            raise DeclarationError("counts are at least 0")
        if self.header_row and not self.has_header:
            raise DeclarationError("header_row needs a header")
