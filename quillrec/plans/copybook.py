"""Fixed-format copybook source to a flat list of data entries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillrec.errors import CopybookError, Span

NAME = re.compile(r"[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\Z")
LEVEL = re.compile(r"[0-9]{2}\Z")
#: USAGE spellings and what they mean (fixed values).
USAGES = {"DISPLAY": "display", "COMP": "binary", "COMP-4": "binary", "BINARY": "binary", "COMP-3": "packed", "PACKED-DECIMAL": "packed"}
_USAGE_LIST = "DISPLAY, COMP, COMP-4, BINARY, COMP-3 or PACKED-DECIMAL"
_FORMS = "supported forms are X, X(n), 9, 9(n), 9(n)V9(m), optionally prefixed by S for numeric fields"
_MOST = (1 << 64) - 1


@dataclass(frozen=True)
class Picture:
    """``length`` for text; ``digits`` and ``fraction`` for numbers."""

    length: int | None = None
    digits: int | None = None
    fraction: int = 0
    signed: bool = False


@dataclass(frozen=True)
class Entry:
    level: int
    name: str
    span: Span
    picture: Picture | None = None  # None: a group
    usage: str | None = None


@dataclass(frozen=True)
class Token:
    text: str
    span: Span

    def is_word(self, *words: str) -> bool:
        return self.text.upper() in words


def code_lines(source: str) -> list[tuple[int, str]]:
    """(line number, columns 8-72) of the lines that hold code; comments after ``*>`` are cut off."""
    out = []
    lines = source.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for number, line in enumerate(lines, 1):
        line = line.removesuffix("\r")
        for bad, details in (
            (r"[^\x00-\x7f]", lambda c: f"non-ASCII character '{c}' is not supported"),
            (r"\t", lambda c: "tabs are not allowed because columns must be unambiguous"),
            (r"[\x00-\x1f\x7f]", lambda c: f"ASCII control byte 0x{ord(c):02X} is not supported"),
        ):
            if hit := re.search(bad, line):
                raise CopybookError("InvalidSourceFormat", Span(number, hit.start() + 1), details=details(hit[0]))
        if not line.strip(" "):
            continue
        if len(line) < 7:
            details = f"non-blank line has {len(line)} columns; at least 7 are required"
            raise CopybookError("InvalidSourceFormat", Span(number, len(line) + 1), details=details)
        if line[6] in "*/":
            continue
        if line[6] != " ":
            raise CopybookError("InvalidIndicator", Span(number, 7), indicator=line[6])
        out.append((number, line[7:72].partition("*>")[0]))
    return out


def tokens_of(lines: list[tuple[int, str]]) -> list[Token]:
    """Periods, and runs of anything else but spaces."""
    return [Token(m[0], Span(number, 8 + m.start())) for number, code in lines for m in re.finditer(r"\.|[^ .]+", code)]


def parse_picture(token: Token) -> Picture:
    text = token.text.upper()

    def bad(details: str) -> CopybookError:
        return CopybookError("InvalidPicture", token.span, value=token.text, details=details)

    def count(group: str | None) -> int:
        return 1 if group is None else int(group)

    if m := re.fullmatch(r"(S?)X(?:\(([0-9]+)\))?", text):
        if 0 < count(m[2]) <= _MOST:
            if m[1]:
                raise bad("the S prefix is only valid for numeric PICTUREs")
            return Picture(length=count(m[2]))
    m = re.fullmatch(r"(S?)9(?:\(([0-9]+)\))?", text) or re.fullmatch(r"(S?)9\(([0-9]+)\)V9\(([0-9]+)\)", text)
    if not m:
        raise bad(_FORMS)
    digits = count(m[2])
    fraction = int(m[3]) if m.lastindex == 3 else None
    if not 0 < digits <= _MOST or fraction is not None and not 0 < fraction <= _MOST:
        raise bad(_FORMS)
    for n, what in ((digits, "integer"), (fraction or 0, "fractional")):
        if n > 255:
            raise bad(f"{what} digit count does not fit in the AST")
    return Picture(digits=digits, fraction=fraction or 0, signed=bool(m[1]))


class _Reader:
    """One pass over the tokens; ``take`` and ``need`` name what is missing when they run out."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def end(self) -> Span:
        if not self.tokens:
            return Span(1, 1)
        last = self.tokens[-1]
        return Span(last.span.line, last.span.column + len(last.text))

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, expected: str, where: Span | None = None) -> Token:
        token = self.peek()
        if token is None:
            raise CopybookError("UnexpectedEnd", where or self.end, expected=expected)
        self.at += 1
        return token

    def skip(self, word: str) -> None:
        token = self.peek()
        if token and token.is_word(word):
            self.at += 1

    def stray(self, token: Token | None) -> CopybookError:
        """What stands where a period should: a new entry, an unknown clause or nothing."""
        if token is None:
            return CopybookError("MissingPeriod", self.end)
        if LEVEL.match(token.text):
            return CopybookError("MissingPeriod", token.span)
        return CopybookError("UnsupportedClause", token.span, clause=token.text)

    def entry(self) -> Entry:
        level = self.take("a two-digit level number")
        if not LEVEL.match(level.text) or not 1 <= int(level.text) <= 49:
            raise CopybookError("InvalidLevel", level.span, value=level.text)
        name = self.take("a data-name", level.span)
        if name.text == ".":
            raise CopybookError("UnexpectedToken", name.span, found=".", expected="a data-name")
        if not NAME.match(name.text):
            raise CopybookError("InvalidName", name.span, value=name.text)
        after = self.peek()
        if after is not None and after.text == ".":
            self.at += 1
            return Entry(int(level.text), name.text, level.span)
        if after is None or not after.is_word("PIC", "PICTURE"):
            raise self.stray(after)
        self.at += 1
        self.skip("IS")
        token = self.take("a supported PICTURE followed by a period")
        if token.text == ".":
            raise CopybookError("UnexpectedToken", token.span, found=".", expected="a supported PICTURE")
        picture = parse_picture(token)
        return Entry(int(level.text), name.text, level.span, picture, self.usage())

    def usage(self) -> str:
        token, usage = self.peek(), "display"
        if token is not None and token.is_word("USAGE"):
            self.at += 1
            self.skip("IS")
            token = self.take(_USAGE_LIST)
            if token.text == ".":
                raise CopybookError("UnexpectedToken", token.span, found=".", expected="a supported USAGE")
            if token.text.upper() not in USAGES:
                raise CopybookError("UnsupportedClause", token.span, clause=token.text)
            usage = USAGES[token.text.upper()]
        elif token is not None and token.text.upper() in USAGES:
            usage = USAGES[token.text.upper()]
            self.at += 1
        if (token := self.peek()) is None or token.text != ".":
            raise self.stray(token)
        self.at += 1
        return usage


def parse_copybook(source: str) -> list[Entry]:
    """The entries of a copybook in source order; their level numbers carry the hierarchy."""
    reader, entries = _Reader(tokens_of(code_lines(source))), []
    while reader.peek() is not None:
        entries.append(reader.entry())
    return entries
