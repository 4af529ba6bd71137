"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessella.errors import SqlError

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
  | (?P<vector>\[[^\]]*\])
  | (?P<param>\?\d*)
  | (?P<name>[^\W\d]\w*)
  | (?P<op><>|!=|<=|>=|\|\||[-+*/%=<>(),.;:$@&|^~])
    """,
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, quoted, vector, param, name, op, end
    text: str

    @property
    def word(self) -> str:
        """The token as a keyword: upper case for plain names, else empty."""
        return self.text.upper() if self.kind == "name" else ""


def tokens(sql: str) -> list[Token]:
    """All tokens of a text, without white space and comments, and an `end` token."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise SqlError(f"unexpected character {sql[at]!r} at position {at}")
        at, kind, text = m.end(), m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
        out.append(Token(kind, text))
    return [*out, Token("end", "")]
