"""Query text to queries.

    query := [SELECT (* | field {, field})] FROM key [RANGE n TO n] [WHERE cond {AND cond}]
             [ORDER BY datetime (ASC | DESC)] [LIMIT n]
    cond  := field (== | = | != | <> | < | <= | > | >=) number
"""

from __future__ import annotations

import re
from decimal import Decimal
from typing import NamedTuple

from tickloom.errors import ParseError, QueryError
from tickloom.plans.query import Cond, Field, Query, field_of, op_of


class Token(NamedTuple):
    kind: str
    text: str
    pos: int


# tried in this order at each place
_RULES = re.compile(
    r"""(?P<blank>[ \t\r\n]+)
      | "(?P<string>(?:[^"\\]|\\.)*)"
      | (?P<op>[<>=!]=|<>|[<>=!*,])
      | (?P<number>-?[0-9.]+|-)
      | (?P<word>[\w/.-]+)""",
    re.VERBOSE | re.DOTALL,
)


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _RULES.match(text, at)
        if m is None:
            raise ParseError(at, "unterminated string" if text[at] == '"' else f"unexpected {text[at]!r}")
        kind = m.lastgroup
        if kind == "number":
            if text[m.end() : m.end() + 1] in ("e", "E"):
                raise ParseError(at, "exponents are not supported; write the digits out")
            if not re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", m[0]):
                raise ParseError(at, f"bad number {m[0]!r}")
        if kind != "blank":
            out.append(Token(kind, re.sub(r"\\(.)", r"\1", m["string"], flags=re.DOTALL) if kind == "string" else m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        token = self.here
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def word(self, *words: str) -> str | None:
        """The keyword that stands here, if it is one of these; it is then passed."""
        if self.here.kind == "word" and self.here.text.lower() in words:
            return self.take().text.lower()
        return None

    def need(self, *words: str) -> str:
        return self.word(*words) or self.fail(f"expected {' or '.join(words).upper()}")

    def fail(self, message: str, token: Token | None = None):
        token = token or self.here
        raise ParseError(token.pos, message if token.kind != "end" else f"{message}, but the query ends")

    def natural(self) -> int:
        token = self.take()
        if token.kind != "number":
            self.fail("expected a number", token)
        if token.text[0] == "-" and float(token.text) < 0:
            self.fail("expected a number that is not negative", token)
        if float(token.text) % 1:
            self.fail("expected a whole number", token)
        return int(token.text.partition(".")[0] or 0) if token.text[0] != "-" else 0

    def fields(self) -> tuple[Field, ...]:
        if self.here.text == "*" and self.here.kind == "op":
            self.take()
            return ()
        found = []
        while True:
            token = self.take()
            found.append(field_of(token.text) if token.kind in ("word", "string") else None)
            if found[-1] is None:
                self.fail(f"unknown field {token.text!r}", token)
            if self.here.kind != "op" or self.here.text != ",":
                return tuple(found)
            self.take()

    def cond(self) -> Cond:
        name = self.take()
        field = field_of(name.text) if name.kind == "word" else self.fail("expected a field", name)
        if field is None:
            self.fail(f"unknown field {name.text!r}", name)
        sign = self.take()
        op = op_of(sign.text) if sign.kind == "op" else None
        if op is None:
            self.fail("expected a comparison", sign)
        value = self.take()
        if value.kind != "number":
            self.fail("expected a number", value)
        try:
            return Cond.of(field, op, Decimal(value.text))
        except QueryError as error:
            raise ParseError(value.pos, str(error)) from error


def parse(text: str) -> Query:
    """The query of a text, or ParseError with the place where it can't be read."""
    r = _Reader(text)
    fields: tuple[Field, ...] = ()
    if r.need("select", "from") == "select":
        fields = r.fields()
        r.need("from")
    if r.here.kind not in ("word", "string") or not r.here.text:
        r.fail("expected a key after FROM")
    query = Query(r.take().text).select(*fields)
    if r.word("range"):
        place = r.here
        start = r.natural()
        r.need("to")
        end = r.natural()
        if start > end:
            r.fail("the range starts after it ends", place)
        query = query.between(start, end)
    if r.word("where"):
        conds = [r.cond()]
        while r.word("and"):
            conds.append(r.cond())
        query = Query(query.key, query.fields, query.start, query.end, tuple(conds))
    if r.word("order"):
        r.need("by")
        token = r.take()
        if token.kind not in ("word", "string") or field_of(token.text) is not Field.DATETIME:
            r.fail("only datetime orders records", token)
        query = query.newest_first() if r.need("asc", "desc") == "desc" else query
    if r.word("limit"):
        query = query.take(r.natural())
    if r.here.kind != "end":
        r.fail(f"unexpected {r.here.text!r}")
    return query
