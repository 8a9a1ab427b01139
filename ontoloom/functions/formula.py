"""Formulas of derived properties as columns: nested IF, comparisons, AND / OR / NOT, IS [NOT] NULL, arithmetic.

    IF(annual_spend > 100000, 'VIP', IF(customer_name IS NOT NULL, 'person', 'company'))

A formula is parsed once on the driver and becomes one expression for all rows.  A comparison with null is false."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|'((?:[^']|'')*)'|\"([^\"]*)\"|([^\W\d]\w*)|(<=|>=|<>|!=|==|[-+*/(),<>=]))")


class FormulaError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, fields: dict[str, Column] | None):
        self.fields, self.at, self.tokens = fields, 0, []
        pos = 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise FormulaError(f"unexpected character at {pos} of {text!r}")
            self.tokens.append(next((k, v) for k, v in zip(("num", "str", "str", "name", "op"), m.groups()) if v is not None))
            pos = m.end()

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1].lower() in words

    def take(self, *words: str) -> str:
        if not self.peek(*words):
            raise FormulaError(f"expected {' or '.join(words)}")
        self.at += 1
        return self.tokens[self.at - 1][1].lower()

    def whole(self) -> Column:
        c = self.either()
        if self.at != len(self.tokens):
            raise FormulaError("text after the end of the formula")
        return c

    def either(self) -> Column:
        c = self.both()
        while self.peek("or"):
            self.take("or")
            c = c | self.both()
        return c

    def both(self) -> Column:
        c = self.negated()
        while self.peek("and"):
            self.take("and")
            c = c & self.negated()
        return c

    def negated(self) -> Column:
        if self.peek("not"):
            self.take("not")
            return ~self.negated()
        return self.compared()

    def compared(self) -> Column:
        a = self.sum()
        if self.peek("is"):
            self.take("is")
            no = self.peek("not") and self.take("not")
            self.take("null")
            return a.isNotNull() if no else a.isNull()
        if self.peek("<", ">", "<=", ">=", "=", "==", "<>", "!="):
            op, b = self.take("<", ">", "<=", ">=", "=", "==", "<>", "!="), self.sum()
            c = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}.get(op)
            c = (a == b if op in ("=", "==") else a != b) if c is None else c
            return F.coalesce(c, F.lit(False))
        return a

    def sum(self) -> Column:
        c = self.product()
        while self.peek("+", "-"):
            c = c + self.product() if self.take("+", "-") == "+" else c - self.product()
        return c

    def product(self) -> Column:
        c = self.atom()
        while self.peek("*", "/"):
            if self.take("*", "/") == "*":
                c = c * self.atom()
            else:
                c = c / F.nullif(self.atom(), F.lit(0))
        return c

    def atom(self) -> Column:
        if self.at >= len(self.tokens):
            raise FormulaError("the formula breaks off")
        if self.peek("-"):
            self.take("-")
            return -self.atom()
        if self.peek("("):
            self.take("(")
            c = self.either()
            self.take(")")
            return c
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(v) if "." in v else int(v))
        if kind == "str":
            return F.lit(v.replace("''", "'"))
        if kind == "name" and v.lower() == "if" and self.peek("("):
            self.take("(")
            cond = self.either()
            self.take(",")
            yes = self.either()
            self.take(",")
            no = self.either()
            self.take(")")
            return F.when(cond, yes).otherwise(no)
        if kind == "name":
            if self.fields is not None and v not in self.fields:
                raise FormulaError(f"unknown field {v}")
            return self.fields[v] if self.fields is not None else F.col(v)
        raise FormulaError(f"unexpected {v}")


def compile_formula(text: str, fields: dict[str, Column] | None = None) -> Column:
    """The column of a formula; fields maps names to columns and, if given, names all that may occur."""
    return _Parser(text, fields).whole()
