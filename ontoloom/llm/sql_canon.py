"""Canonical form of an SQL text: what stays when formatting that cannot change its meaning is taken away.

Gone are white space, letter case, statement ends, identifier quotes, full-width spelling, comments, redundant
parentheses of conditions, and the order of the items of SELECT, SET and INSERT lists (INSERT columns move with their
values).  Kept are operators, values, tables, conditions and their order, grouping that binds, sort order and limits.
"""

from __future__ import annotations

import re
import unicodedata

_TOKEN = re.compile(r"""/\*.*?\*/|--[^\n]*|(?P<s>'(?:[^']|'')*')|(?P<d>"(?:[^"]|"")*")|(?P<b>`[^`]*`|\[[^\]]*\])|(?P<w>[^\W\d]\w*|\d+(?:\.\d+)?(?:e[+-]?\d+)?|\d\w*)|(?P<o><=>|<>|!=|<=|>=|==|\|\||::|:=|[^\s\w])""", re.S)
_COMPARE = {"=", "<>", "<", ">", "<=", ">=", "==", "<=>", "like", "ilike", "rlike", "regexp"}
_CLAUSE = {"where", "group", "order", "having", "limit", "offset", "union", "intersect", "except", "on", "join", "left", "right", "inner", "outer", "full", "cross", "natural", "set", "values", "from", "returning", "window", "fetch", "for", "using"}
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "。": ";", "、": ","})


def tokens(sql: str) -> list[str]:
    """Tokens; string values carry the mark ' in front, so that they never equal a name."""
    text = unicodedata.normalize("NFKC", sql).translate(_QUOTES).lower()
    out: list[str] = []
    found = [m for m in _TOKEN.finditer(text) if m.lastgroup]
    for i, m in enumerate(found):
        kind, t = m.lastgroup, m.group()
        if kind == "s":
            out.append("'" + " ".join(t[1:-1].split()))
        elif kind == "d":
            near = found[i + 1].group() if i + 1 < len(found) else ""
            value = out and out[-1] in _COMPARE and near != "." or out and out[-1] in ("(", ",") and "values" in out
            out.append("'" + " ".join(t[1:-1].split()) if value else "".join(t[1:-1].split()))
        elif kind == "b":
            inner = t[1:-1].strip()
            if t[0] == "[" and not re.fullmatch(r"[^\W\d][\w ]*", inner):
                out += ["[", *tokens(inner), "]"]
            else:
                out.append(inner)
        elif t == ";":
            continue
        else:
            out.append({"!=": "<>", "==": "="}.get(t, t))
    return out


def _close(t: list[str], i: int) -> int:
    """Index of the parenthesis that closes the one at i, or the end."""
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] == "(") - (t[j] == ")")
        if depth == 0:
            return j
    return len(t)


def _split(t: list[str], at: str = ",") -> list[list[str]]:
    out, depth = [[]], 0
    for x in t:
        depth += (x == "(") - (x == ")")
        if x == at and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return out


def _until(t: list[str], i: int, stops: set[str]) -> int:
    depth = 0
    for j in range(i, len(t)):
        if depth == 0 and (t[j] in stops or t[j] == ")"):
            return j
        depth += (t[j] == "(") - (t[j] == ")")
    return len(t)


class _Condition:
    """AND / OR / NOT tree of a condition; nested nodes of the same kind are one node, single ones lose their parentheses."""

    def __init__(self, t: list[str]):
        self.t, self.i = t, 0

    def render(self) -> list[str]:
        n = self.disjunction()
        out = self.text(n)
        return out + _plain(self.t[self.i :])

    def disjunction(self):
        return self._chain("or", self.conjunction)

    def conjunction(self):
        return self._chain("and", self.negation)

    def _chain(self, op: str, below):
        parts = [below()]
        while self.i < len(self.t) and self.t[self.i] == op:
            self.i += 1
            parts.append(below())
        flat = [y for x in parts for y in (x[1] if x[0] == op else [x])]
        return flat[0] if len(flat) == 1 else (op, flat)

    def negation(self):
        if self.i < len(self.t) and self.t[self.i] == "not":
            self.i += 1
            return ("not", [self.negation()])
        return self.primary()

    def primary(self):
        t, i = self.t, self.i
        if i < len(t) and t[i] == "(" and t[i + 1 : i + 2] != ["select"]:
            j = _close(t, i)
            if j + 1 >= len(t) or t[j + 1] in ("and", "or", ")"):
                inner = _Condition(t[i + 1 : j])
                node = inner.disjunction()
                if inner.i >= len(inner.t):
                    self.i = j + 1
                    return node
        j, depth, between = i, 0, False
        while j < len(t):
            if depth == 0 and (t[j] == "or" or t[j] == "and" and not between or t[j] == ")"):
                break
            if depth == 0 and t[j] in ("between", "and"):
                between = t[j] == "between"
            depth += (t[j] == "(") - (t[j] == ")")
            j += 1
        if j == i and j < len(t):
            j += 1
        self.i = j
        return ("leaf", _plain(t[i:j]))

    def text(self, n, inside: str = "") -> list[str]:
        if n[0] == "leaf":
            return n[1]
        if n[0] == "not":
            return ["not", *self.text(n[1][0], "not")]
        body = [y for k, x in enumerate(n[1]) for y in ([n[0]] if k else []) + self.text(x, n[0])]
        return ["(", *body, ")"] if inside == "not" or (inside == "and" and n[0] == "or") else body


def _plain(t: list[str]) -> list[str]:
    """Tokens with subqueries in canonical form."""
    out, i = [], 0
    while i < len(t):
        if t[i] == "(" and t[i + 1 : i + 2] == ["select"]:
            j = _close(t, i)
            out += ["(", *statement(t[i + 1 : j]), ")"]
            i = j + 1
        else:
            out.append(t[i])
            i += 1
    return out


def _sorted_list(t: list[str]) -> list[str]:
    items = sorted(" ".join(_plain(x)) for x in _split(t))
    return " , ".join(items).split(" ")


def statement(t: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(t):
        x = t[i]
        if x == "select":
            out.append(x)
            i += 1
            while t[i : i + 1] and t[i] in ("distinct", "all"):
                out.append(t[i])
                i += 1
            j = _until(t, i, {"from", "into", "union", "where"})
            out += _sorted_list(t[i:j])
            i = j
        elif x == "set" and out[:1] == ["update"]:
            j = _until(t, i + 1, {"where", "from", "returning", "order", "limit"})
            out += ["set", *_sorted_list(t[i + 1 : j])]
            i = j
        elif x in ("where", "having", "on"):
            j = _until(t, i + 1, _CLAUSE)
            out += [x, *_Condition(t[i + 1 : j]).render()]
            i = j
        elif x == "values" and out[:1] == ["insert"]:
            i = _insert(t, i, out)
        elif x == "(":
            j = _close(t, i)
            out += ["(", *(statement(t[i + 1 : j]) if t[i + 1 : i + 2] == ["select"] else _plain(t[i + 1 : j])), *t[j : j + 1]]
            i = j + 1
        else:
            out.append(x)
            i += 1
    if out[:1] == ["insert"] and "values" not in out:  # INSERT ... SELECT: the lists belong together and stay as they are
        return _plain(t)
    return out


def _insert(t: list[str], i: int, out: list[str]) -> int:
    """Columns and values of an INSERT, ordered together by column."""
    rows, j = [], i + 1
    while j < len(t) and t[j] == "(":
        k = _close(t, j)
        rows.append([" ".join(_plain(v)) for v in _split(t[j + 1 : k])])
        j = k + 1
        if j < len(t) and t[j] == ",":
            j += 1
    at = max((k for k, x in enumerate(out) if x == "("), default=-1)
    cols = [" ".join(c) for c in _split(out[at + 1 : len(out) - 1])] if at >= 0 and out[-1:] == [")"] else []
    if cols and rows and all(len(r) == len(cols) for r in rows):
        order = sorted(range(len(cols)), key=lambda k: (cols[k], [r[k] for r in rows]))
        out[at:] = ["(", *" , ".join(cols[k] for k in order).split(" "), ")"]
        rows = [[r[k] for k in order] for r in rows]
    out.append("values")
    for n, r in enumerate(rows):
        out += ([","] if n else []) + ["(", *" , ".join(r).split(" "), ")"]
    return j


def canonical(sql: str | None) -> str | None:
    """Canonical text; null for null and for texts without any token."""
    if sql is None:
        return None
    t = tokens(sql)
    return " ".join(x for x in statement(t) if x) if t else None
