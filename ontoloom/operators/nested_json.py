"""Problem 1: deeply nested JSON records into linked flat tables by structural indexing.

All payloads of an Arrow batch are laid end to end in one byte array.  Bitmaps of quotes, brackets and delimiters are
built for the whole array at once, strings are masked by the parity of the unescaped quotes before each byte, and the
nesting depth of every byte is a prefix sum over the brackets.  One stable sort of the delimiters by text and depth puts
each container's own side by side: neighbours then give the grammar check and the spans of all keys, members and
elements at once, and one pass per level hands paths and rows down.  No JSON tree is built.

Every array that holds an object becomes a table, named by its path of keys; each of its elements is a row linked to the
element, or the record, that it lies in.  What lies between a row and its scalars is kept in their dotted names, and
arrays of scalars stay one field with their JSON text.

Results:
* a null, cut-off or otherwise incomplete payload yields no rows;
* at the path of a list, an object counts as a list of that object, JSON text as what it holds, to any number of layers;
* null elements take a position but make no row; absent or null fields are no entries;
* deliveries of one record are merged: an element that came several times is one row, that of the greatest fields whole;
* of a repeated key every value counts, and of equal fields the greatest value;
* an object's members are fields of their own; asked for by name, it is also one field with its JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.session import once

_SCALAR = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
OPEN_OBJECT, OPEN_ARRAY, CLOSE_OBJECT, CLOSE_ARRAY, COMMA, COLON, QUOTE = b'{[}],:"'
NULL, SCALAR, STRING, OBJECT, ARRAY = range(5)
_PIECE = 8 << 20


class Index:
    """Structural index of several JSON texts: which are complete, and all their values.

    Of each value: text, parent (index of the value it lies in, -1 for a whole text), lo and hi (its bytes), kind,
    key_lo and key_hi (its key's bytes between the quotes, -1 for none) and place (from 0, in an array or object)."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts) + b"\n"
        b = np.frombuffer(self.buf, np.uint8)
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        end = np.cumsum(lens)
        start = end - lens
        n = len(texts)
        self.valid = np.ones(n, bool)
        slash = b == 0x5C
        escaped = self._escaped(slash)
        quote = (b == QUOTE) & ~escaped
        q = np.cumsum(quote, dtype=np.int32)
        # parity of quotes, restarted at each text so that a cut-off string spoils no later one
        before = np.repeat(np.concatenate(([0], q[end[:-1] - 1])), lens).astype(np.int32) if n else q[:0]
        inside = ((q - before) & 1).astype(bool)  # true from an opening quote to the byte before the closing one
        self.valid &= ~inside[end - 1]
        out = ~(inside | quote)
        pos = np.flatnonzero(out & ((b == OPEN_OBJECT) | (b == OPEN_ARRAY) | (b == CLOSE_OBJECT) | (b == CLOSE_ARRAY) | (b == COMMA) | (b == COLON)))
        sym = b[pos]
        opening, closing = (sym == OPEN_OBJECT) | (sym == OPEN_ARRAY), (sym == CLOSE_OBJECT) | (sym == CLOSE_ARRAY)
        text = np.searchsorted(end, pos, side="right")
        self._check_escapes(b, slash & ~escaped, end)
        depth = np.cumsum(opening.astype(np.int64) - closing)
        first = np.searchsorted(text, np.arange(n))  # first delimiter of each text
        depth -= np.concatenate(([0], depth))[first][text]
        depth += closing  # depth of the container that a delimiter belongs to
        self._fail(text[depth < 1])
        # one stable sort: the delimiters of each container side by side, in their order
        order = np.argsort(text * (int(depth.max(initial=0)) + 2) + np.maximum(depth, 0), kind="stable")
        p, s, t, d = pos[order], sym[order], text[order], depth[order]
        o, c = opening[order], closing[order]
        group = np.concatenate(([True], (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(p) else np.zeros(0, bool)
        box = np.maximum(np.cumsum(o) - 1, 0)  # container that each belongs to
        opener = np.flatnonzero(o)
        is_object = (s[opener] == OPEN_OBJECT)[box] if len(opener) else np.zeros(len(p), bool)
        prev = np.concatenate(([0], s[:-1])) if len(p) else s
        starts = group | np.isin(prev, (CLOSE_OBJECT, CLOSE_ARRAY))
        after_open = (prev == OPEN_OBJECT) | (prev == OPEN_ARRAY)
        good = np.where(o, starts, ~starts)
        good &= np.where(s == COLON, is_object & (after_open | (prev == COMMA)), True)
        good &= np.where(s == COMMA, np.where(is_object, prev == COLON, after_open | (prev == COMMA)), True)
        good &= np.where(c, (s == np.where(is_object, CLOSE_OBJECT, CLOSE_ARRAY)) & np.where(is_object, after_open | (prev == COLON), after_open | (prev == COMMA)), True)
        last = np.concatenate((group[1:], [True])) if len(p) else group
        good &= ~last | c
        self._fail(t[~good])
        # parts: what follows each delimiter but a closing one, up to the next of its container
        white = (b == 0x20) | (b == 0x0A) | (b == 0x0D) | (b == 0x09)
        at = np.arange(len(b), dtype=np.int32)
        following = np.minimum.accumulate(np.where(white, len(b), at)[::-1])[::-1]
        preceding = np.maximum.accumulate(np.where(white, -1, at))
        part = np.flatnonzero(~c[:-1] & self.valid[t[:-1]]) if len(p) else np.zeros(0, np.int64)
        lo, hi = following[p[part] + 1].astype(np.int64), preceding[p[part + 1] - 1].astype(np.int64) + 1
        empty = lo >= hi
        hollow = empty & o[part] & c[part + 1]  # an empty container
        obj = is_object[part]
        key = obj & (s[part] != COLON)
        self._fail(t[part][(empty & ~hollow) | (key & ~hollow & (s[part + 1] != COLON))])
        keys, vals = np.flatnonzero(key & ~hollow), np.flatnonzero(~key & ~hollow)
        quotes = lambda a, z: q[z - 1] - q[a] + quote[a]
        whole = lambda a, z: quote[np.minimum(a, len(b) - 1)] & (z - a >= 2) & quote[z - 1] & (quotes(a, z) == 2)
        self._fail(t[part[keys]][~whole(lo[keys], np.maximum(hi[keys], 1))])
        # values: whole texts first, then parts
        top_lo, top_hi = following[start].astype(np.int64), preceding[end - 1].astype(np.int64) + 1
        self.valid &= top_lo < np.minimum(top_hi, end)
        tops = np.flatnonzero(self.valid)
        self.text = np.concatenate((tops, t[part[vals]]))
        self.lo, self.hi = np.concatenate((top_lo[tops], lo[vals])), np.concatenate((top_hi[tops], hi[vals]))
        vbox = box[part[vals]]
        # the key of a member is the part before its colon
        kpart = np.full(len(p) + 1, -1, np.int64)
        kpart[part[keys] + 1] = keys
        k = np.where(obj[vals], kpart[part[vals]], -1)
        none = np.full(len(tops), -1, np.int64)
        self.key_lo, self.key_hi = (np.concatenate((none, np.where(k >= 0, x, -1))) for x in ((lo[k] + 1, hi[k] - 1) if len(lo) else (k, k)))
        # places: the parts of a container lie side by side
        turn = np.concatenate(([True], vbox[1:] != vbox[:-1])) if len(vals) else np.zeros(0, bool)
        runs = np.flatnonzero(turn)
        self.place = np.concatenate((np.zeros(len(tops), np.int64), np.arange(len(vals)) - np.repeat(runs, np.diff(np.append(runs, len(vals)))) if len(vals) else np.zeros(0, np.int64)))
        # kinds, and which container each value is
        byte = b[self.lo]
        self.kind = np.full(len(self.lo), SCALAR, np.int8)
        boxed = (byte == OPEN_OBJECT) | (byte == OPEN_ARRAY)
        self.kind[byte == OPEN_OBJECT], self.kind[byte == OPEN_ARRAY], self.kind[byte == QUOTE] = OBJECT, ARRAY, STRING
        shuts = np.full(len(opener), -1, np.int64)
        sound = c & self.valid[t]
        shuts[box[sound]] = p[sound]
        value_of = np.full(len(opener) + 1, -1, np.int64)
        if boxed.any():
            rank = np.empty(len(p), np.int64)
            rank[order] = np.arange(len(p))
            mine = box[rank[np.searchsorted(pos, self.lo[boxed])]]
            self._fail(self.text[boxed][shuts[mine] != self.hi[boxed] - 1])
            value_of[mine] = np.flatnonzero(boxed)
        strings = self.kind == STRING
        self._fail(self.text[strings][~whole(self.lo[strings], self.hi[strings])])
        known: dict[bytes, int] = {}
        scalars = np.flatnonzero(self.kind == SCALAR)
        for i, a, z in zip(scalars.tolist(), self.lo[scalars].tolist(), self.hi[scalars].tolist()):
            x = self.buf[a:z]
            code = known.get(x)
            if code is None:
                code = known[x] = NULL if x == b"null" else SCALAR if _SCALAR.fullmatch(x) else -1
            self.kind[i] = code
        self._fail(self.text[self.kind == -1])
        self.parent = np.concatenate((none, value_of[vbox]))
        self._fail(self.text[len(tops) :][self.parent[len(tops) :] < 0])

    def _fail(self, texts: np.ndarray) -> None:
        self.valid[texts] = False

    @staticmethod
    def _escaped(slash: np.ndarray) -> np.ndarray:
        """Bytes behind an odd run of backslashes."""
        if not slash.any():
            return np.zeros(len(slash), bool)
        n = np.arange(len(slash), dtype=np.int32)
        run = np.where(slash, n - np.maximum.accumulate(np.where(slash, -1, n)), 0)
        return np.concatenate(([False], (run[:-1] & 1).astype(bool)))

    def _check_escapes(self, b: np.ndarray, begins: np.ndarray, end: np.ndarray) -> None:
        i = np.flatnonzero(begins)
        if not len(i):
            return
        padded = np.concatenate((b, np.zeros(6, np.uint8)))
        nxt = padded[i + 1]
        hexes = np.zeros(256, bool)
        hexes[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = True
        digits = hexes[padded[i + 2]] & hexes[padded[i + 3]] & hexes[padded[i + 4]] & hexes[padded[i + 5]]
        good = np.isin(nxt, np.frombuffer(b'"\\/bfnrt', np.uint8)) | (nxt == ord("u")) & digits
        self._fail(np.searchsorted(end, i[~good], side="right"))

    def string(self, lo: int, hi: int) -> str:
        """Text between the quotes at lo - 1 and hi."""
        raw = self.buf[lo:hi]
        return json.loads(self.buf[lo - 1 : hi + 1], strict=False) if b"\\" in raw else raw.decode("utf-8", "replace")

    def value(self, i: int) -> str:
        """A string's text; of other values their JSON text, without white space."""
        lo, hi = int(self.lo[i]), int(self.hi[i])
        if self.kind[i] == STRING:
            return self.string(lo + 1, hi - 1)
        if self.kind[i] >= OBJECT:
            return json.dumps(json.loads(self.buf[lo:hi], strict=False), ensure_ascii=False, separators=(",", ":"))
        return self.buf[lo:hi].decode()


class _Rows:
    """Rows and fields of the texts of a batch, and the texts that lie in their strings."""

    def __init__(self, lists: frozenset[str], wanted: frozenset[tuple[str, str]] | None):
        self.lists, self.wanted = lists, wanted
        self.above = frozenset(x[:i] for x in lists for i, ch in enumerate(x) if ch == ".")
        self.record: list[int] = []  # of each row: its record, path, place names, parent row, position
        self.path: list[str] = []
        self.name: list[str] = []
        self.parent: list[int] = []
        self.pos: list[int] = []
        self.fields: list[dict[str, str]] = []
        self.learned: set[str] = set()

    def add(self, record: int, path: str, name: str, parent: int, pos: int) -> int:
        self.record.append(record)
        self.path.append(path)
        self.name.append(name)
        self.parent.append(parent)
        self.pos.append(pos)
        self.fields.append({})
        return len(self.record) - 1

    def walk(self, texts: list[bytes], at: list[tuple[int, str, str, bool]]) -> np.ndarray:
        """Rows of texts, each of which lies at (row, path, name in the row, whether it is an element already): which texts are complete."""
        x = Index(texts)
        inner: list[tuple[bytes, tuple[int, str, str, bool]]] = []
        n = len(x.text)
        ok = x.valid[x.text]
        row, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        places: dict[tuple[str, str], int] = {}  # (path, name in the row) of values, numbered
        names: list[tuple[str, str]] = []

        def number(place: tuple[str, str]) -> int:
            if place not in places:
                places[place] = len(names)
                names.append(place)
            return places[place]

        kids = np.zeros(n, bool)  # arrays that hold an object
        some = ok & (x.parent >= 0) & (x.kind == OBJECT)
        kids[x.parent[some]] = True
        kids &= x.kind == ARRAY
        element = np.zeros(n, bool)
        level = np.flatnonzero(ok & (x.parent < 0))
        for i in level.tolist():
            r, path, name, done = at[x.text[i]]
            row[i], where[i], element[i] = r, number((path, name)), done
        by_parent = np.argsort(x.parent, kind="stable")
        sorted_parent = x.parent[by_parent]
        steps: dict[tuple[int, bytes], int] = {}
        while len(level):
            boxes = self._take(x, level, row, where, element, kids, names, number, inner)
            a, z = np.searchsorted(sorted_parent, boxes), np.searchsorted(sorted_parent, boxes, side="right")
            level = by_parent[np.repeat(a, z - a) + (np.arange((z - a).sum()) - np.repeat(np.cumsum(z - a) - (z - a), z - a))] if len(boxes) else boxes
            up = x.parent[level]
            row[level], where[level] = row[up], where[up]
            element[level] = x.kind[up] == ARRAY
            for i in level[x.key_lo[level] >= 0].tolist():
                raw = x.buf[x.key_lo[i] : x.key_hi[i]]
                step = (int(where[i]), raw)
                to = steps.get(step)
                if to is None:
                    path, name = names[step[0]]
                    k = x.string(int(x.key_lo[i]), int(x.key_hi[i]))
                    to = steps[step] = number((f"{path}.{k}" if path else k, f"{name}.{k}" if name else k))
                where[i] = to
        if inner:
            good = self.walk([t for t, _ in inner], [a for _, a in inner])
            for k in np.flatnonzero(~good).tolist():  # no JSON after all
                t, (r, _, name, _) = inner[k]
                self._put(r, name, lambda t=t: t.decode("utf-8", "surrogatepass"))
        return x.valid

    def _take(self, x: Index, level: np.ndarray, row, where, element, kids, names, number, inner) -> np.ndarray:
        """Rows and fields that the values of a level make; the containers to go into."""
        into = []
        for i, kind, w in zip(level.tolist(), x.kind[level].tolist(), where[level].tolist()):
            path, name = names[w]
            listed = path in self.lists
            if element[i]:
                if kind == NULL:
                    continue
                if x.parent[i] >= 0:  # an element of an array in this text
                    row[i] = self.add(self.record[row[i]], path, f"{self.name[row[i]]}/{path}[{x.place[i]}]", int(row[i]), int(x.place[i]))
                    where[i] = w = number((path, ""))
                    name = ""
                if kind >= OBJECT:
                    into.append(i)
                    if kind == ARRAY and not kids[i]:
                        self._field(x, i, row[i], name)
                        into.pop()
                elif kind == STRING and x.buf[x.lo[i] + 1 : x.lo[i] + 2] in b"{[" and x.hi[i] - x.lo[i] > 3:
                    inner.append((x.value(i).encode("utf-8", "surrogatepass"), (int(row[i]), path, name, True)))
                else:
                    self._field(x, i, row[i], name)
            elif kind == OBJECT:
                if self.wanted and not listed:  # asked for as a whole
                    self._field(x, i, row[i], name)
                if listed:
                    row[i] = self.add(self.record[row[i]], path, f"{self.name[row[i]]}/{path}[0]", int(row[i]), 0)
                    where[i] = number((path, ""))
                into.append(i)
            elif kind == ARRAY:
                if kids[i]:
                    self.learned.add(path)
                if kids[i] or listed:
                    into.append(i)
                else:
                    self._field(x, i, row[i], name)
            elif kind == STRING and (listed or path in self.above):
                t = x.value(i)
                if t.lstrip()[:1] in ("{", "[", '"'):
                    inner.append((t.encode("utf-8", "surrogatepass"), (int(row[i]), path, name, False)))
                else:
                    self._field(x, i, row[i], name)
            elif kind != NULL:
                self._field(x, i, row[i], name)
        return np.array(into, np.int64)

    def _field(self, x: Index, i: int, row: int, name: str) -> None:
        self._put(row, name, lambda: x.value(i))

    def _put(self, row: int, name: str, value) -> None:
        if self.wanted is None or (self.path[row], name) in self.wanted:
            v, f = value(), self.fields[row]
            f[name] = max(f[name], v) if name in f else v


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Records with a payload in pieces that bound the bitmaps' memory."""
    ids, texts = [], []
    size = 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if k is None or t is None:
            continue
        ids.append(k)
        texts.append(t.encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= _PIECE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def list_paths(reports: DataFrame) -> list[str]:
    """Paths at which some complete payload has an array that holds an object, sorted: as many as the records' shapes, to be learned from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in batches:
            for ids, texts in _pieces(b):
                r = _Rows(frozenset(), frozenset())
                r.walk(texts, [(r.add(k, "", "", -1, 0), "", "", False) for k in ids])
                found |= r.learned
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["path"])

    return sorted(r.path for r in _texts(reports).mapInArrow(run, "path string").distinct().collect())


def _texts(reports: DataFrame) -> DataFrame:
    return reports.select(F.col("report_id").cast("bigint"), F.col("payload").cast("string"))


_FIELDS = "array<struct<name:string,value:string>>"
_PA_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def flatten(reports: DataFrame, lists: Iterable[str] | None = None, wanted: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(report_id, path, row_id, parent_id, parent_pos, pos, fields): all rows of all readable payloads, once each; the record itself has the empty path.

    reports needs report_id and payload; other columns are ignored.  lists are the paths whose other forms count as
    lists too (None: list_paths()), wanted the fields (path, name) to read (None: all)."""
    paths = frozenset(list_paths(reports) if lists is None else lists)
    names = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _pieces(b):
                r = _Rows(paths, names)
                tops = [r.add(k, "", "", -1, 0) for k in ids]
                good = r.walk(texts, [(i, "", "", False) for i in tops])
                keep = np.ones(len(r.record), bool)
                keep[: len(tops)] = good
                i = np.flatnonzero(keep).tolist()
                up = [r.parent[k] for k in i]
                fields = [[{"name": n, "value": v} for n, v in sorted(r.fields[k].items())] for k in i]
                cols = [pa.array([r.record[k] for k in i], pa.int64()), pa.array([r.path[k] for k in i]), pa.array([r.name[k] for k in i]), pa.array([r.name[u] if u >= 0 else None for u in up], pa.string()), pa.array([r.pos[u] if u >= 0 and r.path[u] else None for u in up], pa.int32()), pa.array([r.pos[k] for k in i], pa.int32()), pa.array(fields, _PA_FIELDS)]
                yield pa.RecordBatch.from_arrays(cols, names=["report_id", "path", "row_id", "parent_id", "parent_pos", "pos", "fields"])

    rows = _texts(reports).mapInArrow(run, f"report_id bigint, path string, row_id string, parent_id string, parent_pos int, pos int, fields {_FIELDS}")
    one = rows.groupBy("report_id", "row_id").agg(F.max(F.struct("fields", "path", "parent_id", "parent_pos", "pos")).alias("v"))
    return one.select("report_id", "v.path", "row_id", "v.parent_id", "v.parent_pos", "v.pos", "v.fields")


def field(name: str, *others: str):
    """Value of the first of the named fields that a row has, null for none."""
    at = lambda n: F.get(F.filter("fields", lambda f: f["name"] == n), 0)["value"]
    return F.coalesce(*[at(n) for n in (name, *others)])


#: The tables of a report: path, kind of row, fields that label it, fields that detail it.
TABLES = (
    ("scenarios", "scenario", ("id", "name"), ("title", "description")),
    ("scenarios.result.proof_chain", "proof_step", ("rule",), ("premise", "expected_relation")),
    ("steps", "step", ("id", "name"), ("title", "description")),
    ("steps.output.checks", "check", ("concept",), ("premise", "expected_relation")),
)
LISTS = tuple(p for p, *_ in TABLES)


def nodes(reports: DataFrame) -> DataFrame:
    """(report_id, node_kind, parent_pos, pos, label, detail): reports, and the rows of their TABLES; the label is empty where there is none."""
    wanted = {(p, n) for p, _, *names in TABLES for ns in names for n in ns}
    rows = flatten(reports, LISTS, wanted)
    kind = label = detail = None
    for p, k, labels, details in TABLES:
        here = F.col("path") == p
        kind, label, detail = (F.when(here, v) if old is None else old.when(here, v) for old, v in ((kind, F.lit(k)), (label, field(*labels)), (detail, field(*details))))
    known = rows.where(F.col("path").isin("", *LISTS))
    return known.select("report_id", kind.otherwise("report").alias("node_kind"), "parent_pos", "pos", F.coalesce(label, F.lit("")).alias("label"), detail.alias("detail"))


def flat_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """All tables by path, the records' own under the empty one: report_id, row_id, parent_id, parent_pos, pos, fields.  The rows are made once."""
    lists = list_paths(reports)
    rows = once("flat_tables", reports, lambda r: flatten(r, lists))
    return {p: rows.where(F.col("path") == p).drop("path") for p in ["", *lists]}


def found(reports: DataFrame) -> DataFrame:
    """(report_id, child_kind, parent_pos, pos, label) of proof steps and checks."""
    inner = {"scenarios.result.proof_chain": ("proof_step", "rule"), "steps.output.checks": ("check", "concept")}
    rows = flatten(reports, LISTS, {(p, n) for p, (_, n) in inner.items()}).where(F.col("path").isin(*inner))
    kind = F.when(F.col("path") == "steps.output.checks", "check").otherwise("proof_step")
    label = F.coalesce(field("rule", "concept"), F.lit(""))
    return rows.select("report_id", kind.alias("child_kind"), "parent_pos", "pos", label.alias("label"))
