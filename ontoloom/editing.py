"""Editing an ontology: copy-on-write tables with a change log, role-gated tools, a message board and a scenario runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.ids import norm_id
from ontoloom.operators import enrich, graph, reason
from ontoloom.session import cut
from ontoloom.sources import files

#: What refers to what, and the roles that may write.
REFERENCES = {"properties": ["domain"], "relations": ["domain", "range"], "axioms": ["subject", "object"], "taxonomy": ["child", "parent"]}
WRITERS = {"curator", "validator"}
CUT_EVERY = 20


class Editor:
    """Tables by kind (concepts, properties, relations, axioms; each with id).  An edit replaces a table by a plan over the old one; lineage is cut every CUT_EVERY edits."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables, self.log = spark, dict(tables), []

    def _done(self, op: str, kind: str, ref: str) -> None:
        self.log.append((len(self.log) + 1, op, kind, ref, datetime.now(timezone.utc).replace(tzinfo=None)))
        if len(self.log) % CUT_EVERY == 0:
            self.tables = {k: cut(v) for k, v in self.tables.items()}

    def _row(self, kind: str, row: dict) -> DataFrame:
        schema = self.tables[kind].schema
        return self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)

    def read(self, kind: str, ref: str) -> DataFrame:
        return self.tables[kind].where(norm_id("id") == ref.strip().lower())

    def _require(self, kind: str, ref: str | None) -> None:
        if ref is None or self.read(kind, ref).isEmpty():
            raise ValueError(f"no {kind} {ref!r}")

    def create(self, kind: str, **row) -> None:
        """A relation's or property's ends must exist."""
        for c in REFERENCES.get(kind, []):
            if kind in ("properties", "relations") and c in self.tables[kind].columns:
                self._require("concepts", row.get(c))
        self.tables[kind] = self.tables[kind].unionByName(self._row(kind, row))
        self._done("create", kind, row["id"])

    def update(self, kind: str, ref: str, **changes) -> None:
        """Nulls change nothing."""
        self._require(kind, ref)
        hit = norm_id("id") == ref.strip().lower()
        df = self.tables[kind]
        self.tables[kind] = df.select(*[F.when(hit, F.lit(changes[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if changes.get(c) is not None else F.col(c) for c in df.columns])
        self._done("update", kind, ref)

    def delete(self, kind: str, ref: str) -> None:
        """Deleting a concept deletes what refers to it."""
        self._require(kind, ref)
        if kind == "concepts":
            gone = self.spark.createDataFrame([(ref.strip().lower(),)], "id string")
            for name in ("properties", "relations", "axioms"):
                if name in self.tables:
                    refs = [c for c in REFERENCES[name] if c in self.tables[name].columns]
                    self.tables[name] = enrich.cascade({name: self.tables[name]}, gone, {name: refs})[name]
        self.tables[kind] = self.tables[kind].where(~F.coalesce(norm_id("id") == ref.strip().lower(), F.lit(False)))
        self._done("delete", kind, ref)

    def save(self, path: str) -> None:
        """All tables and the log of changes as Parquet under path."""
        files.save_ontology({**self.tables, "change_log": self.changes()}, path)

    def changes(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, "change_id bigint, op string, target string, ref string, changed_at timestamp_ntz")

    def summary(self) -> DataFrame:
        return enrich.change_summary(self.changes())

    def closure(self) -> DataFrame:
        """(child, ancestor, distance) of the subClassOf axioms."""
        return graph.closure(self.tables["axioms"].where("axiom_type = 'subClassOf'").select(F.col("subject").alias("child"), F.col("object").alias("parent")))


    def _above(self, ref: str) -> DataFrame:
        own = self.spark.createDataFrame([(ref, 0)], "ancestor string, distance int")
        return own.unionByName(self.closure().where(F.col("child") == ref).select("ancestor", "distance"))

    def is_a(self, child: str, parent: str) -> bool:
        """Whether child is parent or lies below it."""
        return not self._above(child).where(F.col("ancestor") == parent).isEmpty()

    def relations_of(self, ref: str) -> DataFrame:
        """(name, range, origin, distance): relations a concept has itself (distance 0) or from above."""
        r = self.tables["relations"].select(F.col("domain").alias("ancestor"), "name", "range")
        return self._above(ref).join(r, "ancestor").select("name", "range", F.col("ancestor").alias("origin"), "distance")

    def properties_of(self, ref: str) -> DataFrame:
        """(name, origin, distance): properties a concept has itself or from above."""
        p = self.tables["properties"].select(F.col("domain").alias("ancestor"), "name")
        return self._above(ref).join(p, "ancestor").select("name", F.col("ancestor").alias("origin"), "distance")


@dataclass
class Agent:
    """A role with tools; only curators and validators get those that write."""

    name: str
    role: str
    editor: Editor
    tools: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self) -> None:
        e = self.editor
        self.tools |= {"read": e.read, "closure": e.closure, "summary": e.summary, "changes": e.changes, "is_a": e.is_a, "relations_of": e.relations_of, "properties_of": e.properties_of}
        if self.role in WRITERS:
            self.tools |= {"create": e.create, "update": e.update, "delete": e.delete}

    def use(self, tool: str, *args, **kwargs):
        if tool not in self.tools:
            raise ValueError(f"{self.role} has no tool {tool!r}")
        return self.tools[tool](*args, **kwargs)


class Team:
    """Agents of distinct names over one editor, and their board."""

    def __init__(self, editor: Editor):
        self.editor, self.agents, self.messages = editor, {}, []

    def add(self, name: str, role: str) -> Agent:
        if name in self.agents:
            raise ValueError(f"there is an agent {name!r}")
        self.agents[name] = Agent(name, role, self.editor)
        return self.agents[name]

    def send(self, sender: str, recipient: str, text: str) -> None:
        self.messages.append((len(self.messages) + 1, sender, recipient, text))

    def board(self) -> DataFrame:
        return self.editor.spark.createDataFrame(self.messages, "pos bigint, sender string, recipient string, text string")

    def inbox(self, name: str) -> DataFrame:
        return enrich.inbox(self.board(), name)


def scenario(editor: Editor, concepts: list[dict], subclass: list[tuple[str, str]], relations: list[dict], inherits: list[tuple[str, str, bool]], paths: list[tuple[str, str]], closures: list[tuple[str, str, bool]], fires: list[tuple[str, str]], max_hops: int = 5) -> DataFrame:
    """(step, name, ok, detail) of seven steps: add concepts, taxonomy and relations, check inheritance, find paths, check the closure, fire triggers (name, text).  A step that fails is reported and the next goes on."""
    spark, out = editor.spark, []

    def add_all(kind: str, rows: list[dict]) -> str:
        for r in rows:
            editor.create(kind, **r)
        return f"{len(rows)} added"

    def inheritance() -> str:
        own = editor.tables["relations"].select("domain", "name")
        up = editor.closure().join(own.withColumnRenamed("domain", "ancestor"), "ancestor").select(F.col("child").alias("domain"), "name")
        have = {tuple(r) for r in own.unionByName(up).join(spark.createDataFrame([(c,) for c, _, _ in inherits], "domain string").distinct(), "domain", "left_semi").distinct().collect()}
        wrong = [(c, r) for c, r, want in inherits if ((c, r) in have) != want]
        if wrong:
            raise AssertionError(f"inheritance differs: {wrong}")
        return f"{len(inherits)} checked"

    def reach() -> str:
        q = spark.createDataFrame(paths, "src string, dst string")
        n = graph.paths(editor.tables["relations"].select("name", "domain", "range"), q, max_hops).select("src", "dst").distinct().count()
        return f"{n} of {len(paths)} reachable"

    def closed() -> str:
        q = spark.createDataFrame([(c, p) for c, p, _ in closures], "child string, ancestor string")
        have = {tuple(r) for r in q.join(editor.closure(), ["child", "ancestor"], "left_semi").collect()}
        wrong = [(c, p) for c, p, want in closures if ((c, p) in have or c == p) != want]
        if wrong:
            raise AssertionError(f"closure differs: {wrong}")
        return f"{len(closures)} checked"

    def trigger() -> str:
        t = editor.tables.get("triggers") or spark.createDataFrame([], "name string, text string")
        return f"{reason.fire(spark.createDataFrame(fires, 'event string, text string'), t, 2).count()} fired"

    axioms = [{"id": f"axiom_{c}_{p}", "axiom_type": "subClassOf", "subject": c, "object": p, "confidence": 1.0} for c, p in subclass]
    steps = [("add_concepts", lambda: add_all("concepts", concepts)), ("add_taxonomy", lambda: add_all("axioms", axioms)), ("add_relations", lambda: add_all("relations", relations)), ("verify_inheritance", inheritance), ("multi_hop", reach), ("subclass_closure", closed), ("triggers", trigger)]
    for i, (name, step) in enumerate(steps, 1):
        try:
            out.append((i, name, True, step()))
        except Exception as e:
            out.append((i, name, False, str(e)[:500]))
    return spark.createDataFrame(out, "step int, name string, ok boolean, detail string")
