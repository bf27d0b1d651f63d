"""Entities, edges, tags and unresolved sites of Python files, by the standard parser, a partition at a time.

Files become rows of one tagged table (what, fields as JSON text), from which the tables are projected.
Names are resolved afterwards by joins on the table of all entities: one match is resolved, several are
ambiguous with sorted candidates, none stays an unresolved site. Attribute calls on objects stay unresolved.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.shipping import ship

PLUGIN = "python"
ROWS = "what string, path string, data string"


def module_of(path: str) -> str:
    parts = path.removesuffix(".pyi").removesuffix(".py").split("/")
    parts = parts[1:] if parts[0] == "src" and len(parts) > 1 else parts
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def dotted(node: ast.AST) -> str | None:
    """A name with its attributes. On anything else an attribute is `().name`, which means no entity."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value) or '()'}.{node.attr}"
    return None


def decorator(node: ast.AST) -> str:
    return dotted(node.func if isinstance(node, ast.Call) else node) or ""


def type_checking(test: ast.AST) -> bool:
    """Whether a guard holds for type checkers only: any part of an `and`, all of an `or`."""
    if isinstance(test, ast.BoolOp):
        return (any if isinstance(test.op, ast.And) else all)(map(type_checking, test.values))
    return (dotted(test) or "").split(".")[-1] == "TYPE_CHECKING"


class Extractor:
    def __init__(self, path: str, text: str):
        self.path, self.module, self.lines = path, module_of(path), text.split("\n")
        self.offsets = [0]
        for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
            self.offsets.append(self.offsets[-1] + len(line) + 1)
        self.out: list[tuple[str, dict]] = []
        self.exported: set[str] | None = None
        self.imported: dict[str, str] = {}

    def add(self, what: str, **fields) -> None:
        self.out.append((what, fields))

    def entity(self, kind: str, name: str, parent: str | None, node: ast.AST | None, **more) -> str:
        first, last = (1, len(self.lines)) if node is None else (min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno)
        body = "\n".join(self.lines[first - 1 : last])
        where = f"{PLUGIN}:{kind}:{name}"
        self.add("entity", id=where, kind=kind, name=name, short_name=name.split(".")[-1], parent_id=parent, line_start=first, line_end=last, content_hash=hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), **more)
        if parent:
            self.add("edge", kind="contains", from_id=parent, to_id=where)
        return where

    def tag(self, where: str, *names: str) -> None:
        for n in names:
            self.add("tag", entity_id=where, tag=n)

    def run(self, text: str, most_nodes: int | None = None) -> list[tuple[str, dict]]:
        try:
            tree = ast.parse(text)
            degraded = "too_complex" if most_nodes is not None and sum(1 for _ in ast.walk(tree)) > most_nodes else None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree, degraded = None, "syntax_error"
        top = self.entity("module", self.module, None, None, properties=json.dumps({"syntax_degraded": degraded} if degraded else {"docstring": ast.get_docstring(tree)} if ast.get_docstring(tree) else {}))
        if degraded:
            return self.out
        for node in tree.body:
            if isinstance(node, ast.Assign) and any(dotted(t) == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
                self.exported = {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
        self.imports(tree, False, False, top)
        self.body(tree.body, self.module, top, top, None)
        return self.out

    def imports(self, node: ast.AST, typed: bool, inner: bool, top: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.If) and type_checking(child.test):
                for part, flag in ((child.body, True), (child.orelse, typed)):
                    for x in part:
                        self.imports(ast.Module([x], []), flag, inner, top)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    self.imported[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self.import_edge(top, a.name, child, typed, inner, imported_name=None, import_style="import", level=0)
            elif isinstance(child, ast.ImportFrom):
                base = self.module.split(".")
                if child.level:
                    drop = child.level - (1 if self.path.endswith("__init__.py") else 0)
                    base = base[: len(base) - drop] if drop <= len(base) else []
                    target = ".".join(base + (child.module.split(".") if child.module else []))
                else:
                    target = child.module or ""
                for a in child.names:
                    self.imported[a.asname or a.name] = f"{target}.{a.name}" if target else a.name
                    to = target if child.module or not child.level else ".".join([*base, a.name])
                    if to:
                        self.import_edge(top, to, child, typed, inner, imported_name=a.name, import_style="from", level=child.level)
            else:
                self.imports(child, typed, inner or isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda), top)

    def import_edge(self, top: str, name: str, node: ast.AST, typed: bool, inner: bool, **properties) -> None:
        properties |= {"type_only": True} if typed else {}
        properties["scope"] = "function" if inner else "module"
        self.add("edge", kind="imports", from_id=top, to_id=f"{PLUGIN}:module:{name}", confidence="resolved", properties=json.dumps(properties), start=self.at(node))

    def at(self, node: ast.AST) -> int:
        return self.offsets[node.lineno - 1] + node.col_offset

    def body(self, body: list[ast.stmt], scope: str, parent: str, top: str, owner: ast.ClassDef | None) -> None:
        seen = {}
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                seen.setdefault(node.name, []).append(node)
        for node in body:
            if isinstance(node, ast.ClassDef):
                self.declare(node, "class", scope, parent, top, owner)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                overload = any(decorator(d).split(".")[-1] == "overload" for d in node.decorator_list)
                if not overload and node is seen[node.name][-1] or overload and all(any(decorator(d).split(".")[-1] == "overload" for d in n.decorator_list) for n in seen[node.name]) and node is seen[node.name][-1]:
                    self.declare(node, "function", scope, parent, top, owner)
            elif isinstance(node, ast.If | ast.Try | ast.With | ast.For | ast.While):
                for field in ("body", "orelse", "finalbody"):
                    self.body(getattr(node, field, []), scope, parent, top, owner)
                for h in getattr(node, "handlers", []):
                    self.body(h.body, scope, parent, top, owner)
                self.sites(node, parent, nested=False)
            else:
                self.sites(node, parent)

    def declare(self, node, kind: str, scope: str, parent: str, top: str, owner: ast.ClassDef | None) -> None:
        name = f"{scope}.{node.name}"
        doc = ast.get_docstring(node)
        signature = f"({ast.unparse(node.args)})" if kind == "function" else f"({', '.join(map(ast.unparse, node.bases))})"
        where = self.entity(kind, name, parent, node, signature=signature, properties=json.dumps({"docstring": doc} if doc else {}))
        marks = [decorator(d) for d in node.decorator_list]
        for d in node.decorator_list:
            self.add("site", kind="decorates", from_id=where, text=decorator(d), start=self.at(d), scope=scope, line=d.lineno)
        if kind == "class":
            for b in node.bases:
                self.add("site", kind="inherits_from", from_id=where, text=dotted(b) or "", start=self.at(b), scope=scope)
            if any(m.split(".")[-1] in ("dataclass", "define", "attrs") for m in marks) or any((dotted(b) or "").split(".")[-1] in ("BaseModel", "TypedDict", "NamedTuple") for b in node.bases):
                self.tag(where, "data-model")
        if kind == "function":
            if node.name == "main":
                self.tag(where, "entry-point")
            if any(m.split(".")[-1] in ("get", "post", "put", "delete", "patch", "route") for m in marks):
                self.tag(where, "http-route")
            if any(m.split(".")[-1] == "command" for m in marks):
                self.tag(where, "cli-command")
        if node.name.startswith("test_" if kind == "function" else "Test"):
            self.tag(where, "test")
        if parent == top:
            if self.exported is not None:
                if node.name in self.exported:
                    self.tag(where, "exported-api")
            elif not node.name.startswith("_"):
                self.tag(where, "public-surface")
        inner = name if kind == "class" else f"{name}.<locals>"
        self.body(node.body, inner, where, top, node if kind == "class" else None)

    def sites(self, node: ast.AST, caller: str, nested: bool = True) -> None:
        """Calls and loaded names below a statement, other definitions left out."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) or (not nested and isinstance(child, ast.stmt | ast.excepthandler)):
                continue
            if isinstance(child, ast.Call):
                self.add("site", kind="calls", from_id=caller, text=dotted(child.func) or "", start=self.at(child), scope=self.module)
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load) and not isinstance(node, ast.Call):
                self.add("site", kind="references", from_id=caller, text=child.id, start=self.at(child), scope=self.module)
            self.sites(child, caller)

    def resolved_text(self, text: str) -> str:
        head, _, rest = text.partition(".")
        base = self.imported.get(head)
        return f"{base}.{rest}" if base and rest else base or text


def extract(files: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """The tagged rows of files (path, content). A file that cannot be parsed gives one module, and says so.

    most_nodes: so does a file whose syntax tree has more nodes; None: every file is taken whole.
    """

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["content"], strict=True):
                e = Extractor(path, text or "")
                for what, fields in e.run(text or "", most_nodes):
                    if what == "site":
                        fields["target"] = e.resolved_text(fields["text"])
                        fields["module"] = e.module
                    rows.append((what, path, json.dumps(fields)))
            yield pd.DataFrame(rows, columns=["what", "path", "data"])

    return ship(files.select("path", "content")).mapInPandas(go, ROWS)


def entities(rows: DataFrame) -> DataFrame:
    fields = "id string, kind string, name string, short_name string, parent_id string, line_start long, line_end long, content_hash string, properties string, signature string"
    e = rows.where("what = 'entity'").select("path", F.from_json("data", fields).alias("d"))
    return e.select("d.id", F.lit(PLUGIN).alias("plugin_id"), "d.kind", "d.name", "d.short_name", "d.parent_id", F.col("path").alias("source_file_path"), F.col("d.line_start").alias("source_line_start"), F.col("d.line_end").alias("source_line_end"), "d.content_hash", F.coalesce("d.properties", F.lit("{}")).alias("properties"), F.lit(None).cast("string").alias("summary"), "d.signature")


def tags(rows: DataFrame) -> DataFrame:
    t = rows.where("what = 'tag'").select(F.from_json("data", "entity_id string, tag string").alias("d"))
    return t.select("d.entity_id", F.lit(PLUGIN).alias("plugin_id"), "d.tag").distinct()


def file_stats(rows: DataFrame) -> DataFrame:
    """(path, entities, tags, sites, finding) of each extracted file; finding: the rule that a file which could not be parsed breaks."""
    n = lambda what: F.count_if(F.col("what") == what)
    bad = F.max(F.when(F.col("what") == "entity", F.get_json_object(F.get_json_object("data", "$.properties"), "$.syntax_degraded")))
    sums = rows.groupBy("path").agg(n("entity").alias("entities"), n("tag").alias("tags"), n("site").alias("sites"), bad.alias("__bad"))
    rule = F.when(F.col("__bad") == "syntax_error", "PY-SYNTAX-ERROR").when(F.col("__bad").isNotNull(), "PY-TOO-COMPLEX")
    return sums.select("path", "entities", "tags", "sites", rule.alias("finding"))


def resolve_sites(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved sites) of the extracted rows against known entities.

    A text means an entity whose name is the text within its module, or the imported name it stands for;
    bases must be classes. Equal names of several entities make the edge ambiguous.
    """
    fields = "kind string, from_id string, text string, target string, module string, start long"
    s = rows.where("what = 'site'").select(F.from_json("data", fields).alias("d")).select("d.*").where("text <> ''")
    s = s.withColumn("__n", F.explode(F.array_distinct(F.array(F.concat_ws(".", "module", "text"), F.col("target")))))
    e = known.select(F.col("name").alias("__n"), F.col("id").alias("to_id"), F.col("kind").alias("__kind"))
    hit = s.join(e, "__n").where((F.col("kind") != "inherits_from") | (F.col("__kind") == "class"))
    hit = hit.where((F.col("kind") == "references") | (F.col("from_id") != F.col("to_id")) | (F.col("kind") == "calls"))
    key = ["kind", "from_id", "text", "start"]
    found = hit.groupBy(*key).agg(F.array_sort(F.collect_set("to_id")).alias("c"))
    one = F.size("c") == 1
    sites = found.select("kind", "from_id", F.get("c", F.lit(0)).alias("to_id"), F.when(one, "resolved").otherwise("ambiguous").alias("confidence"), F.when(~one, F.to_json(F.struct(F.col("c").alias("candidates")))).alias("properties"), F.col("start").alias("source_byte_start"))
    flat = "kind string, from_id string, to_id string, confidence string, properties string, start long"
    own = rows.where("what = 'edge'").select(F.from_json("data", flat).alias("d")).select("d.kind", "d.from_id", "d.to_id", F.coalesce("d.confidence", F.lit("resolved")).alias("confidence"), "d.properties", F.col("d.start").alias("source_byte_start"))
    every = own.unionByName(sites)
    edges = every.groupBy("kind", "from_id", "to_id").agg(F.min_by(F.struct("confidence", "properties", "source_byte_start"), F.coalesce("source_byte_start", F.lit(-1))).alias("r")).select("kind", "from_id", "to_id", "r.*")
    hashes = known.select(F.col("id").alias("from_id"), F.col("content_hash").alias("caller_content_hash"))
    left = s.where("kind = 'calls'").select("from_id", "text", "start").distinct().join(found.where("kind = 'calls'").select("from_id", "text", "start"), ["from_id", "text", "start"], "left_anti").join(hashes, "from_id")
    unresolved = left.select(F.col("from_id").alias("caller_entity_id"), "caller_content_hash", F.concat_ws("-", "start", "text").alias("site_key"), F.col("start").alias("site_ordinal"), F.col("text").alias("callee_expr"), F.col("start").alias("source_byte_start"))
    return edges, unresolved


def problems(found: DataFrame, kinds: tuple[str, ...] = ("module", "class", "function"), most_bytes: int = 1 << 16) -> DataFrame:
    """(id, rule_id) of extracted entities that must not be stored: undeclared kind, id that does not fit, fields too long, paths that leave the tree."""
    rule = (
        F.when(~F.col("kind").isin(*kinds), "UNDECLARED-KIND")
        .when(F.col("id") != F.concat_ws(":", "plugin_id", "kind", "name"), "ID-MISMATCH")
        .when(F.octet_length("properties") > most_bytes, "FIELD-TOO-LONG")
        .when(F.col("source_file_path").startswith("/") | F.array_contains(F.split("source_file_path", "/"), ".."), "PATH-ESCAPE")
    )
    return found.select("id", rule.alias("rule_id")).where("rule_id is not null")
