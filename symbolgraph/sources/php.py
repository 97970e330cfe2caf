"""Classes, methods, and what they call and use, of PHP sources.

A file is cut into tokens once (strings and comments are single tokens), then read by nesting of braces: names are
resolved through the namespace and the imports; a call's receiver is `$this`, a typed property or parameter, a
variable that `new` was assigned to, or a class. Call sites name a class and a method; which method node that is
is a join over the inheritance closure, done once for all files.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgraph.operators.hierarchy import resolve_method
from symbolgraph.sources.store import Graph

# Types that name no class.
BUILTIN = {"int", "float", "string", "bool", "array", "callable", "iterable", "object", "mixed", "void", "never", "null", "false", "true", "static", "integer", "boolean", "double"}

_TOKEN = re.compile(r"""/\*.*?\*/|//[^\n]*|\#(?!\[)[^\n]*|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|\$\w+|\\?[A-Za-z_]\w*(?:\\\w+)*|::|\?->|->|=>|\d+(?:\.\d+)?|\S""", re.S)
FIELDS = [("kind", pa.string()), ("id", pa.string()), ("parent", pa.string()), ("type", pa.string()), ("name", pa.string()), ("file", pa.string()), ("visibility", pa.string()), ("is_static", pa.bool_()), ("is_abstract", pa.bool_()), ("return_type", pa.string()), ("to_id", pa.string()), ("argument_index", pa.int32()), ("start_row", pa.int32())]
ROWS = "kind string, id string, parent string, type string, name string, file string, visibility string, is_static boolean, is_abstract boolean, return_type string, to_id string, argument_index int, start_row int"


class Reader:
    def __init__(self, file: str, content: str):
        self.file, self.rows = file, []
        body = content.partition("<?php")[2] or content
        at = content.find(body)
        self.tokens, self.lines = [], []
        line, last = content.count("\n", 0, at), at
        for m in _TOKEN.finditer(content, at):
            line += content.count("\n", last, m.start())
            last = m.start()
            if not m[0].startswith(("/*", "//", "#")):
                self.tokens.append(m[0])
                self.lines.append(line)
        self.namespace, self.imports = "", {}

    def peek(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def resolve(self, name: str) -> str:
        if name.startswith("\\"):
            return name[1:]
        head, _, rest = name.partition("\\")
        if head in self.imports:
            return self.imports[head] + ("\\" + rest if rest else "")
        return f"{self.namespace}\\{name}" if self.namespace else name

    def emit(self, kind: str, **values) -> None:
        self.rows.append({"kind": kind, "file": self.file, **values})

    def skip(self, i: int, opening: str, closing: str) -> int:
        """Behind the bracket that closes the one at i."""
        depth = 0
        while i < len(self.tokens):
            depth += (self.tokens[i] == opening) - (self.tokens[i] == closing)
            i += 1
            if depth == 0:
                break
        return i

    def read(self) -> list[dict]:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t == "namespace" and re.match(r"[A-Za-z_]", self.peek(i + 1)):
                self.namespace = self.peek(i + 1)
                i += 2
            elif t == "use":
                i = self.use(i + 1)
            elif t in ("class", "interface", "trait") and re.match(r"[A-Za-z_]\w*$", self.peek(i + 1)) and self.peek(i - 1) not in ("::", "new"):
                i = self.declared(i, t, self.peek(i - 1) == "abstract" or self.peek(i - 2) == "abstract")
            else:
                i += 1
        return self.rows

    def use(self, i: int) -> int:
        while self.peek(i) not in (";", ""):
            name = self.tokens[i].lstrip("\\")
            if self.peek(i + 1) == "as":
                self.imports[self.peek(i + 2)] = name
                i += 3
            elif re.match(r"[A-Za-z_]", name):
                self.imports[name.rsplit("\\", 1)[-1]] = name
                i += 1
            else:
                i += 1
        return i + 1

    def declared(self, i: int, kind: str, abstract: bool) -> int:
        cls = self.resolve(self.peek(i + 1)) if self.peek(i + 1) not in self.imports else f"{self.namespace}\\{self.peek(i + 1)}".lstrip("\\")
        self.emit("node", id=cls, type=kind, name=self.peek(i + 1), is_abstract=abstract, start_row=self.lines[i])
        i += 2
        relation = None
        while self.peek(i) not in ("{", ""):
            t = self.tokens[i]
            if t in ("extends", "implements"):
                relation = t.upper()
            elif relation and re.match(r"\\?[A-Za-z_]", t):
                self.emit("edge", id=cls, to_id=self.resolve(t), type="EXTENDS" if kind == "interface" else relation)
            i += 1
        end = self.skip(i, "{", "}")
        self.members(cls, kind, i + 1, end - 1)
        return end

    def members(self, cls: str, kind: str, i: int, end: int) -> None:
        properties: dict[str, str] = {}
        bodies = []
        visibility, static, abstract, typed = "public", False, False, None
        while i < end:
            t = self.tokens[i]
            if t in ("public", "protected", "private"):
                visibility = t
            elif t == "static":
                static = True
            elif t == "abstract":
                abstract = True
            elif t == "use":
                i += 1
                while self.peek(i) not in (";", "{", ""):
                    if re.match(r"\\?[A-Za-z_]", self.tokens[i]):
                        self.emit("edge", id=cls, to_id=self.resolve(self.tokens[i]), type="USES_TRAIT")
                    i += 1
                i = self.skip(i, "{", "}") - 1 if self.peek(i) == "{" else i
            elif t == "function":
                name = self.peek(i + 1) if self.peek(i + 1) != "&" else self.peek(i + 2)
                method = f"{cls}::{name}"
                opening = self.tokens.index("(", i)
                closing = self.skip(opening, "(", ")")
                params = self.parameters(cls, method, name, opening + 1, closing - 1, properties)
                i, returned = closing, []
                while self.peek(i) not in ("{", ";", ""):
                    if self.tokens[i] not in (":", "?"):
                        returned.append(self.tokens[i])
                    i += 1
                self.emit("node", id=method, parent=cls, type="method", name=name, visibility=visibility, is_static=static, is_abstract=abstract or kind == "interface", return_type="".join(returned) or None, start_row=self.lines[opening])
                self.emit("edge", id=cls, to_id=method, type="CONTAINS")
                if self.peek(i) == "{":
                    after = self.skip(i, "{", "}")
                    bodies.append((method, params, i + 1, after - 1))
                    i = after - 1
                visibility, static, abstract, typed = "public", False, False, None
            elif t.startswith("$"):
                self.emit("node", id=f"{cls}::{t}", parent=cls, type="property", name=t, visibility=visibility, is_static=static, start_row=self.lines[i])
                self.emit("edge", id=cls, to_id=f"{cls}::{t}", type="CONTAINS")
                if typed and typed.lower() not in BUILTIN:
                    properties[t[1:]] = self.resolve(typed)
                while self.peek(i) not in (";", ""):
                    i = self.skip(i, "[", "]") if self.tokens[i] == "[" else self.skip(i, "(", ")") if self.tokens[i] == "(" else i + 1
            elif t == ";":
                visibility, static, abstract, typed = "public", False, False, None
            elif re.match(r"\\?[A-Za-z_]", t) and t not in ("readonly", "final", "var", "const"):
                typed = t
            i += 1
        for method, params, a, b in bodies:
            self.calls(cls, method, {**params}, properties, a, b)

    def parameters(self, cls: str, method: str, name: str, i: int, end: int, properties: dict[str, str]) -> dict[str, str]:
        found, typed, promoted, n = {}, None, False, 0
        while i < end:
            t = self.tokens[i]
            if t in ("public", "protected", "private", "readonly"):
                promoted = True
            elif t.startswith("$"):
                self.emit("node", id=f"{method}::{t}", parent=method, type="parameter", name=t, return_type=typed, start_row=self.lines[i])
                self.emit("edge", id=method, to_id=f"{method}::{t}", type="HAS_PARAMETER", argument_index=n)
                if typed and typed.lower() not in BUILTIN:
                    found[t] = self.resolve(typed)
                    if name == "__construct":
                        self.emit("edge", id=cls, to_id=found[t], type="DEPENDS_ON")
                        properties.setdefault(t[1:], found[t])
                    if promoted:
                        properties[t[1:]] = found[t]
                n += 1
                typed, promoted = None, False
                while i < end and self.tokens[i] != ",":
                    i = self.skip(i, "[", "]") if self.tokens[i] == "[" else self.skip(i, "(", ")") if self.tokens[i] == "(" else i + 1
            elif re.match(r"\\?[A-Za-z_]", t):
                typed = t
            i += 1
        return found

    def calls(self, cls: str, method: str, variables: dict[str, str], properties: dict[str, str], i: int, end: int) -> None:
        while i < end:
            t = self.tokens[i]
            if t == "new" and re.match(r"\\?[A-Za-z_]", self.peek(i + 1)):
                target = cls if self.peek(i + 1) in ("self", "static") else self.resolve(self.peek(i + 1))
                self.emit("call", id=method, parent=target, name="__construct")
                self.emit("edge", id=method, to_id=target, type="INSTANTIATES")
                if self.peek(i - 1) == "=" and self.peek(i - 2).startswith("$"):
                    variables[self.peek(i - 2)] = target
            elif t in ("->", "?->") and self.peek(i + 2) == "(":
                owner = None
                if self.peek(i - 1) == "$this":
                    owner = cls
                elif self.peek(i - 2) in ("->", "?->") and self.peek(i - 3) == "$this":
                    owner = properties.get(self.peek(i - 1))
                elif self.peek(i - 2) not in ("->", "?->", "::"):
                    owner = variables.get(self.peek(i - 1))
                if owner:
                    self.emit("call", id=method, parent=owner, name=self.peek(i + 1))
            elif t == "::" and self.peek(i + 2) == "(" and re.match(r"\\?[A-Za-z_]", self.peek(i - 1)):
                head = self.peek(i - 1)
                if head == "parent":
                    self.emit("call", id=method, parent=cls, name=self.peek(i + 1), type="PARENT")
                else:
                    self.emit("call", id=method, parent=cls if head in ("self", "static") else self.resolve(head), name=self.peek(i + 1), type="STATIC")
            i += 1


def facts(files: DataFrame) -> DataFrame:
    """Nodes, edges and call sites of files (file, content); a file that can't be read gives one row of kind `failure`."""
    schema = pa.schema(FIELDS)

    def read(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += Reader(file, content or "").read()
                except (ValueError, IndexError, RecursionError) as e:
                    rows.append({"kind": "failure", "file": file, "name": type(e).__name__})
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n, _ in FIELDS} for r in rows], schema)

    return files.select("file", "content").mapInArrow(read, ROWS)


def graph(found: DataFrame) -> Graph:
    """The graph of facts(): calls reach the method that their class has or inherits, where it is known."""
    nodes = found.where("kind = 'node'").groupBy("id").agg(F.min_by(F.struct("parent", "type", "name", "file", "visibility", "is_static", "is_abstract", "return_type", "start_row"), F.struct("file", "start_row")).alias("n")).select("id", "n.*")
    links = found.where("kind = 'edge'").select(F.col("id").alias("from_id"), "to_id", "type", F.lit(None).cast("string").alias("call_type"), "argument_index").distinct()
    dispatch = resolve_method(nodes, links)
    sites = found.where("kind = 'call'").select(F.col("id").alias("from_id"), F.col("parent").alias("cls"), "name", F.when(F.col("type") == "STATIC", "STATIC").alias("call_type"), (F.col("type") == "PARENT").alias("up"))
    up = links.where("type = 'EXTENDS'").groupBy(F.col("from_id").alias("cls")).agg(F.min("to_id").alias("base"))
    sites = sites.join(up, "cls", "left").withColumn("cls", F.when(F.col("up"), F.col("base")).otherwise(F.col("cls")))
    interfaces = nodes.where("type = 'interface'").join(nodes.where("type = 'method'").select(F.col("parent").alias("id"), F.col("name").alias("m"), F.col("id").alias("target")), "id").select(F.col("id").alias("cls"), F.col("m").alias("name"), "target")
    calls = sites.join(dispatch.unionByName(interfaces), ["cls", "name"]).select("from_id", F.col("target").alias("to_id"), F.lit("CALLS").alias("type"), "call_type", F.lit(None).cast("int").alias("argument_index")).distinct()
    edges = links.unionByName(calls)
    return Graph(nodes, edges.withColumn("id", F.concat_ws("->", "from_id", "to_id", "type", "call_type", "argument_index")))
