"""Extraction from Rust sources: items, impl blocks, signatures, calls, references, derives, imports and root tags.

There is no compiler here: a lexer cuts a file into tokens, and items are read from their heads and matching
brackets. Files are read one by one on the executors and give tagged rows, as Python files do; paths are
resolved afterwards by a join with the table of entities, over all files at once.

A file that cannot be lexed (brackets that do not match, say) gives its module alone, marked as degraded.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.shipping import ship

PLUGIN = "rust"
ROWS = "what string, path string, data string"
TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*)|(?P<block>/\*)|(?P<string>(?:b|c)?r(?P<fence>#*)\".*?\"(?P=fence)|(?:b|c)?\"(?:\\.|[^\"\\])*\")"
    r"|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])')|(?P<life>'\w+)|(?P<word>(?:r#)?[^\W\d]\w*)|(?P<number>\d[\w]*(?:\.\d[\w]*)?)|(?P<mark>::|->|=>|\.\.=?|[^\w\s])",
    re.S,
)
OPEN, CLOSE = "([{", ")]}"
# Attributes and derives by which frameworks, hosts and compilers reach code.
ROUTES = ("get", "post", "put", "patch", "delete", "head", "options", "trace", "connect", "route")
COMMANDS = ("Parser", "Subcommand", "Args", "ValueEnum", "StructOpt")
ENTRIES = ("pyfunction", "pyfn", "pyclass", "pymodule", "proc_macro", "proc_macro_derive", "proc_macro_attribute")
TESTS = ("test", "bench", "rstest", "test_case", "quickcheck")
# Words of the language that stand before brackets or in types without naming an entity.
WORDS = frozenset("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while yield".split())


def module_of(path: str) -> str:
    """`<crate>.<modules>` of a file below a crate's `src`; binaries of a crate with a library have a root of their own."""
    parts = path.removesuffix(".rs").split("/")
    if "src" not in parts:
        return ".".join(parts)
    at = len(parts) - 1 - parts[::-1].index("src")
    crate = (parts[at - 1] if at else "crate").replace("-", "_")
    inner = parts[at + 1 :]
    if inner[:1] == ["bin"] and len(inner) > 1:
        crate, inner = f"{crate}@bin({inner[1]})", inner[2:]
    if inner and inner[-1] in ("lib", "main", "mod"):
        inner = inner[:-1]
    return ".".join([crate, *inner])


def reserved(text: str) -> str:
    """A text that may stand in an id: `:` is the separator there."""
    return text.replace("%", "%25").replace(":", "%3A")


class Extractor:
    def __init__(self, path: str, text: str):
        self.path, self.module, self.text = path, module_of(path), text
        self.crate = self.module.split(".")[0]
        self.out: list[tuple[str, dict]] = []
        self.kinds: list[str] = []
        self.words: list[str] = []
        self.at: list[int] = []
        self.ends: list[int] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()

    def add(self, what: str, **fields) -> None:
        self.out.append((what, fields))

    # --- tokens ---

    def lex(self) -> None:
        at, n, stack = 0, len(self.text), []
        self.match: dict[int, int] = {}
        while at < n:
            m = TOKEN.match(self.text, at)
            if m is None:
                raise ValueError("no token")
            at, kind, word = m.end(), m.lastgroup, m[0]
            if kind == "block":  # comments nest
                depth = 1
                for x in re.finditer(r"/\*|\*/", self.text[at:]):
                    depth += 1 if x[0] == "/*" else -1
                    if not depth:
                        at += x.end()
                        break
                else:
                    raise ValueError("a comment without end")
                continue
            if kind == "space":
                continue
            if kind == "fence":
                kind = "string"
            if kind == "mark" and word in OPEN:
                stack.append(len(self.words))
            elif kind == "mark" and word in CLOSE:
                if not stack or CLOSE[OPEN.index(self.words[stack[-1]])] != word:
                    raise ValueError("brackets do not match")
                self.match[stack.pop()] = len(self.words)
            self.kinds.append(kind)
            self.words.append(word)
            self.at.append(m.start())
            self.ends.append(m.end())
        if stack:
            raise ValueError("a bracket is open")

    def angles(self, i: int) -> int:
        """The index after the `>` that closes the `<` at i."""
        depth = 0
        while i < len(self.words):
            w = self.words[i]
            if w in OPEN and self.kinds[i] == "mark":
                i = self.match[i]
            elif w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif w in (";", "{"):
                return i
            i += 1
        return i

    def render(self, a: int, z: int) -> str:
        return "".join(self.words[a:z])

    def spaced(self, a: int, z: int) -> str:
        """Tokens as a signature shows them: one space between words, none around paths and brackets."""
        out = ""
        for i in range(a, z):
            w = self.words[i]
            beside = re.match(r"[\w'\"]", w) and re.search(r"[\w>=]$", out)
            out += (" " if out.endswith(",") or out.endswith(":") and not out.endswith("::") or beside else "") + w
        return out

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def byte(self, i: int) -> int:
        return self.at[i] if self.ascii else len(self.text[: self.at[i]].encode("utf-8", "surrogatepass"))

    # --- entities ---

    def entity(self, kind: str, name: str, parent: str | None, first: int, last: int, signature=None, tags=(), **properties) -> str:
        where = f"{PLUGIN}:{kind}:{name}"
        a, z = (self.line(self.at[first]), self.line(self.ends[last] - 1)) if self.at else (1, 1)
        if kind == "module" and parent is None and first == 0:
            a, z = 1, max(1, len(self.lines) - (self.text.endswith("\n") and len(self.lines) > 1))
        body = "\n".join(self.text.split("\n")[a - 1 : z]) if kind == "module" else self.text[self.at[first] : self.ends[last]]
        short = name.rsplit("]", 1)[-1].rsplit(".", 1)[-1] if kind != "impl" else name.split(".")[-1]
        self.add("entity", id=where, kind=kind, name=name, short_name=short, parent_id=parent, line_start=a, line_end=z, content_hash=hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), signature=None if signature is None else json.dumps(signature, sort_keys=True), properties=json.dumps(properties))
        if parent:
            self.add("edge", kind="contains", from_id=parent, to_id=where)
        for t in sorted(set(tags)):
            self.add("tag", entity_id=where, tag=t)
        return where

    def site(self, kind: str, owner: str, path: str, i: int) -> None:
        self.add("site", kind=kind, from_id=owner, text=path, target=self.dotted(path), module=self.crate, start=self.byte(i))

    def dotted(self, path: str) -> str:
        """The qualname that a path means: `crate` and `self` stand for the crate; `super` is left, and means nothing."""
        parts = path.split("::")
        head = self.uses.get(parts[0])
        if head:
            parts = [*head.split("::"), *parts[1:]]
        if parts[0] in ("crate", "self"):
            parts[0] = self.crate
        return ".".join(parts)

    def run(self) -> list[tuple[str, dict]]:
        self.uses: dict[str, str] = {}
        try:
            self.lex()
            self.top = self.entity("module", self.module, None, 0, max(0, len(self.words) - 1))
            self.items(0, len(self.words), self.module, self.top, True, False, True)
        except (ValueError, IndexError, KeyError, RecursionError):
            self.out, self.at = [], []
            self.entity("module", self.module, None, 0, 0, syntax_degraded="syntax_error")
        return self.out

    def attributes(self, i: int, z: int) -> tuple[list[tuple[int, int]], int]:
        """Token ranges inside `#[...]` from i on, and the index after them. `#![...]` is skipped."""
        found = []
        while i < z and self.words[i] == "#" and i + 1 < z:
            k = i + 1 + (self.words[i + 1] == "!")
            if self.words[k] != "[":
                break
            if k == i + 1:
                found.append((k + 1, self.match[k]))
            i = self.match[k] + 1
        return found, i

    def items(self, i: int, z: int, module: str, owner: str, public: bool, testing: bool, top: bool) -> None:
        """Items between two tokens. public: whether all modules around are; testing: whether one is for tests."""
        heads = []
        while i < z:
            first = i
            attrs, i = self.attributes(i, z)
            seen, pub = i, False
            if i < z and self.words[i] == "pub":
                pub, i = True, i + 1
                if i < z and self.words[i] == "(":
                    pub, i = False, self.match[i] + 1
            while i < z and (self.words[i] in ("default", "unsafe", "async", "extern") or self.words[i] == "const" and i + 1 < z and self.words[i + 1] in ("fn", "unsafe", "async", "extern") or self.kinds[i] == "string"):
                i += 1
            word = self.words[i] if i < z else ""
            end = self.end_of(i, z)
            if word in ("mod", "fn", "struct", "enum", "union", "trait", "impl", "type", "const", "static", "use", "macro_rules"):
                heads.append((word, first, i, end, attrs, pub))
                i = end + 1
            else:
                i = max(seen, i, end if word and word not in CLOSE else i) + 1
        for word, _, i, end, _, _ in heads:
            if word == "use":
                for leaf, alias in self.leaves(i + 1, end):
                    self.uses[alias] = leaf
        twins: dict[tuple[str, str], int] = {}
        for word, _, i, end, _, _ in heads:
            key = (word, self.impl_name(i, end)[0] if word == "impl" else self.words[i + 1 + (word == "macro_rules")])
            twins[key] = twins.get(key, 0) + 1
        merged: dict[str, str] = {}
        for word, first, i, end, attrs, pub in heads:
            name = self.impl_name(i, end)[0] if word == "impl" else self.words[i + 1 + (word == "macro_rules")]
            suffix = self.cfg(attrs) if twins[word, name] > 1 else ""
            test = testing or any(self.render(a, b) == "cfg(test)" for a, b in attrs)
            if word == "use":
                for leaf, _ in self.leaves(i + 1, end):
                    self.site("imports", owner, leaf, i)
            elif word == "mod":
                if self.words[i + 2] == "{":
                    inner = f"{module}.{name}{suffix}"
                    where = self.entity("module", inner, None, first, end)
                    self.items(i + 3, end, inner, where, public and pub, test, False)
            elif word == "impl":
                self.implementation(first, i, end, module + "." + name + suffix, owner, public, test, merged)
            else:
                kind = {"fn": "function", "type": "type_alias", "macro_rules": "macro", "union": "struct"}.get(word, word)
                exported = any(self.render(a, b) == "macro_export" for a, b in attrs) if word == "macro_rules" else pub and public
                tags = self.tags(name, exported, word == "fn", attrs, test, top)
                where = self.entity(kind, f"{module}.{name}{suffix}", owner, first, end, self.signature(word, i, end), tags)
                for a, b in attrs:
                    if self.words[a] == "derive":
                        for path, k in self.paths(a + 2, b - 1):
                            self.site("derives", where, path, k)
                self.inside(where, i + 2, end, word)

    def end_of(self, i: int, z: int) -> int:
        """The last token of an item: its closing brace, or the semicolon."""
        while i < z:
            w, mark = self.words[i], self.kinds[i] == "mark"
            if mark and w == ";":
                return i
            if mark and w == "{":
                end = self.match[i]
                return end + 1 if end + 1 < z and self.words[end + 1] == ";" and self.kinds[end + 1] == "mark" else end
            if mark and w in OPEN:
                i = self.match[i]
            elif mark and w == "}":
                return i
            i += 1
        return z - 1

    def leaves(self, a: int, z: int, prefix: str = "") -> Iterator[tuple[str, str]]:
        """(path, name here) of a use tree; globs have none."""
        path = prefix
        while a < z:
            w = self.words[a]
            if w == "{":
                start, end = a + 1, self.match[a]
                for b in self.commas(start, end):
                    yield from self.leaves(b[0], b[1], path)
                return
            if w == "as":
                yield path, self.words[a + 1]
                return
            if w == "*":
                return
            path += w
            a += 1
        path = path.removesuffix("::self").removeprefix("::")
        if path:
            yield path, path.split("::")[-1]

    def commas(self, a: int, z: int) -> list[tuple[int, int]]:
        """Ranges between commas that stand in no bracket or angle."""
        out, start, i, depth = [], a, a, 0
        while i < z:
            w = self.words[i]
            if self.kinds[i] == "mark" and w in OPEN:
                i = self.match[i]
            elif w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
            elif w == "," and depth <= 0:
                out.append((start, i))
                start = i + 1
            i += 1
        return [x for x in (*out, (start, z)) if x[0] < x[1]]

    def parameters(self, i: int) -> tuple[list[str], list[str], int]:
        """(all generic names, those of types, index after) of the `<...>` at i, if there is one."""
        if self.words[i] != "<":
            return [], [], i
        end = self.angles(i)
        names, types = [], []
        for a, _ in self.commas(i + 1, end - 1):
            const = self.words[a] == "const"
            names.append(self.words[a + const])
            if self.kinds[a] == "word" and not const:
                types.append(self.words[a])
        return names, types, end

    def located(self, a: int, z: int, declared: list[str]) -> tuple[str, int | None]:
        """A type as a name: its last segment with its arguments, declared ones by their place. (name, token of the segment)."""
        k, last = a, None
        while k < z and (self.words[k] in ("::", "dyn") or self.kinds[k] == "word"):
            last = k if self.kinds[k] == "word" and self.words[k] != "dyn" else last
            k += 1
        if last is None or k < z and self.words[k] != "<":
            return reserved(self.render(a, z)), None
        base = self.words[last]
        if k >= z:
            return base, last
        args = [declared.index(self.render(x, y)) if self.render(x, y) in declared else reserved(self.render(x, y)) for x, y in self.commas(k + 1, self.angles(k) - 1) if self.kinds[x] != "life"]
        shown = [f"${x}" if isinstance(x, int) else x for x in args]
        return base + (f"<{','.join(shown)}>" if shown else ""), last

    def impl_name(self, i: int, end: int) -> tuple[str, tuple[int, int] | None]:
        """(name of the block, range of its trait)."""
        _, types, k = self.parameters(i + 1)
        body = next(x for x in range(k, end + 1) if self.words[x] in ("{", ";", "where"))
        split = next((x for x in range(k, body) if self.words[x] == "for" and self.words[x + 1] != "<"), None)
        if split is None:
            return f"{self.located(k, body, types)[0]}.impl#<{','.join(f'${n}' for n in range(len(types)))}>", None
        a = k + (self.words[k] == "!")
        trait = self.located(a, split, [])[0]
        return f"{self.located(split + 1, body, types)[0]}.impl[{trait}]", (a, split)

    def implementation(self, first: int, i: int, end: int, name: str, owner: str, public: bool, test: bool, merged: dict[str, str]) -> None:
        """An impl block and its methods. Blocks of one name are one entity."""
        _, trait = self.impl_name(i, end)
        where = merged.get(name)
        if where is None:
            where = merged[name] = self.entity("impl", name, owner, first, end)
            if trait:
                path = re.split("<", self.render(*trait))[0]
                self.site("implements", where, path, trait[0])
        k = next((x for x in range(i, end) if self.words[x] == "{"), end)
        j = k + 1
        while j < end:
            start = j
            attrs, j = self.attributes(j, end)
            pub = j < end and self.words[j] == "pub"
            head = j
            while j < end and self.words[j] not in ("fn", "type", "const") and not (self.words[j] in "{;" and self.kinds[j] == "mark"):
                j = self.match[j] + 1 if self.words[j] in OPEN and self.kinds[j] == "mark" else j + 1
            if j < end and self.words[j] == "const" and self.words[j + 1] in ("fn", "unsafe", "async", "extern"):
                j = next(x for x in range(j, end) if self.words[x] == "fn")
            last = self.end_of(j, end)
            if j < end and self.words[j] == "fn":
                exported = pub and self.words[head + 1] != "(" and public
                own = test or any(self.render(a, b) == "cfg(test)" for a, b in attrs)
                m = self.entity("function", f"{name}.{self.words[j + 1]}", where, start, last, self.signature("fn", j, last), self.tags(self.words[j + 1], exported, True, attrs, own, False))
                self.inside(m, j + 2, last, "fn")
            j = last + 1

    def cfg(self, attrs: list[tuple[int, int]]) -> str:
        found = sorted(reserved(self.render(a + 2, b - 1)) for a, b in attrs if self.words[a] == "cfg")
        return f"@cfg({'&'.join(found)})" if found else ""

    def signature(self, word: str, i: int, end: int):
        if word == "fn":
            names, _, k = self.parameters(i + 2)
            close = self.match[k]
            params = [self.spaced(a, b) for a, b in self.commas(k + 1, close)]
            stop = next((x for x in range(close, end + 1) if self.words[x] in ("{", ";", "where")), end)
            back = self.spaced(close + 2, stop) if self.words[close + 1] == "->" else ""
            return {"v": 1, "params": params, "return_ann": back, "generics": names}
        if word in ("struct", "union"):
            _, _, k = self.parameters(i + 2)
            opened = next((x for x in range(k, end + 1) if self.words[x] in ("{", "(", ";")), end)
            fields = [] if self.words[opened] == ";" else [self.spaced(self.attributes(a, b)[1], b) for a, b in self.commas(opened + 1, self.match[opened])]
            return {"v": 1, "fields": [re.sub(r"^pub ?(\([^)]*\))? ?", "", f) for f in fields]}
        return None

    def tags(self, name: str, exported: bool, is_fn: bool, attrs: list[tuple[int, int]], test: bool, top: bool) -> set[str]:
        out, last = set(), []
        for a, b in attrs:
            head = re.match(r"[\w:]*", self.render(a, b))[0]
            last.append(head.split("::")[-1])
            if head == "derive" and any(p.split("::")[-1] in COMMANDS for p, _ in self.paths(a + 2, b - 1)):
                out |= {"cli-command", "framework-handler"}
            if head in ("allow", "expect") and "dead_code" in self.words[a:b]:
                out.add("allow-dead-code")
        if exported and "@bin(" not in self.module:
            out.add("exported-api")
        if test or any(x in TESTS for x in last):
            out.add("test")
        if is_fn and top and name == "main" or any(x in ENTRIES for x in last) or is_fn and name == "main" and "main" in last:
            out.add("entry-point")
        if any(x in ROUTES for x in last):
            out |= {"http-route", "framework-handler"}
        return out

    # --- sites ---

    def paths(self, a: int, z: int) -> Iterator[tuple[str, int]]:
        """Paths among the tokens, and where they begin. Not those after a dot."""
        i = a
        while i < z:
            if self.kinds[i] != "word" or i > a and self.words[i - 1] == ".":
                i += 1
                continue
            start, path = i, self.words[i]
            while i + 2 < z and self.words[i + 1] == "::" and self.kinds[i + 2] == "word":
                path += "::" + self.words[i + 2]
                i += 2
            yield path, start
            i += 1

    def inside(self, where: str, a: int, z: int, word: str) -> None:
        """Calls and references between two tokens of an item."""
        for path, i in self.paths(a, z):
            last = i + 2 * path.count("::")
            after = self.words[last + 1] if last + 1 < len(self.words) else ""
            if after == "::" and last + 2 < len(self.words) and self.words[last + 2] == "<":
                k = self.angles(last + 2)
                after = self.words[k] if k < len(self.words) else ""
            if path.split("::")[0] in WORDS and "::" not in path or self.words[i - 1] in ("fn", "let", "mod", "'"):
                continue
            if after == "(" and word == "fn":
                self.site("calls", where, path, i)
            elif after not in ("!", ":") and (path[:1].isupper() or "::" in path):
                self.site("references", where, path, i)
        if word == "fn":
            for i in range(a, z):
                if self.words[i] == "." and self.kinds[i + 1] == "word" and i + 2 < len(self.words) and self.words[i + 2] == "(":
                    self.add("site", kind="calls", from_id=where, text="." + self.words[i + 1], target=None, module=self.crate, start=self.byte(i + 1))


def extract(files: DataFrame) -> DataFrame:
    """The tagged rows of files (path, content)."""

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(what, path, json.dumps(fields)) for path, text in zip(part["path"], part["content"], strict=True) for what, fields in Extractor(path, text or "").run()]
            yield pd.DataFrame(rows, columns=["what", "path", "data"])

    return ship(files.select("path", "content")).mapInPandas(go, ROWS)


def entities(rows: DataFrame) -> DataFrame:
    fields = "id string, kind string, name string, short_name string, parent_id string, line_start long, line_end long, content_hash string, properties string, signature string"
    e = rows.where("what = 'entity'").select("path", F.from_json("data", fields).alias("d"))
    return e.select("d.id", F.lit(PLUGIN).alias("plugin_id"), "d.kind", "d.name", "d.short_name", "d.parent_id", F.col("path").alias("source_file_path"), F.col("d.line_start").alias("source_line_start"), F.col("d.line_end").alias("source_line_end"), "d.content_hash", F.coalesce("d.properties", F.lit("{}")).alias("properties"), F.lit(None).cast("string").alias("summary"), "d.signature")


def tags(rows: DataFrame) -> DataFrame:
    t = rows.where("what = 'tag'").select(F.from_json("data", "entity_id string, tag string").alias("d"))
    return t.select("d.entity_id", F.lit(PLUGIN).alias("plugin_id"), "d.tag").distinct()


#: What the target of a site may be.
TARGETS = {"calls": ("function",), "implements": ("trait",), "derives": ("trait", "macro"), "references": ("struct", "enum", "trait", "type_alias", "const", "static"), "imports": ("module", "struct", "enum", "trait", "type_alias", "const", "static", "function", "macro")}


def resolve_sites(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved calls) of the extracted rows against known entities.

    A path means the entity of its qualname, or if it is one word and there is none, that of the crate. One
    entity makes an edge resolved; several of one qualname make it ambiguous, to the first by id; none means
    that it lies outside, and a call then stays unresolved.
    """
    fields = "kind string, from_id string, text string, target string, module string, start long"
    s = rows.where("what = 'site'").select(F.from_json("data", fields).alias("d")).select("d.*")
    single = ~F.col("text").contains("::")
    names = F.array_compact(F.array(F.struct(F.lit(0).alias("rank"), F.col("target").alias("n")), F.when(single, F.struct(F.lit(1).alias("rank"), F.concat_ws(".", "module", "target").alias("n")))))
    tried = s.where("target is not null").withColumn("x", F.explode(names)).select("kind", "from_id", "text", "start", "x.*")
    e = known.select(F.col("name").alias("n"), F.col("id").alias("to_id"), F.col("kind").alias("__kind"))
    may = F.lit(False)
    for kind, to in TARGETS.items():
        may = may | ((F.col("kind") == kind) & F.col("__kind").isin(*to))
    key = ["kind", "from_id", "text", "start"]
    hit = tried.join(e, "n").where(may & (F.col("from_id") != F.col("to_id")) | (F.col("kind") == "calls") & (F.col("__kind") == "function"))
    found = hit.groupBy(*key, "rank").agg(F.array_sort(F.collect_set("to_id")).alias("c")).groupBy(*key).agg(F.min_by("c", "rank").alias("c"))
    one = F.size("c") == 1
    sites = found.select("kind", "from_id", F.get("c", F.lit(0)).alias("to_id"), F.when(one, "resolved").otherwise("ambiguous").alias("confidence"), F.when(~one, F.to_json(F.struct(F.col("c").alias("candidates")))).alias("properties"), F.col("start").alias("source_byte_start"))
    own = rows.where("what = 'edge'").select(F.from_json("data", "kind string, from_id string, to_id string").alias("d")).select("d.kind", "d.from_id", "d.to_id", F.lit("resolved").alias("confidence"), F.lit(None).cast("string").alias("properties"), F.lit(None).cast("long").alias("source_byte_start"))
    every = own.unionByName(sites)
    edges = every.groupBy("kind", "from_id", "to_id").agg(F.min_by(F.struct("confidence", "properties", "source_byte_start"), F.coalesce("source_byte_start", F.lit(-1))).alias("r")).select("kind", "from_id", "to_id", "r.*")
    hashes = known.select(F.col("id").alias("from_id"), F.col("content_hash").alias("caller_content_hash"))
    left = s.where("kind = 'calls'").select(*key).distinct().join(found.select(*key), key, "left_anti").join(hashes, "from_id")
    return edges, left.select(F.col("from_id").alias("caller_entity_id"), "caller_content_hash", F.concat_ws("-", "start", "text").alias("site_key"), F.col("start").alias("site_ordinal"), F.col("text").alias("callee_expr"), F.col("start").alias("source_byte_start"))
