"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And automaton: a bit for each literal position of a rule,
in as many 64-bit words as needed. A step shifts every rule at once and masks by the next byte; a
bit whose rule has a wildcard next holds itself. The automaton reads the canonical URL, host
followed by path, of all URLs of a batch in step, in buckets of equal length; a URL takes as many
steps as it has bytes, whatever the number of rules.

In a glob `*` stands for any run within the host (no `/`), and `**` for any run at all. Matching is
on bytes. A filter rule (host, path) is the globs `host/path**` and `**.host/path**`, the latter
with the run kept within the host.

Canonical: host after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path from
there up to `?`, `#` or the end. A null URL, or one without `://`, has neither. Repeated rows are
judged each for itself; an empty table gives no rows. Columns of the input are passed on if they are named
in `keep`, unless they are called like a result, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B

ONE = np.uint64(1)


@dataclass(frozen=True)
class HostRule:
    """Decides URLs of a host and its subdomains whose path starts so. The longest fitting rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


#: Rules of the contract.
RULES = (HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"), HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"))
#: What decides where no rule fits: block these, allow the rest.
BLOCKED = ("m.**", "blog.**", "**.html", "*/es/**", "ads.**", "*.ads.*/**", "**/login**", "**/wp-admin/**")


class ShiftAnd:
    """State: bits of positions that have been read. Bit 0 of a glob: nothing read yet."""

    def __init__(self, globs: tuple[str, ...]):
        literal, within, across, first, last = [], [], [], [], []
        for glob in globs:
            data, at = glob.encode(), 0
            first.append(len(literal))
            literal.append(None)
            while at < len(data):
                if data[at : at + 2] == b"**":
                    across.append(len(literal) - 1)
                    at += 2
                elif data[at : at + 1] == b"*":
                    within.append(len(literal) - 1)
                    at += 1
                else:
                    literal.append(data[at])
                    at += 1
            last.append(len(literal) - 1)
        self.words = (len(literal) + 63) // 64
        pack = lambda bits: self.packed(np.array(bits, np.int64))
        self.first, self.across, self.within, self.last = pack(first), pack(across), pack(within), np.array(last)
        self.masks = np.zeros((256, self.words), np.uint64)
        for i, b in enumerate(literal):
            if b is not None:
                self.masks[b, i // 64] |= ONE << np.uint64(i % 64)
        self.holds = np.where(np.arange(256)[:, None] == ord("/"), self.across, self.across | self.within)

    def packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= ONE << np.uint64(b % 64)
        return out

    def matches(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row for each string, a column for each glob."""
        n, lengths = len(off) - 1, np.diff(off)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.first, (n, 1))
        active, start = lengths[order], off[:-1][order]
        for step in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(-active, -step, "left"))  # those longer than step
            byte = data[start[:k] + step]
            old = state[:k]
            new = old << ONE
            new[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:k] = (new & self.masks[byte]) | (old & self.holds[byte])
        out = np.empty((n, len(self.last)), bool)
        out[order] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & ONE
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(bare, "/", 1)
    none = url.isNull() | (at == 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(none, "").otherwise(lowered), F.when(none, "").otherwise(F.substring(bare, F.length(host) + 1, F.length(bare)))


def filter_urls(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep`, host, path, rule (of the longest fitting one, else null) and verdict."""
    host, path = canonical(F.make_valid_utf8(F.col(B.quoted(url)).cast("string")))
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    source = pages.select(B.packed(pages, keep), host.alias("host"), path.alias("path"), F.concat(host, path).alias("joined"))
    automaton = ShiftAnd(tuple(g for r in rules for g in r.globs) + tuple(blocked))
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].name))
    names = np.array([rules[i].name for i in order] + [None], object)
    verdicts = np.array([rules[i].verdict for i in order], object)

    def run(parts):
        for part in parts:
            hit = automaton.matches(*B.buffers(part.column(part.num_columns - 1)))
            fits = hit[:, : 2 * len(rules)].reshape(len(hit), len(rules), 2).any(2)[:, order]
            best = np.where(fits.any(1), fits.argmax(1), len(rules)) if len(rules) else np.zeros(len(hit), np.int64)
            verdict = np.where(hit[:, 2 * len(rules) :].any(1), "block", "allow").astype(object)
            ruled = best < len(rules)
            verdict[ruled] = verdicts[best[ruled]]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[best], pa.string()), pa.array(verdict, pa.string())], columns)

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    columns = schema.names
    made = ["host", "path", "rule", "verdict"]
    return B.unpacked(B.ship(source).mapInArrow(run, schema), [*keep, *made], {c: c for c in made})


def pattern(glob: str) -> str:
    """The same glob as a regular expression, for SQL."""
    out = glob.replace(".", "\\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", "(.|\\n)*")
    return f"^{out}$"


def oracle(rules: tuple[HostRule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> str:
    cases = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in cases]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, cases, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, cases, strict=True))
    block = " OR ".join(f"regexp_matches(host || path, '{pattern(g)}')" for g in blocked)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(split_part(split_part(rest, '#', 1), '?', 1), '') AS bare FROM a),
c AS (SELECT page_id, bare, split_part(bare, '/', 1) AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(raw) + 1) AS path FROM c)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {block} THEN 'block' ELSE 'allow' END AS verdict FROM d"""
