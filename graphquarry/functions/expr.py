"""Column expressions that operators share. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphquarry.schema import CONFIDENCES


def confidence_rank(confidence: Column) -> Column:
    """0 resolved, 1 ambiguous, 2 inferred; null for anything else."""
    out = F.lit(None).cast("int")
    for rank, name in reversed(list(enumerate(CONFIDENCES))):
        out = F.when(confidence == name, F.lit(rank)).otherwise(out)
    return out


def within_ceiling(confidence: Column, ceiling: str = "resolved") -> Column:
    return confidence.isin(*CONFIDENCES[: CONFIDENCES.index(ceiling) + 1])


def qualname(entity_id: Column) -> Column:
    """What follows an id's second colon."""
    return F.get(F.split(entity_id, ":", 3), F.lit(2))


def locator(plugin: Column, kind: Column, name: Column) -> Column:
    """plugin:kind:name, or null where a segment is empty, has a colon, or is no identifier."""
    good = plugin.rlike("^[a-z][a-z0-9_]*$") & kind.rlike("^[a-z][a-z0-9_]*$") & (name != "") & ~name.contains(":")
    return F.when(good, F.concat_ws(":", plugin, kind, name))


def folded(text: Column) -> Column:
    """ASCII letters in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def block_reason(properties: Column) -> Column:
    """Why an entity's content is withheld; JSON that cannot be read withholds too."""
    return F.when(properties.isNull(), F.lit(None).cast("string")).when(~is_json(properties), F.lit("malformed_properties_json")).otherwise(F.get_json_object(properties, "$.briefing_blocked"))


def runtime_import(properties: Column) -> Column:
    """Whether an import edge runs when the module is loaded. Unreadable properties count as such."""
    typed = F.coalesce(F.get_json_object(properties, "$.type_only"), F.lit("0"))
    scope = F.coalesce(F.get_json_object(properties, "$.scope"), F.lit("module"))
    return properties.isNull() | ~is_json(properties) | (~typed.isin("1", "true") & (scope == "module"))


def candidates(properties: Column) -> Column:
    """The other targets an ambiguous edge may have, sorted and distinct; empty if none can be read."""
    names = F.from_json(F.get_json_object(properties, "$.candidates"), "array<string>")
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), F.array().cast("array<string>"))


def callee_leaf(callee: Column) -> Column:
    """The last name of a call's text, after `.` or `:`, without white space around it; null if that is no identifier."""
    leaf = F.regexp_replace(F.regexp_extract(callee, "([^.:]*)$", 1), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return F.when(leaf.rlike(r"^[\p{IsAlphabetic}\p{N}_]+$"), leaf)


def unresolved_why(callee: Column) -> Column:
    return F.when(callee.contains("."), "attribute-receiver").otherwise("dynamic")


def language(stored: Column, plugin: Column, path: Column) -> Column:
    """Stored language, else the plugin's, else by extension."""
    of_plugin = F.when(plugin.isin("python", "rust"), plugin)
    of_path = F.when(path.endswith(".py"), "python").when(path.endswith(".rs"), "rust").when(path.endswith(".ts"), "typescript").when(path.endswith(".js"), "javascript").when(path.endswith(".go"), "go")
    return F.coalesce(stored, of_plugin, of_path)


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test's: a folder `test` or `tests` inside, or a file named as tests are."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    file = F.element_at(F.split(low, "/"), -1)
    return low.contains("/tests/") | low.contains("/test/") | file.startswith("test_") | file.endswith("_test.py") | (file == "conftest.py")


def admits(path: Column, scope: str) -> Column:
    """A path scope: all, production or test. Only `all` takes a path that is not known."""
    if scope == "all":
        return F.lit(True)
    test = F.coalesce(is_test_path(path), F.lit(False))
    return path.isNotNull() & (test if scope == "test" else ~test)


def glob_regex(glob: str) -> str:
    """`*` and `?` stay within a segment; `**` as a whole segment is any number of segments, none included."""
    parts = glob.split("/")
    out = ""
    for part in parts:
        if part == "**":
            # each segment stands with a slash before it; the text is matched with one in front
            out += "(?:/[^/]*)*"
        else:
            out += "/" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return F.concat(F.lit("/"), path).rlike(glob_regex(glob))


def scalar_facet(json: Column, name: str) -> Column:
    """A string, number or truth value of a JSON object as text; null for objects and arrays. Strings may begin with any character."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant"))
    return F.when(~kind.rlike("^(OBJECT|ARRAY)"), value)


def entropy(text: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes, in bits. One pass counts them; the counts then give the sum."""
    raw = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    runs = F.array_sort(raw)
    n = F.size(raw)
    # runs of equal bytes in the sorted list: a struct of the sum so far, the byte at hand and its count
    part = lambda k: F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0)
    start = F.struct(F.lit(0.0).alias("s"), F.lit("").alias("c"), F.lit(0).alias("k"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(a["s"].alias("s"), c.alias("c"), (a["k"] + 1).alias("k"))).otherwise(F.struct((a["s"] - part(a["k"])).alias("s"), c.alias("c"), F.lit(1).alias("k")))
    return F.when(n > 0, F.aggregate(runs, start, step, lambda a: a["s"] - part(a["k"]))).otherwise(0.0)


def looks_secret(name: Column, least: int = 20, bits: float = 4.5) -> Column:
    """Whether a segment of a name is as long and as random as a secret."""
    return F.exists(F.split(name, "[:.]"), lambda s: (F.octet_length(s) >= least) & (entropy(s) >= bits))


def cosine(a: Column, b: Column) -> Column:
    """Null where lengths differ or a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def unix_seconds(stamp: Column) -> Column:
    """`unix:<seconds>` or ISO text as seconds; null if neither."""
    return F.when(stamp.startswith("unix:"), F.expr("0") + F.substring(stamp, 6, 20).try_cast("long")).otherwise(F.unix_seconds(F.try_to_timestamp(stamp)))


def drifted(current: Column, stored: Column) -> Column:
    """Whether a count changed by more than half; from nothing any count is a drift."""
    return F.abs(current - stored) * 2 > F.abs(stored)


def wire_severity(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", "critical").when(severity == "ERROR", "high").when(severity == "WARN", "medium").otherwise("info")


def estimated_tokens(chars: Column, least: int = 0) -> Column:
    return F.greatest(F.ceil(chars / 4).cast("long"), F.lit(least).cast("long"))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def module_name(path: Column) -> Column:
    """Dotted module of a Python file: without a leading `src/`, the extension and `__init__`."""
    bare = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.pyi?$", "")
    return F.replace(F.regexp_replace(bare, "(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def clean_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "")))


def mint_sei(where: Column, run: Column, prefix: str = "sei:") -> Column:
    """A stable identity's token. Opaque to readers, so any good hash serves."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(where, F.lit("\0"), run), 256), 1, 32))


def cluster_hash(members: Column) -> Column:
    """12 hexadecimal digits of the SHA-256 of the sorted members, joined."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), ""), 256), 1, 12)
