"""Line deduplication by a fixed-depth log-template tree, in DataFrame operations only.

A line's fields that vary are generalised: a word with a digit, or an `@`, or `://`, becomes `<*>`.
The tree's leaf of a line is its number of words and its first `depth` generalised words. Within a
leaf the template that most documents have leads (ties: the greater text), and templates that agree
with it in `similar` of their words join its group. Of the templates that no group has taken, again the
one that most documents have leads, and so on, until fewer than `least_docs` documents of the leaf have
any that are left. A round finds all groups that the first `HEAD` templates of each leaf lead, for all leaves at once, so
nearly all leaves need one; templates that cannot be similar to any other are left out of further ones. A group found in `least_docs` documents or more
recurs; its lines are dropped from all these documents but the first (least doc_id, nulls last), so
that no text is lost altogether. Lines of fewer than `least_words` words are never dropped.

A first pass counts lines by hashed leaf, from the number of words and the first few of them alone; only
lines of leaves that recur take part in the rest, in a second pass, and only theirs are generalised
whole. A sieve of at most 2**20 slots (recurring leaves by hash) is broadcast so that most other lines
go before the shuffle; the exact join follows. Documents are counted in two steps, first by document, so a
line in a third of all documents is no group in one task; joins on leaves and templates are equi-joins
that adaptive execution splits where a key is hot.

Words are runs of characters other than space and U+0009 to U+000D; lines end at U+000A. Null texts
become empty ones. Rows with equal doc_id and text are one document and are treated alike; empty
texts have one empty line. Long texts are taken whole, an empty table gives no rows. Other columns are
passed on, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm import batches as B
from graphquarry.operators.components import ensure_checkpoint_dir, written

SPACE = " \t\n\x0b\x0c\r"
WILD = "<*>"
#: Slots of the sieve, at most so many longs to broadcast.
SIEVE = 1 << 20
DEPTH, SIMILAR, LEAST_DOCS, LEAST_WORDS = 3, 0.7, 10, 3
#: Templates of a leaf whose groups are found in one round.
HEAD = 512
#: A word with a digit, an @ or ://, from its first character on.
VARIABLE = f"(?<![^{SPACE}])[^{SPACE}0-9@:]*+(?::(?!//)[^{SPACE}0-9@:]*+)*+(?:[0-9@]|://)[^{SPACE}]*+"


KEY = ["__k1", "__k2"]
LEAF = ["__l1", "__l2"]


def key(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart: two hashes of doc_id and text, because doc_id may be null or repeat."""
    return [F.xxhash64(F.lit(i), doc_id, text).alias(name) for i, name in enumerate(KEY, 1)]


def generalised(words: Column) -> Column:
    """Words in one string, those that vary as WILD."""
    line = F.array_join(words, " ")
    return F.when(line.rlike("[0-9@]|://"), F.regexp_replace(line, VARIABLE, WILD)).otherwise(line)


def parsed(docs: DataFrame, depth: int, least_words: int) -> DataFrame:
    """A row for each line of `least_words` words or more: document, position, words and leaf."""
    text = F.col("__text")
    for space in SPACE.replace("\n", "").replace(" ", ""):
        text = F.replace(text, F.lit(space), F.lit(" "))
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.array_remove(F.split(line, " "), ""))
    lines = docs.select(*(c for c in docs.columns if c != "__text"), F.posexplode(lines).alias("__pos", "__words")).where(F.size("__words") >= least_words)
    lines = lines.withColumn("__head", generalised(F.slice("__words", 1, depth)))
    return lines.withColumns({name: F.xxhash64(F.lit(i), F.size("__words"), "__head") for i, name in enumerate(LEAF, 1)}).drop("__head")


def similar_to(words: Column, others: Column, similar: float) -> Column:
    equal = F.aggregate(F.zip_with(words, others, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return (F.size(words) == F.size(others)) & ((words == others) | (equal >= similar * F.size(words)))


def alone(rest: DataFrame, similar: float) -> DataFrame:
    """Templates that no other of their leaf can be similar to.

    Similar ones differ in at most d words, so that of d + 1 stretches of words one at least is the same in both.
    """
    words = F.split("__template", " ")
    size = F.size(words)
    stretches = F.floor(size - similar * size + 1e-9).cast("int") + 1
    cut = lambda i: F.floor(i * size / stretches).cast("int")
    keys = F.transform(F.sequence(F.lit(0), stretches - 1), lambda i: F.xxhash64(i, F.array_join(F.slice(words, cut(i) + 1, cut(i + 1) - cut(i)), " ")))
    keys = written(rest.select(*LEAF, F.xxhash64("__template").alias("__t"), F.explode(keys).alias("__key")))
    shared = written(keys.groupBy(*LEAF, "__key").agg(F.min("__t").alias("a"), F.max("__t").alias("b")).where("a < b").select(*LEAF, "__key"))
    near = keys.join(shared, [*LEAF, "__key"], "left_semi").select(*LEAF, "__t").distinct()
    return rest.withColumn("__t", F.xxhash64("__template")).join(near, [*LEAF, "__t"], "left_anti").drop("__t")


def groups(by_doc: DataFrame, similar: float, least_docs: int, head: int = HEAD) -> DataFrame:
    """Leaf, template and group (its leading template). Templates that can be in no group of `least_docs` documents may have none.

    Each round takes the `head` templates of a leaf that lead the others: which of them lead groups depends on
    them alone. Then all templates of the leaf join the first of these groups that they fit, and what is left goes on.
    """
    rest = written(by_doc.groupBy(*LEAF, "__template").agg(F.count("*").alias("__n")))
    words = lambda c: F.split(c, " ")
    order = Window.partitionBy(*LEAF).orderBy(F.col("__n").desc(), F.col("__template").desc())
    found = []
    while True:
        many = rest.groupBy(*LEAF).agg(F.sum("__n").alias("__sum")).where(F.col("__sum") >= least_docs).select(*LEAF)  # documents at most
        rest = rest.join(many, LEAF, "left_semi")
        first = rest.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= head)
        first = first.groupBy(*LEAF).agg(F.sort_array(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__template").alias("t"))), asc=False).alias("__first"))
        ordered = F.transform("__first", lambda x: words(x["t"]))
        leads = F.aggregate(ordered, F.array().cast("array<array<string>>"), lambda found, x: F.when(F.exists(found, lambda y: similar_to(x, y, similar)), found).otherwise(F.concat(found, F.array(x))))
        mine = words("__template")
        lead = F.aggregate("__leads", F.lit(None).cast("array<string>"), lambda got, y: F.when(got.isNotNull(), got).when(similar_to(mine, y, similar), y))
        tried = written(rest.join(first.select(*LEAF, leads.alias("__leads")), LEAF).select(*LEAF, "__template", "__n", F.array_join(lead, " ").alias("__group")))
        found.append(tried.where("__group is not null").select(*LEAF, "__template", "__group"))
        rest = tried.where("__group is null").select(*LEAF, "__template", "__n")
        if rest.isEmpty():
            break
        if len(found) == 1:  # what can join nothing leads itself alone, and needs no rounds
            single = written(alone(rest, similar))
            found.append(single.select(*LEAF, "__template", F.col("__template").alias("__group")))
            rest = written(rest.join(single, [*LEAF, "__template"], "left_anti"))
            if rest.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def recurring(lines: DataFrame, similar: float, least_docs: int) -> DataFrame:
    """The templates to drop, with the document of their group that keeps them: leaf, template, and key."""
    by_doc = written(lines.select(*LEAF, "__template", "__id", *KEY).distinct())
    grouped = written(groups(by_doc, similar, least_docs))
    in_docs = by_doc.join(grouped, [*LEAF, "__template"]).select(*LEAF, "__group", "__id", *KEY).distinct()
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), *KEY)).alias("__first")
    counted = in_docs.groupBy(*LEAF, "__group").agg(F.count("*").alias("__docs"), first).where(F.col("__docs") >= least_docs)
    counted = written(counted)  # so that the join deals both sides anew and can split a group of many templates
    return grouped.join(counted, [*LEAF, "__group"]).select(*LEAF, "__template", F.col("__first.__k1").alias("__f1"), F.col("__first.__k2").alias("__f2"))


def drop_lines(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """The documents with recurring lines taken out of their text, and n_lines and n_dropped.

    The columns of the input keep their places; n_lines and n_dropped replace columns of that name.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    content = B.text_or_empty(text)
    plain = docs.select(F.col("doc_id").alias("__id"), *key(F.col("doc_id"), content), content.alias("__text"))
    leaves = parsed(plain.select("__text"), depth, least_words).groupBy(*LEAF).agg(F.count("*").alias("__n")).where(F.col("__n") >= least_docs).select(*LEAF).checkpoint()
    slot = F.pmod("__l1", F.lit(SIEVE))
    lines = parsed(plain, depth, least_words).join(F.broadcast(leaves.select(slot.alias("__slot")).distinct()), slot == F.col("__slot"), "left_semi")
    lines = written(lines.withColumn("__template", generalised(F.col("__words"))).drop("__words").join(leaves, LEAF, "left_semi"))
    gone = lines.join(recurring(lines, similar, least_docs), [*LEAF, "__template"]).where((F.col("__k1") != F.col("__f1")) | (F.col("__k2") != F.col("__f2")))
    gone = gone.groupBy(*KEY).agg(F.collect_set("__pos").alias("__gone"))
    out = docs.select(B.packed(docs), *key(F.col("doc_id"), content)).join(gone.hint("shuffle_hash"), KEY, "left")
    content = F.make_valid_utf8(F.coalesce(F.col(B.ROW).getField(text).cast("string"), F.lit("")))
    out = out.select(B.ROW, "__gone", content.alias("__text"), F.split(content, "\n", -1).alias("__lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.get("__lines", i))
    kept = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
    out = out.select(B.ROW, kept.alias("__kept"), F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
    made = {text: "__kept", "n_lines": "n_lines", "n_dropped": "n_dropped"}
    return B.unpacked(out, list(dict.fromkeys([*docs.columns, *made])), made)


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
w AS (SELECT doc_id, pos, list_transform(regexp_extract_all(line, '[^ \\t-\\r]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '{WILD}' ELSE x END) AS w FROM l),
t AS (SELECT doc_id, pos, w, len(w) AS n, array_to_string(w[1:{DEPTH}], ' ') AS head, array_to_string(w, ' ') AS template FROM w WHERE len(w) >= {LEAST_WORDS}),
c AS (SELECT n, head, template, any_value(w) AS w, count(DISTINCT doc_id) AS k FROM t GROUP BY ALL),
e AS (SELECT n, head, arg_max(template, (k, template)) AS lead, arg_max(w, (k, template)) AS lw FROM c GROUP BY ALL),
g AS (SELECT n, head, template, CASE WHEN len(list_filter(list_zip(w, lw), lambda x: x[1] = x[2])) >= {SIMILAR} * n THEN lead ELSE template END AS grp FROM c JOIN e USING (n, head)),
r AS (SELECT n, head, grp, min(doc_id) AS first FROM t JOIN g USING (n, head, template) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM t JOIN g USING (n, head, template) JOIN r USING (n, head, grp) WHERE doc_id <> first GROUP BY doc_id)
SELECT doc_id, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: lines[i + 1]), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)"""
