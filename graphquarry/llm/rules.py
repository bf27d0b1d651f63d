"""Quality rules: a threshold table compiled into one Spark projection.

Every rule compares a numerator with a share of a denominator in whole numbers:
`100 * numerator > percent * denominator` fails it. The statistics and the rules are built-in
expressions, so Catalyst evaluates a document in one pass and no row leaves the JVM or its partition.

Words are runs of characters other than space and U+0009 to U+000D. Null texts have no words, fail
the base rules and are not kept; so do empty ones. Long texts are taken whole. Repeated rows are judged
each for itself; an empty table gives no rows. Other columns are passed on unchanged, whatever their
names, except those named like a statistic or a verdict, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm import batches as B

SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: A choice of ours: frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the", "and", "of", "to", "in", "that", "is", "was", "der", "die", "und", "den", "das", "le", "la", "les", "et", "des", "el", "los", "que", "en", "de", "una")


@dataclass(frozen=True)
class Rule:
    """Fails a document if 100 * numerator > percent * denominator (above), or if it is less (below)."""

    name: str
    numerator: str
    denominator: str
    percent: int
    above: bool = True

    def column(self) -> Column:
        left, right = 100 * F.col(self.numerator), self.percent * F.col(self.denominator)
        return left > right if self.above else left < right

    def sql(self) -> str:
        return f"100 * {self.numerator} {'>' if self.above else '<'} {self.percent} * {self.denominator}"


#: The table: word length 2 to 15 on average, symbols, repeated lines, stop words, words with a letter.
RULES = (
    Rule("short_words", "word_chars", "n_words", 200, above=False),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 30),
    Rule("few_stop_words", "n_stop_words", "n_words", 2, above=False),
    Rule("no_letters", "n_letter_words", "n_words", 70, above=False),
)
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that are in the text twice or more, the first one included.

    Window hashes are looked at first; texts without equal ones, nearly all, are done then. Else the
    windows are sorted by hash and those next to each other compared word by word.
    """

    def counted(w: Column, hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, width) == F.slice(w, b["i"] + 1, width))

            near = F.transform(s, lambda x, k: F.when(((k > 0) & same(x, F.get(s, k - 1))) | ((k + 1 < F.size(s)) & same(x, F.get(s, k + 1))), x["i"]))
            return F.sort_array(F.filter(near, lambda x: x.isNotNull()))

        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")), lambda a, x: F.struct((a["n"] + x + width - F.greatest(x, a["to"])).cast("int").alias("n"), (x + width).cast("int").alias("to")), lambda a: a["n"])

        return let(let(ordered, starts), covered)

    def of_words(w: Column) -> Column:
        keys = F.transform(w, lambda x: F.xxhash64(x))

        def of_keys(k: Column) -> Column:
            hashes = F.transform(F.sequence(F.lit(0), F.size(k) - width), lambda i: F.xxhash64(*(F.get(k, i + j) for j in range(width))))
            return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(w, h)))

        return F.when(F.size(w) <= width, F.lit(0)).otherwise(let(keys, of_keys))

    return of_words(words)


def with_statistics(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    t = B.text_or_empty(text)
    words = F.array_remove(F.split(t, f"[{SPACE}]+"), "")
    bare = F.col("t")
    for space in SPACE:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    longest = max(map(len, stop_words), default=0)  # lower case is never shorter
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    stop = F.array(*(F.lit(x) for x in stop_words))
    out = docs.select(B.packed(docs), t.alias("t"), words.alias("words"), lines.alias("lines"))
    made = {
        "n_words": F.size("words"),
        "word_chars": F.length(bare),
        "n_symbols": F.regexp_count("t", F.lit("[" + SYMBOLS.replace("&", "\\&") + "]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_stop_words": F.size(F.filter("words", lambda w: (F.length(w) <= longest) & F.array_contains(stop, F.lower(w)))),
        "n_letter_words": F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))),
    }
    out = out.select(B.ROW, *(c.cast("long").alias(n) for n, c in made.items()))
    return B.unpacked(out, [*(c for c in docs.columns if c not in made), *made], dict(zip(made, made, strict=True)))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with their statistics, base_failed, failed_rules (array of names) and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(r.column(), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    return with_statistics(docs, text).withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \\t-\\r]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d),
h AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \\t-\\r]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(r.sql() for r in rules)}) AS kept FROM b"""
