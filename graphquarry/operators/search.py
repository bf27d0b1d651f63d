"""Finding entities by text, by ranked terms, and by vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.shipping import ship

MOST_OFFSET = 100_000


def containing(entities: DataFrame, text: str) -> DataFrame:
    """(id): the text is part of the id, a name, the summary, or the docstring of an open entity. No character is a wildcard."""
    part = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    has = lambda c: F.coalesce(F.contains(X.folded(c), F.lit(part)), F.lit(False))
    p = F.col("properties")
    doc = X.block_reason(p).isNull() & has(F.when(X.is_json(p), F.get_json_object(p, "$.docstring")))
    return entities.where(has(F.col("id")) | has(F.col("name")) | has(F.col("short_name")) | has(F.col("summary")) | doc).select("id")


def stem(word: str) -> str:
    """Porter's stem of a lower-case word (M. F. Porter, An algorithm for suffix stripping, 1980)."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word

    def kinds(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    def measure(s: str) -> int:
        k = kinds(s)
        return sum(a == "v" and b == "c" for a, b in zip(k, k[1:], strict=False))

    def swap(w: str, table: tuple[tuple[str, str], ...], least: int) -> str:
        for old, new in table:
            if w.endswith(old):
                return w[: -len(old)] + new if measure(w[: -len(old)]) > least else w
        return w

    def short(s: str) -> bool:
        return len(s) >= 3 and kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    # The suffix tables of the algorithm.
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            head = w[: -len(end)]
            if measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def stemmed(words: DataFrame) -> DataFrame:
    """(word, term) of distinct words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"word": part["word"], "term": [stem(w) for w in part["word"]]})

    return ship(words.select("word").distinct()).mapInPandas(run, "word string, term string")


def words_of() -> Column:
    """The words of an entity's name, short name and summary, in lower case."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "short_name", "summary")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inverted_index(entities: DataFrame) -> DataFrame:
    """(term, id, tf, length): stems of name, short name and summary. Distinct words are stemmed once each."""
    words = entities.select("id", F.explode(words_of()).alias("word"))
    counts = words.groupBy("id", "word").agg(F.count("*").alias("n"))
    terms = stemmed(counts)
    rows = counts.join(terms, "word").groupBy("id", "term").agg(F.sum("n").alias("tf"))
    length = counts.groupBy("id").agg(F.sum("n").alias("length"))
    return rows.join(length, "id").select("term", "id", "tf", "length")


#: Constants of BM25.
K1, B = 1.2, 0.75


def query_terms(text: str) -> list[str]:
    """The different stems of a text, in order."""
    return sorted({stem(w) for w in re.findall(r"[^\W_]+", text.lower())})


def bm25(index: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of entities that have every term of the query, better ones higher."""
    terms = query_terms(query)
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    docs = index.groupBy("id").agg(F.max("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = index.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(docs))  # a row for each query term, and one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(terms)).select("id", "score")


def is_ranked_text(text: str) -> bool:
    """Whether a text is words alone, so that the ranked index can take it: letters, digits, underscores and white space."""
    return all(c.isalnum() or c == "_" or c.isspace() for c in text)


def ranked_text(text: Column) -> Column:
    """The same of a column."""
    return text.rlike(r"^[\p{L}\p{N}_\s]*$")


def merged(entities: DataFrame, index, text: str) -> DataFrame:
    """(id, src, score): ranked hits (src 0), and those that only contain the text (src 1); each id once.

    index: rows of `inverted_index`, a stored `ranked.Index`, or None for no ranked hits.
    """
    hits = containing(entities, text).select("id", F.lit(1).alias("src"), F.lit(0.0).alias("score"))
    if index is not None and is_ranked_text(text):
        ranked = bm25(index, text) if isinstance(index, DataFrame) else index.ranked(text)
        hits = ranked.select("id", F.lit(0).alias("src"), "score").unionByName(hits)
    best = hits.groupBy("id").agg(F.min(F.struct("src", (-F.col("score")).alias("s"))).alias("b"))
    return best.select("id", "b.src", (-F.col("b.s")).alias("score"))


def checked_page(text: str, offset: int) -> None:
    if not text.strip():
        raise ValueError("an empty pattern")
    if offset > MOST_OFFSET:
        raise ValueError("the offset is too large")


def find(entities: DataFrame, index: DataFrame | None, text: str, kind: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Ranked hits first, then those that only contain the text; each once, in pages. Offsets over MOST_OFFSET are refused; `merged` has all hits."""
    checked_page(text, offset)
    rows = merged(entities, index, text).join(entities.select("id", "kind", "name"), "id")
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    return rows.orderBy("src", F.col("score").desc(), "id").offset(offset).limit(limit).select("id", "kind", "name")


def semantic(vectors: DataFrame, query: DataFrame, model: str | None = None, entities: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(id, score): nearest by cosine among vectors (entity_id, content_hash, model_id, vec) that are up to date.

    query: one row (vec). Exact; the best are kept on the executors before they are merged.
    """
    rows = vectors if model is None else vectors.where(F.col("model_id") == model)
    if entities is not None:
        rows = rows.join(entities.select(F.col("id").alias("entity_id"), "content_hash"), ["entity_id", "content_hash"], "left_semi")
    one = F.broadcast(query.select(F.col("vec").alias("__q")).limit(1))  # one row
    scored = rows.crossJoin(one).select(F.col("entity_id").alias("id"), X.cosine(F.col("vec"), F.col("__q")).alias("score"))
    return scored.where("score is not null").orderBy(F.col("score").desc(), "id").limit(limit)


def embedding_candidates(entities: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(id, content_hash, text): open entities with a hash and no vector of it yet."""
    p = F.col("properties")
    doc = F.when(X.is_json(p), F.get_json_object(p, "$.docstring"))
    text = F.concat_ws("\n", "short_name", F.coalesce(doc, F.col("name")))
    have = vectors.where(F.col("model_id") == model).select(F.col("entity_id").alias("id"), "content_hash")
    return entities.where(X.block_reason(p).isNull() & F.col("content_hash").isNotNull()).join(have, ["id", "content_hash"], "left_anti").select("id", "content_hash", text.alias("text"))


def embed(candidates: DataFrame, provider, model: str) -> DataFrame:
    """Vectors made by `provider(list of texts) -> list of vectors`, 64 texts at a time, on the executors."""

    def run(parts):
        for part in parts:
            for at in range(0, len(part), 64):
                rows = part.iloc[at : at + 64]
                yield pd.DataFrame({"entity_id": rows["id"], "content_hash": rows["content_hash"], "model_id": model, "vec": list(provider(list(rows["text"])))})

    return candidates.mapInPandas(run, "entity_id string, content_hash string, model_id string, vec array<float>")


def summary_state(cache: DataFrame, today: str, max_days: int, callers: DataFrame) -> DataFrame:
    """(entity_id, state) of cached summaries (entity_id, created_at, caller_count): expired, stale (callers changed by over half) or fresh."""
    age = F.datediff(F.lit(today).cast("date"), F.to_date("created_at"))
    rows = cache.join(callers, "entity_id", "left")
    now = F.coalesce("callers", F.lit(0))
    state = F.when(age > max_days, "expired").when(X.drifted(now, F.col("caller_count")), "stale").otherwise("fresh")
    return rows.select("entity_id", state.alias("state"))
