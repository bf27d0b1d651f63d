"""Patterns as a trie of segments, against one regular expression for each."""

import random
import re

from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators import guidance

SEGMENTS = ["src", "lib", "a.b", "x+y", "test_a.py", "m.py", "**", "*", "*.py", "te?t*", "?", "[q]", "a**b", "", "($)"]
NAMES = ["src", "lib", "a.b", "aXb", "x+y", "test_a.py", "m.py", "q", "[q]", "axxb", "", "($)", "text"]


def test_globs_against_regular_expressions(spark):
    rng = random.Random(7)
    globs = sorted({"/".join(rng.choices(SEGMENTS, k=rng.randint(1, 4))) for _ in range(250)} | {"**", "**/**/m.py", "src/**", ""})
    paths = sorted({"/".join(rng.choices(NAMES, k=rng.randint(1, 5))) for _ in range(150)} | {"src", "m.py", ""})
    want = {(p, g) for g in globs for p in paths if re.search(X.glob_regex(g), "/" + p)}
    frames = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g, g) for g in globs], "sheet string, pattern string")
    assert {tuple(r) for r in guidance.glob_hits(*frames).collect()} == want and len(want) > 300


def test_many_patterns_of_a_shape(spark):
    """Thousands of patterns and paths: no nested loop, and hits alone are made."""
    globs = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("sheet"), F.format_string("**/name%d.py", "id").alias("pattern"))
    paths = spark.range(20_000).select(F.format_string("pkg%d/sub/name%d.py", F.col("id") % 50, "id").alias("path"))
    hits = guidance.glob_hits(paths, globs)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert hits.count() == 5000
