"""Lines as rows: positions and excerpts against plain Python, and what the plans carry."""

import random

from pyspark.sql import functions as F

from graphquarry.operators import graph, lines, lookup

TEXTS = {"a": "x = 1\r\n\ny = 'ü'\n", "b": "", "c": "one line", "d": "\n\n\n", "e": "日本語\n" * 3000 + "end", "f": "w" * 20_000 + "\n" + "v" * 9000}


def files(spark):
    return spark.createDataFrame([*TEXTS.items(), ("none", None)], "path string, content string")


def test_lines(spark):
    got = {}
    for r in lines.lines_of(files(spark)).collect():
        got.setdefault(r.path, []).append(r)
    for path, text in TEXTS.items():
        rows, raw = sorted(got[path], key=lambda r: r.line), text.encode()
        assert [r.text for r in rows] == text.split("\n") and [r.line for r in rows] == list(range(1, len(rows) + 1))
        assert all(raw[r.start : r.start + r.size].decode() == r.text for r in rows)
    assert "none" not in got


def test_positions(spark, tmp_path):
    rng, sites = random.Random(8), []
    for path, text in TEXTS.items():
        n = len(text.encode())
        sites += [(path, at) for at in {*range(-1, 8), *(rng.randint(0, n + 2) for _ in range(40)), n, n + 1, 4095, 4096, 8192, None}]
    sites += [("missing", 1), ("none", 0), ("a", 3), ("a", 3)]
    frame = spark.createDataFrame([(k, *s) for k, s in enumerate(sites)], "site long, path string, source_byte_start long")
    want = {}
    for k, (path, at) in enumerate(sites):
        if path in TEXTS:
            raw = TEXTS[path].encode()
            ok = at is not None and 0 <= at <= len(raw)
            want[k] = (raw[:at].count(b"\n") + 1, at - (raw.rfind(b"\n", 0, at) + 1)) if ok else (None, None)
    table = lines.stored(lines.lines_of(files(spark)), f"{tmp_path}/lines", 4)
    for source in (files(spark), table):
        got = graph.byte_positions(frame, source).collect()
        assert len(got) == len(want) and {r.site: (r.line, r.column) for r in got} == want
    plan = graph.byte_positions(frame, table)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan  # positions read no text


def test_excerpts(spark):
    rng, rows = random.Random(9), []
    for k in range(300):
        path = rng.choice([*TEXTS, "missing", "none"])
        a = rng.choice([-3, 0, 1, 2, 3, 60, 64, 65, 2990, 3001, 3002])
        rows.append((f"e{k}", path, a, a + rng.choice([-5, 0, 0, 1, 70, 200]), "{}" if k % 9 else '{"briefing_blocked":"x"}'))
    entities = spark.createDataFrame(rows, "id string, source_file_path string, source_line_start long, source_line_end long, properties string")
    for before, after in ((0, 0), (2, 3)):
        want = {}
        for i, path, a, z, p in rows:
            if path in TEXTS and p == "{}":
                own, first = TEXTS[path].split("\n"), max(1, a - before)
                if first <= len(own):
                    want[i] = (first, "\n".join(own[first - 1 : max(first - 1, z + after)]))
        got = lookup.source_lines(files(spark).withColumnRenamed("path", "source_file_path"), entities, before, after).collect()
        assert {r.id: (r.first_line, r.text) for r in got} == want and len(got) == len(want)


def test_long_file(spark, tmp_path):
    """Many lines of one file: work follows what is asked for."""
    n = 400_000
    text = spark.range(1).select(F.lit("big").alias("path"), F.repeat(F.lit("0123456\n"), n).alias("content"))
    table = lines.stored(lines.lines_of(text), f"{tmp_path}/lines", 4)
    assert table.count() == n + 1
    spots = spark.range(0, 8 * n, 80_008).select(F.lit("big").alias("path"), F.col("id").alias("source_byte_start"))
    got = graph.byte_positions(spots, table).collect()
    assert all((r.line, r.column) == (r.source_byte_start // 8 + 1, r.source_byte_start % 8) for r in got) and len(got) == spots.count()
    wanted = spark.createDataFrame([("x", "big", n - 1, n + 5), ("y", "big", 7, 8)], "id string, path string, first long, last long")
    assert {r.id: r.text for r in lines.excerpts(wanted, table).collect()} == {"x": "0123456\n0123456\n", "y": "0123456\n0123456"}
