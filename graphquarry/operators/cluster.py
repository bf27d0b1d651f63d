"""Communities of a weighted directed graph by Leiden's three phases: local moves, refinement, aggregation.

In a round of moves, nodes whose turn it is (half of them, by a hash of node and round, so that neighbours seldom
swap places) go to the neighbouring community that gains most directed modularity, if that is more than
staying gives; ties go to the least name. Then every community is refined: its nodes begin alone again, and a node that is
well connected within the community joins a well connected part next to it that gains most, while it is still
alone. Parts are thus connected. They become the nodes of a smaller graph, on which moving goes on from the communities
found; when parts do not grow any more, communities do so whole. This is done without refinement too, and the better of both
is kept. Then single nodes move again from there, until modularity stays. At last each community is cut into its connected parts.

Weights are whole numbers, so that sums do not depend on an order. The same rounds exist twice: as joins, for graphs
of any size, and in numpy for one task. A graph of at most `SMALL` edges goes to one task whole; a larger one is moved, refined and
aggregated by joins until it is that small. Both give the same communities, whatever `SMALL` is, but for
the last moves of single nodes, which a large graph makes by joins too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.operators import traverse as V
from graphquarry.operators.components import connected_components, written
from graphquarry.shipping import ship

ROUNDS, LEVELS, PASSES, LEAST_SIZE, WEAK, SMALL = 20, 20, 3, 3, 0.3, 1 << 20


# --- one level in numpy: nodes are numbers in the order of their names ---------------------------------


def turns(names: list[str], round_: int) -> np.ndarray:
    return np.array([zlib.crc32(f"{round_ // 2}:{x}".encode()) % 2 == round_ % 2 for x in names], bool)


class Level:
    """A graph (u, v, w) of named nodes; `both` has each edge but loops in both directions."""

    def __init__(self, names: list[str], u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float):
        self.names, self.n, self.u, self.v, self.w, self.resolution = names, len(names), u, v, w, resolution
        self.out, self.into, self.m = np.bincount(u, w, self.n), np.bincount(v, w, self.n), float(w.sum())
        k = u != v
        self.x, self.y, self.bw = np.concatenate([u[k], v[k]]), np.concatenate([v[k], u[k]]), np.concatenate([w[k], w[k]])

    def quality(self, place: np.ndarray) -> float:
        inner = self.w[place[self.u] == place[self.v]].sum()
        return float(inner * self.m - self.resolution * (np.bincount(place, self.out, self.n) * np.bincount(place, self.into, self.n)).sum())

    def gathered(self, x: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = np.unique(x * self.n + c, return_inverse=True)
        return keys // self.n, keys % self.n, np.bincount(at, w, len(keys))

    def moved(self, place: np.ndarray) -> np.ndarray:
        still = 0
        for round_ in range(ROUNDS):
            turn = turns(self.names, round_)
            k, movers = turn[self.x], np.flatnonzero(turn)
            free = movers[np.bincount(place, minlength=self.n)[movers] == 0]  # they may be alone again
            x, c, w = self.gathered(np.concatenate([self.x[k], movers, free]), np.concatenate([place[self.y[k]], place[movers], free]), np.concatenate([self.bw[k], np.zeros(len(movers) + len(free))]))
            own = c == place[x]
            into = np.bincount(place, self.into, self.n)[c] - np.where(own, self.into[x], 0.0)
            out = np.bincount(place, self.out, self.n)[c] - np.where(own, self.out[x], 0.0)
            gain = w * self.m - self.resolution * (self.out[x] * into + self.into[x] * out)
            order = np.lexsort((c, ~own, -gain, x))
            order = order[np.unique(x[order], return_index=True)[1]]
            new = place.copy()
            new[x[order]] = c[order]
            still = 0 if (new != place).any() else still + 1
            place = new
            if round_ % 2 and still >= 2:  # every node had its turn
                break
        return place

    def refined(self, place: np.ndarray) -> np.ndarray:
        part, still = np.arange(self.n), 0
        k = place[self.x] == place[self.y]
        x, y, w = self.x[k], self.y[k], self.bw[k]
        out, into = np.bincount(place, self.out, self.n)[place], np.bincount(place, self.into, self.n)[place]  # of a node's community
        good = np.bincount(x, w, self.n) * self.m >= self.resolution * (self.out * (into - self.into) + self.into * (out - self.out))
        for round_ in range(ROUNDS):
            turn, alone = turns(self.names, round_), (np.bincount(part, minlength=self.n) == 1)[part]
            own_out, own_into = np.bincount(part, self.out, self.n), np.bincount(part, self.into, self.n)
            cut = np.bincount(part[x], np.where(part[x] != part[y], w, 0), self.n)
            fit = cut * self.m >= self.resolution * (own_out * (into - own_into) + own_into * (out - own_out))  # right for names of parts
            goes = alone & good & turn
            k = goes[x] & fit[part[y]] & ~(alone[part[y]] & turn[part[y]])
            a, t, s = self.gathered(x[k], part[y[k]], w[k])
            gain = s * self.m - self.resolution * (self.out[a] * own_into[t] + self.into[a] * own_out[t])
            a, t, gain = a[gain > 0], t[gain > 0], gain[gain > 0]
            order = np.lexsort((t, -gain, a))
            order = order[np.unique(a[order], return_index=True)[1]]
            still = 0 if len(order) else still + 1
            part = part.copy()
            part[a[order]] = t[order]
            if round_ % 2 and still >= 2:
                break
        return part

    def aggregated(self, part: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
        """The level of parts, each node's place in it, and the names of its nodes here."""
        kept, at = np.unique(part, return_inverse=True)
        u, v, w = Level.gathered(self, at[self.u], at[self.v], self.w)
        return Level([self.names[i] for i in kept], u, v, w.astype(np.int64), self.resolution), at, kept


def least_of(place: np.ndarray) -> np.ndarray:
    """The same communities, each named by its least node."""
    _, first, at = np.unique(place, return_index=True, return_inverse=True)
    return first[at]


def settled(level: Level, place: np.ndarray, refine: bool = True) -> np.ndarray:
    """Communities of a level's nodes from `place` on, by its own moves and those of all smaller graphs. Without `refine` communities are the nodes of these."""
    home, at, whole = place, np.arange(level.n), level
    for _ in range(LEVELS):
        new = whole.moved(place)
        place = new if whole.quality(new) > whole.quality(place) else place
        home = place[at]
        small, up, kept = whole.aggregated(whole.refined(place) if refine else least_of(place))
        if refine and small.n == whole.n:  # parts are as large as they get: communities move whole
            small, up, kept = whole.aggregated(least_of(place))
        if small.n == whole.n:
            break
        whole, at, place = small, up[at], least_of(place[kept])
    return least_of(home)


def parts_of(level: Level, place: np.ndarray) -> np.ndarray:
    """Communities cut into their connected parts, each named by its least node."""
    k = place[level.x] == place[level.y]
    x, y, part = level.x[k], level.y[k], np.arange(level.n)
    while True:
        new = part.copy()
        np.minimum.at(new, x, part[y])
        new = new[new]
        if (new == part).all():
            return part
        part = new


def leiden(level: Level) -> np.ndarray:
    place = max((settled(level, np.arange(level.n), refine) for refine in (True, False)), key=level.quality)
    for _ in range(PASSES - 1):
        again = settled(level, place)
        if level.quality(again) <= level.quality(place):
            break
        place = again
    return parts_of(level, place)


# --- the same as joins ---------------------------------------------------------------------------------


class Joined:
    """A graph of any size: edges (u, v, w), each pair once."""

    def __init__(self, edges: DataFrame, resolution: float):
        self.edges, self.resolution = written(edges), resolution
        none = F.lit(0).cast("long")
        ends = self.edges.select("u", F.col("w").alias("o"), none.alias("i")).unionByName(self.edges.select(F.col("v").alias("u"), none.alias("o"), F.col("w").alias("i")))
        self.nodes = written(ends.groupBy("u").agg(F.sum("o").cast("double").alias("out"), F.sum("i").cast("double").alias("into")))
        self.m = float(self.edges.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
        one = self.edges.where("u <> v")
        self.both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))

    def alone(self) -> DataFrame:
        return self.nodes.select("u", F.col("u").alias("c"))

    def sums(self, place: DataFrame, of: str, out: str, into: str) -> DataFrame:
        return place.join(self.nodes, "u").groupBy(F.col(of).alias("c")).agg(F.sum("out").alias(out), F.sum("into").alias(into))

    def quality(self, place: DataFrame) -> float:
        a, b = place.withColumnRenamed("c", "cu"), place.select(F.col("u").alias("v"), F.col("c").alias("cv"))
        inner = self.edges.join(a, "u").join(b, "v").where("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        rest = self.sums(place, "c", "o", "i").agg(F.coalesce(F.sum(F.col("o") * F.col("i")), F.lit(0.0))).first()[0]
        return float(inner * self.m - self.resolution * rest)

    @staticmethod
    def turn(name: str, round_: int):
        return F.crc32(F.concat(F.lit(f"{round_ // 2}:"), F.col(name))) % 2 == round_ % 2

    def moved(self, place: DataFrame) -> DataFrame:
        still = 0
        for round_ in range(ROUNDS):
            movers = place.where(self.turn("u", round_)).select("u", F.col("c").alias("own"))
            near = self.both.where(self.turn("u", round_)).join(place.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "w")
            offers = near.unionByName(movers.select("u", F.col("own").alias("c"), F.lit(0).cast("long").alias("w"))).groupBy("u", "c").agg(F.sum("w").cast("double").alias("w"))
            free = movers.join(place.select(F.col("c").alias("u")).distinct(), "u", "left_anti")  # they may be alone again
            offers = offers.unionByName(free.select("u", F.col("u").alias("c"), F.lit(0.0).alias("w")))
            rows = offers.join(movers, "u").join(self.nodes, "u").join(self.sums(place, "c", "co", "ci"), "c", "left")
            stays = F.col("c") == F.col("own")
            into, out = (F.coalesce(c, F.lit(0.0)) - F.when(stays, F.col(own)).otherwise(0.0) for c, own in (("ci", "into"), ("co", "out")))
            gain = F.col("w") * self.m - self.resolution * (F.col("out") * into + F.col("into") * out)
            best = rows.groupBy("u").agg(F.min(F.struct((-gain).alias("g"), (~stays).alias("s"), "c")).alias("b")).select("u", F.col("b.c").alias("new"))
            after = written(place.join(best, "u", "left").select("u", F.coalesce("new", "c").alias("c"), (F.coalesce("new", "c") != F.col("c")).alias("moves")))
            still = still + 1 if after.where("moves").isEmpty() else 0
            place = after.select("u", "c")
            if round_ % 2 and still >= 2:
                break
        return place

    def refined(self, place: DataFrame) -> DataFrame:
        """(u, c, t): nodes with their community and their part of it."""
        home = place.join(self.sums(place, "c", "co", "ci"), "c").join(self.nodes, "u").select("u", "c", "co", "ci", "out", "into")
        inner = written(self.both.join(place, "u").join(place.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").where("c = cv").select("u", "v", "w"))
        ties = inner.groupBy("u").agg(F.sum("w").cast("double").alias("tie"))
        good = F.coalesce("tie", F.lit(0.0)) * self.m >= self.resolution * (F.col("out") * (F.col("ci") - F.col("into")) + F.col("into") * (F.col("co") - F.col("out")))
        home = written(home.join(ties, "u", "left").select("u", "c", "co", "ci", "out", "into", good.alias("good")))
        part, still = self.nodes.select("u", F.col("u").alias("t")), 0
        for round_ in range(ROUNDS):
            size = part.join(home, "u").groupBy("t").agg(F.count("*").alias("n"), F.sum("out").alias("po"), F.sum("into").alias("pi"), F.first("co").alias("co"), F.first("ci").alias("ci"))
            links = inner.join(part, "u").join(part.select(F.col("u").alias("v"), F.col("t").alias("s")), "v")
            cut = links.where("t <> s").groupBy("t").agg(F.sum("w").cast("double").alias("cut"))
            fit = F.coalesce("cut", F.lit(0.0)) * self.m >= self.resolution * (F.col("po") * (F.col("ci") - F.col("pi")) + F.col("pi") * (F.col("co") - F.col("po")))
            to = size.join(cut, "t", "left").where(fit & ~((F.col("n") == 1) & self.turn("t", round_))).select(F.col("t").alias("s"), "po", "pi")
            goes = part.join(size.where("n = 1").select("t"), "t", "left_semi").join(home.where(F.col("good") & self.turn("u", round_)).select("u", "out", "into"), "u").select("u", "out", "into")
            offers = links.groupBy("u", "s").agg(F.sum("w").cast("double").alias("w")).join(goes, "u").join(to, "s")
            gain = F.col("w") * self.m - self.resolution * (F.col("out") * F.col("pi") + F.col("into") * F.col("po"))
            best = offers.where(gain > 0).groupBy("u").agg(F.min(F.struct((-gain).alias("g"), "s")).alias("b")).select("u", F.col("b.s").alias("new"))
            after = written(part.join(best, "u", "left").select("u", F.coalesce("new", "t").alias("t"), F.col("new").isNotNull().alias("moves")))
            still = still + 1 if after.where("moves").isEmpty() else 0
            part = after.select("u", "t")
            if round_ % 2 and still >= 2:
                break
        return part.join(place, "u")

    def aggregated(self, part: DataFrame) -> Joined:
        a, b = part.select("u", F.col("t").alias("a")), part.select(F.col("u").alias("v"), F.col("t").alias("b"))
        return Joined(self.edges.join(a, "u").join(b, "v").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), self.resolution)


def in_one_task(edges: DataFrame, place: DataFrame, resolution: float, whole: bool, refine: bool = True) -> DataFrame:
    """(u, c) by the numpy form, of a graph that has been counted. whole: all passes from single nodes, cut into connected parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["u"], *rows["v"].dropna()})
        at = {x: i for i, x in enumerate(names)}
        links, homes = rows[rows["w"].notna()], rows[rows["w"].isna()]
        level = Level(names, links["u"].map(at).to_numpy(np.int64), links["v"].map(at).to_numpy(np.int64), links["w"].to_numpy(np.int64), resolution)
        if whole:
            found = leiden(level)
        else:
            start = np.arange(level.n)
            start[homes["u"].map(at).to_numpy(np.int64)] = homes["v"].map(at).to_numpy(np.int64)
            found = settled(level, start, refine)
        return pd.DataFrame({"u": names, "c": [names[i] for i in found]})

    rows = edges.select("u", "v", "w") if whole else edges.select("u", "v", "w").unionByName(place.select("u", F.col("c").alias("v"), F.lit(None).cast("long").alias("w")))
    return ship(rows).groupBy(F.lit(0).alias("all")).applyInPandas(run, "u string, c string")


def settled_by_joins(graph: Joined, place: DataFrame, small: int, refine: bool = True) -> DataFrame:
    """`settled` for a graph of any size; what has become small enough goes to one task."""
    home, whole = place.select("u", F.col("u").alias("at"), "c"), graph
    for _ in range(LEVELS):
        if whole.edges.limit(small + 1).count() <= small:
            place = written(in_one_task(whole.edges, place, whole.resolution, False, refine))
            return home.select("u", "at").join(place.select(F.col("u").alias("at"), "c"), "at").select("u", "c")
        new = whole.moved(place)
        place = new if whole.quality(new) > whole.quality(place) else place
        home = written(home.select("u", "at").join(place.select(F.col("u").alias("at"), "c"), "at").select("u", "at", "c"))
        whole_communities, n = place.join(place.groupBy("c").agg(F.min("u").alias("t")), "c").select("u", "c", "t"), whole.nodes.count()
        part = written(whole.refined(place) if refine else whole_communities)
        less = whole.aggregated(part)
        if refine and less.nodes.count() == n:
            part = written(whole_communities)
            less = whole.aggregated(part)
        if less.nodes.count() == n:
            break
        home = written(home.select("u", "at", "c").join(part.select(F.col("u").alias("at"), "t"), "at").select("u", F.col("t").alias("at"), "c"))
        first = part.groupBy("c").agg(F.min("t").alias("first"))
        whole, place = less, written(part.join(first, "c").select(F.col("t").alias("u"), F.col("first").alias("c")).distinct())
    return home.select("u", "c")


def communities(graph: DataFrame, resolution: float = 1.0, small: int = SMALL) -> DataFrame:
    """(id, community) of the nodes of edges (from_id, to_id, reference_count); a community is named by its least node. Nodes without weight stay alone."""
    w = V.weight(F.col("reference_count")).cast("long")
    edges = graph.where("from_id is not null and to_id is not null").groupBy(F.col("from_id").alias("u"), F.col("to_id").alias("v")).agg(F.sum(w).alias("w"))
    edges = written(edges.where("w > 0 or u is not null"))
    if edges.limit(small + 1).count() <= small:
        return in_one_task(edges, edges, resolution, True).select(F.col("u").alias("id"), F.col("c").alias("community"))
    whole = Joined(edges, resolution)
    place = max((written(settled_by_joins(whole, whole.alone(), small, refine)) for refine in (True, False)), key=whole.quality)
    for _ in range(PASSES - 1):
        again = written(settled_by_joins(whole, place, small))
        if whole.quality(again) <= whole.quality(place):
            break
        place = again
    a, b = place.withColumnRenamed("c", "cu"), place.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    inner = edges.where("u <> v").join(a, "u").join(b, "v").where("cu = cv").select("u", "v")
    parts = connected_components(inner, "u", "v").select(F.col("node").alias("u"), "component")
    return place.select("u").join(parts, "u", "left").select(F.col("u").alias("id"), F.coalesce("component", "u").alias("community"))


def materialised(graph: DataFrame, least_size: int = LEAST_SIZE, resolution: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(id, name, members) of subsystems of at least so many members, and (id, name) of a finding if their modularity is weak.

    Where no more than one community is that large, the components of heavier edges stand for them, if these are more.
    """
    of = lambda rows: rows.select(F.explode("members").alias("id"), F.col("community").alias("group"))
    found = communities(graph, resolution).groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members"))
    groups = written(found.where(F.size("members") >= least_size))
    many = groups.limit(2).count()
    if many <= 1:
        other = written(V.weighted_components(graph, least_size).select(F.col("component").alias("community"), "members"))
        groups = other if other.limit(many + 1).count() > many else groups
    weak = V.modularity(graph, of(groups)).where(F.col("modularity") < WEAK)
    return V.subsystems(groups), weak.select(F.lit("core:finding:weak-modularity").alias("id"), F.format_string("%.6f", "modularity").alias("name"))
