"""Connected components of a link table by alternating large and small stars, and links of nodes that share keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cut, with_line_of


def _mark(links: DataFrame) -> tuple:
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Neighbour minima are pre-aggregated and joined back, so a node with very many links is
    never gathered into one group. Each round is checkpointed in the shared folder. Minima
    are merged and never broadcast, so no round's table goes through the driver.
    Loops, repeated and reversed links and nulls (dropped) are allowed.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
        before, mark = mark, _mark(links)
        if mark == before:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Nodes under a key that are paired outright; more go by components first.
CROWDED = 512
#: Nodes in a list that is paired with a list of another component.
LISTED = 1024


def connected(
    entries: DataFrame, verify: Callable[[DataFrame], DataFrame], shared: int = 1, crowded: int = CROWDED, near: Callable[[str, str], Column] | None = None
) -> DataFrame:
    """Links (a, b) with the same connected components as all candidates that pass ``verify``.

    ``entries`` (key, node, and what ``near`` looks at) must be cut or stored. Candidates are
    pairs of nodes with ``shared`` pairs of entries of one key or more, counting those for
    which ``near(x, y)`` holds (of columns with the prefixes x and y); ``verify`` gives those
    of its pairs (a, b) that are linked. Entries of a key that few share are paired
    outright. Under a crowded key all nodes are first paired with its smallest; after the
    links so found have made components, entries of different components are paired too,
    and one near pair makes a candidate. So a pair is left out only where its nodes are
    connected already, and a large group of copies costs a pair for each member, not for
    each two.
    """
    near = near or (lambda x, y: F.lit(True))
    what = [c for c in entries.columns if c not in ("key", "node")]
    load = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where(F.col("n") > crowded)
    full = cut(load.select(F.col("key").alias("f_key"), "least"))
    none = full.isEmpty()
    light = entries if none else with_line_of(entries, full, [("key", "f_key")]).where("least is null").drop("f_key", "least")
    side = lambda x: light.select(*[F.col(c).alias(f"{x}{c}") for c in ("key", "node", *what)])
    pairs = side("x_").join(side("y_"), (F.col("x_key") == F.col("y_key")) & (F.col("x_node") < F.col("y_node")) & near("x_", "y_"))
    pairs = pairs.groupBy(F.col("x_node").alias("a"), F.col("y_node").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).select("a", "b")
    if none:
        return cut(verify(cut(pairs)))
    dense = cut(with_line_of(entries, full, [("key", "f_key")]).where("least is not null").drop("f_key"))
    stars = dense.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = cut(verify(cut(pairs.union(stars).distinct())))
    roots = components(links).withColumnsRenamed({"node": "r_node"})
    placed = dense.join(roots, F.col("node") == F.col("r_node"), "left").select("key", "node", *what, F.coalesce("root", "node").alias("root"))
    placed = cut(placed)
    size = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = size.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key")
    size = size.join(several, "key", "left_semi")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LISTED))
    lists = placed.join(size, ["key", "root"]).groupBy("key", "root", part.alias("part")).agg(F.collect_list(F.struct("node", *what)).alias("held"))
    lists = cut(lists)
    more = lists.select(F.col("key").alias("m_key"), F.col("root").alias("m_root"), F.col("held").alias("m_held"))
    cross = lists.join(more, (F.col("key") == F.col("m_key")) & (F.col("root") < F.col("m_root")))
    cross = cross.select(F.explode("held").alias("x"), "m_held").select("x", F.explode("m_held").alias("y"))
    cross = cross.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("node", *what)]).where(near("x_", "y_"))
    cross = cut(cross.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    return links if cross.isEmpty() else links.union(cut(verify(cross)))
