"""Greedy clustering in order of rank, in parallel rounds of joins.

The sequential rule: go through the nodes by rank; a node that is not taken yet becomes a centre and takes every
neighbour not taken yet. Its result depends on the order alone, so it can be found in rounds: an undecided node without a
smaller undecided neighbour is a centre, whatever else happens; a neighbour of a centre will be taken and blocks nobody any
more. When all are decided, a taken node belongs to its smallest neighbouring centre. The number of rounds is the longest
chain in which each node decides the next, a handful in practice; each is a few equi-joins on what is still undecided.

Neighbours are given by edges, and by groups: all nodes of a group are neighbours, and so are all nodes of linked groups.
Groups are met through the least rank in each, so a group of any size costs one row a node and never its pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from scour.session import copied, cut_lineage, discard


def _least_neighbour(nodes: DataFrame, marked: DataFrame, edges: DataFrame, links: DataFrame | None) -> DataFrame:
    """(id, least): for each of ``nodes`` the smallest id among ``marked`` that is a neighbour; itself too, inside a group."""
    direct = edges.join(marked.select(F.col("id").alias("b")), "b").groupBy("a").agg(F.min("b").alias("least"))
    found = direct.select(F.col("a").alias("id"), "least").join(nodes.select("id"), "id")
    if links is not None:
        first = marked.where("form IS NOT NULL").groupBy("form").agg(F.min("id").alias("first"))
        reached = links.join(first, links["g"] == first["form"]).groupBy("f").agg(F.min("first").alias("least"))
        own = nodes.join(reached, nodes["form"] == reached["f"]).select("id", "least")
        found = found.unionByName(own).groupBy("id").agg(F.min("least").alias("least"))
    return found


def greedy_clusters(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(id, centre) of every node that another one takes.

    ``nodes``: id (the rank, unique) and form (its group, or null). ``edges``: a, b, in either direction. ``links``: pairs of linked
    groups f, g; groups are linked with themselves.
    """
    spark = nodes.sparkSession
    nodes = nodes.select("id", "form")
    edges = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    if links is not None:
        own = nodes.where("form IS NOT NULL").select(F.col("form").alias("f"), F.col("form").alias("g"))
        links = cut_lineage(links.select("f", "g").union(links.select("g", "f")).union(own).distinct())
    left, path = copied(nodes)
    paths, centres = [path], []
    while left.limit(1).count():
        least = _least_neighbour(left, left, edges, links)
        free = left.join(least, "id", "left").where("least IS NULL OR least >= id").select("id", "form")
        free = cut_lineage(free)
        centres.append(free)
        near = _least_neighbour(left, free, edges, links).select("id")
        left, path = copied(left.join(near.union(free.select("id")), "id", "left_anti"))
        paths.append(path)
    for path in paths[:-1]:
        discard(spark, path)
    if not centres:
        return nodes.select("id", F.col("id").alias("centre")).where("false")
    every = reduce(DataFrame.unionByName, centres)
    taken = nodes.join(every.select("id"), "id", "left_anti")
    return _least_neighbour(taken, every, edges, links).select("id", F.col("least").alias("centre"))
