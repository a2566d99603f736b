"""Linked lists and bipartite matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain_ranks(nodes: DataFrame, firsts: DataFrame) -> DataFrame:
    """Ranks of linked lists: (start, id, ordinal), from each first id along next_id.

    Every round doubles the ranked part of all lists and the length of the jumps; a list that comes back to a
    node it has ends there. An id has one next_id.
    """
    ids = nodes.select(F.col("id").alias("to"))
    jumps = nodes.select("id", F.col("next_id").alias("to")).filter(F.col("to").isNotNull() & (F.col("to") != 0)).join(ids, "to", "left_semi").select("id", "to").distinct().checkpoint()
    out = firsts.select(F.col("id").alias("start"), F.col("id")).distinct().withColumn("ordinal", F.lit(1)).checkpoint()
    length, n = 1, out.count()
    while True:
        ahead = out.join(jumps, "id").select("start", F.col("to").alias("id"), (F.col("ordinal") + length).cast("int").alias("ordinal"))
        out = out.unionByName(ahead).groupBy("start", "id").agg(F.min("ordinal").alias("ordinal")).checkpoint()
        before, n = n, out.count()
        if n == before:
            return out
        jumps = jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")).checkpoint()
        length *= 2


def match_pairs(edges: DataFrame, group: str) -> DataFrame:
    """Largest one-to-one matching of left and right within each group, edges tried in the order of rank.

    edges: group, left_id, right_id, rank. Groups are bounded (places of one zone), so each is matched in one task.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        wanted = {a: list(g.sort_values(["rank", "right_id"])["right_id"]) for a, g in frame.groupby("left_id", sort=True)}
        taken: dict[int, int] = {}
        for root in wanted:
            parent, queue = {}, [root]  # breadth first to a free right node, then turn the path over
            while queue:
                left, end = queue.pop(0), None
                for right in wanted[left]:
                    if right in parent:
                        continue
                    parent[right] = left
                    if right not in taken:
                        end = right
                        break
                    queue.append(taken[right])
                if end is not None:
                    while end is not None:
                        left = parent[end]
                        before = next((r for r, own in taken.items() if own == left), None)
                        taken[end] = left
                        if before is not None and before != end:
                            del taken[before]
                        end = before if left != root else None
                    break
        pairs = sorted((left, right) for right, left in taken.items())
        return pd.DataFrame({group: [frame[group].iloc[0]] * len(pairs), "left_id": [p[0] for p in pairs], "right_id": [p[1] for p in pairs]})

    kind = edges.schema[group].dataType.simpleString()
    return edges.groupBy(group).applyInPandas(solve, f"`{group}` {kind}, left_id long, right_id long")
