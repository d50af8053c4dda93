"""Walks of parent-pointer trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(ArrayType(StringType()))
def _path(nodes: pd.Series, parents: pd.Series, leaves: pd.Series) -> pd.Series:
    def one(nodes, parents, leaf) -> list[str]:
        parent, out, seen = dict(zip(nodes, parents)), [], set()
        while leaf is not None and leaf in parent and leaf not in seen:
            seen.add(leaf)
            out.append(leaf)
            leaf = parent[leaf]
        return out

    return pd.Series([one(*x) for x in zip(nodes, parents, leaves)])


def walk(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv_id, depth, node_id from each conversation's leaf up to its root.

    A conversation's pointers are walked by lookups in one task, in time linear in the depth: one
    shuffle by conversation.  A missing parent or a cycle ends the walk."""
    all_ = nodes.groupBy("conv_id").agg(F.collect_list(F.struct("node_id", "parent_id")).alias("n"))
    pick = lambda name: F.transform("n", lambda x: x[name])
    path = _path(pick("node_id"), pick("parent_id"), F.col("node_id"))
    return all_.join(leaves, "conv_id").select("conv_id", F.posexplode(path).alias("depth", "node_id"))
