"""Connected components of links by alternating large and small stars; links stay distributed throughout.

Defined cases: links of a node to itself count for nothing, repeated links count once, an empty table has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) -> (node, root): root is the least node that is reachable. Only nodes below it are listed."""
    return graph.components(edges).where("node <> root")
