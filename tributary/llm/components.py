"""Connected components of an edge table by label propagation with pointer jumping; nothing is collected but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_dir, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long: root is the least node that links reach.

    Each round takes the least label among a node and its neighbours, then the label of that label. A round's labels are written to the
    shared folder, so a lost executor costs one round at most. Null ends and loops add nothing; an empty table gives an empty result.
    """
    folder = work_dir(edges.sparkSession)
    edges = edges.selectExpr("cast(a AS long) AS a", "cast(b AS long) AS b").where("a IS NOT NULL AND b IS NOT NULL")
    both = written(edges.unionByName(edges.selectExpr("b AS a", "a AS b")).where("a <> b").distinct(), "edges", folder)
    loops = written(edges.where("a = b").select(F.col("a").alias("node")).distinct(), "loops", folder)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels0", folder)
    for i in range(1, most_rounds + 1):
        near = both.join(labels.selectExpr("node AS b", "root AS r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "r").alias("next"))
        jump = lower.alias("l").join(labels.selectExpr("node AS n", "root AS r2"), F.col("l.next") == F.col("n"))
        new = written(jump.select("node", "root", F.least("next", "r2").alias("next")), f"labels{i}", folder)
        moved = new.where("next <> root").limit(1).count()
        labels = new.selectExpr("node", "next AS root")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels.unionByName(loops.join(labels, "node", "left_anti").selectExpr("node", "node AS root"))
