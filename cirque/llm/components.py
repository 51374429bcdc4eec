"""Connected components by least label, with hooking of labels and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, steps: C.Steps | None = None, name: str = "components") -> DataFrame:
    """(node, component) for every end of ``links`` (columns x and y, any ordered type); component is the least node.

    In a round a node takes the least label of its label and of its neighbours' labels, and hands what it takes on to the
    node that its label names, so that whole trees join at once and long chains take few rounds. Labels only fall, and
    rounds go on until none does; then every link has one label at both ends. Each round is written and the one before
    deleted; the last one belongs to ``steps``. Labels and hubs that many nodes share are dealt into parts.

    Links to oneself and repeated links change nothing, a link with a null end is left out, and an empty table has no
    components.
    """
    steps = steps or C.Steps(links.sparkSession)
    some = links.where("x is not null and y is not null")
    edges = steps(some.select("x", "y").unionByName(some.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}_edges")
    label = steps(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("component")), name)
    moved = 1
    while moved:
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        far = C.dealt_join(label.select("node", "component"), jump, "component", "node").select("node", F.col("component").alias("was"), "far")
        low = C.dealt_join(edges, far.select(F.col("node").alias("y"), "far"), "y", "x").groupBy("x").agg(F.min("far").alias("low"))
        near = far.join(low, far.node == low.x).select("node", "was", F.least("far", "low").alias("component"))
        # a label was never above its node, so the least "was" at a node is its own
        both = near.select(F.explode(F.array(F.struct("node", "was", "component"), F.struct(F.col("was").alias("node"), "was", "component"))).alias("r")).select("r.*")
        label = steps(both.groupBy("node").agg(F.min("was").alias("was"), F.min("component").alias("component")), name)
        moved = label.where("component <> was").limit(1).count()
    steps.drop(f"{name}_edges")
    return label.select("node", "component")
