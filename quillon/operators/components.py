"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.store import discard, written


def components(nodes: DataFrame, edges: DataFrame, node: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node with the smallest one it reaches.

    Labels fall to the least of the neighbours', a node that is a label also to
    the least that one of its own nodes met, and then to the label's own label,
    so the rounds grow with the logarithm of a chain's length. Minima are
    combined before they are shuffled. Each round is written in the shared folder, and the one before it deleted.
    """
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u != v").distinct())
    label = written(nodes.select(F.col(node).alias("node"), F.col(node).alias("component")).distinct())
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("least"))
        new = label.join(near, F.col("node") == F.col("u"), "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("mid"))
        met = new.groupBy(F.col("component").alias("of")).agg(F.min("mid").alias("met"))
        new = new.join(met, F.col("node") == F.col("of"), "left").select("node", F.least("mid", F.coalesce("met", "mid")).alias("mid"))
        up = new.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        new = written(new.join(up, "mid").select("node", F.least("mid", "top").alias("component")))
        if not new.join(label.select("node", F.col("component").alias("was")), "node").where("component != was").limit(1).count():
            discard(both)
            return new
        discard(label)
        label = new
