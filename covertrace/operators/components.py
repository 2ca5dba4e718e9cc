"""Groups of rows that links draw together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.session import written


def smallest_linked(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): for each id in ``links`` the smallest id it is linked to over any number of links.

    Each round takes the smallest label along the links, then the label's own label, until no label changes;
    rounds are logarithmic in the longest chain. Each is written to the shared folder. Null ends and self links
    add nothing.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges)
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    labels = written(edges.select(F.explode(F.array("u", "v")).alias("id"), F.col("v").alias("x")).groupBy("id").agg(F.min("x").alias("root")))
    while True:
        at_u, at_v = labels.select(F.col("id").alias("u"), F.col("root").alias("ru")), labels.select(F.col("id").alias("v"), F.col("root").alias("rv"))
        meet = edges.join(at_u, "u").join(at_v, "v").where("ru <> rv").select("u", "v", "ru", "rv", F.least("ru", "rv").alias("x"))
        if meet.isEmpty():  # all links are within one label
            return labels
        # both ends and both their labels take the smaller label
        moved = meet.select(F.explode(F.array("u", "v", "ru", "rv")).alias("id"), "x").groupBy("id").agg(F.min("x").alias("x"))
        stepped = labels.join(moved, "id", "left").select("id", F.least("root", F.coalesce("x", "root")).alias("root"))
        jump = stepped.select(F.col("id").alias("root"), F.col("root").alias("further"))
        labels = written(stepped.join(jump, "root", "left").select("id", F.least("root", F.coalesce("further", "root")).alias("root")))
