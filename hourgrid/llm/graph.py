"""Connected components of link tables by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import spread_join, staged


def _lowest(rows: DataFrame, total: int) -> DataFrame:
    """(u, v) with the least of u and its neighbours v as m; a node of very many neighbours is not one task's."""
    least = rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("weight"))
    return spread_join(rows, least, "u", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for every node of the edges (a, b): the least node that links lead to.

    Large stars (every greater neighbour to the least) and small stars (every smaller one, too) alternate until
    all edges lead to the least node of their component; the number of rounds is logarithmic in practice.
    Loops, repeated edges and null ends do no harm. Each round is a written table."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, total = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _lowest(large, total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before, total = now, 2 * now[0]
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
