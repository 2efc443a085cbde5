"""Connected components, and joins with keys that hold very many rows."""

from pyspark.sql import DataFrame, functions as F

from poolwright.llm.stage import materialize

#: A key with more than this share of the rows is hot: there are at most
#: 1 / HOT of them, so what belongs to them fits a broadcast.
HOT = 1 / 500


def join_by_key(left: DataFrame, right: DataFrame, on: str | list[str], *, how: str = "left", total: int | None = None) -> DataFrame:
    """``left`` LEFT (or INNER) JOIN ``right`` (unique on ``on``), where some keys
    may hold a large part of ``left``: those are joined by broadcast in place,
    all others by shuffle.  Null keys match nothing and are not shuffled.
    ``left`` is read thrice, so it should be a written table, or cheap."""
    on = [on] if isinstance(on, str) else on
    total = left.count() if total is None else total
    hot = left.groupBy(*on).count().where(F.col("count") > max(200.0, total * HOT)).select(*on).dropna().limit(int(1 / HOT)).collect()
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    if hot:
        keys = F.broadcast(left.sparkSession.createDataFrame([(*r, True) for r in hot], left.select(*on).schema.add("_hot", "boolean")))
        marked = left.where(~null).join(keys, on, "left")
        own = F.broadcast(right.join(keys, on, "left_semi"))
        out = marked.where("_hot").join(own, on, how).select(columns).union(marked.where("_hot is null").join(right, on, how).select(columns))
    else:
        out = left.where(~null).join(right, on, how).select(columns)
    if how == "inner":
        return out
    return out.union(left.where(null).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in on)).select(columns))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for the nodes of ``edges``
    (a, b: longs), by alternating large and small stars until nothing changes.
    A hub's neighbours are not gathered in one place; every round is written."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = join_by_key(both, least, "a", how="inner", total=2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_by_key(large, least, "a", how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = materialize(small.where("a <> b").distinct())
        after = print_of(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b")).distinct()
