"""Parent pointers and linked chains, by joins that double their length, with a depth bound and a guard against cycles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.session import discard, written


def _view(df: DataFrame) -> str:
    name = "mosaiq_" + uuid.uuid4().hex
    df.createOrReplaceTempView(name)
    return name


def style_chain(styles: DataFrame, keys: list[str], depth: int = 10) -> DataFrame:
    """(keys, id, level, ancestor, value): every style with its ancestors up to `depth` steps, itself at level 0.

    styles (keys, id, parent, value), ids unique within their keys. Chains are cut where a parent is missing; cycles end at
    the depth bound. Arrays of ancestors double in each join (1, 2, 4, ... styles), so there are few joins and no recursion.
    The hint keeps tables whose compressed size looks small off the driver. A chain that has ended meets nothing and is dealt by its own id, so ended chains don't gather in one task.
    """
    kind, known = styles.schema["id"].dataType, F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()

    def place(there: bool, x: str) -> Column:
        return F.struct(F.lit(there).alias("there"), *keys, F.col(x).cast(kind).alias("x"))

    paths = styles.select(*keys, "id", F.array("id").alias("ancestors"), F.array("value").alias("values"), F.col("parent").alias("next"))
    size = 1
    while size <= depth:
        more = min(size, depth + 1 - size)
        above = paths.where(known & F.col("id").isNotNull()).select(place(True, "id").alias("at"), *(F.slice(c, 1, more).alias(f"more_{c}") for c in ("ancestors", "values")), F.col("next").alias("then"))
        met = paths.withColumn("at", F.when(known & F.col("next").isNotNull(), place(True, "next")).otherwise(place(False, "id"))).join(above.hint("merge"), "at", "left")
        grown = (F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"more_{c}")).alias(c) for c in ("ancestors", "values"))
        paths, size = met.select(*keys, "id", *grown, F.col("then").alias("next")), size + more
    rows = paths.select(*keys, "id", F.posexplode(F.arrays_zip("ancestors", "values")).alias("level", "x"))
    return rows.select(*keys, "id", "level", F.col("x.ancestors").alias("ancestor"), F.col("x.values").alias("value"))


def inherited(chain: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the nearest style in the chain that has one."""
    own = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("level")))
    return chain.groupBy(*keys, "id").agg(own.alias("value"), (F.max("level") + 1).alias("length"))


def _branches(jumps: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """(start, step, sector) of every path from each head where a sector may lead to several: one round a step."""
    a, b = _view(jumps), _view(heads)
    return jumps.sparkSession.sql(
        f"WITH RECURSIVE c(start, step, sector, seen) MAX RECURSION LEVEL {limit + 2} AS (SELECT sector, 0, sector, array(sector) FROM {b} UNION ALL "
        f"SELECT c.start, c.step + 1, l.next, array_append(c.seen, l.next) FROM c JOIN {a} l ON l.sector = c.sector WHERE NOT array_contains(c.seen, l.next) AND c.step < {limit}) "
        "SELECT start, step, sector FROM c LIMIT ALL"
    )


def _paths(jumps: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """(start, step, sector) of the path from each head, written to the shared folder, as are the rounds before.

    A round takes every step of the paths that are still open as many jumps on as they are long, so that they double, and
    the jumps with them. Of a sector met twice the first step stays; a path that doesn't fill its length has ended.
    """
    paths = written(heads.select(F.col("sector").alias("start"), F.lit(0).alias("step"), "sector"), "paths")
    size = 1
    while size <= limit:
        going = paths.where(F.col("step") == size - 1).select("start")
        if going.isEmpty():
            break
        if size > 1:
            onward = jumps.select(F.col("sector").alias("next"), F.col("next").alias("then"))
            far = written(jumps.join(onward.hint("merge"), "next").select("sector", F.col("then").alias("next")), "jumps")
            discard(jumps)
            jumps = far
        more = paths.join(going.hint("merge"), "start", "left_semi").join(jumps.hint("merge"), "sector")
        more = more.select("start", (F.col("step") + size).alias("step"), F.col("next").alias("sector"))
        grown = written(paths.unionByName(more).groupBy("start", "sector").agg(F.min("step").alias("step")), "paths")
        discard(paths)
        paths, size = grown, size * 2
    discard(jumps)
    return paths


def chain_order(links: DataFrame, starts: DataFrame, limit: int = 100_000, end: int = -2) -> DataFrame:
    """(chain, step, sector): sectors of each chain in order, from (sector, next) and (chain, sector).

    A chain ends at `end`, at a sector that isn't there, at one that it has visited, and at `limit` steps. Chains that
    start at one sector share its path, which is found once; sectors to which nothing leads are left out before. The
    hints keep tables whose compressed size looks small off the driver.
    """
    first = starts.where(~F.col("sector").eqNullSafe(F.lit(end)))
    hops = links.where(F.col("next") != end).select("sector", F.col("next").cast(links.schema["sector"].dataType).alias("next"))
    heads = first.where("sector is not null").select("sector").distinct()
    met = hops.select(F.col("next").alias("sector")).unionByName(heads).distinct()
    jumps = written(hops.join(met.hint("merge"), "sector", "left_semi"), "jumps")
    forked = not jumps.groupBy("sector").count().where("count > 1").isEmpty()
    paths = (_branches if forked else _paths)(jumps, heads, limit)
    rest = paths.where((F.col("step") > 0) & (F.col("step") <= limit)).select(F.col("start").alias("head"), "step", F.col("sector").alias("at"))
    later = first.select("chain", F.col("sector").alias("head")).join(rest.hint("merge"), "head").select("chain", "step", F.col("at").alias("sector"))
    return first.select("chain", F.lit(0).alias("step"), "sector").unionByName(later)
