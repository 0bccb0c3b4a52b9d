"""Full-text search over an inverted table of tokens, and nearest vectors within a partition."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraql.functions.text import bound, tokens
from terraql.functions.vectors import METRICS
from terraql.sources.tables import kept


def inverted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, position): the table that an index would hold."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("position", "token"))


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda token: token == F.lit(word)


def bm25(df: DataFrame, key: str, text: str, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Keys of texts that have any word of the query, with their score."""
    wanted = [w.lower() for w in dict.fromkeys(query)]

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).alias("_len"), *[F.size(F.filter(words, _equals(w))).alias(f"_n{i}") for i, w in enumerate(wanted)])

    # a text is split once, and its few numbers are kept for the statistics and the scores
    each = kept(df.select(key, bound(tokens(F.col(text)), counted).alias("_c")).select(key, "_c.*"))
    stats = each.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_n{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(wanted))])
    both = each.where(" or ".join(f"_n{i} > 0" for i in range(len(wanted)))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("_docs") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        n = F.col(f"_n{i}")
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return both.select(key, score.alias("score"))


def autocomplete(df: DataFrame, key: str, text: str, typed: str) -> DataFrame:
    """Keys and the word that completes what is typed last; words typed before it have to be there."""
    *whole, prefix = typed.lower().split()
    table = df.select(key, tokens(F.col(text)).alias("_w"))
    for w in whole:
        table = table.where(F.array_contains("_w", w))
    return table.select(key, F.explode(F.array_distinct(F.filter("_w", lambda t: t.startswith(prefix)))).alias("completion"))


def spell_check(df: DataFrame, text: str, word: str, most: int = 2, k: int = 5) -> DataFrame:
    """The known words nearest to a word by edit distance; then the commonest, then in order."""
    vocabulary = df.select(F.explode(tokens(F.col(text))).alias("suggestion")).where(F.length("suggestion").between(len(word) - most, len(word) + most))
    counted = vocabulary.groupBy("suggestion").agg(F.count(F.lit(1)).alias("frequency"))
    near = counted.withColumn("distance", F.levenshtein("suggestion", F.lit(word.lower()))).where(F.col("distance") <= most)
    return near.orderBy("distance", F.desc("frequency"), "suggestion").limit(k)


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, metric: str = "euclidean", key: str = "vec_id", partition: Sequence[str] = (), beyond: float | None = None) -> DataFrame:
    """The k rows nearest to a vector, in each partition if there is one; ``beyond`` continues after a distance."""
    target = F.array(*[F.lit(float(x)) for x in query])
    rows = df.withColumn("distance", METRICS[metric](F.col(vector), target))
    if beyond is not None:
        rows = rows.where(F.col("distance") > beyond)
    if not partition:
        return rows.orderBy("distance", key).limit(k)
    order = Window.partitionBy(*partition).orderBy("distance", key)
    return rows.withColumn("row", F.row_number().over(order)).where(F.col("row") <= k)


def bit_set(column: Column, mask: int) -> Column:
    """Whether all bits of a mask are set."""
    return column.bitwiseAND(F.lit(mask)) == F.lit(mask)


def _grid(reach: float, cell: float) -> tuple[Callable, Callable, Callable]:
    """A point's own grid cell, as _r and _c; the middle of a cell; the cells that a distance in degrees may reach. Columns are about as wide as rows are high."""

    def wide(row: Column) -> Column:
        return F.greatest(F.floor(360 / cell * F.cos(F.radians((row + 0.5) * cell - 90))), F.lit(1))

    def turn(lon: Column) -> Column:
        return F.pmod(lon + 180, F.lit(360.0)) / 360  # 180 is -180

    def own(df: DataFrame, lat: str, lon: str) -> DataFrame:
        w = wide(F.col("_r"))
        return df.withColumn("_r", F.floor((F.col(lat) + 90) / cell)).withColumn("_c", F.pmod(F.floor(turn(F.col(lon)) * w), w))

    def middle(row: Column, column: Column) -> tuple[Column, Column]:
        return (row + 0.5) * cell - 90, (column + 0.5) * 360 / wide(row) - 180

    def entered(df: DataFrame, lat: str, lon: str, more: float = 0.0) -> DataFrame:
        far = reach + more
        rows = F.sequence(F.floor((F.col(lat) - far + 90) / cell), F.floor((F.col(lat) + far + 90) / cell))
        # a distance spans more columns toward the poles, and all where the nearest way may lead across one
        half = F.asin(F.lit(math.sin(math.radians(far))) / F.cos(F.radians(lat))) / (2 * math.pi)
        half = F.when(F.abs(lat) + far < 89.9, half).otherwise(0.5)
        df = df.withColumn("_r", F.explode(rows)).withColumn("_w", wide(F.col("_r")))
        low, high = F.floor((turn(F.col(lon)) - half) * F.col("_w")), F.floor((turn(F.col(lon)) + half) * F.col("_w"))
        columns = F.transform(F.sequence(low, F.least(high, low + F.col("_w") - 1)), lambda c: F.pmod(c, F.col("_w")))
        return df.withColumn("_c", F.explode(columns)).drop("_w")

    return own, middle, entered


def spatial_join(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", cell: float = 1.0, side: int = 4096) -> DataFrame:
    """Pairs within a distance: right rows enter the grid cells around theirs, left rows their own; then the exact test.

    Cells are as high as the distance at least. The points of cells are counted first: tasks are as many as the pairs
    to test take, and a cell of too many is dealt out in tiles of about ``side`` rows of each side.
    Columns of the two sides have to differ but for lat and lon, which come back as left_ and right_.
    """
    from terraql.functions.spatial import EARTH_KM, haversine, unit_vector

    reach = math.degrees(max(km, 0) / EARTH_KM) * 1.000001 + 1e-6  # more than rounding can take away
    cell = max(cell, reach)
    own, middle, entered = _grid(reach, cell)
    a = own(left.withColumnsRenamed({lat: "left_lat", lon: "left_lon"}), "left_lat", "left_lon")
    b = right.withColumnsRenamed({lat: "right_lat", lon: "right_lon"})

    # right points are counted as if all of a cell entered what any of them may enter; a row that enters costs about as much as 32 tests
    n = F.count(F.lit(1))
    y, x = middle(F.col("_r"), F.col("_c"))
    settled = own(b, "right_lat", "right_lon").groupBy("_r", "_c").agg(n.alias("_n")).select("_n", y.alias("_y"), x.alias("_x"))
    counted = entered(settled, "_y", "_x", cell / 2).groupBy("_r", "_c").agg(F.sum("_n").alias("_right"))
    both = counted.join(a.groupBy("_r", "_c").agg(n.alias("_left")), ["_r", "_c"], "left").withColumn("_left", F.coalesce("_left", F.lit(0)))
    work = kept(both.withColumn("_work", F.col("_right") * (F.col("_left") + 32.0)))
    most = 2 * side * side
    rows, total, top = work.agg(F.sum("_right"), F.sum("_work"), F.max(F.when(F.col("_left") > 0, F.col("_work")))).first()

    keys = ["_r", "_c"]
    b = entered(b.repartition(math.ceil((rows or 0) / 2_000_000) or 1), "right_lat", "right_lon")
    if top and top > most:
        # at most one cell for so much work, so the table is small
        hot = F.broadcast(work.where((F.col("_left") > 0) & (F.col("_work") > most)).select(*keys, F.ceil(F.col("_left") / side).alias("_i"), F.ceil(F.col("_right") / side).alias("_j")))

        def dealt(df: DataFrame, tile: str, tiles: str, other: str, others: str, columns: Sequence[str]) -> DataFrame:
            one = F.lit(1).cast("bigint")
            df = df.join(hot, keys, "left").withColumn(tile, F.pmod(F.xxhash64(*columns), F.coalesce(tiles, one)))
            return df.withColumn(other, F.explode(F.sequence(one - 1, F.coalesce(others, one) - 1))).drop("_i", "_j")

        a, b = dealt(a, "_s", "_i", "_t", "_j", a.columns), dealt(b, "_t", "_j", "_s", "_i", b.columns)
        keys = [*keys, "_s", "_t"]

    parts = math.ceil((total or 0) / most) or 1
    a, b = (df.repartition(parts, *keys) for df in (a, b))
    u, v = (unit_vector(F.col(f"{s}_lat"), F.col(f"{s}_lon")) for s in ("left", "right"))
    a, b = a.withColumns({f"_u{i}": x for i, x in enumerate(u)}), b.withColumns({f"_v{i}": x for i, x in enumerate(v)})
    near = haversine(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon"))
    test = near <= km
    if 0 <= km < math.pi * EARTH_KM:
        # chords tell all pairs but those that are close to the distance itself
        square = sum((F.col(f"_u{i}") - F.col(f"_v{i}")) * (F.col(f"_u{i}") - F.col(f"_v{i}")) for i in range(3))
        wanted = 4 * math.sin(km / EARTH_KM / 2) ** 2
        slack = wanted * 1e-6 + math.sqrt(wanted) * 1e-14 + 1e-28
        test = (square <= wanted - slack) | ((square <= wanted + slack) & test)
    # a broadcast would be of rows repeated for each cell, which Spark's estimate leaves out
    both = a.join(b.hint("merge"), keys).where(test).withColumn("km", near)
    return both.drop(*keys, *[f"_{x}{i}" for x in "uv" for i in range(3)])
