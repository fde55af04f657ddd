"""Pictures of classified pixels, screen samples, caches and gestures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import overview as O
from tessera.operators import pixels as X
from tessera.queries.base import query, s_scaled, scaled, table

# A picture 250 pixels wide: a pixel for each event, in patches of one level with strays.
_PX = "(SELECT event_id % 250 AS x, event_id // 250 AS y, ((event_id % 250 // 7 + event_id // 1750) % 5 + CASE WHEN event_id * 31 % 97 < 5 THEN 3 ELSE 0 END)::BIGINT AS z FROM events)"


def _picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    z = (F.floor(i % 250 / 7) + F.floor(i / 1750)) % 5 + F.when(i * 31 % 97 < 5, 3).otherwise(0)
    return table(spark, sf_dir, "events").select((i % 250).alias("x"), F.floor(i / 250).alias("y"), z.cast("long").alias("z"))


@query(f"""SELECT z, count(*)::BIGINT AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) FILTER (WHERE y < 40 / 3.0)::BIGINT AS upper, count(*) FILTER (WHERE y >= 40 / 3.0 AND y < 80 / 3.0)::BIGINT AS middle,
count(*) FILTER (WHERE y >= 80 / 3.0)::BIGINT AS lower FROM {_PX} GROUP BY z""")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.class_histogram(_picture(spark, sf_dir), "z", F.lit(40))


_MED = f"""(SELECT p.x, p.y, p.z, m.median FROM {_PX} p JOIN (SELECT c.x, c.y, list_sort(list(s.z))[count(*) // 2 + 1] AS median FROM {_PX} c
  JOIN (SELECT unnest(range(-4, 5, 2)) AS dx) ON true JOIN (SELECT unnest(range(-4, 5, 2)) AS dy) ON true JOIN {_PX} s ON s.x = c.x + dx AND s.y = c.y + dy GROUP BY c.x, c.y HAVING count(*) >= 20) m ON m.x = p.x AND m.y = p.y)"""


@query(f"SELECT x, y, z, median FROM {_MED}")
def window_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.window_median(_picture(spark, sf_dir), "z", radius=4, step=2, least=20)


@query(f"""WITH RECURSIVE f AS (SELECT x, y, z, z - median AS diff FROM {_MED} WHERE abs(z - median) >= 2),
r(x, y, ly, lx) AS (SELECT x, y, y, x FROM f UNION SELECT f.x, f.y, r.ly, r.lx FROM r JOIN f ON (abs(f.x - r.x) + abs(f.y - r.y)) = 1),
l AS (SELECT x, y, min(row(ly, lx)) AS k FROM r GROUP BY x, y),
v AS (SELECT k, count(*)::BIGINT AS size, min(f.x) AS x0, max(f.x) AS x1, min(f.y) AS y0, max(f.y) AS y1, sum(diff)::BIGINT AS total FROM f JOIN l ON l.x = f.x AND l.y = f.y GROUP BY k),
m AS (SELECT k, diff FROM (SELECT k, diff, count(*) AS n FROM f JOIN l ON l.x = f.x AND l.y = f.y GROUP BY k, diff) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, diff) = 1)
SELECT size, x0, x1, y0, y1, total, m.diff AS mode FROM v JOIN m ON m.k = v.k""")
def stray_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.window_median(_picture(spark, sf_dir), "z", radius=4, step=2, least=20).where(F.abs(F.col("z") - F.col("median")) >= 2)
    cells = found.select("x", "y", F.lit("stray").alias("cls"), (F.col("z") - F.col("median")).alias("diff"))
    return M.grid_components(cells, "diff").drop("cls")


_SC = "(SELECT c_custkey % 20 AS view, c_custkey AS id, (c_custkey % 5)::INTEGER AS z, (c_custkey * 37 % 1100)::DOUBLE AS x0, (c_custkey * 53 % 700)::DOUBLE AS y0, (c_custkey % 6 + 1) * 40.0 AS side, (c_custkey % 4 + 1) / 2.0 AS ratio FROM customer)"


@query(f"""WITH g AS (SELECT view, (i + 0.5) / 32.0 * 1280 AS px, (j + 0.5) / 20.0 * 860 AS py FROM (SELECT unnest(range(0, 20)) AS view), (SELECT unnest(range(0, 32)) AS i), (SELECT unnest(range(0, 20)) AS j)),
b AS (SELECT g.view, px, py, min(row(-s.z, s.side, s.ratio)) FILTER (WHERE s.view IS NOT NULL) AS best FROM g LEFT JOIN {_SC} s ON s.view = g.view AND px BETWEEN x0 AND x0 + side AND py BETWEEN y0 AND y0 + side GROUP BY ALL)
SELECT view, count(*)::BIGINT AS total, count(*) FILTER (WHERE best[3] <= 1.2)::BIGINT AS sharp, count(*) FILTER (WHERE best[3] > 1.2)::BIGINT AS blur, count(*) FILTER (WHERE best IS NULL)::BIGINT AS uncovered FROM b GROUP BY view""")
def sample_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    side = (k % 6 + 1) * 40.0
    boxes = c.select((k % 20).alias("view"), (k % 5).cast("int").alias("z"), (k * 37 % 1100).cast("double").alias("x0"), (k * 53 % 700).cast("double").alias("y0"), side.alias("_s"), ((k % 4 + 1) / 2.0).alias("ratio"))
    boxes = boxes.withColumns({"x1": F.col("x0") + F.col("_s"), "y1": F.col("y0") + F.col("_s")}).drop("_s")
    grid = spark.range(20 * 32 * 20).select((F.col("id") % 20).alias("view"), ((F.floor(F.col("id") / 20) % 32 + 0.5) / 32.0 * 1280).alias("px"), ((F.floor(F.col("id") / 640) + 0.5) / 20.0 * 860).alias("py"))
    return X.sample_ratios(grid, boxes, 1.2, 128)


_AT = "CASE WHEN event_id % 3 = 0 THEN 'normal' WHEN event_id % 5 > 0 AND event_id % 7 = 1 THEN 'geom' WHEN event_id % 5 > 0 AND event_id % 7 = 2 THEN 'loading' WHEN event_id % 5 > 0 AND event_id % 11 < 4 THEN 'unselected' WHEN event_id % 5 = 0 THEN 'hole' WHEN event_id % 2 = 0 THEN 'finer' ELSE 'normal' END"


@query(f"SELECT user_id % 10 AS view, {_AT} AS reason, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def pixel_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    why = X.attribute(i % 3 == 0, i % 7 == 1, i % 7 == 2, i % 11 >= 4, i % 5 > 0, i % 2 == 0)
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("view"), why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT user_id % 10 AS view, (event_id % 9)::INTEGER AS z, count(*) FILTER (WHERE event_id * 7 % 400 < 160)::BIGINT AS tiny, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tiny_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = {"view": F.col("user_id") % 10, "z": (F.col("event_id") % 9).cast("int")}
    return O.small_tiles(table(spark, sf_dir, "events"), by, F.col("event_id") * 7 % 400, 160)


@query("SELECT user_id % 10 AS view, CASE WHEN event_id % 860 < 860 / 3.0 THEN 'upper' WHEN event_id % 860 < 1720 / 3.0 THEN 'middle' ELSE 'lower' END AS band, count(*)::BIGINT AS n, min(event_id * 7907 % 100000) AS nearest, max(event_id * 7907 % 100000) AS farthest, min(event_id % 9) AS coarsest, max(event_id % 9) AS finest FROM events GROUP BY ALL")
def band_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, far, z = F.col("event_id") % 860, F.col("event_id") * 7907 % 100000, F.col("event_id") % 9
    return O.band_ranges(table(spark, sf_dir, "events"), {"view": F.col("user_id") % 10, "band": O.band(y, 860.0)}, far, z)


@query(f"SELECT user_id % 10 AS view, max({s_scaled('value', 100)}) AS highest, max(event_id % 9) FILTER (WHERE event_type = 'click') AS deepest FROM events GROUP BY ALL")
def observed_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return O.observed_maxima(e, {"view": F.col("user_id") % 10}, scaled(F.col("value"), 100), F.col("event_id") % 9, F.col("event_type") == "click")


@query("SELECT 'u' || (user_id % 50) AS cache, count(*)::BIGINT AS entries, sum(event_id * 613 % 90000 + 1000)::BIGINT AS bytes, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS hits FROM events GROUP BY ALL")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return O.cache_sizes(e, F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")), F.col("event_id") * 613 % 90000 + 1000, F.col("event_type") == "view")


@query("""SELECT scenario, count(*) FILTER (WHERE stuck)::BIGINT AS stuck FROM (SELECT 's' || (user_id % 12) AS scenario, event_id % 3 > 0 AND coalesce(abs(event_id // 50 % 7 - lag(event_id // 50 % 7) OVER w) < 1e-3, false) AS stuck
FROM events WINDOW w AS (PARTITION BY user_id % 12 ORDER BY event_id)) GROUP BY scenario""")
def stuck_gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("scenario"), (F.col("event_id") % 3 > 0).alias("interacting"), (F.floor(F.col("event_id") / 50) % 7).alias("pose"))
    return M.stuck_gestures(e, "scenario", "event_id", ["pose"])


# A gesture is released where the pose has stood still for longer than the limit before a sample.
_LIMIT = 800_000


@query(f"""WITH s AS (SELECT user_id, event_id, epoch_us(ts)::BIGINT AS t, event_id // 3 % 4 AS pose FROM events),
m AS (SELECT *, CASE WHEN pose IS DISTINCT FROM lag(pose) OVER w THEN t END AS moved FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, t - max(moved) OVER (PARTITION BY user_id ORDER BY t, event_id) > {_LIMIT} AS released FROM m""")
def gesture_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.floor(F.col("event_id") / 3) % 4).alias("pose"))
    return M.watchdog(s, "user_id", ["t", "event_id"], "t", "pose", _LIMIT).select("event_id", "released")
