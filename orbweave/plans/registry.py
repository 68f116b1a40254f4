"""Registration of queries: the Spark plan, its result's columns and kinds, and the oracle SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}

#: Common table expressions of the stand-ins, as in :mod:`orbweave.plans.standins`.
CTES = {
    "det": """det AS (SELECT l_orderkey AS frame, l_linenumber * 1000000 + l_partkey AS idx, l_partkey % 20 AS class_id, min(l_suppkey) AS obj,
      min(l_quantity) AS x1, min(100 * l_discount) AS y1, min(l_quantity) + 1 + min(100 * l_tax) AS x2, min(100 * l_discount) + 1 + l_partkey % 7 AS y2, 1 - min(l_discount) AS conf
      FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey)""",
    "pts": """pts AS (SELECT DISTINCT l_suppkey AS obj, CAST(l_quantity * 10000 + round(100 * l_discount) * 100 + round(100 * l_tax) AS BIGINT) AS pid,
      l_quantity AS x, round(100 * l_discount) AS y, round(100 * l_tax) AS z FROM lineitem)""",
    "box": """box AS (SELECT obj, min(x) + obj % 7 AS min_x, min(y) + obj % 5 AS min_y, min(z) AS min_z, max(x) - obj % 9 AS max_x, max(y) AS max_y, max(z) - obj % 3 AS max_z, count(*) AS n FROM pts GROUP BY obj)""",
    "day": """day AS (SELECT user_id AS track, CAST(date_part('day', ts) AS BIGINT) AS frame, floor(min(value)) AS lo, floor(max(value)) + 1 AS hi, count(*) AS n, max(value) AS best FROM events GROUP BY 1, 2)""",
    "trk": """trk AS (SELECT track, count(*) AS frames, avg(hi - lo) AS area_mean, median(hi - lo) AS area_median, stddev_pop(hi - lo) / avg(hi - lo) AS area_cv, track % 3 AS label FROM day GROUP BY track)""",
    "prs": """prs AS (SELECT a.track AS a, b.track AS b, a.frame, a.hi - a.lo AS area_a, b.hi - b.lo AS area_b, greatest(0.0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS inter
      FROM day a JOIN day b ON a.frame = b.frame AND a.track < b.track)""",
    "met": """met AS (SELECT a, b, count(*) AS shared, median(inter / (area_a + area_b - inter)) AS median_iou, avg(CASE WHEN inter / (area_a + area_b - inter) >= 0.3 THEN 1.0 ELSE 0.0 END) AS iou_share,
      avg(CASE WHEN inter / (area_a + area_b - inter) >= 0.4 THEN 1.0 ELSE 0.0 END) AS duplicate_share,
      median(inter / area_a) AS median_ab, median(inter / area_b) AS median_ba, avg(CASE WHEN inter / area_a >= 0.6 THEN 1.0 ELSE 0.0 END) AS share_ab, avg(CASE WHEN inter / area_b >= 0.6 THEN 1.0 ELSE 0.0 END) AS share_ba,
      median(area_a / area_b) AS median_ratio, median(area_a) AS median_area_a, median(area_b) AS median_area_b FROM prs GROUP BY a, b),
      mtr AS (SELECT m.*, m.shared / CAST(least(x.frames, y.frames) AS DOUBLE) AS coverage FROM met m JOIN trk x ON m.a = x.track JOIN trk y ON m.b = y.track)""",
    "cen": """cel AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY label, i),
      cen AS (SELECT label, list(m ORDER BY i) AS c FROM cel GROUP BY label)""",
}
_NEEDS = {"box": ["pts"], "trk": ["day"], "prs": ["day"], "met": ["day", "trk", "prs"]}


def rounded(c: Column) -> Column:
    """``round(c, 6)`` of a double. Spark goes by way of decimal text; where no tie is near, whole millionths are the same and far quicker."""
    x = c.cast("double")
    y = x * 1e6
    whole = F.rint(y)
    return F.when((F.abs(y) < 1e12) & (F.abs(y - whole) < 0.499), whole / 1e6).otherwise(F.round(x, 6)) + 0.0


def query(name: str, ids: str, columns: str, sql: str | None = None, uses: str = ""):
    """Register a query. ``columns``: 'name:kind ...' with kinds i (BIGINT), f (DOUBLE, rounded to 6 digits),
    s (VARCHAR), b (BOOLEAN), applied alike to the plan and to the SQL."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = fn(importable(spark), d)
            kinds = {"i": lambda c: c.cast("bigint"), "f": rounded, "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
            return df.select(*(kinds[k](F.col(n)).alias(n) for n, k in spec))

        run.__doc__ = fn.__doc__
        QUERIES[name], IDS[name] = run, ids
        if sql:
            kinds = {"i": "CAST({0} AS BIGINT) AS {0}", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}", "b": "CAST({0} AS BOOLEAN) AS {0}"}
            names: list[str] = []
            for u in uses.split():
                names += [x for x in [*_NEEDS.get(u, []), u] if x not in names]
            order = [k for k in CTES if k in names]
            head = "WITH RECURSIVE " + ",\n".join(CTES[k] for k in order) + "\n" if order else ""
            ORACLES[name] = f"{head}SELECT {', '.join(kinds[k].format(n) for n, k in spec)} FROM ({sql.strip()}) AS q"
        return run

    return wrap
