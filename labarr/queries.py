"""Queries over the test tables, one for each operator, with the SQL that says the same.

Sums of money are rounded on both sides, as the order of additions differs.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, cftime, exprs
from .operators import DataArray, Dataset
from .plans.index import Index
from .sources.table import from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,4)")).cast("double")


# --- the arrays ------------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataArray:
    """day x event_type: sum of value."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return from_table(rows, ["day", "event_type"], {"value": money(F.col("value"))})["value"]


_DAILY = "SELECT ts::DATE AS d, event_type, sum(value::DECIMAL(18,4))::DOUBLE AS v FROM events GROUP BY ALL"
_DAILY_AT = f"SELECT *, dense_rank() OVER (ORDER BY d) - 1 AS i, dense_rank() OVER (ORDER BY event_type) - 1 AS j FROM ({_DAILY})"


def _text_day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.000Z')"


def hourly(spark: SparkSession, sf_dir: str) -> DataArray:
    """hour: sum of value; hours without events hold null."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    return from_table(rows, ["hour"], {"value": money(F.col("value"))})["value"]


_HOURLY = "SELECT date_trunc('hour', ts) AS h, sum(value::DECIMAL(18,4))::DOUBLE AS v FROM events GROUP BY ALL"


def cube(spark: SparkSession, sf_dir: str) -> Dataset:
    """month x returnflag x linestatus: sums of quantity and price."""
    rows = table(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity", "l_extendedprice")
    return from_table(rows, ["month", "flag", "status"], {"quantity": money(F.col("l_quantity")), "price": money(F.col("l_extendedprice"))})


_CUBE = "SELECT date_trunc('month', l_shipdate)::DATE AS m, l_returnflag AS flag, l_linestatus AS status, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS q, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS p FROM lineitem GROUP BY ALL"
_CUBE_GRID = f"""SELECT m, flag, status, q, p, dense_rank() OVER (ORDER BY m) - 1 AS i, dense_rank() OVER (ORDER BY flag) - 1 AS j, dense_rank() OVER (ORDER BY status) - 1 AS k
FROM (SELECT DISTINCT m FROM ({_CUBE})) CROSS JOIN (SELECT DISTINCT flag FROM ({_CUBE})) CROSS JOIN (SELECT DISTINCT status FROM ({_CUBE})) LEFT JOIN ({_CUBE}) USING (m, flag, status)"""


def odd_orders(spark: SparkSession, sf_dir: str) -> DataArray:
    """orderkey: total price, with nulls at keys divisible by 7 and NaN at those by 11.

    Positions come from the keys, which are 0 or 1 up to the number of orders."""
    rows = table(spark, sf_dir, "orders")
    least, most = rows.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    k = F.col("o_orderkey")
    value = F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    cells = rows.select((k - least).alias("__i_orderkey"), value.alias("value"))
    return DataArray.from_cells(cells, ["orderkey"], [most - least + 1], {"orderkey": Index.range(most - least + 1, least)})


_ODD = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS v FROM orders"


def _cells(a: DataArray, *names: str) -> DataFrame:
    """Positions under the given names, and value."""
    return a.cells.toDF(*names, "value")


def _records(a: DataArray) -> DataFrame:
    return a.records()


# --- one query per operator ------------------------------------------------------------

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_R = f"SELECT {_text_day('d')} AS day, event_type, v AS value FROM ({_DAILY_AT})"


@query(f"SELECT {_text_day('m')} AS month, flag, status, q AS value FROM ({_CUBE_GRID})")
def from_table_cube(spark, sf_dir):
    return _records(cube(spark, sf_dir)["quantity"])


@query(f"SELECT {_text_day('d')} AS day, v AS value FROM ({_DAILY}) WHERE event_type = 'purchase'")
def sel_scalar(spark, sf_dir):
    return _records(daily(spark, sf_dir).sel({"event_type": "purchase"}))


@query(f"{_R} WHERE event_type IN ('click', 'purchase')")
def sel_list(spark, sf_dir):
    return _records(daily(spark, sf_dir).sel({"event_type": ["click", "purchase"]}))


@query(f"{_R} WHERE i BETWEEN 3 AND 9")
def sel_slice(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _records(a.sel({"day": {"start": a.indexes["day"][3], "stop": a.indexes["day"][9]}}))


@query(f"{_R} WHERE i >= 20")
def sel_one_sided(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _records(a.sel({"day": {"start": a.indexes["day"][20]}}))


@query(f"SELECT i, n AS j, v AS value FROM ({_DAILY_AT}) JOIN (VALUES (0, 'view'), (1, 'click'), (2, 'view')) AS w(n, event_type) USING (event_type)")
def sel_list_reorder_dups(spark, sf_dir):
    got = _cells(daily(spark, sf_dir).sel({"event_type": ["view", "click", "view"]}), "i", "j")
    return got.withColumn("j", F.col("j").cast("int"))


def _targets(a: DataArray) -> list[datetime]:
    """Three instants between the array's first and last hours."""
    first, n = a.indexes["hour"][0], len(a.indexes["hour"])
    return [first + timedelta(hours=h, minutes=m) for h, m in ((n // 5, 20), (n // 2, 45), (n // 2 + 7, 30))]


_HOURS = f"SELECT *, row_number() OVER (ORDER BY h) - 1 AS i FROM ({_HOURLY})"
_ASKED = f"SELECT n, f + to_hours(a::INT) + to_minutes(b::INT) AS t FROM (SELECT min(h) AS f, count(*) AS c FROM ({_HOURLY})), LATERAL (VALUES (0, c // 5, 20), (1, c // 2, 45), (2, c // 2 + 7, 30)) AS w(n, a, b)"


def _asked(spark, sf_dir, method, **more):
    a = hourly(spark, sf_dir)
    got = _records(a.sel({"hour": _targets(a)}, method=method, **more))
    return got


@query(f"SELECT {_text_day('s.h')} AS hour, s.v AS value FROM (SELECT n, arg_min(struct_pack(h := h, v := v), struct_pack(d := abs(epoch_us(h) - epoch_us(t)), i := i)) AS s FROM ({_HOURS}), ({_ASKED}) GROUP BY n)")
def sel_nearest(spark, sf_dir):
    return _asked(spark, sf_dir, "nearest")


@query(f"SELECT {_text_day('h')} AS hour, v AS value FROM ({_ASKED}) a ASOF JOIN ({_HOURS}) b ON a.t >= b.h")
def sel_ffill(spark, sf_dir):
    return _asked(spark, sf_dir, "ffill")


@query(f"SELECT {_text_day('h')} AS hour, v AS value FROM ({_ASKED}) a ASOF JOIN ({_HOURS}) b ON a.t <= b.h")
def sel_bfill(spark, sf_dir):
    return _asked(spark, sf_dir, "bfill")


@query(f"SELECT {_text_day('h')} AS hour, v AS value FROM ({_ASKED}) a ASOF JOIN ({_HOURS}) b ON a.t >= b.h WHERE epoch_ms(a.t) - epoch_ms(b.h) <= 864000000")
def sel_tolerance(spark, sf_dir):
    return _asked(spark, sf_dir, "ffill", tolerance=864_000_000)


@query(f"SELECT {_text_day('h')} AS hour, v AS value FROM ({_ASKED}) a ASOF JOIN ({_HOURS}) b ON a.t <= b.h")
def sel_ffill_descending(spark, sf_dir):
    a = hourly(spark, sf_dir)
    return _records(a.isel({"hour": slice(None, None, -1)}).sel({"hour": _targets(a)}, method="ffill"))


@query(f"SELECT {_text_day('m')} AS month, status, q AS value FROM (SELECT *, max(j) OVER () AS last FROM ({_CUBE_GRID})) WHERE j = last")
def isel_negative(spark, sf_dir):
    return _records(cube(spark, sf_dir)["quantity"].isel({"flag": -1}))


@query(f"SELECT n AS i, j, k, q AS value FROM ({_CUBE_GRID}) JOIN (VALUES (0::BIGINT, 5), (1, 2), (2, 7)) AS w(n, i) USING (i)")
def isel_list(spark, sf_dir):
    return _cells(cube(spark, sf_dir)["quantity"].isel({"month": [5, 2, 7]}), "i", "j", "k")


@query(f"SELECT {_text_day('d')} AS day, v AS value FROM ({_DAILY_AT}) WHERE i BETWEEN 6 AND 12 AND event_type = 'view'")
def sel_chained(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _records(a.isel({"day": slice(4, 20)}).sel({"event_type": ["click", "view"]}).isel({"day": slice(2, 9)}).sel({"event_type": "view"}))


@query(f"SELECT round(coalesce(sum(CASE WHEN NOT isnan(v) THEN v END), 0), 2) AS value FROM ({_ODD})")
def sum_all(spark, sf_dir):
    return odd_orders(spark, sf_dir).sum().cells.select(F.round("value", 2).alias("value"))


@query(f"SELECT round(avg(CASE WHEN NOT isnan(v) THEN v END), 4) AS value FROM ({_ODD})")
def mean_all(spark, sf_dir):
    return odd_orders(spark, sf_dir).mean().cells.select(F.round("value", 4).alias("value"))


@query(f"SELECT count(CASE WHEN NOT isnan(v) THEN 1 END) AS value FROM ({_ODD})")
def count_valid(spark, sf_dir):
    return odd_orders(spark, sf_dir).count().cells


@query(f"SELECT {_text_day('m')} AS month, flag, round(sum(coalesce(q, 0)), 2) AS value FROM ({_CUBE_GRID}) GROUP BY ALL")
def sum_dim(spark, sf_dir):
    return _records(cube(spark, sf_dir)["quantity"].sum("status")).withColumn("value", F.round("value", 2))


@query(f"SELECT flag, status, round(avg(p), 4) AS value FROM ({_CUBE_GRID}) GROUP BY ALL")
def mean_dim(spark, sf_dir):
    return _records(cube(spark, sf_dir)["price"].mean("month")).withColumn("value", F.round("value", 4))


@query(f"SELECT flag, status, max(q) AS most, min(q) AS least, round(ln(product(1 + q / 1e6)), 9) AS prod FROM ({_CUBE_GRID}) GROUP BY ALL")
def reduce_max_min_product(spark, sf_dir):
    a = cube(spark, sf_dir)["quantity"]
    many = a.divide(1e6).add(1.0)
    got = Dataset({"most": a.reduce("month", "max"), "least": a.reduce("month", "min"), "prod": many.reduce("month", "product")})
    wide = got.wide()
    names = got["most"].to_records().select("__i_flag", "__i_status", "flag", "status")
    return wide.join(names, ["__i_flag", "__i_status"]).select("flag", "status", "most", "least", F.round(F.log("prod"), 9).alias("prod"))


@query(f"SELECT i, j, k, round(q + p, 4) AS a, round(q - p, 4) AS s, round(q * p, 2) AS m, round(p / q, 6) AS d, round(pow(q, 0.5), 6) AS w FROM ({_CUBE_GRID})")
def arith_add_sub_mul_div_pow(spark, sf_dir):
    c = cube(spark, sf_dir)
    q, p = c["quantity"], c["price"]
    got = Dataset({"a": q.add(p), "s": q.subtract(p), "m": q.multiply(p), "d": p.divide(q), "w": q.power(0.5)}).wide()
    return got.select(F.col("__i_month").alias("i"), F.col("__i_flag").alias("j"), F.col("__i_status").alias("k"), F.round("a", 4).alias("a"), F.round("s", 4).alias("s"), F.round("m", 2).alias("m"), F.round("d", 6).alias("d"), F.round("w", 6).alias("w"))


@query("SELECT o_orderkey AS k, CASE WHEN v IS NULL THEN NULL WHEN d = 0 THEN CASE WHEN v > 0 THEN 'Infinity'::DOUBLE WHEN v < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END ELSE v / d END AS value FROM (SELECT o_orderkey, (o_orderkey % 5 - 2)::DOUBLE AS v, (o_orderkey % 3)::DOUBLE AS d FROM orders)")
def div_by_zero(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = rows.agg(F.max("o_orderkey")).first()[0] + 1
    cells = rows.select(k.alias("__i_k"), (k % 5 - 2).cast("double").alias("v"), (k % 3).cast("double").alias("d"))
    # made from one frame: the quotient is a projection
    v, d = (DataArray.from_cells(cells, ["k"], [n], None, c) for c in ("v", "d"))
    return _cells(v.divide(d), "k")


_CMP = f"FROM ({_CUBE_GRID})"


@query(f"SELECT i, j, k, q > p / 1500 AS gt, q >= 4000 AS ge, q < p / 1500 AS lt, q <= 4000 AS le, q = 4000 AS eq, q != 4000 AS ne {_CMP} WHERE q IS NOT NULL")
def compare_all(spark, sf_dir):
    c = cube(spark, sf_dir)
    q, p = c["quantity"], c["price"].divide(1500)
    got = Dataset({"gt": q.gt(p), "ge": q.ge(4000), "lt": q.lt(p), "le": q.le(4000), "eq": q.eq(4000), "ne": q.ne(4000), "q": q}).wide().filter("q is not null")
    return got.select(F.col("__i_month").alias("i"), F.col("__i_flag").alias("j"), F.col("__i_status").alias("k"), "gt", "ge", "lt", "le", "eq", "ne")


@query(f"SELECT k, CASE WHEN v IS NULL THEN NULL ELSE NOT isnan(v) AND v > 150000 END AS gt, CASE WHEN v IS NULL THEN NULL ELSE NOT isnan(v) AND v <= 150000 END AS le, v IS NULL OR NOT isnan(v) AS eq FROM ({_ODD})")
def compare_nan(spark, sf_dir):
    a = odd_orders(spark, sf_dir)
    got = Dataset({"gt": a.gt(150000), "le": a.le(150000), "eq": a.eq(a)}).wide()
    least = a.indexes["orderkey"][0]
    return got.select((F.col("__i_orderkey") + F.lit(int(least))).alias("k"), "gt", "le", "eq")


@query(f"SELECT {_text_day('d')} AS day, event_type, CASE WHEN v > 12000 THEN v END AS value FROM ({_DAILY})")
def where_mask(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _records(a.where(a.gt(12000)))


@query(f"SELECT {_text_day('d')} AS day, event_type, CASE WHEN v > 12000 THEN v ELSE -1 END AS value FROM ({_DAILY})")
def where_other(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _records(a.where(a.gt(12000), -1))


@query(f"SELECT k, CASE WHEN coalesce(v != 0 OR isnan(v), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM ({_ODD})")
def where_truthy(spark, sf_dir):
    a = odd_orders(spark, sf_dir)
    got = DataArray.choose(a, 1, 0)
    return got.cells.select((F.col("__i_orderkey") + F.lit(int(a.indexes["orderkey"][0]))).alias("k"), "value")


def _regions(spark, sf_dir) -> DataArray:
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").cast("double").alias("n"))
    return from_table(rows, ["n_regionkey"], ["n"])["n"]


@query(f"SELECT r AS region, {_text_day('d')} AS day, n * v AS value FROM (SELECT n_regionkey::DOUBLE AS r, count(*)::DOUBLE AS n FROM nation GROUP BY ALL) CROSS JOIN (SELECT d, v FROM ({_DAILY}) WHERE event_type = 'view')")
def broadcast_outer(spark, sf_dir):
    got = _regions(spark, sf_dir).multiply(daily(spark, sf_dir).sel({"event_type": "view"}))
    return _records(got).withColumnRenamed("n_regionkey", "region")


@query(f"SELECT i, j, round(v - mean(v) OVER (PARTITION BY event_type), 4) AS value FROM ({_DAILY_AT})")
def broadcast_shared(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _cells(a.subtract(a.mean("day")), "i", "j").withColumn("value", F.round("value", 4))


def _rolled(before: int, after: int, least: int, what: str, source: str = _DAILY_AT) -> str:
    frame = f"PARTITION BY event_type ORDER BY i ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING"
    return f"SELECT i, j, round(CASE WHEN count(v) OVER ({frame}) >= {least} THEN {what}(v) OVER ({frame}) END, 4) AS value FROM ({source})"


@query(_rolled(6, 0, 7, "avg"))
def rolling_mean(spark, sf_dir):
    return _cells(daily(spark, sf_dir).rolling("day", 7).mean(), "i", "j").withColumn("value", F.round("value", 4))


@query(_rolled(1, 2, 4, "sum"))
def rolling_sum_center(spark, sf_dir):
    return _cells(daily(spark, sf_dir).rolling("day", 4, center=True).sum(), "i", "j").withColumn("value", F.round("value", 4))


@query(_rolled(4, 0, 2, "avg", f"SELECT i, j, event_type, CASE WHEN i % 3 != 0 THEN v END AS v FROM ({_DAILY_AT})"))
def rolling_min_periods(spark, sf_dir):
    a = daily(spark, sf_dir)
    keep = DataArray.from_cells(spark.range(a.shape[0]).select(F.col("id").alias("__i_day"), (F.col("id") % 3).alias("value")), ["day"], [a.shape[0]], {"day": a.indexes["day"]})
    masked = DataArray.choose(keep, a, None)
    return masked.rolling("day", 5, min_periods=2).mean().cells.select(F.col("__i_day").alias("i"), F.col("__i_event_type").alias("j"), F.round("value", 4).alias("value"))


@query("SELECT k AS i, round(CASE WHEN count(v) OVER w >= 168 THEN avg(v) OVER w * 168 END, 2) AS value FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_totalprice AS v FROM orders) WINDOW w AS (ORDER BY k ROWS BETWEEN 83 PRECEDING AND 84 FOLLOWING)")
def rolling_lane(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    least, n = rows.agg(F.min("o_orderkey"), F.count("*")).first()
    a = DataArray.from_cells(rows.select((F.col("o_orderkey") - least).alias("__i_x"), F.col("o_totalprice").alias("value")), ["x"], [n])
    return _cells(a.rolling("x", 168, center=True).mean(), "i").withColumn("value", F.round(F.col("value") * 168, 2))


def _halves(spark, sf_dir) -> tuple[Dataset, Dataset]:
    a = daily(spark, sf_dir)
    return Dataset({"v": a.isel({"day": slice(0, 11)})}), Dataset({"v": a.isel({"day": slice(11, None)})})


@query(f"{_R}")
def concat_time(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return _records(a.concat(b, "day")["v"])


@query(f"{_R} WHERE i BETWEEN 8 AND 15")
def concat_sel_span(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return _records(a.concat(b, "day").isel({"day": slice(8, 16)})["v"])


@query(f"SELECT i, j, k, q AS quantity, p AS price FROM ({_CUBE_GRID})")
def merge_vars(spark, sf_dir):
    c = cube(spark, sf_dir)
    merged = Dataset({"quantity": c["quantity"]}).merge(Dataset({"price": c["price"]}))
    return merged.wide().toDF("i", "j", "k", "quantity", "price")


@query(f"SELECT i, j, k, q AS amount FROM ({_CUBE_GRID})")
def rename_drop(spark, sf_dir):
    return cube(spark, sf_dir).rename({"quantity": "amount"}).drop_vars(["price", "none"]).wide().toDF("i", "j", "k", "amount")


@query(f"SELECT (i * 2 + 1)::DOUBLE AS day, event_type, v AS value FROM ({_DAILY_AT})")
def assign_coords(spark, sf_dir):
    a = daily(spark, sf_dir)
    return _records(a.assign_coords({"day": [2 * i + 1 for i in range(a.shape[0])]}))


@query(f"SELECT {_text_day('d')} AS day, v AS value FROM ({_DAILY_AT}) WHERE event_type = 'click'")
def squeeze(spark, sf_dir):
    return _records(daily(spark, sf_dir).sel({"event_type": ["click"]}).squeeze())


@query("SELECT floor(s_acctbal * 10 + 0.5) / 10 AS label, s_suppkey::DOUBLE AS value FROM supplier")
def to_records(spark, sf_dir):
    """Labels are the suppliers' balances; records round them."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_acctbal").collect()
    a = DataArray.from_flat(spark, [float(r["s_suppkey"]) for r in rows], (len(rows),), ["label"], {"label": [r["s_acctbal"] for r in rows]})
    return a.records(precision=1)


@query(f"SELECT 'hourly' AS type, 'hours' AS unit, (epoch(h2) - epoch(h1)) / 3600.0::DOUBLE AS value FROM (SELECT min(h) FILTER (i = 0) AS h1, min(h) FILTER (i = 1) AS h2 FROM ({_HOURS}))")
def resolution(spark, sf_dir):
    a = hourly(spark, sf_dir)
    a.attrs["units"] = "seconds since 1970-01-01"
    got = a.calculate_time_resolution("hour")
    return spark.createDataFrame([(got["type"], got["unit"], float(got["value"]))], "type string, unit string, value double")


@query(f"SELECT count(DISTINCT d) * count(DISTINCT event_type) * 8 AS bytes, 7 * count(DISTINCT event_type) * 8 AS part FROM ({_DAILY})")
def size_estimate(spark, sf_dir):
    a = daily(spark, sf_dir)
    a.attrs["_zarr_data_type"] = "float64"
    d = Dataset({"v": a})
    return spark.createDataFrame([(d.get_size_estimation("v"), d.get_size_estimation("v", {"day": {"start": 2, "stop": 9}}))], "bytes long, part long")


def _days(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("n"))


_DAYS = "SELECT o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS n FROM orders"
_D2 = "lpad({0}::VARCHAR, 2, '0')"


@query(f"SELECT o_orderkey, strftime(DATE '1990-01-01' + n::INT, '%Y-%m-%dT00:00:00') AS label FROM ({_DAYS})")
def cf_decode_proleptic(spark, sf_dir):
    return _days(spark, sf_dir).select("o_orderkey", cftime.decode_column(F.col("n"), "days since 1990-01-01", "proleptic_gregorian").alias("label"))


@query(f"SELECT o_orderkey, (1990 + n // 365)::VARCHAR || strftime(DATE '2001-01-01' + (n % 365)::INT, '-%m-%dT00:00:00') AS label FROM ({_DAYS})")
def cf_decode_noleap(spark, sf_dir):
    return _days(spark, sf_dir).select("o_orderkey", cftime.decode_column(F.col("n"), "days since 1990-01-01", "noleap").alias("label"))


@query(f"SELECT o_orderkey, (1990 + n // 360)::VARCHAR || '-' || {_D2.format('(n % 360 // 30 + 1)')} || '-' || {_D2.format('(n % 30 + 1)')} || 'T12:00:00' AS label FROM ({_DAYS})")
def cf_decode_360(spark, sf_dir):
    return _days(spark, sf_dir).select("o_orderkey", cftime.decode_column(F.col("n") + 0.5, "days since 1990-01-01", "360_day").alias("label"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01'))::BIGINT / 3600000000.0::DOUBLE AS hours FROM events")
def cf_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", cftime.encode_column(F.col("ts"), "hours since 2000-01-01").alias("hours"))


@query("SELECT min(k) AS first, max(k) AS last, count(*) AS n, round(sum(v), 2) AS total, chunk::INT AS chunk FROM (SELECT o_orderkey - min(o_orderkey) OVER () AS k, o_totalprice AS v, (o_orderkey - min(o_orderkey) OVER ()) // 4096 AS chunk FROM orders) GROUP BY chunk")
def stream_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    least, n = rows.agg(F.min("o_orderkey"), F.count("*")).first()
    a = DataArray.from_cells(rows.select((F.col("o_orderkey") - least).alias("__i_x"), F.col("o_totalprice").alias("value")), ["x"], [n])
    parts = [(c.data.original_index("x", 0), c.chunk_index, c.data.size) for c in a.sel_stream({}, chunk_size=4096 * 8 / (1 << 20))]
    # the chunks' own plans are tested; here each row is told its chunk and all are grouped once
    size = parts[0][2]
    chunk = F.call_function("div", F.col("__i_x"), F.lit(size)).cast("int")
    known = spark.createDataFrame([(k, start, size) for start, k, size in parts], "chunk int, start long, size long")
    rows = a.cells.withColumn("chunk", chunk).groupBy("chunk").agg(F.min("__i_x").alias("first"), F.max("__i_x").alias("last"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.join(F.broadcast(known), "chunk").filter("first >= start and last < start + size").select("first", "last", "n", "total", "chunk")


@query("SELECT vec_id, len(embedding)::INT AS n, 2 AS grid_rows, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, embedding[4] AS d, true AS same FROM embeddings")
def array_utils(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    first = F.slice("embedding", 1, 4)
    df = df.select("vec_id", arrays.shape_column(F.col("embedding"), 1)[0].alias("n"), first.alias("first"), arrays.reshape_column(first, [2, 2]).alias("grid"))
    cell = lambda i, j: arrays.at_column(F.col("grid"), (i, j))
    return df.select("vec_id", "n", arrays.shape_column(F.col("grid"), 2)[0].alias("grid_rows"), cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d"), arrays.flatten_column(F.col("grid"), 2).eqNullSafe(F.col("first")).alias("same"))


@query("SELECT (i - 1)::BIGINT AS component, round(avg(embedding[i]), 6) AS value FROM embeddings, range(1, 65) AS t(i) GROUP BY i")
def embedding_mean(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    n = df.agg(F.max("vec_id")).first()[0] + 1
    cells = df.select(F.col("vec_id").alias("__i_vec"), F.posexplode("embedding").alias("__i_component", "value")).withColumn("__i_component", F.col("__i_component").cast("long"))
    return _cells(DataArray.from_cells(cells, ["vec", "component"], [n, 64]).mean("vec"), "component").withColumn("value", F.round("value", 6))


def _stored(spark, sf_dir) -> Dataset:
    """The quantity cube, written as Zarr in chunks of 16 months and opened again."""
    import tempfile

    from .sources.stores import DirectoryStore
    from .sources.zarr import open_zarr, write_zarr

    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if shared and not shared.startswith(("file:", "/")):
        raise ValueError("Zarr is written to folders that are mounted; spark.checkpoint.dir names none")
    folder = tempfile.mkdtemp(prefix="cube-", dir=shared.removeprefix("file://").removeprefix("file:") or None)
    write_zarr(cube(spark, sf_dir)["quantity"], f"{folder}/quantity", (16, 3, 1), [{"name": "gzip", "configuration": {"level": 5}}])
    return open_zarr(spark, DirectoryStore(folder))


@query(f"SELECT i, j, k, coalesce(q, 'NaN'::DOUBLE) AS value FROM ({_CUBE_GRID})")
def zarr_scan(spark, sf_dir):
    return _cells(_stored(spark, sf_dir)["quantity"], "i", "j", "k")


@query(f"SELECT i - 20 AS i, k, coalesce(q, 'NaN'::DOUBLE) AS value FROM ({_CUBE_GRID}) WHERE i BETWEEN 20 AND 40 AND j = 1")
def zarr_pruned(spark, sf_dir):
    return _cells(_stored(spark, sf_dir)["quantity"].isel({"month": slice(20, 41), "flag": 1}), "i", "k")


def _asof(spark, sf_dir, method: str, tolerance: float | None = None, by: bool = False) -> DataFrame:
    """Views looked up among purchases, by time (of the same user)."""
    from .operators.asof import asof_join

    events = table(spark, sf_dir, "events")
    view = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buy = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    got = asof_join(view, buy, "ts", ["paid"], ["user_id"] if by else None, method, tolerance)
    return got.select("event_id", F.col("ts_right").cast("timestamp_ntz").alias("bought"), "paid")


_VIEWS = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v"
_BUYS = "(SELECT user_id, ts AS bought, min(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY ALL) b"
_BUYS_ALL = "(SELECT ts AS bought, min(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY ALL) b"


@query(f"SELECT event_id, bought, paid FROM {_VIEWS} ASOF LEFT JOIN {_BUYS_ALL} ON v.ts >= b.bought")
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, "ffill")


@query(f"SELECT event_id, bought, paid FROM {_VIEWS} ASOF LEFT JOIN {_BUYS_ALL} ON v.ts <= b.bought")
def asof_forward(spark, sf_dir):
    return _asof(spark, sf_dir, "bfill")


@query(f"SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(bought) <= 86400000000 THEN bought END AS bought, CASE WHEN epoch_us(ts) - epoch_us(bought) <= 86400000000 THEN paid END AS paid FROM {_VIEWS} ASOF LEFT JOIN {_BUYS} ON v.user_id = b.user_id AND v.ts >= b.bought")
def asof_grouped_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir, "ffill", 86_400_000, True)


@query(f"SELECT event_id, CASE WHEN p.bought IS NULL OR epoch_us(n.bought) - epoch_us(v.ts) < epoch_us(v.ts) - epoch_us(p.bought) THEN n.bought ELSE p.bought END AS bought, CASE WHEN p.bought IS NULL OR epoch_us(n.bought) - epoch_us(v.ts) < epoch_us(v.ts) - epoch_us(p.bought) THEN n.paid ELSE p.paid END AS paid FROM {_VIEWS} ASOF LEFT JOIN {_BUYS_ALL.replace(') b', ') p')} ON v.ts >= p.bought ASOF LEFT JOIN {_BUYS_ALL.replace(') b', ') n')} ON v.ts <= n.bought")
def asof_nearest(spark, sf_dir):
    return _asof(spark, sf_dir, "nearest")


@query(f"SELECT i, j, k, greatest(q, p / 1500) AS value FROM ({_CUBE_GRID})")
def elementwise_custom(spark, sf_dir):
    c = cube(spark, sf_dir)
    return _cells(c["quantity"].elementwise(lambda q, p: F.greatest(q, p / 1500), c["price"]), "i", "j", "k")


@query("SELECT i - 10 AS row, (i * 7 + j)::DOUBLE AS value FROM range(40) a(i), range(90) b(j) WHERE j = 81 AND i BETWEEN 10 AND 30")
def loader_scan(spark, sf_dir):
    """An array that a function makes; only blocks with wanted positions are asked for."""
    import numpy as np

    from .sources.loader import from_loader

    def load(r):
        return np.add.outer(np.array(r["row"]) * 7.0, np.array(r["col"], float))

    a = from_loader(spark, ["row", "col"], (40, 90), load, block=(16, 32))
    return _cells(a.isel({"col": 81, "row": slice(10, 31)}), "row")


@query(f"SELECT {_text_day('d')} AS day, round(CASE WHEN count(v) OVER w >= 7 THEN avg(v) OVER w END, 4) AS value FROM ({_DAILY}) WHERE event_type = 'purchase' WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def weekly_purchases(spark, sf_dir):
    """The flagship: table to array, selection, rolling mean, records."""
    a = daily(spark, sf_dir).sel({"event_type": "purchase"}).rolling("day", 7).mean()
    return _records(a).withColumn("value", F.round("value", 4))


from . import queries_more  # noqa: E402, F401  (adds its queries)
