"""Stand-in inputs built from the driver tables.

``panel`` is the labelled/unlabelled feature table (one row per order,
``is_train`` marks the 70 % labelled part); ``preds`` holds three model outputs
per panel row. The SQL text is shared by Spark and the DuckDB oracle, so both
engines see identical inputs. These builders only shape rows into the schema
the operators expect; all operator work happens in ``foldspark.operators``.
``panel`` is written once per application as parquet under the session's
checkpoint directory and read back (``materialize=False`` returns the plain plan).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldspark.sources.tables import register

PANEL_SQL = """
select o_orderkey as id, (o_orderkey % 10) < 7 as is_train,
 cast(18 + c_custkey % 60 as int) as age,
 case when o_orderkey % 17 = 0 then null else 15 + (c_acctbal + 1000) / 4.4e2 end as bmi,
 10 + 200 * li.d as rem_pct,
 case when o_orderkey % 31 = 0 then 0e0 else 100 * li.t end as deep_pct,
 li.q as latency_min,
 cast(coalesce(li.n, 0) as int) as awakenings,
 case when o_orderkey % 13 = 0 then null else cast((o_orderkey * 37) % 400 as double) end as caffeine_mg,
 cast((o_orderkey * 53) % 240 as double) as screen_min,
 cast((o_orderkey * 6151) % 20000 as double) as steps,
 cast(o_custkey % 90 as double) as nap_min,
 case when o_orderkey % 11 = 0 then null else cast(floor(o_totalprice / 5e4) as double) end as stress,
 cast(4 + o_custkey % 9 as double) as work_hours,
 cast(50 + o_orderkey % 50 as int) as resting_bpm,
 16 + (o_orderkey % 100) / 1e1 as room_temp_c,
 cast(o_orderkey % 9 - 4 as double) as weekend_diff_h,
 case c_custkey % 3 when 0 then 'F' when 1 then 'M' else 'X' end as gender,
 case when c_custkey % 19 = 0 then null else c_mktsegment end as occupation,
 case when n_name = 'NATION_1' and o_orderkey % 2 = 0 then 'NATION_1_ALT'
      when n_name = 'NATION_2' and o_orderkey % 2 = 0 then 'NATION_2_ALT' else n_name end as country,
 case when o_orderkey % 23 = 0 then null else o_orderpriority end as chronotype,
 case when o_orderkey % 29 = 0 then null else o_orderstatus end as mental_state,
 concat('Q', cast(extract(quarter from o_orderdate) as {S})) as season,
 case when extract(day from o_orderdate) % 7 < 2 then 'weekend' else 'weekday' end as day_type,
 6e-1 * (o_totalprice / 5e4) + 3e-1 * ((c_acctbal + 1000) / 1.1e3) + ((o_orderkey * 7919) % 1000) / 1e3 as target
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
left join (select l_orderkey as k, count(*) as n, avg(l_discount) as d, avg(l_tax) as t, avg(l_quantity) as q
           from lineitem group by l_orderkey) li on li.k = o_orderkey
"""

PREDS_SQL = """
select id, is_train, target,
 8e-1 * target + 5e-1 + ((id * 31) % 100) / 1e2 as p_a,
 9e-1 * target + ((id * 17) % 200) / 1e2 - 5e-1 as p_b,
 7e-1 * target + 1e0  + ((id * 13) % 50)  / 5e1 as p_c
from panel
"""

# long form: one row per (id, model, seed); per-seed offset ((id * seed) % 7) / 1e2
PREDS_LONG_SQL = """
select p.id, p.is_train, p.target, m.model, s.seed,
 case m.model when 'a' then p.p_a when 'b' then p.p_b else p.p_c end
   + ((p.id * s.seed) % 7) / 1e2 as pred
from preds p
cross join (values ('a'), ('b'), ('c')) m(model)
cross join (values (42), (123), (456), (789), (2024)) s(seed)
"""

# unmodified alias of the country column used by the panel
PANEL_ALIASES = {"NATION_1_ALT": "NATION_1", "NATION_2_ALT": "NATION_2"}

PANEL_CATEGORIES = ["gender", "occupation", "country", "chronotype", "mental_state",
                    "season", "day_type"]
PANEL_NUMERIC = ["age", "bmi", "rem_pct", "deep_pct", "latency_min", "awakenings",
                 "caffeine_mg", "screen_min", "steps", "nap_min", "stress", "work_hours",
                 "resting_bpm", "room_temp_c", "weekend_diff_h"]
PANEL_MISSING = ["occupation", "bmi", "caffeine_mg", "stress", "chronotype", "mental_state"]


_TABLES: dict = {}


def _materialized(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """The stand-in table written once per application as parquet under the
    session's checkpoint directory (a shared folder on a cluster) and read back,
    so operators that scan their input several times read a table, as they would
    in production, instead of re-running the fixture joins."""
    import hashlib
    import os

    from foldspark.session import ensure_checkpoint_dir
    app = spark.sparkContext.applicationId
    key = (app, name, os.path.abspath(sf_dir))
    if key not in _TABLES:
        root = ensure_checkpoint_dir(spark).rstrip("/")
        tag = hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        path = f"{root}/foldspark-fixtures/{app}/{name}_{tag}"
        build().write.mode("overwrite").parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def panel(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    def build():
        register(spark, sf_dir, ("orders", "customer", "nation", "lineitem"))
        return spark.sql(PANEL_SQL.replace("{S}", "string"))
    return _materialized(spark, "panel", sf_dir, build) if materialize else build()


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel(spark, sf_dir).createOrReplaceTempView("panel")
    return spark.sql(PREDS_SQL)


def preds_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivoted predictions, five seeds per model (the seed column is a small
    literal generator, not a join of data tables)."""
    p = preds(spark, sf_dir)
    from pyspark.sql import functions as F
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p"))
                                 for m in ("a", "b", "c")]))
    seeds = F.explode(F.array(*[F.lit(s) for s in (42, 123, 456, 789, 2024)]))
    return (p.select("id", "is_train", "target", models.alias("m"))
             .select("id", "is_train", "target", "m.model", "m.p", seeds.alias("seed"))
             .select("id", "is_train", "target", "model", "seed",
                     (F.col("p") + F.pmod(F.col("id") * F.col("seed"), F.lit(7)) / F.lit(1e2)).alias("pred")))


def oracle_ctes(with_preds: bool = True, with_long: bool = False) -> str:
    """CTE prefix for DuckDB oracle text."""
    parts = [f"panel as ({PANEL_SQL.replace('{S}', 'varchar')})"]
    if with_preds or with_long:
        parts.append(f"preds as ({PREDS_SQL})")
    if with_long:
        parts.append(f"preds_long as ({PREDS_LONG_SQL})")
    return "with " + ",\n".join(parts) + "\n"
