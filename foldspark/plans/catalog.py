"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame (statistics and fits run while it is built). Oracle text is an
independent SQL formulation over the same driver tables (the fixture CTEs are
shared text). Float outputs are rounded on both sides (8 digits for row values,
6 for aggregates), since float sums depend on evaluation order.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str = ""
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, ids: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, ids, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # import for registration side effects
    from foldspark.plans import (q_prep, q_metrics, q_blend, q_calibrate,  # noqa: F401
                                 q_models, q_checks, q_oracles)
    return REGISTRY


# ---- SQL fragments shared by oracle texts ------------------------------------

def fold_sql(seed: int = 42, k: int = 5, id_col: str = "id") -> str:
    return f"((('0x'||substr(md5({id_col}::varchar||':{seed}'),1,8))::BIGINT) % {k})"


def hash_sql(seed: int = 42, id_col: str = "id") -> str:
    return f"(('0x'||substr(md5({id_col}::varchar||':{seed}'),1,8))::BIGINT)"


COUNTRY_SQL = ("case country when 'NATION_1_ALT' then 'NATION_1' "
               "when 'NATION_2_ALT' then 'NATION_2' else country end")
