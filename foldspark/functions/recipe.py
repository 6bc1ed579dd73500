"""Feature recipe: the row features as data.

Each ``Feature`` is a named column expression over *roles* (logical inputs such
as ``stress`` or ``steps``); a role map binds roles to real column names, so the
recipe is not tied to one schema. Features that use a median-filled input
declare it; ``apply`` computes all needed medians in one aggregate, attaches
them with a join on the split column (a table with one row per split, so the
join is a broadcast of a bounded table) and evaluates every feature in one
projection.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions import exprs as X
from foldspark.functions import quantiles as Q
from foldspark.operators.joins import lookup

# Default binding of roles to the panel's columns.
DEFAULT_ROLES = {
    "age": "age", "bmi": "bmi", "rem": "rem_pct", "deep": "deep_pct",
    "latency": "latency_min", "awakenings": "awakenings", "caffeine": "caffeine_mg",
    "screen": "screen_min", "steps": "steps", "nap": "nap_min", "stress": "stress",
    "work": "work_hours", "bpm": "resting_bpm", "room_temp": "room_temp_c",
    "weekend_diff": "weekend_diff_h", "gender": "gender", "occupation": "occupation",
    "country": "country", "chronotype": "chronotype", "mental_state": "mental_state",
    "season": "season", "day_type": "day_type", "target": "target",
}

# Fixed values of the source recipe: bin edges, constants and column groups.
AGE_EDGES = [0, 25, 35, 45, 55, 100]
BMI_EDGES = [0, 18.5, 25, 30, 100]
RATIO_EPS = 1e-3
MISSING_ROLES = ["occupation", "bmi", "caffeine", "stress", "chronotype", "mental_state"]
NANFLAG_ROLES = ["stress", "mental_state", "occupation", "bmi", "caffeine", "chronotype"]
COMPOSITE_ROLES = ["gender", "occupation", "country", "mental_state", "season", "day_type"]


class Ctx:
    """Accessors handed to feature builders."""

    def __init__(self, roles: dict):
        self.roles = roles

    def name(self, role: str) -> str:
        return self.roles.get(role, role)

    def c(self, role: str) -> Column:
        return F.col(self.name(role))

    def z(self, role: str) -> Column:
        """0-filled."""
        return X.fill0(self.name(role))

    def m(self, role: str) -> Column:
        """Median-filled (median of the scope chosen in ``apply``)."""
        n = self.name(role)
        return F.coalesce(F.col(n).cast("double"), F.col(median_col(n)))


def median_col(name: str) -> str:
    return f"__median_{name}"


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    build: Callable[[Ctx], Column]
    medians: tuple = ()


def _f(name, group, build, medians=()):
    return Feature(name, group, build, tuple(medians))


SLEEP = [
    _f("fe_quality_sleep_pct", "sleep", lambda x: x.z("rem") + x.z("deep")),
    _f("fe_rem_deep_ratio", "sleep", lambda x: X.safe_div(x.c("rem"), x.c("deep"))),
    _f("fe_sleep_disruption", "sleep", lambda x: x.z("latency") * 0.5 + x.z("awakenings") * 5),
    _f("fe_social_jetlag", "sleep", lambda x: F.abs(x.c("weekend_diff"))),
]
LIFESTYLE = [
    _f("fe_stress_x_work", "lifestyle", lambda x: x.m("stress") * x.m("work"), ["stress", "work"]),
    _f("fe_log_steps", "lifestyle", lambda x: F.log1p(x.z("steps"))),
    _f("fe_presleep_stim", "lifestyle", lambda x: x.z("screen") / 60.0 + x.z("caffeine") / 100.0),
]
DEMOGRAPHIC = [
    _f("fe_age_group", "demographic",
       lambda x: X.right_closed_bins(x.c("age"), AGE_EDGES).cast("double")),
    _f("fe_bmi_class", "demographic",
       lambda x: X.right_closed_bins(x.c("bmi"), BMI_EDGES).cast("double")),
    _f("fe_pulse_x_age", "demographic", lambda x: x.c("bpm") * x.c("age") / 100.0),
]


def _missing_flags(prefix: str, roles: Sequence[str], total: str, group: str):
    feats = [_f(f"{prefix}{r}", group, (lambda rr: lambda x: X.is_missing(x.name(rr)))(r))
             for r in roles]
    feats.append(_f(total, group, lambda x: sum((X.is_missing(x.name(r)) for r in roles),
                                                F.lit(0)).cast("int")))
    return feats


MISSING = _missing_flags("fe_missing_", MISSING_ROLES, "fe_total_missing", "missing")
INTERACTION = [
    _f("fe_stress_x_screen", "interaction", lambda x: x.m("stress") * x.z("screen") / 60.0, ["stress"]),
    _f("fe_age_x_work", "interaction", lambda x: x.c("age") * x.z("work")),
    _f("fe_bmi_x_log_steps", "interaction", lambda x: x.m("bmi") * F.log1p(x.z("steps")), ["bmi"]),
    _f("fe_awakenings_x_age", "interaction", lambda x: x.z("awakenings") * x.c("age")),
    _f("fe_nap_x_awakenings", "interaction", lambda x: x.z("nap") * x.z("awakenings")),
]
POLYNOMIAL = [
    _f(f"fe_{r}_sq", "polynomial", (lambda rr: lambda x: x.m(rr) * x.m(rr))(r), [r])
    for r in ("stress", "rem", "deep", "work")
]
RATIO = [
    _f("fe_caffeine_per_bmi", "ratio", lambda x: x.z("caffeine") / (x.m("bmi") + RATIO_EPS), ["bmi"]),
    _f("fe_screen_per_latency", "ratio", lambda x: x.z("screen") / (x.z("latency") + RATIO_EPS)),
    _f("fe_steps_per_work", "ratio", lambda x: x.z("steps") / (x.z("work") + RATIO_EPS)),
    _f("fe_stress_per_log_steps", "ratio",
       lambda x: x.m("stress") / (F.log1p(x.z("steps")) + RATIO_EPS), ["stress"]),
]
NANFLAG = _missing_flags("fe_isna_", NANFLAG_ROLES, "fe_total_nan", "nanflag") + [
    _f("fe_stress_nan_x_age", "nanflag", lambda x: X.is_missing(x.name("stress")) * x.c("age")),
    _f("fe_stress_nan_x_work", "nanflag", lambda x: X.is_missing(x.name("stress")) * x.z("work")),
    _f("fe_stress_nan_x_awakenings", "nanflag",
       lambda x: X.is_missing(x.name("stress")) * x.z("awakenings")),
]
NOTEBOOK = [
    _f("fe_stress_x_caffeine", "notebook", lambda x: x.c("stress") * x.c("caffeine")),
    _f("fe_stress_missing", "notebook", lambda x: X.is_missing(x.name("stress"))),
]

V1 = SLEEP + LIFESTYLE + DEMOGRAPHIC
V2_ROW = V1 + MISSING + INTERACTION + POLYNOMIAL + RATIO
GROUPS = {"sleep": SLEEP, "lifestyle": LIFESTYLE, "demographic": DEMOGRAPHIC,
          "missing": MISSING, "interaction": INTERACTION, "polynomial": POLYNOMIAL,
          "ratio": RATIO, "nanflag": NANFLAG, "notebook": NOTEBOOK}


def product_feature(name: str, a: str, b: str) -> Feature:
    """Generic null-propagating product of two columns (roles or names)."""
    return _f(name, "product", lambda x: x.c(a) * x.c(b))


def composite_category(cols: Sequence[str], missing: str = "MISSING", sep: str = "_") -> Column:
    """Join several category columns into one key; null parts become ``missing``."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in cols])


def attach_medians(df: DataFrame, cols: Iterable[str], scope: str = "split",
                   split_col: str = "is_train") -> DataFrame:
    """Add ``__median_<c>`` columns.

    scope="split": median of the row's own split (the source computes train
    and test medians separately); scope="train": train medians for all rows;
    scope="all": one median over every row.
    The statistics have one row per split value: they are collected (bounded)
    and attached as literals keyed by the split value, so no join is needed.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        return df
    src = df.where(F.col(split_col)) if scope == "train" else df
    keys = [split_col] if scope == "split" else []
    rows = Q.column_quantiles(src, {c: F.col(c) for c in cols}, keys).collect()
    if scope == "split":
        out = [lookup([(r[split_col], r["q0"]) for r in rows if r["col"] == c and r[split_col] is not None],
                      F.col(split_col), "double").alias(median_col(c)) for c in cols]
        return df.select("*", *out)
    got = {r["col"]: r["q0"] for r in rows}
    return df.select("*", *[F.lit(got.get(c)).cast("double").alias(median_col(c)) for c in cols])


def apply(df: DataFrame, features: Sequence[Feature], roles: dict | None = None,
          median_scope: str = "split", split_col: str = "is_train",
          keep: bool = True) -> DataFrame:
    """Evaluate features in one projection (``keep``: also keep input columns)."""
    ctx = Ctx({**DEFAULT_ROLES, **(roles or {})})
    need = [ctx.name(r) for f in features for r in f.medians]
    base = attach_medians(df, need, median_scope, split_col)
    out = [F.col(c) for c in df.columns] if keep else []
    out += [f.build(ctx).alias(f.name) for f in features]
    return base.select(*out)


def feature_names(features: Sequence[Feature]) -> list[str]:
    return [f.name for f in features]


def adder(group: str) -> Callable[..., DataFrame]:
    """``add_<group>(df, **kw)`` for ``DataFrame.transform`` chains."""
    feats = GROUPS[group]

    def add(df: DataFrame, **kw) -> DataFrame:
        return apply(df, feats, **kw)

    add.__name__ = f"add_{group}"
    return add


add_sleep = adder("sleep")
add_lifestyle = adder("lifestyle")
add_demographic = adder("demographic")
add_missing_indicators = adder("missing")
add_interaction = adder("interaction")
add_polynomial = adder("polynomial")
add_ratio = adder("ratio")
add_nanflags = adder("nanflag")


def features_v1(df: DataFrame, **kw) -> DataFrame:
    return apply(df, V1, **kw)


def features_v2_rows(df: DataFrame, **kw) -> DataFrame:
    """v1 plus missing flags, interactions, squares and ratios (no group stats)."""
    return apply(df, V2_ROW, **kw)
