"""Queries for cleaning, row features, folds, encodings and group statistics
(survey steps 1-2)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions import exprs as X
from foldspark.functions import recipe as R
from foldspark.operators import clean, encode, folds, groups
from foldspark.plans import fixtures as FX
from foldspark.plans.catalog import COUNTRY_SQL, fold_sql, hash_sql, query

CATS = FX.PANEL_CATEGORIES


def cleaned_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with the alias dictionary applied (the source's load-and-clean step)."""
    return clean.normalize_aliases(FX.panel(spark, sf), "country", FX.PANEL_ALIASES)


def round_doubles(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ---- oracle SQL fragments ------------------------------------------------------

P_CTE = FX.oracle_ctes(with_preds=False) + \
    f", p as (select * replace ({COUNTRY_SQL} as country) from panel)\n"

MED_COLS = ["stress", "work_hours", "bmi", "rem_pct", "deep_pct"]
PM_CTE = (", med as (select is_train, " + ", ".join(f"median({c}) as m_{c}" for c in MED_COLS)
          + " from p group by is_train)\n, pm as (select p.*, " + ", ".join(f"m_{c}" for c in MED_COLS)
          + " from p join med on p.is_train = med.is_train)\n")


def _bins_sql(c, edges):
    parts = [f"when {c} > {lo} and {c} <= {hi} then {i}" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
    return f"(case {' '.join(parts)} end)::double"


MISS = {"occupation": "occupation", "bmi": "bmi", "caffeine": "caffeine_mg", "stress": "stress",
        "chronotype": "chronotype", "mental_state": "mental_state"}
SQL_FEATURES = {
    "fe_quality_sleep_pct": "coalesce(rem_pct, 0) + coalesce(deep_pct, 0)",
    "fe_rem_deep_ratio": "rem_pct / nullif(deep_pct, 0)",
    "fe_sleep_disruption": "coalesce(latency_min, 0) * 0.5 + coalesce(awakenings, 0) * 5",
    "fe_social_jetlag": "abs(weekend_diff_h)",
    "fe_stress_x_work": "coalesce(stress, m_stress) * coalesce(work_hours, m_work_hours)",
    "fe_log_steps": "ln(1 + coalesce(steps, 0))",
    "fe_presleep_stim": "coalesce(screen_min, 0) / 60 + coalesce(caffeine_mg, 0) / 100",
    "fe_age_group": _bins_sql("age", R.AGE_EDGES),
    "fe_bmi_class": _bins_sql("bmi", R.BMI_EDGES),
    "fe_pulse_x_age": "resting_bpm * age / 100",
    **{f"fe_missing_{r}": f"({c} is null)::int" for r, c in MISS.items()},
    "fe_total_missing": "(" + " + ".join(f"({c} is null)::int" for c in MISS.values()) + ")",
    "fe_stress_x_screen": "coalesce(stress, m_stress) * coalesce(screen_min, 0) / 60",
    "fe_age_x_work": "age * coalesce(work_hours, 0)",
    "fe_bmi_x_log_steps": "coalesce(bmi, m_bmi) * ln(1 + coalesce(steps, 0))",
    "fe_awakenings_x_age": "coalesce(awakenings, 0)::double * age",
    "fe_nap_x_awakenings": "coalesce(nap_min, 0) * coalesce(awakenings, 0)",
    "fe_stress_sq": "coalesce(stress, m_stress) * coalesce(stress, m_stress)",
    "fe_rem_sq": "coalesce(rem_pct, m_rem_pct) * coalesce(rem_pct, m_rem_pct)",
    "fe_deep_sq": "coalesce(deep_pct, m_deep_pct) * coalesce(deep_pct, m_deep_pct)",
    "fe_work_sq": "coalesce(work_hours, m_work_hours) * coalesce(work_hours, m_work_hours)",
    "fe_caffeine_per_bmi": "coalesce(caffeine_mg, 0) / (coalesce(bmi, m_bmi) + 1e-3)",
    "fe_screen_per_latency": "coalesce(screen_min, 0) / (coalesce(latency_min, 0) + 1e-3)",
    "fe_steps_per_work": "coalesce(steps, 0) / (coalesce(work_hours, 0) + 1e-3)",
    "fe_stress_per_log_steps": "coalesce(stress, m_stress) / (ln(1 + coalesce(steps, 0)) + 1e-3)",
    **{f"fe_isna_{r}": f"({c} is null)::int" for r, c in
       [(r, MISS[r]) for r in R.NANFLAG_ROLES]},
    "fe_total_nan": "(" + " + ".join(f"({MISS[r]} is null)::int" for r in R.NANFLAG_ROLES) + ")",
    "fe_stress_nan_x_age": "(stress is null)::int * age",
    "fe_stress_nan_x_work": "(stress is null)::int * coalesce(work_hours, 0)",
    "fe_stress_nan_x_awakenings": "((stress is null)::int * coalesce(awakenings, 0))::double",
    "fe_stress_x_caffeine": "stress * caffeine_mg",
    "fe_stress_missing": "(stress is null)::int",
    "fe_efficiency_x_rem": "(coalesce(rem_pct, 0) + coalesce(deep_pct, 0)) * rem_pct",
}
INT_FEATURES = {n for n in SQL_FEATURES if n.startswith(("fe_missing_", "fe_isna_"))} | {
    "fe_total_missing", "fe_total_nan", "fe_stress_nan_x_age", "fe_stress_missing"}


def _sel(names, digits=8):
    return ", ".join(SQL_FEATURES[n] + f" as {n}" if n in INT_FEATURES
                     else f"round({SQL_FEATURES[n]}, {digits}) as {n}" for n in names)


def _features_oracle(names, where: str = "") -> str:
    return P_CTE + PM_CTE + f"select id, {_sel(names)} from pm {where}"


# ---- step 1: cleaning and categories ---------------------------------------------

@query("alias_normalize", P_CTE + "select id, country from p", "P1, P2")
def q_alias_normalize(spark, sf):
    """Alias dictionary applied to the country column; null stays null."""
    return cleaned_panel(spark, sf).select("id", "country")


_ALIGN_SQL = P_CTE + "select id, " + ", ".join(
    f"case when {c} in (select {c} from p where is_train) then {c} end as {c}" for c in CATS) + " from p"


@query("category_align", _ALIGN_SQL, "P3")
def q_category_align(spark, sf):
    """Category levels aligned to the train dictionary; test-only levels -> null."""
    return clean.align_categories(cleaned_panel(spark, sf), CATS).select("id", *CATS)


_CODES_SQL = P_CTE + ", d as (" + " union all ".join(
    f"select '{c}' as col, {c} as level, (dense_rank() over (order by {c}) - 1)::int as code "
    f"from (select distinct {c} from p where is_train and {c} is not null)" for c in CATS) + ")\n" + \
    "select id, " + ", ".join(f"(select code from d where col = '{c}' and level = p.{c}) as {c}_code"
                               for c in CATS) + " from p"


@query("category_codes", _CODES_SQL, "P4")
def q_category_codes(spark, sf):
    """Integer code = rank of the sorted train level; missing/unseen -> null."""
    out = clean.category_codes(cleaned_panel(spark, sf), CATS, suffix="_code")
    return out.select("id", *[f"{c}_code" for c in CATS])


@query("unseen_levels", P_CTE + "select distinct col, level from (" + " union all ".join(
    f"select '{c}' as col, {c} as level from p where not is_train and {c} is not null "
    f"and {c} not in (select {c} from p where is_train and {c} is not null)" for c in CATS) + ")", "U3")
def q_unseen_levels(spark, sf):
    """(column, level) pairs of test rows that train rows never show (left-anti)."""
    return clean.unseen_levels(cleaned_panel(spark, sf), CATS)


_COMPOSITE = ["gender", "occupation", "country", "mental_state", "season", "day_type"]


@query("composite_category", P_CTE + "select id, concat_ws('_', " + ", ".join(
    f"coalesce({c}, 'MISSING')" for c in _COMPOSITE) + ") as mega_cat, "
    + ", ".join(f"coalesce({c}, 'missing') as {c}_lvl" for c in CATS) + " from p", "F44, P5")
def q_composite_category(spark, sf):
    """F44 composite key (null -> 'MISSING', joined by '_') and P5 missing-as-level."""
    p = cleaned_panel(spark, sf)
    levels = [f"{c}_lvl" for c in CATS]
    return clean.missing_as_level(p.select("id", R.composite_category(_COMPOSITE).alias("mega_cat"),
                                           *[F.col(c).alias(n) for c, n in zip(CATS, levels)]), levels)


# ---- step 1: row features ---------------------------------------------------------

def _reg_features(name, feats, ids, doc):
    def build(spark, sf):
        p = cleaned_panel(spark, sf)
        return round_doubles(R.apply(p, feats, keep=True).select("id", *R.feature_names(feats)))
    build.__doc__ = doc
    query(name, _features_oracle(R.feature_names(feats)), ids)(build)


_reg_features("features_v1", R.V1, "F1-F10, FV1",
              "v1 row features (sleep, lifestyle, demographic) with own-split medians.")
_reg_features("missing_flags", R.MISSING, "F11-F17", "Six missing flags and their row total.")
_reg_features("interactions", R.INTERACTION, "F18-F22", "Interaction features, medians of own split.")
_reg_features("squares", R.POLYNOMIAL, "F23-F26", "Squares of median-filled columns.")
_reg_features("ratios", R.RATIO, "F27-F30", "Ratio features with epsilon guards.")
_NANFLAG_FEATS = R.NANFLAG + R.NOTEBOOK + [R.product_feature("fe_efficiency_x_rem", "fe_quality_sleep_pct", "rem")]


@query("nanflag_interactions", _features_oracle(R.feature_names(_NANFLAG_FEATS)), "F31-F43")
def q_nanflag_interactions(spark, sf):
    """Second flag family, stress-missing interactions and notebook products (F41 over a derived column)."""
    p = R.apply(cleaned_panel(spark, sf), [R.SLEEP[0]], keep=True)
    return round_doubles(R.apply(p, _NANFLAG_FEATS, keep=True).select("id", *R.feature_names(_NANFLAG_FEATS)))


@query("age_bmi_bins", P_CTE + f"select id, age, {_bins_sql('age', R.AGE_EDGES)} as fe_age_group, "
       f"round(bmi, 8) as bmi, {_bins_sql('bmi', R.BMI_EDGES)} as fe_bmi_class from p", "F8, F9")
def q_age_bmi_bins(spark, sf):
    """Right-closed age and BMI bins; values outside the edges -> null."""
    p = cleaned_panel(spark, sf)
    return round_doubles(R.apply(p, R.DEMOGRAPHIC[:2], keep=True)
                         .select("id", "age", "fe_age_group", "bmi", "fe_bmi_class"))


@query("own_median_fill", P_CTE + PM_CTE + "select id, is_train, " + ", ".join(
    f"round(coalesce({c}, m_{c}), 8) as {c}_med" for c in MED_COLS)
    + ", round(coalesce(caffeine_mg, 0), 8) as caffeine_mg_0 from pm", "P8, P9")
def q_own_median_fill(spark, sf):
    """P9 median fill with the row's own split median; P8 constant fill."""
    p = R.attach_medians(cleaned_panel(spark, sf), MED_COLS, scope="split")
    return round_doubles(p.select("id", "is_train", *[
        F.coalesce(F.col(c), F.col(R.median_col(c))).alias(f"{c}_med") for c in MED_COLS],
        X.fill0("caffeine_mg").alias("caffeine_mg_0")))


# ---- step 2: folds ---------------------------------------------------------------

@query("kfold_hash", P_CTE + f"select id, is_train, {fold_sql()}::int as fold from p", "K1")
def q_kfold_hash(spark, sf):
    """K1: shuffled 5-fold assignment from a seeded hash of the id."""
    return folds.hash_folds(cleaned_panel(spark, sf), 5, 42).select("id", "is_train", "fold")


@query("kfold_balanced", P_CTE + f"select id, ((row_number() over (order by {hash_sql()}, id) - 1) % 5)::int "
       "as fold from p where is_train", "K1b")
def q_kfold_balanced(spark, sf):
    """5 folds whose sizes differ by at most one (distributed global rank)."""
    tr = cleaned_panel(spark, sf).where("is_train")
    return folds.balanced_folds(tr, 5, 42).select("id", "fold")


@query("kfold_stratified", P_CTE + ", c as (select id, greatest(0, least(10, round_even(target, 0)))::int "
       "as cls from p where is_train)\n"
       f"select id, cls, ((row_number() over (partition by cls order by {hash_sql()}, id) - 1) % 5)::int "
       "as fold from c", "K2, F45")
def q_kfold_stratified(spark, sf):
    """K2: folds stratified on the integer class of the target."""
    tr = cleaned_panel(spark, sf).where("is_train").withColumn("cls", X.int_class("target"))
    return folds.stratified_folds(tr, "cls", 5, 42).select("id", "cls", "fold")


_SEEDS = [42, 123, 456, 789, 2024]


@query("kfold_multi_seed", P_CTE + "select id, seed, ((('0x'||substr(md5(id::varchar||':'||seed::varchar),1,8))"
       "::BIGINT) % 5)::int as fold from p, (values (42), (123), (456), (789), (2024)) s(seed) where is_train",
       "K3")
def q_kfold_multi_seed(spark, sf):
    """K3: one hash fold per (row, seed) for five seeds."""
    tr = cleaned_panel(spark, sf).where("is_train")
    return folds.multi_seed_folds(tr, _SEEDS, 5).select("id", "seed", "fold")


@query("seeded_sample", P_CTE + ", smp as (select * from p where is_train order by "
       f"{hash_sql(7)}, id limit 5000) select id, round(stress, 8) as stress from smp where "
       + " and ".join(f"{c} is not null" for c in FX.PANEL_NUMERIC), "P12, P13")
def q_seeded_sample(spark, sf):
    """P13 + P12: a repeatable sample of 5,000 train rows, then rows with a null in any
    numeric column dropped."""
    p = clean.seeded_sample(cleaned_panel(spark, sf).where("is_train"), 5000, 7)
    return round_doubles(clean.drop_null_rows(p, FX.PANEL_NUMERIC).select("id", "stress"))


# ---- step 2: target encoding -------------------------------------------------------

TE_COLS = ["country", "occupation", "chronotype", "mental_state"]


def _te_oracle_cte(cols, smoothing, key_sql=None):
    """Encodings by aggregate subtraction, written independently in SQL."""
    parts = []
    for c in cols:
        kc = key_sql or c
        parts.append(
            f", s_{c} as (select {kc} as level, {fold_sql()} as fold, sum(target) as s, count(*) as n "
            f"from p where is_train and {kc} is not null group by all)"
            f", t_{c} as (select level, sum(s) as S, sum(n) as N from s_{c} group by level)"
            f", e_{c} as (select s.level, s.fold, (t.S - s.s + {smoothing} * g.gm) / (t.N - s.n + {smoothing}) as enc "
            f"from s_{c} s join t_{c} t on s.level = t.level, g)"
            f", f_{c} as (select level, (S + {smoothing} * g.gm) / (N + {smoothing}) as enc from t_{c}, g)")
    return ", g as (select avg(target) as gm from p where is_train)\n" + "\n".join(parts) + "\n"


def _te_oracle(split: str) -> str:
    sel = []
    joins = []
    for c in TE_COLS:
        if split == "train":
            joins.append(f"left join e_{c} on e_{c}.level = p.{c} and e_{c}.fold = {fold_sql(id_col='p.id')}")
        else:
            joins.append(f"left join f_{c} on f_{c}.level = p.{c}")
        sel.append(f"round(coalesce({'e' if split == 'train' else 'f'}_{c}.enc, g.gm), 8) as fe_te_{c}")
    cond = "p.is_train" if split == "train" else "not p.is_train"
    extra = f", {fold_sql(id_col='p.id')}::int as fold" if split == "train" else ""
    return (P_CTE + _te_oracle_cte(TE_COLS, 10) + f"select p.id{extra}, " + ", ".join(sel)
            + " from p cross join g " + " ".join(joins) + f" where {cond}")


def _te_frame(spark, sf):
    p = folds.hash_folds(cleaned_panel(spark, sf), 5, 42)
    return encode.target_encode(p, TE_COLS, smoothing=10.0)


@query("target_encode_oof", _te_oracle("train"), "E1, E3, J2")
def q_target_encode_oof(spark, sf):
    """Out-of-fold smoothed target encoding (m=10) of four categories, train rows."""
    out = _te_frame(spark, sf).where("is_train")
    return round_doubles(out.select("id", "fold", *[f"fe_te_{c}" for c in TE_COLS]))


@query("target_encode_test", _te_oracle("test"), "E1, E3, J2")
def q_target_encode_test(spark, sf):
    """Test rows encoded with all train rows; unseen/null -> global mean."""
    out = _te_frame(spark, sf).where(~F.col("is_train"))
    return round_doubles(out.select("id", *[f"fe_te_{c}" for c in TE_COLS]))


_MEGA_SQL = "concat_ws('_', " + ", ".join(f"coalesce({c}, 'MISSING')" for c in _COMPOSITE) + ")"
_COMPOSITE_ORACLE = (P_CTE + ", p2 as (select *, " + _MEGA_SQL + " as mega_cat from p)"
                     + _te_oracle_cte(["mega_cat"], 20).replace(" from p ", " from p2 ")
                     .replace("from p where is_train)", "from p where is_train)")
                     + f"select p2.id, p2.is_train, round(case when p2.is_train then coalesce(e_mega_cat.enc, g.gm) "
                     f"else coalesce(f_mega_cat.enc, g.gm) end, 8) as fe_te_mega_cat from p2 cross join g "
                     f"left join e_mega_cat on e_mega_cat.level = p2.mega_cat and e_mega_cat.fold = "
                     f"{fold_sql(id_col='p2.id')} left join f_mega_cat on f_mega_cat.level = p2.mega_cat")


@query("target_encode_composite", _COMPOSITE_ORACLE, "E2, F44")
def q_target_encode_composite(spark, sf):
    """Composite category of six columns, out-of-fold encoded with m=20."""
    p = folds.hash_folds(cleaned_panel(spark, sf), 5, 42).withColumn(
        "mega_cat", R.composite_category(_COMPOSITE))
    out = encode.target_encode(p, ["mega_cat"], smoothing=20.0)
    return round_doubles(out.select("id", "is_train", "fe_te_mega_cat"))


# ---- step 2: group statistics ------------------------------------------------------

G_COLS = groups.DEFAULT_GROUP_COLS
A_COLS = groups.DEFAULT_AGG_COLS

_GSTATS_SQL = P_CTE + " union all ".join(
    f"select '{g}' as group_col, {g} as level, " + ", ".join(
        f"round(avg({a}), 6) as {a}_mean, round(stddev_samp({a}), 6) as {a}_std, count({a}) as {a}_n"
        for a in A_COLS) + f" from p where is_train and {g} is not null group by {g}" for g in G_COLS)


@query("group_stats", _GSTATS_SQL, "G1")
def q_group_stats(spark, sf):
    """G1: mean / sample std / count of five columns per level of three group columns (train rows)."""
    st = groups.group_stats(cleaned_panel(spark, sf), G_COLS, A_COLS)
    return round_doubles(st, 6)


def _gdev_sql():
    ctes = []
    sel = []
    joins = []
    for g in G_COLS:
        ctes.append(f"gs_{g} as (select {g} as lv, " + ", ".join(
            f"avg({a}) as m_{a}, stddev_samp({a}) as s_{a}" for a in A_COLS)
            + f" from p where is_train and {g} is not null group by {g})")
        joins.append(f"left join gs_{g} on gs_{g}.lv = p.{g}")
        for a in A_COLS:
            sel += [f"round(gs_{g}.m_{a}, 8) as fe_grp_{g}_{a}_mean", f"round(gs_{g}.s_{a}, 8) as fe_grp_{g}_{a}_std",
                    f"round(p.{a} - gs_{g}.m_{a}, 8) as fe_grp_{g}_{a}_dev"]
    return P_CTE + ", " + ", ".join(ctes) + "\nselect p.id, " + ", ".join(sel) + " from p " + " ".join(joins)


GDEV_COLS = [groups.stats_name(g, a, s) for g in G_COLS for a in A_COLS for s in ("mean", "std", "dev")]


@query("group_deviation", _gdev_sql(), "G1, J1")
def q_group_deviation(spark, sf):
    """G1 + J1: 45 group features (mean, std, deviation) joined onto every row."""
    out = groups.add_group_statistics(cleaned_panel(spark, sf), G_COLS, A_COLS)
    return round_doubles(out.select("id", *GDEV_COLS))


def features_v2(spark, sf) -> DataFrame:
    """FV2: v2 row features + group statistics + out-of-fold target encoding.
    Both statistics tables are fitted on the narrow cleaned table, then applied
    to the wide feature rows (broadcast joins, no shuffle of wide rows)."""
    base = folds.hash_folds(cleaned_panel(spark, sf), 5, 42)
    gstats, small = groups.fit_group_statistics(base, G_COLS, A_COLS)
    te = encode.fit_target_encoding(base, TE_COLS, smoothing=10.0)
    wide = R.features_v2_rows(base)
    wide = groups.apply_group_statistics(wide, gstats, small, G_COLS, A_COLS)
    return encode.apply_target_encoding(wide, te)


V2_ROW_NAMES = R.feature_names(R.V2_ROW)


def _fv2_sql():
    base = _gdev_sql()
    head, tail = base.split("\nselect p.id, ", 1)
    ctes = head + "\n" + PM_CTE.replace(", med as", ", med as", 1) + _te_oracle_cte(TE_COLS, 10)
    def q(e):
        for c in MED_COLS:
            e = e.replace(f"m_{c}", f"p.m_{c}")
        return e
    sel = [f"round({q(SQL_FEATURES[n])}, 8) as {n}" if n not in INT_FEATURES
           else SQL_FEATURES[n] + f" as {n}" for n in V2_ROW_NAMES]
    te_sel = []
    te_join = []
    for c in TE_COLS:
        te_join.append(f"left join e_{c} on e_{c}.level = p.{c} and e_{c}.fold = {fold_sql(id_col='p.id')} "
                       f"left join f_{c} on f_{c}.level = p.{c}")
        te_sel.append(f"round(case when p.is_train then coalesce(e_{c}.enc, g.gm) else coalesce(f_{c}.enc, g.gm) end, 8)"
                      f" as fe_te_{c}")
    gsel, gjoin = tail.split(" from p ", 1)
    # feature expressions reference unqualified input columns: evaluate over pm (p + medians)
    return (ctes + "select p.id, " + ", ".join(sel) + ", " + gsel + ", " + ", ".join(te_sel)
            + " from pm p cross join g " + gjoin + " " + " ".join(te_join))


@query("features_v2", _fv2_sql(), "FV2, F1-F30, G1, E1")
def q_features_v2(spark, sf):
    """FV2: the full v2 feature table (row features, 45 group features, 4 encodings)."""
    out = features_v2(spark, sf)
    return round_doubles(out.select("id", *V2_ROW_NAMES, *GDEV_COLS, *[f"fe_te_{c}" for c in TE_COLS]))
