"""Queries over the given tables for the library's operators, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.lineage import cut, shared_folder, stored
from ..operators import affinity, analytics, annotate, groups, impute, ingest, network, ontology, score_counts, score_intensity, scoring, validate, wd
from ..sources import readers, writers
from . import pipeline, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **named: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL over the views' CTEs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"with recursive {views.SQL.strip()}{sql}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.interactions(spark, sf).select("experiment", "prey", F.col("spc").alias("value"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return views.interactions(spark, sf).select("experiment", "prey", F.col("intensity").alias("value"))


def scored_view(spark: SparkSession, sf: str) -> DataFrame:
    """Test pairs with stand-in scores of their counts, known flags and bfdr: input of the analytics queries."""
    design = views.design(spark, sf)
    test = F.broadcast(design.where("type = 'T'").select("experiment", "bait_id"))
    rows = views.interactions(spark, sf).join(test, "experiment").groupBy("bait", "bait_id", "prey").agg(F.sum("spc").alias("s"))
    rows = rows.withColumn("score", F.round(F.col("s") / (F.col("s") + 60), 2)).withColumn("wd", F.round(F.sqrt("s"), 3)).withColumn("wd_fdr", F.when(F.col("s") % 7 != 0, F.round(1 / (1 + F.col("s")), 4)))
    known = views.known_of(spark, sf, design.select(F.col("bait_id").alias("pb"))).select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("n") >= 2).alias("multivalidated"))
    rows = annotate.join_known(rows.withColumn("first_id", text.first_item(F.col("prey"))), known)
    return stats.tail_fdr(stored(rows), "score")


SCORED = """,
sc0 as (select bait, 'P' || substr(bait, 2) bait_id, i.prey, sum(spc) s from inter i join ed using (experiment, bait) where "type" = 'T' group by 1, 2, 3),
sc1 as (select *, prey first_id, round(s / (s + 60), 2) score, round(sqrt(s), 3) wd, case when s % 7 <> 0 then round(1 / (1 + s), 4) end wd_fdr from sc0),
scv as (select score, count(*) n from sc1 group by 1),
scf as (select score, coalesce(least(1, greatest(0, 1 - sum(score * n) over w / sum(n) over w)), 0) bfdr from scv
  window w as (order by score desc rows between unbounded preceding and 1 preceding)),
scored as (select s.*, f.bfdr, k.pa is not null is_known, coalesce(k.n >= 2, false) multivalidated from sc1 s join scf f using (score)
  left join known k on k.pa = s.first_id and k.pb = s.bait_id)
"""
WD = """,
wt as (select e.bait experiment, replicate, bait_id bait, prey, spc "count" from inter join ed e using (experiment)),
w1 as (select experiment, prey, replicate, min(bait) bait, max("count") c from wt group by 1, 2, 3),
w2 as (select experiment, prey, min(bait) bait, avg(c) x, count(*) filter (c > 0) n_saw, list(c order by c) v, sum(c) sc, count(*) nr from w1 group by 1, 2),
w3 as (select *, bait = prey self, list_sum(list_transform(v, lambda t: -((t + 1 / nr) / (sc + 1)) * log2((t + 1 / nr) / (sc + 1)))) entropy,
  (select count(distinct experiment) from w2) k from w2),
w4 as (select *, sum(self::int) over p = sum((x > 0)::int) over p self_only, count(*) filter (n_saw > 0) over p seen, coalesce(sum(case when not self then x end) over p, 0) sx,
  coalesce(sum(case when not self then x * x end) over p, 0) sxx, count(case when not self then x end) over p n, sum(self::int) over p n_self from w3 window p as (partition by prey)),
w5 as (select *, case when self_only then 1 else seen end n_exp, case when self_only then x / k else sx / k end mu from w4),
w6 as (select *, nullif(sqrt(case when self_only then (x - mu) ** 2 + mu * mu * k else greatest(0, sxx - 2 * mu * sx + n * mu * mu + (k - n - n_self) * mu * mu) end / (k - 1)), 0) sd from w5),
w7 as (select *, (x - nullif(mu, 0)) / sd z, sqrt(x * (sd / nullif(mu, 0) * (k / n_exp)) ** n_saw) wd0 from w6),
w8 as (select *, wd0 / (select quantile_cont(wd0, 0.98) from w7 where wd0 > 0) wd from w7),
w9 as (select *, case when wd is not null then (rank() over (partition by prey order by round(wd, 9) desc nulls last) - 1) / k end p_value from w8),
wb as (select p_value, sum(count(*)) over (order by p_value) r, sum(count(*)) over () n from w9 where p_value is not null group by 1),
wa as (select p_value, least(1, min(p_value * n / r) over (order by p_value desc rows between unbounded preceding and current row)) wd_fdr from wb)
"""


def _wd(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.wd_table(_counts(spark, sf), views.design(spark, sf))


@query(WD + """select experiment, prey, bait, round(x, 6) avg_count, n_saw, round(entropy, 6) entropy, self, self_only, n_exp, round(nullif(mu, 0), 6) prey_mean, round(sd, 6) prey_sd,
  round(z, 6) z, round(wd, 6) wd, round(p_value, 6) p_value, round(wd_fdr, 6) wd_fdr from w9 left join wa using (p_value)""")
def wd_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wd.wd_scores(_wd(spark, sf)).drop("k").withColumn("n_exp", F.col("n_exp").cast("long")))


@query()
def wd_scores_resampled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wd.wd_scores(_wd(spark, sf), iterations=200).drop("k"))


@query(WD + """, d1 as (select experiment, prey, min(bait) bait, sum("count") total, count(*) filter ("count" > 0) reps from wt group by 1, 2),
d2 as (select *, sum((total > 0 and bait <> prey)::int) over (partition by prey) frequency, (select count(distinct experiment) from d1) k from d1)
select experiment, prey, total, frequency, round(sqrt((k / greatest(1, frequency)) ** reps * total), 6) d from d2""")
def d_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wd.d_scores(_wd(spark, sf)))


def _gp(k: str, mean: str, lam: str) -> str:
    first, rate = f"({mean}) * (1 - {lam})", f"(({mean}) * (1 - {lam}) + ({k}) * {lam})"
    return f"case when {k} = 0 then -{first} else ln({first}) + ({k} - 1) * ln({rate}) - {rate} - lgamma({k} + 1) end"


def _members(grouped: bool) -> str:
    if not grouped:
        return ", d as (select *, 0 g from ed)"
    return """, gs as (select distinct grp::int g from ed where "type" = 'T'),
d as (select distinct ed.*, g from ed, gs where case when grp = '*' then true else list_contains(string_split(grp, ','), g::varchar) end)"""


def _rounds(n: int) -> str:
    return ", b0 as (select distinct g, 0.0::double beta from d)" + "".join(
        f""", b{i} as (select g, least(15, greatest(-15, case when p <= 0 then -15 when p >= 1 then 15 else ln(p / (1 - p)) end)) beta from
  (select g, sum((beta + lt - lf >= 0)::int / m) / sum(1 / m) p from dens join b{i - 1} using (g) where not skip group by 1))"""
        for i in range(1, n + 1)
    )


def _natural_rounds() -> str:
    """Up to 15 rounds, ended where the likelihood rises by less than a thousandth."""
    return ", q0 as (select distinct g, 0.0::double beta from d)" + "".join(
        f""", q{i} as (select g, beta, d + za * beta - zn * ln(1 + exp(beta)) ll from (select *, least(15, greatest(-15, case when p <= 0 then -15 when p >= 1 then 15 else ln(p / (1 - p)) end)) beta from
  (select g, sum(z / m) filter (not skip) / sum(1 / m) filter (not skip) p, sum(z / m) za, sum(1 / m) zn, sum((z * lt + (1 - z) * lf) / m) d from (select dens.*, (beta + lt - lf >= 0)::int z from dens join q{i - 1} using (g)) group by 1)))"""
        for i in range(1, 16)
    ) + ", qs as (" + " union all ".join(f"select {i} i, g, beta, ll from q{i}" for i in range(1, 16)) + """), qo as (select *, lag(ll) over (partition by g order by i) ol from qs),
qn as (select g, coalesce(min(i) filter (ll >= ol and exp(least(ll - ol, 1)) - 1 < 1e-3), 15) i from qo group by 1), b3 as (select g, beta from qs join qn using (g, i))"""  # fmt: skip


_REPORT = """,
av as (select g, prey, bait, round(avg(score), 9) avg_p, max(score) max_p, min(log_odds) log_odds from sco group by 1, 2, 3),
fv as (select avg_p, coalesce(least(1, greatest(0, 1 - sum(avg_p * n) over w / sum(n) over w)), 0) bfdr from (select avg_p, count(*) n from av group by 1)
  window w as (order by avg_p desc rows between unbounded preceding and 1 preceding))
"""


def _count_sql(grouped: bool, controls: int = 100, replicates: int = 100, rounds: str = "") -> str:
    """The count model; top controls and replicates by sorted lists, `rounds` in place of three fixed ones."""
    return _members(grouped) + f""",
nc as (select g, count(*) filter ("type" = 'C') n_ctrl from d group by 1),
cs as (select g, prey, sum(spc) whole, list_sort(list(spc), 'DESC')[1:{controls}] v from inter join d using (experiment) where "type" = 'C' group by 1, 2),
ct as (select g, prey, whole, list_sum(v) s, list_sum(list_transform(v, lambda x: x * x)) ss from cs),
c1 as (select nc.g, prey.prey, gene, n_ctrl, least(n_ctrl, {controls}) l, coalesce(whole, 0) whole, coalesce(s, 0) s, coalesce(ss, 0) ss, greatest(0.1, coalesce(s, 0) / least(n_ctrl, {controls})) eta
  from prey cross join nc left join ct on ct.g = nc.g and ct.prey = prey.prey),
c2 as (select *, (ss - s * s / l) / (l - 1) v from c1),
cp as (select g, prey, gene, eta, case when v > eta then 1 - sqrt(eta / v) else 0.1 end lam, floor(whole / n_ctrl) ctrl_mean from c2),
pr as (select distinct g, prey, d.bait from inter join d using (experiment) where "type" = 'T'),
ms as (select g, bait, count(*) m from d where "type" = 'T' group by 1, 2),
ce as (select pr.g, pr.prey, pr.bait, d.experiment, m, cp.eta, lam, ctrl_mean, coalesce(case when gene <> pr.bait then spc end, 0) y from pr join d on d.g = pr.g and d.bait = pr.bait and d."type" = 'T'
  join ms on ms.g = pr.g and ms.bait = pr.bait join cp on cp.g = pr.g and cp.prey = pr.prey left join inter i on i.experiment = d.experiment and i.prey = pr.prey),
dens as materialized (select *, {_gp("floor(least(y, 5 * eta))", "5 * eta", "0.1")} lt, {_gp("floor(greatest(y, eta))", "eta", "lam")} lf, max(y) over (partition by g, prey, bait) most,
  max(y) over (partition by g, prey, bait) = 0 skip from ce)""" + (rounds or _rounds(3)) + """,
sco as (select *, beta + lt - lf log_odds, case when y <= 1 or y <= ctrl_mean or most = 1 then 0 else 1 / (1 + exp(-(beta + lt - lf))) end score from dens join b3 using (g))""" + _REPORT.replace("avg(score)", f"list_avg(list_sort(list(score), 'DESC')[1:{replicates}])") + """,
fo as (select g, prey, bait, sum(y) "sum", avg(y) avg, avg(y) / any_value(eta) fold_change, any_value(m) n_rep from dens group by 1, 2, 3)
"""  # fmt: skip


_COUNT_OUT = 'prey, bait, round(avg_p, 6) avg_p, round(max_p, 6) max_p, round(log_odds, 6) log_odds, round(fold_change, 6) fold_change, n_rep, round("sum", 6) "sum", round(avg, 6) avg, round(bfdr, 6) bfdr'
_COUNT_COLUMNS = ["prey", "bait", "avg_p", "max_p", "log_odds", "fold_change", "n_rep", "sum", "avg", "bfdr"]


@query(_count_sql(False) + f"select {_COUNT_OUT} from av join fv using (avg_p) join fo using (g, prey, bait)")
def count_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_counts.score(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf), rounds=3, digits=6).select(*_COUNT_COLUMNS)


@query(_count_sql(False, 3, 2, _natural_rounds()) + f"select {_COUNT_OUT} from av join fv using (avg_p) join fo using (g, prey, bait)")
def count_scores_of_the_best(spark: SparkSession, sf: str) -> DataFrame:
    """Three top controls and two top replicates of more, and rounds that end by themselves."""
    out = score_counts.score(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf), n_controls=3, n_replicates=2, digits=6)
    return out.select(*_COUNT_COLUMNS)


@query(_count_sql(True) + f"select g source_group, {_COUNT_OUT} from av join fv using (avg_p) join fo using (g, prey, bait)")
def count_scores_grouped(spark: SparkSession, sf: str) -> DataFrame:
    members = groups.memberships(views.design(spark, sf))
    inter = groups.scope_to_groups(_counts(spark, sf), members)
    return score_counts.score(inter, members, views.preys(spark, sf), by=["source_group"], rounds=3, digits=6).select("source_group", *_COUNT_COLUMNS)


_INTENSITY = """, d as (select *, 0 g from ed),
sc as (select avg(ln(intensity)) mu, stddev_samp(ln(intensity)) sd from inter),
st as (select experiment, bait, prey, (ln(intensity) - mu) / sd x from inter, sc),
nc as (select count(*) n_ctrl from ed where "type" = 'C'),
cc as (select prey, count(*) n, sum(x) s, avg(x) mean, stddev_pop(x) sd from st join ed using (experiment) where "type" = 'C' group by 1),
t0 as (select sum(s) / sum(n) t from cc, nc where n < n_ctrl),
li as (select regr_slope(ln(sd), mean) slope, regr_intercept(ln(sd), mean) icept, exp(list_sort(list(ln(sd)))[(count(*) // 2 + 1)::int]) lo from cc, nc where n = n_ctrl and sd > 0),
p1 as (select p.prey, gene, coalesce(mean, t) eta, t, greatest(lo, case when coalesce(n, 0) = 0 then lo when n >= 3 then cc.sd else exp(mean * slope + icept) end) sf, lo
  from prey p cross join t0 cross join li left join cc on cc.prey = p.prey),
pr as (select distinct prey, bait from inter where experiment in (select experiment from ed where "type" = 'T')),
ce as (select 0 g, pr.prey, pr.bait, d.experiment, count(*) over (partition by pr.prey, pr.bait) m, p1.eta, p1.t, p1.sf, p1.lo, case when gene <> pr.bait then st.x end y
  from pr join ed d on d.bait = pr.bait join p1 on p1.prey = pr.prey left join st on st.experiment = d.experiment and st.prey = pr.prey),
sh as (select prey, avg(case when y > eta then y end) up, stddev_samp(case when y > eta + ln(5) then y end) sp from ce where y is not null group by 1),
c2 as (select ce.*, greatest(ln(4), coalesce(up - eta, 0)) dd, greatest(lo, coalesce(sp, sf)) sdt, coalesce(y, t) at_ from ce left join sh using (prey)),
dens as (select *, -0.5 * least(abs((least(at_, eta + dd) - (eta + dd)) / sdt), 5) ** 2 - ln(sdt) lt, -0.5 * least(abs((greatest(at_, eta) - eta) / sf), 5) ** 2 - ln(sf) lf,
  count(y) over (partition by prey, bait) = 0 skip from c2)""" + _rounds(3) + """,
sco as (select *, beta + lt - lf log_odds, case when y is null then 0 else 1 / (1 + exp(-(beta + lt - lf))) end score from dens join b3 using (g))""" + _REPORT + """,
fo as (select g, prey, bait, avg(exp(at_)) / exp(any_value(eta)) fold_change, any_value(m) n_rep, exp(any_value(t)) imputed_value from dens group by 1, 2, 3)
"""  # fmt: skip


@query(_INTENSITY + """select prey, bait, round(avg_p, 6) avg_p, round(max_p, 6) max_p, round(log_odds, 6) log_odds, round(fold_change, 6) fold_change, n_rep, round(imputed_value, 6) imputed_value,
  round(bfdr, 6) bfdr from av join fv using (avg_p) join fo using (g, prey, bait)""")
def intensity_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = score_intensity.score(_values(spark, sf), views.design(spark, sf), views.preys(spark, sf), rounds=3, digits=6)
    return rounded(out.select("prey", "bait", "avg_p", "max_p", "log_odds", "fold_change", "n_rep", "imputed_value", "bfdr"))


_MISSING = "coalesce(nullif((ln(500 + 37 * (substr(p.prey, 2)::bigint % 100) / nullif(substr(p.prey, 2)::bigint % 3, 0)) - mu) / sd_ln, 0), t)"


@query(_INTENSITY.replace("coalesce(mean, t) eta, t,", f"coalesce(mean, {_MISSING}) eta, {_MISSING} t,").replace("from prey p cross join t0", "from prey p cross join (select mu, sd sd_ln from sc) cross join t0") + """select prey, bait, round(avg_p, 6) avg_p,
  round(max_p, 6) max_p, round(log_odds, 6) log_odds, round(fold_change, 6) fold_change, round(imputed_value, 6) imputed_value, round(bfdr, 6) bfdr from av join fv using (avg_p) join fo using (g, prey, bait)""")
def intensity_scores_with_missing_values(spark: SparkSession, sf: str) -> DataFrame:
    """A given missing value for two of three preys, the common one for the others."""
    key = F.substring("prey", 2, 20).cast("long")
    preys = views.preys(spark, sf).withColumn("imputed_mu", 500 + 37 * (key % 100) / F.nullif(key % 3, F.lit(0)))
    out = score_intensity.score(_values(spark, sf), views.design(spark, sf), preys, rounds=3, digits=6)
    return rounded(out.select("prey", "bait", "avg_p", "max_p", "log_odds", "fold_change", "imputed_value", "bfdr"))


@query()
def intensity_scores_imputed(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.score(_values(spark, sf), views.design(spark, sf), views.preys(spark, sf), imputation="mixture", pi=0.1)


@query(SCORED + "select bait, prey, score, round(bfdr, 6) bfdr from scored")
def pooled_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored_view(spark, sf).select("bait", "prey", "score", "bfdr"))


@query(_members(True) + 'select experiment, bait, "type", g source_group from d')
def group_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return groups.memberships(views.design(spark, sf)).select("experiment", "bait", "type", "source_group")


@query(_members(True) + """, pp as (select distinct g, prey, d.bait from inter join d using (experiment) where "type" = 'T')
select g source_group, count(*) filter ("type" = 'T') n_test, count(*) filter ("type" = 'C') n_control, (select count(*) from pp where pp.g = d.g) n_pairs from d group by 1""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    members = groups.memberships(views.design(spark, sf))
    pairs = scoring.unique_pairs(groups.scope_to_groups(_counts(spark, sf), members), members, ["source_group"])
    return writers.run_summary(members, pairs)


@query("""select (select count(*) from prey) n_preys, (select count(distinct bait) from ed where "type" = 'T') n_baits, (select count(*) from ed where "type" = 'C') n_controls,
  (select count(*) from (select distinct prey, e.bait from inter join ed e using (experiment) where "type" = 'T')) n_pairs,
  (select count(distinct bait) from ed where "type" = 'T' and bait not in (select gene from prey)) n_baits_not_preys""")
def data_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.data_summary(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf))


@query("""select count(distinct case when "type" = 'T' then experiment end) n_test, count(distinct case when "type" = 'C' then experiment end) n_control from ed""")
def design_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.design_counts(views.design(spark, sf))


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """A design row for each order line's customer segment and status, with faults of all kinds."""
    orders = views.table(spark, sf, "orders")
    name = F.expr("concat('E', o_custkey % 12, '_', o_orderkey % 4)")
    kind = F.expr("case o_orderkey % 17 when 0 then 'X' when 1 then null when 2 then ' ' else if(o_custkey % 12 >= 10, 'C', 'T') end")
    grp = F.expr("element_at(array('1', '2', '*', '1,2', '*,1', '0', 'a', '', '3'), cast(o_orderkey % 9 as int) + 1)")
    return orders.select(name.alias("experiment"), kind.alias("type"), F.expr("concat('B', o_custkey % 12)").alias("bait"), F.expr("if(o_orderkey % 13 = 0, 'x', cast(o_orderkey % 5 as string))").alias("replicate"), grp.alias("grp"))


_FAULTY = """, fd as (select 'E' || o_custkey % 12 || '_' || o_orderkey % 4 experiment, case o_orderkey % 17 when 0 then 'X' when 1 then null when 2 then ' ' else case when o_custkey % 12 >= 10 then 'C' else 'T' end end "type",
  'B' || o_custkey % 12 bait, case when o_orderkey % 13 = 0 then 'x' else (o_orderkey % 5)::varchar end replicate, ['1', '2', '*', '1,2', '*,1', '0', 'a', '', '3'][(o_orderkey % 9 + 1)::int] grp from orders)"""


@query(_FAULTY + """, v as (
select 'required_not_blank' rule, experiment "key", 'type' detail from fd where trim(coalesce("type", '')) = ''
union all select 'valid_type', experiment, "type" from fd where coalesce("type" not in ('T', 'C'), true)
union all select 'valid_replicate', experiment, replicate from fd where coalesce(try_cast(replicate as int), 0) <= 0
union all select 'duplicate_experiment', experiment, count(*)::varchar from fd group by experiment having count(*) > 1
union all select case when grp = '*,1' then 'star_mixed' when grp in ('0', 'a') then 'invalid_group' when "type" = 'T' and grp = '*' then 'star_on_test' when "type" = 'T' and grp = '1,2' then 'several_groups'
  when "type" = 'T' and grp = '' then 'test_without_group' end, experiment, grp from fd
union all select 'experiment_not_in_data', experiment, null from (select distinct experiment from fd where experiment not in (select experiment from inter))
union all select 'warning_experiment_not_in_design', experiment, null from (select distinct experiment from inter where experiment not in (select experiment from fd)))
select * from v where rule is not null""")
def design_violations(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_design(_faulty(spark, sf), views.interactions(spark, sf))


@query(_FAULTY + """, g as (select "type", unnest(string_split(grp, ','))::int n from fd where grp in ('1', '2', '3', '1,2') and ("type" <> 'T' or true)),
q as (select distinct n from g where "type" = 'T' and n < 3), c as (select distinct n from g where "type" = 'C' and n > 1)
select 'group_without_control' rule, n::varchar "key", null::varchar detail from q where n not in (select n from c)
union all select 'warning_control_without_test', n::varchar, null from c where n not in (select n from q)""")
def group_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Groups without controls: tests of groups 1 and 2, controls of groups 2 and 3, no universal control."""
    rows = _faulty(spark, sf).where("grp in ('1', '2', '3', '1,2')").withColumn("g", F.explode(F.split("grp", ",")))
    kept = rows.where("(type = 'T' and g < 3) or (type = 'C' and g > 1)").withColumn("grp", F.col("g"))
    return validate.group_rules(kept).where("rule like '%_control%'")


@query("""select o_orderkey, case when len(p) > 3 then replace(list_aggregate(p[1:3], 'string_agg', ';') || ';+' || (len(p) - 3), ' ', '-') else list_aggregate(p, 'string_agg', ';') end prey,
  p[1] first_id from (select l_orderkey o_orderkey, list('P ' || l_partkey order by l_linenumber, l_partkey) p from lineitem group by 1)""")
def short_ids(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("P "), x["l_partkey"].cast("string"))), ";").alias("ids"))
    return lines.select(F.col("l_orderkey").alias("o_orderkey"), text.short_ids(F.col("ids")).alias("prey"), text.first_item(F.col("ids")).alias("first_id"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """The counts as a wide table with metadata and flags: preys of part keys that 50 divides are contaminants."""
    names = [r.experiment for r in views.design(spark, sf).select("experiment").orderBy("experiment").collect()]
    wide = ingest.pivot_runs(_counts(spark, sf), names).join(views.preys(spark, sf).select("prey", "gene"), "prey")
    flag = F.when(F.substring("prey", 2, 20).cast("long") % 50 == 0, "+").otherwise("-")
    return wide.select("prey", "gene", F.lit("x").alias("description"), F.lit("1").alias("length"), F.lit("-").alias("reverse"), F.lit(None).cast("string").alias("only_by_site"), flag.alias("contaminant"), *names)


_KEPT = """, kp as (select * from inter where substr(prey, 2)::bigint % 50 <> 0 and prey in (select prey from inter join ed using (experiment) where "type" = 'T' and spc > 0))"""


@query(_KEPT + "select experiment, kp.bait, prey, spc \"value\" from kp where spc > 0")
def melted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Wide to long: flags, melt, preys of controls alone, zeros."""
    design, wide = views.design(spark, sf), ingest.drop_flagged(_wide(spark, sf))
    inter = ingest.melt_quant(wide, design, [c for c in wide.columns if c.startswith("E")])
    return ingest.drop_zero(ingest.drop_control_only(inter, design)).select("experiment", "bait", "prey", "value")


@query('select p.prey, e.experiment, e.bait, coalesce(spc, 0) "value" from prey p cross join ed e left join inter i on i.prey = p.prey and i.experiment = e.experiment')
def dense_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.dense_interactions(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf))


@query("""select 'P' || l_partkey prey, 'E' || l_suppkey % 10 || '_' || (l_orderkey % 3 + 1) experiment, round(2 ** avg(log2(l_extendedprice)), 3) "value" from lineitem where l_linestatus = 'O' and l_quantity > 5 group by 1, 2""")
def msstats_clean(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.table(spark, sf, "lineitem")
    rows = lines.select(
        F.expr("concat('P', l_partkey)").alias("prey"), F.when(F.col("l_linestatus") == "O", "L").otherwise("H").alias("label"),
        F.when(F.col("l_quantity") > 5, F.log2("l_extendedprice")).alias("log_intensity"), F.expr("concat('E', l_suppkey % 10, '_', l_orderkey % 3 + 1)").alias("experiment"),
    )
    return rounded(ingest.msstats_clean(rows), 3)


@query("select o_orderkey, o_custkey bait, row_number() over (partition by o_custkey order by o_orderkey) replicate from orders")
def numbered_replicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("bait"))
    return ingest.number_replicates(rows, "o_orderkey").withColumn("replicate", F.col("replicate").cast("long"))


@query("""select 'E' || l_suppkey % 10 || '_' || (l_orderkey % 3 + 1) experiment, 'P' || l_partkey prey, arg_max(l_quantity, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity) "value" from lineitem group by 1, 2""")
def assigned_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem").select(F.expr("concat('E', l_suppkey % 10, '_', l_orderkey % 3 + 1)").alias("experiment"), F.expr("concat('P', l_partkey)").alias("prey"), F.col("l_quantity").alias("value"), F.expr("l_orderkey * 100000 + l_linenumber * 1000 + l_quantity").alias("n"))
    return scoring.assign_cells(rows, "n")


@query("""select round(u, 6) upper_tlim, round(least_ - 5 * sd, 6) mu_low, round(hi, 6) mu_high, round(lo, 6) sigma_floor from (select log10(quantile_cont(mn, 0.95)) u, log10(quantile_cont(me, 0.99)) hi, quantile_cont(s, 0.01) lo
  from (select min(intensity) mn, avg(intensity) me, stddev_samp(log10(intensity)) s from inter group by prey)), (select min(log10(intensity)) least_, stddev_samp(log10(intensity)) sd from inter)""")
def imputation_limits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(impute.limits(_values(spark, sf)))


@query(""", x as (select i.prey, log10(intensity) y from inter i join ed using (experiment) where 'P' || substr(ed.bait, 2) <> i.prey),
u as (select log10(quantile_cont(mn, 0.95)) u from (select min(intensity) mn from inter group by prey))
select prey, count(*) n_obs, round(sum(y), 6) sum_y, round(sum(y * y), 6) sum_yy, round(avg(y), 6) obs_mu, round(least(min(y), any_value(u)), 6) tlim, round(case when stddev_pop(y) < 1e-9 then 0.5 else stddev_pop(y) end, 6) obs_sigma
from x, u group by prey""")
def censored_statistics(spark: SparkSession, sf: str) -> DataFrame:
    inter = _values(spark, sf)
    rows = impute.censor_stats(impute.exclude_self(inter, views.design(spark, sf)), F.lit(0), impute.limits(inter))
    rows = rows.withColumn("obs_sigma", F.when(F.col("obs_sigma") < 1e-9, 0.5).otherwise(F.col("obs_sigma")))
    return rounded(rows.select("prey", "n_obs", "sum_y", "sum_yy", "obs_mu", "tlim", "obs_sigma"))


@query()
def imputed_preys(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(impute.impute(_values(spark, sf), views.design(spark, sf), views.preys(spark, sf), "mixture", 0.1))


@query()
def imputed_preys_with_prior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(impute.impute(_values(spark, sf), views.design(spark, sf), views.preys(spark, sf), "prior"))


@query()
def imputation_pi(spark: SparkSession, sf: str) -> DataFrame:
    pi = impute.estimate_pi(_values(spark, sf), views.design(spark, sf))
    return spark.createDataFrame([(round(pi, 4),)], "pi double")


@query(""", e as (select bait, count(*) n from ed where "type" = 'C' group by 1)
select i.bait, prey, round(1 - count(*) / any_value(n), 6) missing, round(avg(log2(intensity)), 6) mean_log2 from inter i join e using (bait) group by 1, 2""")
def missingness(spark: SparkSession, sf: str) -> DataFrame:
    controls = views.design(spark, sf).where("type = 'C'").select("bait", "experiment")
    return rounded(impute.missingness(_values(spark, sf), controls, ("bait",)))


@query(""", f as (select prey, avg(log10(intensity)) mu, stddev_samp(log10(intensity)) sigma from inter group by 1), s as (select avg(mu) m, stddev_pop(mu) sm, avg(sigma) q, stddev_pop(sigma) sq from f)
select prey, round(case when abs(mu - m) > 3 * sm or coalesce(abs(sigma - q) > 3 * sq, false) then 0 else mu end, 6) mu, sigma is not null and not (abs(mu - m) > 3 * sm or coalesce(abs(sigma - q) > 3 * sq, false)) imputed from f, s""")
def rejected_fits(spark: SparkSession, sf: str) -> DataFrame:
    fits = _values(spark, sf).groupBy("prey").agg(F.avg(F.log10("value")).alias("mu"), F.stddev_samp(F.log10("value")).alias("sigma"))
    return rounded(impute.reject_outliers(fits).select("prey", "mu", "imputed"))


@query("""select experiment, prey, round((ln(intensity) - m) / s, 6) z, intensity back from inter, (select avg(ln(intensity)) m, stddev_pop(ln(intensity)) s from inter)""")
def normalised_values(spark: SparkSession, sf: str) -> DataFrame:
    inter = _values(spark, sf)
    params = impute.normalization(inter)
    rows = impute.normalize(inter, params).withColumn("z", F.col("value"))
    return impute.denormalize(rows, params).select("experiment", "prey", F.round("z", 6).alias("z"), F.round("value", 2).alias("back"))


@query("""select least(pa, pb) a, greatest(pa, pb) b from known group by 1, 2""")
def prey_edges(spark: SparkSession, sf: str) -> DataFrame:
    return network.edges_from_pairs(views.known_once(spark, sf).select("a", "b"), views.preys(spark, sf))


_MEMBERS = """, tm as (select 'P' || p_partkey prey, 'R' || p_partkey // 7 || p_brand term from part)"""


@query(_MEMBERS + "select distinct a.prey a, b.prey b from tm a join tm b using (term) where a.prey < b.prey")
def prey_edges_from_terms(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part").select(F.expr("concat('P', p_partkey)").alias("prey"), F.concat(F.lit("R"), F.expr("p_partkey div 7").cast("string"), "p_brand").alias("term"))
    terms = part.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("prey")), " ").alias("members"))
    return network.edges_from_terms(terms, part)


@query(""", ek as (select least(pa, pb) a, greatest(pa, pb) b from known group by 1, 2),
zz as (select i.prey, e.bait, count(*) filter (spc > 40) / any_value(m) z from inter i join ed e using (experiment) join (select bait b2, count(*) m from ed group by 1) on b2 = e.bait where "type" = 'T' group by 1, 2)
select a prey, bait, round(sum(z), 6) support from ek join zz on zz.prey = ek.b where z > 0 group by 1, 2""")
def neighbour_support(spark: SparkSession, sf: str) -> DataFrame:
    cells = scoring.replicate_cells(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf).withColumn("gene", F.lit(None).cast("string")))
    labelled = cells.withColumn("z", F.coalesce(F.col("y") > 40, F.lit(False)))
    return rounded(network.neighbour_support(labelled, prey_edges(spark, sf)).drop("neighbours"))


@query()
def topology_scores(spark: SparkSession, sf: str) -> DataFrame:
    inter, design, preys = _counts(spark, sf), views.design(spark, sf), views.preys(spark, sf)
    inter, design = stored(inter), cut(design)
    scored = stored(score_counts.density_pairs(inter, design, preys))
    pairs = score_counts.posterior(scored, ["prey", "bait"], rounds=3).select("prey", "bait", "avg_p")
    return rounded(network.topology_scores(scored.select("prey", "bait", "skip", "cells"), prey_edges(spark, sf), pairs), 4)


@query(_count_sql(False) + WD + """select av.prey, av.bait, round(avg_p, 6) avg_p, round(wd, 6) wd, round(p_value, 6) p_value, null::int source_group from av left join w9 on w9.experiment = av.bait and w9.prey = av.prey""")
def merged_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_counts.score(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf), rounds=3, digits=6)
    return rounded(annotate.merge_scores(scored, wd.wd_scores(_wd(spark, sf))).select("prey", "bait", "avg_p", "wd", "p_value", "source_group"))


_PHYSICAL = """, ph as (select 9606 + l_orderkey % 2 oa, 9606 o, case when l_quantity > 10 then 'physical' else 'genetic' end st, 'P' || l_partkey a, 'P' || l_suppkey b, l_orderkey * 10 + l_linenumber n from lineitem),
pk as (select a, b, string_agg('S' || n % 5, '; ' order by n) systems, string_agg('A' || n % 7, '; ' order by n) authors from ph where oa = o and st = 'physical' group by 1, 2)"""


def _physical(spark: SparkSession, sf: str) -> DataFrame:
    n = F.expr("l_orderkey * 10 + l_linenumber")
    return views.table(spark, sf, "lineitem").select(
        (9606 + F.col("l_orderkey") % 2).alias("organism_a"), F.lit(9606).cast("long").alias("organism_b"), F.when(F.col("l_quantity") > 10, "physical").otherwise("genetic").alias("system_type"),
        F.concat(F.lit("S"), (n % 5).cast("string")).alias("system"), F.concat(F.lit("A"), (n % 7).cast("string")).alias("author"), F.lit("x").alias("source"),
        F.expr("concat('P', l_partkey)").alias("a"), F.expr("concat('P', l_suppkey)").alias("b"), n.alias("ordinal"), "l_quantity",
    )


@query(_PHYSICAL + """select pk.*, (a, b) in (select a, b from ph where oa = o and st = 'physical' and n % 3 = 0) multivalidated from pk""")
def known_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _physical(spark, sf)
    return annotate.summarise_known(rows, rows.where("ordinal % 3 = 0"), 9606).select("a", "b", "systems", "authors", "multivalidated")


@query(SCORED + "select bait, prey, is_known, multivalidated, case when multivalidated then 'multivalidated' when is_known then 'known' else 'not known' end evidence from scored")
def known_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.evidence_class(scored_view(spark, sf)).select("bait", "prey", "is_known", "multivalidated", "evidence")


_LISTS = """, ol as (select l_orderkey k, string_agg('P' || l_partkey, ';' order by l_linenumber, l_partkey) prey from lineitem group by 1)"""


def _order_lists(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("P"), x["l_partkey"].cast("string"))), ";").alias("prey"))


@query(_LISTS + """, cx as (select 'C' || s_suppkey cname, s_suppkey place, 'P' || s_suppkey * 3 || ';P' || s_suppkey * 2 + 1 subs from supplier),
cm as (select cname, place, unnest(string_split(subs, ';')) id from cx), ids as (select k, unnest(string_split(prey, ';')) id, generate_subscripts(string_split(prey, ';'), 1) pos from ol),
be as (select k, arg_min(cname, pos * 1000000 + place) c from ids join cm using (id) group by 1)
select k, prey, c complex, len(list_intersect(string_split(prey, ';'), (select list(bait_id) from ed))) > 0 prey_is_bait, list_contains(string_split(prey, ';'), 'P' || k % 10) self_interaction from ol left join be using (k)""")
def annotated_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Complexes, baits among preys and self-interactions of `;` lists."""
    rows = _order_lists(spark, sf).withColumn("bait_id", F.expr("concat('P', k % 10)"))
    complexes = views.table(spark, sf, "supplier").select(F.expr("concat('C', s_suppkey)").alias("complex"), F.expr("concat('P', s_suppkey * 3, ';P', s_suppkey * 2 + 1)").alias("subunits"), F.col("s_suppkey").alias("ordinal"))
    rows = annotate.self_interaction(annotate.complex_membership(rows, complexes))
    return annotate.prey_is_bait(rows, views.design(spark, sf)).select("k", "prey", "complex", "prey_is_bait", "self_interaction")


@query(""", at_ as (select distinct 'G' || s_suppkey * 2 g from supplier), ge as (select distinct 'G' || p_partkey gene from part), na as (select p_partkey o, unnest(['N' || p_partkey % 50, 'G' || p_partkey, 'G' || p_partkey + 1]) g, unnest([0, 1, 2]) pos from part),
fi as (select gene, min(o) o from ge join na on na.g = ge.gene where gene not in (select g from at_) group by 1), ot as (select gene, arg_min(na.g, pos) a from fi join na using (o) where na.g in (select g from at_) group by 1)
select gene, case when gene in (select g from at_) then gene else a end atlas_gene from ge left join ot using (gene)""")
def synonym_matches(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    genes = part.select(F.expr("concat('G', p_partkey)").alias("gene"))
    proteins = part.select(F.expr("concat('N', p_partkey % 50, ' G', p_partkey, ' G', p_partkey + 1)").alias("names"), F.col("p_partkey").alias("ordinal"))
    atlas = views.table(spark, sf, "supplier").select(F.expr("concat('G', s_suppkey * 2)").alias("gene"))
    return annotate.match_by_synonym(genes, proteins, atlas)


_RAW = "'x. SUBCELLULAR LOCATION: ' || p_type || ' {E:1}, ' || p_brand || '; y'"


@query(f""", lo as (select p_partkey, trim(string_split(string_split(string_split(regexp_replace({_RAW}, '^.*?SUBCELLULAR LOCATION: ', ''), ';')[1], ' {{')[1], ',')[1]) l,
  p_name || ' [GO:' || lpad(p_partkey::varchar, 7, '0') || ']; ' || p_brand || ' [GO:0000001]' g from part)
select p_partkey, case when count(*) over (partition by l) > 1 then l end location, replace(regexp_replace(g, ' \\[[^\\]]*\\]', '', 'g'), ' ;', ';') go_name, ['GO:' || lpad(p_partkey::varchar, 7, '0'), 'GO:0000001'] go_ids from lo""")
def cleaned_annotations(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    raw = F.concat(F.lit("x. SUBCELLULAR LOCATION: "), "p_type", F.lit(" {E:1}, "), "p_brand", F.lit("; y"))
    go = F.concat("p_name", F.lit(" [GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("]; "), "p_brand", F.lit(" [GO:0000001]"))
    rows = part.select("p_partkey", text.first_location(raw).alias("location"), text.clean_go(go).alias("go_name"), text.go_ids(go).alias("go_ids"))
    return annotate.null_singletons(rows, "location").select("p_partkey", "location", "go_name", "go_ids")


_ONTOLOGY = """, ew as (select child, parent, max(1 / (0.67 + n) + case kind when 'isa' then 0.4 else 0.3 end) w from (select distinct * from term_edges) join (select parent, count(*) n from (select distinct * from term_edges) group by 1) using (parent) group by 1, 2),
nd as (select child term from term_edges union select parent from term_edges), pa as (select term, term anc, 1.0::double v from nd union all select p.term, ew.parent, p.v * ew.w from pa p join ew on ew.child = p.anc),
sv as (select term, anc, max(v) v from pa group by 1, 2), tt as (select term, sum(v) t from sv group by 1)"""


def _semantics(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.term_edges(spark, sf).distinct().select(F.lit("n").alias("namespace"), "child", "parent", "kind")
    counts = raw.groupBy("namespace", "parent").agg(F.count(F.lit(1)).alias("n_children"))
    return ontology.semantic_values(ontology.weigh(raw.join(counts, ["namespace", "parent"])))


@query(_ONTOLOGY + "select term, anc ancestor, round(v, 6) \"value\" from sv")
def semantic_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_semantics(spark, sf).drop("namespace"))


_TERM_PAIRS = """, tp as (select a.term a, b.term b from tt a join tt b on a.term < b.term where a.term like 'TB:%' and b.term like 'TB:%')"""


@query(_ONTOLOGY + _TERM_PAIRS + """select tp.a, tp.b, round(coalesce((select sum(x.v + y.v) from sv x join sv y using (anc) where x.term = tp.a and y.term = tp.b), 0) / (p.t + q.t), 6) similarity from tp join tt p on p.term = tp.a join tt q on q.term = tp.b""")
def term_similarity(spark: SparkSession, sf: str) -> DataFrame:
    values = _semantics(spark, sf)
    terms = values.select(F.col("term").alias("gene")).where("term like 'TB:%'").distinct()
    return rounded(ontology.term_similarity(values, ontology.all_pairs(terms, terms)).drop("namespace"))


@query(_ONTOLOGY + SCORED + """, gp as (select distinct bait_id a, prey b from scored),
xy as (select a, b, x.term x, y.term y from gp join prey_terms x on x.prey = a join prey_terms y on y.prey = b),
ss as (select x, y, coalesce((select sum(p.v + q.v) from sv p join sv q using (anc) where p.term = x and q.term = y), 0) / ((select t from tt where term = x) + (select t from tt where term = y)) s from (select distinct x, y from xy)),
rw as (select a, b, x, y, s from xy join ss using (x, y)), bs as (select a, b, x t, max(s) s from rw group by 1, 2, 3 union all select a, b, y, max(s) from rw group by 1, 2, 3),
bm as (select a, b, max(s) over (partition by a, b, t) s from bs)
select a bait_id, b first_id, round(avg(s), 6) similarity from bm group by 1, 2""")
def semantic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    terms = views.prey_terms(spark, sf).withColumnRenamed("prey", "gene")
    pairs = scored_view(spark, sf).select(F.col("bait_id").alias("a"), F.col("first_id").alias("b"))
    return ontology.gene_similarity(_semantics(spark, sf), terms, pairs, digits=6).select(F.col("a").alias("bait_id"), F.col("b").alias("first_id"), "similarity")


@query(_ONTOLOGY + _TERM_PAIRS + """, si as (select coalesce((select sum(x.v + y.v) from sv x join sv y using (anc) where x.term = tp.a and y.term = tp.b), 0) / (p.t + q.t) s from tp join tt p on p.term = tp.a join tt q on q.term = tp.b)
select round(list_sort(list(s))[count(*) // 2 + 1], 6) preference from si""")
def median_preference(spark: SparkSession, sf: str) -> DataFrame:
    values = _semantics(spark, sf)
    terms = values.select(F.col("term").alias("gene")).where("term like 'TB:%'").distinct()
    similar = ontology.term_similarity(values, ontology.all_pairs(terms, terms))
    return rounded(ontology.upper_median(similar).drop("namespace"))


@query()
def affinity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the type-and-brand terms by similarity."""
    return affinity.affinity_clusters(term_similarity(spark, sf).where("similarity > 0"), 0.5, rounds=500, stable=50)


@query(SCORED + "select bait, prey, score, wd from scored where score >= 0.4 and bfdr <= 0.5 and wd >= 5 and coalesce(wd_fdr, 1) <= 0.02")
def passing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.apply_thresholds(scored_view(spark, sf), 0.4, 0.5, 5, 0.02).select("bait", "prey", "score", "wd")


@query(SCORED + """, ps as (select * from scored where score >= 0.5), en as (select distinct first_id p from ps where first_id not in (select bait_id from ps)),
dg as (select p, count(*) n from (select unnest([pa, pb]) p from known where pa in (select p from en) and pb in (select p from en)) group by 1),
de as (select avg(coalesce(n, 0)) m from (select distinct first_id p from ps) left join dg using (p))
select (select count(*) from scored) total_before, (select count(*) filter (is_known) from scored) known_before, count(*) total_after, count(*) filter (is_known) known_after,
  (select median(n)::double from (select count(*) n from ps group by bait)) median_network_size, round((select m from de), 6) mean_degree,
  round((count(*) filter (is_known) / count(*)) / ((select count(*) filter (is_known) / count(*) from scored)), 6) enrichment_ratio from ps""")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    known = views.known(spark, sf).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    return rounded(analytics.threshold_metrics(scored_view(spark, sf), known, score=0.5))


@query(SCORED + """select round(u / 20, 2) cutoff, count(*) filter (score >= u / 20 - 1e-9) n, round(count(*) filter (is_known and score >= u / 20 - 1e-9) / nullif(count(*) filter (score >= u / 20 - 1e-9), 0), 6) share_known
from scored, range(21) t(u) group by u""")
def retention_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analytics.retention_curve(scored_view(spark, sf)).withColumn("cutoff", F.round("cutoff", 2)))


@query(SCORED + """, rp as (select wd threshold, sum(count(*) filter (not is_known)) over w / sum(count(*) filter (not is_known)) over () fpr, sum(count(*) filter (is_known)) over w / sum(count(*) filter (is_known)) over () tpr
  from scored group by wd window w as (order by wd desc rows between unbounded preceding and current row))
select null::double threshold, 0.0::double fpr, 0.0::double tpr union all select threshold, round(fpr, 6), round(tpr, 6) from rp""")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analytics.roc_curve(scored_view(spark, sf), "wd").select("threshold", "fpr", "tpr"))


@query(SCORED + """, rp as (select sum(count(*) filter (not is_known)) over w / sum(count(*) filter (not is_known)) over () f, sum(count(*) filter (is_known)) over w / sum(count(*) filter (is_known)) over () t
  from scored group by wd window w as (order by wd desc rows between unbounded preceding and current row)), ra as (select 0.0::double f, 0.0::double t union all select f, t from rp)
select round(sum(a), 6) auc from (select (f - lag(f) over (order by f, t)) * (t + lag(t) over (order by f, t)) / 2 a from ra)""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analytics.auc(analytics.roc_curve(scored_view(spark, sf), "wd")))


@query(""", pk as (select prey, min(intensity) lo from inter group by 1 having count(*) >= 0.5 * (select count(*) from ed)), gr as (select pk.prey, ed.experiment, coalesce(intensity, lo) v from pk cross join ed left join inter i on i.prey = pk.prey and i.experiment = ed.experiment)
select prey, experiment, round((v - avg(v) over w) / stddev_samp(v) over w, 6) z from gr window w as (partition by prey) qualify stddev_samp(v) over w > 0""")
def pca_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analytics.pca_matrix(_values(spark, sf), views.design(spark, sf)))


def _squared(name: str, times: int) -> str:
    """CTEs that square a matrix (a, b, g) again and again, its trace held at one: what is left is vv' of its top vector."""
    out = f"{name}0 as materialized (select a, b, g / (select sum(g) from {name} where a = b) g from {name})"
    for k in range(times):
        out += f""", {name}s{k} as materialized (select x.a, y.b, sum(x.g * y.g) g from {name}{k} x join {name}{k} y on x.b = y.a group by 1, 2),
{name}{k + 1} as materialized (select a, b, g / (select sum(g) from {name}s{k} where a = b) g from {name}s{k})"""
    m = f"{name}{times}"
    return out + f""", {name}v as materialized (select a, g / sqrt((select g from {m} where a = b order by g desc limit 1)) v from {m} where b = (select a from {m} where a = b order by g desc, a limit 1)),
{name}l as materialized (select sum(x.v * g * y.v) l from {name} join {name}v x using (a) join {name}v y on y.a = b),
{name}p as (select a, v * sqrt(l) * (select sign(v) from {name}v order by abs(v) desc limit 1) p from {name}v, {name}l)"""


@query(""", pk as (select prey, min(intensity) lo from inter group by 1 having count(*) >= 0.5 * (select count(*) from ed)), gr as (select pk.prey, ed.experiment, coalesce(intensity, lo) v from pk cross join ed left join inter i on i.prey = pk.prey and i.experiment = ed.experiment),
zz as materialized (select prey, experiment, (v - avg(v) over w) / stddev_samp(v) over w z from gr window w as (partition by prey) qualify stddev_samp(v) over w > 0),
g as materialized (select x.experiment a, y.experiment b, sum(x.z * y.z) g from zz x join zz y using (prey) group by 1, 2), """ + _squared("g", 16) + """,
h as materialized (select g.a, g.b, g - l * x.v * y.v g from g join gv x on x.a = g.a join gv y on y.a = g.b, gl), """ + _squared("h", 16) + """
select gp.a experiment, round(gp.p, 4) pc1, round(hp.p, 4) pc2 from gp join hp using (a)""")
def pca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analytics.pca(_values(spark, sf), views.design(spark, sf))[0], 4)


@query(SCORED + """, ab as (select prey, sum(case when bait = 'B0' then intensity else 0 end) sa, sum(case when bait = 'B0' then intensity * intensity else 0 end) qa, sum(case when bait = 'B1' then intensity else 0 end) sb,
  sum(case when bait = 'B1' then intensity * intensity else 0 end) qb from inter where bait in ('B0', 'B1') group by 1), n as (select count(*) filter (bait = 'B0') na, count(*) filter (bait = 'B1') nb from ed),
m as (select *, sa / na ma, sb / nb mb, greatest(0, qa - sa * sa / na) + greatest(0, qb - sb * sb / nb) sse, na + nb - 2 df from ab, n), t as (select *, abs(ma - mb) / nullif(sqrt(sse / df * (1 / na + 1 / nb)), 0) t from m),
pv as (select *, atan(t / sqrt(df)) th from t), ps as (select prey, bool_or(bait = 'B0') ia, bool_or(bait = 'B1') ib from scored where score >= 0.5 and bait in ('B0', 'B1') group by 1)
select prey, round(ma, 4) mean_a, round(mb, 4) mean_b, round(case when ma > 0 and mb > 0 then log2(ma / mb) else 0 end, 6) log2_ratio,
  round(greatest(0, case df when 4 then 1 - sin(th) * (1 + cos(th) ** 2 / 2) when 3 then 1 - 2 / pi() * (th + sin(th) * cos(th)) when 2 then 1 - sin(th) end), 6) p_value,
  case when ia and ib then 'Both' when ia then 'A only' when ib then 'B only' else 'Neither' end category from pv left join ps using (prey)""")
def compared_baits(spark: SparkSession, sf: str) -> DataFrame:
    out = analytics.compare_baits(_values(spark, sf), views.design(spark, sf), scored_view(spark, sf), "B0", "B1", score=0.5)
    return out.select("prey", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round("log2_ratio", 6).alias("log2_ratio"), F.round("p_value", 6).alias("p_value"), "category")


@query(SCORED + """, a as (select distinct prey from scored where bait = 'B0'), b as (select distinct prey from scored where bait = 'B1')
select count(*) filter (b.prey is null) only_a, count(*) filter (a.prey is not null and b.prey is not null) "both", count(*) filter (a.prey is null) only_b from a full join b on a.prey = b.prey""")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_view(spark, sf)
    return analytics.set_overlap(rows.where("bait = 'B0'"), rows.where("bait = 'B1'"))


_ENRICHED = SCORED + """, ft as (select distinct prey, regexp_replace(trim(f), '\\s*[0-9]+$', '') feature from (select prey, unnest(string_split(features, ';')) f from prey where prey in (select prey from scored)) where trim(f) <> ''),
fu as (select feature, count(*) k_all from ft group by 1 having count(*) >= 5), hi as (select distinct bait, prey from scored where score >= 0.6), hn as (select bait, count(*) n from hi group by 1),
hk as (select bait, feature, count(*) k from hi join ft using (prey) group by 1, 2 having count(*) >= 2), ma as (select count(distinct prey) m_all from scored),
e1 as (select bait, feature, k, n, k_all, m_all, (k / n) / (k_all / m_all) enrichment from hk join fu using (feature) join hn using (bait), ma),
e2 as (select bait, feature, k, n, k_all, m_all, enrichment, least(1, sum(exp(lgamma(k_all + 1) - lgamma(i + 1) - lgamma(k_all - i + 1) + lgamma(m_all - k_all + 1) - lgamma(n - i + 1) - lgamma(m_all - k_all - n + i + 1)
  - lgamma(m_all + 1) + lgamma(n + 1) + lgamma(m_all - n + 1)))) p from (select *, unnest(range(greatest(k, n + k_all - m_all), least(n, k_all) + 1)) i from e1) group by all),
e3 as (select *, rank() over (partition by bait order by round(p, 12)) + count(*) over (partition by bait, round(p, 12)) - 1 r, count(*) over (partition by bait) c from e2),
e4 as (select *, least(1, min(p * c / r) over (partition by bait order by p desc)) adj_p from e3)
"""


@query(_ENRICHED + "select bait, feature, k, n, k_all, m_all, round(enrichment, 6) enrichment, round(p, 6) p_value, round(adj_p, 6) adj_p from e4")
def enriched_features(spark: SparkSession, sf: str) -> DataFrame:
    listed = views.preys(spark, sf).select("prey", F.lit("part").alias("feature_type"), "features")
    return rounded(analytics.enrichment(scored_view(spark, sf), listed, 0.6).select("bait", "feature", "k", "n", "k_all", "m_all", "enrichment", "p_value", "adj_p"))


@query(_ENRICHED + """, gd as (select * from e4 where adj_p <= 0.9 and enrichment >= 1.01), tp as (select feature from gd group by 1 order by count(distinct bait) desc, feature limit 30)
select feature, """ + ", ".join(f"round(log2(greatest(1, coalesce(max(case when bait = 'B{b}' then enrichment end), 1))), 6) B{b}" for b in range(8)) + " from gd join tp using (feature) group by 1")
def enrichment_matrix(spark: SparkSession, sf: str) -> DataFrame:
    listed = views.preys(spark, sf).select("prey", F.lit("part").alias("feature_type"), "features")
    rows = analytics.enrichment(scored_view(spark, sf), listed, 0.6)
    return rounded(analytics.enrichment_matrix(rows, 0.9, 1.01, baits=[f"B{b}" for b in range(8)]))


def _folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query('select experiment, bait, prey, spc "value" from inter')
def scoring_files(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring inputs written as headerless TSVs and read again."""
    folder = _folder(spark)
    inter = views.interactions(spark, sf).withColumn("value", F.col("spc"))
    writers.write_scoring_inputs(views.design(spark, sf), views.preys(spark, sf), inter, folder)
    return readers.read_scoring_inputs(spark, f"{folder}/bait", f"{folder}/prey", f"{folder}/interaction")[2].select("experiment", "bait", "prey", "value")


@query(_KEPT + "select experiment, prey, spc \"value\" from inter where substr(prey, 2)::bigint % 50 <> 0")
def protein_group_files(spark: SparkSession, sf: str) -> DataFrame:
    """A wide protein table written as a MaxQuant TSV, read again and melted; the design likewise as CSV."""
    folder, wide, design = _folder(spark), _wide(spark, sf), views.design(spark, sf)
    names = {v: k for k, v in readers.MAXQUANT_COLUMNS.items()}
    wide.select(*[F.col(c).alias(names.get(c, f"Intensity {c}")) for c in wide.columns]).write.csv(f"{folder}/groups", sep="\t", header=True, quote="'")
    design.select(F.col("experiment").alias("Experiment Name"), F.col("type").alias("Type"), F.col("bait").alias("Bait"), F.col("replicate").alias("Replicate"), F.col("bait_id").alias("Bait ID"), F.col("grp").alias("Group")).write.csv(f"{folder}/design", header=True)
    return pipeline.load(spark, "maxquant", f"{folder}/groups", readers.read_design(spark, f"{folder}/design"))[0].select("experiment", "prey", "value")


def _run_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith("E")]


@query('select experiment, prey, spc "value" from inter')
def diann_files(spark: SparkSession, sf: str) -> DataFrame:
    """A wide matrix written and read as DIA-NN's."""
    folder, wide = _folder(spark), _wide(spark, sf)
    wide.select(F.col("prey").alias("Protein.Group"), F.col("gene").alias("Genes"), *_run_columns(wide)).write.csv(f"{folder}/matrix", sep="\t", header=True)
    return pipeline.load(spark, "diann", f"{folder}/matrix", views.design(spark, sf))[0].select("experiment", "prey", "value")


@query(_KEPT + "select experiment, prey, spc \"value\" from inter where substr(prey, 2)::bigint % 50 <> 0")
def fragpipe_files(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table written and read as FragPipe's; contaminants by their prefix."""
    folder, wide = _folder(spark), _wide(spark, sf)
    protein = F.when(F.col("contaminant") == "+", F.concat(F.lit("contam_"), "prey")).otherwise(F.col("prey"))
    quants = [F.col(c).alias(f"{c} Intensity") for c in _run_columns(wide)] + [F.lit(1.0).alias(f"{c} MaxLFQ Intensity") for c in _run_columns(wide)]
    wide.select(protein.alias("Protein"), F.col("prey").alias("Protein ID"), F.col("gene").alias("Gene"), F.col("length").alias("Protein Length"), *quants).write.csv(f"{folder}/table", sep="\t", header=True)
    return pipeline.load(spark, "fragpipe", f"{folder}/table", views.design(spark, sf))[0].select("experiment", "prey", "value")


@query("""select 'P' || l_partkey prey, 'E' || l_suppkey % 10 || '_' || (l_orderkey % 3 + 1) experiment, round(2 ** avg(log2(l_extendedprice)), 3) "value" from lineitem where l_linestatus = 'O' and l_quantity > 5
  and l_suppkey % 10 <> 7 group by 1, 2""")
def msstats_files(spark: SparkSession, sf: str) -> DataFrame:
    """Protein-level rows written and read as MSstats'; runs of one bait are not in the design."""
    folder, lines = _folder(spark), views.table(spark, sf, "lineitem")
    lines.select(
        F.expr("concat('P', l_partkey)").alias("Protein"), F.when(F.col("l_linestatus") == "O", "L").otherwise("H").alias("LABEL"), F.when(F.col("l_quantity") > 5, F.log2("l_extendedprice")).alias("LogIntensities"),
        F.expr("concat('E', l_suppkey % 10, '_', l_orderkey % 3 + 1)").alias("originalRUN"), F.lit("g").alias("GROUP"), F.lit("s").alias("SUBJECT"), F.lit(0.5).alias("MissingPercentage"),
    ).write.csv(f"{folder}/levels", header=True)
    return rounded(pipeline.load(spark, "msstats", f"{folder}/levels", views.design(spark, sf).where("bait <> 'B7'"))[0], 3)


@query("""select GROUP_ "GROUP", n from (select l_returnflag GROUP_, count(*)::varchar n from lineitem group by 1)""")
def sidecar_files(spark: SparkSession, sf: str) -> DataFrame:
    """The quality sidecar keeps the columns that it knows."""
    folder, lines = _folder(spark), views.table(spark, sf, "lineitem")
    writers.write_sidecar(lines.groupBy(F.col("l_returnflag").alias("GROUP")).agg(F.count(F.lit(1)).alias("NumMeasuredFeature"), F.max("l_tax").alias("other")), f"{folder}/qc")
    return spark.read.csv(f"{folder}/qc", header=True).select("GROUP", F.col("NumMeasuredFeature").alias("n"))


@query(""", te as (select distinct replace(child, ' ', '_') child, replace(parent, ' ', '_') parent, kind from term_edges) select child, parent, kind, n_children from te join (select parent, count(*) n_children from te group by 1) using (parent)""")
def ontology_files(spark: SparkSession, sf: str) -> DataFrame:
    """An ontology written as stanzas, with an obsolete term and a parent of another namespace, and read as edges."""
    folder = _folder(spark)
    rows = views.term_edges(spark, sf).select(*[F.translate(c, " ", "_").alias(c) for c in ("child", "parent", "kind")]).distinct()
    line = F.when(F.col("kind") == "isa", F.concat(F.lit("is_a: "), "parent", F.lit(" ! x"))).otherwise(F.concat(F.lit("relationship: part_of "), "parent", F.lit(" ! y")))
    head = lambda term, space: F.concat(F.lit("[Term]\nid: "), term, F.lit(f"\nnamespace: {space}\n"))
    stanzas = rows.groupBy("child").agg(F.concat(head(F.col("child"), "n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\nis_a: ELSEWHERE ! z")).alias("value")).select("value")
    more = spark.range(1).select(F.explode(F.array(head(F.lit("ROOT"), "n"), head(F.lit("ELSEWHERE"), "m"), F.concat(head(F.lit("OLD"), "n"), F.lit("is_a: ROOT\nis_obsolete: true")))).alias("value"))
    stanzas.union(more).write.text(f"{folder}/terms", lineSep="\n\n")
    return ontology.edges(readers.read_obo(spark, f"{folder}/terms")).select("child", "parent", "kind", "n_children")


@query(""", pt as (select 'P' || l_partkey first_id, count(*) n from lineitem group by 1), pr as (select 'P' || p_partkey first_id, p_type, p_brand, p_partkey, count(*) over (partition by p_type) c from part where p_partkey % 5 <> 0)
select first_id, n, case when c > 1 then p_type end location, p_brand || '; ' || p_type motif, p_brand || '; b' go_cellular from pt left join pr using (first_id)""")
def annotation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Protein annotations written with the file's column names, read and joined by the first id."""
    folder, part = _folder(spark), views.table(spark, sf, "part").where("p_partkey % 5 <> 0")
    part.select(
        F.expr("concat('P', p_partkey)").alias("Entry"), F.concat(F.lit("SUBCELLULAR LOCATION: "), "p_type", F.lit(" {ECO:1}; x")).alias("Subcellular location [CC]"),
        F.concat(F.lit('MOTIF 1..2; /note="'), "p_brand", F.lit('"; /note="'), "p_type", F.lit('"')).alias("Motif"), F.concat("p_brand", F.lit(" [GO:0000001]; b [GO:0000002]")).alias("Gene Ontology (cellular component)"),
    ).write.csv(f"{folder}/proteins", sep="\t", header=True)
    proteins = annotate.clean_proteins(readers.read_annotations(spark, "proteins", f"{folder}/proteins"))
    rows = views.table(spark, sf, "lineitem").groupBy(F.expr("concat('P', l_partkey)").alias("first_id")).agg(F.count(F.lit(1)).alias("n"))
    return annotate.join_proteins(rows, proteins).select("first_id", "n", "location", "motif", "go_cellular")


@query("""select 'whole' file, 'experiment_not_in_data' rule, 'X1' "key" union all select 'whole', 'warning_experiment_not_in_design', experiment from ed where experiment = 'E0_1'
union all select 'cut', 'missing_column', 'Reverse' from (select 1 from ed limit 1) union all select 'cut', 'empty_data', null""")
def input_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A design with an experiment too many and one too few against a whole protein table, and one without rows and a column."""
    wide, names = _wide(spark, sf), {v: k for k, v in readers.MAXQUANT_COLUMNS.items()}
    whole = wide.select(*[F.col(c).alias(names.get(c, f"Intensity {c}")) for c in wide.columns])
    one = views.design(spark, sf).where("experiment = 'E0_2'").withColumn("experiment", F.lit("X1"))
    design = views.design(spark, sf).where("experiment <> 'E0_1'").unionByName(one)
    found = [validate.validate_inputs(design, t, "maxquant").select(F.lit(name).alias("file"), "rule", "key") for name, t in (("whole", whole), ("cut", whole.drop("Reverse").where("false")))]
    return found[0].unionByName(found[1])


@query("""select case when substr(experiment, 2, 1) = '9' then 'unknown experiment' when substr(prey, 2)::bigint % 7 = 0 then 'unknown prey' end problem, case when bait in ('B8') then 'C' when bait <> 'B9' then 'T' end "type", count(*) n,
  count(*) filter (substr(prey, 2)::bigint % 7 <> 0) n_gene from inter group by 1, 2""")
def indexed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a design without one bait and preys without every seventh, sorted into known and unknown."""
    design, preys = views.design(spark, sf).where("bait <> 'B9'"), views.preys(spark, sf).where("cast(substring(prey, 2) as long) % 7 <> 0")
    good, bad = scoring.index_interactions(_counts(spark, sf), design, preys)
    rows = good.withColumn("problem", F.lit(None).cast("string")).unionByName(bad)
    return rows.groupBy("problem", "type").agg(F.count(F.lit(1)).alias("n"), F.count("gene").alias("n_gene"))


@query("""select prey, sum((spc > 40)::int) >= 0.5 * (select count(*) from ed where "type" = 'T') frequent from inter join ed using (experiment) where "type" = 'T' group by 1""")
def frequent_preys(spark: SparkSession, sf: str) -> DataFrame:
    test = views.design(spark, sf).where("type = 'T'").select("experiment")
    return scoring.frequent_preys(_counts(spark, sf).join(test, "experiment").withColumn("z", F.col("value") > 40))


@query("""select bait experiment, replicate, coalesce(bait_id, bait) bait, prey, gene, spc "count" from (select i.experiment, i.prey, i.spc, e.bait, e.bait_id, e.replicate from inter i left join (select * from ed where bait <> 'B9') e using (experiment)) left join prey using (prey)""")
def wd_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The wd table from scoring inputs, whose design lacks one bait."""
    return ingest.wd_from_scoring_inputs(_counts(spark, sf), views.design(spark, sf).where("bait <> 'B9'"), views.preys(spark, sf))


@query("""select count(*) n, 0::bigint reverse, 0::bigint only_by_site, count(*) filter (substr(prey, 2)::bigint % 50 = 0) contaminant from (select distinct prey from inter)""")
def flagged_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flagged_counts(_wide(spark, sf))


@query(SCORED + "select prey, score from scored where bait = 'B3' and score >= 0.4 and bfdr <= 0.5")
def bait_network(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.bait_network(scored_view(spark, sf), "B3", score=0.4, bfdr=0.5).select("prey", "score")


def _semantics_sql(name: str, where: str) -> str:
    """Semantic values (sv), totals (tt) and pair similarities of one part of the terms, by suffix."""
    n = name
    return f""", et_{n} as (select distinct * from term_edges where {where}),
ew_{n} as (select child, parent, max(1 / (0.67 + n) + case kind when 'isa' then 0.4 else 0.3 end) w from et_{n} join (select parent, count(*) n from et_{n} group by 1) using (parent) group by 1, 2),
pa_{n} as (select term, term anc, 1.0::double v from (select child term from et_{n} union select parent from et_{n}) union all select p.term, ew_{n}.parent, p.v * ew_{n}.w from pa_{n} p join ew_{n} on ew_{n}.child = p.anc),
sv_{n} as (select term, anc, max(v) v from pa_{n} group by 1, 2), tt_{n} as (select term, sum(v) t from sv_{n} group by 1),
xy_{n} as (select a, b, x.term x, y.term y from gp join prey_terms x on x.prey = a join prey_terms y on y.prey = b join tt_{n} t on t.term = x.term join tt_{n} u on u.term = y.term),
ss_{n} as (select x, y, coalesce((select sum(p.v + q.v) from sv_{n} p join sv_{n} q using (anc) where p.term = x and q.term = y), 0) / ((select t from tt_{n} where term = x) + (select t from tt_{n} where term = y)) s from (select distinct x, y from xy_{n})),
rw_{n} as (select a, b, x, y, s from xy_{n} join ss_{n} using (x, y)), bs_{n} as (select a, b, x t, max(s) s from rw_{n} group by 1, 2, 3 union all select a, b, y, max(s) from rw_{n} group by 1, 2, 3),
bm_{n} as (select a, b, max(s) over (partition by a, b, t) s from bs_{n}), si_{n} as (select a, b, round(avg(s), 6) s from bm_{n} group by 1, 2)"""


@query(SCORED + ", gp as (select distinct bait_id a, prey b from scored where score >= 0.75)" + _semantics_sql("p", "child not like 'W:%'") + _semantics_sql("f", "child like 'W:%'") + """
select coalesce(p.a, f.a) a, coalesce(p.b, f.b) b, p.s process, f.s "function", coalesce(p.s, f.s) "first" from si_p p full join si_f f on p.a = f.a and p.b = f.b""")
def similarity_by_ontology(spark: SparkSession, sf: str) -> DataFrame:
    """Gene pairs in two ontologies side by side: types and brands, and words."""
    space = F.when(F.col("child").startswith("W:"), "f").otherwise("p")
    raw = views.term_edges(spark, sf).distinct().select(space.alias("namespace"), "child", "parent", "kind")
    counts = raw.groupBy("namespace", "parent").agg(F.count(F.lit(1)).alias("n_children"))
    values = ontology.semantic_values(ontology.weigh(raw.join(counts, ["namespace", "parent"])))
    pairs = scored_view(spark, sf).where("score >= 0.75").select(F.col("bait_id").alias("a"), F.col("first_id").alias("b")).distinct()
    terms = views.prey_terms(spark, sf).withColumnRenamed("prey", "gene")
    return ontology.by_ontology(ontology.gene_similarity(values, terms, pairs, digits=6), {"p": "process", "f": "function"})


@query(SCORED + """, sx as (select score, wd, s::double s, coalesce(1 - wd_fdr, 0) q, is_known from scored), """ + ", ".join(
    f"""r{c} as (select sum(count(*) filter (not is_known)) over w / sum(count(*) filter (not is_known)) over () f, sum(count(*) filter (is_known)) over w / sum(count(*) filter (is_known)) over () t
  from sx group by {c} window w as (order by {c} desc rows between unbounded preceding and current row)), o_{c} as (select 0.0::double f, 0.0::double t union all select f, t from r{c}),
v{c} as (select round(sum(a), 6) auc from (select (f - lag(f) over (order by f, t)) * (t + lag(t) over (order by f, t)) / 2 a from o_{c}))""" for c in ("score", "wd", "s", "q")
) + "".join(f" {'union all' if k else ''} select '{c}' score, auc from v{c}" for k, c in enumerate(("score", "wd", "s", "q"))))
def roc_auc_of_all_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The area for each of four score columns: posterior, wd, value and a rate, whose small values count."""
    rows = cut(scored_view(spark, sf).withColumn("rate", F.coalesce("wd_fdr", F.lit(1.0))))
    out = None
    for name, column, down in (("score", "score", True), ("wd", "wd", True), ("s", "s", True), ("q", "rate", False)):
        area = analytics.auc(analytics.roc_curve(rows, column, down)).select(F.lit(name).alias("score"), F.round("auc", 6).alias("auc"))
        out = area if out is None else out.union(area)
    return out


@query(_count_sql(False) + """, vl as (select prey, bait, string_agg(coalesce(round(y, 2)::double::varchar, '.'), '|' order by experiment) "values", avg(y) mean_value from dens group by 1, 2),
vc as (select prey, string_agg(round(spc, 2)::double::varchar, '|' order by spc desc) ctrl_values, avg(spc) mean_control from inter join ed using (experiment) where "type" = 'C' group by 1)
select prey, bait, "values", ctrl_values, round(mean_control, 6) mean_control, round(mean_value, 6) mean_value from vl left join vc using (prey)""")
def reported_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The report's replicates and controls as pipe lists, and their means by parsing them again."""
    out = score_counts.score(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf), rounds=3)
    rows = analytics.evidence_class(out.withColumn("multivalidated", F.lit(False)).withColumn("is_known", F.lit(False)))
    own = text.intensities(F.col("values"))
    mean = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))
    return rounded(rows.select("prey", "bait", "values", "ctrl_values", "mean_control", mean.alias("mean_value")))


@query(_members(True) + """, gr as (select g, prey, d.bait, sum(spc) s from inter join d using (experiment) where "type" = 'T' group by 1, 2, 3),
gm as (select g, count(*) filter ("type" = 'T') n_test, count(*) filter ("type" = 'C') n_control from d group by 1)
select g source_group, n_test, n_control, count(*) n_pairs, round(sum(s), 2)::double total, min(prey) first_prey from gr join gm using (g) group by all""")
def group_files(spark: SparkSession, sf: str) -> DataFrame:
    """Results by group and their summary, written and read again."""
    members = groups.memberships(views.design(spark, sf))
    rows = groups.scope_to_groups(_counts(spark, sf), members.where("type = 'T'"))
    pairs = rows.join(F.broadcast(members.select("experiment", "bait").distinct()), "experiment").groupBy("source_group", "bait", "prey").agg(F.sum("value").alias("s"))
    folder = _folder(spark)
    writers.write_groups(pairs, members, folder)
    totals = spark.read.parquet(f"{folder}/groups").groupBy("source_group").agg(F.round(F.sum("s"), 2).cast("double").alias("total"), F.min("prey").alias("first_prey"))
    return spark.read.schema("source_group int, n_test long, n_control long, n_pairs long").json(f"{folder}/summary").join(totals, "source_group")


@query("""select e.bait "Experiment.ID", e.replicate "Replicate", coalesce(bait_id, e.bait) "Bait", prey "Prey", gene "Prey.Name", spc::double "Spectral.Count" from inter i join ed e using (experiment) left join prey using (prey)""")
def wd_input_files(spark: SparkSession, sf: str) -> DataFrame:
    """The wd table with the older tool's column names, written and read again."""
    path = f"{_folder(spark)}/wd"
    writers.write_wd_input(ingest.wd_from_scoring_inputs(_counts(spark, sf), views.design(spark, sf), views.preys(spark, sf)), path)
    return spark.read.csv(path, header=True, schema="`Experiment.ID` string, Replicate int, Bait string, Prey string, `Prey.Name` string, `Spectral.Count` double")


@query(SCORED + "select bait, prey, score, wd, round(bfdr, 6) bfdr, 2::bigint n from scored")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """A scored table written as Parquet and as CSV, both read again and compared."""
    folder, rows = _folder(spark), scored_view(spark, sf).select("bait", "prey", "score", "wd", F.round("bfdr", 6).alias("bfdr"))
    writers.write_table(rows, f"{folder}/parquet")
    writers.write_table(rows, f"{folder}/csv", "csv")
    both = spark.read.parquet(f"{folder}/parquet").union(spark.read.csv(f"{folder}/csv", header=True, schema="bait string, prey string, score double, wd double, bfdr double"))
    return both.groupBy("bait", "prey", "score", "wd", "bfdr").agg(F.count(F.lit(1)).alias("n"))


@query("""select case when name = '' then 'empty_name' else 'invalid_name' end rule, name as key, null::varchar detail from (select case when c_custkey % 7 = 0 then '' when c_custkey % 5 = 0 then c_name else replace(c_name, '#', '_') end name from customer)
  where not regexp_matches(name, '^[A-Za-z0-9_]+$') union all select 'name_in_use', n, null from (select case when c_custkey % 7 <> 0 and c_custkey % 5 <> 0 then replace(c_name, '#', '_') end n, c_custkey from customer) where n is not null and c_custkey % 11 = 0""")
def name_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names as names of runs: some empty, some with other characters, some in use."""
    rows = views.table(spark, sf, "customer")
    good = F.translate("c_name", "#", "_")
    name = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(good)
    used = rows.where("c_custkey % 11 = 0 and c_custkey % 7 <> 0 and c_custkey % 5 <> 0").select(good.alias("name"))
    return validate.validate_name(rows.select(name.alias("name")), used)


@query()
def full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Files in, annotated scores out: the pipeline over scoring inputs, with known pairs and proteins."""
    folder, design = _folder(spark), cut(views.design(spark, sf))
    inter = views.interactions(spark, sf).withColumn("value", F.col("intensity"))
    writers.write_scoring_inputs(design, views.preys(spark, sf), inter, folder)
    design.select(F.col("experiment").alias("Experiment Name"), F.col("type").alias("Type"), F.col("bait").alias("Bait"), F.col("replicate").alias("Replicate"), F.col("bait_id").alias("Bait ID"), F.col("grp").alias("Group")).write.csv(f"{folder}/design", header=True)
    part = views.table(spark, sf, "part")
    proteins = part.select(F.expr("concat('P', p_partkey)").alias("entry"), F.expr("concat('G', p_partkey)").alias("names"), F.concat(F.lit("SUBCELLULAR LOCATION: "), "p_type").alias("location"), F.col("p_partkey").alias("ordinal"))
    known = views.known_of(spark, sf, design.select(F.col("bait_id").alias("pb"))).select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("n") >= 2).alias("multivalidated"))
    return pipeline.run(spark, "scoring", folder, f"{folder}/design", annotations={"proteins": proteins, "known": known})
