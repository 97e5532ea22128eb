"""The domain feature sets on tables derived from the test tables, and line sources."""

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import relational as R
from ledgerlens.operators import encode as E
from ledgerlens.plans import card_default, churn, credit, esg, fraud, insurance, screening
from ledgerlens.plans.catalog.relational import DAILY, ORDER, PAYMENTS, daily_log, payments, statements
from ledgerlens.plans.catalog.transactions import TRAIN_BEFORE, orders_with_customer, train
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage
from ledgerlens.sources import tables as SRC


# --- credit -----------------------------------------------------------------

BORROWERS = """b AS (SELECT c_custkey AS borrower_id, c_nationkey, c_acctbal/6000 AS RevolvingUtil, 15+c_nationkey*4 AS age, coalesce(spent,0)/1e6 AS DebtRatio, abs(c_acctbal) AS MonthlyIncome,
 coalesce(n,0) AS NumOpenLoans, length(c_mktsegment)-8 AS NumRealEstate, CASE WHEN c_nationkey>5 THEN c_nationkey-5 END AS NumDependents,
 CASE WHEN c_nationkey=3 THEN 96 WHEN c_nationkey=4 THEN 98 ELSE coalesce(f,0) END AS DPD_30_59, CASE WHEN c_nationkey=3 THEN 96 ELSE coalesce(o,0) END AS DPD_60_89, CASE WHEN c_nationkey=9 THEN NULL ELSE coalesce(p,0) END AS DPD_90plus
 FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o, count(*) FILTER (o_orderstatus='P') AS p FROM orders GROUP BY 1) ON o_custkey=c_custkey)"""


def borrowers(t):
    status = F.col("o_orderstatus")
    per = t.orders.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(status == s).alias(s.lower()) for s in "FOP"])
    rows = R.attach(t.customer, per, {"c_custkey": "o_custkey"})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    nation = F.col("c_nationkey")
    return rows.select(
        F.col("c_custkey").alias("borrower_id"), "c_nationkey", (F.col("c_acctbal") / 6000).alias("RevolvingUtil"), (15 + nation * 4).alias("age"),
        (zero("spent") / 1e6).alias("DebtRatio"), F.abs("c_acctbal").alias("MonthlyIncome"), zero("n").alias("NumOpenLoans"),
        (F.length("c_mktsegment") - 8).alias("NumRealEstate"), F.when(nation > 5, nation - 5).alias("NumDependents"),
        F.when(nation == 3, 96).when(nation == 4, 98).otherwise(zero("f")).alias("DPD_30_59"),
        F.when(nation == 3, 96).otherwise(zero("o")).alias("DPD_60_89"), F.when(nation != 9, zero("p")).alias("DPD_90plus"))


_code = lambda c: f"coalesce(CASE WHEN {c} NOT IN (96,98) THEN least({c}::DOUBLE, 10.0) END, 0.0)"
_AGE = "least(greatest(age::DOUBLE,18.0),100.0)"


@query("credit_features", "P2 P4 P5 P8 P11 P12 P13 P14 P26 R7", f"""
WITH {BORROWERS}, q AS (SELECT quantile_cont(DebtRatio,0.999) AS dc, quantile_cont(MonthlyIncome,0.999) AS ic FROM b WHERE c_nationkey<20),
c AS (SELECT borrower_id, age, NumOpenLoans, NumRealEstate, coalesce(NumDependents,0) AS nd, {_code('DPD_30_59')} AS d30, {_code('DPD_60_89')} AS d60, {_code('DPD_90plus')} AS d90,
  CAST(coalesce(DPD_30_59 IN (96,98),false) OR coalesce(DPD_60_89 IN (96,98),false) OR coalesce(DPD_90plus IN (96,98),false) AS INTEGER) AS fe_dpd_unknown,
  CAST(RevolvingUtil>1 AS INTEGER) AS fe_over_limit, least(greatest(RevolvingUtil,0),1) AS u, least(greatest(DebtRatio,0),dc) AS debt, least(greatest(MonthlyIncome,0),ic) AS inc, dc*ic AS cap FROM b, q)
SELECT borrower_id, fe_dpd_unknown, fe_over_limit, ln(1+inc) AS "fe_log_MonthlyIncome", ln(1+debt) AS "fe_log_DebtRatio", d30+d60+d90 AS fe_total_dpd, d30+2*d60+3*d90 AS fe_dpd_severity,
 CAST(d30+d60+d90>0 AS INTEGER) AS fe_any_delinquency, CAST(d90>=2 AS INTEGER) AS fe_chronic_default, {_AGE}**2 AS fe_age_sq, CAST({_AGE} BETWEEN 35 AND 55 AS INTEGER) AS fe_prime_earner,
 CAST({_AGE}>=65 AS INTEGER) AS fe_senior, CAST({_AGE}<30 AS INTEGER) AS fe_young, CASE WHEN {_AGE}<30 THEN 0 WHEN {_AGE}<40 THEN 1 WHEN {_AGE}<50 THEN 2 WHEN {_AGE}<60 THEN 3 WHEN {_AGE}<70 THEN 4 ELSE 5 END AS fe_age_bucket,
 u*u AS fe_util_sq, CAST(u>0.75 AS INTEGER) AS fe_high_util, CAST(u=0 AS INTEGER) AS fe_zero_util, least(debt*inc,cap) AS fe_dti_proxy, inc/(nd+1) AS fe_income_per_dep, NumOpenLoans*1.0/(NumRealEstate+1) AS fe_loans_per_estate,
 u*(d30+d60+d90) AS fe_util_x_dpd FROM c""",
       "fe_log_MonthlyIncome fe_log_DebtRatio fe_total_dpd fe_dpd_severity fe_age_sq fe_util_sq fe_dti_proxy fe_income_per_dep fe_loans_per_estate fe_util_x_dpd")
def credit_features(t):
    rows = credit.clean(borrowers(t))
    out = credit.features(rows, credit.fit(rows.where("c_nationkey < 20")))
    return out.select("borrower_id", *[c for c in out.columns if c.startswith("fe_")])


@query("credit_imputed", "I3 P21")
def credit_imputed(t):
    holed = borrowers(t).withColumn("MonthlyIncome", F.when(F.col("c_nationkey") < 20, F.col("MonthlyIncome")))
    cleaned = cut_lineage(credit.clean(holed))  # read by the donors, the queries and the result
    rows = cut_lineage(credit.impute(cleaned, "borrower_id"))  # read by the fit and by the features
    out = credit.features(rows, credit.fit(rows))
    return out.select("borrower_id", "MonthlyIncome", *[c for c in out.columns if c.startswith("fe_")])


# --- churn ------------------------------------------------------------------

MEMBERS = """m AS (SELECT c_custkey AS msno, c_nationkey AS city, c_mktsegment AS registered_via, CASE WHEN 2+c_nationkey*5 BETWEEN 7 AND 100 THEN 2+c_nationkey*5 END AS bd,
 coalesce(CASE WHEN c_nationkey<8 THEN 'male' WHEN c_nationkey<16 THEN 'female' END,'unknown') AS gender, CAST(c_acctbal<0 AS INTEGER) AS is_churn FROM customer)"""
SUBS = f"""
pay AS (SELECT user_id AS msno, count(*) AS txn_count, avg(days) AS plan_days_mean, avg(listed) AS plan_price_mean, avg(paid) AS actual_paid_mean, avg(renew) AS auto_renew_rate, avg(cancel) AS cancel_rate FROM {PAYMENTS} GROUP BY 1),
lg AS (SELECT user_id AS msno, count(*) AS log_days, avg(num_25) AS num_25_mean, avg(num_100) AS num_100_mean, avg(num_unq) AS num_unq_mean, avg(total_secs) AS total_secs_mean FROM {DAILY} GROUP BY 1),
s AS (SELECT * FROM m LEFT JOIN pay USING (msno) LEFT JOIN lg USING (msno))"""


def subscribers(t):
    nation = F.col("c_nationkey")
    labels = t.customer.select(F.col("c_custkey").alias("msno"), S.flag(F.col("c_acctbal") < 0).alias("is_churn"))
    members = churn.clean_members(t.customer.select(
        F.col("c_custkey").alias("msno"), nation.alias("city"), F.col("c_mktsegment").alias("registered_via"), (2 + nation * 5).alias("bd"),
        F.when(nation < 8, "male").when(nation < 16, "female").alias("gender")))
    pay = R.subscription_aggregate(payments(t), "user_id", "listed", "paid", "days", "renew", "cancel", "expires", "dated").withColumnRenamed("user_id", "msno")
    logs = R.log_aggregate(daily_log(t), "user_id", ["num_25", "num_100", "num_unq", "total_secs"]).withColumnRenamed("user_id", "msno")
    return churn.build(labels, members, pay, logs)


_SONGS = "nullif(coalesce(num_25_mean,0)+coalesce(num_100_mean,0),0)"
_share = lambda c: f"least(greatest(coalesce(coalesce({c},0)/{_SONGS},0),0),1)"


@query("churn_features", "P3 P35 P36 P37 J1 A1 A2", f"""
WITH {MEMBERS}, {SUBS}, med AS (SELECT quantile_cont(auto_renew_rate,0.5) AS r, quantile_cont(bd,0.5) AS a FROM s WHERE city<20), g AS (SELECT avg(is_churn) AS g FROM s WHERE city<20),
c AS (SELECT city, avg(is_churn) AS r FROM s WHERE city<20 GROUP BY 1), v AS (SELECT registered_via, avg(is_churn) AS r FROM s WHERE city<20 GROUP BY 1),
f AS (SELECT s.*, coalesce(CASE WHEN bd IS NOT NULL THEN least(greatest(bd::DOUBLE,7),80) END,a,30) AS fe_age, med.r AS mr, coalesce(c.r,g) AS fe_city_risk, coalesce(v.r,g) AS fe_reg_channel_risk FROM s LEFT JOIN c USING (city) LEFT JOIN v USING (registered_via), med, g)
SELECT msno, {_share('num_100_mean')} AS fe_completion_rate, {_share('num_25_mean')} AS fe_skip_rate, {_share('num_100_mean')} AS fe_deep_listen_rate, coalesce(num_unq_mean/({_SONGS}+1),0) AS fe_variety_ratio,
 ln(1+coalesce(total_secs_mean,0)) AS fe_log_secs, ln(1+coalesce(log_days,0)) AS fe_log_days_log, coalesce(total_secs_mean/(coalesce(num_unq_mean,0)+1),0) AS fe_secs_per_song,
 CAST(coalesce(actual_paid_mean<plan_price_mean,false) AS INTEGER) AS fe_is_discounted, least(greatest(coalesce((plan_price_mean-actual_paid_mean)/nullif(plan_price_mean,0),0),0),1) AS fe_discount_depth,
 CAST(coalesce(plan_days_mean>=30,false) AS INTEGER) AS fe_is_long_plan, ln(1+coalesce(plan_days_mean,0)) AS fe_plan_days_log, ln(1+coalesce(txn_count,0)) AS fe_txn_count_log, coalesce(auto_renew_rate,mr) AS fe_auto_renew, coalesce(cancel_rate,0) AS fe_cancel_rate,
 fe_age, CAST(fe_age<25 AS INTEGER) AS fe_age_bucket_young, CAST(fe_age>=45 AS INTEGER) AS fe_age_bucket_senior, CAST(gender='male' AS INTEGER) AS fe_is_male, CAST(gender='female' AS INTEGER) AS fe_is_female, fe_city_risk, fe_reg_channel_risk FROM f""",
       "fe_completion_rate fe_skip_rate fe_deep_listen_rate fe_variety_ratio fe_log_secs fe_log_days_log fe_secs_per_song fe_discount_depth fe_plan_days_log fe_txn_count_log fe_auto_renew fe_cancel_rate fe_age fe_city_risk fe_reg_channel_risk")
def churn_features(t):
    rows = subscribers(t)
    fit = rows.where("city < 20")
    medians = churn.fit(fit)
    out = churn.subscription(churn.engagement(rows), medians)
    out = churn.demographics(out, medians, E.fit_target_rate(fit, ["city"], "is_churn"), E.fit_target_rate(fit, ["registered_via"], "is_churn"))
    return out.select("msno", *[c for c in out.columns if c.startswith("fe_")])


@query("churn_plan_length", "A18 P26", f"""
WITH {MEMBERS}, {SUBS} SELECT CASE WHEN d>0 AND d<=7 THEN '<7d' WHEN d>7 AND d<=30 THEN '7-30d' WHEN d>30 AND d<=90 THEN '30-90d' WHEN d>90 AND d<=180 THEN '90-180d' WHEN d>180 AND d<=365 THEN '180-365d' WHEN d>365 AND d<=9999 THEN '>365d' END AS plan_bucket,
 count(*) AS n, CAST(sum(is_churn) AS BIGINT) AS hits, avg(is_churn) AS rate FROM (SELECT is_churn, coalesce(plan_days_mean,0) AS d FROM s) GROUP BY 1""", "rate")
def churn_plan_length(t):
    return churn.rate_by_plan_length(subscribers(t), "is_churn")


# --- insurance --------------------------------------------------------------

POLICIES = """raw AS (SELECT p_partkey AS id, CASE WHEN p_size<5 THEN -1 ELSE p_size END AS ps_ind_01, CAST(substr(p_brand,7) AS INTEGER) AS ps_ind_02_cat, CAST(p_type='SMALL' AS INTEGER) AS ps_ind_03_bin,
 p_retailprice/1000 AS ps_reg_01, CASE WHEN p_size>40 THEN -1.0 ELSE p_retailprice/900 END AS ps_reg_03, (p_retailprice-900)/100 AS ps_car_13, power(p_size,6)/1e6 AS ps_car_12, CASE WHEN p_size>45 THEN -1 ELSE length(p_type) END AS ps_car_02_cat,
 CAST(p_size>25 AS INTEGER) AS ps_car_03_bin, p_size*1.5 AS ps_calc_01, CAST(p_name LIKE 'red%' AS INTEGER) AS target FROM part),
pol AS (SELECT id, nullif(ps_ind_01,-1) AS ind1, ps_ind_02_cat AS ind2, ps_ind_03_bin AS ind3, ps_reg_01 AS reg1, nullif(ps_reg_03,-1) AS reg3, nullif(ps_car_13,-1) AS car13, ps_car_12 AS car12, nullif(ps_car_02_cat,-1) AS car2, ps_car_03_bin AS car3, target FROM raw)"""


def policies(t):
    size, price = F.col("p_size"), F.col("p_retailprice")
    raw = t.part.select(
        F.col("p_partkey").alias("id"), F.when(size < 5, -1).otherwise(size).alias("ps_ind_01"), F.substring("p_brand", 7, 10).cast("int").alias("ps_ind_02_cat"),
        S.flag(F.col("p_type") == "SMALL").alias("ps_ind_03_bin"), (price / 1000).alias("ps_reg_01"), F.when(size > 40, -1.0).otherwise(price / 900).alias("ps_reg_03"),
        ((price - 900) / 100).alias("ps_car_13"), (F.pow(size, F.lit(6)) / 1e6).alias("ps_car_12"), F.when(size > 45, -1).otherwise(F.length("p_type")).alias("ps_car_02_cat"),
        S.flag(size > 25).alias("ps_car_03_bin"), (size * 1.5).alias("ps_calc_01"), S.flag(F.col("p_name").startswith("red")).alias("target"))
    return insurance.without_sentinels(raw)


@query("insurance_features", "P1 P8 P12 P13 P21 P22 E2 F9 I1 I2", f"""
WITH {POLICIES}, q AS (SELECT quantile_cont(ind1,0.5) AS i1, quantile_cont(reg1,0.5) AS r1, quantile_cont(reg3,0.5) AS r3, quantile_cont(car13,0.5) AS c13, quantile_cont(car12,0.5) AS c12 FROM pol),
m AS (SELECT car2 AS cm FROM pol WHERE car2 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, car2 LIMIT 1), te AS (SELECT ind2, avg(target) AS r FROM pol GROUP BY 1),
f AS (SELECT id, CAST(ind1 IS NULL AS INTEGER) AS a, CAST(reg3 IS NULL AS INTEGER) AS b, CAST(car2 IS NULL AS INTEGER) AS c, coalesce(ind1,i1) AS ind1, ind3, car3, coalesce(reg1,r1) AS reg1, coalesce(reg3,r3) AS reg3, coalesce(car13,c13) AS car13, coalesce(car12,c12) AS car12,
  coalesce(car2,cm) AS car2, te.r FROM pol JOIN te USING (ind2), q, m)
SELECT id, a AS fe_miss_ps_ind_01, b AS fe_miss_ps_reg_03, c AS fe_miss_ps_car_02_cat, CAST(car2 AS INTEGER) AS ps_car_02_cat, r AS fe_te_ps_ind_02_cat, (a+b+c)::DOUBLE AS fe_n_missing, ind3::DOUBLE AS fe_n_bin_ind, car3::DOUBLE AS fe_n_bin_car, reg1+reg3 AS fe_reg_sum,
 ind1::DOUBLE AS fe_ind_cont_sum, car13*reg3 AS fe_car13_reg03, (a+b+c)*(reg1+reg3) AS fe_miss_x_reg, car13*car13 AS fe_car13_sq, ln(1+greatest(reg1,0)) AS fe_log_ps_reg_01, ln(1+greatest(reg3,0)) AS fe_log_ps_reg_03, ln(1+greatest(car12,0)) AS fe_log_ps_car_12 FROM f""",
       "fe_te_ps_ind_02_cat fe_n_missing fe_n_bin_ind fe_n_bin_car fe_reg_sum fe_ind_cont_sum fe_car13_reg03 fe_miss_x_reg fe_car13_sq fe_log_ps_reg_01 fe_log_ps_reg_03 fe_log_ps_car_12")
def insurance_features(t):
    rows = policies(t)
    out = insurance.Fitted(rows, "target").apply(rows)
    return out.select("id", "ps_car_02_cat", *[c for c in out.columns if c.startswith("fe_")])


# --- greenwashing -----------------------------------------------------------

COMPANIES = """co AS (SELECT s_suppkey AS company_id, n_name AS sector, 30+s_acctbal/300 AS e_score, 45+s_acctbal/500 AS s_score, 50.0 AS g_score, 45+s_acctbal/800 AS composite_esg, 62.0 AS reported_e, 58.0 AS reported_s, 40.0 AS reported_g,
 abs(s_acctbal)/100 AS market_cap_bn, s_acctbal/200 AS revenue_bn, s_acctbal/10 AS emissions_intensity FROM supplier JOIN nation ON s_nationkey=n_nationkey),
gp AS (SELECT *, reported_e-e_score AS e_gap, reported_s-s_score AS s_gap, reported_g-g_score AS g_gap, (reported_e-e_score+reported_s-s_score+reported_g-g_score)/3 AS avg_gap FROM co),
se AS (SELECT doc_id, CAST(lang='en' AS INTEGER) AS env_claim_label, s_suppkey AS company_id FROM (SELECT doc_id, lang, (row_number() OVER (ORDER BY doc_id)-1) % (SELECT count(*) FROM supplier)+1 AS slot FROM documents)
  JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS slot FROM supplier) USING (slot)),
x AS (SELECT *, CASE WHEN env_claim_label=1 THEN CASE WHEN avg_gap>20 THEN 'High' WHEN avg_gap>8 THEN 'Medium' ELSE 'Low' END ELSE CASE WHEN avg_gap>25 THEN 'Medium' ELSE 'Low' END END AS greenwashing_risk FROM se JOIN gp USING (company_id))"""


def disclosures(t):
    bal = F.col("s_acctbal")
    companies = R.attach(t.supplier, t.nation, {"s_nationkey": "n_nationkey"}, ["n_name"], "inner").select(
        F.col("s_suppkey").alias("company_id"), F.col("n_name").alias("sector"), (30 + bal / 300).alias("e_score"), (45 + bal / 500).alias("s_score"), F.lit(50.0).alias("g_score"),
        (45 + bal / 800).alias("composite_esg"), F.lit(62.0).alias("reported_e"), F.lit(58.0).alias("reported_s"), F.lit(40.0).alias("reported_g"),
        (F.abs(bal) / 100).alias("market_cap_bn"), (bal / 200).alias("revenue_bn"), (bal / 10).alias("emissions_intensity"))
    claims = t.documents.select("doc_id", S.flag(F.col("lang") == "en").alias("env_claim_label"))
    assigned = R.assign_round_robin(claims, "doc_id", companies, "company_id")
    rows = R.attach(assigned, esg.company_gaps(companies), "company_id", how="inner")
    return rows.withColumn("greenwashing_risk", esg.risk_label("env_claim_label", "avg_gap"))


@query("risk_labels", "P31 P32 J11", f"WITH {COMPANIES} SELECT doc_id, company_id, e_gap, s_gap, g_gap, avg_gap, greenwashing_risk FROM x", "e_gap s_gap g_gap avg_gap")
def risk_labels(t):
    return disclosures(t).select("doc_id", "company_id", "e_gap", "s_gap", "g_gap", "avg_gap", "greenwashing_risk")


_R = ["greatest(e_gap,0)", "greatest(s_gap,0)", "greatest(g_gap,0)"]
_RM = f"(({'+'.join(_R)})/3)"


@query("esg_features", "P13 P30 P38 P8 E2 E7 P12", f"""
WITH {COMPANIES}, rk AS (SELECT sector, avg(CASE greenwashing_risk WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END) AS r FROM x WHERE composite_esg<58 GROUP BY 1), dr AS (SELECT avg(r) AS d FROM rk),
tp AS (SELECT sector FROM x WHERE composite_esg<58 GROUP BY 1 ORDER BY count(*) DESC, sector LIMIT 8)
SELECT doc_id, greatest(e_gap,0) AS fe_e_gap_clipped, greatest(s_gap,0) AS fe_s_gap_clipped, greatest(g_gap,0) AS fe_g_gap_clipped, greatest(avg_gap,0) AS fe_avg_gap_clipped,
 coalesce(sqrt((({_R[0]}-{_RM})**2+({_R[1]}-{_RM})**2+({_R[2]}-{_RM})**2)/2)/nullif({_RM},0),0) AS fe_gap_cv, greatest({','.join(_R)}) AS fe_max_gap, (reported_e+reported_s+reported_g)/3-composite_esg AS fe_composite_delta,
 composite_esg AS fe_composite_esg, CAST(composite_esg<40 AS INTEGER) AS fe_esg_low, CAST(composite_esg>=70 AS INTEGER) AS fe_esg_high, e_score/100 AS fe_e_score_norm, s_score/100 AS fe_s_score_norm, g_score/100 AS fe_g_score_norm,
 ln(1+greatest(market_cap_bn,0)) AS fe_log_market_cap, ln(1+greatest(revenue_bn,0)) AS fe_log_revenue, ln(1+greatest(emissions_intensity,0)) AS fe_log_emissions, CAST(emissions_intensity>500 AS INTEGER) AS fe_emissions_high,
 CAST(sector NOT IN (FROM tp) AS INTEGER) AS "fe_sector_Other", coalesce(r,d) AS fe_sector_risk_te, env_claim_label*greatest(avg_gap,0) AS fe_claim_x_gap, greatest(avg_gap,0)*CAST(emissions_intensity>500 AS INTEGER) AS fe_gap_x_emissions
FROM x LEFT JOIN rk USING (sector), dr""",
       "fe_e_gap_clipped fe_s_gap_clipped fe_g_gap_clipped fe_avg_gap_clipped fe_gap_cv fe_max_gap fe_composite_delta fe_composite_esg fe_e_score_norm fe_s_score_norm fe_g_score_norm fe_log_market_cap fe_log_revenue fe_log_emissions fe_sector_risk_te fe_claim_x_gap fe_gap_x_emissions")
def esg_features(t):
    rows = disclosures(t)
    top, rates = esg.fit_sectors(rows.where("composite_esg < 58"))
    out = esg.structured_features(rows, top, rates)
    keep = [c for c in out.columns if c.startswith("fe_") and (not c.startswith("fe_sector_") or c in ("fe_sector_Other", "fe_sector_risk_te"))]
    return out.select("doc_id", *keep)


# --- screening --------------------------------------------------------------

RATIOS = ["pe_ratio", "pb_ratio", "roe", "net_margin", "ebitda_margin", "debt_equity", "debt_assets", "interest_coverage", "revenue_growth", "eps_growth"]
YEARLY = """y AS (SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, any_value(c_mktsegment) AS sector, avg(o_totalprice)/1e4 AS pe_ratio, max(o_totalprice)/1e5 AS pb_ratio, min(o_totalprice)/1e6 AS roe,
 count(*)*0.1 AS net_margin, CASE WHEN count(*)>1 THEN max(o_totalprice)/1e6 END AS ebitda_margin, any_value(c_acctbal)/1e4 AS debt_equity, any_value(c_nationkey)/25.0 AS debt_assets, count(*) FILTER (o_orderstatus='F')*1.0 AS interest_coverage,
 max(o_totalprice)/min(o_totalprice)-1 AS revenue_growth, count(*) FILTER (o_orderstatus='O')*0.2 AS eps_growth FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"""


def yearly(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return orders_with_customer(t).groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.any_value("c_mktsegment").alias("sector"), (F.avg(price) / 1e4).alias("pe_ratio"), (F.max(price) / 1e5).alias("pb_ratio"), (F.min(price) / 1e6).alias("roe"),
        (F.count(F.lit(1)) * 0.1).alias("net_margin"), F.when(F.count(F.lit(1)) > 1, F.max(price) / 1e6).alias("ebitda_margin"), (F.any_value("c_acctbal") / 1e4).alias("debt_equity"),
        (F.any_value("c_nationkey") / 25.0).alias("debt_assets"), (F.count_if(status == "F") * 1.0).alias("interest_coverage"),
        (F.max(price) / F.min(price) - 1).alias("revenue_growth"), (F.count_if(status == "O") * 0.2).alias("eps_growth"))


_CLIPPED = ", ".join(f"coalesce(CASE WHEN y.{c} IS NOT NULL THEN least(greatest(y.{c}, lo_{c}), hi_{c}) END, me_{c}) AS {c}" for c in RATIOS)
_STATS = ", ".join(f"quantile_cont({c},0.01) AS lo_{c}, quantile_cont({c},0.99) AS hi_{c}, quantile_cont({c},0.5) AS me_{c}" for c in RATIOS)


@query("screening_features", "P5 P12 P17 I1 E6", f"""
WITH {YEARLY}, st AS (SELECT {_STATS} FROM y WHERE fiscal_year<2000), c AS (SELECT ticker, fiscal_year, {_CLIPPED} FROM y, st), mx AS (SELECT greatest(max(pe_ratio),1) AS mp, greatest(max(pb_ratio),1) AS mb FROM c WHERE fiscal_year<2000)
SELECT ticker, fiscal_year, coalesce(CASE WHEN eps_growth<>0 THEN least(greatest(pe_ratio/(abs(eps_growth)*100+1),-50),50) END,0) AS peg_ratio, coalesce(1/(nullif(interest_coverage,0)+1),1) AS interest_burden, roe-debt_equity*0.1 AS quality_spread,
 -(pe_ratio/mp+pb_ratio/mb)/2 AS value_composite, (revenue_growth+eps_growth)/2 AS growth_composite, (roe+net_margin+ebitda_margin)/3 AS profitability_composite, debt_equity+debt_assets-interest_coverage*0.01 AS leverage_risk,
 CASE fiscal_year WHEN 1996 THEN 1 WHEN 1998 THEN -1 WHEN 2000 THEN 1 ELSE 0 END AS macro_regime, CAST(fiscal_year=1998 AS INTEGER) AS is_crisis_year, CAST(fiscal_year IN (1996,2000) AS INTEGER) AS is_bull_year FROM c, mx""",
       "peg_ratio interest_burden quality_spread value_composite growth_composite profitability_composite leverage_risk")
def screening_features(t):
    rows = yearly(t)
    fit = rows.where("fiscal_year < 2000")
    stats = screening.fit_ratios(fit, RATIOS)
    out = screening.composites(screening.clip_and_fill(rows, stats, RATIOS), screening.fit_maxima(screening.clip_and_fill(fit, stats, RATIOS)))
    out = screening.regime(out, regimes={1996: 1, 1998: -1, 2000: 1})
    return out.drop("sector", *RATIOS)


@query("cohort_rank", "W7 R3", """
WITH y AS (SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CASE WHEN count(*)>1 THEN max(o_totalprice) END AS pb FROM orders GROUP BY 1,2)
SELECT ticker, fiscal_year, coalesce(CASE WHEN pb IS NOT NULL THEN (rank() OVER (PARTITION BY fiscal_year ORDER BY pb NULLS LAST)+(count(*) OVER (PARTITION BY fiscal_year, pb)-1)/2.0)/count(pb) OVER (PARTITION BY fiscal_year) END, 0.5) AS pb__rank FROM y""", "pb__rank")
def cohort_rank(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(F.when(F.count(F.lit(1)) > 1, F.max("o_totalprice")).alias("pb"))
    return screening.ranks(rows, ["pb"]).drop("pb")


@query("screening_table", "W7 E6 P5 P12 P17")
def screening_table(t):
    rows = cut_lineage(yearly(t))  # read by four fits and by the features
    return screening.build(rows.where("fiscal_year < 2000"), rows, RATIOS)


# --- whole feature tables ---------------------------------------------------

@query("fraud_table", "P6 P9 P15 P18 P19 P20 P21 W1 A3 A4 E1 E3 E5 I1")
def fraud_table(t):
    rows = orders_with_customer(t).select(
        "o_orderkey", "o_orderdate", "o_totalprice", "label", "o_custkey", "c_nationkey", "c_mktsegment", "o_orderpriority",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("o_orderstatus") == "F", "T").when(F.col("o_orderstatus") == "O", "F").alias("M1"))
    schema = fraud.Schema(
        "o_orderkey", "o_orderdate", "o_totalprice", "label", "o_custkey", "c_nationkey", "c_mktsegment", "o_orderpriority", "1995-01-01",
        extra_cards=["c_mktsegment"], match_columns=["M1"], fill_columns=["balance"], label_columns=["o_orderpriority"], free_mail=["BUILDING"])
    rows = cut_lineage(rows)  # read by every fit and by the features
    return fraud.FraudFeatures(train(rows), schema).apply(rows)


@query("card_default_table", "A5 A6 A7 A8 W7 W9 E4 E5 P16 J9")
def card_default_table(t):
    rows = statements(t).join(t.events.select("event_id", "event_type"), "event_id")
    fit = rows.where("ts < timestamp_ntz '2024-01-16'")
    return card_default.StatementFeatures(fit, "user_id", ORDER, ["v", "b"], ["event_type"], ["v"]).apply(rows)


# --- line sources -----------------------------------------------------------

ROLES = {"user": 0, "assistant": 1}
_TRIM = "trim({0}, E' \\t\\r\\n')"


@query("lines_sentence_at_label", "S6 S8", f"""
SELECT conv_id, turn, {_TRIM.format('text')} AS sentence, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS label FROM conversations WHERE role IN ('user','assistant')""")
def lines_sentence_at_label(t):
    lines = t.conversations.select("conv_id", "turn", F.concat("text", F.lit(" @ "), F.upper("role"), F.lit(" ")).alias("value"))
    return SRC.parse_sentence_at_label(lines, ROLES)


@query("lines_label_comma_sentence", "S7", f"""
SELECT conv_id, turn, trim({_TRIM.format('text')}, '"') AS sentence, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS label FROM conversations WHERE role IN ('user','assistant') AND length(trim({_TRIM.format('text')}, '"'))>5""")
def lines_label_comma_sentence(t):
    lines = t.conversations.select("conv_id", "turn", F.concat(F.lit('"'), F.col("role"), F.lit('", '), F.col("text")).alias("value"))
    return SRC.parse_label_comma_sentence(lines, ROLES)


@query("clean_sentences", "S10", f"""
SELECT doc_id, {_TRIM.format('text')} AS text, CAST(quality AS INTEGER) AS quality FROM documents JOIN labels USING (doc_id) WHERE length({_TRIM.format('text')})>5""")
def clean_sentences(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("quality"))
    return SRC.clean_sentences(rows, "text", "quality")


@query("tagged_union", "S9 U1 U4", f"""
SELECT split, count(*) AS n, sum(o_totalprice) AS total FROM (SELECT o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '{TRAIN_BEFORE}' THEN 'train' ELSE 'val' END AS split FROM orders) GROUP BY 1""", "total")
def tagged_union(t):
    orders = t.orders
    early, late = train(orders), orders.where(F.col("o_orderdate") >= F.lit(TRAIN_BEFORE).cast("timestamp_ntz"))
    both = early.withColumn("split", F.lit("train")).unionByName(late.drop("o_orderpriority").withColumn("split", F.lit("val")), allowMissingColumns=True)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("aligned_columns", "P23 P24", "SELECT c_custkey, c_acctbal, 0.0::DOUBLE AS missing_feature FROM customer", "c_acctbal missing_feature")
def aligned_columns(t):
    df = C.drop_matching(t.customer, names=["c_nationkey"], non_numeric=True)
    return C.align_columns(df, [*C.numeric_columns(df), "missing_feature"])


@query("converted_values", "P25", """
SELECT page_id, TRY_CAST(split_part(url,'/',5) AS DOUBLE) AS part FROM pages""", "part")
def converted_values(t):
    return t.pages.select("page_id", S.number_or_null(F.split_part("url", F.lit("/"), F.lit(5))).alias("part"))
