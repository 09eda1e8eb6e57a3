"""The registered queries once more, as plain SQL over the source tables.

Written from the definitions and independent of the package: only the note
sentences and the lists of names are shared with it.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pdengine import fixed_values as fv
from pdengine.catalog import DELINQUENCY_STEP, MEMO_EPOCH, UTILIZATION_STEP
from pdengine.plans.fixed_model import BASE_HAZARD, HAZARD, TREES
from pdengine.sources.note_templates import NEGATIVE, NEUTRAL, POSITIVE

K = range(1, 7)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(_text(t) for t in texts) + "]"


def _u(m: int, key: str = "b") -> str:
    return f"((({key}) * {m} + 104729) % 10007) / 10007.0::DOUBLE"


ACCOUNTS = f"""
ranked AS (
  SELECT o_custkey, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
  FROM orders),
six AS (
  SELECT * FROM ranked
  WHERE k <= 6 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 6)),
money AS (
  SELECT l_orderkey, l_linestatus, l_returnflag,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS amount
  FROM lineitem),
per_order AS (
  SELECT l_orderkey, CAST(sum(amount) AS DOUBLE) AS bill,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN amount END) AS DOUBLE) AS paid,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
  FROM money GROUP BY l_orderkey),
cycles AS (
  SELECT o_custkey AS b, k, coalesce(bill, 0) AS bill, coalesce(paid, 0) AS paid,
         CASE WHEN returned IS NULL THEN -2 WHEN returned = 0 THEN -1
              ELSE least(returned - 1, 8) END AS status
  FROM six LEFT JOIN per_order ON o_orderkey = l_orderkey),
wide AS (
  SELECT b, max(bill) AS top_bill,
  {", ".join(f"max(status) FILTER (k = {k}) AS PAY_{k}" for k in K)},
  {", ".join(f"max(bill) FILTER (k = {k}) AS BILL_AMT{k}" for k in K)},
  {", ".join(f"max(paid) FILTER (k = {k}) AS PAY_AMT{k}" for k in K)}
  FROM cycles GROUP BY b),
accounts0 AS (
  SELECT b, ceil(top_bill / 50000) * 50000 AS LIMIT_BAL, 1 + b % 2 AS SEX, c_nationkey % 7 AS EDUCATION,
         b % 4 AS MARRIAGE, 21 + (b * 31) % 55 AS AGE, wide.* EXCLUDE (b, top_bill),
         {" + ".join(f"(CASE WHEN PAY_{k} > 0 THEN 1 ELSE 0 END)" for k in K)} AS late,
         greatest({", ".join(f"PAY_{k}" for k in K)}) AS worst
  FROM wide JOIN customer ON c_custkey = b),
accounts AS (
  SELECT * EXCLUDE (late, worst),
         CASE WHEN 0.08::DOUBLE * late + 0.04::DOUBLE * greatest(worst, 0)
                   + 0.05::DOUBLE * greatest(PAY_1 - PAY_6, 0) + {_u(7919)} > 1.05::DOUBLE
              THEN 1 ELSE 0 END AS "default"
  FROM accounts0)"""


def _features(source: str, name: str, pays: str = "PAY_{k}", bills: str = "BILL_AMT{k}") -> str:
    """Engineered columns over ``source``; the patterns name the shocked inputs."""
    p = [pays.format(k=k) for k in K]
    a = [bills.format(k=k) for k in K]
    ratios = [f"(PAY_AMT{k} / nullif({b}, 0))" for k, b in zip(K, a)]
    total = " + ".join(f"coalesce({r}, 0)" for r in ratios)
    n = " + ".join(f"(CASE WHEN {b} <> 0 THEN 1 ELSE 0 END)" for b in a)
    mean_bill = f"(({' + '.join(a)}) / 6)"

    def clip(x, low, high):
        return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"

    return f"""
{name} AS (
  SELECT *,
    {clip(f"coalesce({a[0]} / nullif(LIMIT_BAL, 0), 0)", -2, 5)} AS util_ratio_1,
    {clip(f"coalesce({mean_bill} / nullif(LIMIT_BAL, 0), 0)", -2, 5)} AS avg_util_ratio,
    coalesce(({total}) / nullif({n}, 0), 0) AS pay_ratio_train,
    {clip(f"coalesce(({total}) / nullif({n}, 0), 0)", -5, 5)} AS avg_pay_ratio,
    {" + ".join(f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in p)} AS months_delinquent,
    greatest({", ".join(p)}) AS max_delinquency,
    {p[0]} - {p[5]} AS delinquency_trend,
    {a[0]} - {a[5]} AS bill_trend
  FROM {source})"""


def _segment_case() -> str:
    def pick(weights):
        reached, parts = 0.0, []
        for name, w in zip(fv.SEGMENTS[:-1], weights):
            reached = round(reached + w, 2)
            parts.append(f"WHEN {_u(6571)} < {reached}::DOUBLE THEN {_text(name)}")
        return f"CASE {' '.join(parts)} ELSE {_text(fv.SEGMENTS[-1])} END"

    cases = " ".join(f"WHEN {i} THEN {pick(w)}" for i, w in fv.SEGMENT_WEIGHTS.items())
    return f"CASE coalesce(limit_bin, 0) {cases} ELSE {pick(fv.OTHER_SEGMENT_WEIGHTS)} END"


def _note_case() -> str:
    def template(texts):
        return f"{_list(texts)}[CAST(floor({_u(3571)} * {len(texts)}) AS INTEGER) + 1]"

    def pct(low, span):
        return f"CAST({low} + CAST(floor({_u(2689)} * {span}) AS INTEGER) AS VARCHAR)"

    bad = f"replace(replace({template(NEGATIVE)}, '{{n}}', CAST(greatest(months_delinquent, 1) AS VARCHAR)), '{{pct}}', {pct(15, 30)})"
    good = f"replace({template(POSITIVE)}, '{{pct}}', {pct(5, 20)})"
    return f"""CASE WHEN delinquency_trend > 0 OR months_delinquent >= 3 THEN {bad}
                    WHEN delinquency_trend < 0 AND months_delinquent = 0 THEN {good}
                    ELSE {template(NEUTRAL)} END"""


RECODE = """
cleaned AS (
  SELECT * REPLACE (CASE WHEN EDUCATION IN (0, 5, 6) THEN 4 ELSE EDUCATION END AS EDUCATION,
                    CASE WHEN MARRIAGE = 0 THEN 3 ELSE MARRIAGE END AS MARRIAGE)
  FROM accounts)"""

BOOK = f"""
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(LIMIT_BAL, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM accounts),
binned AS (
  SELECT f.*, len(list_filter(e[2:-2], lambda x: x < LIMIT_BAL)) AS limit_bin FROM features f, edges),
book AS (
  SELECT *, b AS borrower_id, {_segment_case()} AS segment,
    round_even(LIMIT_BAL * (0.3::DOUBLE + greatest(0::DOUBLE, least(1.5::DOUBLE, avg_util_ratio))) * 100, 0) / 100 AS exposure_at_risk,
    {_note_case()} AS rm_note,
    CASE {" ".join(f"WHEN PAY_{k} > 0 THEN {k}" for k in K)} ELSE 6 END AS duration,
    "default" AS event,
    1 + CAST(floor({_u(6185)} * 12) AS INTEGER) AS loan_vintage_month,
    CASE WHEN 1 + CAST(floor({_u(6185)} * 12) AS INTEGER) <= 9 THEN 'train' ELSE 'test' END AS split
  FROM binned)"""


def _scores(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *,
    round(1 / (1 + exp(2::DOUBLE - 0.5::DOUBLE * months_delinquent - 0.2::DOUBLE * max_delinquency
                       - 0.8::DOUBLE * avg_util_ratio + 0.6::DOUBLE * avg_pay_ratio)), 6) AS frozen_gbm,
    round(1 - exp(-0.3::DOUBLE * exp(0.25::DOUBLE * months_delinquent + 0.15::DOUBLE * delinquency_trend)), 6) AS frozen_cox
  FROM {source})"""


def _ranks(source: str, name: str) -> str:
    """Strictly-less counts against the train scores, by joining per-value running counts."""
    parts = []
    for kind in ("gbm", "cox"):
        parts.append(f"""
{name}_{kind} AS (
  SELECT v, least(coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
                  (SELECT count(*) FROM frozen WHERE split = 'train') - 1)
            / ((SELECT count(*) FROM frozen WHERE split = 'train') - 1)::DOUBLE AS r
  FROM (SELECT v, sum(c) AS c FROM (
          SELECT frozen_{kind} AS v, 1 AS c FROM frozen WHERE split = 'train'
          UNION ALL SELECT frozen_{kind}, 0 FROM {source}) GROUP BY v))""")
    return ",".join(parts) + f""",
{name} AS (
  SELECT s.*, g.r AS gbm_rank, c.r AS cox_rank, 0.7::DOUBLE * g.r + 0.3::DOUBLE * c.r AS blend,
         round(100 * (0.7::DOUBLE * g.r + 0.3::DOUBLE * c.r), 4) AS pd_score
  FROM {source} s JOIN {name}_gbm g ON s.frozen_gbm = g.v JOIN {name}_cox c ON s.frozen_cox = c.v)"""


def _banded(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN pd_score >= high THEN 'High' WHEN pd_score >= elevated THEN 'Elevated' ELSE 'Watch' END AS band
  FROM {source}, cuts)"""


CUTS = """
cuts AS (
  SELECT quantile_cont(pd_score, 0.9) AS high, quantile_cont(pd_score, 0.7) AS elevated
  FROM fused WHERE split = 'train')"""

BASE = "WITH " + ACCOUNTS
FEATURES = BASE + "," + RECODE + "," + _features("cleaned", "features")
WITH_BOOK = FEATURES + "," + BOOK
SCORED = (
    WITH_BOOK + "," + _scores("book", "frozen") + "," + _ranks("frozen", "fused") + "," + CUTS + ","
    + _banded("fused", "scored")
)


def _shocked(scenario: str) -> str:
    if scenario == "utilization_shock":
        moved = f"SELECT * REPLACE ({', '.join(f'BILL_AMT{k} * {1 + UTILIZATION_STEP / 100}::DOUBLE AS BILL_AMT{k}' for k in K)}) FROM cleaned"
    else:
        moved = f"SELECT * REPLACE ({', '.join(f'least(PAY_{k} + {DELINQUENCY_STEP}::DOUBLE, 8) AS PAY_{k}' for k in K)}) FROM cleaned"
    return f", moved AS ({moved})," + _features("moved", "shocked")


def _stress(scenario: str) -> str:
    return (
        SCORED + _shocked(scenario) + "," + _scores("shocked", "shocked_scores") + ","
        + _ranks("shocked_scores", "shocked_fused") + "," + _banded("shocked_fused", "after") + """,
transitions AS (
  SELECT s.band AS band_before, a.band AS band_after, count(*) AS n_loans,
         CAST(sum(CAST(exposure_at_risk AS DECIMAL(18,2))) AS DOUBLE) AS exposure
  FROM scored s JOIN after a USING (b) GROUP BY 1, 2),
by_stage AS (
  SELECT 'before' AS stage, band_before AS band, sum(n_loans)::BIGINT AS n_loans, round(sum(exposure), 2) AS exposure
  FROM transitions GROUP BY 2
  UNION ALL
  SELECT 'after', band_after, sum(n_loans)::BIGINT, round(sum(exposure), 2) FROM transitions GROUP BY 2),
newly AS (
  SELECT coalesce(sum(n_loans) FILTER (band_before <> 'High' AND band_after = 'High'), 0)::BIGINT AS newly_high_count,
         round(coalesce(sum(exposure) FILTER (band_before <> 'High' AND band_after = 'High'), 0), 2) AS newly_high_exposure,
         round(sum(exposure), 2) AS total_exposure
  FROM transitions)"""
    )


ACTION = "CASE band WHEN 'High' THEN {High} WHEN 'Elevated' THEN {Elevated} ELSE {Watch} END".format(
    **{b: _text(t) for b, t in fv.ACTIONS.items()}
)

REASON = """
CASE
 WHEN feature IN ('PAY_1','PAY_2','PAY_3','PAY_4','PAY_5','PAY_6') THEN
   'Repayment status in ' || cycle || CASE WHEN value > 0 THEN ' shows a ' || n || '-month delay' ELSE ' was on time' END
 WHEN feature = 'months_delinquent' THEN n || ' of the last 6 billing cycles were delinquent'
 WHEN feature = 'max_delinquency' THEN CASE WHEN value <= 0 THEN 'No delinquency recorded in the observed window'
   ELSE 'Worst delinquency reached ' || n || ' month(s) overdue' END
 WHEN feature = 'delinquency_trend' THEN CASE WHEN value > 0 THEN 'Repayment status has worsened by ' || n
   ELSE 'Repayment status has improved by ' || CAST(CAST(trunc(-value) AS BIGINT) AS VARCHAR) END || ' point(s) over the last 6 cycles'
 WHEN feature = 'avg_util_ratio' THEN 'Average credit utilization is ' || CASE WHEN amount > 0 THEN 'elevated' ELSE 'moderate' END
   || ' at ' || pct || ' of limit'
 WHEN feature = 'util_ratio_1' THEN 'Most recent billing cycle utilization at ' || pct || ' of limit'
 WHEN feature = 'avg_pay_ratio' THEN CASE WHEN amount > 0 THEN 'Payments covering only ' || pct || ' of the billed amount on average'
   ELSE 'Payments consistently covering ' || pct || ' of the billed amount' END
 WHEN feature = 'bill_trend' THEN CASE WHEN value > 0 THEN 'Outstanding bill has grown by Rs ' || format('{:,.0f}', value)
   ELSE 'Outstanding bill has declined by Rs ' || format('{:,.0f}', 0.0 - value) END || ' over the observed window'
 WHEN feature = 'LIMIT_BAL' THEN 'Sanctioned credit limit of ' || rs
 WHEN feature = 'AGE' THEN 'Borrower age ' || n
 WHEN feature = 'segment' THEN 'Exposure is on ' || CASE category WHEN 'SME' THEN 'an SME lending' WHEN 'Agri' THEN 'an agricultural lending'
   WHEN 'Retail Personal' THEN 'a retail personal loan' WHEN 'Credit Card' THEN 'a credit card'
   WHEN 'Consumer Durable' THEN 'a consumer durable loan' ELSE category END || ' product line, which carries a different baseline risk'
 WHEN feature IN ('SEX','EDUCATION','MARRIAGE') THEN 'Demographic profile factor (' || lower(feature) || ' category ' || category || ')'
 WHEN starts_with(feature, 'nlp_emb_') THEN 'RM note content pushed the score ' || CASE WHEN amount > 0 THEN 'higher' ELSE 'lower' END
   || ': "' || rm_note || '"'
 WHEN starts_with(feature, 'BILL_AMT') THEN 'Outstanding bill in ' || cycle || ' was ' || rs
 WHEN starts_with(feature, 'PAY_AMT') THEN 'Payment made in ' || cycle || ' was ' || rs
 ELSE replace(feature, '_', ' ') || ' = ' || CAST(value AS VARCHAR) END"""


def _reasoned(source: str, name: str) -> str:
    """Sentences for rows ``(feature, value, category, amount, rm_note, ...)``."""
    return f"""
{name} AS (
  SELECT *, {REASON} AS reason FROM (
    SELECT *, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS n, format('{{:.0f}}%', 100 * value + 0.0) AS pct,
           'Rs ' || format('{{:,.0f}}', value + 0.0) AS rs,
           CASE right(feature, 1) WHEN '1' THEN 'the most recent billing cycle'
                ELSE right(feature, 1) || ' billing cycles ago' END AS cycle
    FROM {source}))"""


TERMS = """
terms AS (
  SELECT b, rm_note, unnest(['months_delinquent','max_delinquency','avg_util_ratio','avg_pay_ratio']) AS feature,
         unnest([months_delinquent::DOUBLE, max_delinquency, avg_util_ratio, avg_pay_ratio]) AS value,
         unnest([0.5::DOUBLE * months_delinquent, 0.2::DOUBLE * max_delinquency, 0.8::DOUBLE * avg_util_ratio,
                 -0.6::DOUBLE * avg_pay_ratio]) AS amount, NULL::VARCHAR AS category
  FROM book),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY abs(amount) DESC, feature) AS place FROM terms)"""

EXPLAINED = (
    SCORED + "," + TERMS + "," + _reasoned("placed", "reasoned") + """,
explained AS (
  SELECT s.*, r.reasons FROM scored s JOIN (
    SELECT b, list(reason ORDER BY place) AS reasons FROM reasoned GROUP BY b) r USING (b)),
memo AS (
  SELECT *, round(pd_score, 1) AS pd1, """ + ACTION + """ AS act,
    list_transform(reasons[1:2], lambda t: lower(rtrim(t, '.')[1]) || rtrim(t, '.')[2:]) AS drivers
  FROM explained),
memos AS (
  SELECT *, 'Borrower ' || b || ' (' || segment || ' segment, exposure at risk Rs ' || format('{:,.0f}', exposure_at_risk)
    || ') is currently scored ' || format('{:.0f}', pd1) || '/100, placing the account in the ' || band
    || ' band. This is primarily driven by: ' || array_to_string(drivers, '; ') || '. ' || act AS summary
  FROM memo)"""
)


def _all_reasons() -> str:
    names = fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES + ["nlp_emb_0", "limit_bin"]
    selects = []
    for i, n in enumerate(names):
        amount = f"CASE WHEN (b + {i}) % 2 = 0 THEN 1.0 ELSE -1.0 END AS amount"
        if n in fv.CATEGORICAL_FEATURES:
            value = f"NULL::DOUBLE AS value, CAST({n} AS VARCHAR) AS category"
        elif n == "nlp_emb_0":
            value = "NULL::DOUBLE AS value, NULL::VARCHAR AS category"
        else:
            value = f"CAST({n} AS DOUBLE) AS value, NULL::VARCHAR AS category"
        selects.append(f"SELECT borrower_id, '{n}' AS feature, {value}, {amount}, rm_note FROM book")
    return WITH_BOOK + ", long AS (" + " UNION ALL ".join(selects) + ")," + _reasoned("long", "reasoned")


APPLICATIONS = f"""
applications AS (
  SELECT b AS application_id, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 40 AS DOUBLE) AS loan_amount, CASE WHEN b % 11 > 0 THEN 15 + (b * 31) % 90 END AS age,
    CASE WHEN b % 13 > 0 THEN (b * 7) % 400 END AS tenure_months,
    CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) * (1 + b % 7)::INTEGER AS DOUBLE) AS existing_emi, ((b * 13) % 320)::DOUBLE AS credit_utilization_pct,
    CASE WHEN b % 17 > 0 THEN ['clean','minor_delay','moderate_delay','severe_delinquency','unknown'][b % 5 + 1] END AS repayment_history,
    CASE b % 4 WHEN 0 THEN '' WHEN 1 THEN 'SME' WHEN 2 THEN 'Agri' ELSE c_mktsegment END AS segment,
    CASE WHEN b % 6 > 0 THEN {_list(NEUTRAL)}[b % {len(NEUTRAL)} + 1] END AS rm_note
  FROM (SELECT c_custkey AS b, * FROM customer)),
checked AS (
  SELECT *, [CASE WHEN loan_amount > 0 THEN NULL ELSE 'loan_amount' END,
             CASE WHEN coalesce(age BETWEEN 18 AND 100, true) THEN NULL ELSE 'age' END,
             CASE WHEN coalesce(tenure_months BETWEEN 1 AND 360, true) THEN NULL ELSE 'tenure_months' END,
             CASE WHEN existing_emi >= 0 THEN NULL ELSE 'existing_emi' END,
             CASE WHEN credit_utilization_pct BETWEEN 0 AND 300 THEN NULL ELSE 'credit_utilization_pct' END,
             CASE WHEN coalesce(repayment_history, 'clean') IN ('clean','minor_delay','moderate_delay','severe_delinquency')
                  THEN NULL ELSE 'repayment_history' END] AS problems
  FROM applications),
fine AS (SELECT * FROM checked WHERE len(list_filter(problems, lambda p: p IS NOT NULL)) = 0)"""

CODE = "CASE coalesce(repayment_history, 'clean') WHEN 'clean' THEN -1.0::DOUBLE WHEN 'minor_delay' THEN 1 WHEN 'moderate_delay' THEN 2 ELSE 4 END"

MODES = ", ".join(
    f"(SELECT {c} FROM book GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in fv.CATEGORICAL_FEATURES
)

WHAT_IF = WITH_BOOK + f""",
asked AS (
  SELECT *, CASE WHEN b % 5 IN (0, 1, 4) THEN floor({_u(3571)} * 61) END AS new_rate_pct,
    CASE WHEN b % 5 IN (0, 2) THEN 1 + CAST(floor({_u(3571)} * 360) AS INTEGER) END AS new_tenure_months,
    CASE WHEN b % 5 IN (2, 3) THEN round(LIMIT_BAL * ({_u(3571)} + 0.1::DOUBLE), 2) END AS new_principal,
    CASE WHEN b % 5 = 4 THEN round(LIMIT_BAL * ({_u(3571)}) / 10, 2) END AS new_emi
  FROM book),
priced AS (
  SELECT *, coalesce(new_principal, BILL_AMT1) AS principal, coalesce(new_rate_pct, 12) / 100 / 12 AS r,
         coalesce(new_tenure_months, 12) AS t FROM asked),
applied AS (
  SELECT *, coalesce(new_emi, CASE WHEN new_rate_pct IS NOT NULL OR new_tenure_months IS NOT NULL THEN
      CASE WHEN r = 0 THEN principal / t ELSE principal * r * pow(1 + r, t) / (pow(1 + r, t) - 1) END END) AS applied_emi
  FROM priced),
modified AS (
  SELECT b, LIMIT_BAL, applied_emi, new_principal,
    {", ".join(f"PAY_{k}" for k in K)},
    {", ".join(f"coalesce(new_principal, BILL_AMT{k}) AS BILL_AMT{k}" for k in K)},
    {", ".join(f"coalesce(applied_emi, PAY_AMT{k}) AS PAY_AMT{k}" for k in K)}
  FROM applied),""" + _features("modified", "changed")

METRICS = SCORED + """,
t AS (SELECT pd_score AS s, "default" AS y, b FROM scored WHERE split = 'test'),
per AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY s),
cum AS (
  SELECT *, coalesce(sum(p) OVER below, 0) AS lp, coalesce(sum(n) OVER below, 0) AS ln,
         sum(p) OVER () AS tp, sum(n) OVER () AS tn
  FROM per WINDOW below AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
auc AS (SELECT sum(p * (ln + n / 2)) / (max(tp)::DOUBLE * max(tn)) AS auc,
               max(abs(ln / tn::DOUBLE - lp / tp::DOUBLE)) AS ks, max(tp)::BIGINT AS tp, max(tp + tn)::BIGINT AS cnt FROM cum),
tops AS (SELECT y, row_number() OVER (ORDER BY s DESC, b) AS r FROM t),
rec AS (
  SELECT greatest(1, CAST(floor((SELECT count(*) FROM t) * 0.2::DOUBLE) AS BIGINT)) AS n_top),
recall AS (
  SELECT n_top, (SELECT sum(y) FROM tops WHERE r <= n_top)::BIGINT AS hits,
         (SELECT sum(y) FROM tops WHERE r <= n_top) / (SELECT sum(y) FROM tops)::DOUBLE AS recall FROM rec)"""

PAYS, BILLS, PAID = ", ".join(fv.PAY_COLS), ", ".join(fv.BILL_COLS), ", ".join(fv.PAY_AMT_COLS)
RAW = f"LIMIT_BAL, SEX, EDUCATION, MARRIAGE, AGE, {PAYS}, {BILLS}, {PAID}"
ENGINEERED = ", ".join(fv.ENGINEERED_COLS)
ROUNDED_ENGINEERED = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in fv.ENGINEERED_COLS)
COX_NUMERIC = [c for c in fv.COX_COVARIATES if c not in fv.TEXT_FEATURES]
DESCRIBED = fv.PAY_COLS + fv.ENGINEERED_COLS + ["duration", "event"]
SHARES = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST("{c}" AS VARCHAR) AS value, count(*) AS n,
        round(count(*) / (SELECT count(*) FROM scored)::DOUBLE, 8) AS share FROM scored GROUP BY "{c}" """
    for c in ("default", "segment", "band")
)


def _z(c: str) -> str:
    return (
        f"round(({c} - (SELECT avg({c}) FROM book WHERE split = 'train')) / "
        f"(SELECT stddev_samp({c}) FROM book WHERE split = 'train'), 6) AS z_{c}"
    )


ORACLES = {
    "src_accounts": BASE + f' SELECT b AS borrower_id, {RAW}, "default" FROM accounts',
    "account_rejects": BASE + """ SELECT CAST(b AS VARCHAR) AS id, 'LIMIT_BAL' AS column_name, 'n/a' AS cell FROM accounts WHERE b % 50 = 7
        UNION ALL SELECT CAST(b AS VARCHAR), 'PAY_0', 'late' FROM accounts WHERE b % 60 = 3""",
    "book_scan": WITH_BOOK + f" SELECT borrower_id, {', '.join(fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES)} FROM book",
    "clean_recode": BASE + "," + RECODE + " SELECT b AS borrower_id, SEX, EDUCATION, MARRIAGE FROM cleaned",
    "feature_engineering": FEATURES + f" SELECT b AS borrower_id, {ENGINEERED} FROM features",
    "pay_ratio_train": FEATURES + " SELECT b AS borrower_id, pay_ratio_train AS avg_pay_ratio FROM features",
    "pay_ratio_serve": FEATURES + " SELECT b AS borrower_id, avg_pay_ratio FROM features",
    "exposure": WITH_BOOK + " SELECT borrower_id, exposure_at_risk FROM book",
    "survival_columns": WITH_BOOK + " SELECT borrower_id, duration, event FROM book",
    "zscore": WITH_BOOK + f" SELECT borrower_id, {', '.join(_z(c) for c in COX_NUMERIC)} FROM book",
    "blend": SCORED + " SELECT borrower_id, round(gbm_rank, 8) AS gbm_rank, round(cox_rank, 8) AS cox_rank, round(blend, 8) AS blend, pd_score FROM scored",
    "assign_band": SCORED + " SELECT borrower_id, pd_score, band FROM scored",
    "recommended_action": SCORED + f" SELECT borrower_id, band, {ACTION} AS recommended_action FROM scored",
    "emi": WITH_BOOK + """, t AS (SELECT borrower_id, BILL_AMT1 AS principal, (b % 25)::DOUBLE AS rate_pct,
        1 + b % 360 AS tenure_months, (b % 25)::DOUBLE / 100 / 12 AS r FROM book)
        SELECT borrower_id, principal, rate_pct, tenure_months, round_even(1e6 * CASE WHEN r = 0 THEN principal / tenure_months
          ELSE principal * r * pow(1 + r, tenure_months) / (pow(1 + r, tenure_months) - 1) END, 0) / 1e6 AS emi FROM t""",
    "new_loan_rows": "WITH " + APPLICATIONS + f""" SELECT application_id, loan_amount AS LIMIT_BAL, coalesce(age, 35) AS AGE,
        {", ".join(f"{CODE} AS PAY_{k}" for k in K)},
        {", ".join(f"credit_utilization_pct / 100 * loan_amount AS BILL_AMT{k}" for k in K)},
        {", ".join(f"existing_emi AS PAY_AMT{k}" for k in K)},
        nullif(segment, '') AS segment, coalesce(rm_note, '') AS rm_note FROM fine""",
    "fill_defaults": WITH_BOOK + "," + APPLICATIONS + f""", modes AS (SELECT {MODES})
        SELECT application_id, SEX, EDUCATION, MARRIAGE, coalesce(nullif(fine.segment, ''), modes.segment) AS segment
        FROM fine, modes""",
    "request_rejects": "WITH " + APPLICATIONS + """ SELECT application_id, reason FROM (
        SELECT application_id, unnest(problems) AS reason FROM checked) WHERE reason IS NOT NULL""",
    "reason_text": _all_reasons() + " SELECT borrower_id, feature, reason FROM reasoned",
    "memo_summary": EXPLAINED + " SELECT borrower_id, summary FROM memos",
    "memo_records": EXPLAINED + f""" SELECT b || '_{MEMO_EPOCH}' AS memo_id, borrower_id, segment,
        exposure_at_risk, pd1 AS pd_score, band, array_to_string(reasons, ' | ') AS reason_codes,
        act AS recommended_intervention, summary,
        replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS summary_xml,
        strftime(to_timestamp({MEMO_EPOCH}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' AS generated_at FROM memos""",
    "escape_text": "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents",
    "watchlist": SCORED + """ SELECT borrower_id, segment, round(pd_score, 1) AS pd_score, band, exposure_at_risk
        FROM scored WHERE segment = 'SME' AND band = 'High'""",
    "oot_split": WITH_BOOK + " SELECT borrower_id, loan_vintage_month, split FROM book",
    "newly_high": _stress("delinquency_shock") + """ SELECT *, round(newly_high_exposure / 1e7, 2) AS newly_high_crore,
        round(total_exposure / 1e7, 1) AS total_crore FROM newly""",
    "loan_lookup": SCORED + """ SELECT borrower_id, segment, pd_score, band FROM scored
        WHERE borrower_id IN (SELECT o_custkey FROM orders)""",
    "loan_missing": SCORED + """ SELECT DISTINCT o_custkey AS borrower_id FROM orders
        WHERE o_custkey NOT IN (SELECT borrower_id FROM scored)""",
    "book_join_scores": SCORED + ' SELECT borrower_id, segment, exposure_at_risk, "default", split, pd_score FROM scored',
    "stress_transition": _stress("delinquency_shock") + " SELECT * FROM transitions",
    "rank_reference": SCORED + """ SELECT borrower_id, frozen_gbm, frozen_cox, round(gbm_rank, 8) AS gbm_rank,
        round(cox_rank, 8) AS cox_rank FROM scored""",
    "cox_risk": WITH_BOOK + "," + _scores("book", "frozen") + " SELECT borrower_id, frozen_cox FROM frozen",
    "default_rate_overall": WITH_BOOK + """ SELECT count(*) AS n_loans, sum("default")::BIGINT AS n_defaults,
        round(avg("default"), 8) AS default_rate FROM book""",
    "default_rate_by_split": WITH_BOOK + """ SELECT split, count(*) AS n_loans, sum("default")::BIGINT AS n_defaults,
        round(avg("default"), 8) AS default_rate FROM book GROUP BY split""",
    "default_rate_by_pay1": WITH_BOOK + """ SELECT PAY_1, count(*) AS n_loans, sum("default")::BIGINT AS n_defaults,
        round(avg("default"), 8) AS default_rate FROM book GROUP BY PAY_1""",
    "describe_features": WITH_BOOK + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c})::DOUBLE AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
            {", ".join(f"round(quantile_cont({c}::DOUBLE, {q / 100}), 4) AS q{q}" for q in (25, 50, 75))} FROM book"""
        for c in DESCRIBED
    ),
    "corr_with_default": WITH_BOOK + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(corr("{c}", "default"), 8) AS corr FROM book"""
        for c in fv.RAW_NUMERIC_COLS + ["default"]
    ),
    "value_shares": SCORED + " " + SHARES,
    "category_modes": WITH_BOOK + f" SELECT {MODES}",
    "book_summary": SCORED + f""" SELECT total_exposure, round(total_exposure / 1e7, 1) AS total_exposure_crore,
        total_borrowers, n_watch, n_elevated, n_high, segments, high_cut, elevated_cut, {MEMO_EPOCH}::DOUBLE AS last_scored_at FROM (
        SELECT CAST(sum(CAST(exposure_at_risk AS DECIMAL(18,2))) AS DOUBLE) AS total_exposure, count(*) AS total_borrowers,
          count(*) FILTER (band = 'Watch') AS n_watch, count(*) FILTER (band = 'Elevated') AS n_elevated,
          count(*) FILTER (band = 'High') AS n_high, string_agg(DISTINCT segment, '|' ORDER BY segment) AS segments,
          round(max(high), 4) AS high_cut, round(max(elevated), 4) AS elevated_cut FROM scored)""",
    "segment_band_rollup": SCORED + """ SELECT coalesce(segment, 'ALL') AS segment, coalesce(band, 'ALL') AS band,
        count(*) AS n_loans, CAST(sum(CAST(exposure_at_risk AS DECIMAL(18,2))) AS DOUBLE) AS exposure
        FROM scored GROUP BY ROLLUP (segment, band)""",
    "stress_by_band": _stress("delinquency_shock") + " SELECT * FROM by_stage",
    "band_compare": _stress("delinquency_shock") + """ SELECT position, v.band,
          coalesce(b.n_loans, 0) AS before_n, coalesce(a.n_loans, 0) AS after_n,
          coalesce(b.exposure, 0) AS before_exposure, coalesce(a.exposure, 0) AS after_exposure
        FROM (VALUES (0, 'Watch'), (1, 'Elevated'), (2, 'High')) v(position, band)
        LEFT JOIN by_stage b ON b.band = v.band AND b.stage = 'before'
        LEFT JOIN by_stage a ON a.band = v.band AND a.stage = 'after'""",
    "band_cuts": SCORED + " SELECT round(high, 6) AS high, round(elevated, 6) AS elevated FROM cuts",
    "horizon": WITH_BOOK + " SELECT max(duration) AS horizon FROM book WHERE split = 'train'",
    "auc_gini": METRICS + " SELECT round(auc, 10) AS auc, round(2 * auc - 1, 10) AS gini, cnt AS n_rows, tp AS n_positive FROM auc",
    "ks": METRICS + " SELECT round(ks, 10) AS ks_statistic FROM auc",
    "recall_top20": METRICS + " SELECT n_top, hits, round(recall, 10) AS recall FROM recall",
    "limit_qcut": WITH_BOOK + " SELECT borrower_id, LIMIT_BAL, limit_bin FROM book",
    "reason_topk": WITH_BOOK + "," + TERMS + """ SELECT b AS borrower_id, place, feature, round(amount, 8) AS contribution
        FROM placed WHERE place <= 3""",
    "watchlist_page": SCORED + """, w AS (SELECT borrower_id, segment, round(pd_score, 1) AS pd_score, band, exposure_at_risk
          FROM scored WHERE segment = 'SME'), n AS (SELECT count(*) AS total FROM w)
        SELECT w.*, total, 21 AS row_from, least(70, total) AS row_to FROM w, n
        ORDER BY exposure_at_risk DESC, borrower_id LIMIT 50 OFFSET 20""",
    "watchlist_deep_page": SCORED + """, w AS (SELECT borrower_id, segment,
          CASE WHEN borrower_id % 7 > 0 THEN exposure_at_risk END AS exposure_at_risk FROM scored)
        SELECT * FROM w ORDER BY exposure_at_risk DESC NULLS LAST, borrower_id
        LIMIT 60 OFFSET (SELECT greatest(count(exposure_at_risk) - 30, 0) FROM w)""",
    "what_if_rejects": WITH_BOOK + """, asked AS (
          SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 90 END AS rate,
            CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 400 END AS tenure,
            CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS principal FROM customer)
        SELECT request_id, 'new_rate_pct' AS reason FROM asked WHERE rate NOT BETWEEN 0 AND 60
        UNION ALL SELECT request_id, 'new_tenure_months' FROM asked WHERE tenure NOT BETWEEN 1 AND 360
        UNION ALL SELECT request_id, 'new_principal' FROM asked WHERE NOT principal > 0
        UNION ALL SELECT request_id, 'borrower_id' FROM asked WHERE request_id NOT IN (SELECT b FROM book)""",
    "top_risk": EXPLAINED + """ SELECT borrower_id, pd_score, band, array_to_string(reasons, ' | ') AS reasons,
        act AS recommended_action FROM memos ORDER BY pd_score DESC, borrower_id LIMIT 10""",
    "note_sample": WITH_BOOK + f""" SELECT borrower_id, delinquency_trend, months_delinquent, rm_note FROM book
        ORDER BY {_u(7919)}, borrower_id LIMIT 5""",
    "union_splits": SCORED + """ SELECT borrower_id, split, "default", pd_score FROM scored WHERE split = 'train'
        UNION ALL SELECT borrower_id, split, "default", pd_score FROM scored WHERE split = 'test'""",
    "assign_segment": WITH_BOOK + " SELECT borrower_id, segment FROM book",
    "rm_note": WITH_BOOK + " SELECT borrower_id, rm_note FROM book",
    "stress_utilization": BASE + "," + RECODE + _shocked("utilization_shock")
        + f" SELECT b AS borrower_id, {ROUNDED_ENGINEERED} FROM shocked",
    "stress_delinquency": BASE + "," + RECODE + _shocked("delinquency_shock")
        + f" SELECT b AS borrower_id, {ROUNDED_ENGINEERED} FROM shocked",
    "stress_report": _stress("utilization_shock") + f""", items AS (
        SELECT 'band_count_' || stage AS item, band, n_loans::DOUBLE AS value FROM by_stage
        UNION ALL SELECT 'exposure_' || stage, band, exposure FROM by_stage
        UNION ALL SELECT 'newly_high_count', 'ALL', newly_high_count FROM newly
        UNION ALL SELECT 'newly_high_exposure', 'ALL', newly_high_exposure FROM newly
        UNION ALL SELECT 'total_exposure', 'ALL', total_exposure FROM newly)
        SELECT 'utilization_shock' AS scenario, {UTILIZATION_STEP}::DOUBLE AS magnitude, * FROM items""",
    "what_if_terms": WHAT_IF + """ SELECT b AS request_id, b AS borrower_id, round_even(applied_emi * 1e6, 0) / 1e6 AS applied_emi,
        round_even(new_principal * 1e6, 0) / 1e6 AS applied_principal,
        round_even(avg_util_ratio * 1e6, 0) / 1e6 AS avg_util_ratio,
        round_even(avg_pay_ratio * 1e6, 0) / 1e6 AS avg_pay_ratio FROM changed""",
    "performance_report": METRICS + """ SELECT 'auc' AS metric, '' AS detail, round(auc, 8) AS value FROM auc
        UNION ALL SELECT 'gini', '', round(2 * auc - 1, 8) FROM auc
        UNION ALL SELECT 'ks_statistic', '', round(ks, 8) FROM auc
        UNION ALL SELECT 'recall_at_top_20pct', '', round(recall, 8) FROM recall
        UNION ALL SELECT 'n_' || split, '', count(*) FROM scored GROUP BY split
        UNION ALL SELECT 'test_default_rate', '', round(avg(y), 8) FROM t
        UNION ALL SELECT 'band_distribution_test', band, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 8)
          FROM scored WHERE split = 'test' GROUP BY band""",
    "settings_report": SCORED + """ SELECT 'high_cut' AS setting, CAST(round(high, 4) AS VARCHAR) AS value FROM cuts
        UNION ALL SELECT 'elevated_cut', CAST(round(elevated, 4) AS VARCHAR) FROM cuts
        UNION ALL SELECT 'gbm_blend_weight', '0.7' UNION ALL SELECT 'cox_blend_weight', '0.3'
        UNION ALL SELECT 'cox_horizon_duration', CAST(max(duration)::DOUBLE AS VARCHAR) FROM book WHERE split = 'train'
        UNION ALL SELECT 'text_model', 'hashed tf-idf'
        UNION ALL SELECT 'segments', string_agg(DISTINCT segment, '|' ORDER BY segment) FROM book
        UNION ALL SELECT 'total_borrowers', CAST(count(*) AS VARCHAR) FROM book
        UNION ALL SELECT 'last_scored_at', '1700000000.000'""",
    "note_covariance": WITH_BOOK + """, n AS (SELECT count(*) AS n FROM embeddings), v AS (
          SELECT borrower_id, CAST(embedding AS DOUBLE[]) AS e FROM book, n JOIN embeddings ON vec_id = borrower_id % n WHERE split = 'train'),
        long AS (SELECT borrower_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM v)
        SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_pop(a.x, b.x), 9) AS covariance
        FROM long a JOIN long b ON a.borrower_id = b.borrower_id AND a.i <= b.i GROUP BY a.i, b.i""",
    "write_splits": WITH_BOOK + ' SELECT borrower_id, split, "default", LIMIT_BAL, rm_note FROM book',
    "scored_book": SCORED + """ SELECT segment, exposure_at_risk, rm_note, "default", loan_vintage_month,
        borrower_id, pd_score, split, band FROM scored""",
    # Least-squares monotone fit as max over starts of min over ends of block means,
    # then linear between neighbouring points and constant outside.
    "isotonic_apply": SCORED + """,
points AS (
  SELECT blend AS x, sum("default") AS s, count(*) AS c, row_number() OVER (ORDER BY blend) AS i
  FROM scored WHERE split = 'train' GROUP BY blend),
sums AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(c) OVER (ORDER BY i) AS cc FROM points),
blocks AS (
  SELECT a.i AS i, b.i AS j, (b.cs - a.cs + a.s) / (b.cc - a.cc + a.c)::DOUBLE AS m FROM sums a JOIN sums b ON a.i <= b.i),
mins AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM blocks),
fit AS (SELECT j AS i, max(m) AS f FROM mins GROUP BY j),
curve AS (SELECT x, f, lead(x) OVER (ORDER BY x) AS x2, lead(f) OVER (ORDER BY x) AS f2 FROM points JOIN fit USING (i))
SELECT borrower_id, round(CASE WHEN blend < (SELECT min(x) FROM curve) THEN (SELECT f FROM curve ORDER BY x LIMIT 1)
         WHEN x2 IS NULL OR blend = x THEN f ELSE f + (f2 - f) * (blend - x) / (x2 - x) END, 8) AS calibrated
FROM scored ASOF LEFT JOIN curve ON blend >= x""",
}

# The stored feature book holds what the scan of the book gives.
ORACLES["stored_feature_book"] = ORACLES["book_scan"]


# --- the model whose trees and hazards are given: scores, explanations by the definition, and everything over them


def _side(feature: str, split) -> str:
    return f"{feature} IN ({', '.join(map(_text, split))})" if isinstance(split, tuple) else f"{feature} <= {split}::DOUBLE"


def _leaves(tree: int, spec, path=(), number=None):
    """(leaf's column of its count, conditions) in the order left before right."""
    if not isinstance(spec, tuple):
        yield path
        return
    feature, split, left, right = spec
    yield from _leaves(tree, left, (*path, _side(feature, split)))
    yield from _leaves(tree, right, (*path, f"NOT ({_side(feature, split)})"))


def _value(spec) -> str:
    if not isinstance(spec, tuple):
        return f"{spec}::DOUBLE"
    feature, split, left, right = spec
    return f"CASE WHEN {_side(feature, split)} THEN {_value(left)} ELSE {_value(right)} END"


def _counted(spec, first: int) -> int:
    """Number of leaves of a subtree; leaves are numbered from ``first``."""
    return 1 if not isinstance(spec, tuple) else _counted(spec[2], first) + _counted(spec[3], first)


def _expected(tree: int, spec, known: frozenset, first: int = 0) -> str:
    """Mean of a tree over the train loans when only the features in ``known`` are the loan's own."""
    if not isinstance(spec, tuple):
        return f"{spec}::DOUBLE"
    feature, split, left, right = spec
    n = _counted(left, first)
    one, two = _expected(tree, left, known, first), _expected(tree, right, known, first + n)
    if feature in known:
        return f"(CASE WHEN {_side(feature, split)} THEN {one} ELSE {two} END)"
    sizes = ["(" + " + ".join(f"n{tree}_{i}" for i in range(a, b)) + ")" for a, b in ((first, first + n), (first + n, first + n + _counted(right, first)))]
    return f"(({sizes[0]} * {one} + {sizes[1]} * {two}) / ({sizes[0]} + {sizes[1]})::DOUBLE)"


def _tree_features(spec) -> set[str]:
    return set() if not isinstance(spec, tuple) else {spec[0]} | _tree_features(spec[2]) | _tree_features(spec[3])


def _shapley(feature: str) -> str:
    """A feature's contribution: what it adds to coalitions of the others, weighed by their sizes."""
    parts = []
    for tree, spec in enumerate(TREES):
        names = sorted(_tree_features(spec))
        if feature not in names:
            continue
        others = [n for n in names if n != feature]
        for size in range(len(others) + 1):
            weight = factorial(size) * factorial(len(others) - size) / factorial(len(names))
            for chosen in combinations(others, size):
                with_it, without = frozenset({*chosen, feature}), frozenset(chosen)
                parts.append(f"{weight}::DOUBLE * ({_expected(tree, spec, with_it)} - {_expected(tree, spec, without)})")
    return " + ".join(parts)


FIXED_FEATURES = sorted(set().union(*map(_tree_features, TREES)))
FIXED_REACH = "reach AS (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {' AND '.join(path)}) + 1 AS n{tree}_{i}"
    for tree, spec in enumerate(TREES) for i, path in enumerate(_leaves(tree, spec))
) + " FROM book WHERE split = 'train')"


def _fixed_scores(source: str, name: str) -> str:
    margin = " + ".join(f"({_value(spec)})" for spec in TREES)
    eta = " + ".join(f"{w}::DOUBLE * {c}" for c, w in HAZARD.items())
    return f"""
{name} AS (
  SELECT *, 1 / (1 + exp(-2 * margin)) AS frozen_gbm, 1 - exp(-{BASE_HAZARD}::DOUBLE * exp({eta})) AS frozen_cox
  FROM (SELECT *, {margin} AS margin FROM {source}))"""


def _fixed_calibrated(source: str, name: str) -> str:
    """Ranks, blend and calibrated score of rows with both scores."""
    return _ranks(source, f"{name}_ranked") + f""",
{name} AS (
  SELECT r.* EXCLUDE (pd_score), 100 * CASE WHEN blend < (SELECT min(x) FROM curve) THEN (SELECT f FROM curve ORDER BY x LIMIT 1)
         WHEN x2 IS NULL OR blend = x THEN f ELSE f + (f2 - f) * (blend - x) / (x2 - x) END AS pd_score
  FROM {name}_ranked r ASOF LEFT JOIN curve ON blend >= x)"""


FIXED = (
    WITH_BOOK + "," + _fixed_scores("book", "frozen") + "," + _ranks("frozen", "blended") + """,
points AS (
  SELECT blend AS x, sum("default") AS s, count(*) AS c, row_number() OVER (ORDER BY blend) AS i
  FROM blended WHERE split = 'train' GROUP BY blend),
sums AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(c) OVER (ORDER BY i) AS cc FROM points),
blocks AS (
  SELECT a.i AS i, b.i AS j, (b.cs - a.cs + a.s) / (b.cc - a.cc + a.c)::DOUBLE AS m FROM sums a JOIN sums b ON a.i <= b.i),
mins AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM blocks),
fit AS (SELECT j AS i, max(m) AS f FROM mins GROUP BY j),
curve AS (SELECT x, f, lead(x) OVER (ORDER BY x) AS x2, lead(f) OVER (ORDER BY x) AS f2 FROM points JOIN fit USING (i)),"""
    + _fixed_calibrated("frozen", "fused") + "," + CUTS + "," + _banded("fused", "scored")
)
FIXED_TERMS = FIXED_REACH + """,
terms AS (
  SELECT b, rm_note, unnest([""" + ", ".join(map(_text, FIXED_FEATURES)) + """]) AS feature,
         unnest([""" + ", ".join("NULL::DOUBLE" if f in fv.CATEGORICAL_FEATURES else f"{f}::DOUBLE" for f in FIXED_FEATURES) + """]) AS value,
         unnest([""" + ", ".join(_shapley(f) for f in FIXED_FEATURES) + """]) AS amount,
         unnest([""" + ", ".join(f if f in fv.CATEGORICAL_FEATURES else "NULL::VARCHAR" for f in FIXED_FEATURES) + """]) AS category
  FROM book, reach),
placed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY abs(amount) DESC, feature) AS place FROM terms) WHERE place <= 4)"""
FIXED_EXPLAINED = (
    EXPLAINED.replace(SCORED, FIXED).replace(TERMS, FIXED_TERMS).replace("round(pd_score, 1) AS pd1", "round_even(pd_score * 10, 0) / 10 AS pd1")
)
FIXED_DETAIL = """ SELECT borrower_id, segment, round_even(exposure_at_risk * 100, 0) / 100 AS exposure_at_risk, pd1 AS pd_score, band, rm_note,
        array_to_string(reasons, ' | ') AS reason_codes, act AS recommended_action FROM memos"""


def _fixed_stress(scenario: str) -> str:
    """Book-wide shock under the fixed model, as the stress answer's rows."""
    moved = _stress(scenario).replace(SCORED, FIXED)
    moved = moved.replace(_scores("shocked", "shocked_scores"), "shocked_segments AS (SELECT shocked.*, segment FROM shocked JOIN book USING (b)),"
                          + _fixed_scores("shocked_segments", "shocked_scores"))
    moved = moved.replace(_ranks("shocked_scores", "shocked_fused"), _fixed_calibrated("shocked_scores", "shocked_fused"))
    items = ORACLES["stress_report"].removeprefix(_stress("utilization_shock"))
    step = UTILIZATION_STEP if scenario == "utilization_shock" else DELINQUENCY_STEP
    return moved + items.replace("'utilization_shock' AS scenario", f"'{scenario}' AS scenario").replace(f"{UTILIZATION_STEP}::DOUBLE AS magnitude", f"{step}::DOUBLE AS magnitude")


ORACLES |= {
    "fixed_gbm_scores": FIXED + " SELECT borrower_id, round(margin, 10) AS gbm_margin, round(frozen_gbm, 10) AS gbm_proba FROM frozen",
    "fixed_contributions": FIXED + "," + FIXED_TERMS.replace("WHERE place <= 4", "") + ", base AS (SELECT "
        + " + ".join(_expected(t, s, frozenset()) for t, s in enumerate(TREES)) + """ AS m FROM reach)
        SELECT b AS borrower_id, round(m, 9) AS base_margin, feature, round(amount, 9) AS contribution
        FROM placed, base WHERE abs(amount) > 1e-12""",
    "fixed_rescore": FIXED + " SELECT borrower_id, segment, split, round(pd_score, 8) AS pd_score, band FROM scored",
    "fixed_loan_detail": FIXED_EXPLAINED + FIXED_DETAIL,
    "fixed_loan_requested": FIXED_EXPLAINED + FIXED_DETAIL + " WHERE borrower_id IN (SELECT o_custkey FROM orders)",
    "fixed_memo_batch": FIXED_EXPLAINED + ORACLES["memo_records"].removeprefix(EXPLAINED),
    "fixed_performance": METRICS.replace(SCORED, FIXED) + ORACLES["performance_report"].removeprefix(METRICS),
    "fixed_stress_utilization": _fixed_stress("utilization_shock"),
    "fixed_stress_delinquency": _fixed_stress("delinquency_shock"),
    "fixed_applications": FIXED + "," + APPLICATIONS + f""", modes AS (SELECT {MODES}),
        app_rows AS (SELECT application_id, loan_amount AS LIMIT_BAL, coalesce(nullif(fine.segment, ''), modes.segment) AS segment,
          {", ".join(f"{CODE} AS PAY_{k}" for k in K)},
          {", ".join(f"credit_utilization_pct / 100 * loan_amount AS BILL_AMT{k}" for k in K)},
          {", ".join(f"existing_emi AS PAY_AMT{k}" for k in K)} FROM fine, modes),""" + _features("app_rows", "app_features") + ","
        + _fixed_scores("app_features", "app_scores") + "," + _fixed_calibrated("app_scores", "app_fused") + "," + _banded("app_fused", "app_banded")
        + f""" SELECT application_id, round_even(pd_score * 10, 0) / 10 AS pd_score, band, {ACTION} AS recommended_action FROM app_banded""",
    "fixed_what_if": FIXED + WHAT_IF.removeprefix(WITH_BOOK) + ", changed_segments AS (SELECT changed.*, segment FROM changed JOIN book USING (b)),"
        + _fixed_scores("changed_segments", "changed_scores") + "," + _fixed_calibrated("changed_scores", "changed_fused") + ","
        + _banded("changed_fused", "after") + """ SELECT s.b AS request_id, s.borrower_id, round_even(s.pd_score * 10, 0) / 10 AS original_pd_score,
          s.band AS original_band, round_even(a.pd_score * 10, 0) / 10 AS new_pd_score, a.band AS new_band,
          round(a.applied_emi, 6) AS applied_emi, round(a.new_principal, 6) AS applied_principal,
          round_even((a.pd_score - s.pd_score) * 10, 0) / 10 AS delta FROM scored s JOIN after a USING (b)""",
    "watchlist_index_page": SCORED + """, w AS (SELECT borrower_id, segment, round(pd_score, 1) AS pd_score, band, exposure_at_risk
          FROM scored WHERE segment = 'Credit Card'), n AS (SELECT count(*) AS total FROM w)
        SELECT w.*, total FROM w, n ORDER BY exposure_at_risk DESC, borrower_id
        LIMIT 40 OFFSET (SELECT greatest(total - 60, 0) FROM n)""",
    "describe_sketched": WITH_BOOK + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
            {", ".join(f"round((SELECT v FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS k FROM book) WHERE r = ceil(k * {q / 100})), 4) AS q{q}" for q in (25, 50, 75))}
            FROM book"""
        for c in DESCRIBED
    ),
}
