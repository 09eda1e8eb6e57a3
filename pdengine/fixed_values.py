"""Fixed values.

Everything here is a name, number or sentence that other systems and reports
rely on, so it is kept in one place and in natural order. No logic lives here.
"""

CYCLES = (1, 2, 3, 4, 5, 6)
PAY_COLS = ["PAY_1", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILL_COLS = ["BILL_AMT1", "BILL_AMT2", "BILL_AMT3", "BILL_AMT4", "BILL_AMT5", "BILL_AMT6"]
PAY_AMT_COLS = ["PAY_AMT1", "PAY_AMT2", "PAY_AMT3", "PAY_AMT4", "PAY_AMT5", "PAY_AMT6"]
ACCOUNT_COLS = ["LIMIT_BAL", "AGE"]
ENGINEERED_COLS = [
    "util_ratio_1", "avg_util_ratio", "avg_pay_ratio", "months_delinquent",
    "max_delinquency", "delinquency_trend", "bill_trend",
]
RAW_NUMERIC_COLS = ACCOUNT_COLS + PAY_COLS + BILL_COLS + PAY_AMT_COLS
NUMERIC_FEATURES = RAW_NUMERIC_COLS + ENGINEERED_COLS
CATEGORICAL_FEATURES = ["SEX", "EDUCATION", "MARRIAGE", "segment"]
N_TEXT_COMPONENTS = 16
TEXT_FEATURES = [f"nlp_emb_{i}" for i in range(N_TEXT_COMPONENTS)]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES + TEXT_FEATURES
COX_COVARIATES = [
    "LIMIT_BAL", "AGE", "avg_util_ratio", "avg_pay_ratio",
    "months_delinquent", "max_delinquency", "delinquency_trend", "nlp_emb_0",
]

# Layout of the raw account file.
RAW_ID = "ID"
RAW_RENAMES = {"ID": "borrower_id", "PAY_0": "PAY_1", "default payment next month": "default"}

# Undocumented category codes folded into the "other" code.
EDUCATION_RECODE = {0: 4, 5: 4, 6: 4}
MARRIAGE_RECODE = {0: 3}

# Clips of the engineered ratios.
UTILIZATION_CLIP = (-2.0, 5.0)
PAY_RATIO_CLIP = (-5.0, 5.0)
EXPOSURE_BASE = 0.3
EXPOSURE_UTILIZATION_CLIP = (0.0, 1.5)

# Score fusion and bands.
GBM_WEIGHT = 0.7
COX_WEIGHT = 0.3
HIGH_PERCENTILE = 0.9
ELEVATED_PERCENTILE = 0.7
BANDS = ["Watch", "Elevated", "High"]
LAST_TRAIN_VINTAGE = 9
MAX_PAY_STATUS = 8
CENSOR_CYCLE = 6
TOP_REASONS = 4
MEMO_REASONS = 2
TOP_IMPORTANCES = 15
CRORE = 10_000_000
STRESS_SCENARIOS = ("utilization_shock", "delinquency_shock")
DEFAULT_RATE_PCT = 12.0
DEFAULT_TENURE_MONTHS = 12

SEGMENTS = ["Retail Personal", "Credit Card", "Consumer Durable", "SME", "Agri"]
SEGMENT_WEIGHTS = {
    0: [0.45, 0.35, 0.15, 0.03, 0.02],
    1: [0.35, 0.30, 0.20, 0.10, 0.05],
    2: [0.20, 0.25, 0.20, 0.25, 0.10],
    3: [0.10, 0.15, 0.15, 0.45, 0.15],
    4: [0.05, 0.10, 0.10, 0.55, 0.20],
}
OTHER_SEGMENT_WEIGHTS = [0.2, 0.2, 0.2, 0.2, 0.2]
SEGMENT_PHRASES = {
    "SME": "an SME lending",
    "Agri": "an agricultural lending",
    "Retail Personal": "a retail personal loan",
    "Credit Card": "a credit card",
    "Consumer Durable": "a consumer durable loan",
}

REPAYMENT_CODES = {
    "clean": -1.0,
    "minor_delay": 1.0,
    "moderate_delay": 2.0,
    "severe_delinquency": 4.0,
}

ACTIONS = {
    "High": "Escalate to credit committee for review; place on close watch; consider limit freeze pending RM follow-up.",
    "Elevated": "RM to conduct a check-in call within 2 weeks; monitor closely through the next billing cycle.",
    "Watch": "Include in standard quarterly monitoring; no immediate action required.",
}

# Sentences of reason codes; {names} are filled per loan.
REASON_SENTENCES = {
    "status_late": "Repayment status in {cycle} shows a {count}-month delay",
    "status_on_time": "Repayment status in {cycle} was on time",
    "months_delinquent": "{count} of the last 6 billing cycles were delinquent",
    "no_delinquency": "No delinquency recorded in the observed window",
    "max_delinquency": "Worst delinquency reached {count} month(s) overdue",
    "trend_worse": "Repayment status has worsened by {size} point(s) over the last 6 cycles",
    "trend_better": "Repayment status has improved by {size} point(s) over the last 6 cycles",
    "utilization_high": "Average credit utilization is elevated at {percent} of limit",
    "utilization_fair": "Average credit utilization is moderate at {percent} of limit",
    "utilization_now": "Most recent billing cycle utilization at {percent} of limit",
    "pays_little": "Payments covering only {percent} of the billed amount on average",
    "pays_well": "Payments consistently covering {percent} of the billed amount",
    "bill_up": "Outstanding bill has grown by Rs {amount} over the observed window",
    "bill_down": "Outstanding bill has declined by Rs {amount} over the observed window",
    "limit": "Sanctioned credit limit of {rupees}",
    "age": "Borrower age {count}",
    "segment": "Exposure is on {segment} product line, which carries a different baseline risk",
    "profile": "Demographic profile factor ({name} category {category})",
    "note_higher": 'RM note content pushed the score higher: "{note}"',
    "note_lower": 'RM note content pushed the score lower: "{note}"',
    "bill": "Outstanding bill in {cycle} was {rupees}",
    "payment": "Payment made in {cycle} was {rupees}",
    "other": "{label} = {any}",
}
CYCLE_PHRASES = {"latest": "the most recent billing cycle", "earlier": "{cycle} billing cycles ago"}
MEMO_SENTENCE = (
    "Borrower {borrower} ({segment} segment, exposure at risk Rs {exposure}) is currently scored {score}/100, "
    "placing the account in the {band} band. This is primarily driven by: {drivers}. {action}"
)

# What an application that leaves a field out is taken to say.
DEFAULT_AGE = 35
DEFAULT_TENURE = 12
DEFAULT_HISTORY = "clean"
