import pytest
from pyspark.sql import functions as F

from pdengine.functions.wording import escape_xml, lower_first, memo_summary, reason_text

CASES = [
    ("PAY_1", 2.0, None, 1, "Repayment status in the most recent billing cycle shows a 2-month delay"),
    ("PAY_3", 0.0, None, 1, "Repayment status in 3 billing cycles ago was on time"),
    ("months_delinquent", 4.0, None, 1, "4 of the last 6 billing cycles were delinquent"),
    ("max_delinquency", 0.0, None, -1, "No delinquency recorded in the observed window"),
    ("max_delinquency", 3.0, None, 1, "Worst delinquency reached 3 month(s) overdue"),
    ("delinquency_trend", 2.0, None, 1, "Repayment status has worsened by 2 point(s) over the last 6 cycles"),
    ("delinquency_trend", -1.0, None, 1, "Repayment status has improved by 1 point(s) over the last 6 cycles"),
    ("avg_util_ratio", 12.5, None, 1, "Average credit utilization is elevated at 1250% of limit"),
    ("avg_util_ratio", 0.125, None, -1, "Average credit utilization is moderate at 12% of limit"),
    ("util_ratio_1", 0.5, None, 1, "Most recent billing cycle utilization at 50% of limit"),
    ("avg_pay_ratio", 0.1, None, 1, "Payments covering only 10% of the billed amount on average"),
    ("avg_pay_ratio", 1.0, None, -1, "Payments consistently covering 100% of the billed amount"),
    ("bill_trend", 1234567.0, None, 1, "Outstanding bill has grown by Rs 1,234,567 over the observed window"),
    ("bill_trend", 0.0, None, 1, "Outstanding bill has declined by Rs 0 over the observed window"),
    ("LIMIT_BAL", 50000.0, None, 1, "Sanctioned credit limit of Rs 50,000"),
    ("AGE", 41.0, None, 1, "Borrower age 41"),
    ("segment", None, "SME", 1, "Exposure is on an SME lending product line, which carries a different baseline risk"),
    ("segment", None, "Gold", 1, "Exposure is on Gold product line, which carries a different baseline risk"),
    ("EDUCATION", None, "2", 1, "Demographic profile factor (education category 2)"),
    ("nlp_emb_3", 0.4, None, 1, 'RM note content pushed the score higher: "quiet"'),
    ("nlp_emb_0", 0.4, None, -1, 'RM note content pushed the score lower: "quiet"'),
    ("BILL_AMT1", 2.5, None, 1, "Outstanding bill in the most recent billing cycle was Rs 2"),
    ("PAY_AMT6", 1000.0, None, 1, "Payment made in 6 billing cycles ago was Rs 1,000"),
    ("other_thing", 1.5, None, 1, "other thing = 1.5"),
]


def test_reason_sentences(spark):
    rows = spark.createDataFrame(
        [(i, *c[:3], float(c[3]), "quiet") for i, c in enumerate(CASES)],
        "i int, f string, v double, c string, a double, note string",
    )
    text = reason_text(F.col("f"), F.col("v"), F.col("c"), F.col("a"), F.col("note"))
    got = [r.t for r in rows.select("i", text.alias("t")).orderBy("i").collect()]
    assert got == [c[4] for c in CASES]


def test_memo_summary_uses_two_reasons(spark):
    row = spark.range(1).select(
        memo_summary(
            F.lit(7), F.lit("SME"), F.lit(1234.5), F.lit(61.5), F.lit("Odd"),
            F.array(*[F.struct(F.lit(t).alias("text")) for t in ("First one.", "Second", "Third")]),
        ).alias("s")
    ).first()
    assert row.s == (
        "Borrower 7 (SME segment, exposure at risk Rs 1,234) is currently scored 62/100, placing the account "
        "in the Odd band. This is primarily driven by: first one; second. "
        "Include in standard quarterly monitoring; no immediate action required."
    )


@pytest.mark.parametrize("text, expected", [("a<b & c>d", "a&lt;b &amp; c&gt;d"), ("&lt;", "&amp;lt;")])
def test_escape(spark, text, expected):
    assert spark.range(1).select(escape_xml(F.lit(text)).alias("t")).first().t == expected


def test_lower_first_of_empty(spark):
    assert spark.range(1).select(lower_first(F.lit("")).alias("t")).first().t == ""
