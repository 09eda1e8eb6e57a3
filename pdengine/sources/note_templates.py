"""Sentences of generated officer notes; ``{n}`` and ``{pct}`` are filled per borrower.

Made up for this package. Only the tone of a note follows from the loan; no
result depends on the wording.
"""

POSITIVE = [
    "Order register is full for the coming season, up {pct}% on plan.",
    "Auditor's letter is clean and was sent without a reminder.",
    "Solar panels now cover most of the workshop's power bill.",
    "Borrower repaid {pct}% of the principal ahead of plan.",
    "Harvest was sold forward at a good price.",
    "Cold store is running at full load since spring.",
    "Two apprentices finished training and now earn their own wages.",
    "Fleet was renewed with a grant, repair costs are lower.",
    "Cooperative has taken the member on to its board.",
    "Online shop passed its first thousand parcels.",
    "Insurance paid out in full after the storm.",
    "Deposit account has been topped up every month.",
    "Supplier raised the trade limit after a good year.",
]

NEGATIVE = [
    "Cheques to two suppliers were returned this month.",
    "Irrigation pump failed and the crop is down about {pct}%.",
    "Tax office has frozen part of the current account.",
    "Delivery van was written off and is not insured.",
    "Guarantor wants to be released from the guarantee.",
    "Borrower missed {n} appointments at the branch.",
    "Export order was cancelled after the goods were packed.",
    "Trading licence has lapsed and renewal is pending.",
    "Stock report shows {pct}% of goods past their date.",
    "Flood water stood in the store room for a week.",
    "Books have not been closed for {n} months.",
    "Main tenant has given notice.",
    "Pledged gold was taken back and not replaced.",
    "Three workers left over unpaid wages.",
    "Court summons from a former partner was served.",
    "Loom is idle for lack of yarn on credit.",
    "Phone number on file is no longer in use.",
]

NEUTRAL = [
    "Annual visit done; photographs are on file.",
    "Nominee details were updated on request.",
    "Borrower asked how to change the instalment date.",
    "Branch code changed after the merger of two offices.",
    "Signature card was replaced.",
]
