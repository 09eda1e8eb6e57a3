"""Plain-language sentences: reason codes and memo text, as column expressions.

The wordings are fixed values: reports and readers rely on the exact text,
which stands whole in ``fixed_values``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from pdengine import fixed_values as fv
from pdengine.functions.bands import action


def whole(amount: Column) -> Column:
    """No decimals, thousands separated, ties to even; a negative zero prints as 0."""
    return F.format_number(amount + F.lit(0.0), 0)


def percent(share: Column) -> Column:
    return F.concat(_plain(F.lit(100.0) * share), F.lit("%"))


def _plain(value: Column) -> Column:
    return F.call_function("format_number", value + F.lit(0.0), F.lit("0"))


def _count(value: Column) -> Column:
    return value.cast("long").cast("string")


def filled(sentence: str, **parts: Column) -> Column:
    """A whole sentence with its ``{names}`` filled by columns."""
    pieces = re.split(r"\{(\w+)\}", sentence)
    columns = [parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*columns) if len(columns) > 1 else columns[0]


def cycle_phrase(cycle: Column) -> Column:
    earlier = filled(fv.CYCLE_PHRASES["earlier"], cycle=cycle)
    return F.when(cycle == "1", F.lit(fv.CYCLE_PHRASES["latest"])).otherwise(earlier)


def reason_text(
    feature: Column, value: Column, category: Column, contribution: Column, note: Column
) -> Column:
    """Sentence for one feature of one loan.

    ``value`` holds numeric features, ``category`` the text of categorical
    ones; the sign of the contribution chooses between paired wordings.
    """
    segment = F.coalesce(
        *[F.when(category == name, F.lit(phrase)) for name, phrase in fv.SEGMENT_PHRASES.items()],
        category,
    )
    parts = {
        "cycle": cycle_phrase(F.right(feature, F.lit(1))),
        "count": _count(value),
        "size": _count(F.abs(value)),
        "percent": percent(value),
        "amount": whole(F.abs(value)),
        "rupees": F.concat(F.lit("Rs "), whole(value)),
        "segment": segment,
        "category": category,
        "name": F.lower(feature),
        "note": F.coalesce(note, F.lit("")),
        "label": F.replace(feature, F.lit("_"), F.lit(" ")),
        "any": F.coalesce(category, value.cast("string")),
    }

    def say(name: str) -> Column:
        return filled(fv.REASON_SENTENCES[name], **parts)

    def either(rule: Column, yes: str, no: str) -> Column:
        return F.when(rule, say(yes)).otherwise(say(no))

    raises = contribution > 0
    return (
        F.when(feature.isin(fv.PAY_COLS), either(value > 0, "status_late", "status_on_time"))
        .when(feature == "months_delinquent", say("months_delinquent"))
        .when(feature == "max_delinquency", either(value <= 0, "no_delinquency", "max_delinquency"))
        .when(feature == "delinquency_trend", either(value > 0, "trend_worse", "trend_better"))
        .when(feature == "avg_util_ratio", either(raises, "utilization_high", "utilization_fair"))
        .when(feature == "util_ratio_1", say("utilization_now"))
        .when(feature == "avg_pay_ratio", either(raises, "pays_little", "pays_well"))
        .when(feature == "bill_trend", either(value > 0, "bill_up", "bill_down"))
        .when(feature == "LIMIT_BAL", say("limit"))
        .when(feature == "AGE", say("age"))
        .when(feature == "segment", say("segment"))
        .when(feature.isin("SEX", "EDUCATION", "MARRIAGE"), say("profile"))
        .when(feature.startswith("nlp_emb_"), either(raises, "note_higher", "note_lower"))
        .when(feature.startswith("BILL_AMT"), say("bill"))
        .when(feature.startswith("PAY_AMT"), say("payment"))
        .otherwise(say("other"))
    )


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def memo_summary(
    borrower: Column, segment: Column, exposure: Column, score: Column, band: Column, reasons: Column
) -> Column:
    """Opening paragraph of a memo; ``reasons`` is the ordered array of reason structs."""
    drivers = F.concat_ws(
        "; ",
        F.transform(
            F.slice(reasons, 1, fv.MEMO_REASONS), lambda r: lower_first(F.rtrim(r["text"], F.lit(".")))
        ),
    )
    return filled(
        fv.MEMO_SENTENCE, borrower=borrower.cast("string"), segment=segment, exposure=whole(exposure),
        score=_plain(score), band=band, drivers=drivers, action=action(band),
    )


def escape_xml(text: Column) -> Column:
    """Ampersand first, so that entities written here are not escaped again."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
