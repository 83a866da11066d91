"""Vehicle rules: recall, cost texts, warranty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hibiki import constants as C


def recall_affected(status: Column) -> Column:
    return status.startswith(C.RECALL_AFFECTED)


def recall_repaired(status: Column) -> Column:
    return status.startswith(C.RECALL_AFFECTED) & status.contains(C.RECALL_REPAIRED)


def _yen_amounts(cost: Column) -> Column:
    """All yen amounts, after the last ``=`` of each sentence: a sum replaces its parts."""
    sentences = F.split(cost, "。")
    totals = F.transform(sentences, lambda s: F.regexp_replace(s, r"^.*[=＝]", ""))
    texts = F.flatten(
        F.transform(
            totals,
            lambda s: F.regexp_extract_all(s, F.lit(r"([0-9][0-9,]*)(?=円|〜)"), F.lit(1)),
        )
    )
    return F.transform(texts, lambda s: F.replace(s, F.lit(","), F.lit("")).cast("long"))


def cost_low(cost: Column) -> Column:
    return F.array_min(_yen_amounts(cost))


def cost_high(cost: Column) -> Column:
    return F.array_max(_yen_amounts(cost))


def cost_free(cost: Column) -> Column:
    return cost.contains(C.FREE_OF_CHARGE)


def warranty_state(
    expiry: Column, as_of: Column, mileage: Column | None = None, max_mileage: int | None = None
) -> Column:
    """``expired``, ``ending`` within three months, ``valid``; null without a stored expiry.

    The stored expiry decides; a mileage above the limit ends the cover earlier.
    """
    over = F.lit(False)
    if mileage is not None and max_mileage is not None:
        over = F.coalesce(mileage > max_mileage, F.lit(False))
    ending = F.add_months(as_of, C.WARRANTY_ENDING_MONTHS)
    return (
        F.when(expiry.isNull(), F.lit(None).cast("string"))
        .when((expiry < as_of) | over, "expired")
        .when(expiry <= ending, "ending")
        .otherwise("valid")
    )
