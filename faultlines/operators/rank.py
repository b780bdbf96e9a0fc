"""Root-cause candidates: one per group, with confidence, signals and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import is_blank, lookup, round_half_up, string_list, two_decimals


def confidence(severity: Column, category: Column, code: Column, count: Column, parse_confidence: Column) -> Column:
    total = (
        lookup(severity, C.SEVERITY_WEIGHT, C.SEVERITY_WEIGHT_DEFAULT)
        + lookup(category, C.CATEGORY_BOOST, C.CATEGORY_BOOST_DEFAULT)
        + F.coalesce(lookup(code, C.CODE_BOOST), F.lit(0.0))
        + F.least(F.lit(C.REPEAT_BOOST_MAX), (count - 1) * F.lit(C.REPEAT_BOOST_STEP))
        + F.least(F.greatest(parse_confidence * F.lit(C.PARSE_BOOST_FACTOR), F.lit(0.0)), F.lit(C.PARSE_BOOST_MAX))
    )
    return round_half_up(F.least(F.greatest(total, F.lit(0.0)), F.lit(C.CONFIDENCE_MAX)), 2)


def signals(code: Column, category: Column, severity: Column, count: Column, parse_confidence: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~is_blank(code), F.concat(F.lit("diagnostic-code:"), code)),
            F.concat(F.lit("category:"), lookup(category, C.CATEGORY_TEXT)),
            F.concat(F.lit("severity:"), F.lower(severity)),
            F.when(count > 1, F.concat(F.lit("group-count:"), count.cast("string"))),
            F.concat(F.lit("parse-confidence:"), two_decimals(parse_confidence)),
            F.lit("ranked-primary:true"),
        )
    )


def insight(code: Column, category: Column) -> Column:
    """Title, explanation, causes and fixes: by code, else by category, else the default."""

    def as_struct(item) -> Column:
        title, explanation, causes, fixes = item
        return F.struct(
            F.lit(title).alias("title"),
            F.lit(explanation).alias("explanation"),
            string_list(causes).alias("likely_causes"),
            string_list(fixes).alias("suggested_fixes"),
        )

    chain = None
    for key, item in C.INSIGHTS_BY_CODE.items():
        chain = F.when(code == key, as_struct(item)) if chain is None else chain.when(code == key, as_struct(item))
    for key, item in C.INSIGHTS_BY_CATEGORY.items():
        chain = chain.when(category == key, as_struct(item))
    return chain.otherwise(as_struct(C.INSIGHT_DEFAULT))


def candidates(groups: DataFrame) -> DataFrame:
    """Ranked candidates; the group row already carries its primary diagnostic, so there is no join."""
    p = F.col("primary")
    ranked = W.partitionBy("log_id").orderBy(F.desc("confidence"), F.col("primary.seg"))
    return (
        groups.withColumns(
            {
                "confidence": confidence(
                    p["severity"], p["category"], p["code"], F.col("count"), F.col("parse_confidence")
                ),
                "signals": signals(
                    p["code"], p["category"], p["severity"], F.col("count"), F.col("parse_confidence")
                ),
                "_insight": insight(p["code"], p["category"]),
            }
        )
        .withColumns(
            {
                **{n: F.col(f"_insight.{n}") for n in ("title", "explanation", "likely_causes", "suggested_fixes")},
                "diagnostic_id": p["id"],
                "rank": F.row_number().over(ranked),
            }
        )
        .drop("_insight")
    )
