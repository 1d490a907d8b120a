"""Facts that come before the decision: where the closing part of a judgment begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, DISPOSITIVE, SECTION_HEADER
from ..functions import text as T

HEADER = "(?imd)" + SECTION_HEADER
CUES = ["(?i)" + p for p in DISPOSITIVE]
SENTENCE_END = r"(?s)^.*[.!?](?:[\"')\]”’]+)?\s*"


def extract(cases: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``cases`` with facts, boundary_char, boundary_reason, source_chars and retained_chars."""
    t = F.coalesce(F.col(text), F.lit(""))
    places = F.array(F.struct(T.starts_after(t, HEADER).alias("at"), F.lit(0).alias("order")), *[F.struct(T.starts_after(t, p).alias("at"), F.lit(k).alias("order")) for k, p in enumerate(CUES, 1)])
    first = F.array_min(F.filter(places, lambda x: x["at"].isNotNull()))
    cap = F.round(F.char_length(t) * CONFIG.retained).cast("int")
    staged = cases.withColumn("_first", first).withColumn("_cap", cap)
    free = F.col("_first").isNull() | (F.col("_first.at") > F.col("_cap"))
    reason = F.when(t == "", "empty_text").when(free, "positional_cap").when(F.col("_first.order") == 0, "section_header").otherwise("dispositive_cue")
    staged = staged.withColumn("boundary_reason", reason).withColumn("_cut", F.when(free, F.col("_cap")).otherwise(F.col("_first.at")))
    # back to the last sentence end, unless too little would stay
    aligned = F.char_length(F.regexp_extract(F.expr(f"substring(coalesce({text}, ''), 1, _cut)"), SENTENCE_END, 0))
    staged = staged.withColumn("_aligned", aligned)
    cut = F.when(F.col("_aligned") >= CONFIG.aligned_chars, F.col("_aligned")).otherwise(F.col("_cut"))
    staged = staged.withColumn("boundary_char", F.when(t != "", cut.cast("int")))
    staged = staged.withColumn("facts", F.coalesce(F.regexp_replace(F.expr(f"substring(coalesce({text}, ''), 1, boundary_char)"), r"\s+$", ""), F.lit("")))
    return staged.withColumn("source_chars", F.char_length(t)).withColumn("retained_chars", F.char_length("facts")).drop("_first", "_cap", "_cut", "_aligned")


def cues(text: Column) -> Column:
    """Distinct outcome phrases of a text, in case-blind order."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CUES])))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def eligible() -> Column:
    """Enough of the text and enough words were kept."""
    share = F.col("retained_chars") / F.col("source_chars")
    return F.when(F.col("source_chars") == 0, False).otherwise((share >= CONFIG.least_retained) & (F.size(T.words(F.col("facts"))) >= CONFIG.least_words))
