"""Page cleaning, chunking and text quality, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, HEADER, MARGIN, NUMBER
from ..functions import text as T


def normal_line(line: Column) -> Column:
    return F.trim(T.casefold(F.regexp_replace(F.regexp_replace(F.trim(line), HEADER, ""), r"\s+", " ")))


def edge_lines(text: Column) -> Column:
    """First and last lines of a page that are not blank."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = CONFIG.edge_lines
    return F.concat(F.slice(lines, 1, n), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (n - 1)), n))


def furniture(pages: DataFrame) -> DataFrame:
    """(doc_id, lines): edge lines that stand on enough distinct pages of one document."""
    kept = F.filter(F.col("edge"), lambda x: ~x.rlike(MARGIN) & ~x.rlike(NUMBER))
    lines = pages.select("doc_id", "page", edge_lines(F.col("raw_text")).alias("edge")).select("doc_id", "page", F.explode(kept).alias("line"))
    named = lines.select("doc_id", "page", normal_line(F.col("line")).alias("line")).filter("line <> ''").distinct()
    often = named.groupBy("doc_id", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= CONFIG.furniture_pages)
    return often.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def clean(text: Column, known: Column) -> Column:
    """A page's text without margin letters, page numbers, headers and furniture; hyphens at line ends joined."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(MARGIN) & ~x.rlike(NUMBER) & ~x.rlike(HEADER) & ~F.array_contains(known, normal_line(x)))
    joined = F.array_join(F.transform(kept, lambda x: F.replace(x, F.lit("�"), F.lit(" "))), "\n")
    joined = F.regexp_replace(joined, r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?=[a-z])", "")
    return T.collapse(F.regexp_replace(joined, r"[ \t]*\n[ \t]*", " "))


def cleaned(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text)."""
    known = F.coalesce("lines", F.array().cast("array<string>"))
    return pages.join(furniture(pages), "doc_id", "left").select("doc_id", "page", clean(F.col("raw_text"), known).alias("text"))


def chunks(pages: DataFrame, words: int = CONFIG.chunk_words, most: int = CONFIG.chunk_sentences) -> DataFrame:
    """(doc_id, page, chunk, start, end, text): sentence-aligned passages of cleaned pages, by one fold per page."""
    parts = T.bind(T.sentences(F.col("text")), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array("text")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("words"))

    def step(state, sentence):
        n = F.size(T.words(sentence))
        full = (F.size(state["held"]) > 0) & ((F.size(state["held"]) >= most) | (state["words"] + n > words))
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(F.array_join(state["held"], " ")))).otherwise(state["out"]).alias("out"),
            F.when(full, F.array(sentence)).otherwise(F.concat(state["held"], F.array(sentence))).alias("held"),
            F.when(full, n).otherwise(state["words"] + n).alias("words"),
        )

    grouped = F.aggregate(parts, zero, step, lambda state: F.concat(state["out"], F.array(F.array_join(state["held"], " "))))
    # a filter on the text or on what is exploded would be pushed down and clean and fold every page once more
    rows = pages.select("doc_id", "page", F.when(F.col("text") != "", grouped).otherwise(F.array().cast("array<string>")).alias("parts"))
    # cleaned text has single spaces, so a passage starts one space after the last one's end
    sums = F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(p) + 1)))
    starts = F.slice(sums, F.lit(1), F.size("parts"))
    out = rows.select("doc_id", "page", F.posexplode_outer(F.arrays_zip(F.col("parts").alias("text"), starts.alias("start"))).alias("at", "c")).filter("at is not null")
    return out.select("doc_id", "page", (F.col("at") + 1).alias("chunk"), F.col("c.start").alias("start"), (F.col("c.start") + F.char_length("c.text")).alias("end"), F.col("c.text").alias("text"))


def chunk_id(doc: str = "doc_id") -> Column:
    return F.format_string("S_%d::p%04d::c%03d", F.col(doc), F.col("page"), F.col("chunk"))


def not_evidence(text: Column) -> Column:
    """Fragments of up to three words without an outcome, and lists of names."""
    words = T.words(text)
    outcome = text.rlike(r"(?i)\b(?:appeal|petition|application|case)\s+(?:is\s+)?(?:dismissed|allowed|granted|disposed)\b")
    names = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")))
    listed = (F.regexp_count(text, F.lit(",")) >= 3) & (names >= F.greatest(F.lit(4), F.floor(F.size(words) / 3)))
    ended = F.rtrim(text).endswith("Adv.") | F.rtrim(text).endswith("Advs.")
    return F.when(F.size(words) <= 3, ~outcome).otherwise(listed & (ended | (F.size(words) <= 50)))


def metrics(text: Column) -> dict[str, Column]:
    """Eight signals of how well a text was extracted."""
    bare = F.char_length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")
    ascii_ = F.regexp_count(text, F.lit(r"[\x21-\x7e]")).cast("long")
    tokens = F.size(T.words(text)).cast("long")
    latin = F.regexp_count(text, F.lit("[A-Za-z]{2,}")).cast("long")
    return {
        "nonspace_characters": bare,
        "ascii_visible_ratio": F.when(bare > 0, F.round(ascii_ / bare, 6)).otherwise(0.0),
        "control_characters": F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cs}&&[^\n\r\t]]")).cast("long"),
        "replacement_characters": F.regexp_count(text, F.lit("�")).cast("long"),
        "mojibake_markers": F.regexp_count(text, F.lit("[\u0080-\u009f�]|(?:Ã|Â|â)[^\\s]")).cast("long"),
        "tokens": tokens,
        "ascii_words": latin,
        "ascii_words_per_token": F.when(tokens > 0, F.round(latin / tokens, 6)).otherwise(0.0),
    }


def reasons() -> Column:
    """What is wrong with a text that has the columns of ``metrics``."""
    c = F.col
    rules = [
        (c("nonspace_characters") < 80, "insufficient_embedded_text"),
        (c("control_characters") > 0, "unicode_control_characters"),
        (c("replacement_characters") >= 2, "replacement_characters"),
        (c("mojibake_markers") >= 2, "mojibake_markers"),
        ((c("nonspace_characters") >= 80) & (c("ascii_visible_ratio") < 0.75), "low_ascii_visible_ratio"),
        ((c("tokens") >= 20) & (c("ascii_words_per_token") < 0.25), "low_english_token_ratio"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))
