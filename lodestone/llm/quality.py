"""Quality rules, line first, in DataFrame functions only.

Each line is judged by itself: by its punctuation, as navigation, and by boilerplate phrases.
Failing lines are removed; a document that so loses too much of its text is rejected. Four
statistics of the whole text (the base rules) reject by themselves.

A line passes the punctuation rule if it ends like a sentence, or is the last line of its text
(it may be cut off), or has ``LONG_LINE`` words and a sentence end within; its symbols and
its shouted words must be few. Navigation is a short line without an end, or one with many
separators. Repeats within a text: a 3-word window's three words are hashed to 64 bits, equal
hashes are found by sorting them, and the words under a window found twice are counted.

Defined results: null or empty text has no words, fails the base rule and is not kept; repeated
rows are judged alike; an empty table gives an empty result; other columns, whatever their
names, pass through ``filter_documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, carried, column, restored, text_or_empty

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Of a text's characters, the share that line rules may remove.
MAX_LOST_PERCENT = 50
LONG_LINE, NAVIGATION_WORDS, SEPARATORS = 12, 4, 3
#: Phrases of boilerplate lines, small letters.
BOILERPLATE = ("all rights reserved", "cookie policy", "cookies to improve", "enable javascript", "lorem ipsum", "privacy policy", "sign in to", "subscribe to our", "terms of service", "terms of use", "click here to")


def line_fails(line: Column, last: Column) -> Column:
    """Whether the line rules remove a line; blank lines pass."""
    words = F.regexp_count(line, F.lit(WORD))
    chars = F.greatest(F.length(line), F.lit(1))
    ends = line.rlike(r"""[.!?:;。！？…]["'”’»)\]]*\s*$""")
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    separators = F.regexp_count(line, F.lit(r"[|»›•·]|\s>\s"))
    shouted = F.regexp_count(line, F.lit(r"!!"))
    blank = ~line.rlike(WORD)
    punctuation = (~(ends | last | ((words >= LONG_LINE) & line.rlike(r"[.!?]\s")))) | (symbols * 20 > chars) | (shouted * 2 > words)
    navigation = ((words < NAVIGATION_WORDS) & ~ends & ~last) | ((separators >= SEPARATORS) & (separators * 4 > words))
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE)) & (words < 30)
    return ~blank & (punctuation | navigation | boilerplate)


def _held(value: Column, other: Column) -> Column:
    """``value``, which the optimizer must not move: a filter on it that is pushed below the
    projections would put whole array expressions inside each other's loops."""
    return F.when(F.monotonically_increasing_id() >= 0, value).otherwise(other)


def with_rules(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept."""
    split = rows.withColumn("_t", text)
    split = split.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).withColumn("_l", F.split("_t", "\n"))
    hashed = split.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    counted = (
        hashed.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
        .withColumn("_full", F.filter("_l", lambda x: x.rlike(WORD)))
        # (hash of the window, its first word's place), one for each 3-word window
        .withColumn("_g", F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))))
        .drop("_w", "_h")
    )
    dup_lines = (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")
    # Most texts repeat no window: only the others are sorted with their places.
    repeats = F.size("_g") > F.size(F.array_distinct("_g"))
    placed = F.when(repeats, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<g:bigint,i:int>>)"))
    sorted_ = counted.withColumn("n_dup_lines", dup_lines).withColumn("_s", placed).drop("_g", "_full")
    twice = F.filter("_s", lambda x, k: (x["g"] == F.get("_s", k + 1)["g"]) | ((k > 0) & (x["g"] == F.get("_s", k - 1)["g"])))
    places = sorted_.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_s")
    # Each place covers three words, less what the next place covers again.
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lost = F.aggregate(F.transform("_l", lambda x, k: F.when(line_fails(x, k == F.size("_l") - 1), F.length(x)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    judged = places.withColumn("n_repeat_words", _held(covered, F.lit(0))).withColumn("lost_chars", _held(lost, F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    ok = 100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.length("_t")
    return judged.withColumn("base_failed", failed).withColumn("kept", _held(~F.col("base_failed") & ok, F.lit(False))).drop("_p", "_l")


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and every rule's figure and verdict."""
    return with_rules(docs.select("doc_id", text_or_empty("text").alias("_x")), F.col("_x")).select("doc_id", *OUT)


def _without_failing() -> Column:
    """The lines of ``_l`` that pass, as one text."""
    passed = F.filter(F.transform("_l", lambda x, k: F.when(~line_fails(x, k == F.size("_l") - 1), x)), lambda x: x.isNotNull())
    return F.array_join(passed, "\n")


def clean_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text without its failing lines."""
    return docs.select("doc_id", F.split(text_or_empty("text"), "\n").alias("_l")).select("doc_id", _without_failing().alias("text"))


def filter_documents(docs: DataFrame, clean: bool = False) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were; ``clean`` removes the texts' failing lines."""
    rows = docs.select(carried(docs), F.coalesce(column(docs, "text").cast("string"), F.lit("")).alias("_x"))
    kept = with_rules(rows, F.col("_x")).filter("kept")
    if clean:
        # A failing line is not blank, so a text that lost no characters has none.
        text = F.when(F.col("lost_chars") > 0, _without_failing()).otherwise(F.col("_t"))
        kept = kept.withColumn("_l", F.split("_t", "\n")).withColumn("_row", F.col("_row").withField("text", text))
    return kept.select(*restored(docs.columns))
