"""Line-first quality rules, in DataFrame functions only.

Each line is judged by three families of rules: punctuation (short lines without a
closing mark, lines thick with symbols or doubled exclamation marks), navigation
(menus: short items between bars or arrows) and boilerplate (stock phrases of sites
and licences in lines of at most 25 words). Lines that fail are removed; a document that loses more than
`max_lost` of its words is rejected, and so is one that fails the base figures
(under 20 words, or over 30 % of the words inside repeated 8-word windows).

Nulls and odd input: a null or empty text has no words and is rejected
(base_failed); its cleaned text stays null or empty. Repeated rows are judged alike,
each row by itself. Other columns of any name pass through: all results are in one
struct column, `into`.

There is no shuffle: everything of a document is computed inside its row. Repeated
windows are found by sorting the 64-bit hashes of a document's windows, and only in
documents that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import filtered, unused

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
MAX_LOST = 0.5
BOILERPLATE_WORDS = 25
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = r"(?:^|[ \t])[|>»›•·](?:[ \t\r]|$)"
#: Closing marks of Latin, Chinese and Japanese, Arabic, Indic, Ethiopic, Armenian, Khmer and Burmese script.
CLOSED = r"[.!?:;,…\"'”’»)\]。！？：；，、．｡」』】）؟؛،۔।॥።፧։។၊။][ \t\r]*$"
BOILERPLATE = (
    r"(?i)(?:all rights reserved|cookie (?:policy|settings)|accept (?:all )?cookies|privacy policy|terms of (?:use|service)"
    r"|enable javascript|subscribe to our|sign up for our|newsletter|click here|read more$|share on (?:facebook|twitter)"
    r"|powered by|licensed under|released under|copyright (?:\(c\)|©|[0-9]{4}))"
)


#: Names of columns on the way.
USED = {f"__{c}" for c in ("lines", "words", "n", "chars", "w1", "w2", "w4", "w8", "worded", "judged", "windows", "failed", "repeat", "lost")}


def line_fails(line: Column, n: Column) -> Column:
    """True for a line of n > 0 words that a rule removes; false for any other line."""
    bars = F.regexp_count(line, F.lit(SEPARATOR))
    punctuation = (
        ((n < 4) & ~line.rlike(CLOSED))
        | (2 * F.regexp_count(line, F.lit(SYMBOLS)) > n)
        | (3 * F.regexp_count(line, F.lit("!!")) > n)
    )
    navigation = 4 * F.when(F.contains(line, F.lit("|")) | line.rlike("[>»›•·]"), bars).otherwise(0) >= F.greatest(n, F.lit(8))
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return (n > 0) & (punctuation | navigation | boilerplate)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE, -1), "")


def _chained(hashes: Column, step: int, n: Column) -> Column:
    """Each hash combined with the one `step` further on."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        same = lambda a, j: F.coalesce(F.get(s, j)["h"] == a["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.transform(s, lambda a, j: F.struct(a["i"].alias("i"), (same(a, j - 1) | same(a, j + 1)).alias("t"))), lambda a: a["t"]), lambda a: a["i"]))

    def total(p: Column) -> Column:
        each = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - x), F.lit(WINDOW)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    # one-element arrays bind the sorted arrays to a name, so that they are computed once
    bound = F.transform(F.array(ordered), twins)
    return F.get(F.transform(bound, total), F.lit(0))


def assess(docs: DataFrame, text: str = "text", into: str = "quality", max_lost: float = MAX_LOST) -> DataFrame:
    """docs with a struct column `into`: the base figures, lost_words, failed_lines, cleaned, base_failed, kept."""
    # columns of the names used on the way are set aside
    clashing = [c for c in docs.columns if c.lower() in USED]
    aside = dict(zip(clashing, unused(docs, *(f"aside_{c}" for c in clashing)), strict=True))
    docs, text = docs.withColumnsRenamed(aside), aside.get(text, text)
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("__lines", F.transform(F.split(t, "\n", -1), lambda x: F.struct(x.alias("line"), _words(x).alias("words"))))
    step = step.withColumns(
        {
            "__words": F.flatten(F.transform("__lines", lambda x: x["words"])),
            "__lines": F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"))),
        }
    )
    step = step.withColumns(
        {
            "__n": F.size("__words"),
            "__chars": F.length(F.array_join("__words", "")).cast("long"),
            "__w1": F.transform("__words", lambda w: F.xxhash64(w)),
            "__worded": F.transform(F.filter("__lines", lambda x: x["n"] > 0), lambda x: x["line"]),
            "__judged": F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_fails(x["line"], x["n"]).alias("fails"))),
        }
    ).drop("__words", "__lines")
    # hashes of windows of 2, 4 and then 8 words; only the first n - 7 of the last are whole
    step = step.withColumn("__w2", _chained(F.col("__w1"), 1, F.col("__n"))).drop("__w1")
    step = step.withColumn("__w4", _chained(F.col("__w2"), 2, F.col("__n"))).drop("__w2")
    step = step.withColumn("__w8", _chained(F.col("__w4"), 4, F.col("__n"))).drop("__w4")
    step = step.withColumns(
        {
            "__windows": F.when(F.col("__n") > WINDOW, F.slice("__w8", F.lit(1), F.col("__n") - (WINDOW - 1))),
            "__failed": F.filter("__judged", lambda x: x["fails"]),
        }
    ).drop("__w8")
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    step = step.withColumns(
        {
            "__repeat": F.when(F.col("__windows").isNotNull() & some, _covered(F.col("__windows"))).otherwise(F.lit(0)).cast("long"),
            "__lost": F.aggregate("__failed", F.lit(0).cast("long"), lambda a, x: a + x["n"]),
        }
    )
    base_failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__repeat") > REPEAT_PERCENT * F.col("__n"))
    lost_too_much = F.col("__lost") > max_lost * F.col("__n")
    result = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.col("__lost").alias("lost_words"),
        F.size("__failed").cast("long").alias("failed_lines"),
        F.when(F.col(text).isNotNull(), F.array_join(F.transform(F.filter("__judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")).alias("cleaned"),
        base_failed.alias("base_failed"),
        (~base_failed & ~lost_too_much).alias("kept"),
    )
    done = step.withColumn(into, result).drop("__n", "__chars", "__worded", "__judged", "__windows", "__failed", "__repeat", "__lost")
    return done.withColumnsRenamed({new: old for old, new in aside.items()})


def op2(docs: DataFrame) -> DataFrame:
    q = assess(docs.select("doc_id", "text"))
    return q.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "failed_lines")))


def stage(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, with the failing lines removed; n_chars follows the text."""
    (into,) = unused(docs, "quality")
    good = filtered(assess(docs, into=into), F.col(f"{into}.kept"))
    new = {"text": F.col(f"{into}.cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col(f"{into}.cleaned")).cast(docs.schema["n_chars"].dataType)
    return good.withColumns(new).select(docs.columns)


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
 wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)),
 twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
 cover AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
 judged AS (
  SELECT doc_id, n,
     ((n < 4 AND NOT regexp_matches(line, 'CLOSED'))
       OR 2 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > n
       OR 3 * len(regexp_extract_all(line, '!!')) > n
       OR 4 * bars >= greatest(n, 8)
       OR (n <= 25 AND regexp_matches(line, 'BOILER'))) AS fails
  FROM (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
               len(regexp_extract_all(line, '(?:^|[ \t])[|>»›•·](?:[ \t\r]|$)')) AS bars
        FROM (SELECT doc_id, unnest(lines) AS line FROM base))
  WHERE n > 0),
 lost AS (SELECT doc_id, CAST(sum(CASE WHEN fails THEN n ELSE 0 END) AS BIGINT) AS lost_words, CAST(count(*) FILTER (fails) AS BIGINT) AS failed_lines FROM judged GROUP BY doc_id),
 figures AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
     CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
     CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words, coalesce(failed_lines, 0) AS failed_lines
  FROM base b LEFT JOIN cover c ON b.doc_id = c.doc_id LEFT JOIN lost l ON b.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
   (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
   (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT lost_words > 0.5 * n_words) AS kept,
   lost_words, failed_lines
FROM figures
""".replace("BOILER", BOILERPLATE.replace("'", "''")).replace("CLOSED", CLOSED.replace("'", "''"))
