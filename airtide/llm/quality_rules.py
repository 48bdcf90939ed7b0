"""Line-first cleaning of documents, with DataFrame expressions alone.

Every line is judged by itself: a punctuation rule, a navigation rule, a symbol rule and
a boilerplate rule. Lines that fail are removed; a document that loses too much of its
text that way is rejected, as is one that fails the two document rules (too few words,
too much repetition).

Nothing is shuffled: all of a document's counts come from its own row. Repeated 5-word
windows are found by hashes first; only documents in which two hashes agree sort their
windows themselves, so equal hashes of different windows change no result.

Edge cases: a null text counts as a text without words, fails the document rules and has
the empty string as cleaned text. Rows are independent, so repeated rows and null ids
come back as often as they came in. Other columns are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_SHARE = 0.5
WINDOW = 5

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"

#: A sentence ends within the line, or the line ends as a sentence, clause or quotation may.
SENTENCE = (
    rf"[.!?…。！？।؟۔։።၊။។༎][\"'”’»)\]」』]*{_SPACE}"
    rf"|[.!?…。！？।؟۔։።၊။។༎:;\"'”’»)\]」』]{_SPACE}*$"
)
#: Letters of scripts that write sentences without a stop, or with one that is often left out.
UNSTOPPED = r"[\x{0E00}-\x{0EFF}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]"
#: Separators between links. A guillemet or a middle dot only counts where it stands alone,
#: and a guillemet only in a line without an opening one.
SEPARATOR = rf"[|›•→]|{_SPACE}·{_SPACE}|{_SPACE}»{_SPACE}"
QUOTING_SEPARATOR = rf"[|›•→]|{_SPACE}·{_SPACE}"
#: What a line without two of these can't be: a menu.
TWO_MARKS = r"[|›•→·»](?s:.*)[|›•→·»]"
#: Fields between separators are short in a menu: so many characters on average.
FIELD_CHARS = 24
#: A line that is nothing but the name of a link.
LINK = (
    rf"(?i)^{_SPACE}*(?:home|menu|next|previous|back to top|sign in|sign up|log ?in|log ?out"
    r"|read more|skip to content|share this|contact us|about us|site ?map)\W*$"
)
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)"
    r"|enable javascript|lorem ipsum|click here|subscribe to our|accept (?:all )?cookies)\b"
)
#: A line is boilerplate if its phrases are more than one part in so many of its characters.
BOILERPLATE_PARTS = 3
MAX_SYMBOL_SHARE = 0.1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+"), "")


def is_menu(line: Column) -> Column:
    """Two separators or more, with short fields between them."""

    def short(separator: str) -> Column:
        n = F.regexp_count(line, F.lit(separator))
        return (n >= 2) & (F.length(line) <= FIELD_CHARS * (n + 1))

    quotes = F.contains(line, F.lit("«"))
    return line.rlike(TWO_MARKS) & F.when(quotes, short(QUOTING_SEPARATOR)).otherwise(short(SEPARATOR))


def is_boilerplate(line: Column) -> Column:
    """Mostly phrases of boilerplate; a mention in a sentence is none."""
    phrases = F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))
    return line.rlike(BOILERPLATE) & (BOILERPLATE_PARTS * phrases > F.length(line))


def line_passes(line: Column, max_symbol_share: float = MAX_SYMBOL_SHARE) -> Column:
    """Whether a line with a word passes all line rules. Each is relative to the line."""
    symbols = F.regexp_count(line, F.lit(_SYMBOL))
    return (
        (line.rlike(SENTENCE) | line.rlike(UNSTOPPED))
        & ~line.rlike(LINK)
        & ~is_menu(line)
        & (symbols <= max_symbol_share * F.length(line))
        & ~is_boilerplate(line)
    )


def judge(
    docs: DataFrame,
    *,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_lost_share: float = MAX_LOST_SHARE,
) -> DataFrame:
    """One row per document: ``row`` (the document as it was) and what the rules say.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``; ``n_lines`` and ``n_failed_lines``, ``clean_text`` (the lines that
    pass), ``lost_share`` (of the characters in lines with a word) and ``kept``.
    """
    out = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    out = out.withColumns(
        {
            "words": words_of(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(_WORD)),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(_SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "passing": F.filter("lines", lambda line: line_passes(line)),
            "windows": _per_window(lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        }
    )
    out = _count_repeated_words(out)
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    line_chars = F.length(F.array_join("lines", ""))
    out = out.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("passing")).cast("long").alias("n_failed_lines"),
        F.array_join("passing", "\n").alias("clean_text"),
        F.when(line_chars > 0, 1 - F.length(F.array_join("passing", "")) / line_chars)
        .otherwise(0.0)
        .alias("lost_share"),
    )
    # The always-true part is not deterministic: a filter on ``kept`` stays above this
    # projection. Moved below it, the rules would be copied into the filter and into each
    # other's lambdas, and run anew for each element.
    stays = F.monotonically_increasing_id() >= 0
    kept = ~F.col("base_failed") & (F.col("lost_share") <= max_lost_share) & stays
    return out.withColumn("kept", kept)


def _per_window(value) -> Column:
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    return F.when(F.size("words") >= WINDOW, F.transform(starts, value)).otherwise(F.array())


def _count_repeated_words(out: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside windows that the text holds twice or more."""
    keep = [c for c in out.columns if c not in ("text", "windows")]
    maybe = F.size(F.array_distinct("windows")) < F.size("windows")
    window = lambda i: F.struct(
        F.array_join(F.slice("words", i, WINDOW), " ").alias("text"), i.alias("at")
    )
    out = out.select(
        *keep, F.when(maybe, F.sort_array(_per_window(window))).alias("_sorted")
    )
    same = lambda x, k: F.coalesce(
        F.get("_sorted", k)["text"] == x["text"], F.lit(False)
    )
    repeated = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.select(
        *keep, F.sort_array(F.transform(repeated, lambda x: x["at"])).alias("_at")
    )
    # A window covers WINDOW words, or those up to the next repeated window.
    covers = F.transform(
        "_at", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - at, F.lit(WINDOW)))
    )
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, n: a + n)
    return out.select(*keep, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def clean(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", **rules) -> DataFrame:
    """The documents that are kept, with the text of their passing lines, other columns as is."""
    judged = judge(docs, text=text, **rules).where("kept")
    replaced = {text: F.col("clean_text"), n_chars: F.length("clean_text").cast("long")}
    return judged.select(
        *[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_failed_lines",
    )


#: The rules again, over rows of lines and words.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), worded AS (
  SELECT *, CASE WHEN contains(line, '«') THEN len(regexp_extract_all(line, '[|›•→]|[\x20\x09-\x0D]·[\x20\x09-\x0D]'))
    ELSE len(regexp_extract_all(line, '[|›•→]|[\x20\x09-\x0D]·[\x20\x09-\x0D]|[\x20\x09-\x0D]»[\x20\x09-\x0D]')) END AS separators
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT *,
    (regexp_matches(line, '[.!?…。！？।؟۔։።၊။។༎]["''”’»)\]」』]*[\x20\x09-\x0D]|[.!?…。！？।؟۔։።၊။។༎:;"''”’»)\]」』][\x20\x09-\x0D]*$')
      OR regexp_matches(line, '[\x{0E00}-\x{0EFF}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]'))
    AND NOT regexp_matches(line, '(?i)^[\x20\x09-\x0D]*(?:home|menu|next|previous|back to top|sign in|sign up|log ?in|log ?out|read more|skip to content|share this|contact us|about us|site ?map)\W*$')
    AND NOT (separators >= 2 AND length(line) <= 24 * (separators + 1))
    AND length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) <= 0.1 * length(line)
    AND 3 * (length(line) - length(regexp_replace(line, '(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|click here|subscribe to our|accept (?:all )?cookies)\b', '', 'g'))) <= length(line)
    AS passes
  FROM worded
), per_line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (WHERE NOT passes) AS n_failed_lines,
         sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (WHERE passes), 0) AS kept_chars
  FROM judged GROUP BY r
), words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), twice AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next
  FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, sum(least(5, coalesce(next - i, 5))) AS n_repeat_words FROM twice GROUP BY r
), counts AS (
  SELECT d.doc_id, d.r, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
         coalesce(kept_chars, 0) AS kept_chars, coalesce(chars, 0) AS chars
  FROM d JOIN words USING (r) LEFT JOIN per_line USING (r) LEFT JOIN repeats USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND (chars = 0 OR 1 - kept_chars::DOUBLE / chars <= 0.5) AS kept,
       n_lines, n_failed_lines
FROM counts
"""
