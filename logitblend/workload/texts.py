"""Cleaning and answer extraction over whole text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.functions import answers, text
from logitblend.workload.inputs import table

# The patterns in the dialect of the comparing engine.
SQL_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SQL_NON_SPACE = "[^" + SQL_SPACE[1:]
SQL_TRIM = "'" + text.WHITESPACE_CHARS + "'"
SQL_NUMBER = r"(-?\d+[.,]?\d*)"
SQL_BOXED = r"\\boxed\{" + SQL_NUMBER + r"\}"
SQL_MARKED = f"####{SQL_SPACE}*{SQL_NUMBER}"
SQL_STATED = r"answer is (\d+)"
SQL_CURRENCY = "[$€£]?" + SQL_NUMBER
SQL_EARLIER = r"(-?\d*[.,]?\d+)"


def sql_strip(s: str) -> str:
    return f"trim({s}, {SQL_TRIM})"


def sql_collapse(s: str) -> str:
    return f"trim(regexp_replace({s}, '{SQL_SPACE}+', ' ', 'g'), ' ')"


def sql_cut(s: str, word: str, marker: str) -> str:
    return (
        f"CASE WHEN contains({s}, '{word}') THEN "
        + sql_strip(f"split_part({s}, '{marker}', 1)")
        + f" ELSE {s} END"
    )


def sql_last_number(s: str, pattern: str) -> str:
    return (
        f"try_cast(replace(list_last(regexp_extract_all({s}, '{pattern}', 1)), ',', '') AS DOUBLE)"
    )


def sql_extract_number(s: str) -> str:
    tries = [SQL_MARKED, SQL_BOXED, "the " + SQL_STATED, SQL_NUMBER]
    return "coalesce(" + ", ".join(sql_last_number(s, p) for p in tries) + ")"


def defined(number: Column) -> Column:
    """NaN as null: engines print and hash NaN in different ways."""
    return F.nanvl(number, F.lit(None).cast("double"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and conversation turn with one of five endings."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("int"), "text"
    )
    ending = F.element_at(
        F.array(
            F.lit("\u00a0\u3000Question: what next?\nAnswer: 7"),
            F.lit(" A Question here\t"),
            F.lit("\u2003 Explanation: because\u2028"),
            F.lit("\nqUeStIoN: one\nexplanation: two\u0085"),
            F.lit(" 3 4 1,234.5e6/7."),
        ),
        ((F.col("id") + F.col("turn")) % 5 + 1).cast("int"),
    )
    return docs.unionByName(turns).select(
        "kind", "id", "turn", F.concat("text", ending).alias("text")
    )


SQL_OUTPUTS = """
WITH sources AS (
  SELECT 'document' AS kind, doc_id AS id, 0::INTEGER AS turn, text FROM documents
  UNION ALL SELECT 'turn', conv_id, turn::INTEGER, text FROM conversations),
outputs AS (
  SELECT kind, id, turn, text || CASE (id + turn) % 5
    WHEN 0 THEN chr(160) || chr(12288) || 'Question: what next?' || chr(10) || 'Answer: 7'
    WHEN 1 THEN ' A Question here' || chr(9)
    WHEN 2 THEN chr(8195) || ' Explanation: because' || chr(8232)
    WHEN 3 THEN chr(10) || 'qUeStIoN: one' || chr(10) || 'explanation: two' || chr(133)
    ELSE ' 3 4 1,234.5e6/7.' END AS text
  FROM sources)
"""


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, collapsed = F.col("text"), F.col("collapsed")
    rows = _outputs(spark, sf_dir).withColumn("collapsed", text.collapse_whitespace(output))
    return rows.select(
        "kind", "id", "turn", "collapsed",
        text.strip(output).alias("stripped"),
        text.cut_at_markers(collapsed, explanation=False).alias("before_question"),
        text.cut_at_markers(output).alias("before_markers"),
        text.cut_trailers(output).alias("without_trailers"),
        text.keep_numeric_chars(output).alias("numeric_chars"),
        text.clean_number(output).alias("number_text"),
        text.drop_last_char(output).alias("without_last"),
    )


_BEFORE_Q = sql_cut("text", "Question", "Question:")
CLEAN_TEXT = SQL_OUTPUTS + f""",
cleaned AS (SELECT *, {sql_collapse("text")} AS collapsed, {_BEFORE_Q} AS q FROM outputs)
SELECT kind, id, turn, collapsed, {sql_strip("text")} AS stripped,
       {sql_cut("collapsed", "Question", "Question:")} AS before_question,
       {sql_cut("q", "Explanation", "Explanation")} AS before_markers,
       regexp_replace(text, '(?i)(Question|Explanation):[^\\n]*', '', 'g') AS without_trailers,
       {sql_strip(r"regexp_replace(text, '[^\p{Nd}.,\-eE/]', '', 'g')")} AS numeric_chars,
       {sql_strip("replace(replace(text, ',', ''), ' ', '')")} AS number_text,
       {sql_strip("substring(text, 1, length(text) - 1)")} AS without_last
FROM cleaned
"""


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select(
        "kind", "id", "turn", text.word_count(F.col("text")).alias("words")
    )


WORD_COUNT = SQL_OUTPUTS + f"""
SELECT kind, id, turn,
       len(regexp_extract_all(text, '{SQL_NON_SPACE}+'))::INTEGER AS words
FROM outputs
"""


def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated solutions stating a line's quantity in one of several styles."""
    n = F.col("l_quantity").cast("int").cast("string")
    key = F.col("l_orderkey").cast("string")
    style = F.col("l_linenumber") % 7
    solution = (
        F.when(style == 0, F.concat(F.lit("First 12. the answer is "), key, F.lit(" #### "), n))
        .when(style == 1, F.concat(F.lit("so \\boxed{"), n, F.lit("} and the answer is 5")))
        .when(style == 2, F.concat(F.lit("the answer is "), n, F.lit(". Order "), key))
        .when(style == 3, F.concat(F.lit("it is "), n, F.lit(". Question: and "), key, F.lit("?")))
        .when(style == 4, F.concat(F.lit("#### -"), n, F.lit(",500.5 in all")))
        .when(style == 5, F.concat(F.lit("between -"), n, F.lit(" and 1,234.5")))
        .otherwise(F.lit("no number at all"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", solution.alias("text")
    )


SQL_SOLUTIONS = r"""
WITH solutions AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7
    WHEN 0 THEN 'First 12. the answer is ' || l_orderkey || ' #### ' || l_quantity::INTEGER
    WHEN 1 THEN 'so \boxed{' || l_quantity::INTEGER || '} and the answer is 5'
    WHEN 2 THEN 'the answer is ' || l_quantity::INTEGER || '. Order ' || l_orderkey
    WHEN 3 THEN 'it is ' || l_quantity::INTEGER || '. Question: and ' || l_orderkey || '?'
    WHEN 4 THEN '#### -' || l_quantity::INTEGER || ',500.5 in all'
    WHEN 5 THEN 'between -' || l_quantity::INTEGER || ' and 1,234.5'
    ELSE 'no number at all' END AS text
  FROM lineitem)
"""


def extract_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    solution = F.col("text")
    parts = _solutions(spark, sf_dir).withColumns(
        {
            "cut": text.cut_at_markers(solution),
            "kept": answers.clean_solution(solution, "whitelist"),
        }
    )
    return parts.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        defined(answers.extract_number(F.col("cut"))).alias("number"),
        defined(answers.extract_number(F.col("kept"), ())).alias("whitelist_number"),
        defined(answers.extract_number(solution, answers.NUMBER_PATTERNS)).alias("table_number"),
        defined(answers.extract_number_after_marker(solution)).alias("earlier_number"),
    )


_CUT = sql_cut("q", "Explanation", "Explanation")
_KEPT = sql_strip(
    r"regexp_replace(regexp_replace(collapsed, '(?i)(Question|Explanation):[^\n]*', '', 'g'),"
    r" '[^\p{Nd}.,\-eE/]', '', 'g')"
)
EXTRACT_NUMBER = SQL_SOLUTIONS + f""",
parts AS (
  SELECT *, {_BEFORE_Q} AS q, {sql_collapse("text")} AS collapsed,
         CASE WHEN contains(text, 'boxed') THEN list_last(string_split(text, 'boxed'))
              WHEN contains(text, 'the answer is ')
              THEN {sql_strip("list_last(string_split(text, 'the answer is '))")}
              WHEN contains(text, 'The answer is ')
              THEN {sql_strip("list_last(string_split(text, 'The answer is '))")}
              ELSE text END AS tail
  FROM solutions),
cuts AS (SELECT *, {_CUT} AS cut, {_KEPT} AS kept FROM parts)
SELECT l_orderkey, l_linenumber, l_partkey,
       {sql_extract_number("cut")} AS number,
       {sql_extract_number("kept")} AS whitelist_number,
       coalesce({sql_last_number("text", SQL_BOXED)}, {sql_last_number("text", SQL_MARKED)},
                {sql_last_number("text", SQL_STATED)}, {sql_last_number("text", SQL_CURRENCY)}
       ) AS table_number,
       {sql_last_number("tail", SQL_EARLIER)} AS earlier_number
FROM cuts
"""


def extract_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select(
        "kind", "id", "turn", defined(answers.extract_number(F.col("text"))).alias("number")
    )


EXTRACT_NUMBER_TEXT = SQL_OUTPUTS + f"""
SELECT kind, id, turn, {sql_extract_number("text")} AS number FROM outputs
"""


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    def letter(base: int) -> Column:
        return F.char(F.lit(65) + F.col("o_orderkey") % base)

    style = F.col("o_orderkey") % 5
    reply = (
        F.when(style == 0, F.concat(F.lit("Clearly the answer is "), letter(4), F.lit(" or B")))
        .when(style == 1, F.concat(F.lit("The answer is "), letter(3), F.lit(". Because C")))
        .when(style == 2, F.concat(F.lit("A then \\boxed{"), letter(4), F.lit("} D")))
        .when(style == 3, F.concat(F.col("o_orderpriority"), F.lit(" so "), letter(7)))
        .otherwise(F.lit("none of these"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply"))


def extract_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select(
        "o_orderkey", F.coalesce(answers.extract_choice(F.col("reply")), F.lit("-")).alias("choice")
    )


EXTRACT_CHOICE = r"""
WITH replies AS (
  SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN 'Clearly the answer is ' || chr((65 + o_orderkey % 4)::INTEGER) || ' or B'
    WHEN 1 THEN 'The answer is ' || chr((65 + o_orderkey % 3)::INTEGER) || '. Because C'
    WHEN 2 THEN 'A then \boxed{' || chr((65 + o_orderkey % 4)::INTEGER) || '} D'
    WHEN 3 THEN o_orderpriority || ' so ' || chr((65 + o_orderkey % 7)::INTEGER)
    ELSE 'none of these' END AS reply
  FROM orders),
tails AS (
  SELECT o_orderkey,
         CASE WHEN contains(reply, 'boxed') THEN list_last(string_split(reply, 'boxed'))
              WHEN contains(reply, 'the answer is ')
              THEN list_last(string_split(reply, 'the answer is '))
              WHEN contains(reply, 'The answer is ')
              THEN list_last(string_split(reply, 'The answer is '))
              ELSE reply END AS tail,
         contains(reply, 'boxed') OR contains(reply, 'he answer is ') AS marked
  FROM replies)
SELECT o_orderkey,
       coalesce(CASE WHEN marked THEN regexp_extract_all(tail, '[A-D]')[1]
                     ELSE list_last(regexp_extract_all(tail, '[A-D]')) END, '-') AS choice
FROM tails
"""


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("int").cast("string")
    style = F.col("l_linenumber") % 5
    answer = (
        F.when(style == 0, F.concat(F.lit("The Answer Is "), n, F.lit(",000")))
        .when(style == 1, F.concat(F.lit("step 3\n#### -"), n))
        .when(style == 2, F.concat(F.lit("the answer is -"), n, F.lit("; answer is 4")))
        .when(style == 3, F.concat(F.lit("7 of "), n))
        .otherwise(F.lit("unknown"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", answer.alias("answer"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "answer",
            defined(answers.gold_label(F.col("answer"))).alias("stated"),
            defined(answers.strict_gold_label(F.col("answer"))).alias("strict"),
            defined(answers.lenient_gold_label(F.col("answer"))).alias("lenient"),
        )
    )


GOLD_LABELS = r"""
WITH golds AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5
    WHEN 0 THEN 'The Answer Is ' || l_quantity::INTEGER || ',000'
    WHEN 1 THEN 'step 3' || chr(10) || '#### -' || l_quantity::INTEGER
    WHEN 2 THEN 'the answer is -' || l_quantity::INTEGER || '; answer is 4'
    WHEN 3 THEN '7 of ' || l_quantity::INTEGER
    ELSE 'unknown' END AS answer
  FROM lineitem)
SELECT *, try_cast(regexp_extract(answer, '(?i)answer is (-?\d+)', 1) AS DOUBLE) AS stated,
       try_cast(regexp_extract(answer, '#### (-?\d+)', 1) AS DOUBLE) AS strict,
       coalesce(try_cast(regexp_extract(answer, 'answer is (\d+)', 1) AS DOUBLE),
                try_cast(list_last(regexp_extract_all(answer, '\d+')) AS DOUBLE)) AS lenient
FROM golds
"""


QUERIES = {
    "clean_text": clean_text,
    "word_count": word_count,
    "extract_number": extract_number,
    "extract_number_text": extract_number_text,
    "extract_choice": extract_choice,
    "gold_labels": gold_labels,
}

ORACLES = {
    "clean_text": CLEAN_TEXT,
    "word_count": WORD_COUNT,
    "extract_number": EXTRACT_NUMBER,
    "extract_number_text": EXTRACT_NUMBER_TEXT,
    "extract_choice": EXTRACT_CHOICE,
    "gold_labels": GOLD_LABELS,
}
