"""Blending queries over ``embeddings`` taken as logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.functions import half, vectors
from logitblend.functions.text import normalize_token
from logitblend.operators import blending, candidates, sequences
from logitblend.plans import ensemble
from logitblend.schemas import STEP_KEYS
from logitblend.sources.shared import written
from logitblend.workload import inputs
from logitblend.workload.inputs import SPACE, UNDERSCORE, ensemble_sql, table

MODEL_KEYS = candidates.MODEL_KEYS


def _rounded(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column).cast("double"), digits).alias(column)


def _id(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(-1)).cast("int").alias(column)


def topk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.top_k_softmax(inputs.logits(spark, sf_dir, 2)).select(
        *MODEL_KEYS, "pos", "token_id", _rounded("score"), _rounded("p")
    )


TOPK_TOKENS = ensemble_sql(2) + """,
weights AS (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY run, example_id, step, model)) AS e
  FROM top)
SELECT run, example_id, step, model, pos::INTEGER AS pos, token_id, round(logit, 6) AS score,
       round(e / sum(e) OVER (PARTITION BY run, example_id, step, model), 6) AS p
FROM weights
"""


def topk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("run"),
        F.col("l_orderkey").alias("example_id"),
        F.lit(0).alias("step"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("model"),
        F.col("l_partkey").cast("int").alias("token_id"),
        F.col("l_extendedprice").alias("logit"),
    )
    return candidates.top_k_long(long, 2)


TOPK_LONG = """
WITH logit AS (
  SELECT 'lineitem' AS run, l_orderkey AS example_id, 0::INTEGER AS step,
         (l_linenumber % 2 + 1)::INTEGER AS model, l_partkey::INTEGER AS token_id,
         l_extendedprice AS score
  FROM lineitem)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY run, example_id, step, model
                               ORDER BY score DESC, token_id)::INTEGER AS pos
  FROM logit)
WHERE pos <= 2
"""


def token_normalize_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = candidates.top_k(inputs.logits(spark, sf_dir, 2))
    odd = F.col("token_id") % 2 == 1
    raw = F.concat(
        F.when(odd, UNDERSCORE).otherwise(SPACE), F.lit("t"), F.expr("token_id div 2")
    )
    merged = candidates.merge_spellings(ranked.withColumn("token", normalize_token(raw)))
    return merged.select(*MODEL_KEYS, "token", "pos", "token_id", _rounded("score"))


TOKEN_NORMALIZE_COLLAPSE = ensemble_sql(2) + f""",
named AS (
  SELECT *, replace(CASE WHEN token_id % 2 = 1 THEN '{UNDERSCORE}' ELSE '{SPACE}' END
                    || 't' || (token_id // 2), '{UNDERSCORE}', '{SPACE}') AS token
  FROM top)
SELECT run, example_id, step, model, token, min(pos)::INTEGER AS pos,
       arg_max(token_id, pos) AS token_id, round(arg_max(logit, pos), 6) AS score
FROM named GROUP BY run, example_id, step, model, token
"""


def _union(n: int):
    def union_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
        return candidates.union_tokens(
            ensemble.own_candidates(
                inputs.logits(spark, sf_dir, n), inputs.vocab(spark, n)
            )
        )

    return union_vocab


def _union_sql(n: int) -> str:
    return ensemble_sql(n) + "SELECT run, example_id, step, token FROM joint"


def _sets(
    spark: SparkSession, sf_dir: str, n: int, literal_skip: bool = False, **options
) -> DataFrame:
    return ensemble.filled_sets(
        inputs.logits(spark, sf_dir, n),
        inputs.vocab(spark, n),
        inputs.subtokens(spark, n),
        inputs.profiles(n, literal_skip),
        **options,
    )


_SET_SQL = """
SELECT run, example_id, step, model, token, pos::INTEGER AS pos,
       coalesce(token_id, -1)::INTEGER AS token_id, source, repeated,
       coalesce(round(score, 6), -99.0::DOUBLE) AS score
FROM sets
"""


def _fill(n: int, literal_skip: bool = False, **options):
    def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
        score = F.coalesce(F.round("score", 6), F.lit(-99.0)).alias("score")
        return _sets(spark, sf_dir, n, literal_skip, **options).select(
            *MODEL_KEYS, "token", "pos", _id("token_id"), "source", "repeated", score
        )

    return fill_missing


def union_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, 2).select(
        *MODEL_KEYS, "token", "pos", _rounded("p")
    )


UNION_SOFTMAX = ensemble_sql(2) + """
SELECT run, example_id, step, model, token, pos::INTEGER AS pos, round(p, 6) AS p FROM probs
"""


def drop_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    probabilities = _sets(spark, sf_dir, 2).withColumn("score", F.col("p"))
    return blending.drop_tokens(probabilities, 0.05).select(*MODEL_KEYS, "token", _rounded("p"))


DROP_TOKEN = ensemble_sql(2) + """,
kept AS (SELECT run, example_id, step, token FROM probs WHERE model = 1 AND p > 0.05)
SELECT run, example_id, step, model, token, round(p, 6) AS p
FROM probs SEMI JOIN kept USING (run, example_id, step, token)
"""


def vector_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode(vectors.softmax(F.col("embedding"))).alias("i", "p"))
        .select("vec_id", "i", _rounded("p", 9))
    )


VECTOR_SOFTMAX = """
WITH raw AS (
  SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i,
         unnest(embedding)::DOUBLE AS x
  FROM embeddings),
exps AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM raw)
SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM exps
"""


def _picks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ensemble.picks(
        inputs.logits(spark, sf_dir, n),
        inputs.vocab(spark, n),
        inputs.subtokens(spark, n),
        inputs.profiles(n),
    )


def report_picks(picked: DataFrame, n: int) -> DataFrame:
    return picked.select(
        *STEP_KEYS, "token", F.coalesce("next_token", F.lit("-")).alias("next_token"),
        _rounded("p"), "n_models", *[_id(f"token_id_{m}") for m in range(1, n + 1)],
    )


def _pick(n: int):
    def ensemble_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report_picks(_picks(spark, sf_dir, n), n)

    return ensemble_pick


def _pick_sql(n: int, extra: str = "", **options) -> str:
    ids = ", ".join(
        f"coalesce(token_id_{m}, -1)::INTEGER AS token_id_{m}" for m in range(1, n + 1)
    )
    return ensemble_sql(n, **options) + f"""
SELECT run, example_id, step, token, coalesce(next_token, '-') AS next_token,
       round(p, 6) AS p, n_models, {ids}{extra}
FROM picks
"""


def ensemble_pick_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-model blend over logits stored one row per token."""
    picked = ensemble.picks(
        inputs.long_logits(spark, sf_dir, 2),
        inputs.vocab(spark, 2),
        inputs.subtokens(spark, 2),
        inputs.profiles(2),
    )
    return report_picks(picked, 2)


# Entries of a vector that the vocabularies of the variants list; every how many vectors
# one is empty.
LISTED, GAP = 56, 5


def fill_missing_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors wider than the vocabularies, and models without a score at some steps."""
    sets = ensemble.filled_sets(
        inputs.logits(spark, sf_dir, 2, GAP),
        inputs.vocab(spark, 2, LISTED),
        inputs.subtokens(spark, 2),
        inputs.profiles(2),
    )
    score = F.coalesce(F.round("score", 6), F.lit(-99.0)).alias("score")
    return sets.select(*MODEL_KEYS, "token", "pos", _id("token_id"), "source", "repeated", score)


def ensemble_pick_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = ensemble.picks(
        inputs.logits(spark, sf_dir, 2, GAP),
        inputs.vocab(spark, 2, LISTED),
        inputs.subtokens(spark, 2),
        inputs.profiles(2),
    )
    return report_picks(picked, 2).join(
        picked.select(*STEP_KEYS, F.col("unnamed").cast("int").alias("unnamed")), STEP_KEYS
    )


def ensemble_pick_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with NaN and infinite entries: the pick is that of the models that have scores."""
    picked = ensemble.picks(
        inputs.logits(spark, sf_dir, 3, faulty=True),
        inputs.vocab(spark, 3),
        inputs.subtokens(spark, 3),
        inputs.profiles(3),
    )
    faulty = picked.select(*STEP_KEYS, "n_faulty")
    return report_picks(picked, 3).join(faulty, STEP_KEYS)


def _packed(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """A table of packed vectors, as a run in half precision would leave it."""
    rows = inputs.logits(spark, sf_dir, n).withColumn("logits", half.packed(F.col("logits")))
    return written(rows, "half")


def topk_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top k of vectors in packed half precision."""
    return candidates.top_k(_packed(spark, sf_dir, 2)).select(*MODEL_KEYS, "pos", "token_id", _rounded("score"))


def ensemble_pick_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-model blend over logits in packed half precision."""
    picked = ensemble.picks(
        _packed(spark, sf_dir, 2),
        inputs.vocab(spark, 2),
        inputs.subtokens(spark, 2),
        inputs.profiles(2),
    )
    return report_picks(picked, 2)


# A number rounded to half precision: to a multiple of a power of two, 1,024 of which make the
# power of two at or below it.
SQL_HALF = """(CASE WHEN abs(x::DOUBLE * 10) < 2.0::DOUBLE ** -14
               THEN round_even(x::DOUBLE * 10 * 2.0::DOUBLE ** 24, 0) / 2.0::DOUBLE ** 24
               ELSE round_even(x::DOUBLE * 10 / 2.0::DOUBLE ** (floor(log2(abs(x::DOUBLE * 10))) - 10), 0)
                    * 2.0::DOUBLE ** (floor(log2(abs(x::DOUBLE * 10))) - 10) END / 10)"""
TOPK_HALF = ensemble_sql(2, value=SQL_HALF) + """
SELECT run, example_id, step, model, pos::INTEGER AS pos, token_id, round(logit, 6) AS score FROM top
"""


def _mean(n: int, lam: float | None = None):
    def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ensemble.blended(
            inputs.logits(spark, sf_dir, n),
            inputs.vocab(spark, n),
            inputs.subtokens(spark, n),
            inputs.profiles(n, lam=lam),
        ).select(*STEP_KEYS, "token", _rounded("p"), "n_models")

    return ensemble_mean


def _mean_sql(n: int, lam: float | None = None) -> str:
    return ensemble_sql(n, lam=lam) + """
SELECT run, example_id, step, token, round(p, 6) AS p, n_models FROM blended
"""


def confidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.confidence_trace(inputs.logits(spark, sf_dir, 2)).select(
        *MODEL_KEYS, _rounded("confidence")
    )


CONFIDENCE_TRACE = ensemble_sql(2) + """,
peaks AS (SELECT *, max(logit) OVER (PARTITION BY run, example_id, step, model) AS peak FROM top)
SELECT run, example_id, step, model, round(1 / sum(exp(logit - peak)), 6) AS confidence
FROM peaks GROUP BY run, example_id, step, model
"""


def ensemble_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.assemble(_picks(spark, sf_dir, 2)).select(
        "run", "example_id", "n_steps", "text",
        F.array_join(F.transform("token_ids", lambda i: i.cast("string")), " ", "-").alias("ids"),
    )


ENSEMBLE_TEXTS = ensemble_sql(2) + f"""
SELECT run, example_id, count(*)::INTEGER AS n_steps,
       trim(regexp_replace(coalesce(string_agg(
         CASE WHEN special THEN '' ELSE
           replace(replace(replace(replace(next_token, '{UNDERSCORE}', ' '), '{SPACE}', ' '),
                   'Ċ', chr(10)), '<0x0A>', chr(10)) END,
         '' ORDER BY step), ''), '\\s+', ' ', 'g')) AS text,
       string_agg(coalesce(token_id_1::VARCHAR, '-'), ' ' ORDER BY step) AS ids
FROM picks GROUP BY run, example_id
"""


def assemble_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a conversation as a step."""
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("example_id"),
        "turn",
        F.posexplode(F.split("text", " ")).alias("nth", "word"),
    )
    steps = words.select(
        "example_id",
        F.struct("turn", "nth").alias("step"),
        F.concat(F.lit(SPACE), "word").alias("next_token"),
    )
    return sequences.assemble(steps, by=["example_id"], token_id=None)


ASSEMBLE_SEQUENCE = r"""
SELECT conv_id AS example_id, sum(len(string_split(text, ' ')))::INTEGER AS n_steps,
       trim(regexp_replace(string_agg(' ' || text, '' ORDER BY turn),
            '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',
            ' ', 'g')) AS text
FROM conversations GROUP BY conv_id
"""


def assemble_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as steps, some of them missing and some logged twice."""
    step = F.col("l_linenumber") - 1
    lines = table(spark, sf_dir, "lineitem").filter((F.col("l_partkey") + step) % 3 > 0)
    twice = F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    steps = lines.select(
        F.col("l_orderkey").alias("example_id"),
        step.cast("int").alias("step"),
        F.explode(twice).alias("nth"),
        "l_partkey",
    ).withColumn("next_token", F.concat(F.lit(SPACE), "l_partkey", "nth"))
    found = sequences.assemble(steps.drop("nth"), ["example_id"], token_id=None, expected=7)
    runs = F.transform("missing_steps", lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["stop"].cast("string")))
    return found.select(
        "example_id", "n_steps", "text", "n_missing", F.array_join(runs, " ").alias("missing"),
        F.array_join(F.col("repeated_steps").cast("array<string>"), " ").alias("repeated"),
    )


ASSEMBLE_GAPS = """
WITH lines AS (
  SELECT l_orderkey AS o, l_linenumber - 1 AS s, l_partkey AS p, l_partkey % 5 = 0 AS twice
  FROM lineitem WHERE (l_partkey + l_linenumber - 1) % 3 > 0),
steps AS (
  SELECT o, s, p || 'a' AS t FROM lines UNION ALL SELECT o, s, p || 'b' FROM lines WHERE twice),
texts AS (
  SELECT o, count(*)::INTEGER AS n_steps, string_agg(t, ' ' ORDER BY s, t) AS text FROM steps GROUP BY o),
repeated AS (
  SELECT o, string_agg(s, ' ' ORDER BY s) AS repeated
  FROM (SELECT o, s FROM steps GROUP BY o, s HAVING count(*) > 1) GROUP BY o),
lacking AS (
  SELECT o, s, s - row_number() OVER (PARTITION BY o ORDER BY s) AS island
  FROM (SELECT o, unnest(range(0, 7)) AS s FROM texts) ANTI JOIN lines USING (o, s)),
islands AS (
  SELECT o, min(s) AS a, max(s) AS b FROM lacking GROUP BY o, island),
missing AS (
  SELECT o, sum(b - a + 1)::BIGINT AS n, string_agg(a || '-' || b, ' ' ORDER BY a) AS runs FROM islands GROUP BY o)
SELECT o AS example_id, n_steps, text, coalesce(n, 0)::BIGINT AS n_missing, coalesce(runs, '') AS missing,
       coalesce(repeated, '') AS repeated
FROM texts LEFT JOIN missing USING (o) LEFT JOIN repeated USING (o)
"""


def left_pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"),
        "turn",
        F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"),
    )

    def joined(c: str) -> Column:
        return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)

    return sequences.left_pad(rows, pad_id=-1).select(
        "batch_id", "turn", "width", joined("padded"), joined("mask")
    )


LEFT_PAD_BATCHES = """
WITH rows AS (
  SELECT conv_id AS batch_id, turn,
         list_transform(string_split(text, ' '), lambda w: length(w)) AS ids
  FROM conversations),
widths AS (SELECT batch_id, max(len(ids)) AS width FROM rows GROUP BY batch_id)
SELECT batch_id, turn, width::INTEGER AS width,
       array_to_string(list_concat(list_transform(range(0, width - len(ids)), lambda i: -1), ids),
                       ' ') AS padded,
       array_to_string(list_concat(list_transform(range(0, width - len(ids)), lambda i: 0),
                                   list_transform(ids, lambda i: 1)), ' ') AS mask
FROM rows JOIN widths USING (batch_id)
"""


QUERIES = {
    "topk_tokens": topk_tokens,
    "topk_long": topk_long,
    "token_normalize_collapse": token_normalize_collapse,
    "union_vocab_2": _union(2),
    "union_vocab_3": _union(3),
    "fill_missing": _fill(3),
    "fill_missing_literal": _fill(2, literal_skip=True),
    "fill_missing_normalized": _fill(3, normalize_vocab=True),
    "union_softmax": union_softmax,
    "vector_softmax": vector_softmax,
    "drop_token": drop_token,
    "ensemble_mean_2": _mean(2),
    "ensemble_mean_3": _mean(3),
    "ensemble_mean_weighted": _mean(2, lam=0.3),
    "ensemble_pick_2": _pick(2),
    "ensemble_pick_3": _pick(3),
    "ensemble_pick_long": ensemble_pick_long,
    "ensemble_pick_padded": ensemble_pick_padded,
    "fill_missing_padded": fill_missing_padded,
    "confidence_trace": confidence_trace,
    "ensemble_texts": ensemble_texts,
    "assemble_sequence": assemble_sequence,
    "left_pad_batches": left_pad_batches,
    "assemble_gaps": assemble_gaps,
    "ensemble_pick_faulty": ensemble_pick_faulty,
    "topk_half": topk_half,
    "ensemble_pick_half": ensemble_pick_half,
}

ORACLES = {
    "topk_tokens": TOPK_TOKENS,
    "topk_long": TOPK_LONG,
    "token_normalize_collapse": TOKEN_NORMALIZE_COLLAPSE,
    "union_vocab_2": _union_sql(2),
    "union_vocab_3": _union_sql(3),
    "fill_missing": ensemble_sql(3) + _SET_SQL,
    "fill_missing_literal": ensemble_sql(2, literal_skip=True) + _SET_SQL,
    "fill_missing_normalized": ensemble_sql(3, normalize=True) + _SET_SQL,
    "union_softmax": UNION_SOFTMAX,
    "vector_softmax": VECTOR_SOFTMAX,
    "drop_token": DROP_TOKEN,
    "ensemble_mean_2": _mean_sql(2),
    "ensemble_mean_3": _mean_sql(3),
    "ensemble_mean_weighted": _mean_sql(2, lam=0.3),
    "ensemble_pick_2": _pick_sql(2),
    "ensemble_pick_3": _pick_sql(3),
    "ensemble_pick_long": _pick_sql(2),
    "ensemble_pick_padded": _pick_sql(2, ", unnamed::INTEGER AS unnamed", gap=GAP, listed=LISTED),
    "fill_missing_padded": ensemble_sql(2, gap=GAP, listed=LISTED) + _SET_SQL,
    "confidence_trace": CONFIDENCE_TRACE,
    "ensemble_texts": ENSEMBLE_TEXTS,
    "assemble_sequence": ASSEMBLE_SEQUENCE,
    "left_pad_batches": LEFT_PAD_BATCHES,
    "assemble_gaps": ASSEMBLE_GAPS,
    "ensemble_pick_faulty": _pick_sql(3, ", n_faulty", faulty=True),
    "topk_half": TOPK_HALF,
    "ensemble_pick_half": _pick_sql(2, value=SQL_HALF),
}
