"""Operator inputs derived from the test tables by plain arithmetic, so that SQL
can repeat them.

Logits: the vectors of ``embeddings`` in order of ``vec_id`` are taken as those
of n models in turn, and four steps in a row as one example.
Vocabularies: model m calls id i by the number i*c mod 97, with c = 1, 7, 11, so
vocabularies overlap in part.  Some tokens carry the model's space marker, one is
a newline, one begins like the newline's shared key, one is a special token, model 1 has an
empty token, and model 2 spells one token in two ways.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.functions.text import SPACE_MARKER, UNDERSCORE_MARKER
from logitblend.profiles import ModelProfile, two_model_weights, uniform_weights

STEPS = 4
#: Entries of a vector, and so of a vocabulary.
WIDTH = 64
MODULUS = 97
FACTORS = {1: 1, 2: 7, 3: 11}
SPACE, UNDERSCORE = SPACE_MARKER, UNDERSCORE_MARKER

PROFILES = [
    ModelProfile(1, "qwen2", marker=None, blank_id=5, dedup_ids=True),
    ModelProfile(2, "llama2", marker=UNDERSCORE, blank_id=6, dedup_ids=False),
    ModelProfile(3, "other", marker=None, blank_id=None, dedup_ids=True),
]


def profiles(n: int, literal_skip: bool = False, lam: float | None = None) -> list[ModelProfile]:
    chosen = uniform_weights(PROFILES[:n]) if lam is None else two_model_weights(PROFILES[:n], lam)
    return [replace(p, blank_skip=False) for p in chosen] if literal_skip else chosen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def faults(number: Column, x: Column, i: Column) -> Column:
    """Entries of vectors from a run that overflowed: some vectors have a NaN, some an infinite entry, some
    only entries of minus infinity, some a few of them."""
    endless = F.lit(float("inf"))
    return (
        F.when((number % 7 == 1) & (i == 3), F.lit(float("nan")))
        .when((number % 7 == 2) & (i == 4), endless)
        .when(number % 7 == 3, -endless)
        .when((number % 7 == 4) & (i % 3 == 0), -endless)
        .otherwise(x)
    )


SQL_FAULTS = """CASE WHEN vec_id % 7 = 1 AND token_id = 3 THEN 'nan'::DOUBLE
              WHEN vec_id % 7 = 2 AND token_id = 4 THEN 'inf'::DOUBLE
              WHEN vec_id % 7 = 3 OR (vec_id % 7 = 4 AND token_id % 3 = 0) THEN '-inf'::DOUBLE
              ELSE x END"""


def logits(spark: SparkSession, sf_dir: str, n: int, gap: int = 0, faulty: bool = False) -> DataFrame:
    """With ``gap``, every so many vectors one is empty: a model without a score there."""
    turn = F.expr(f"vec_id div {n}")
    example = F.expr(f"vec_id div {n * STEPS}")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("run"), example % 3).alias("run"),
        example.alias("example_id"),
        (turn % STEPS).cast("int").alias("step"),
        (F.col("vec_id") % n + 1).cast("int").alias("model"),
        F.transform(
            F.when(F.col("vec_id") % gap == 0, F.array().cast("array<float>")).otherwise(
                F.col("embedding")
            )
            if gap
            else F.col("embedding"),
            lambda x, i: faults(F.col("vec_id"), x.cast("double") * 10, i) if faulty else x.cast("double") * 10,
        ).alias("logits"),
    )


def long_logits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The same with one row per token."""
    return logits(spark, sf_dir, n).select(
        "run", "example_id", "step", "model", F.posexplode("logits").alias("token_id", "logit")
    )


def _by_model(values: dict[int, str | int]) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("model")
    )


def _models(n: int) -> Column:
    return F.explode(F.array(*[F.lit(m) for m in range(1, n + 1)])).alias("model")


def _numbers(spark: SparkSession, n: int, name: str, models: int) -> DataFrame:
    return spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias(name), _models(models))


def vocab(spark: SparkSession, n: int, width: int = WIDTH) -> DataFrame:
    """With a smaller ``width``, vectors are wider than the vocabulary."""
    number = F.col("number")
    odd = F.col("model") % 2 == 1
    marker = F.when(odd, SPACE).otherwise(UNDERSCORE)
    plain = F.concat(F.lit("t"), number)
    token = (
        F.when((number == 13) & (F.col("model") == 1), "")
        .when(number == 14, F.when(odd, "Ċ").otherwise("<0x0A>"))
        .when((number == 15) & ~odd, f"{SPACE}t8")
        .when(number == 16, F.when(odd, "/news").otherwise(f"{UNDERSCORE}/news"))
        .when(number == 17, "</s>")
        .when(number % 7 == 1, F.concat(marker, plain))
        .otherwise(plain)
    )
    return (
        _numbers(spark, width, "token_id", n)
        .withColumn("number", F.col("token_id") * _by_model(FACTORS) % MODULUS)
        .select("model", "token_id", token.alias("token"), (number == 17).alias("special"))
    )


def subtokens(spark: SparkSession, n: int) -> DataFrame:
    number = F.col("number")
    marked = number % 7 == 1
    marker = F.when(F.col("model") == 2, UNDERSCORE).otherwise(SPACE)
    token = (
        F.when(number == 14, "/n")
        .when(marked, F.concat(marker, F.lit("t"), number))
        .otherwise(F.concat(F.lit("t"), number))
    )
    lead = _by_model({p.model: 1 if p.blank_id is None else p.blank_id for p in PROFILES})
    pieces = F.array(number % WIDTH, (number + 1) % WIDTH)
    ids = F.when(marked, F.concat(F.array(lead), pieces)).otherwise(pieces)
    return (
        _numbers(spark, MODULUS, "number", n)
        .filter(~number.isin(13, 95))
        .select("model", token.alias("token"), F.posexplode(ids).alias("pos", "token_id"))
    )


def ensemble_sql(
    n: int,
    literal_skip: bool = False,
    normalize: bool = False,
    lam: float | None = None,
    gap: int = 0,
    listed: int = WIDTH,
    faulty: bool = False,
    value: str = "x",
) -> str:
    """The whole computation as common table expressions, from logits to picks."""
    models = ", ".join(f"({m}, {FACTORS[m]})" for m in range(1, n + 1))
    profile_rows = ", ".join(
        "({}, {}, {}, {}, {}, {!r}::DOUBLE)".format(
            p.model,
            f"'{p.marker}'" if p.marker else "NULL::VARCHAR",
            "NULL::INTEGER" if p.blank_id is None else p.blank_id,
            str(p.dedup_ids).lower(),
            str(p.blank_skip).lower(),
            p.weight,
        )
        for p in profiles(n, literal_skip, lam)
    )
    keys = "run, example_id, step"
    spelled = (
        f"replace(replace(replace(token, '{UNDERSCORE}', '{SPACE}'), '<0x0A>', '/n'), 'Ċ', '/n')"
    )
    return f"""
WITH models(model, factor) AS (VALUES {models}),
profile(model, marker, blank_id, dedup_ids, blank_skip, weight) AS (VALUES {profile_rows}),
width AS (SELECT {WIDTH} AS width),
raw AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token_id, unnest(embedding) AS x
  FROM embeddings {f"WHERE vec_id % {gap} <> 0" if gap else ""}),
logit AS (
  SELECT 'run' || (vec_id // {n * STEPS}) % 3 AS run, vec_id // {n * STEPS} AS example_id,
         ((vec_id // {n}) % {STEPS})::INTEGER AS step, (vec_id % {n} + 1)::INTEGER AS model,
         token_id::INTEGER AS token_id, {value}::DOUBLE * 10 AS logit
  FROM (SELECT vec_id, token_id, {SQL_FAULTS if faulty else "x"} AS x FROM raw)),
vocab0 AS (
  SELECT model, token_id::INTEGER AS token_id, (token_id * factor) % {MODULUS} AS number
  FROM models, (SELECT unnest(range(0, {listed})) AS token_id)),
vocab AS (
  SELECT model, token_id,
         CASE WHEN number = 13 AND model = 1 THEN ''
              WHEN number = 14 THEN CASE WHEN model % 2 = 1 THEN 'Ċ' ELSE '<0x0A>' END
              WHEN number = 15 AND model % 2 = 0 THEN '{SPACE}t8'
              WHEN number = 16 THEN CASE WHEN model % 2 = 1 THEN '/news' ELSE '{UNDERSCORE}/news' END
              WHEN number = 17 THEN '</s>'
              WHEN number % 7 = 1
              THEN CASE WHEN model % 2 = 1 THEN '{SPACE}' ELSE '{UNDERSCORE}' END || 't' || number
              ELSE 't' || number END AS token,
         number = 17 AS special
  FROM vocab0),
words AS (
  SELECT model, number, width,
         CASE WHEN number = 14 THEN '/n'
              WHEN number % 7 = 1
              THEN CASE WHEN model = 2 THEN '{UNDERSCORE}' ELSE '{SPACE}' END || 't' || number
              ELSE 't' || number END AS token
  FROM models, (SELECT unnest(range(0, {MODULUS})) AS number), width
  WHERE number NOT IN (13, 95)),
pieces AS (
  SELECT model, token, 0 AS pos, coalesce(blank_id, 1) AS token_id
  FROM words JOIN profile USING (model) WHERE number % 7 = 1
  UNION ALL SELECT model, token, 1, number % width FROM words
  UNION ALL SELECT model, token, 2, (number + 1) % width FROM words),
known AS (
  SELECT model, {spelled if normalize else "token"} AS key, min(token_id) AS token_id
  FROM vocab WHERE token_id <> 0 GROUP BY ALL),
fallback AS (
  SELECT model, token, arg_min(token_id, pos) AS subtoken_id
  FROM pieces JOIN profile USING (model)
  WHERE NOT (blank_skip AND token_id IS NOT DISTINCT FROM blank_id)
  GROUP BY model, token),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, model ORDER BY logit DESC, token_id) AS pos
  FROM logit),
top AS (SELECT * FROM ranked WHERE pos <= 10),
spelled AS (
  SELECT t.*, coalesce({spelled}, '<unnamed ' || model || ':' || token_id || '>') AS token
  FROM top t LEFT JOIN vocab v USING (model, token_id)),
own AS (
  SELECT {keys}, model, token, min(pos) AS pos, arg_max(logit, pos) AS logit,
         arg_max(token_id, pos) AS token_id
  FROM spelled GROUP BY {keys}, model, token),
joint AS (SELECT DISTINCT {keys}, token FROM own),
logged AS (
  SELECT 'run' || (vec_id // {n * STEPS}) % 3 AS run, vec_id // {n * STEPS} AS example_id,
         ((vec_id // {n}) % {STEPS})::INTEGER AS step, (vec_id % {n} + 1)::INTEGER AS model
  FROM embeddings),
missing AS (
  SELECT j.run, j.example_id, j.step, l.model, j.token,
         CASE WHEN starts_with(j.token, '<unnamed ') THEN NULL
              WHEN p.marker IS NULL THEN j.token
              ELSE replace(j.token, '{SPACE}', p.marker) END AS lookup,
         p.blank_id
  FROM joint j
  JOIN logged l USING ({keys})
  JOIN profile p USING (model)
  ANTI JOIN own o USING ({keys}, model, token)),
resolved AS (
  SELECT m.run, m.example_id, m.step, m.model, m.token,
         CASE WHEN m.token = '' THEN m.blank_id
              ELSE coalesce(v.token_id, f.subtoken_id) END AS token_id,
         CASE WHEN m.token = ''
              THEN CASE WHEN m.blank_id IS NULL THEN 'unresolved' ELSE 'blank' END
              WHEN v.token_id IS NOT NULL THEN 'vocab'
              WHEN f.subtoken_id IS NOT NULL THEN 'subtoken'
              ELSE 'unresolved' END AS source
  FROM missing m
  LEFT JOIN known v ON v.model = m.model AND v.key = m.{"token" if normalize else "lookup"}
  LEFT JOIN fallback f ON f.model = m.model AND f.token = m.lookup),
filled AS (
  SELECT r.* REPLACE (CASE WHEN r.token_id IS NOT NULL AND l.logit IS NULL THEN 'out_of_range'
                           ELSE source END AS source), l.logit
  FROM resolved r LEFT JOIN logit l USING ({keys}, model, token_id)),
entries AS (
  SELECT {keys}, model, token, pos AS rank, logit, token_id,
         CASE WHEN starts_with(token, '<unnamed ') THEN 'unnamed' ELSE 'own' END AS source
  FROM own
  UNION ALL SELECT {keys}, model, token, NULL, logit, token_id, source FROM filled),
placed AS (
  SELECT *, row_number() OVER (
              PARTITION BY {keys}, model ORDER BY rank NULLS LAST, token) AS pos
  FROM entries),
seen AS (
  SELECT *, row_number() OVER (
              PARTITION BY {keys}, model, token_id ORDER BY rank IS NULL, pos) AS nth
  FROM placed),
sets AS (
  SELECT s.run, s.example_id, s.step, s.model, s.token, s.pos, s.token_id, s.source,
         p.dedup_ids AND s.rank IS NULL AND s.token_id IS NOT NULL AND s.nth > 1 AS repeated,
         CASE WHEN p.dedup_ids AND s.rank IS NULL AND s.token_id IS NOT NULL AND s.nth > 1
              THEN 0 ELSE s.logit END AS score,
         p.weight
  FROM seen s JOIN profile p USING (model)),
exps AS (
  SELECT *, coalesce(exp(score - max(score) OVER (PARTITION BY {keys}, model)), 0) AS e
  FROM sets),
totals AS (SELECT *, sum(e) OVER (PARTITION BY {keys}, model) AS total FROM exps),
probs AS (
  SELECT *, CASE WHEN total > 0 AND NOT isnan(total) THEN e / total ELSE 0 END AS p FROM totals),
blended AS (
  SELECT {keys}, token, sum(weight * p) AS p, count(*) FILTER (WHERE total > 0 AND NOT isnan(total)) AS n_models,
         count(*) FILTER (WHERE isnan(total)) AS n_faulty,
         bool_or(source = 'unnamed') AS unnamed,
         max(CASE WHEN model = 1 THEN pos END) AS pos,
         {", ".join(f"max(CASE WHEN model = {m} THEN token_id END) AS token_id_{m}"
                    for m in range(1, n + 1))}
  FROM probs GROUP BY {keys}, token),
places AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}
                               ORDER BY p DESC, pos NULLS LAST, token) AS place
  FROM blended),
picks AS (
  SELECT b.*, v.token AS next_token, coalesce(v.special, false) AS special
  FROM places b LEFT JOIN vocab v ON v.model = 1 AND v.token_id = b.token_id_1
  WHERE place = 1)
"""
