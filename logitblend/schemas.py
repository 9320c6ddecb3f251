"""Column layouts of the tables the operators read and write, as DDL strings."""

from __future__ import annotations

#: One decode step of one example in one run.
STEP_KEYS = ["run", "example_id", "step"]


CHOICE4_ITEM = (
    "question string, A string, B string, C string, D string, answer string, domain string"
)
CHOICE2_ITEM = ("question string, A string, B string, answer string")
# `answer` is a string in some question sets and a list of aliases in others.
QA_ITEM = ("question string, answer variant")
MATH_ITEM = ("question string, answer string")

DENSE_LOGITS = (
    "run string, example_id bigint, step int, model int, logits array<float>"
)
LONG_LOGITS = (
    "run string, example_id bigint, step int, model int, token_id int, logit float"
)
# `special` (boolean) may be added: tokens that are never part of a text.
VOCAB = ("model int, token_id int, token string")
SUBTOKENS = ("model int, token string, pos int, token_id int")

RESULT_MATH = (
    "seq bigint, question string, original_sln string, pred_solution string, "
    "pred double, label double"
)
RESULT_CHOICE = (
    "seq bigint, question string, original_sln string, pred_solution string, "
    "pred string, label string, subject string"
)
RESULT_QA = (
    "seq bigint, question string, original_sln variant, pred_solution string, "
    "pred string, label variant"
)
RESULTS = {"math": RESULT_MATH, "choice": RESULT_CHOICE, "qa": RESULT_QA}
