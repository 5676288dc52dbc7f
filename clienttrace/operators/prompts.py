"""Chat prompts built from profiles and evidence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """A classification task as the prompts name it."""

    name: str
    pos: str
    neg: str
    answer_format: str
    expert: str
    brief: str
    brief_answer: str


# Labels and instructions of the tasks.
GENDER = Task(
    "gender", "male", "female", "male or female",
    "You are an expert bank analyst specializing in customer segmentation by transaction behavior. "
    "You analyze spending patterns, merchant categories, transaction frequency and amounts to predict "
    "customer demographics.",
    "gender (male or female)", "male or female")
CHURN = Task(
    "churn", "churn", "stay", "churn or stay",
    "You are an expert bank analyst specializing in customer retention. You analyze transaction patterns, "
    "spending behavior and activity trends to predict whether a client will churn (leave the bank).",
    "churn (yes or no)", "yes or no")
AGE = Task(
    "age", "young", "old", "0, 1, 2, or 3",
    "You are an expert bank analyst specializing in customer demographics. You analyze spending patterns and "
    "transaction behavior to predict the age group of bank clients.",
    "age group (0=youngest, 1, 2, 3=oldest)", "0, 1, 2, or 3")
TASKS = {t.name: t for t in (GENDER, CHURN, AGE)}

# Age classes.
AGE_LABELS = {0: "young (under 25)", 1: "adult (25-35)", 2: "middle-aged (35-55)", 3: "senior (over 55)"}
AGE_SHORT = ("young", "adult", "middle", "senior")

# Strategies and evidence kinds of the grids.
STRATEGIES = ("zero_shot", "few_shot", "cot")
ENRICHMENTS = ("none", "shap", "knn", "both")
REDUCED = (("zero_shot",), ("none", "knn"))
DEMO_STRATEGIES = ("zero_shot_knn", "few_shot_random", "few_shot_knn", "few_shot_cot_knn")
THINKING = ("off", "on")

# System texts.
WITH_ANALYSIS = " You also have analysis from an ML model."
WITH_PREDICTION = " You also have a prediction from an ML model. Think step by step."
GENDER_HINTS = (
    "You are a bank transaction analyst who predicts customer gender from spending patterns. "
    "Key patterns: men typically spend more on transportation, auto services, electronics, "
    "restaurants, and entertainment. Women typically spend more on clothing stores, cosmetics, "
    "home furnishing, and medical services. Higher transaction amounts and fewer categories "
    "often indicate male clients. More diverse small purchases across many categories often "
    "indicate female clients. You MUST answer with exactly one word: male or female. No explanations.")
GENDER_HINTS_ANALYSIS = (
    "You are an expert bank transaction analyst predicting customer gender. "
    "You have the customer's transaction profile AND predictions from a machine learning model "
    "with feature importance analysis. Use both sources. Answer with exactly one word: male or female.")
CHURN_HINTS = (
    "You are a bank churn prediction analyst. Based on transaction patterns, predict if the client "
    "will churn (leave the bank). Answer with exactly one word: yes or no.")
CHURN_HINTS_ANALYSIS = (
    "You are an expert bank churn analyst. You have the client's transaction profile AND predictions "
    "from a machine learning model. Use both. Answer: yes or no.")
AGE_HINTS = (
    "You are a bank analyst predicting client age group from transaction patterns. "
    "Categories: young (under 25), adult (25-35), middle-aged (35-55), senior (over 55). "
    "Answer with one word: young, adult, middle, or senior.")
AGE_HINTS_ANALYSIS = (
    "You are a bank analyst predicting client age group. You have transaction profile "
    "AND ML model predictions. Answer: young, adult, middle, or senior.")
AGE_PATTERNS = (
    "Age-related transaction patterns:\n"
    "- young (under 25): many small transactions (<500 RUB), high category diversity (10+ types), "
    "high frequency (20+ txns/month), spread across entertainment and food\n"
    "- adult (25-35): moderate frequency (10-20/month), mix of small and medium amounts, "
    "diverse but structured spending\n"
    "- middle-aged (35-55): higher average amounts, concentrated in fewer categories (5-8), "
    "regular patterns, 8-15 txns/month\n"
    "- senior (over 55): low frequency (<10/month), very concentrated spending (2-4 categories), "
    "higher per-transaction amounts, habitual patterns")
AGE_CLASSES_SYSTEM = (
    "You are a bank analyst predicting age group from transaction patterns. "
    "Categories: 0=youngest, 1=young-adult, 2=middle-age, 3=senior. "
    "You also have prediction from ML model. Think step by step.")

# Questions, headings and short system texts. Braces stand for the labels of a task.
ASK_ONE_WORD = "\n\nRespond with ONLY one word: {answers}. Write your answer after {mark}"
ANALYZE_STEPS = "\nAnalyze the transaction patterns step by step, then give your final prediction: {answers}."
NOW_PREDICT = "Now predict:\n"
BRIEF_SYSTEM = "You are a bank analyst predicting client {brief}."
BRIEF_WITH_ANALYSIS = " You have ML analysis."
BRIEF_ANSWER = " Answer: {answers}."
PROFILE_HEAD = "Profile:\n"
PREDICT = "\nPredict."
THINK_PREDICT = "\nThink step by step, then predict."
CLASSIFY_CLIENT_JSON = "Classify this client. Output JSON: "
CLASSIFY_JSON = "Classify. Output JSON: "
CLASSIFY_AGE_JSON = "\n\nClassify age group. Output JSON: "
AGE_FORM = '{"reasoning": "analysis", "label": 0|1|2|3, "confidence": 0-1}'
LADDER_ASK = "predict the customer's {name}. Answer with exactly one word: {answers}."
LADDER_PLAIN = "\n\nBased on the transaction profile, "
LADDER_HELPED = "\n\nBased on the transaction profile and the similar clients above, "
AGE_PLAIN_SYSTEM = "You are a bank analyst predicting client age group from transaction patterns.\n"
AGE_PLAIN_ANSWER = "\nAnswer with one word: young, adult, middle, or senior."
AGE_EVIDENCE_SYSTEM = (
    "You are a bank analyst predicting client age group. You have the client's transactions "
    "AND analysis from machine learning models.\n")
AGE_EVIDENCE_ANSWER = "\nThink step by step, then answer: young, adult, middle, or senior."
AGE_PREDICT = "\n\nPredict age group."
AGE_PREDICT_BOTH = "Consider both evidences and predict age group."
AGE_PREDICT_ALL = "Based on all evidence, predict age group."
DEMO_ASK = "\nClassify this client."
COT_FIELD = "analysis (≤80 words)"
COT_COUNT = "Client has {count} transactions with average amount {average} RUB."
COT_TOP = "Top spending categories: {top}."
COT_RETAIL = "High retail/clothing spending is a characteristic pattern."
COT_TRANSPORT = "Significant transportation spending observed."
COT_TICKET = "Higher-than-average ticket size suggests premium behavior."
COT_END = "Based on these patterns, classification: {label}."

#: Examples packed into one prompt block at most.
MAX_EXAMPLES = 1_000


def _fill(text: str, **values: Column) -> Column:
    """A fixed text with columns for its names in braces."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", text)):
        pieces.append(values[piece] if i % 2 else piece)
    return _cat(*pieces)


def _cat(*pieces: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column | str, user: Column | str) -> Column:
    """``ARRAY<STRUCT<role, content>>`` of a system and a user message."""
    system, user = (c if isinstance(c, Column) else F.lit(c) for c in (system, user))
    return F.array(_message("system", system), _message("user", user))


def build_messages(task: Task, strategy: Column, evidence: Column, profile: Column,
                   few_shot: Column | None = None, quoted: bool = True) -> Column:
    """Prompts of the strategy x evidence grid, the strategy being a column.

    A non-empty evidence text also changes the system message.
    """
    mark = "'ANSWER:'" if quoted else "ANSWER:"
    ask = ASK_ONE_WORD.format(answers=task.answer_format, mark=mark)
    few_shot = F.lit("") if few_shot is None else few_shot
    user = (F.when(strategy == "few_shot", _cat(few_shot, NOW_PREDICT, profile, evidence, ask))
            .when(strategy == "cot", _cat(profile, evidence, ANALYZE_STEPS.format(answers=task.answer_format)))
            .otherwise(_cat(profile, evidence, ask)))
    system = _cat(task.expert, F.when(F.trim(evidence) != "", WITH_ANALYSIS).otherwise(""))
    return chat(system, user)


def matrix_messages(task: Task, strategy: Column, evidence: Column, profile: Column,
                    few_shot: Column | None = None) -> Column:
    """The short prompts of the strategy matrix."""
    few_shot = F.lit("") if few_shot is None else few_shot
    plain, answer = BRIEF_SYSTEM.format(brief=task.brief), BRIEF_ANSWER.format(answers=task.brief_answer)
    system = F.when(F.trim(evidence) != "", plain + BRIEF_WITH_ANALYSIS + answer).otherwise(plain + answer)
    user = (F.when(strategy == "few_shot", _cat(few_shot, NOW_PREDICT, PROFILE_HEAD, profile, evidence, PREDICT))
            .when(strategy == "cot", _cat(PROFILE_HEAD, profile, evidence, THINK_PREDICT))
            .otherwise(_cat(PROFILE_HEAD, profile, evidence, PREDICT)))
    return chat(system, user)


def json_messages(task: Task, profile: Column, evidence: Column | None = None, reasoning: str | None = None,
                  system: str | None = None, ask: str = CLASSIFY_CLIENT_JSON) -> Column:
    """Prompts that ask for a JSON answer, with a reasoning field if described."""
    field = f'"reasoning": "{reasoning}", ' if reasoning else ""
    form = f'{{{field}"label": "{task.pos}" or "{task.neg}", "confidence": 0-1}}'
    text = profile if evidence is None else F.concat(profile, evidence)
    return chat(system or task.expert, _cat(text, "\n\n", ask, form))


def prediction_messages(task: Task, profile: Column, evidence: Column) -> Column:
    return json_messages(task, profile, _cat("\n\n", evidence), "analysis", task.expert + WITH_PREDICTION,
                         CLASSIFY_JSON)


def age_prediction_messages(profile: Column, evidence: Column) -> Column:
    return chat(AGE_CLASSES_SYSTEM, _cat(profile, "\n\n", evidence, CLASSIFY_AGE_JSON, AGE_FORM))


def ladder_messages(task: Task, profile: Column, neighbours: Column) -> Column:
    """Prompts of the model-size comparison; null ``neighbours`` gives the plain form."""
    ask = LADDER_ASK.format(name=task.name, answers=task.answer_format)
    plain = _cat(profile, LADDER_PLAIN, ask)
    helped = _cat(profile, "\n", neighbours, LADDER_HELPED, ask)
    return chat(task.expert, F.when(neighbours.isNull(), plain).otherwise(helped))


# Wording of the profile prompts per task.
_PROFILE_FORMS: Mapping[str, Mapping[str, str]] = {
    "gender": {"zero": GENDER_HINTS, "analysis": GENDER_HINTS_ANALYSIS, "head": "Customer transaction profile:\n",
               "helped_head": "Customer transaction profile:\n", "middle": "\n\nMachine learning analysis:\n",
               "ask": "\n\nPredict the customer's gender.", "few": "\nNow predict the gender for this customer:\n"},
    "churn": {"zero": CHURN_HINTS, "analysis": CHURN_HINTS_ANALYSIS, "head": "Client profile:\n",
              "helped_head": "Profile:\n", "middle": "\n\nML analysis:\n",
              "ask": "\n\nWill this client churn?", "few": "\nNow predict:\n"},
    "age": {"zero": AGE_HINTS, "analysis": AGE_HINTS_ANALYSIS, "head": "Profile:\n",
            "helped_head": "Profile:\n", "middle": "\n\nML analysis:\n",
            "ask": "\n\nPredict age group.", "few": "\nPredict:\n"},
}


def profile_messages(task: str, strategy: str, profile: Column, analysis: Column | None = None,
                     examples: Column | None = None) -> Column:
    """``zero_shot``, ``few_shot`` or ``shap_enriched`` prompts around a profile."""
    form = _PROFILE_FORMS[task]
    if strategy == "few_shot":
        return chat(form["zero"], _cat("Examples:", examples, form["few"], profile))
    if strategy == "shap_enriched":
        return chat(form["analysis"], _cat(form["helped_head"], profile, form["middle"], analysis, form["ask"]))
    return chat(form["zero"], _cat(form["head"], profile, form["ask"]))


def age_evidence_messages(profile: Column, kind: str, evidence: Column) -> Column:
    """Age prompts without evidence or reasoning over it."""
    if kind == "none":
        return chat(AGE_PLAIN_SYSTEM + AGE_PATTERNS + AGE_PLAIN_ANSWER, _cat(PROFILE_HEAD, profile, AGE_PREDICT))
    system = AGE_EVIDENCE_SYSTEM + AGE_PATTERNS + AGE_EVIDENCE_ANSWER
    end = AGE_PREDICT_BOTH if kind == "both" else AGE_PREDICT_ALL
    return chat(system, _cat(PROFILE_HEAD, profile, "\n\n", evidence, "\n\n", end))


def cot_reasoning(profile: Column, label: Column) -> Column:
    """A short worked reasoning read off a profile text, ending with the label.

    The category list is cut to 100 characters; that is part of the format.
    """
    def number(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(profile, pattern, 1), F.lit("")).cast("long"), F.lit(0))
    count, average = number(r"Transactions:\s*(\d+)"), number(r"avg\s*(\d+)")
    top = F.regexp_extract(profile, r"Top categories:\s*([^\n]+)", 1)
    return F.concat_ws(
        " ",
        _fill(COT_COUNT, count=count.cast("string"), average=average.cast("string")),
        _fill(COT_TOP, top=F.substring(top, 1, 100)),
        F.when(F.contains(top, F.lit("Retail")) | F.contains(top, F.lit("Clothing")), COT_RETAIL),
        F.when(F.contains(top, F.lit("Transportation")), COT_TRANSPORT),
        F.when(average > 3000, COT_TICKET),
        _fill(COT_END, label=label))


def _json_string(text: Column) -> Column:
    """A string as a JSON literal (quotes and control characters escaped)."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def demo_answer(label: Column, reasoning: Column | None = None) -> Column:
    lead = _cat("{") if reasoning is None else _cat('{"reasoning": ', _json_string(reasoning), ", ")
    return _cat(lead, '"label": ', _json_string(label), ', "confidence": 0.9}')


def demo_messages(demos: DataFrame, cot: bool = False, query: str = "query_id") -> DataFrame:
    """Demonstrations of each query as alternating user and assistant turns.

    ``demos`` has ``position, profile, label``; a query has only its few.
    """
    reasoning = cot_reasoning(F.col("profile"), F.col("label")) if cot else None
    pair = F.array(_message("user", _cat(F.col("profile"), DEMO_ASK)),
                   _message("assistant", demo_answer(F.col("label"), reasoning)))
    collected = F.sort_array(F.collect_list(F.struct("position", pair.alias("pair"))))
    return (demos.groupBy(query).agg(collected.alias("_turns"))
            .select(query, F.flatten(F.transform("_turns", lambda x: x["pair"])).alias("demos")))


def with_demos(messages: Column, demos: Column) -> Column:
    """System message, then the demonstrations, then the question."""
    return F.concat(F.slice(messages, 1, 1), F.coalesce(demos, F.array().cast("array<struct<role:string,content:string>>")),
                    F.slice(messages, 2, 1))


def demo_strategy_messages(task: Task, strategy: str, profile: Column, neighbours: Column, demos: Column) -> Column:
    """Prompts of ``DEMO_STRATEGIES``: demonstration turns before the question, which tells the neighbours' votes.

    Null ``demos`` are none. With ``few_shot_cot_knn`` the answer has a reasoning field.
    """
    if strategy not in DEMO_STRATEGIES:
        raise ValueError(f"{strategy} is none of {DEMO_STRATEGIES}")
    messages = json_messages(task, profile, neighbours, COT_FIELD if strategy == "few_shot_cot_knn" else None)
    return messages if strategy == "zero_shot_knn" else with_demos(messages, demos)


def few_shot_block(examples: DataFrame, style: str = "numbered") -> DataFrame:
    """One row, one ``block`` of labelled profiles in ``position`` order.

    ``numbered``: ``Example 1: ... Answer:``; ``profile_numbered`` and
    ``profile``: the forms of the profile prompts. Examples are a handful; more
    than ``MAX_EXAMPLES`` raise an error, and no more than these reach the task.
    """
    def text(x: Column) -> Column:
        n = x["position"].cast("string")
        if style == "numbered":
            return _cat("Example ", n, ":\n", x["profile"], "\nAnswer: ", x["label"], "\n\n")
        head = _cat("\nProfile ", n, ":\n") if style == "profile_numbered" else F.lit("\nProfile:\n")
        return _cat(head, x["profile"], "\nAnswer: ", x["label"], "\n")
    items = F.sort_array(F.collect_list(F.struct("position", "profile", "label")))
    block = F.when(F.count(F.lit(1)) <= MAX_EXAMPLES, F.array_join(F.transform(items, text), "")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_EXAMPLES} examples for one block")))
    return examples.limit(MAX_EXAMPLES + 1).agg(block.alias("block"))


def prompt_grid(spark: SparkSession, models: Sequence[str], strategies: Sequence[str] = STRATEGIES,
                enrichments: Sequence[str] = ENRICHMENTS) -> DataFrame:
    """All cells to run with their tag; a table of settings, not of data."""
    cells = [(m, s, e, f"{m}_{s}_{e}") for m in models for s in strategies for e in enrichments]
    return spark.createDataFrame(cells, "model string, strategy string, enrichment string, tag string")


def thinking_grid(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    cells = [(m, t, f"{m}_thinking_{t}_knn") for m in models for t in THINKING]
    return spark.createDataFrame(cells, "model string, thinking string, tag string")


def spread_over_grid(clients: DataFrame, grid: DataFrame) -> DataFrame:
    """Every client once per cell.

    The cells are packed into one array value, so this is a projection, not a
    join, and clients stay where they are.
    """
    cells = grid.agg(F.sort_array(F.collect_list(F.struct(*grid.columns)))).scalar()
    return clients.withColumn("_cell", F.explode(cells)).select("*", "_cell.*").drop("_cell")
