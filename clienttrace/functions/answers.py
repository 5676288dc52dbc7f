"""Turning model answers into probabilities and classes, as column chains.

Labels are matched as whole words by default. With ``legacy_substring`` they
are matched anywhere, so "male" is also found in "female" and a positive label
that ends a longer negative one always wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clienttrace.functions.scalars import clip
from clienttrace.functions.vectors import argmax_class, bind, softmax, total

# Shape of a chat response.
RESPONSE_SCHEMA = (
    "choices array<struct<message struct<content string, reasoning string>, "
    "logprobs struct<content array<struct<top_logprobs array<struct<token string, logprob double>>>>>>>, "
    "usage struct<prompt_tokens bigint, completion_tokens bigint>")
# Confidence bounds and the probabilities of unsure answers.
LOWEST, HIGHEST = 0.05, 0.95
ONLY_ONE, LAST_OF_BOTH, UNDECIDED = 0.85, 0.7, 0.5
TAIL_CHARS, AFTER_ANSWER_CHARS = 50, 20
MINIMUM_TOKEN_MASS, MINIMUM_LOGIT_MASS = 0.01, 1e-8
# Patterns.
PERCENT = r"(\d{1,3})\s*%"
JSON_WITH_LABEL = r'(\{[^{}]*"label"[^{}]*\})'
QUOTED_LABEL = r'"label"\s*:\s*"(\w+)"'
DIGIT_LABEL = r'"label"\s*:\s*(\d)'


def response_parts(raw: Column) -> dict[str, Column]:
    """Columns of a raw response: text parts, first token scores and usage."""
    r = F.from_json(raw, RESPONSE_SCHEMA)
    first = F.try_element_at(r["choices"], F.lit(1))
    token = F.try_element_at(first["logprobs"]["content"], F.lit(1))
    return {"content": F.coalesce(first["message"]["content"], F.lit("")),
            "reasoning": first["message"]["reasoning"],
            "top_logprobs": token["top_logprobs"],
            "prompt_tokens": r["usage"]["prompt_tokens"],
            "completion_tokens": r["usage"]["completion_tokens"]}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _found(text: Column, label: str, legacy: bool) -> Column:
    return F.contains(text, F.lit(label)) if legacy else F.rlike(text, F.lit(rf"\b{label}\b"))


def _last_index(text: Column, word: str) -> Column:
    """0-based position of the last occurrence, -1 if absent."""
    at = F.locate(word[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(word) + 1).otherwise(-1)


def last_mention(text: Column, pos: str, neg: str, legacy: bool = False) -> Column:
    """``pos`` or ``neg``, whichever is mentioned last in lower-case text; null if neither."""
    if legacy:
        p, n = _last_index(text, pos), _last_index(text, neg)
        return F.when(p > n, pos).when(n > p, neg)
    return F.nullif(F.regexp_extract(text, rf"(?s).*\b({pos}|{neg})\b", 1), F.lit(""))


def _from_object(text: Column, pos: str) -> Column:
    """Probability from a JSON object with label and confidence, null if it is not one."""
    parsed = F.from_json(text, "label string, confidence string")
    quoted = F.rlike(text, F.lit(r'"label"\s*:\s*"'))
    sure = F.when(parsed["confidence"].isNull(), F.lit(ONLY_ONE)).otherwise(parsed["confidence"].try_cast("double"))
    sure = F.when(sure.isNotNull(), clip(sure, LOWEST, HIGHEST))
    return F.when(parsed["label"].isNotNull() & quoted,
                  F.when(F.lower(parsed["label"]) == pos, sure).otherwise(1 - sure))


def parse_json_answer(content: Column, reasoning: Column, pos: str, neg: str, fallback: str = "mention",
                      legacy_substring: bool = False) -> Column:
    """Positive probability of an answer asked for as JSON.

    Whole content as JSON; else (``mention``) the first object with a label in
    content and reasoning, then the last label mentioned; or (``label``) just a
    quoted label in the content.
    """
    pos, neg = pos.lower(), neg.lower()
    whole = F.when(F.rlike(content, F.lit(r"(?s)^\s*\{.*\}\s*$")), _from_object(content, pos))
    if fallback == "label":
        label = F.nullif(F.lower(F.regexp_extract(content, QUOTED_LABEL, 1)), F.lit(""))
        rest = F.when(label == pos, ONLY_ONE).when(label.isNotNull(), 1 - ONLY_ONE)
        return F.coalesce(whole, rest, F.lit(UNDECIDED))
    combined = F.concat(content, F.lit(" "), F.coalesce(reasoning, F.lit("")))
    inner = _from_object(F.regexp_extract(combined, JSON_WITH_LABEL, 1), pos)
    said = last_mention(F.lower(combined), pos, neg, legacy_substring)
    mention = F.when(said == pos, ONLY_ONE).when(said == neg, 1 - ONLY_ONE)
    return F.coalesce(whole, inner, mention, F.lit(UNDECIDED))


def parse_text_answer(content: Column, pos: str, neg: str, percent: bool = True,
                      legacy_substring: bool = False) -> Column:
    """Positive probability of a free-text answer (the part after the last ``</think>``)."""
    pos, neg = pos.lower(), neg.lower()
    text = _strip(F.substring_index(F.lower(content), "</think>", -1))
    p, n = _found(text, pos, legacy_substring), _found(text, neg, legacy_substring)
    last = last_mention(text, pos, neg, legacy_substring) == pos

    def choose(only: Column, both: Column) -> Column:
        return (F.when(p & ~n, only).when(n & ~p, 1 - only)
                .when(p & n, F.when(last, both).otherwise(1 - both)).otherwise(UNDECIDED))
    plain = choose(F.lit(ONLY_ONE), F.lit(LAST_OF_BOTH))
    if not percent:
        return plain
    number = F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")).cast("int")
    sure = clip(number / 100.0, LOWEST, HIGHEST)
    return F.when(number.isNotNull(), choose(sure, sure)).otherwise(plain)


def recover_from_reasoning(content: Column, reasoning: Column, pos: str, neg: str, search_whole: bool = True,
                           legacy_substring: bool = False) -> Column:
    """The content, or for a blank one the label its reasoning ends with.

    First what follows the last ``answer:`` (the positive label is tested
    first), then the last characters, then (optionally) the whole reasoning.
    """
    p, n = pos.lower(), neg.lower()
    text = F.lower(reasoning)
    after = F.substring(_strip(F.substring_index(text, "answer:", -1)), 1, AFTER_ANSWER_CHARS)
    stated = F.when(F.contains(text, F.lit("answer:")),
                    F.when(_found(after, p, legacy_substring), pos).when(_found(after, n, legacy_substring), neg))
    # right() of a shorter text is the whole text.
    tail = last_mention(F.right(text, F.lit(TAIL_CHARS)), p, n, legacy_substring)
    steps = [stated, F.when(tail == p, pos).when(tail == n, neg)]
    if search_whole:
        whole = last_mention(text, p, n, legacy_substring)
        steps.append(F.when(whole == p, pos).when(whole == n, neg))
    blank = (_strip(content) == "") & (F.coalesce(F.length(reasoning), F.lit(0)) > 0)
    return F.when(blank, F.coalesce(*steps, F.lit(""))).otherwise(content)


def token_probability(top_logprobs: Column, pos: str, neg: str) -> Column:
    """Share of the positive label in the first token's alternatives.

    A token belongs to a label if one is a prefix of the other (positive tested
    first). Null when both together carry too little probability.
    """
    pos, neg = pos.lower(), neg.lower()

    def side(token: Column) -> Column:
        t = _strip(F.lower(token))
        return (F.when(F.startswith(F.lit(pos), t) | F.startswith(t, F.lit(pos)), 1)
                .when(F.startswith(F.lit(neg), t) | F.startswith(t, F.lit(neg)), -1).otherwise(0))

    sided = F.transform(top_logprobs, lambda x: F.struct(side(x["token"]).alias("s"), F.exp(x["logprob"]).alias("p")))
    sums = F.aggregate(
        sided, F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg")),
        lambda a, x: F.struct((a["pos"] + F.when(x["s"] == 1, x["p"]).otherwise(0.0)).alias("pos"),
                              (a["neg"] + F.when(x["s"] == -1, x["p"]).otherwise(0.0)).alias("neg")))
    return bind(sums, lambda s: F.when(s["pos"] + s["neg"] > MINIMUM_TOKEN_MASS, s["pos"] / (s["pos"] + s["neg"])))


def logit_probability(pos_logits: Column, neg_logits: Column) -> Column:
    """Positive share of the softmax over the label tokens' logits."""
    def share(probs: Column) -> Column:
        p = total(F.slice(probs, F.lit(1), F.size(pos_logits)))
        mass = total(probs)
        return F.when(mass > MINIMUM_LOGIT_MASS, p / mass).otherwise(UNDECIDED)
    return bind(softmax(F.concat(pos_logits, neg_logits)), share)


def class_probability(token_scores: Column, classes: int) -> Column:
    """Softmax over all class tokens, summed per class.

    ``token_scores`` is ``ARRAY<STRUCT<cls, score>>``; ``argmax_class`` of the
    result is the answer.
    """
    probs = softmax(F.transform(token_scores, lambda x: x["score"]))
    paired = F.zip_with(token_scores, probs, lambda t, p: F.struct(t["cls"].alias("cls"), p.alias("p")))
    return bind(paired, lambda pairs: F.array(*[
        F.aggregate(pairs, F.lit(0.0), _add_class(c))
        for c in range(classes)]))


def _add_class(c: int):
    return lambda s, x: s + F.when(x["cls"] == c, x["p"]).otherwise(0.0)


def predicted_class(token_scores: Column, classes: int) -> Column:
    return bind(class_probability(token_scores, classes), argmax_class)


def parse_class_answer(content: Column, classes: int = 4) -> Column:
    """Class number of an answer asked for as JSON; -1 if there is none."""
    label = F.from_json(content, "label string")["label"].try_cast("double").cast("int")
    written = F.nullif(F.regexp_extract(content, DIGIT_LABEL, 1), F.lit("")).cast("int")
    digits = F.regexp_extract_all(content, F.lit(f"[0-{classes - 1}]"), F.lit(0))
    return F.coalesce(label, written, F.try_element_at(digits, F.lit(-1)).cast("int"), F.lit(-1))


def combine(steps: Sequence[Column]) -> Column:
    """First probability that is not null."""
    return F.coalesce(*steps)


def answer_probability(raw: Column, pos: str, neg: str, legacy_substring: bool = False) -> Column:
    """Token probability of a raw response, else its text, recovered from the reasoning if blank."""
    parts = response_parts(raw)
    text = recover_from_reasoning(parts["content"], parts["reasoning"], pos, neg, True, legacy_substring)
    return combine([token_probability(parts["top_logprobs"], pos, neg),
                    parse_text_answer(text, pos, neg, True, legacy_substring)])
