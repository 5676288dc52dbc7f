"""Licences named in texts: an Aho-Corasick scan for tags and notices, a shunting-yard parser for expressions.

The words of a whole text, joined by blanks, run once through an automaton of
notice phrases and of the words of the identifier tag. Behind the place of a
tag, where a colon follows, the expression that its line starts with is parsed (``with`` binds before ``and``, that before
``or``) and evaluated. Nothing is shuffled; a document stays in its task.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import map_texts

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notice phrases of common licences.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: First letters of identifiers and the label of their family.
FAMILIES = {"agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "mit": "mit", "cc-by-sa": "cc-by-sa",
            "cc-by": "cc-by", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "unlicense": "unlicense"}
COPYLEFT = {"gpl", "agpl", "lgpl", "mpl", "epl", "cc-by-sa"}

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_BEHIND_TAG = re.compile(rb"[ \t]*:([^\r\n]*)")
#: Brackets, operators and identifiers (which start and end with a letter, digit or plus), or any other sign.
_PARTS = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?|[^\s()]")
_BINDS = {"or": 1, "and": 2, "with": 3}

SPANS = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
EXPRESSIONS = pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_()),
                                  ("labels", pa.list_(pa.string()))]))


def postfix(expression: str) -> list[str] | None:
    """Operands and operators in the order of evaluation; ``None`` if the expression is none."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # what must come next
    for part in _PARTS.findall(expression):
        low = part.lower()
        if low in _BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        elif part == "(":
            if not operand:
                return None
            waiting.append(part)
        elif part == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand or not part[0].isalnum():
                return None
            out.append(part)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def family(identifier: str) -> str:
    low = identifier.lower()
    found = [f for f in FAMILIES if low == f or low.startswith(f + "-")]
    return FAMILIES[max(found, key=len)] if found else low.rstrip("+")


def evaluate(expression: str) -> dict:
    """Labels an expression asks for and whether it can be met without copyleft.

    ``or`` is met if one side is, ``and`` if both are; an exception behind
    ``with`` leaves the licence what it is. What cannot be parsed has no labels.
    """
    order = postfix(expression)
    if order is None:
        return {"expression": expression.strip(), "valid": False, "permissive": None, "labels": []}
    stack: list[tuple[bool, frozenset[str]]] = []
    for part in order:
        if part not in _BINDS:
            label = family(part)
            stack.append((label not in COPYLEFT, frozenset([label])))
            continue
        (a, some), (b, more) = stack[-2:]
        del stack[-2:]
        stack.append((a, some) if part == "with" else (a or b if part == "or" else a and b, some | more))
    return {"expression": expression.strip(), "valid": True, "permissive": stack[0][0], "labels": sorted(stack[0][1])}


def expressions_in(line: str) -> list[str]:
    """The expressions a tag line starts with: up to the first part that cannot belong to one.

    That leaves out comment ends and remarks. Behind a comma or semicolon there may be a further expression, if
    all its identifiers are of known families.
    """
    out, start, end, operand, depth = [], 0, 0, True, 0
    for m in _PARTS.finditer(line):
        part = m[0].lower()
        if part in _BINDS:
            if operand:
                break
            operand = True
        elif part == "(":
            if not operand:
                break
            depth += 1
        elif part == ")":
            if operand or not depth:
                break
            depth -= 1
        elif part in ",;" and not operand and not depth:
            out.append(line[start:end])
            start, operand = m.end(), True
        elif part[0].isascii() and part[0].isalnum() and operand:
            operand = False
        else:
            break
        end = m.end()
    out.append(line[start:max(start, end)])
    known = set(FAMILIES.values())
    return out[:1] + [e for e in out[1:] if set(evaluate(e)["labels"]) and set(evaluate(e)["labels"]) <= known]


def automaton() -> ahocorasick.Automaton:
    """Every phrase between blanks, so that only whole words match."""
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (label, kind, len(phrase) + 2, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def scan_text(text: str | None, phrases: ahocorasick.Automaton) -> tuple[int, list[dict], list[dict]]:
    """Number of words, spans of phrases by word number, and expressions of a whole text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.translate(_WORD_BYTES).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    spans, expressions, at, seen = [], [], 0, 0
    for end, (label, kind, size, n) in phrases.iter(joined):
        start = end + 1 - size
        if start < at:  # a longer phrase may end later and start earlier
            at = seen = 0
        seen += joined.count(" ", at, start)
        at = start
        spans.append({"label": label, "kind": kind, "start": seen, "words": n})
    tags = [s["start"] + s["words"] - 1 for s in spans if s["kind"] == "tag"]
    if tags:
        # Normalising keeps the places of bytes, so the end of a tag's last word is where its line goes on.
        ends = [m.end() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
        for behind in (_BEHIND_TAG.match(raw, ends[t]) for t in tags):
            if behind:
                expressions += [evaluate(e) for e in expressions_in(behind[1].decode("utf-8", "replace"))]
    return len(words), spans, expressions


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_words, spans, expressions`` per row.

    Spans (label, kind ``base``, ``notice`` or ``tag``, first word, number of
    words) are in the order in which phrases end, overlapping ones and repeats included.
    Null and empty texts have no words and empty lists; repeated rows are repeated; an empty table gives no rows.
    """
    def run(texts: list[str | None]):
        phrases = automaton()
        found = [scan_text(t, phrases) for t in texts]
        return [[f[i] for f in found] for i in range(3)]

    return map_texts(docs, id_column, text_column, {"n_words": pa.int64(), "spans": SPANS, "expressions": EXPRESSIONS}, run)


def summary(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts, labels and a score per scanned row.

    The score is how sure the finding is: each place of a phrase leaves a doubt
    of 0.4, each valid expression of 0.1, and doubts multiply; without any it is 0.
    """
    base = F.filter("spans", lambda s: s["kind"] == "base")
    starts = F.transform(base, lambda s: s["start"])
    labelled = F.filter("spans", lambda s: s["kind"] != "tag")
    valid = F.filter("expressions", lambda e: e["valid"])
    every = F.concat(F.transform(labelled, lambda s: s["label"]), F.flatten(F.transform(valid, lambda e: e["labels"])))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        id_column, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), text(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        text(every).alias("labels"),
        (1 - F.pow(F.lit(0.4), F.size(labelled)) * F.pow(F.lit(0.1), F.size(valid))).alias("score"),
        F.exists(valid, lambda e: e["permissive"]).alias("permissive"),
        F.array_join(F.transform("expressions", lambda e: e["expression"]), "; ").alias("expressions"))
