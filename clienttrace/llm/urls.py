"""URL filter: rules first, else the ratio of two character models. DataFrame functions only.

URLs that a rule decides teach two variable-order Markov models, one of accepted
and one of rejected URLs. A sign's probability after up to ``ORDER - 1`` signs
is blended with that after one sign less (Witten-Bell):

    p_k = (count + kinds * p_(k-1)) / (total + kinds)

with ``kinds`` the number of different signs seen after the context, down to a
uniform 1/256; a context never seen leaves the shorter one's. A URL's score is
the mean over its signs of ln p(accepted) - ln p(rejected), so its length does not
matter. The threshold is calibrated on rule-decided URLs that taught nothing: the
score, in steps of ``STEP``, at which accepted and rejected URLs part best.

Counts are combined map side per distinct n-gram. The table of n-grams is
broadcast up to ``BROADCAST_GRAMS`` rows, counted first; beyond, it is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, written

ORDER = 4
STEP = 0.01
BROADCAST_GRAMS = 1 << 18
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and the rest of a URL; all empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(behind, "^[^?#]*", 0)
    return F.translate(host, *LETTERS), path, F.substring(behind, F.length(path) + 1, F.length(behind))


def matching_rule(rules: list[tuple[str, str, str]]) -> Column:
    """``(verdict, rule)`` of the longest fitting rule (verdict, host, path), else null; of equally long ones the first."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule"))).otherwise(out)
    return out


def _model(grams: DataFrame) -> DataFrame:
    """``gram, llr`` from counts ``allow`` and ``block`` of each n-gram (zero for those that taught nothing)."""
    out = grams.select("gram", F.lit(1 / 256).alias("p_allow"), F.lit(1 / 256).alias("p_block"))
    for k in range(ORDER):
        tail = F.substring("gram", ORDER - k, k + 1)
        counts = grams.groupBy(tail.alias("tail")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = F.substring("tail", 1, k)
        totals = counts.groupBy(context.alias("context")).agg(
            *(F.sum(c).alias(f"n_{c}") for c in ("allow", "block")),
            *(F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in ("allow", "block")))
        stats = counts.withColumn("context", context).join(totals, "context").drop("context")
        out = out.withColumn("tail", tail).join(stats, "tail")
        blended = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"k_{c}") * F.col(f"p_{c}"))
                             / (F.col(f"n_{c}") + F.col(f"k_{c}"))).otherwise(F.col(f"p_{c}")) for c in ("allow", "block")}
        out = out.select("gram", *(v.alias(f"p_{c}") for c, v in blended.items()))
    return out.select("gram", (F.ln("p_allow") - F.ln("p_block")).alias("llr"))


def _threshold(scored: DataFrame) -> float:
    """The step that parts held-out accepted and rejected URLs best; of equal ones the middle one."""
    step = F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") / STEP)))
    found = scored.where("held_out and rule.verdict is not null").groupBy(step.alias("step")).agg(
        F.count_if(F.col("rule.verdict") == "allow").alias("allow"), F.count("*").alias("n")).collect()
    allow = {r["step"]: r["allow"] for r in found}
    block = {r["step"]: r["n"] - r["allow"] for r in found}
    all_allow, all_block = sum(allow.values()), sum(block.values())
    if not all_allow or not all_block:
        return 0.0
    best, at, below_allow, below_block = -1.0, [], 0, 0
    for step in range(-2000, 2002):
        gain = (all_allow - below_allow) / all_allow + below_block / all_block
        if gain > best:
            best, at = gain, []
        if gain == best:
            at.append(step)
        below_allow += allow.get(step, 0)
        below_block += block.get(step, 0)
    return at[len(at) // 2] * STEP


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id",
          url_column: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, score, threshold`` per row: the rule's verdict, else the models'.

    A null URL has host and path empty and is scored as the empty text. If the rules teach only one kind
    of URLs, or none, the models say that kind (none: allow). Repeated rows are repeated, empty tables stay empty.
    """
    host, path, rest = parts(F.coalesce("url", F.lit("")))
    rows = columns(pages, id_column, url_column).toDF("id", "url").select(
        "id", host.alias("host"), path.alias("path"), rest.alias("rest"),
        (F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(5)) == 0).alias("held_out"))
    rows = written(rows.withColumn("rule", matching_rule(rules)).withColumn("row", F.uuid()), "urls")
    taught = {r["verdict"] for r in rows.where("rule is not null and not held_out").select(
        "rule.verdict").distinct().collect()}
    if taught != {"allow", "block"}:
        other = "block" if taught == {"block"} else "allow"
        return rows.select(F.col("id").alias(id_column), "host", "path", "rule.rule",
                           F.coalesce("rule.verdict", F.lit(other)).alias("verdict"),
                           F.lit(0.0).alias("score"), F.lit(0.0).alias("threshold"))
    # Overlapping n-grams by a lookahead; the start is padded, the end is a sign of its own.
    text = F.concat(F.lit("\u0002" * (ORDER - 1)), "host", "path", "rest", F.lit("\u0003"))
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{ORDER}}}))"), F.lit(1))
    signs = rows.withColumn("gram", F.explode(grams))
    teaches = F.col("rule").isNotNull() & ~F.col("held_out")
    counts = signs.groupBy("gram").agg(*(
        F.count_if(teaches & (F.col("rule.verdict") == c)).alias(c) for c in ("allow", "block")))
    model = written(_model(written(counts, "grams")), "ratios")
    if model.count() <= BROADCAST_GRAMS:
        model = F.broadcast(model)
    scored = written(signs.join(model, "gram").groupBy("row", "id", "host", "path", "rule", "held_out").agg(
        F.avg("llr").alias("score")), "scored")
    limit = _threshold(scored)
    return scored.select(
        F.col("id").alias(id_column), "host", "path", "rule.rule",
        F.coalesce("rule.verdict", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
        "score", F.lit(limit).alias("threshold"))
