"""URL filtering by a ratio of character language models.

Rules (host and path prefix) judge the urls they fit.  From these, two variable-order Markov
models of characters are counted, one of accepted and one of rejected urls: contexts of up to
five characters, each order smoothed with the next lower one by the number of different
continuations (Witten-Bell).  A url's score is the difference of its two log-likelihoods per
character; the threshold is the one that best parts judged urls held out of the counts.

Everything is a table: counts of all six-character windows of all urls, lower orders by
summing over suffixes, and one log-ratio per distinct window, which the urls' windows are
joined with.  The tables grow with the corpus and never reach the driver.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule fits, and the
model scores the text there is (an empty one by its end mark alone); repeated urls are scored
once and counted as often as they occur; with no rule of either kind fitting any held-out url the
threshold is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored

ORDER = 5
HELD_OUT = 5  # one judged url in so many calibrates
BINS = 2000
ALPHABET = 256.0
_START, _END = "\x02", "\x03"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): rest is all after the first ``://``, host lower-cased in A-Z."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(verdict, rule), else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -len(split_rule(r[1])[0]), r[1])):
        of, prefix = split_rule(rule)
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def _windows(text: Column) -> Column:
    padded = F.concat(F.lit(_START * ORDER), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) of the full windows from (gram, a, b): counts in accepted and rejected urls."""
    levels = [counts]
    for k in range(ORDER, 0, -1):
        shorter = levels[0].groupBy(F.substr("gram", F.lit(2)).alias("gram"))
        levels.insert(0, stored(shorter.agg(F.sum("a").alias("a"), F.sum("b").alias("b")), f"grams{k}"))
    lower = None
    for k, level in enumerate(levels, 1):
        last = F.substr("gram", F.lit(1), F.lit(k - 1))
        seen = level.groupBy(last.alias("context")).agg(
            F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"),
            F.sum("b").alias("nb"), F.count_if(F.col("b") > 0).alias("tb"),
        )
        if k == 1:
            # the empty context is one row of four sums
            sums = seen.drop("context").first() or [0] * 4
            joined = level.withColumns({c: F.lit(v) for c, v in zip(("na", "ta", "nb", "tb"), sums)})
            joined = joined.withColumns({"pa": F.lit(1 / ALPHABET), "pb": F.lit(1 / ALPHABET)})
        else:
            joined = level.withColumns({"context": last, "suffix": F.substr("gram", F.lit(2))}).join(seen, "context")
            joined = joined.join(lower.withColumnRenamed("gram", "suffix"), "suffix")

        def smooth(n: str, total: str, kinds: str, p: str) -> Column:
            known = F.col(total) + F.col(kinds)
            return F.when(known == 0, F.col(p)).otherwise((F.col(n) + F.col(kinds) * F.col(p)) / known)

        lower = joined.select("gram", smooth("a", "na", "ta", "pa").alias("pa"), smooth("b", "nb", "tb", "pb").alias("pb"))
        lower = stored(lower, f"model{k}")
    return lower.select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Where accuracy, averaged over both classes, is best on judged urls held out."""
    judged = scored.where("held_out")
    low, high = judged.agg(F.min("score"), F.max("score")).first()
    if low is None:
        return 0.0
    width = (high - low) / BINS or 1.0
    at = F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1)).alias("bin")
    weight = F.col("n")
    rows = judged.groupBy(at).agg(
        F.sum(F.when(F.col("verdict") == "allow", weight).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", weight).otherwise(0)).alias("b"),
    ).collect()
    a, b = {r["bin"]: r["a"] for r in rows}, {r["bin"]: r["b"] for r in rows}
    total_a, total_b = sum(a.values()), sum(b.values())
    if not total_a or not total_b:
        return 0.0
    below_a = below_b = 0
    best, run = (-1.0, 0), []
    for k in range(BINS + 1):
        right = (total_a - below_a) / total_a + below_b / total_b
        if right > best[0] + 1e-12:
            best, run = (right, k), [k]
        elif math.isclose(right, best[0]):
            run.append(k)
        below_a, below_b = below_a + a.get(k, 0), below_b + b.get(k, 0)
    return low + width * run[len(run) // 2]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """All rows with ``host``, ``path``, ``rule``, ``verdict`` and ``score``; columns of these names are replaced."""
    added = ("host", "path", "rule", "verdict", "score")
    distinct = pages.groupBy(F.col(f"`{url}`").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    host, path, rest = parts(F.col("url"))
    shown = F.concat(host, F.substr(rest, F.length(host) + 1))
    distinct = distinct.select("url", "n", host.alias("host"), path.alias("path"),
                               F.when(F.instr("url", "://") > 0, shown).otherwise(F.coalesce("url", F.lit(""))).alias("said"))
    distinct = distinct.withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    held = F.col("judged").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0)
    urls = distinct.select("url", "n", "host", "path", "judged.verdict", "judged.rule", held.alias("held_out"), "said")
    urls = stored(urls.withColumn("uid", F.monotonically_increasing_id()), "urls")
    windows = urls.select("uid", "n", "verdict", "held_out", F.explode(_windows(F.col("said"))).alias("gram"))
    counted = ~F.col("held_out")
    counts = windows.groupBy("gram").agg(
        F.sum(F.when(counted & (F.col("verdict") == "allow"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(counted & (F.col("verdict") == "block"), F.col("n")).otherwise(0)).alias("b"),
    )
    ratios = stored(_log_ratios(stored(counts, "grams")), "ratios")
    scores = windows.select("uid", "gram").join(ratios, "gram").groupBy("uid").agg(F.avg("ratio").alias("score"))
    scored = stored(urls.join(scores, "uid").select("url", "n", "host", "path", "verdict", "rule", "held_out", "score"), "scored")
    threshold = _threshold(scored)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    s = scored.withColumn("verdict", F.coalesce("verdict", by_model)).alias("s")
    p = pages.alias("p")
    rest = [F.col(f"p.`{c}`") for c in pages.columns if c not in added]
    return p.join(s, F.col(f"p.`{url}`").eqNullSafe(F.col("s.url"))).select(*rest, *[F.col(f"s.{c}") for c in added])
