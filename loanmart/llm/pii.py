"""Personal data: candidate spans by generators, boosted trees on format and context, in DataFrame functions only.

Four base kinds are fixed: their matches that pass the kind's check are always spans.  High-recall
generators propose more (identity numbers, account numbers, national phone numbers, secrets), overlapping
or not.  Some of these are certain: identity numbers by their area and group rules, account numbers by
their remainder of 97, phone numbers and secrets that something like ``tel:`` or ``password=`` announces;
what fails its rules, and a secret of digits only, is certainly nothing.  Boosted trees are fitted on format
and context of certain candidates, of base matches by their checks, and on long plain words, which
are nothing.  A base match that fails is no counterexample where another base match passes or a generator with
rules of its own claims the place.  In half of the rows the context is hidden, so that format alone must do there as well.
Uncertain candidates are selected above a probability that keeps the asked precision over all certain ones
of their kind.

The patterns run from left to right in time linear in the text; a text moves nowhere, only its matches do.
Positions are code points, the end exclusive.  Defined cases: a null or empty text has no spans; several
kinds may claim one place; repeated rows are handled each; with labels of one sort only, just certain
candidates are added; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import stored

CONTEXT = 24
SAMPLE = 20_000  # labelled candidates the trees are fitted on, in hash order
WORD_TEXTS = 2_000  # texts whose long plain words are counterexamples
PRECISION = 0.95
TREES, DEPTH = 12, 4


@dataclass(frozen=True)
class Kind:
    """A generator; ``hint`` is what a text must have for the pattern to be worth running."""

    name: str
    pattern: str
    hint: str
    base: bool = False


# fixed values: the base kinds.  A run that may begin anywhere begins at its left end or
# where the last match ended; possessive repeats keep time and stack bounded.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9]", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+", True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]"),
    Kind("tel", r"(?<![0-9+.-])(?<![0-9][ /])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![ -]?[0-9-])|(?<![0-9+.-])(?<![0-9][ /])\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![ -]?[0-9-])", "[0-9]"),
    Kind("secret", r"(?:(?<![A-Za-z0-9_+/-])|\G)(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+(?!@)", "[0-9]"),
)
CHECKED = ("ssn", "iban", "tel")  # generators with rules of their own
FEATURES = ("length", "digits", "upper", "lower", "different", "runs", "gaps", "announced")


def _matches(text: Column, kind: Kind) -> Column:
    """Structs (kind, i, gap, hit, before): the i-th match and the text since the one before it."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def match(hit: Column, i: Column) -> Column:
        gap = F.get(gaps_of, i)
        return F.struct(
            F.lit(kind.name).alias("kind"), i.cast("long").alias("i"), F.length(gap).cast("long").alias("gap"),
            hit.alias("hit"), F.right(gap, F.lit(CONTEXT)).alias("before"),
        )

    # bound once, not once per match
    bound = F.array(F.struct(hits.alias("hits"), gaps.alias("gaps")))
    gaps_of = None

    def all_of(pair: Column) -> Column:
        nonlocal gaps_of
        gaps_of = pair["gaps"]
        return F.transform(pair["hits"], match)

    return F.flatten(F.transform(bound, all_of))


_MATCH = "array<struct<kind:string,i:bigint,gap:bigint,hit:string,before:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: Column, hit: Column) -> Column:
    """Whether a base match passes its kind's check."""
    digits = _digits(hit)
    n = F.length(digits)
    small = F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def _mod97(iban: Column) -> Column:
    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def certain(kind: Column, hit: Column, before: Column, valid: Column) -> Column:
    """1 or 0 where it is certain whether a candidate is what its kind says, else null."""
    iban = F.replace(hit, F.lit(" "), F.lit(""))
    ssn = ~hit.rlike("^(000|666|9)|-00-|-0000$")
    tel = hit.rlike(r"^\(?([2-9][0-9]{2}[) .-]+[2-9]|0[1-9])")
    called = before.rlike(r"(?i)\b(tele?(ph|f)one?|tel|phone|fon|fax|mobile|cell|call)[.:]*( (at|us|no\.?|number))?[:\s]*$")
    cue = before.rlike(r"(?i)(key|token|secret|passw(or)?d|pwd)[\"']?\s*[=:]\s*[\"']?$")
    return (
        F.when(kind.isin([k.name for k in KINDS if k.base]), valid.cast("double"))
        .when(kind == "ssn", ssn.cast("double"))
        .when(kind == "iban", (F.length(iban).between(15, 34) & (_mod97(iban) == 1)).cast("double"))
        .when(kind == "tel", F.when(~tel, 0.0).when(called, 1.0))
        .when(kind == "secret", F.when(cue, 1.0).when(hit.rlike("^[0-9-]+$"), 0.0))
    )


def _features(hit: Column, before: Column, shown: Column) -> dict[str, Column]:
    n = F.length(hit).cast("double")

    def share(c: str) -> Column:
        return F.regexp_count(hit, F.lit(c)) / n

    told = before.rlike(r"[=:]\s*[\"']?$").cast("double")
    return {
        "length": F.least(n, F.lit(80.0)),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "different": F.size(F.array_distinct(F.split(hit, ""))) / n,
        "runs": (F.regexp_count(hit, F.lit("[0-9]+")) + F.regexp_count(hit, F.lit("[A-Z]+")) + F.regexp_count(hit, F.lit("[a-z]+"))) / n,
        "gaps": share(r"[ ().-]"),
        "announced": F.when(shown, told).otherwise(0.0),
    }


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per match of any kind, and one of null kind for a text without, written once."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"))
    none = F.array().cast(_MATCH)
    lists = [F.when(F.col("text").rlike(k.hint), _matches(F.col("text"), k)).otherwise(none) for k in KINDS]
    rows = named.select("uid", "doc_id", F.explode_outer(F.concat(*lists)).alias("m")).select("uid", "doc_id", "m.*")
    in_text = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(in_text)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    rows = rows.withColumn("valid", passes(F.col("kind"), F.col("hit"))).drop("i", "gap")
    return stored(rows.withColumn("label", certain(F.col("kind"), F.col("hit"), F.col("before"), F.col("valid"))), "candidates")


def _labelled(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(label, features...): candidates whose label is certain, bounded in number, each kind and label alike."""
    # the trees aren't asked about kinds that rules settle; a failing secret is a failing base match already
    settled = F.col("kind").isin("ssn", "iban") | (F.col("kind") == "secret") & (F.col("label") == 0)
    sure = found.where("label is not null").where(~settled).select("uid", "kind", "start", "end", "hit", "before", "label")
    sizes = {(r["kind"], r["label"]): r["count"] for r in sure.groupBy("kind", "label").count().collect()}
    order, share = F.xxhash64("kind", "hit", "before", "start"), F.lit(0)
    for (kind, label), n in sorted(sizes.items()):
        part = min(1_000_000, -(-1_000_000 * SAMPLE // (len(sizes) * n)))
        share = F.when((F.col("kind") == kind) & (F.col("label") == label), part).otherwise(share)
    sure = stored(sure.where(F.pmod(order, F.lit(1_000_000)) < share).orderBy(order, "uid", "start").limit(SAMPLE), "drawn")
    # the drawn failures are few: those where another kind claims the place, by a passed check or with rules of its own, are none
    failed = sure.where("label = 0").where(~F.col("kind").isin(*CHECKED)).select("uid", "kind", "start", "end")
    claims = found.where(F.col("kind").isin(*CHECKED) | F.col("valid")).select("uid", F.col("start").alias("from"), F.col("end").alias("to"))
    claimed = claims.join(F.broadcast(failed), "uid").where("start < `to` and `from` < end").select("uid", "kind", "start").distinct()
    sure = sure.join(F.broadcast(claimed), ["uid", "kind", "start"], "left_anti").select("hit", "before", "label")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the texts are drawn by their hashes alone; the drawn hashes are few
    drawn = docs.select(F.xxhash64(t).alias("h")).distinct().orderBy("h").limit(WORD_TEXTS)
    some = docs.select(t.alias("text"), F.xxhash64(t).alias("h")).join(F.broadcast(drawn), "h", "left_semi")
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{9,}\b"), F.lit(0))).alias("hit"))
    words = words.distinct().orderBy(F.xxhash64("hit"), "hit").limit(SAMPLE // 4)
    plain = words.select("hit", F.lit("").alias("before"), F.lit(0.0).alias("label"))
    both = sure.unionByName(plain)
    told = _features(F.col("hit"), F.col("before"), _shown())
    return stored(both.select("label", *[c.alias(n) for n, c in told.items()]), "labelled")


def _shown() -> Column:
    return F.pmod(F.xxhash64("hit", "before", F.lit(7)), F.lit(2)) == 0


def _limits(scores: DataFrame) -> dict[str, float]:
    """Per kind the lowest limit above which precision holds, over all of (kind, p, label)."""
    bins = scores.groupBy("kind", F.floor(F.col("p") * 10_000).alias("bin"))
    rows = bins.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right"), F.max("p").alias("high")).collect()
    limits = {}
    for kind in {r["kind"] for r in rows}:
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["bin"])
        n = right = 0
        for i, r in enumerate(own):
            n, right = n + r["n"], right + r["right"]
            if right >= PRECISION * n:
                # down to the next certain candidate, which is left out
                limits[kind] = max(own[i + 1]["high"] if i + 1 < len(own) else 0.0, 0.5)
    return limits


def select_more(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(uid, kind, start, end) of generated candidates: the certain ones, and others that the trees select."""
    more = found.where(F.col("kind").isNotNull() & ~F.col("kind").isin([k.name for k in KINDS if k.base]))
    sure = more.where("label = 1").select("uid", "kind", "start", "end")
    rows = _labelled(found, docs, text)
    if rows.select("label").distinct().count() < 2:
        return sure
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(rows)
    p = vector_to_array("probability")[1].alias("p")

    def scored(some: DataFrame, shown: Column, *kept: str) -> DataFrame:
        told = _features(F.col("hit"), F.col("before"), shown)
        return model.transform(some.select(*kept, *[c.alias(n) for n, c in told.items()])).select(*kept, p)

    # kinds whose candidates are all certain need no limit; what fails the rules of its kind is never selected
    known = more.where("kind = 'secret' and label is not null or label = 1 and kind = 'tel'")
    limit = F.lit(None).cast("double")
    for kind, value in sorted(_limits(scored(known, _shown(), "kind", "label")).items()):
        limit = F.when(F.col("kind") == kind, value).otherwise(limit)
    told = scored(more.where("label is null"), F.lit(True), "uid", "kind", "start", "end")
    return sure.unionByName(told.where(F.col("p") > limit).select("uid", "kind", "start", "end"))


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans."""
    found = candidates(docs, doc_id, text)
    spans = found.select("uid", "doc_id", "kind", "start", "end", F.coalesce("valid", F.lit(False)).alias("base"))
    more = select_more(found, docs, text)
    added = more.select("uid", F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end", F.lit(False).alias("base"))
    spans = spans.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))
    order = F.lit(None).cast("int")
    for i, k in enumerate(KINDS):
        order = F.when(F.col("kind") == k.name, i).otherwise(order)
    piece = F.struct("start", order.alias("order"), "end", "kind", "base")
    kept = F.col("base") | F.col("added")
    grouped = spans.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(kept, piece))).alias("spans"),
        *[F.count_if(F.col("base") & (F.col("kind") == k.name)).alias(f"n_{k.name}") for k in KINDS if k.base],
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return grouped.select(
        "doc_id",
        *[f"n_{k.name}" for k in KINDS if k.base],
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every selected span replaced by its kind in brackets."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = stored(packed.withColumn("_uid", F.monotonically_increasing_id()), "documents")
    flat = keyed.select("_uid", F.col(f"doc.`{text}`").alias("text"))
    report = pii_report(flat, "_uid", "text").select(F.col("doc_id").alias("_uid"), "spans")
    joined = keyed.join(report, "_uid")
    parts = F.transform(
        F.filter(F.split("spans", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind")
        ),
    )
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))

    def step(s: Column, p: Column) -> Column:
        clean = F.substr(whole, s["at"] + 1, F.greatest(p["start"] - s["at"], F.lit(0)))
        mark = F.when(p["start"] >= s["at"], F.concat(F.lit("["), p["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.concat(s["out"], clean, mark).alias("out"))

    done = F.aggregate(parts, state, step, lambda s: F.concat(s["out"], F.substr(whole, s["at"] + 1)))
    redacted = F.when(F.col(f"doc.`{text}`").isNotNull(), done)
    return joined.select(*[redacted.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
