"""Personal data by candidate gradient boosting.

Four strict rules find the base spans (email, ip, card, phone). High-recall
generators propose more: anything that looks like an address with an at-sign
(also "(at)", "[at]"), and runs of seven digits or more with any common
separators. Proposals overlap base spans and each other. Boosted trees rate each
proposal by its format (digits, groups, separators, checksum, top-level part)
and its context (neighbouring characters and a cue word in front). They learn
from the base spans: a proposal that overlaps one is personal data, and so are the
base spans rewritten in their own contexts to forms the base rules miss (no
plus sign, brackets, other separators, a spelled-out sign). Proposals that overlap
none are the contrary, but for those with a strong cue, which are no examples.
Every such proposal and every rewritten span takes part: two thirds by the hash of
their text train the trees, in the held-out third the rewritten spans and the
unknown proposals set a threshold for each family: the lowest rating of a rewritten
span at which their share is at least ``precision``. Proposals rated higher that overlap no
base span are added; of overlapping ones the address stays.

All of it is DataFrame work. A text is cut at the matches of a pattern (marked
by two control characters, which are first replaced in the text by a third one
of the same class); positions are running sums of the parts' lengths, in code
points.

Defined results: a null or empty text has no spans; rows are treated one by
one, repeats and null ids included; an empty table gives no rows; if the
proposals hold one answer only, nothing is learned and nothing added. Only
doc_id and text are read; labels of any kind are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import KEY, row_key, stage

# Fixed patterns of the base rules, in the order of the digest. Repeated groups are
# possessive: Java matches others by recursion, and a long run overflows the stack.
# A run of digits that is no ip from its first digit on is none from a later one.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Addresses with spelled-out signs; digit runs with any usual separators.
GENERATORS = {
    "address": r"[^\s@()\[\]]++\x20?(?:@|\(at\)|\[at\])\x20?[^\s@()\[\]]+",
    "number": r"[+(]?[0-9][0-9\x20()./-]{5,}[0-9]",
}
#: Where a match can start at all: a run that leads to no sign from its first character, or from the last match's end
#: (\G), leads to none from a later one, so no run is read again from each of its characters. Matches stay the same.
STARTS = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)", "address": r"(?:(?<![^\s@()\[\]])|\G)"}
KINDS = [*BASE]
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
CONTEXT = 24
CUES = r"(?i)(tel|phone|call|mobile|fax|mail|contact|card|visa|account|ssn)\W*$"


@dataclass(frozen=True)
class Settings:
    precision: float = 0.99
    trees: int = 10
    depth: int = 3
    seed: int = 5


def cut_at(text: Column, pattern: str, needs: Column) -> Column:
    """The parts of ``text``: what precedes the first match, then each match (closed by CLOSE) and what follows it.

    Possessive search for runs is left to the pattern; ``needs`` skips texts that cannot match.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}")
    return F.when(needs, F.split(marked, OPEN)).otherwise(F.array().cast("array<string>"))


def find(docs: DataFrame) -> DataFrame:
    """Staged matches (uid, kind, start, end, value, before, after) of all patterns, and a header (kind null) for each row."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    src = docs.select(F.col("doc_id"), *row_key(), F.monotonically_increasing_id().alias("uid"), text.alias("t"))
    src = src.withColumn("at", F.col("t").contains("@")).withColumn("digit", F.col("t").rlike("[0-9]"))
    src = src.withColumn("plus", F.col("t").contains("+") & F.col("digit")).withColumn(
        "sign", F.col("at") | F.col("t").contains("(at)") | F.col("t").contains("[at]"))
    needs = {"email": "at", "ip": "digit", "card": "digit", "phone": "plus", "address": "sign", "number": "digit"}
    patterns = {**BASE, **GENERATORS}
    cut = src.select("uid", "doc_id", *KEY, *(cut_at(F.col("t"), STARTS.get(k, "") + p, F.col(needs[k])).alias(k) for k, p in patterns.items()))

    def parts(kind: str) -> Column:
        a = F.col(kind)
        each = F.transform(a, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("n"), (F.length(x) - F.when(i > 0, 1).otherwise(0)).alias("size"),
            F.when(i > 0, F.substring_index(x, CLOSE, 1)).alias("value"),
            F.when(i > 0, F.right(F.get(a, i - 1), F.lit(CONTEXT))).alias("before"),
            F.when(i > 0, F.left(F.substring_index(x, CLOSE, -1), F.lit(4))).alias("after")))
        return F.when(F.size(a) > 1, each).otherwise(F.array().cast(_parts))

    head = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("size"),
                            *(F.lit(None).cast("string").alias(c) for c in ("value", "before", "after"))))
    rows = cut.select("uid", "doc_id", *KEY, F.explode(F.concat(head, *(parts(k) for k in patterns))).alias("p"))
    rows, _ = stage(rows.select("uid", "doc_id", *KEY, "p.*"), "pii-parts")
    return rows


_parts = "array<struct<kind string, n int, size int, value string, before string, after string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the checksum."""
    places = F.sequence(F.lit(1), F.length(number))
    def value(i):
        d = F.try_element_at(F.split(F.reverse(number), ""), i).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def accepted(kind: Column, value: Column) -> Column:
    """The base rules' checks of a match."""
    n = F.length(digits(value))
    small = F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    card = F.when((n >= 16) & (n <= 19), luhn(digits(value))).otherwise(False)
    return (F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card)
            .when(kind == "phone", (n >= 8) & (n <= 15)).otherwise(False))


def spans(parts: DataFrame) -> DataFrame:
    """Matches with positions: (uid, kind, start, end, value, before, after, base)."""
    upto = Window.partitionBy("uid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = (parts.where(F.col("kind").isNotNull()).withColumn("start", F.sum("size").over(upto)).where(F.col("n") > 0))
    return placed.select("uid", "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value", "before", "after",
                         accepted(F.col("kind"), F.col("value")).alias("base"))


def proposals(found: DataFrame) -> DataFrame:
    """Matches of the generators, and whether each overlaps a base span of its document."""
    kept = found.where(F.col("base") | F.col("kind").isin([*GENERATORS]))
    so_far = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return (kept.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(so_far))
            .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(to_come))
            .where(~F.col("base")).withColumn("known", F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) |
                                              F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
            .drop("reach", "next", "base"))


FEATURES = ["is_number", "length", "n_digits", "n_groups", "longest", "n_marks", "plus", "brackets", "luhn_ok", "dots",
            "top", "signs", "slash", "left_word", "right_word", "right_digit", "cue"]


def features(p: DataFrame) -> DataFrame:
    v, d = F.col("value"), digits(F.col("value"))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda chars: (F.length(v) - F.length(F.translate(v, chars, ""))).cast("double")
    n = F.length(d)
    return p.withColumns({
        "is_number": one(F.col("kind") == "number"), "length": F.least(F.length(v), F.lit(200)).cast("double"),
        "n_digits": F.least(n, F.lit(200)).cast("double"), "n_groups": F.least(F.size(groups), F.lit(50)).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda x: F.length(x))), F.lit(0)).cast("double"),
        "n_marks": count(" ().-/"), "plus": one(v.startswith("+")), "brackets": count("()"),
        "luhn_ok": one(F.when((n >= 12) & (n <= 19), luhn(d))), "dots": count("."),
        "top": F.length(F.regexp_extract(v, r"\.([A-Za-z]{2,})\W*$", 1)).cast("double"), "signs": count("@"),
        "slash": count("/"), "left_word": one(F.col("before").rlike("[A-Za-z0-9=\"]$")),
        "right_word": one(F.col("after").rlike("^[A-Za-z]")), "right_digit": one(F.col("after").rlike("^[0-9]")),
        "cue": one(F.col("before").rlike(CUES))})


def rewritten(found: DataFrame) -> DataFrame:
    """Base spans in the forms that the base rules miss, in their own contexts, like the generators would propose them."""
    v, n, outside = F.col("value"), digits(F.col("value")), r"[^\s@()\[\]]+"
    plain = F.regexp_replace(v, r"^\+", "")
    phone = F.array(plain, F.regexp_replace(F.translate(plain, "()", ""), r"^([0-9]+)(?=[^0-9])", "($1)"),
                    F.regexp_replace(v, r"^\+[0-9]+[\x20.-]*(?=\()", ""), F.regexp_replace(F.translate(plain, "()", ""), r"[\x20.-]+", "/"))
    four = lambda mark: F.regexp_replace(n, "([0-9]{4})(?=[0-9])", "$1" + mark)
    whole = F.concat(F.regexp_extract("before", outside + "$", 0), v, F.regexp_extract("after", "^" + outside, 0))
    email = F.array(*(F.regexp_replace(whole, "@", mark) for mark in (" (at) ", "(at)", " [at] ", "[at]", " @ ")))
    forms = (F.when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", F.array(four("."), four("/")))
             .when(F.col("kind") == "email", email))
    address = F.col("kind") == "email"
    bases = found.where(F.col("base") & F.col("kind").isin("phone", "card", "email"))
    rows = bases.withColumn("source", v).withColumn("form", F.explode(F.array_distinct(forms))).where(F.col("form") != F.col("value"))
    rows = rows.withColumns({
        "before": F.when(address, F.regexp_replace("before", outside + "$", "")).otherwise(F.col("before")),
        "after": F.when(address, F.regexp_replace("after", "^" + outside, "")).otherwise(F.col("after")),
        "kind": F.when(address, "address").otherwise("number"), "value": F.col("form")})
    fits = F.when(F.col("kind") == "address", F.col("value").rlike(f"^(?:{GENERATORS['address']})$")).otherwise(
        F.col("value").rlike(f"^(?:{GENERATORS['number']})$"))
    return rows.where(fits).drop("form", "base")


def select_added(p: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Proposals that the boosted trees add: (uid, kind, start, end)."""
    p, _ = stage(features(p), "pii-proposals")
    # What speaks for personal data although no base rule knows it is no example of the contrary.
    n_digits = F.col("n_digits")
    cued = ((F.col("cue") == 1) | ((F.col("kind") == "address") & (F.col("signs") == 0) & (F.col("top") >= 2)) |
            ((F.col("luhn_ok") == 1) & (n_digits >= 16)) |
            ((F.col("kind") == "number") & (F.col("brackets") == 2) & n_digits.between(8, 15) & (F.col("n_groups") >= 3)))
    seen = p.where(F.col("known") | ~cued).withColumn("source", F.col("value"))
    seen = seen.withColumn("answer", F.col("known").cast("double")).withColumn("rewritten", F.lit(False))
    made = features(rewritten(found)).withColumns({"known": F.lit(False), "answer": F.lit(1.0), "rewritten": F.lit(True)})
    # A span and its other forms fall into one fold.
    train, _ = stage(seen.unionByName(made).withColumn(
        "fold", F.pmod(F.xxhash64(F.regexp_replace("source", "[^A-Za-z0-9]", "")), F.lit(3))), "pii-train")
    none = p.limit(0).select("uid", "kind", "start", "end")
    if train.where(F.col("fold") > 0).select("answer").distinct().count() < 2:
        return none
    trees = GBTClassifier(labelCol="answer", featuresCol="features", maxIter=s.trees, maxDepth=s.depth, seed=s.seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(
        train.where(F.col("fold") > 0))
    rate = lambda df: model.transform(df).withColumn("rating", vector_to_array("probability")[1])
    upward = Window.partitionBy("kind").orderBy(F.desc("rating")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The bar is set on what is to be added: missed forms against proposals that no base rule knows. Rows are counted by
    # rating first: the trees have few of them, however many rows there are.
    held = rate(train.where((F.col("fold") == 0) & ~F.col("known"))).groupBy("kind", "rating").agg(
        F.count_if("rewritten").alias("right"), F.count(F.lit(1)).alias("all"))
    held = held.withColumn("share", F.sum("right").over(upward) / F.sum("all").over(upward))
    bars = held.where((F.col("share") >= s.precision) & (F.col("right") > 0)).groupBy("kind").agg(F.min("rating").alias("bar"))
    bars = {r["kind"]: r["bar"] for r in bars.collect()}  # one row a family
    if not bars:
        return none
    bar = F.lit(None).cast("double")
    for kind, x in sorted(bars.items()):
        bar = F.when(F.col("kind") == kind, x).otherwise(bar)
    chosen = rate(p.where(~F.col("known"))).where(F.col("rating") >= bar)
    # A number inside an address that is added itself goes with it.
    by = Window.partitionBy("uid").orderBy("start")
    address = F.col("kind") == "address"
    chosen = (chosen.withColumn("reach", F.max(F.when(address, F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0)))
              .withColumn("next", F.min(F.when(address, F.col("start"))).over(by.rangeBetween(0, Window.unboundedFollowing)))
              .where(address | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) |
                                 F.coalesce(F.col("next") < F.col("end"), F.lit(False)))))
    n = F.length(digits(F.col("value")))
    kind = F.when(address, "email").when((n >= 16) & (F.col("luhn_ok") == 1), "card").otherwise("phone")
    return chosen.select("uid", kind.alias("kind"), "start", "end")


def personal_data(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, no_id, id, text_hash, spans, base): ascending (rank of kind, kind, start, end, base) of each row."""
    parts = find(docs)
    found, _ = stage(spans(parts), "pii-spans")
    added = select_added(proposals(found), found, s)
    every = (found.where("base").select("uid", "kind", "start", "end", "base")
             .unionByName(added.withColumn("base", F.lit(False))))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    span = F.struct(rank.alias("rank"), "start", "end", "kind", "base")
    by_doc = every.groupBy("uid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    heads = parts.where(F.col("kind").isNull()).select("uid", "doc_id", *KEY)
    none = F.array().cast("array<struct<rank int, start bigint, end bigint, kind string, base boolean>>")
    return heads.join(by_doc, "uid", "left").withColumn("spans", F.coalesce(F.col("spans"), none)).drop("uid")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``personal_data``."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    n = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with a column ``redacted``: each span replaced by its kind in brackets; of overlapping spans the first."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)), "text", *row_key())
    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                            .when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(a["rank"] - b["rank"]))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    text = F.col("text")
    def step(acc, x):
        new = F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                       F.lit("["), x["kind"], F.lit("]"))
        skip = x["start"] < acc["at"]
        return F.struct(F.when(skip, acc["at"]).otherwise(x["end"]).alias("at"), F.when(skip, acc["done"]).otherwise(new).alias("done"))
    clean = F.aggregate(by_start, start, step, lambda acc: F.concat(
        acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    spans_of = found.select(*KEY, "spans").dropDuplicates(KEY)
    return rows.join(spans_of, KEY, "left").select(
        *(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)), clean.alias("redacted"))
