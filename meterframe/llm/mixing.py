"""Mixing sources to target weights by hierarchical budgets.

The sources form a tree (by default domain, language, source). A token budget
enters at the root and is split among a node's children by their weights; a
child takes no more than its subtree can give (its tokens times the permitted
epochs), and what it leaves is shared out among its siblings. Only what a whole
family cannot give goes back to the parent's siblings, because a child's limit
is that of its whole subtree. Each leaf then reads its documents in the seeded
order of epoch 0, 1, ... and keeps the prefix that holds its budget in tokens;
the document that the budget's end falls in is kept with the tokens left for it.

Budgets are whole numbers: among the children that are not used up, child i
gets ``floor(B * W_i / W) - floor(B * W_(i-1) / W)``, with W_i the running sum
of weights in the order of the names, so shares add up to the budget.

All of it is DataFrame work. The order of a leaf is that of the md5 of (seed,
epoch, id); token sums by leaf and slice of that order (a few hex digits) find
the slice in which the budget ends, and only the ids of that one slice are
ranked. No task holds a leaf. Rows with one id stand together in the order: at
the budget's end all of them stay, and what is left is split by their tokens.

Defined results: a null level has the name "<null>"; a null or empty text has
no tokens and is kept when it lies in the prefix (before the point where the
budget is met); a node without a stated weight has weight 1, one with weight 0
or less gets nothing; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import id_text, stage

#: Leading hex digits of the order that make a slice: 16 ** 4 slices a leaf.
SLICE_DIGITS = 4
#: Leaves up to this number go to every task (a row of some 200 bytes each);
#: beyond it the leaf table is joined by shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    levels: tuple[str, ...]
    weights: dict = field(default_factory=dict)  # {(name, ...): whole weight}, by path from the root
    share: float = 0.5       # budget as a share of the corpus tokens
    max_epochs: int = 2
    seed: int = 17


def count_tokens(text: Column) -> Column:
    """Words between white space (space, tab to carriage return)."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(words) - (F.element_at(words, 1) == "").cast("int") -
            ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def name_levels(df: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    for level in levels:
        df = df.withColumn(level, F.coalesce(F.col(level).cast("string"), F.lit("<null>")))
    return df


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Budget of each leaf from ``(level..., tokens)``: water-filling from the root down."""
    spark = leaves.sparkSession
    caps = leaves.withColumn("cap", (F.col("tokens") * mix.max_epochs).cast("decimal(38,0)"))
    share = F.lit(str(mix.share)).cast("decimal(9,6)")
    budget = caps.groupBy().agg(F.floor(F.sum("tokens") * share).cast("decimal(38,0)").alias("budget"))
    parents = budget.select(F.col("budget")).withColumn("root", F.lit(1))
    for depth in range(1, len(mix.levels) + 1):
        names, above = list(mix.levels[:depth]), list(mix.levels[:depth - 1])
        nodes = caps.groupBy(*names).agg(F.sum("cap").cast("decimal(38,0)").alias("cap")).withColumn("root", F.lit(1))
        nodes = nodes.withColumn("weight", _weight(mix, names).cast("decimal(18,0)"))
        nodes = nodes.join(parents, ["root", *above]).where(F.col("weight") > 0)
        family = Window.partitionBy("root", *above)
        # Children by the level at which they are used up: cap / weight.
        filling = family.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), names[-1])
        ahead = filling.rowsBetween(Window.unboundedPreceding, -1)
        rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        left = F.col("budget") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
        nodes = (nodes.withColumn("left", left).withColumn("open_weight", F.sum("weight").over(rest))
                 .withColumn("used_up", F.col("cap") * F.col("open_weight") <= F.col("weight") * F.col("left")))
        # Used up are those before the first child that is not.
        nodes = nodes.withColumn("full", F.min(F.col("used_up").cast("int")).over(
            filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
        spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)
        by_name = family.orderBy(names[-1])
        open_w = F.when(F.col("full"), 0).otherwise(F.col("weight"))
        nodes = (nodes.withColumn("open", open_w).withColumn("pool", F.col("budget") - spent)
                 .withColumn("all_open", F.sum("open").over(family))
                 .withColumn("upto", F.sum("open").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        cut = lambda w: F.expr(f"cast((pool * ({w})) div all_open as decimal(38,0))")
        parents = nodes.select(
            "root", *names, F.when(F.col("full"), F.col("cap")).otherwise(cut("upto") - cut("upto - open")).alias("budget"))
    out = leaves.join(parents.drop("root"), list(mix.levels), "left")
    return out.withColumn("budget", F.coalesce(F.col("budget"), F.lit(0)).cast("long"))


def _weight(mix: Mix, names: list[str]) -> Column:
    w = F.lit(1)
    for path, value in sorted(mix.weights.items()):
        if len(path) == len(names):
            same = F.lit(True)
            for n, v in zip(names, path):
                same = same & (F.col(n) == v)
            w = F.when(same, int(value)).otherwise(w)
    return w


def order_key(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), id_text(F.col("doc_id"))))


def plan_leaves(tokens: DataFrame, mix: Mix) -> DataFrame:
    """Leaf table: whole epochs, and where in the last epoch the prefix ends.

    ``tokens`` has (doc_id, level..., n_tokens). Adds to each leaf: tokens,
    budget, epochs (read whole), cut_key (order key of the last kept id),
    cut_left (tokens of the budget that this id still gets) and cut_tokens (tokens
    that it has).
    """
    leaf = list(mix.levels)
    leaves, _ = stage(tokens.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    budgets = leaf_budgets(leaves, mix)
    budgets = (budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
               .withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long")))
    budgets, _ = stage(budgets, "mix-budgets")
    cut = with_leaves(tokens, budgets.where(F.col("rest") > 0).select(*leaf, "epochs", "rest"), leaf)
    cut = cut.withColumn("key", order_key(mix, F.col("epochs"))).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = cut.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (slices.withColumn("upto", F.sum("n").over(upto)).withColumn("from", F.col("upto") - F.col("n"))
            .where((F.col("upto") >= F.col("rest")) & (F.col("from") < F.col("rest")))
            .select(*leaf, "slice", "from"))
    near = with_leaves(cut, ends, [*leaf, "slice"])
    runs = near.groupBy(*leaf, "key", "rest", "from").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.col("from") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    last = runs.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    last = last.select(*leaf, F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_left"),
                       F.col("n").alias("cut_tokens"))
    return budgets.join(last, leaf, "left")


def with_leaves(rows: DataFrame, leaves: DataFrame, on: list[str]) -> DataFrame:
    """Join rows to a table with one row a leaf, sent to all tasks if it is small."""
    few = leaves.count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, on)


def choose(docs: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``docs`` (all columns) with epoch, n_tokens and take_tokens, once for each epoch that keeps them."""
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    leaf = list(mix.levels)
    rows = docs.select(*own, F.col("doc_id"), *(F.col(c) for c in leaf), count_tokens(F.col("text")).alias("n_tokens"))
    rows = name_levels(rows, mix.levels)
    plan, _ = stage(plan_leaves(rows.select("doc_id", *leaf, "n_tokens"), mix), "mix-plan")
    found = with_leaves(rows, plan, leaf)
    found = found.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int"))))
    whole = F.col("epoch") < F.col("epochs")
    found = found.withColumn("key", F.when(~whole, order_key(mix, F.col("epoch"))))
    found = found.where(whole | (F.col("key") <= F.col("cut_key")))
    cut = F.expr("cast((cast(n_tokens as decimal(20,0)) * cut_left) div cut_tokens as long)")
    take = F.when(~whole & (F.col("key") == F.col("cut_key")), cut).otherwise(F.col("n_tokens"))
    return found.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)),
                        F.col("epoch").cast("int").alias("epoch"), F.col("n_tokens"), take.alias("take_tokens"))
