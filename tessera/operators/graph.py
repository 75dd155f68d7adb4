"""Page trees and link graphs: order, paths, label pruning, navigation, related pages, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.texts import resolved_path, slug
from tessera.operators.ranks import beside, placed, saved


def cycle_heads(nodes: DataFrame) -> DataFrame:
    """(id): the least node of each cycle among (id, up); nodes below a cycle are not on it.

    Every node learns the node 1, 2, 4, 8, ... steps up and the least one on the way; who still has one above after
    more steps than there are nodes stands below a cycle, and where it has got to is on it. Nothing but these
    pairs is joined, in a number of rounds that is the logarithm of the depth (of the nodes, where there is a cycle).
    """
    jump = saved(nodes.select("id", "up", F.col("id").alias("least")))
    total, steps = jump.count(), 1
    while steps <= total and not jump.filter("up is not null").isEmpty():
        on = jump.select(F.col("id").alias("up"), F.col("up").alias("then"), F.col("least").alias("other"))
        jump = saved(jump.join(on, "up", "left").select("id", F.col("then").alias("up"), F.least("least", "other").alias("least")))
        steps *= 2
    on_cycle = jump.filter("up is not null").select(F.col("up").alias("id")).distinct()
    return saved(jump.join(on_cycle, "id", "left_semi").filter("id = least").select("id"))


def expand_levels(nodes: DataFrame, cycles: bool = True) -> DataFrame:
    """(id, root, depth, path): each node's chain from its root, however deep.

    A node without a parent, or whose parent is not among the nodes, is a root. A cycle has no beginning: it is
    cut above its least node, which becomes a root, so every node has its row (without ``cycles`` what is on or
    below one is left out). Chains double with each round, so a
    tree of a thousand levels takes about ten; each round is checkpointed, so plans do not grow.
    """
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    linked = saved(nodes.select("id", F.col("parent_id").alias("up")).join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up")))
    heads = cycle_heads(linked).select("id", F.lit(True).alias("head"))
    level = saved(linked.join(heads, "id", "left").select("id", F.when(F.col("head").isNull(), F.col("up")).alias("up"), F.array("id").alias("path")))
    while not level.filter("up is not null").isEmpty():
        above = level.select(F.col("id").alias("up"), F.col("up").alias("then"), F.col("path").alias("head_path"))
        level = saved(
            level.join(above, "up", "left").select("id", F.col("then").alias("up"), F.when(F.col("head_path").isNotNull(), F.concat("head_path", "path")).otherwise(F.col("path")).alias("path"))
        )
    chains = level.select("id", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path")
    return chains if cycles else chains.join(heads.select(F.col("id").alias("root")), "root", "left_anti").select("id", "root", "depth", "path")


def pre_order(tree: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, depth, place): depth-first order where children follow position, then title, then id."""
    steps = tree.select("id", "depth", F.posexplode("path").alias("at", "node")).join(titles.select(F.col("id").alias("node"), "position", "title"), "node")
    key = F.concat(F.lpad(F.coalesce(F.col("position").cast("string"), F.lit("~")), 12, "0"), F.lit("\u0001"), "title", F.lit("\u0001"), F.lpad(F.col("node").cast("string"), 20, "0"))
    keys = steps.groupBy("id", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", key.alias("k")))), lambda x: x["k"]), "\u0002").alias("key"))
    return placed(keys, "key").drop("key")


def neighbours(order: DataFrame) -> DataFrame:
    return beside(order, "place", "id")


def prune_by_label(pages: DataFrame, labels: DataFrame, excluded: str, root: object = None) -> DataFrame:
    """Pages without the excluded label and without an ancestor that has it; the root is immune."""
    hit = labels.filter(F.col("label") == excluded).select(F.col("page_id").alias("hit"))
    if root is not None:
        hit = hit.filter(F.col("hit") != root)
    chain = pages.select("page_id", F.explode(F.array_append("ancestors", F.col("page_id"))).alias("hit"))
    return pages.join(chain.join(hit, "hit").select("page_id").distinct(), "page_id", "left_anti")


def reparent_by_label(pages: DataFrame, labels: DataFrame, excluded: str) -> DataFrame:
    """Pages without the label, under their nearest ancestor that stays; ``ancestors`` runs from the parent upwards."""
    keep = pages.join(labels.filter(F.col("label") == excluded).select("page_id"), "page_id", "left_anti")
    steps = keep.select("page_id", F.posexplode("ancestors").alias("at", "ancestor"))
    alive = steps.join(keep.select(F.col("page_id").alias("ancestor")), "ancestor", "left_semi")
    nearest = alive.groupBy("page_id").agg(F.min_by("ancestor", "at").alias("new_parent"), F.count(F.lit(1)).alias("effective_depth"))
    return keep.select("page_id").join(nearest, "page_id", "left").withColumn("effective_depth", F.coalesce("effective_depth", F.lit(0)))


def ancestor_titles(pages: DataFrame) -> DataFrame:
    steps = pages.select("page_id", F.posexplode("ancestors").alias("at", "ancestor")).join(pages.select(F.col("page_id").alias("ancestor"), "title"), "ancestor")
    named = steps.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]).alias("titles"))
    return pages.select("page_id").join(named, "page_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def unique_slugs(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """A slug for each name; the second of equal slugs ends in -2, the third in -3."""
    s = slug(F.col(name))
    n = F.row_number().over(Window.partitionBy(s).orderBy(key))
    return names.select(key, F.when(n == 1, s).otherwise(F.concat(s, F.lit("-"), n.cast("string"))).alias("slug"))


def related_pages(pages: DataFrame, links: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """(page_id, related, score, rank): 100 for a link to a page, 75 for one from it, 20 for any shared label, 10 for
    the same parent (two pages without one also have the same), 5 for the same root; ties by title, then id.

    Pages of a label, a parent or a root never all meet. Whoever owes its score to what a group shares is behind
    every member of the group with a lesser title; so the first ``top`` others of each group (label, parent, root,
    label and parent, label and root) and the linked pages are all that can be among the best, and only these
    are scored.
    """
    root = F.coalesce(F.try_element_at("ancestors", F.lit(-1)), F.col("page_id"))
    placed_pages = pages.select(F.col("page_id").alias("id"), "title", "parent_id", root.alias("root"))
    tagged = labels.select(F.col("page_id").alias("id"), "label").distinct()
    at = placed_pages.join(tagged, "id", "left")
    keys = (("label",), ("parent_id",), ("root",), ("label", "parent_id"), ("label", "root"))
    members = at.select(
        "id", "title",
        F.explode(F.array(*(F.when(F.col("label").isNotNull() if "label" in k else F.lit(True), F.concat_ws("\u0001", F.lit(str(n)), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in k))) for n, k in enumerate(keys)))).alias("key"),
    ).filter("key is not null").distinct()
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("title", "id"))).filter(F.col("n") <= top + 1)
    near = members.select(F.col("id").alias("a"), "key").join(first.select(F.col("id").alias("b"), "key"), "key").select("a", "b")
    out = links.filter("target_page_id is not null").select(F.col("source_page_id").alias("a"), F.col("target_page_id").alias("b")).distinct()
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b"))
    linked = out.withColumn("s", F.lit(100)).unionByName(back.withColumn("s", F.lit(75))).unionByName(near.withColumn("s", F.lit(0)))
    pairs = linked.filter("a <> b").distinct().groupBy("a", "b").agg(F.sum("s").alias("s"))
    known = placed_pages.join(tagged.groupBy("id").agg(F.collect_set("label").alias("labels")), "id", "left")
    side = lambda x: known.select(*(F.col(c).alias(c if c == x else f"{x}_{c}") if c != "id" else F.col("id").alias(x) for c in known.columns))
    score = (
        F.col("s") + F.when(F.arrays_overlap("a_labels", "b_labels"), 20).otherwise(0)
        + F.when(F.col("a_parent_id").eqNullSafe(F.col("b_parent_id")), 10).otherwise(0) + F.when(F.col("a_root") == F.col("b_root"), 5).otherwise(0)
    )
    scored = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("score", score).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b_title", "b"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.col("a").alias("page_id"), F.col("b").alias("related"), "score", "rank")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Relative links with the page that they lead to, and whether there is none."""
    at = links.withColumn("resolved", resolved_path(F.col("source_path"), F.col("target")))
    known = pages.select(F.col("path").alias("resolved"), F.col("page_id").alias("target_id"))
    return at.join(known, "resolved", "left").withColumn("broken", F.col("target_id").isNull())


def dangling(references: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return references.join(known.select(on).distinct(), on, "left_anti")


def exact_or_folded(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(want, file): the file of that name, else the first of that name in other letters' case."""
    exact = wanted.join(files.select(F.col("file").alias("want")).distinct(), "want").select("want", F.col("want").alias("file"))
    rest = wanted.join(exact.select("want"), "want", "left_anti")
    folded = rest.join(files.select("file", F.lower("file").alias("f")), F.lower("want") == F.col("f")).groupBy("want").agg(F.min("file").alias("file"))
    return exact.unionByName(folded)


def empty_folders(pages: DataFrame) -> DataFrame:
    folders = pages.filter("content_type = 'folder'")
    return folders.join(pages.select(F.col("parent_id").alias("page_id")).filter("page_id is not null").distinct(), "page_id", "left_anti")


def first_priority(rows: DataFrame, key: str, level: str) -> DataFrame:
    """The row of the lowest level of each key, and what each shadowed row is overridden by."""
    w = Window.partitionBy(key).orderBy(level)
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("overridden_by", F.first(level).over(w))
    return ranked.withColumn("shadowed", F.col("_n") > 1).withColumn("overridden_by", F.when(F.col("_n") > 1, F.col("overridden_by"))).drop("_n")
