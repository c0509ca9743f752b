"""URL filter: listed rules first, a path-template tree for the rest.

Each host is the root of a tree of path segments. Level by level, segments that look variable
(numbers, hexadecimal ids, dates, UUIDs) become typed wildcards and children of fewer than
``min_pages`` pages become ``*``. Every other child, however small its share of the node, is
tested against the rest of its node: where a two-proportion test tells its labels apart, it
keeps its own purity (bad share, smoothed towards the node's). Children of a node are summed by
purity bin and by what mostly follows them, at most ``(bins + 4) * 7`` rows a node; neighbouring
bins merge unless their labels, or a chi-square test on what follows, tell them apart. A
template is rejected if its purity reaches a threshold. The tree descends until no node is
open: one of ``min_pages`` pages on two paths or more, with segments left.

A branch of children that were picked for their labels has each child's own prior in its purity,
so that many weak children don't become one strong verdict; a branch that holds all labels of
its node keeps the node's purity, so that depth adds no evidence. Counts are summed before every
shuffle, and no window or task holds the children of a node.

Defined results: a null url or one without ``://`` has empty host and path. Rows repeat as
given. Without any label every template is allowed. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Templates:
    """A child with fewer than ``min_pages`` pages is part of ``*``. ``chi_square`` is the 1 %
    point for one degree of freedom, ``chi_square_shapes`` for six. ``bins`` cut the range of
    purities for merging."""

    min_pages: int = 8
    bins: int = 32
    chi_square: float = 6.63
    chi_square_shapes: float = 16.81
    smoothing: float = 4.0
    reject_at: float = 0.8


SHAPES = [
    ("{uuid}", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("{date}", r"^(19|20)[0-9]{2}-?[01][0-9](-?[0-3][0-9])?$"),
    ("{n}", r"^[0-9]+$"),
    ("{hex}", r"^(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}$"),
    ("{id}", r"^(?=.*[0-9]{3}).{6,}$"),
]
KINDS = ["$", "{uuid}", "{date}", "{n}", "{hex}", "{id}", "word"]


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, or null. ``rules``: host and path prefix -> allow or block; a
    list written by hand, part of the plan."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    stem, extension = F.regexp_extract(segment, r"^(.*?)(\.[a-zA-Z]{2,5})?$", 1), F.regexp_extract(segment, r"(\.[a-zA-Z]{2,5})$", 1)
    out = segment
    for name, pattern in reversed(SHAPES):
        out = F.when(stem.rlike(pattern), F.concat(F.lit(name), extension)).otherwise(out)
    return out


def _kind(step: Column) -> Column:
    out = F.lit(len(KINDS) - 1)
    for i, name in reversed(list(enumerate(KINDS[:-1]))):
        out = F.when(step.startswith(name), F.lit(i)).otherwise(out)
    return out


def _purity(bad: Column, labelled: Column, prior: Column, cfg: Templates) -> Column:
    return (bad + cfg.smoothing * prior) / (labelled + cfg.smoothing)


def _chi_square(bad: Column, labelled: Column, other_bad: Column, other_labelled: Column) -> Column:
    """Of two shares of bad labels; 0 where a side has no label or all labels agree."""
    pooled = F.try_divide(bad + other_bad, labelled + other_labelled)
    gap = F.try_divide(bad, labelled) - F.try_divide(other_bad, other_labelled)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), other_labelled))
    tested = (labelled > 0) & (other_labelled > 0) & (pooled > 0) & (pooled < 1)
    return F.when(tested, F.try_divide(gap * gap, spread)).otherwise(F.lit(0.0))


NEXT = [f"next_{i}" for i in range(len(KINDS))]
COUNTS = ["pages", "labelled", "bad", *NEXT]


def _open(rows: Column, pages: Column, left: Column, cfg: Templates) -> Column:
    return (rows > 1) & (pages >= cfg.min_pages) & (left > 0)


def template_tree(paths: DataFrame, cfg: Templates) -> DataFrame:
    """``paths``: one row per ``host`` and ``path`` with ``pages``, ``labelled`` and ``bad``
    counts. Adds ``template`` and ``purity``."""
    steps = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _shape)
    overall = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = (overall[0] or 0) / overall[1] if overall[1] else 0.0
    rows = paths.withColumn("steps", steps)
    roots = rows.groupBy("host").agg(
        _purity(F.sum("bad"), F.sum("labelled"), F.lit(prior), cfg).alias("purity"),
        _open(F.count("*"), F.sum("pages"), F.max(F.size("steps")), cfg).alias("open"),
    )
    tree = rows.join(roots, "host").withColumn("template", F.col("host"))
    columns = ["host", "path", "pages", "labelled", "bad", "steps", "template", "purity", "open"]
    tree = stored(tree.select(columns), "url-tree")
    ended, level = [_ended(tree, 0)], 0
    while not (tree := tree.filter("open")).isEmpty():
        at = tree.withColumn("step", F.coalesce(F.get("steps", F.lit(level)), F.lit("$")))
        follows = _kind(F.coalesce(F.get("steps", F.lit(level + 1)), F.lit("$")))
        for i, name in enumerate(NEXT):
            at = at.withColumn(name, F.when(follows == i, F.col("pages")).otherwise(F.lit(0)))
        children = at.groupBy("template", "step").agg(
            F.first("purity").alias("prior"), *[F.sum(c).alias(c) for c in COUNTS],
            F.count("*").alias("rows"), F.max(F.size("steps") - level - 1).alias("left"),
        )
        branches = stored(_branches(stored(children, "url-children"), cfg), "url-branches")
        grown = at.drop("purity", "open").join(branches, ["template", "step"])
        tree = grown.withColumn("template", F.concat_ws("/", "template", "branch")).select(columns)
        tree, level = stored(tree, "url-tree"), level + 1
        ended.append(_ended(tree, level))
    return reduce(DataFrame.unionByName, ended)


def _ended(tree: DataFrame, level: int) -> DataFrame:
    rest = F.when(F.size("steps") > level, F.lit("/**")).otherwise(F.lit(""))
    name = F.concat(F.regexp_replace("template", r"/\$$", ""), rest)
    return tree.filter("not open").select("host", "path", name.alias("template"), "purity")


def _branches(children: DataFrame, cfg: Templates) -> DataFrame:
    """Per child of each node (``template``, ``step``): the ``branch`` it belongs to, that
    branch's ``purity``, and whether it is ``open``."""
    nodes = children.groupBy("template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    told = _chi_square(
        F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled")
    )
    share = _purity(F.col("bad"), F.col("labelled"), F.col("prior"), cfg)
    own = F.col("pages") >= cfg.min_pages
    # -2: too few pages; -1: no label; 0: labels as in the rest of the node.
    place = F.when(~own, F.lit(-2)).when(F.col("labelled") == 0, F.lit(-1)).when(told <= cfg.chi_square, F.lit(0))
    place = place.otherwise(1 + F.floor(share * cfg.bins).cast("int"))
    mostly = F.array_position(F.array(*NEXT), F.greatest(*NEXT)).cast("int")
    placed = children.join(nodes, "template").select(
        "*", place.alias("place"), F.when(own, mostly).otherwise(F.lit(0)).alias("mostly")
    )
    bins = placed.groupBy("template", "place", "mostly").agg(
        *[F.first(c).alias(c) for c in ("prior", "all_labelled", "all_bad")], *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("rows").alias("rows"), F.max("left").alias("left"), F.count("*").alias("n"),
        F.min("step").alias("least"), F.max("step").alias("most"),
    )
    # At most 7 * (bins + 4) rows per node from here on.
    order = Window.partitionBy("template").orderBy("mostly", "place")
    for c in ["place", *COUNTS]:
        bins = bins.withColumn(f"p_{c}", F.lag(c).over(order))
    by_label = _chi_square(F.col("bad"), F.col("labelled"), F.col("p_bad"), F.col("p_labelled"))
    one_sided = (F.col("labelled") > 0) != (F.col("p_labelled") > 0)

    def term(name: str) -> Column:
        mine, theirs = F.col(name), F.col(f"p_{name}")
        sizes = F.col("pages") + F.col("p_pages")
        expected = lambda size: (mine + theirs) * F.col(size) / sizes
        squares = F.try_divide(F.pow(mine - expected("pages"), 2), expected("pages"))
        squares += F.try_divide(F.pow(theirs - expected("p_pages"), 2), expected("p_pages"))
        return F.when(mine + theirs > 0, squares).otherwise(F.lit(0.0))

    by_shape = reduce(lambda a, b: a + b, [term(c) for c in NEXT])
    differs = (F.col("p_place") == -2) | one_sided | (by_label > cfg.chi_square) | (by_shape > cfg.chi_square_shapes)
    bins = bins.withColumn("differs", F.coalesce(differs, F.lit(False)).cast("int"))
    bins = bins.withColumn("number", F.sum("differs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    branch = Window.partitionBy("template", "number")
    total = lambda c: F.sum(c).over(branch)
    least, most, n = F.min("least").over(branch), F.max("most").over(branch), total("n")
    name = F.when(F.col("place") == -2, F.lit("*")).when(n == 1, least)
    name = name.when(n == 2, F.format_string("(%s|%s)", least, most)).otherwise(
        F.format_string("(%s|..%d..|%s)", least, n - 2, most)
    )
    # Children picked for their labels bring one prior each.
    weight = F.greatest(F.sum(F.when(F.col("place") > 0, F.col("n"))).over(branch), F.lit(1)) * cfg.smoothing
    purity = (total("bad") + weight * F.col("prior")) / (total("labelled") + weight)
    whole = (total("labelled") == F.col("all_labelled")) & (total("bad") == F.col("all_bad"))
    named = bins.select(
        "template", "place", "mostly", name.alias("branch"),
        F.when(whole, F.col("prior")).otherwise(purity).alias("purity"),
        _open(total("rows"), total("pages"), F.max("left").over(branch), cfg).alias("open"),
    )
    return placed.join(named, ["template", "place", "mostly"]).select("template", "step", "branch", "purity", "open")


def judge_urls(
    pages: DataFrame,
    rules: dict[str, str],
    cfg: Templates = Templates(),
    page_id: str = "page_id",
    url: str = "url",
    labels: DataFrame | None = None,
) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and
    ``purity`` (share of bad labels, smoothed). What the rules decide is labelled by them;
    ``labels`` (``page_id``, ``bad``) may add labels for other pages."""
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = reduce(lambda c, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(c), rules, F.lit(None).cast("string"))
    base = stored(base.withColumn("said", said), "urls")
    bad = (F.col("said") == "block").cast("int")
    seen = base
    if labels is not None:
        told = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("told"))
        seen, bad = base.join(told, "page_id", "left"), F.coalesce(bad, F.col("told"))
    paths = seen.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad")
    )
    tree = template_tree(stored(paths, "url-paths"), cfg)
    verdict = F.when(F.col("purity") >= cfg.reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return base.join(tree, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", verdict).alias("verdict"), "template", "purity"
    )
