"""URL filters: rules of hosts and paths, and a tree of path templates for what no rule decides.

For each host, path segments that vary (numbers, identifiers, or a position with very many values, counted exactly) become wildcards. Then the labelled branches below
a node are compared with each other: in the order of their rates, neighbours that a two-proportion z test can't tell apart are merged, and a significant step starts a new
branch; branches without labels stay as they are. A template is rejected where its labelled purity, smoothed
level by level from the corpus over other hosts' branches of the same place and its own parents, reaches MIN_PURITY. Labels are the verdicts of the rules; `assess`
hides some of them and tells how the tree decides those pages. All levels are handled at once, whatever the depth of the data. Only built-in functions run on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import discard, join_split, lower_ascii, written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_PURITY = 0.8
PRIOR_WEIGHT = 4.0
MANY_VALUES, DISTINCT_SHARE = 16, 0.5
SIMILAR_Z = 1.96
#: Rates of hosts are summed as whole numbers of this part, so that sums don't depend on their order.
RATE_UNIT = 1_000_000
#: `assess` hides the labels of one unit in HIDE.
HIDE = 5


def host(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at > 0, F.lit(False)), lower_ascii(F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0))).otherwise("")


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at > 0, F.lit(False)), F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (size, rule, verdict), or null. A longer path decides between hosts of one length, then the text."""
    table = F.array(*(F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules))
    fits = F.filter(table, lambda r: ((host == r.h) | F.endswith(host, F.concat(F.lit("."), r.h))) & F.startswith(path, r.p))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r.rule.alias("rule"), r.verdict.alias("verdict"))))


def shape(path: Column) -> Column:
    """All segments of a path, numbers and identifiers generalised, joined by slashes; empty for a path without segments."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    wild = F.transform(parts, lambda x: F.when(x.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{id}")).otherwise(F.regexp_replace(x, "[0-9]+", "{n}")))
    return F.array_join(wild, "/")


def _node(k: Column, t: str = "t") -> Column:
    """The node of the first k levels of template t; segments hold no slash. A digest, since a path of n segments has n nodes."""
    return F.md5(F.array_join(F.slice(t, F.lit(1), k), "/"))


def _nodes(trees: DataFrame, *more: str) -> DataFrame:
    """One row for each level k of each template: up, the node above it, and value, its branch there."""
    return trees.select("host", *more, "t", F.posexplode("t").alias("k", "value")).withColumn("up", _node(F.col("k"))).drop("t")


def wildcards(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with t, their levels, a star at each position that varies too much.

    A position is that of all branches below one node. It varies if it has MANY_VALUES values or more and these are DISTINCT_SHARE of its pages or more. All positions are judged
    at once; stars bring nodes together, so positions are judged again until none is new.
    """
    tree = written(shapes.withColumn("t", F.filter(F.split("shape", "/"), lambda x: x != "")), "url-tree")
    while True:
        branches = _nodes(tree, "n").groupBy("host", "k", "up", "value").agg(F.sum("n").alias("n"))
        wide = branches.groupBy("host", "k", "up").agg(F.count("*").alias("values"), F.sum("n").alias("pages"))
        wide = written(wide.where((F.col("values") >= MANY_VALUES) & (F.col("values") >= DISTINCT_SHARE * F.col("pages"))).select("host", "k", "up"), "url-wide")
        if wide.limit(1).count() == 0:
            discard(wide)
            return tree
        starred = join_split(_nodes(tree, "shape"), wide, ["host", "k", "up"]).groupBy("host", "shape").agg(F.collect_set("k").alias("stars"))
        next_ = join_split(tree, starred, ["host", "shape"], "left")
        level = F.transform("t", lambda x, i: F.when(F.array_contains("stars", i), "*").otherwise(x))
        next_ = written(next_.withColumn("t", F.when(F.col("stars").isNull(), F.col("t")).otherwise(level)).drop("stars"), "url-tree")
        discard(tree, wide)
        tree = next_


def merged(trees: DataFrame) -> DataFrame:
    """(host, t, m): each template t of trees (host, t, labelled, bad) and m, its levels after branches alike were merged; a merged branch is told as {first value+number of others}.

    Branches of equal counts are one before any window, so a node of very many branches sends few rows to one task.
    """
    branches = written(_nodes(trees, "labelled", "bad").groupBy("host", "k", "up", "value").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).where("l > 0"), "url-branches")
    node = ["host", "k", "up"]
    counts = branches.groupBy(*node, "l", "b").agg(F.min("value").alias("least"), F.count("*").alias("values"))
    w = Window.partitionBy(*node).orderBy(F.col("b") / F.col("l"), "l")
    l, b, l0, b0 = F.col("l"), F.col("b"), F.lag("l").over(w), F.lag("b").over(w)  # noqa: E741
    rate = (b + b0) / (l + l0)
    gap = F.abs(b / l - b0 / l0) / F.sqrt(F.nullif(rate * (1 - rate), F.lit(0.0)) * (1 / l + 1 / l0))
    counts = counts.withColumn("new", F.coalesce(gap >= SIMILAR_Z, F.lit(False)).cast("int")).withColumn("part", F.sum("new").over(w))
    whole = Window.partitionBy(*node, "part")
    several = F.sum("values").over(whole)
    name = F.when(several > 1, F.concat(F.lit("{"), F.min("least").over(whole), F.lit("+"), (several - 1).cast("string"), F.lit("}")))
    counts = counts.select(*node, "l", "b", name.alias("name")).where("name IS NOT NULL")
    named = join_split(branches, counts, [*node, "l", "b"]).select(*node, "value", "name")
    levels = join_split(_nodes(trees.withColumn("of", F.col("t")), "of"), named, [*node, "value"])
    levels = levels.groupBy("host", F.col("of").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("k", "name"))).alias("names"))
    out = join_split(trees.select("host", "t"), levels, ["host", "t"], "left")
    return out.select("host", "t", F.when(F.col("names").isNull(), F.col("t")).otherwise(F.transform("t", lambda x, i: F.coalesce(F.try_element_at("names", i), x))).alias("m"))


def purities(trees: DataFrame) -> DataFrame:
    """(host, m, purity) of each template of trees (host, t, m, labelled, bad): from the corpus's rate down the levels to the pages that end there.

    At each level the rate so far is first smoothed by other hosts: each host with labels at the same place (the levels before merging) counts as one label of its
    own rate, so a host with very many pages speaks as one. Then the host's own labels are smoothed towards that. A place without labels anywhere keeps the rate above.
    """
    whole = trees.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    steps = trees.select("*", F.explode(F.sequence(F.lit(0), F.size("t") + 1)).alias("k")).withColumn("ends", F.col("k") > F.size("t"))
    level = F.least("k", F.size("t"))
    steps = written(steps.select("host", "m", "k", "ends", "labelled", "bad", _node(level, "m").alias("up"), _node(level).alias("place")), "url-steps")
    keys, places = ["host", "k", "up", "ends"], ["k", "place", "ends"]
    rates = steps.groupBy("host", *places).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).where("l > 0")
    rates = rates.groupBy(*places).agg(F.count("*").alias("n"), F.sum(F.round(RATE_UNIT * F.col("b") / F.col("l")).cast("long")).alias("r"))
    members = steps.groupBy(*keys, "place").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    members = join_split(written(members, "url-members"), written(rates, "url-rates"), places, "left")
    sums = members.groupBy(*keys).agg(F.sum("labelled").alias("sl"), F.sum("bad").alias("sb"), F.coalesce(F.sum("n"), F.lit(0)).alias("gl"), (F.coalesce(F.sum("r"), F.lit(0)) / RATE_UNIT).alias("gb"))
    steps = join_split(written(steps.select("m", *keys).distinct(), "url-levels"), sums, keys).groupBy("host", "m").agg(F.array_sort(F.collect_list(F.struct("k", "sl", "sb", "gl", "gb"))).alias("steps"))
    start = F.lit((whole["b"] or 0) / max(1, whole["l"] or 0)).cast("double")

    def smoothed(p: Column, x: Column) -> Column:
        others = (x.gb + PRIOR_WEIGHT * p) / (x.gl + PRIOR_WEIGHT)
        return (x.sb + PRIOR_WEIGHT * others) / (x.sl + PRIOR_WEIGHT)

    return steps.select("host", "m", F.aggregate("steps", start, smoothed).alias("purity"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, t, purity): for each shape (host, shape, n, labelled, bad) its template, an array of levels, and the template's smoothed purity. The tree is as deep as the deepest shape."""
    tree = wildcards(shapes)
    trees = written(tree.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-trees")
    names = written(merged(trees), "url-merged")
    paths = written(join_split(trees, names, ["host", "t"]), "url-paths")
    pure = join_split(names, written(purities(paths), "url-pure"), ["host", "m"])
    return join_split(tree.select("host", "shape", "t"), pure, ["host", "t"]).select("host", "shape", F.col("m").alias("t"), "purity")


def _judged(pages: DataFrame, id_col: str, url_col: str, rules, min_purity: float, shown: Column) -> DataFrame:
    """(page_id, host, path, r, shown, tree, template, purity): r is the rule that fits, shown whether it was a label, tree the verdict of the template."""
    pages = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    pages = pages.select("*", rule(F.col("host"), F.col("path"), rules).alias("r"), shape(F.col("path")).alias("shape")).withColumn("shown", shown)
    keys = ["host", "shape"]
    label = F.when(F.col("shown"), F.col("r"))
    shapes = pages.groupBy(*keys).agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(label.verdict == "block").alias("bad"))
    known = templates(written(shapes, "url-shapes"))
    known = written(known.select(*keys, F.concat_ws("/", F.col("host"), F.col("t")).alias("template"), "purity"), "url-known")
    tree = F.when(F.col("purity") >= min_purity, "block").otherwise("allow")
    return join_split(pages, known, keys, "left").withColumn("tree", tree).drop("shape")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_purity: float = MIN_PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    A url that is null or has no "://" has an empty host and path, which no rule fits; such pages share one template. Repeated rows stay, an empty table gives an empty result. Pages are summed to their shapes before
    any shuffle, so a host that holds most pages is no larger than its number of shapes, and pages of a hot shape join in parts. The list of rules is a parameter of bounded size.
    """
    out = _judged(pages, id_col, url_col, rules, min_purity, F.lit(True))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "tree").alias("verdict"), "template", "purity")


def assess(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_purity: float = MIN_PURITY, unit: tuple[str, ...] = ("host",)) -> DataFrame:
    """One row (held_out, blocked, right, bad, no_rule, no_rule_blocked): how the tree decides pages whose rules it was not shown.

    The rules of one unit (host, or host and shape) in HIDE, chosen by hash, are no labels. held_out counts their pages, bad those that their rules block, blocked those that the tree blocks,
    right those of both. no_rule and no_rule_blocked count the pages that no rule fits, judged by the same tree. An empty table gives zeros.
    """
    out = _judged(pages, id_col, url_col, rules, min_purity, F.pmod(F.xxhash64(*unit), F.lit(HIDE)) != 0)
    held, free = F.col("r").isNotNull() & ~F.col("shown"), F.col("r").isNull()
    bad, blocked = F.coalesce(F.col("r.verdict") == "block", F.lit(False)), F.col("tree") == "block"
    counts = {"held_out": held, "blocked": held & blocked, "right": held & blocked & bad, "bad": held & bad, "no_rule": free, "no_rule_blocked": free & blocked}
    return out.agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
