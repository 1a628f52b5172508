"""URL filter by path-template trees.

Rules come first: a rule ``host/path`` fits its host and all subdomains where
the url's path starts with the rule's; the longest that fits decides. Every
other url gets the verdict of its path template, learned per host.

A path's segments have ids and digit runs replaced by ``#``; what follows the
first ``depth`` of them is one segment more, whole. From the root down, where a node has more than
``max_children`` children, those with less than ``min_share`` of its pages become
``*``. From the leaves up, siblings whose subtrees have the same templates and
whose shares of blocked pages do not differ (by arcsine, in steps of two
standard errors at most) become one branch; shares are of labelled pages, and a
branch without any counts with that of its siblings. A template is rejected
where its smoothed labelled purity reaches ``purity``: from the parent domains
(of two names at least) to the host, its branches and the template itself, each
level with labels has (blocked + weight * wider) / (labelled + weight), where
``wider`` is the purity one level up. The widest starts from the share of blocked
among all labelled pages, kept below ``purity``, so that share alone rejects
nothing. Labels are those that the rules give.

The tree is built on distinct (host, path shape) rows with their counts, added
up before they are dealt out, so a host with a third of all pages is no more
than its distinct shapes, and no group is collected but that of siblings after
the rare ones are ``*``: ``max_children`` or 1 + 1 / ``min_share`` at most.
Plans are short and cut, for the driver plans them anew at each of their stages;
levels above the first crowded node are not rewritten.

Rows: a null url or one without ``://`` has an empty host and path. Urls of any
length keep their whole path. Of siblings that become one branch the first in
order gives the name; a purity right at ``purity`` rejects. Null and
repeated page_ids keep their rows. Hosts have A-Z lower-cased and nothing else
changed. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaique.llm.common import cut, drop_cut

#: Standard error, in the arcsine scale, that a branch's share may have at most.
STEP = 0.5

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased, '' where there is none."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else ''."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    return F.when(at > 0, known.substr(at + 3, F.length(known))).otherwise("")


def rule_for(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of ``rules`` that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shape_of(path: Column, depth: int) -> Column:
    """The path's segments with ids and digit runs as ``#``, those after the first ``depth`` as one; none for an empty path."""
    plain = F.regexp_replace(path, "(?i)(?=[a-f-]*[0-9])[0-9a-f]{8,}(-[0-9a-f]{4,})*", "#")
    parts = F.split(F.regexp_replace(plain, "[0-9]+", "#"), "/", -1)
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))  # what stands before the first / is empty
    rest = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(1))), "/")
    return F.when(F.size(parts) > depth, F.array_append(F.slice(parts, 1, depth), rest)).otherwise(parts)


def _put(segs: Column, place: int, new: Column) -> Column:
    return F.transform(segs, lambda x, i: F.when(i == place, new).otherwise(x))


def _step(nodes: DataFrame, old: DataFrame) -> DataFrame:
    new = cut(nodes)
    drop_cut(old)
    return new


def _crowded(shapes: DataFrame, max_children: int) -> int | None:
    """The first level at which a node has more than ``max_children`` children, or None."""
    at = shapes.select("host", "segs", F.posexplode("segs").alias("level", "seg"))
    node = ["host", "level", F.slice("segs", F.lit(1), F.col("level")).alias("parent")]
    children = at.select(*node, "seg").distinct()
    kinds = children.groupBy("host", "level", "parent").agg(F.count("*").alias("kinds"))
    return kinds.where(F.col("kinds") > max_children).agg(F.min("level")).first()[0]


def _generalised(shapes: DataFrame, max_children: int, min_share: float, deepest: int) -> DataFrame:
    """``segs`` of (host, shape, segs, n, ..), a :func:`cut`, with the rare of many siblings as ``*``, level by level."""
    now, least = shapes, _crowded(shapes, max_children)
    # a name put for others makes siblings of what lies below them, never of what lies above
    for d in range(deepest if least is None else least, deepest):
        here = now.where(F.size("segs") > d)
        node = [F.col("host"), F.slice("segs", 1, d).alias("parent")]
        children = here.groupBy(*node, F.col("segs")[d].alias("seg")).agg(F.sum("n").alias("own"))
        crowded = (
            children.groupBy("host", "parent")
            .agg(F.count("*").alias("kinds"), F.sum("own").alias("all_of"))
            .where(F.col("kinds") > max_children)
        )
        rare = (
            children.join(crowded, ["host", "parent"])
            .where(F.col("own") < F.lit(min_share) * F.col("all_of"))
            .select("host", "parent", "seg", F.lit(True).alias("rare"))
        )
        told = now.withColumns({"parent": F.slice("segs", 1, d), "seg": F.get("segs", F.lit(d))})
        segs = F.when(F.col("rare"), _put(F.col("segs"), d, F.lit("*"))).otherwise(F.col("segs"))
        now = _step(told.join(rare, ["host", "parent", "seg"], "left").withColumn("segs", segs).select(*now.columns), now)
    return now


def _merged(shapes: DataFrame, deepest: int) -> DataFrame:
    """``segs`` of a :func:`cut` with like siblings under one name, from the leaves up."""
    now = shapes
    for d in range(deepest - 1, -1, -1):
        here = now.where(F.size("segs") > d)
        suffix = F.slice("segs", d + 2, deepest)
        node = [F.col("host"), F.slice("segs", 1, d).alias("parent"), F.col("segs")[d].alias("seg")]
        # a sum over distinct templates does not depend on how many shapes lead to each
        forms = here.groupBy(*node, suffix.alias("suffix")).agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
        )
        like = forms.groupBy("host", "parent", "seg").agg(
            F.sum(F.xxhash64("suffix").cast("decimal(20,0)")).alias("form"),
            F.sum("n").alias("n"),
            F.sum("labelled").alias("labelled"),
            F.sum("blocked").alias("blocked"),
        )
        siblings = Window.partitionBy("host", "parent")
        usual = F.sum("blocked").over(siblings) / F.nullif(F.sum("labelled").over(siblings), F.lit(0))
        share = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).otherwise(F.coalesce("usual", F.lit(0.0)))
        # arcsine makes a share's standard error 1 / (2 sqrt n), whatever the share
        width = F.round(F.least(F.lit(STEP), F.greatest(F.lit(0.05), 1 / F.sqrt("n"))), 2)
        like = like.withColumn("usual", usual).withColumn("rate", F.round(F.asin(F.sqrt(share)) / width) * width)
        group = Window.partitionBy("host", "parent", "form", "rate")
        names = (
            like.select("host", "parent", "seg", F.min("seg").over(group).alias("first"), F.count("*").over(group).alias("k"))
            .where("k > 1")
            .select("host", "parent", "seg", F.concat(F.lit("("), "first", F.lit("|+"), F.col("k") - 1, F.lit(")")).alias("name"))
        )
        told = now.withColumns({"parent": F.slice("segs", 1, d), "seg": F.get("segs", F.lit(d))})
        segs = F.when(F.col("name").isNotNull(), _put(F.col("segs"), d, F.col("name"))).otherwise(F.col("segs"))
        now = _step(told.join(names, ["host", "parent", "seg"], "left").withColumn("segs", segs).select(*now.columns), now)
    return now


def _domains(host: Column) -> Column:
    """The host and its parent domains of two names at least, the widest first; an address has no parents."""
    names = F.split(host, "[.]", -1)
    wider = F.transform(F.sequence(F.lit(2), F.size(names)), lambda k: F.array_join(F.slice(names, -k, k), "."))
    return F.when((F.size(names) > 2) & ~host.rlike("^[0-9.]+$|[:\\]]"), wider).otherwise(F.array(host))


def _backed_off(nodes: DataFrame, keys: list[str], levels: Column, start: Column, weight: float) -> DataFrame:
    """``nodes`` (keys, labelled, blocked, start) as (keys, pure): ``start`` smoothed through the counts of each of ``levels``.

    ``levels`` are the node's ancestors and itself, the widest first; counts of a level are those of all nodes under it.
    """
    at = nodes.select(*keys, start.alias("start"), "labelled", "blocked", F.posexplode_outer(levels).alias("depth", "level"))
    within = [k for k in keys if k == "host" and len(keys) > 1]  # branches are the host's own
    sums = at.groupBy(*within, "level").agg(F.sum("labelled").alias("told"), F.sum("blocked").alias("bad"))
    chain = (
        at.join(sums, [*within, "level"], "left")
        .groupBy(*keys)
        .agg(F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("depth", "told", "bad"))).alias("chain"))
    )
    fold = F.aggregate(
        "chain", F.col("start"), lambda p, x: F.when(x["told"] > 0, (x["bad"] + weight * p) / (x["told"] + weight)).otherwise(p)
    )
    return chain.select(*keys, fold.alias("pure"))


def templates(
    pages: DataFrame, max_children: int = 16, min_share: float = 0.02, weight: float = 4.0, purity: float = 0.5, depth: int = 8
) -> DataFrame:
    """(host, shape, template, purity) of ``pages`` (host, path, label: 1 blocked, 0 allowed, null)."""
    now = cut(
        pages.groupBy("host", shape_of(F.col("path"), depth).alias("shape"))
        .agg(
            F.count("*").alias("n"),
            F.count("label").alias("labelled"),
            F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"),
        )
        .withColumn("segs", F.col("shape"))
    )
    deepest, labelled, blocked = now.agg(F.max(F.size("segs")), F.sum("labelled"), F.sum("blocked")).first()
    now = _merged(_generalised(now, max_children, min_share, deepest or 0), deepest or 0)
    prior = min((blocked or 0) / max(1, labelled or 0), math.nextafter(purity, 0))
    counts = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    hosts = cut(_backed_off(now.groupBy("host").agg(*counts), ["host"], _domains(F.col("host")), F.lit(prior), weight))
    own = now.groupBy("host", "segs").agg(*counts).join(hosts, "host")
    branches = F.transform(F.sequence(F.lit(1), F.size("segs")), lambda k: F.slice("segs", F.lit(1), k))
    branches = F.when(F.size("segs") > 0, branches)
    pure = _backed_off(own, ["host", "segs"], branches, F.col("pure"), weight)
    template = F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template")
    out = cut(now.join(pure, ["host", "segs"]).select("host", "shape", template, F.col("pure").alias("purity")))
    drop_cut(now)
    drop_cut(hosts)
    return out


def judge(
    pages: DataFrame, rules: dict[str, str], purity: float = 0.5, max_children: int = 16, min_share: float = 0.02, depth: int = 8
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    ``rules`` maps ``host/path`` to ``block`` or ``allow``; template and purity
    are null where a rule decides.
    """
    told = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else None
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), list(rules)))
    ruled = told[F.col("rule")] if told is not None else F.lit(None).cast("string")
    rows = rows.withColumn("ruled", ruled)
    learned = templates(
        rows.select("host", "path", (F.col("ruled") == BLOCK).cast("int").alias("label")), max_children, min_share, purity=purity, depth=depth
    ).withColumnsRenamed({"host": "_host", "shape": "_shape"})
    nothing = F.lit(None)
    first = rows.where(F.col("rule").isNotNull()).select(
        "page_id", "host", "path", "rule", F.col("ruled").alias("verdict"),
        nothing.cast("string").alias("template"), nothing.cast("double").alias("purity"),
    )
    others = rows.where(F.col("rule").isNull()).withColumn("shape", shape_of(F.col("path"), depth))
    same = (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape"))
    rest = others.join(learned, same).select(
        "page_id", "host", "path", "rule",
        F.when(F.col("purity") >= purity, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"),
        "template", "purity",
    )
    return first.unionByName(rest)
