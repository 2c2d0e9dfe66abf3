"""URL filter: explicit rules, and per-host path templates rejected by labelled purity.

Every url becomes its host and the segments of its path. Segments that look like numbers,
hexadecimal or mixed identifiers become wildcards at once. Then the template tree is worked
out level by level: at each node (host and template prefix) a child whose urls are distributed
over the outcomes (label 1, label 0, no label) and over ending here like those of its
siblings together, by a Hoeffding bound, is merged with them into a wildcard; others stay. A
template is rejected if the smoothed share of label 1 among its labelled urls reaches
``purity`` and at least the share ``support`` of its urls is labelled.

Nothing is gathered: a level is two aggregations over the distinct paths left, and one join
of children with the totals of their node, which adaptive execution splits for hot hosts.

Cases: a null url, and one without ``://``, has empty host and path and no rule. Without a
labelled url no template is rejected. Paths deeper than ``max_depth`` keep their rest as one
segment. Repeated rows each count and are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.session import write_and_read

# Rule: verdict, host, path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits; null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(longest_first):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("name"),
                                    F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments_of(path: Column, max_depth: int) -> Column:
    """Segments with identifiers as wildcards; what lies below ``max_depth`` is one segment."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    rest = F.array_join(F.slice(parts, max_depth, 1 << 20), "/")
    parts = F.when(F.size(parts) > max_depth,
                   F.concat(F.slice(parts, 1, max_depth - 1), F.array(rest))).otherwise(parts)

    def shape(s: Column) -> Column:
        return (F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.lit("{number}"))
                .when(s.rlike(r"^[0-9A-Fa-f-]{8,}(\.[A-Za-z]+)?$"), F.lit("{hex}"))
                .when(s.rlike(r"[0-9]"), F.lit("{mixed}")).otherwise(s))

    return F.transform(parts, shape)


def _close(k_a: Column, n_a: Column, k_b: Column, n_b: Column, alpha: float) -> Column:
    """Two shares are not told apart at level ``alpha`` by Hoeffding's inequality."""
    width = F.sqrt(F.lit(0.5) * F.log(F.lit(2.0 / alpha)))
    return F.abs(k_a / n_a - k_b / n_b) < width * (1 / F.sqrt(n_a) + 1 / F.sqrt(n_b))


def templates(urls: DataFrame, max_depth: int = 8, alpha: float = 0.05, purity: float = 0.8,
              support: float = 0.5, smooth: float = 0.5) -> DataFrame:
    """(host, segments, template, n, purity, rejected) for each distinct generalised path of
    ``urls`` (host, segments, label); label is 1, 0 or null."""
    one = F.when(F.col("label") == 1, 1).otherwise(0)
    zero = F.when(F.col("label") == 0, 1).otherwise(0)
    tree = urls.groupBy("host", "segments").agg(
        F.sum(one).alias("bad"), F.sum(zero).alias("good"), F.count(F.lit(1)).alias("n"))
    tree = write_and_read(tree.withColumn("template", F.col("segments")), "url-tree")
    depth = tree.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    for level in range(depth):
        tree = write_and_read(_merge_level(tree, level, alpha), "url-tree")
    totals = tree.groupBy("host", "template").agg(
        F.sum("bad").alias("b"), F.sum("good").alias("g"), F.sum("n").alias("all"))
    share = (F.col("b") + smooth) / (F.col("b") + F.col("g") + 2 * smooth)
    judged = totals.select("host", "template", F.col("all").alias("n"), share.alias("purity"),
                           ((share >= purity) & (F.col("b") + F.col("g") >= support * F.col("all"))
                            ).alias("rejected"))
    return tree.select("host", "segments", "template").join(judged, ["host", "template"])


def _merge_level(tree: DataFrame, level: int, alpha: float) -> DataFrame:
    """Replace the segment at ``level`` by ``*`` where its branch looks like its siblings."""
    here = F.size("template") > level
    child = F.when(here, F.get("template", F.lit(level)))
    ends = F.when(F.size("template") == level + 1, F.col("n")).otherwise(0)
    keyed = tree.withColumns({"prefix": F.slice("template", 1, level), "child": child,
                              "ends": ends})
    sums = [F.sum(c).cast("double").alias(c) for c in ("bad", "good", "n", "ends")]
    own = keyed.filter(here).groupBy("host", "prefix", "child").agg(*sums)
    total = own.groupBy("host", "prefix").agg(
        *[F.sum(c).alias("all_" + c) for c in ("bad", "good", "n", "ends")],
        F.count(F.lit(1)).alias("children"))
    both = own.join(total, ["host", "prefix"]).filter("children > 1")
    alike = F.lit(True)
    for c in ("bad", "good", "ends"):
        alike = alike & _close(F.col(c), F.col("n"), F.col("all_" + c) - F.col(c),
                               F.col("all_n") - F.col("n"), alpha)
    merged = both.filter(alike).select("host", "prefix", "child", F.lit(True).alias("merged"))
    out = keyed.join(merged, ["host", "prefix", "child"], "left")
    new = F.when(F.col("merged"), F.concat(F.slice("template", 1, level), F.array(F.lit("*")),
                                           F.slice("template", level + 2, 1 << 20))
                 ).otherwise(F.col("template"))
    return out.select("host", "segments", "bad", "good", "n", new.alias("template"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          max_depth: int = 8, alpha: float = 0.05, purity: float = 0.8,
          support: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) per row. Urls that a rule decides are
    the labelled ones: label 1 for block. The verdict is the rule's, else the template's."""
    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                       path_of(F.col(url_col)).alias("path"))
    own = own.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    own = own.withColumn("segments", segments_of(F.col("path"), max_depth)).withColumn(
        "label", F.when(F.col("hit").isNotNull(),
                        (F.col("hit.verdict") == "block").cast("int")))
    known = templates(own.select("host", "segments", "label"), max_depth, alpha, purity,
                      support)
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return own.join(known, ["host", "segments"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.name").alias("rule"),
        F.coalesce(F.col("hit.verdict"), method).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
