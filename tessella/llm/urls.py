"""URL filters: rules, and a path-template tree for what no rule decides.

DataFrame operations only.  The paths of each host form a tree of segments.  Going
down level by level, as deep as paths go, the segments below a node are generalised into
a wildcard (which keeps a file extension) where they vary: many children with few rows
each.  A child that has a fair share of the node's rows stays literal.

Then siblings are merged, from the root down: below each node, the branches whose
distributions of template suffixes don't differ significantly from that of all siblings
together (a chi-square test), and whose labelled block rates don't either (a test of
proportions, for branches with labels), become one branch.  A template is
rejected when its purity, the share of labelled rows of its merged template that are blocked,
smoothed towards the share among the labelled rows of its host, and that towards
the share among all labelled rows, is high enough, and labels cover enough of the merged
template.  Rows that a rule decides are the labels.

Rows below a node that has too few rows to vary are settled at once, and from
`PLAIN_LEVELS` on what all rows of a node have in common is passed over, so deep paths
cost one pass for each level where they part, not for each segment.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is
judged like the rest.  Repeated rows are judged alike and count as often as they
occur; an empty table gives an empty result; columns of clashing names are dropped
except for the id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import ascii_lower, durable


#: From this level on, what all rows of a node have in common is passed over at once.
PLAIN_LEVELS = 4


@dataclass(frozen=True)
class Rule:
    """`verdict` (allow or block) for a host, its subdomains, and paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines such as ``block com/en/``, the longest first."""
    found = []
    for line in lines:
        verdict, where = line.split()
        host, slash, path = where.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict in rule {line!r}")
        found.append(Rule(verdict, host.lower(), slash + path))
    return sorted(found, key=lambda r: (-len(r.text), r.text, r.verdict))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _wildcard(segment: Column) -> Column:
    """The wildcard of a segment; a short extension of letters stays."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1))


def templates(rows: DataFrame, *, min_children: int = 8, rows_per_child: float = 4.0, literal_share: float = 0.05, literal_rows: int = 20) -> DataFrame:
    """Add a `template` column, an array of segments, to rows of (host, path, ...).

    A node's children vary if there are at least `min_children` of them with less
    than `rows_per_child` rows each on average; then only children with
    `literal_share` of the node's rows and `literal_rows` rows stay literal.
    """
    parts = F.split(F.col("path"), "/")
    nothing = F.array().cast("array<string>")
    # a path begins with a slash, so its first part is empty and carries nothing
    parts = F.when(F.length("path") == 0, nothing).when(F.get(parts, F.lit(0)) == "", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    node = F.sha2(F.concat_ws("/", "host", F.to_json("template")), 256)  # by a digest, as templates may be long
    work = durable(rows.withColumn("_rest", parts).withColumn("template", nothing), "url-paths")
    done, level = work.filter(F.size("_rest") == 0).drop("_rest"), 0
    work = work.filter(F.size("_rest") > 0)
    while level == 0 or not work.isEmpty():
        if level >= PLAIN_LEVELS:
            work = _common_settled(work.withColumn("_node", node), ["_node"], "template", lambda prefix, part: F.concat(prefix, part)).drop("_node")
        work = work.withColumn("_node", node).withColumn("_segment", F.get("_rest", F.lit(0)))
        children = work.groupBy("_node", "_segment").agg(F.count("*").alias("_n"))
        sizes = children.groupBy("_node").agg(F.count("_segment").alias("_children"), F.sum("_n").alias("_rows"))
        varies = (F.col("_children") >= min_children) & (F.col("_rows") < rows_per_child * F.col("_children"))
        stays = (F.col("_n") >= literal_rows) & (F.col("_n") >= literal_share * F.col("_rows"))
        told = children.join(sizes, "_node").select("_node", "_segment", (~varies | stays).alias("_literal"), (F.col("_rows") < min_children).alias("_few"))
        part = F.array(F.when(F.col("_literal"), F.col("_segment")).otherwise(_wildcard(F.col("_segment"))))
        step = F.when(F.col("_segment").isNull(), nothing).when(F.col("_few"), F.col("_rest")).otherwise(part)  # too few rows are left to vary: all is settled
        rest = F.when(F.col("_few"), nothing).otherwise(F.slice("_rest", 2, F.greatest(F.size("_rest"), F.lit(1))))
        stepped = work.join(told.select(F.col("_node").alias("_n1"), F.col("_segment").alias("_s1"), "_literal", "_few"), (F.col("_node") == F.col("_n1")) & F.col("_segment").eqNullSafe(F.col("_s1")))
        work = durable(stepped.select(*[c for c in rows.columns if c != "template"], F.concat("template", step).alias("template"), rest.alias("_rest")), "url-level")
        done = done.unionByName(work.filter(F.size("_rest") == 0).drop("_rest"))
        work = work.filter(F.size("_rest") > 0)
        level += 1
    return done


def _common_settled(work: DataFrame, keys: list[str], prefix: str, add) -> DataFrame:
    """Move the segments that all rows of a node begin with from `_rest` to `prefix`: a pass over them alone would change nothing."""
    low, high = F.col("_low"), F.col("_high")
    size = F.least(F.size(low), F.size(high))  # as many as the least and the greatest row begin with
    same = F.zip_with(F.slice(low, 1, size), F.slice(high, 1, size), lambda a, b: a == b)
    alike = F.when(F.forall(same, lambda x: x), F.size(same)).otherwise(F.array_position(same, F.lit(False)).cast("int") - 1)
    nodes = work.groupBy(*keys).agg(F.min("_rest").alias("_low"), F.max("_rest").alias("_high")).select(*keys, alike.alias("_alike"))
    moved = work.join(nodes, keys)
    moved = moved.withColumn(prefix, add(F.col(prefix), F.slice("_rest", 1, F.col("_alike"))))
    return moved.withColumn("_rest", F.slice("_rest", F.col("_alike") + 1, F.greatest(F.size("_rest"), F.lit(1)))).drop("_alike")


def merged(table: DataFrame, *, z: float = 1.96) -> DataFrame:
    """Add `shape`, the merged template as text, to rows (host, template, n, labelled, bad), one a template.

    Below each node, the branches that are like all branches together get one name, ``~``;
    an only branch keeps its own.
    """
    work = table.withColumn("_rest", F.col("template")).withColumn("shape", F.lit(""))
    done, level = None, 0
    while level == 0 or not work.isEmpty():
        if level >= PLAIN_LEVELS:
            work = _common_settled(work, ["host", "shape"], "shape", lambda prefix, part: F.aggregate(part, prefix, lambda s, x: F.concat(s, F.lit("/"), x)))
        work = work.withColumn("_branch", F.get("_rest", F.lit(0)))
        suffix = F.to_json(F.slice("_rest", 2, F.greatest(F.size("_rest"), F.lit(1))))
        cells = work.filter("_branch IS NOT NULL").groupBy("host", "shape", "_branch", suffix.alias("_suffix")).agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
        suffixes = cells.groupBy("host", "shape", "_suffix").agg(F.sum("_n").alias("_all"), F.sum("_l").alias("_all_l"), F.sum("_b").alias("_all_b"))
        wholes = suffixes.groupBy("host", "shape").agg(F.sum("_all").alias("_whole"), F.sum("_all_l").alias("_known"), F.sum("_all_b").alias("_blocked"), (F.count("_suffix") - 1).alias("_free"))
        seen = cells.join(suffixes.select("host", "shape", "_suffix", "_all"), ["host", "shape", "_suffix"])
        square = F.sum(F.col("_n") * F.col("_n") / F.col("_all"))
        branches = seen.groupBy("host", "shape", "_branch").agg(F.sum("_n").alias("_size"), F.sum("_l").alias("_labelled"), F.sum("_b").alias("_bad"), square.alias("_square"))
        told = branches.join(wholes, ["host", "shape"])
        # over a branch's cells, the sum of (seen - expected)^2 / expected is that of seen^2 / expected, less the branch's rows
        off = F.col("_square") * F.col("_whole") / F.col("_size") - F.col("_size")
        rate = F.col("_blocked") / F.greatest(F.col("_known"), F.lit(1))
        error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("_labelled"), F.lit(1)))
        close = F.abs(F.col("_bad") / F.greatest(F.col("_labelled"), F.lit(1)) - rate) <= z * error + 1e-9
        like = (F.col("_size") < F.col("_whole")) & (off <= F.col("_free") + z * F.sqrt(2 * F.col("_free")) + 1e-9) & ((F.col("_labelled") == 0) | close)
        left = work.join(told.select("host", "shape", "_branch", like.alias("_like")), ["host", "shape", "_branch"], "left")
        name = F.when(F.col("_like"), "~").otherwise(F.col("_branch"))
        shape = F.when(F.col("_branch").isNull(), F.col("shape")).otherwise(F.concat("shape", F.lit("/"), name))
        rest = F.slice("_rest", 2, F.greatest(F.size("_rest"), F.lit(1)))
        work = durable(left.select(*table.columns, shape.alias("shape"), rest.alias("_rest")), "url-shape")
        over, work = work.filter(F.size("_rest") == 0).drop("_rest"), work.filter(F.size("_rest") > 0)
        done = over if done is None else done.unionByName(over)
        level += 1
    return done


def purity(rows: DataFrame, *, smoothing: float = 5.0, z: float = 1.96) -> DataFrame:
    """shape, share of labelled rows and smoothed purity of each (host, template) of rows with a `blocked` column (1, 0, null: not labelled)."""
    own = rows.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    named = merged(durable(own, "url-counts"), z=z)
    shapes = named.groupBy("host", "shape").agg(F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"), (F.sum("labelled") / F.sum("n")).alias("known"))
    all_rows = named.agg(F.coalesce(F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1)), F.lit(0.0)).alias("share")).first()["share"]
    hosts = named.groupBy("host").agg(((F.sum("bad") + smoothing * all_rows) / (F.sum("labelled") + smoothing)).alias("_prior"))
    both = named.select("host", "template", "shape").join(shapes, ["host", "shape"]).join(hosts, "host")
    return both.select("host", "template", "shape", "known", ((F.col("_bad") + smoothing * F.col("_prior")) / (F.col("_labelled") + smoothing)).alias("purity"))


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", reject_at: float = 0.8, known_from: float = 0.5, **tree) -> DataFrame:
    """`id_col`, host, path, rule, verdict, template, shape, known and purity for every page.

    A page that no rule decides is rejected if the purity of its template is
    `reject_at` or more and labels cover `known_from` of the merged template's rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict).withColumn("blocked", (F.col("_ruled") == "block").cast("int"))
    rows = durable(templates(rows, **tree), "url-templates")
    judged = rows.join(purity(rows), ["host", "template"], "left")
    own = F.when((F.col("purity") >= reject_at) & (F.col("known") >= known_from), "block").otherwise("allow")
    text = F.aggregate("template", F.lit(""), lambda s, x: F.concat(s, F.lit("/"), x))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), text.alias("template"), "shape", "known", "purity")
