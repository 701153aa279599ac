"""Merkle manifest of a dataset: a postorder append log of nodes, and proofs read from it by position.

Rows are the leaves of one tree for each source, of fan-out 16; the sources' roots are the leaves of a last tree. A tree's log
holds its nodes in the order in which they are complete: a node follows the last of its children (postorder). Builders are
aligned: one takes 256 nodes whose places begin at a multiple of 256, and appends whatever they complete, so no builder waits
for another and a source of any size is many builders. Because the trees are aligned, the log position of a node follows from
its level, its index and the tree's number of leaves alone, by the sizes of the complete subtrees before it. Proofs use that:
the positions of a run's nodes are computed and looked up in the log, once for each run; all leaves below share the result.

Defined results. A null in any field is hashed as "-". Rows of one id in one source are ordered by their leaf, and rows that
are equal throughout are leaves of their own. A null source is a source of its own, the first. Texts of any length are hashed
whole. An empty table has an empty log and no proofs. Other columns of the table, whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import stage

BITS = 4
FAN = 1 << BITS
LEVELS = 15  # 16 ** 15 leaves are more than a bigint counts
BUILDER_LEVELS = 2  # a builder takes 16 ** 2 nodes


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as the leaf hash reads it: "-" for null, otherwise its length in UTF-8 bytes, ":", and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def nodes_at(n: str, level: str | int) -> str:
    """SQL: the number of nodes of a level in a tree of n leaves."""
    return f"shiftright({n} + shiftleft(1L, {BITS} * ({level})) - 1, {BITS} * ({level}))"


def height(n: str) -> str:
    """SQL: the level of the root of a tree of n leaves."""
    return "(" + " + ".join(f"int({n} > {FAN**k})" for k in range(LEVELS)) + ")"


def position(level: str, index: str, n: str) -> str:
    """SQL: the place of a node in the postorder log of its tree of n leaves, from 0.

    Before it stand the nodes complete before its first leaf i, floor(i / 16^k) of each level k, and its own subtree but
    for itself: with m leaves, ceil(m / 16^k) nodes of each level k up to its own.
    """
    first = f"shiftleft({index}, {BITS} * ({level}))"
    leaves = f"(least({n}, {first} + shiftleft(1L, {BITS} * ({level}))) - {first})"
    before = " + ".join(f"shiftright({first}, {BITS * k})" for k in range(LEVELS))
    own = " + ".join(f"if({k} <= ({level}), {nodes_at(leaves, k)}, 0L)" for k in range(LEVELS))
    return f"({before} + {own} - 1)"


def place(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with ``idx``, the place in the tree (from 0), and ``n``, the tree's number of rows.

    Rows are range-partitioned by tree and order, numbered within their part and shifted by the counts of the parts before,
    so a tree that holds most of the rows is numbered by many tasks. ``order`` must tell all rows of a tree apart.
    """
    dealt = stage(rows.repartitionByRange(tree, *order).withColumn("part", F.spark_partition_id()), "placed")
    counts = dealt.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("held"))
    by_part, all_parts = Window.partitionBy(tree).orderBy("part"), Window.partitionBy(tree)
    shifts = counts.select(tree, "part", (F.sum("held").over(by_part) - F.col("held")).alias("shift"), F.sum("held").over(all_parts).alias("n"))
    local = dealt.withColumn("idx", F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order)).cast("long") - 1)
    return local.join(shifts, [tree, "part"]).withColumn("idx", F.col("idx") + F.col("shift")).drop("part", "shift")


def append_log(leaves: DataFrame) -> DataFrame:
    """The log (tree, n, level, idx, pos, hash) of all trees of leaves (tree, n, idx, hash).

    Each round of builders climbs two levels and writes its nodes, in completion order, to a staged table, so the rounds
    are a logarithm of the largest tree, each on a 256th of the nodes before.
    """
    most = leaves.agg(F.max("n")).head()[0] or 0
    level, parts = 0, []
    base = leaves.select("tree", "n", "idx", "hash")
    while not parts or most > FAN**level:
        built = stage(_build(base, level), f"log-{level}")
        parts.append(built)
        level += BUILDER_LEVELS
        base = built.where(F.col("level") == level).select("tree", "n", "idx", "hash")
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return log


def _build(base: DataFrame, level: int) -> DataFrame:
    """What the builders of one round append: leaves (in the first), and the nodes of the next two levels where there are such."""
    span = BITS * BUILDER_LEVELS
    blocks = (
        base.groupBy("tree", "n", F.shiftright("idx", span).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("kids"))
        .withColumn("runs", F.expr(f"transform(sequence(0, (size(kids) - 1) div {FAN}), r -> slice(kids, r * {FAN} + 1, {FAN}))"))
        .withColumn("parents", F.expr("transform(runs, r -> sha2(cast(array_join(transform(r, k -> k.hash), '') as binary), 256))"))
    )
    kid = "struct({0} AS level, k.idx AS idx, k.hash AS hash)"
    own = f"transform(r, k -> {kid.format(level)})" if level == 0 else f"filter(transform(r, k -> {kid.format(level)}), k -> false)"
    parent = f"array(struct({level + 1} AS level, shiftleft(block, {BITS}) + i AS idx, parents[i] AS hash))"
    top = f"array(struct({level + 2} AS level, block AS idx, sha2(cast(array_join(parents, '') as binary), 256) AS hash))"
    grown, taller = f"{nodes_at('n', level)} > 1", f"{nodes_at('n', level + 1)} > 1"
    none = f"filter({top}, k -> false)"
    done = f"concat(flatten(transform(runs, (r, i) -> concat({own}, if({grown}, {parent}, {none})))), if({taller}, {top}, {none}))"
    node = blocks.select("tree", "n", F.explode(F.expr(done)).alias("node")).select("tree", "n", "node.*")
    return node.select("tree", "n", "level", "idx", F.expr(position("level", "idx", "n")).alias("pos"), "hash")


def sibling_runs(log: DataFrame) -> DataFrame:
    """(tree, level, idx, kids): the hashes of each node's children, in order, looked up in the log by their positions."""
    wanted = log.where("level > 0").select(
        "tree", "n", "level", "idx", F.explode(F.expr(f"sequence(0, cast(least({FAN}L, {nodes_at('n', 'level - 1')} - {FAN} * idx) as int) - 1)")).alias("c")
    )
    wanted = wanted.select("tree", "level", "idx", "c", F.expr(position("level - 1", f"({FAN} * idx + c)", "n")).alias("pos"))
    found = wanted.join(log.select("tree", "pos", "hash"), ["tree", "pos"])
    return found.groupBy("tree", "level", "idx").agg(F.expr("transform(sort_array(collect_list(struct(c, hash))), k -> k.hash)").alias("kids"))


_STEP = "struct(array_join(slice(kids, 1, c), '') AS before, array_join(slice(kids, c + 2, 16), '') AS after)"
NO_STEPS = "cast(array() as array<struct<before:string,after:string>>)"


def roots(log: DataFrame) -> DataFrame:
    """(tree, n, subroot) of each tree."""
    return log.where(f"idx = 0 AND level = {height('n')}").select("tree", "n", F.col("hash").alias("subroot"))


def prove(log: DataFrame, leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """leaves with ``proof``, the steps (before, after) from the leaf up, and the other columns of tops.

    A step holds the hashes left and right of the node in its run. ``tops`` has a row for each tree: tree, n, the steps from
    its root on, ``proof``, and what leaves should get besides. Runs are joined from the top down, so a leaf's steps are put
    together once for each run of 16 leaves and never shuffled for each leaf.
    """
    runs = stage(sibling_runs(log), "runs")
    tall = tops.agg(F.max(F.expr(height("n")))).head()[0] or 0
    extra = [c for c in tops.columns if c not in ("tree", "n", "proof")]
    at = tops.withColumn("level", F.expr(height("n"))).withColumn("idx", F.lit(0).cast("long"))
    here = None
    for level in range(tall, 0, -1):
        start = at.where(F.col("level") == level).select("tree", "idx", "proof", *extra)
        here = start if here is None else here.unionByName(start)
        here = here.join(runs.where(F.col("level") == level).select("tree", "idx", "kids"), ["tree", "idx"])
        if level > 1:
            here = here.select("tree", "idx", "proof", *extra, "kids", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("c"))
            here = here.select("tree", F.expr(f"{FAN} * idx + c").alias("idx"), F.expr(f"concat(array({_STEP}), proof)").alias("proof"), *extra)
    lone = at.where("level = 0").select("tree", "idx", "proof", *extra, F.expr("cast(null as array<string>)").alias("kids"))
    paths = lone if here is None else here.unionByName(lone)
    own = [c for c in leaves.columns if c != "tree"]
    by_run = leaves.groupBy("tree", F.shiftright("idx", BITS).alias("run")).agg(F.collect_list(F.struct(*own)).alias("held"))
    met = by_run.join(paths.withColumnRenamed("idx", "run"), ["tree", "run"]).select("tree", "proof", "kids", *extra, F.explode("held").alias("leaf"))
    met = met.withColumn("c", F.expr(f"cast(leaf.idx % {FAN} as int)"))
    steps = F.expr(f"if(kids IS NULL, proof, concat(array({_STEP}), proof))")
    return met.select("tree", "leaf.*", *extra, steps.alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(proof, leaf, lambda h, step: digest(step["before"], h, step["after"]))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass
class Manifest:
    """leaves: tree, idx, n, hash, the id and the carried columns; log: of the sources' trees; tops: of each source's tree
    its subroot, the steps from there and the root; top_log: of the last tree."""

    leaves: DataFrame
    log: DataFrame
    top_log: DataFrame
    tops: DataFrame

    def proofs(self) -> DataFrame:
        """The leaves with ``proof``, ``subroot`` and ``root``."""
        return prove(self.log, self.leaves, self.tops)


def build(docs: DataFrame, fields: list[str], source: str = "source", key: str = "doc_id", carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table, one leaf a row; ``carried`` are columns to keep beside each leaf."""
    carried = carried or {}
    tree = F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit("")).alias("tree")  # null first
    rows = docs.select(tree, docs[key].alias("key"), leaf_hash([docs[c] for c in fields]).alias("hash"), *[c.alias(k) for k, c in carried.items()])
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")  # tells equal rows apart
    leaves = stage(place(rows, "tree", ["key", "hash", "row"]).drop("row"), "numbered")
    log = append_log(leaves)
    subroots = roots(log)
    last = stage(place(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), F.col("subroot").alias("hash")), "tree", ["name"]), "subroots")
    top_log = append_log(last)
    top = roots(top_log).select("tree", "n", F.col("subroot").alias("root"), F.expr(NO_STEPS).alias("proof"))
    tops = prove(top_log, last, top).select(F.col("name").alias("tree"), F.col("size").alias("n"), "proof", F.col("hash").alias("subroot"), "root")
    return Manifest(leaves, log, top_log, stage(tops, "tops"))
