"""The property graph as DataFrames: merge, deduplicate, remap, link, walk, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.latest import last_n, look_up, salted
from docloom.operators.substrings import SubstringIndex
from docloom.storage import broadcast_small, dealt, stage


def normalized(name: Column) -> Column:
    return F.lower(F.trim(name))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """One entity for each (name, type): its documents, mentions and mean confidence.

    Confidences have two decimals; they are summed as whole hundredths, so the mean doesn't depend on the order of rows.
    """
    of_doc = mentions.groupBy("doc_id", "name", "type").agg(F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("sum"), F.count("*").alias("n"))
    mean = F.sum("sum") / (100.0 * F.sum("n"))
    return of_doc.groupBy("name", "type").agg(F.round(mean, 6).alias("confidence"), F.count("doc_id").alias("n_docs"), F.sum("n").alias("n_mentions"))


def aggregate_folds(mentions: DataFrame) -> DataFrame:
    """(name, type, confidence): after each mention, in order, confidence is the mean of the one before and the new one.

    Counted from the last, mention p weighs 2 ** -p, and the first as much as the one behind it; so only the last 1,100
    of an entity are kept, before the shuffle, as all others weigh nothing in a double.
    """
    by = Window.partitionBy("name", "type").orderBy(F.desc("doc_id"), F.desc("chunk_seq"), F.desc("confidence"))
    last = mentions.withColumn("place", F.row_number().over(by)).where("place <= 1100")
    weight = lambda place: F.pow(F.lit(2.0), -place)
    first = F.max_by("confidence", "place") * weight(F.max("place"))
    return last.groupBy("name", "type").agg((F.sum(F.col("confidence") * weight(F.col("place"))) + first).alias("confidence"))


def keepers(entities: DataFrame) -> DataFrame:
    """(id, keeper) of each entity: of those equal in normalised name and type, the surest, then the one of least id.

    A group-by on the normalised key in place of a self-join of all pairs.
    """
    key = [normalized(F.col("name")).alias("k_name"), F.col("type").alias("k_type")]
    best = entities.groupBy(*key).agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("keeper"))
    mine = entities.select("id", *key)
    return mine.join(best, ["k_name", "k_type"]).select("id", "keeper")


def remap(edges: DataFrame, keeper: DataFrame) -> DataFrame:
    """Edges (src, dst) with both ends moved to their keepers; repeats and loops go."""
    a = keeper.select(F.col("id").alias("src"), F.col("keeper").alias("s"))
    b = keeper.select(F.col("id").alias("dst"), F.col("keeper").alias("d"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"))
    return moved.where(F.col("src") != F.col("dst")).distinct()


def colinks(mentions: DataFrame, rows: int, most: int = 1000) -> DataFrame:
    """Pairs of entities of different types with the number of documents that mention both.

    Mentions, of so many rows, are dealt once by document, made distinct and paired where they are. Only documents with over
    ``most`` entities are dealt again by names, so such a document is paired by many tasks.
    """
    m = dealt(mentions.select("doc_id", "name", "type"), rows, "doc_id").distinct()
    m = m.withColumn("size", F.count("*").over(Window.partitionBy("doc_id")))

    def side(which: str, where: Column) -> DataFrame:
        return m.where(where).select("doc_id", F.col("name").alias(f"name_{which}"), F.col("type").alias(f"type_{which}"))

    few, many = F.col("size") <= most, F.col("size") > most
    pairs = side("a", few).join(side("b", few).hint("merge"), "doc_id").unionByName(salted(side("a", many), side("b", many), ["doc_id"], "name_a"))
    return pairs.where(F.col("type_a") < F.col("type_b")).groupBy("name_a", "type_a", "name_b", "type_b").agg(F.count("*").alias("n_docs"))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within ``depth`` undirected hops of each start, with the fewest hops.

    Starts with the same neighbours reach the same nodes, so each such class is walked once, by a frontier join for each
    hop behind the first; nodes seen before leave the frontier, so paths aren't listed. What a class reaches is given to its
    starts last, in tiles, behind which nothing is shuffled: the result may be starts times nodes, the shuffles aren't.
    A class is told from others by its number of neighbours and two 64-bit hashes, so no start's neighbours are collected.
    """
    both = stage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "near")
    starts = starts.select(F.col("node").alias("start")).distinct()
    own = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    if depth < 1:
        return own
    first = starts.join(both, F.col("start") == F.col("src")).select("start", "dst")
    named = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("dst")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "dst")).alias("h2")]
    member = stage(first.groupBy("start").agg(*named), "class")
    of_class = member.groupBy("n", "h1", "h2").agg(F.min("start").alias("class"))
    member = stage(member.join(of_class, ["n", "h1", "h2"]).select("start", "class"), "class")
    seen = frontier = stage(member.where("start = class").join(first, "start").select("class", F.col("dst").alias("node"), F.lit(1).alias("hops")), "frontier")
    for hop in range(2, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("class", F.col("dst").alias("node")).distinct()
        frontier = stage(step.join(seen, ["class", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return own.unionByName(each_with_each(member, seen))


def each_with_each(member: DataFrame, reached: DataFrame, block: int = 256, most: int = 16_384, rows: int = 1_000_000) -> DataFrame:
    """(start, node, hops): each start of a class (start, class) with each other node that the class reached (class, node, hops).

    A class is cut into tiles of at most some ``most`` starts and ``most`` nodes, and one of over ``rows`` pairs into up to 16
    at least. A tile is paired by one task, which holds its nodes and no more; starts and nodes are shuffled once for each tile
    that they are in. Starts go in blocks of ``block`` (the last of each 8 has what is left), and a block is paired with one
    node after the other: columns of the result then repeat one value or one short list, which Parquet writes in little.
    """
    n_starts, n_nodes = (df.groupBy("class").agg(F.count("*").alias(n)) for df, n in ((member, "n_starts"), (reached, "n_nodes")))
    pairs = F.col("n_starts").cast("double") * F.col("n_nodes")
    wide, high = F.ceil(F.col("n_starts") / most), F.greatest(F.ceil(F.col("n_nodes") / most), F.least(F.lit(16), F.ceil(pairs / rows)))
    sized = stage(n_starts.join(n_nodes, "class").select("class", F.ceil(F.col("n_starts") / (8 * block)).alias("shares"), wide.cast("int").alias("wide"), high.cast("int").alias("high"), pairs.alias("pairs")), "sized")
    tasks = max(int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int((sized.agg(F.sum("pairs")).head()[0] or 0) / (16 * rows))))
    tile, sized = ["class", "across", "down"], sized.drop("pairs")
    starts = look_up(member, sized, ["class"], "start").groupBy("class", F.pmod(F.xxhash64("start"), "shares").alias("share"), "wide", "high").agg(F.collect_list("start").alias("starts"))
    starts = starts.select("class", F.pmod("share", "wide").cast("int").alias("across"), "high", F.explode(F.expr(f"transform(sequence(1, size(starts), {block}), i -> slice(starts, i, {block}))")).alias("starts"))
    starts = starts.select("class", "across", F.explode(F.expr("sequence(0, high - 1)")).alias("down"), "starts")
    nodes = look_up(reached, sized, ["class"], "node")
    nodes = nodes.select(F.col("class").alias("of"), F.explode(F.expr("sequence(0, wide - 1)")).alias("x"), F.pmod(F.xxhash64("node"), "high").cast("int").alias("y"), "node", "hops")
    # The merge takes block by block. A block of the node alone gives nothing, and as such a function isn't compiled, the join
    # gives what a block is paired with one by one; a compiled join would hold all of it.
    met = F.expr("class = of AND across = x AND down = y AND exists(starts, s -> s <> node)")
    pairs = starts.repartition(tasks, *tile).join(nodes.repartition(tasks, "of", "x", "y").hint("merge"), met)
    return pairs.select(F.explode("starts").alias("start"), "node", "hops").where("start <> node")


def paths(edges: DataFrame, starts: DataFrame, depth: int, most: int = 50) -> DataFrame:
    """(start, hops, path): paths of 1 to depth undirected hops without a repeated node, at most ``most`` a start.

    Shorter paths come first, then by their nodes in order; a path that was left out isn't walked on. Before each hop a node's
    neighbours are cut to the first most + depth: of a path's extensions at most ``most`` can be kept, and at most depth are
    on the path already, so the cut changes nothing and a hub costs no more than any node. What is written is linear in starts.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = stage(last_n(both, ["src"], [F.col("dst")], most + depth), "near")
    open_ = starts.select(F.col("node").alias("start")).distinct().select("start", F.array("start").alias("path"), F.lit(0).cast("long").alias("kept"))
    found = None
    for hop in range(1, depth + 1):
        step = open_.join(near, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("start", "kept", F.concat("path", F.array("dst")).alias("path"))
        by = Window.partitionBy("start").orderBy("path")
        step = step.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
        step = step.where(F.col("place") <= most - F.col("kept"))
        n = F.count("*").over(Window.partitionBy("start"))
        step = stage(step.select("start", "path", (F.col("kept") + n).alias("kept")), "paths")
        new = step.select("start", F.lit(hop).alias("hops"), "path")
        found = new if found is None else found.unionByName(new)
        open_ = step.where(F.col("kept") < most)
    return found


def path_nodes(found: DataFrame) -> DataFrame:
    """(start, node, hops): the nodes on the paths, the start itself too, with the fewest hops."""
    places = found.select("start", F.posexplode("path").alias("hops", "node"))
    return places.groupBy("start", "node").agg(F.min("hops").alias("hops"))


def path_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, src, dst, type): the edges that the paths walk, as they are directed."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    walked = found.select("start", F.explode(pairs).alias("pair")).select("start", "pair.*").distinct()
    ways = walked.select("start", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(walked.select("start", F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    return ways.join(edges.select("src", "dst", "type").distinct(), ["src", "dst"]).select("start", "src", "dst", "type")


def chunks_by_terms(mentions: DataFrame, terms: DataFrame, index: SubstringIndex, only: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(query_id, chunk_id, doc_id, entity_count, place): for each query the chunks that mention most entities whose name
    contains any of its terms (query_id, term), at most ``most``.

    mentions: chunk_id, doc_id, name, type. ``only`` (query_id, doc_id) restricts a query to some documents. Without it, mentions
    are dealt once, by chunk; counting, and each task's best chunks of a query, need no further shuffle of them.
    """
    named = index.matches(terms, "term").select("query_id", "name").distinct()
    if only is None:
        held = mentions.select("chunk_id", "doc_id", "name", "type").join(broadcast_small(named.select("name").distinct()), "name", "left_semi")
        met = look_up(held.repartition("chunk_id"), named, ["name"], "chunk_id")
    else:  # documents first: they are few for each query
        met = mentions.join(broadcast_small(only.select("query_id", "doc_id")), "doc_id").join(broadcast_small(named), ["query_id", "name"])
    counted = met.groupBy("query_id", "chunk_id").agg(F.countDistinct("name", "type").alias("entity_count"), F.min("doc_id").alias("doc_id"))
    by = Window.partitionBy("query_id").orderBy(F.desc("entity_count"), "chunk_id")
    return counted.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("query_id", "chunk_id", "doc_id", "entity_count", "place")


def delete_document(mentions: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    """What is left of the entities without some documents: their mentions go, and entities without mentions too.

    Mentions are of so many rows; they are dealt once by document, and only sums by entity are shuffled behind that.
    """
    left = dealt(mentions.select("doc_id", "name", "type", "confidence"), rows, "doc_id").join(dealt(gone.select("doc_id"), rows, "doc_id"), "doc_id", "left_anti")
    return merge_entities(left)


def rebuild(current: DataFrame, extracted: DataFrame, again: DataFrame, first_chunks: int) -> DataFrame:
    """Entities after the mentions of some documents (again: doc_id) are cleared and taken anew from what is extracted of
    their first chunks: (name, type, n_mentions, n_docs, rebuilt)."""
    ids = again.select("doc_id").distinct()
    kept = current.join(ids, "doc_id", "left_anti").select("name", "type", "doc_id", F.lit(False).alias("rebuilt"))
    new = extracted.where(F.col("chunk_seq") <= first_chunks).join(ids, "doc_id", "left_semi").select("name", "type", "doc_id", F.lit(True).alias("rebuilt"))
    return kept.unionByName(new).groupBy("name", "type").agg(F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"), F.bool_or("rebuilt").alias("rebuilt"))


def merge_into_lowest(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (src, dst, type) after entities equal in normalised name and type are merged into the one of least id.

    An edge into an entity that went is a MENTIONS edge of its keeper, an edge out of one RELATED_TO; loops go.
    """
    key = [normalized(F.col("name")).alias("k_name"), F.col("type").alias("k_type")]
    least = entities.groupBy(*key).agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    moved = entities.select("id", *key).join(least, ["k_name", "k_type"]).where("id <> keeper").select("id", "keeper")
    a, b = moved.select(F.col("id").alias("src"), F.col("keeper").alias("s")), moved.select(F.col("id").alias("dst"), F.col("keeper").alias("d"))
    kind = F.when(F.col("d").isNotNull(), "MENTIONS").when(F.col("s").isNotNull(), "RELATED_TO").otherwise(F.col("type"))
    out = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), kind.alias("type"))
    return out.where("src <> dst").distinct()
