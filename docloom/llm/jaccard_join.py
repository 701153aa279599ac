"""Jaccard similarity join of word n-gram sets, exact, with PartEnum signatures.

Sets are banded by size, so that a set's partners are in its own band or a neighbouring one, and two partners differ in
at most k features, k following from band and threshold. A hash deals the feature domain to n > k parts; a signature is
the content of one subset of m parts. At most k parts differ, so two partners agree on all subsets of the others, which
are at least t = C(n - k, m), and share at least one signature even if each leaves out its t - 1 poorest ones: those
with the fewest features, which common passages would otherwise share. Small bands take pairs of parts, large ones single
parts. Size and content order depend on the signature alone, which makes leaving out exact.

Sets that are equal are one entry. Entries that share a signature are a group; groups of the same entries are one, which
leaves few. First each entry of a group is compared with the group's smallest one. Then, in groups that the links found so
far leave in several components, each entry is held against every other by parity sketch: each feature flips one bit, so
two sets that differ in d features have sketches that differ in at most d bits, and pairs whose sketches differ in more
bits than linked sets may are passed over without loss. Of the others, each entry's 8 smallest of another component are
compared; groups where this leaves some out come again, with 128, then 2048 ..., until there are none. Large groups are
dealt in pairs of blocks, so a task holds ``2 * BLOCK`` entries of a group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._components import components
from docloom.llm._text import SPACED, begin, chunks, mix, runs, words
from docloom.storage import stage, unstage

WORDS, PERCENT = 5, 80
BROADCAST_IDS = 2_000_000
SALTS = 16
FLUSH = 1_500_000
BLOCK = 512
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Each text's set of ``size``-word shingles as sorted 64-bit hashes; fewer words are one shingle together."""
    rows, hashes, _ = words(data, offsets, SPACED)
    bounds = runs(rows, len(offsets) - 1)
    total = len(hashes) - size + 1
    if total > 0:
        grams = np.zeros(total, np.uint64)
        for j in range(size):
            grams += mix(hashes[j : j + total] * _A[j % 5] + np.uint64(j))
        grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([int(sum(int(h) * pow(3, 2 * i + 1) for i, h in enumerate(hashes[a:b]))) % (1 << 64)], np.uint64) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


@lru_cache(maxsize=8)
def bands(percent: int = PERCENT, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first size, k, parts, m) of each band: partners of a size up to s have at most 100 * s // percent features."""
    first, k, parts, m = [], [], [], []
    low = 1
    while low < most:
        high = 100 * low // percent
        widest = high + 100 * high // percent
        sums = np.arange(max(2, widest - 2 * (100 + percent)), widest + 1)
        differ = int((sums - 2 * -(-percent * sums // (100 + percent))).max())
        first.append(low)
        k.append(differ)
        m.append(2 if 0 < differ <= 6 else 1)
        parts.append(differ + 4 if m[-1] == 2 else differ + 1 + (differ * 15 // 100 + 1 if differ else 0))
        low = high + 1
    return tuple(np.array(x) for x in (first, k, parts, m))


def signatures(features: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set, given as sorted distinct hashes: of its own band and of the one below."""
    first, ks, all_parts, ms = bands(percent)
    own, out = int(np.searchsorted(first, len(features), "right")) - 1, []
    mixed = mix(features + np.uint64(0x51ED270B))
    for band in (own, own - 1):
        if band < 0 or not ks[band]:  # no features may differ: equal sets are one entry already
            continue
        n, k, m = int(all_parts[band]), int(ks[band]), int(ms[band])
        part = ((features >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # in order, as features are
        cuts = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
        size = np.diff(cuts)
        content = np.zeros(n, np.uint64)
        content[size > 0] = np.add.reduceat(mixed, cuts[:-1][size > 0])
        ids = np.arange(n)
        if m == 2:
            i, j = np.array(list(combinations(range(n), 2))).T
            content, size, ids = mix(content[i]) + mix(content[j] + np.uint64(7)), size[i] + size[j], i * n + j
        spare = comb(n - k, m) - 1
        if spare:
            best = np.lexsort((ids, -size))[: len(ids) - spare]
            content, ids = content[best], ids[best]
        out.append(mix(content ^ mix(ids.astype(np.uint64) + np.uint64((band + 1) << 32))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sized(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are at most BROADCAST_IDS of them, and joined by a shuffle otherwise."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))


def _describe(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("describe")
    for batch in batches:
        n, h1, h2 = [], [], []
        for _, _, data, offsets in chunks(batch.column(1)):
            for s in shingles(data, offsets, size):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0xABCD))).view(np.int64)) if len(s) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["doc_id", "n", "h1", "h2"])


SIGNED = "shard long, ids binary, sigs binary, owner binary"


def _sign(size: int, percent: int, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of texts, packed by shard: entries, the low 32 bits of each signature and whose it is."""
    begin("sign")
    held: list[tuple[int, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        ids = np.array([h[0] for h in held], np.int64)
        every = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        shard = ((every >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows: list[list] = [[], [], [], []]
        for s in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[s] : cuts[s + 1]]
            here, back = np.unique(owner[mine], return_inverse=True)
            values = (ids[here], every[mine].astype(np.uint32), back.astype(np.uint32 if len(here) > 65535 else np.uint16))
            for c, v in zip(rows, [int(s), *(v.tobytes() for v in values)], strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["shard", "ids", "sigs", "owner"])

    count = 0
    for batch in batches:
        for a, _, data, offsets in chunks(batch.column(1)):
            for i, s in enumerate(shingles(data, offsets, size)):
                if len(s) and len(sig := signatures(s, percent)):
                    held.append((batch.column(0)[a + i].as_py(), sig))
                    count += len(sig)
            if count > FLUSH:
                yield packed()
                held, count = [], 0
    yield packed()


GROUPS = "gid long, block int, members array<long>"


def _group(rows: pd.DataFrame) -> pd.DataFrame:
    """The distinct groups of two or more entries that share a signature of one shard, in blocks of sorted entries."""
    begin("group")
    ids, sigs, owner, base = [], [], [], 0
    for r in rows.itertuples(index=False):
        ids.append(np.frombuffer(r.ids, np.int64))
        sigs.append(np.frombuffer(r.sigs, np.uint32))
        owner.append(np.frombuffer(r.owner, np.uint16 if len(r.owner) == 2 * len(sigs[-1]) else np.uint32).astype(np.int64) + base)
        base += len(ids[-1])
    ids, sigs, owner = (np.concatenate(x) for x in (ids, sigs, owner))
    order = np.argsort(sigs, kind="stable")
    shared = np.zeros(len(sigs), bool)
    shared[1:] = sigs[order[1:]] == sigs[order[:-1]]
    shared[:-1] |= shared[1:]
    order = order[shared]
    sigs, member = sigs[order], ids[owner[order]]
    order = np.lexsort((member, sigs))
    sigs, member = sigs[order], member[order]
    fresh = np.ones(len(sigs), bool)
    fresh[1:] = (sigs[1:] != sigs[:-1]) | (member[1:] != member[:-1])
    sigs, member = sigs[fresh], member[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, int)
    ends = np.append(starts[1:], len(sigs))
    name = np.add.reduceat(mix(member.view(np.uint64)), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)
    many = ends - starts > 1
    _, first = np.unique(name[many], return_index=True)
    out = []
    for gid, a, b in zip(name[many][first].tolist(), starts[many][first].tolist(), ends[many][first].tolist(), strict=True):
        out += [(gid, k, member[at : min(at + BLOCK, b)]) for k, at in enumerate(range(a, b, BLOCK))]
    return pd.DataFrame(out, columns=["gid", "block", "members"])


def _sketched(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("sketch")
    for batch in batches:
        sets = [s for _, _, data, offsets in chunks(batch.column(1)) for s in shingles(data, offsets, size)]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, percent).tobytes() if len(s) else b"" for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "sketch"])


def sketch_words(size: int, percent: int = PERCENT) -> int:
    """64-bit words of a sketch: one length for a band and the next, so that partners' sketches can be compared."""
    first = bands(percent)[0]
    own = int(np.searchsorted(first, size, "right")) - 1
    return int(2 ** np.ceil(np.log2(max(1.0, first[own] * 3 / 64))))


def sketch(features: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The parity of the features that hash to each bit."""
    bits = 64 * sketch_words(len(features), percent)
    odd = np.bincount((mix(features + np.uint64(0x1234567)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def common_sketches(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches at the length of the shortest: as lengths are powers of two, bits that fall together are added up."""
    words = min(map(len, sketches))
    return np.stack([s if len(s) == words else np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in sketches])


def may_link(sketches: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others' sizes and sketches allow a link with one."""
    a, b = sizes[one], sizes[others]
    others = others[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
    total = a + sizes[others]
    most = total - 2 * -(-percent * total // (100 + percent))
    return others[np.bitwise_count(sketches[others] ^ sketches[one]).sum(axis=1, dtype=np.int64) <= most]


def _rivals(most: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of units (columns unit, node, component, size, sketch; each unit's rows together, by node): for each entry the
    ``most`` smallest before it of other components whose sketches allow a link; a null with each unit that has more.
    """

    def compared(part: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, ids, label, sizes = (part.column(i).to_numpy() for i in range(4))
        packed = part.column(4).to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        low, high, left = [], [], []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
            own = label[at:end]
            if (own == own[0]).all():
                continue
            table, size = common_sketches([np.frombuffer(x, np.uint64) for x in packed[at:end]]), sizes[at:end]
            over = False
            for j in np.flatnonzero(np.minimum.accumulate(own) != np.maximum.accumulate(own)).tolist():
                found = may_link(table, size, j, np.flatnonzero(own[:j] != own[j]), percent)
                over |= len(found) > most
                low.append(ids[at + found[:most]])
                high.append(np.full(len(low[-1]), ids[at + j]))
            if over:
                left.append(unit[at])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high))
        yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *[None] * len(left)], pa.int64()), pa.array(np.concatenate([b, np.array(left, np.int64)]), pa.int64())], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        cut = int(np.append(0, np.flatnonzero(unit[1:] != unit[:-1]) + 1)[-1])  # where the last unit begins
        if kept and (cut or kept[-1].column(0)[0].as_py() != unit[0]):
            yield from compared(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
            kept = []
        elif cut:
            yield from compared(pa.Table.from_batches([batch.slice(0, cut)]))
        kept.append(batch.slice(cut))
    if kept:
        yield from compared(pa.Table.from_batches(kept))


def _compare(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (a, b, part, text) in which texts of a, with a null b, come before those of their partners."""
    begin("compare")
    leader, own = None, []
    for batch in batches:
        a, b, part = (batch.column(i).to_pylist() for i in range(3))
        keep, sets = [], (s for _, _, data, offsets in chunks(batch.column(3)) for s in shingles(data, offsets, size))
        for i, s in enumerate(sets):
            if leader != (a[i], part[i]):
                leader, own = (a[i], part[i]), []
            if b[i] is None:
                own.append(s)
                continue
            for t in own:  # one set, but for rows that repeat a doc_id
                both = np.sort(np.concatenate([t, s]), kind="stable")
                if linked(int((both[1:] == both[:-1]).sum()), len(t), len(s), percent):
                    keep.append(i)
                    break
        yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links between components; only those that the links touch are worked on."""
    one = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    edges = links.join(_sized(one), "a").join(_sized(two), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stage(label.join(_sized(moved), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "label")


def _looked_up(rows: DataFrame, found: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined with what one row of found says of keys: by broadcast if found is small, otherwise salted, as a key may
    hold a third of rows."""
    if (small := _sized(found)) is not found:
        return rows.join(small, keys, how)
    salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for each row of docs.

    Texts link when 100 * common shingles >= percent * all shingles of both. Null, empty and blank texts have no
    shingles and link with nothing, not even with one another. Rows of equal doc_id are one node: they get the same
    component, each its own n_shingles. A null doc_id is never linked and its component is null. Extra columns are
    ignored. An empty table gives no rows. Equality of shingles is equality of 64-bit hashes.
    """
    spark = docs.sparkSession
    source = _sets(docs, text)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = stage(source.mapInArrow(partial(_describe, size), "doc_id long, n long, h1 long, h2 long"), "sets")
    filled = known.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    alike = ["h1", "h2", "n"]
    leads = stage(filled.groupBy(*alike).agg(F.min("doc_id").alias("lead"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "leads")
    copies = stage(_looked_up(filled, leads, alike, "doc_id").select("doc_id", "lead", *alike).where(F.col("doc_id") != F.col("lead")).distinct(), "copies")
    # A document is signed unless all its rows are copies of smaller documents.
    gone = copies.select("doc_id").distinct()
    own = filled.join(_sized(gone), "doc_id", "left_semi").join(copies.select("doc_id", *alike), ["doc_id", *alike], "left_anti").select("doc_id")
    gone = stage(gone.join(own, "doc_id", "left_anti"), "gone")
    entries = source.where(F.col("doc_id").isNotNull()).join(_sized(gone), "doc_id", "left_anti")
    total = filled.agg(F.sum("n")).first()[0] or 0
    shards = max(parallel, total // 4_000_000, 1)

    signed = entries.mapInArrow(partial(_sign, size, percent, shards), SIGNED)
    found = signed.groupBy("shard").applyInPandas(_group, GROUPS)
    groups = stage(found.groupBy("gid", "block").agg(F.first("members").alias("members")), "groups")
    least = groups.where("block = 0").select("gid", F.element_at("members", 1).alias("a"))
    stars = groups.join(least, "gid").select("a", F.explode("members").alias("b")).where("a <> b").distinct()
    crowd = stage(groups.select(F.explode("members").alias("node")).distinct(), "crowd")
    label = crowd.select("node", F.col("node").alias("component"))
    sketches = stage(entries.join(_sized(crowd), F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(partial(_sketched, size, percent), "node long, size long, sketch binary").where("size > 0"), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs: the text of a once for each part of its partners, before theirs."""
        hot = stage(pairs.groupBy("a").agg(F.count("*").alias("n")).where("n > 256"), "hot")
        part = F.pmod(F.xxhash64("b"), F.floor(F.coalesce("n", F.lit(0)) / 256) + 1)
        parted = stage(pairs.join(_sized(hot), "a", "left").select("a", "b", part.alias("part")), "pairs")
        first = entries.join(_sized(parted.select("a", "part").distinct()), F.col("doc_id") == F.col("a")).select("a", F.lit(None).cast("long").alias("b"), "part", "text")
        second = entries.join(_sized(parted), F.col("doc_id") == F.col("b")).select("a", "b", "part", "text")
        rows = first.unionByName(second).repartition(parallel, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).select("a", "b", "part", "text")
        links = stage(rows.mapInArrow(partial(_compare, size, percent), "a long, b long"), "links")
        unstage(parted)
        unstage(hot)
        return links

    def mixed(units: DataFrame) -> DataFrame:
        """Units (unit, node) with what is known of their entries, of units in several components."""
        named = units.join(_sized(label), "node")
        several = named.groupBy("unit").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("unit")
        return named.join(several, "unit", "left_semi")

    tested = stage(stars, "stars")
    if tested.head(1):
        label = merged(label, verified(tested))
    # Blocks of a group that isn't of one component, in pairs; a small group is one unit.
    kinds = groups.select("gid", "block", F.explode("members").alias("node")).join(_sized(label), "node").groupBy("gid", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = kinds.groupBy("gid").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("blocks")).where("least <> most").select("gid", "blocks")
    blocks = groups.join(kinds, ["gid", "block"]).join(open_, "gid")
    x, y = (blocks.select("gid", "blocks", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "members", "low", "high")]) for k in "xy")
    two = x.where("blocks > 1").join(y.drop("blocks"), "gid").where("block_x < block_y and least(low_x, low_y) <> greatest(high_x, high_y)")
    lone = blocks.where("blocks = 1").select(F.col("gid").alias("unit"), "members")
    units = lone.unionByName(two.select(F.xxhash64("gid", "block_x", "block_y").alias("unit"), F.concat("members_x", "members_y").alias("members")))
    units, most = stage(units.select("unit", F.explode("members").alias("node")), "units"), 8
    while units.head(1):
        rows = mixed(units).join(sketches, "node").select("unit", "node", "component", "size", "sketch")
        rivals = stage(rows.repartition(parallel, "unit").sortWithinPartitions("unit", "node").mapInArrow(partial(_rivals, most, percent), "a long, b long"), "rivals")
        todo = stage(rivals.where(F.col("a").isNotNull()).distinct().join(tested, ["a", "b"], "left_anti"), "todo")
        left = rivals.where(F.col("a").isNull()).select(F.col("b").alias("unit")).distinct()
        if todo.head(1):
            tested = tested.unionByName(todo)
            label = merged(label, verified(todo))
        again = stage(units.join(_sized(left), "unit", "left_semi"), "units")
        for spent in (units, rivals):
            unstage(spent)
        units, most = again, most * 16
    for spent in (groups, crowd, sketches, units):
        unstage(spent)
    # A copy's component is its lead's. Documents whose rows copy several others, or one besides a text of their own, link.
    label, to = label.where("node <> component"), copies.groupBy("doc_id").agg(F.min("lead").alias("lead"), F.count("*").alias("rows"))
    plain = to.where("rows = 1").join(gone, "doc_id", "left_semi").select("doc_id", "lead")
    odd = stage(copies.select("doc_id", "lead").join(plain, "doc_id", "left_anti"), "odd")
    if odd.head(1):
        label = components(odd.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b")))).where("node <> component")
    follow = _looked_up(plain, label.select(F.col("node").alias("lead"), "component"), ["lead"], "doc_id", "left").select("doc_id", F.coalesce("component", "lead").alias("component"))
    found = stage(label.select(F.col("node").alias("doc_id"), "component").unionByName(follow), "found")
    return known.join(_sized(found), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: that of the smallest doc_id.

    Texts without shingles and rows without doc_id link with nothing and all stay. Of rows that repeat a doc_id the one
    with the smallest text stays.
    """
    found = stage(join(docs, size, percent, text), "joined")
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = stage(gone, "gone")
    small = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
    again = stage(found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again"), "again")
    if not again.head(1):
        return kept
    mine = kept["doc_id"].cast("long") == F.col("__again")
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last(text))
    one = kept.join(again, mine, "left_semi").withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return kept.join(again, mine, "left_anti").unionByName(one)
