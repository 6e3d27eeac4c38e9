"""Near-duplicates by a chosen-path set similarity join.

Each distinct shingle set has 128 minwise values. A tree's node picks a few of the positions (each with
probability 1 / (threshold * 128), by a hash of the node), and sends every set to the children named by its values
there: similar sets stay together, others part. Independent trees repeat this: at the threshold a pair meets in the
first level of 24 trees (30 nodes) with 1 - 0.2^30, and survives k levels of a tree with at least 1 / (k + 1).

Nodes of up to `node_limit` sets are compared exhaustively with 8-bit sketches. Larger ones are dealt into ranges of
sizes (ends 1 / threshold apart); a set visits the next range too, so that every pair that can be similar meets in one of
bounded size. A node with over `node_limit` sets in one range is crowded: there the smallest set of each range, its hub,
is compared with the others, dealt out evenly. What matches makes clusters. What doesn't match, a stray, is then compared
exhaustively with the whole clusters of the hubs that it met and with their other strays; a cluster is dealt into parts
for this, once, however many nodes it crowds. Only nodes whose hubs' clusters have over `node_limit` strays in a range
branch on, into their children; those left at the last level, or once all that are left have no more than `finish` pairs,
are compared in pairs of blocks. So no partner is ever left out
for size, and no task holds more than a few times `node_limit` sets. The sketch test lets through what lies within 5
standard deviations of the threshold.

Equal sets are one element from the start. A node yields a spanning forest of the pairs that its sketches allow, never
all of its pairs. The clusters that these edges make are then confirmed on full sets: a cluster's texts meet once, in
blocks of a bounded number of shingles, where an exact prefix-filtered join finds the true links. So copies cost a link
each. Sets are of 64-bit hashes of shingles, and equal sets are told by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.llm import shingles as S
from factlens.llm.components import components
from factlens.llm.store import ship, written

T_VALUES = 128
#: Tables of at most so many rows are broadcast.
BROADCAST_ROWS = 500_000
_U = np.uint64


def _fixed(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A binary column of fixed width, without nulls, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype).reshape(len(column), -1)


def _featured(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, minhash = S.WordHashes(), S.Minhash(T_VALUES, seed)
        for b in batches:
            n, keys, sigs = [], [], []
            for t in b.column(1):
                s = S.shingle_set(t.as_py(), shingle, memory)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "set_key", "sig"]
            )

    return run


def _roots(trees: int, threshold: float, seed: int) -> list[tuple[int, int]]:
    """The positions that each tree's root picks; at least one."""
    rng = np.random.default_rng(seed)
    found = []
    for tree in range(trees):
        at = np.flatnonzero(rng.random(T_VALUES) < 1 / (threshold * T_VALUES))
        found += [(tree, int(i)) for i in (at if len(at) else [rng.integers(T_VALUES)])]
    return found


def _root_keys(roots: list[tuple[int, int]]):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _fixed(b.column(2), 4 * T_VALUES, np.uint32)
            rep, n = np.asarray(b.column(0)), np.asarray(b.column(1))
            salt = S.mix(np.array([tree * 1_000_003 + i + 1 for tree, i in roots], _U))
            keys = S.mix(sig[:, [i for _, i in roots]].astype(_U) + salt[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep, len(roots))), pa.array(np.repeat(n, len(roots)))], ["key", "rep", "n"])

    return run


def _child_keys(threshold: float):
    most = _U(int(2**64 / (threshold * T_VALUES)))
    at = S.mix(np.arange(1, T_VALUES + 1, dtype=_U))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, rep, n, comp = (np.asarray(b.column(i)) for i in range(4))
            key, sig = key.view(_U), _fixed(b.column(4), 4 * T_VALUES, np.uint32)
            picks = S.mix(key[:, None] ^ at[None, :]) < most
            picks[~picks.any(axis=1), 0] = True
            row, i = np.nonzero(picks)
            child = S.mix(S.mix(key[row] + _U(0x9E3779B97F4A7C15)) ^ S.mix(at[i] + sig[row, i]))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[row]), pa.array(n[row]), pa.array(comp[row])], ["key", "rep", "n", "comp"])

    return run


def _forest(ids, comp, near):
    """Edges of a spanning forest of the graph `near`, with the members of a component joined from the start."""
    free, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            same = np.flatnonzero((comp == comp[i]) & free)
            free[same] = False
            queue += same.tolist()
            new = np.flatnonzero(near[i] & free)
            if len(new):
                _, first = np.unique(comp[new], return_index=True)
                out += [(ids[i], ids[j]) for j in new[first]]
                free[new] = False
                queue += new.tolist()
    return out


def _compared(least: int, percent: int):
    """Rows (node, rep, comp, n, visiting, origin, sketch) sorted by node, n and rep -> (u, v, key).

    Where origin is null, the node is compared exhaustively, but for visitors with visitors, and gives the edges (u, v) of
    a spanning forest over its components. Otherwise its first row is the hub of (a part of) a range of the crowded node
    `origin`: rows that match it give an edge, the others are strays: (rep, null, origin).
    """

    def exhaustive(rep, comp, n, visiting, sketch):
        if len(rep) < 2 or (comp == comp[0]).all() or visiting.all():
            return []
        near = np.empty((len(rep), len(rep)), bool)
        for i in range(0, len(rep), 32):
            rows = slice(i, i + 32)
            near[rows] = (sketch[rows, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16) >= least
            near[rows] &= (100 * n[rows, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[rows, None])
        np.fill_diagonal(near, False)
        if visiting.any():
            near[np.ix_(visiting, visiting)] = False
        return _forest(rep.tolist(), comp, near)

    def run(batches):
        hub = None  # node, rep, comp, n and sketch of the first row of a part of a crowded range
        rest = None  # rows of a node that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            node, rep, comp, n, visiting = (np.asarray(b.column(i)) for i in range(5))
            origin, crowded = b.column(5), np.asarray(b.column(5).is_valid())
            visiting = visiting.astype(bool)
            sketch = _fixed(b.column(6), T_VALUES, np.uint8)
            edges: list[tuple[int, int]] = []
            strays: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[cuts[1:], len(node)]
            twos = []
            for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True):
                if crowded[lo]:
                    if hub is None or hub[0] != node[lo]:
                        hub = (node[lo], int(rep[lo]), comp[lo], n[lo], sketch[lo].copy())
                    key = origin[lo].as_py()
                    near = ((sketch[lo:hi] == hub[4][None, :]).sum(axis=1) >= least) & (100 * hub[3] >= percent * n[lo:hi])
                    joined = comp[lo:hi] == hub[2]
                    edges += [(hub[1], int(x)) for x in rep[lo:hi][near & ~joined]]
                    strays += [(int(x), key) for x in rep[lo:hi][~near & ~joined]]
                    continue
                part = (rep[lo:hi], comp[lo:hi], n[lo:hi], visiting[lo:hi], sketch[lo:hi])
                if rest is not None and rest[0] == node[lo]:
                    rest = (rest[0], *(np.concatenate(p) for p in zip(rest[1:], part, strict=True)))
                    if hi < len(node):
                        edges += exhaustive(*rest[1:])
                        rest = None
                    continue
                if rest is not None:
                    edges += exhaustive(*rest[1:])
                    rest = None
                if hi == len(node):
                    rest = (node[lo], *(x.copy() for x in part))
                elif hi - lo == 2:
                    twos.append(lo)
                elif hi - lo > 2:
                    edges += exhaustive(*part)
            if twos:
                i = np.array(twos)
                ok = ((sketch[i] == sketch[i + 1]).sum(axis=1) >= least) & (comp[i] != comp[i + 1]) & (100 * n[i] >= percent * n[i + 1])
                ok &= ~(visiting[i] & visiting[i + 1])
                edges += list(zip(rep[i][ok].tolist(), rep[i + 1][ok].tolist(), strict=True))
            if edges:
                yield _found_batch(_ordered(edges))
            if strays:
                yield _found_batch([(u, None, key) for u, key in strays])
        if rest is not None and (edges := exhaustive(*rest[1:])):
            yield _found_batch(_ordered(edges))

    return run


def _ordered(pairs):
    return [(min(p), max(p), None) for p in pairs]


def _found_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["u", "v", "key"])


def _pair_batch(pairs) -> pa.RecordBatch:
    p = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(p.min(axis=1)), pa.array(p.max(axis=1))], ["u", "v"])


def exact_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the graph of all pairs with 100 * |intersection| >= percent * |union|, exactly.

    Shingles are ordered by rarity; a pair that similar shares one among the first n - ceil(percent * n / 100) + 1 of
    both. Sets go by size; candidates of the same component are skipped, the others' intersections counted at once.
    """
    order = sorted((i for i in range(len(ids)) if len(sets[i])), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return []
    flat, sizes = np.concatenate([sets[i] for i in order]), np.array([len(sets[i]) for i in order])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranked = [np.sort(x) for x in np.split(rank[token], np.cumsum(sizes)[:-1])]
    rare = count[np.argsort(count, kind="stable")]  # how many sets have the token of a rank
    parent = list(range(len(order)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    postings: dict[int, list[int]] = {}
    marked = np.zeros(len(count), bool)
    links = []
    for k, r in enumerate(ranked):
        n = len(r)
        prefix = r[: n - -(-percent * n // 100) + 1]
        prefix = prefix[rare[prefix] > 1].tolist()
        seen: set[int] = set()
        for t in prefix:
            seen.update(postings.get(t, ()))
        by_root: dict[int, list[int]] = {}
        mine = find(k)
        for c in seen:
            if 100 * sizes[c] >= percent * n and (root := find(c)) != mine:
                by_root.setdefault(root, []).append(c)
        if by_root:
            among = [c for cs in by_root.values() for c in cs]
            marked[r] = True
            both = np.add.reduceat(marked[np.concatenate([ranked[c] for c in among])], np.r_[0, np.cumsum(sizes[among])[:-1]], dtype=np.int64)
            marked[r] = False
            for c in np.array(among)[100 * both >= percent * (n + sizes[among] - both)].tolist():
                a, b = find(k), find(c)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((ids[order[k]], ids[order[c]]))
        for t in prefix:
            postings.setdefault(t, []).append(k)
    return links


def _confirmed(shingle: int, percent: int):
    """Rows (block, rep, text) sorted by block -> true links; a block is complete when the next begins."""

    def links(ids, sets):
        by_id: dict[int, list[np.ndarray]] = {}
        for i, x in zip(ids, sets, strict=True):  # rows with one id and different texts are one document
            by_id.setdefault(i, []).append(x)
        pairs = [(i, x) for i, xs in by_id.items() for x in {x.tobytes(): x for x in xs}.values()]
        return [(a, b) for a, b in exact_links([i for i, _ in pairs], [x for _, x in pairs], percent) if a != b]

    def run(batches):
        memory, block, ids, sets = S.WordHashes(), None, [], []
        for batch in batches:
            found = []
            for k, rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != block:
                    found += links(ids, sets)
                    block, ids, sets = k, [], []
                ids.append(rep)
                sets.append(S.shingle_set(text.as_py(), shingle, memory))
            if found:
                yield _pair_batch(found)
        if found := links(ids, sets):
            yield _pair_batch(found)

    return run


def _confirm(clusters: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, block_shingles: int) -> DataFrame:
    """clusters(node, component) -> links(u, v) of full sets.

    A cluster with more than block_shingles shingles is dealt into parts by a hash, and each pair of parts is a block;
    so a block is bounded, and each pair of sets meets. Texts are fetched for the clusters' sets only.
    """
    spark = docs.sparkSession
    members = clusters.join(classes.select("rep", "n"), F.col("node") == F.col("rep")).select("rep", "n", "component")
    heavy = members.groupBy(F.col("component").alias("c")).agg(F.sum("n").alias("total")).filter(F.col("total") > block_shingles)
    parts = F.coalesce(F.ceil(F.col("total") / block_shingles), F.lit(1)).cast("int")
    own, other = F.pmod(F.xxhash64("rep"), parts), F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = members.join(heavy, F.col("component") == F.col("c"), "left").select("rep", "component", own.alias("own"), other.alias("other"))
    dealt = written(dealt.select("rep", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("block")), "dup-blocks")
    few = dealt.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(dealt) if few else dealt, F.col("id") == F.col("rep")).select("block", "rep", "text")
    rows = texts.repartition(_partitions(spark), "block").sortWithinPartitions("block", "rep")
    return rows.mapInArrow(_confirmed(shingle, percent), "u long, v long").distinct()


def _partitions(spark, least: int = 1) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def _few(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _found(dealt: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """dealt(node, rep, comp, visiting, origin) -> (u, v, key) of _compared."""
    full = dealt.join(classes.select("rep", "n", "sketch"), "rep").select("node", "rep", "comp", "n", "visiting", "origin", "sketch")
    sorted_ = full.repartition(_partitions(dealt.sparkSession), "node").sortWithinPartitions("node", "n", "rep")
    return sorted_.mapInArrow(_compared(least, percent), "u long, v long, key long").distinct()


def _sized(rows: DataFrame) -> DataFrame:
    """Adds the node's size; nodes of a single component drop out."""
    sizes = (
        rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    )
    return rows.join(sizes.select("k", "size"), F.col("key") == F.col("k")).drop("k")


def _range(percent: int):
    """The range of sizes of n; what can be similar lies in the same or the next one."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")


def _ranges(rows: DataFrame, node_limit: int, percent: int) -> DataFrame:
    """Of nodes with over node_limit sets: key, r, parts, hub (the set of the least size and rep), crowded (the node is)."""
    large = rows.filter(F.col("size") > node_limit).groupBy("key", _range(percent).alias("r")).agg(F.count("*").alias("c"), F.min(F.struct("n", "rep")).alias("least"))
    crowded = large.groupBy(F.col("key").alias("k")).agg((F.max("c") > node_limit).alias("crowded"))
    parts = F.ceil(F.col("c") / node_limit).cast("int").alias("parts")
    return large.join(crowded, F.col("key") == F.col("k")).select("key", "r", parts, F.col("least.rep").alias("hub"), "crowded")


def _dealt(rows: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """rows(key, rep, n, comp) -> (node, rep, comp, visiting, origin): a small node as it is, of a large one each set in its
    range and as a visitor in the next; of a crowded one each in a part of its range, and the hub in all parts."""
    at = ranges.select(F.col("key").alias("k"), F.col("r").alias("at"), "parts", "hub", "crowded")
    r, none = F.col("r"), F.lit(None).cast("long")
    place = lambda node, visiting, origin: F.struct(node.alias("node"), F.lit(visiting).alias("visiting"), origin.alias("origin"))
    mine = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    places = (
        F.when(F.col("k").isNull(), F.array(place(F.col("key"), False, none)))
        .when(F.col("crowded"), F.transform(mine, lambda p: place(F.xxhash64("key", r, p), False, F.col("key"))))
        .otherwise(F.array(place(F.xxhash64("key", r), False, none), place(F.xxhash64("key", r + 1), True, none)))
    )
    joined = rows.withColumn("r", _range(percent)).join(_few(at), (F.col("key") == F.col("k")) & (r == F.col("at")), "left")
    return joined.select("rep", "comp", F.explode(places).alias("p")).select("p.node", "rep", "comp", "p.visiting", "p.origin")


def _around_clusters(strays: DataFrame, hubs: DataFrame, few, clusters: DataFrame, named: DataFrame, classes: DataFrame, node_limit: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """strays(rep, key), hubs(key, r, cluster), clusters(node, component), named(rep, comp) -> (dealt rows, crowded(cluster)).

    A stray goes to the clusters of its node's hubs in its own range and both neighbours; where hubs of neighbouring ranges
    are of two clusters, the one's members go to the other. A cluster's members are dealt into parts; strays are in all.
    `few` marks what has no more rows than hubs for broadcast, if those are few.
    """
    of = classes.select("rep", "n")
    wide = hubs.select("key", "cluster", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r")).distinct()
    placed = strays.join(of, "rep").withColumn("r", _range(percent)).join(few(wide), ["key", "r"]).select("rep", "n", "cluster").distinct()
    next_ = hubs.select("key", (F.col("r") - 1).alias("r"), F.col("cluster").alias("other"))
    pairs = hubs.join(few(next_), ["key", "r"]).filter("cluster <> other").select("cluster", "other").distinct()
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("c")).union(hubs.select("cluster", "cluster")).distinct()
    crossing = members.join(few(pairs), F.col("other") == F.col("c")).select("rep", "cluster").join(of, "rep").select("rep", "n", "cluster")
    guests = placed.union(crossing).distinct().join(named, "rep").select("rep", "n", "cluster", "comp").filter("comp <> cluster")
    own = members.join(few(hubs.select("cluster").distinct()), F.col("c") == F.col("cluster")).select("rep", "cluster").join(of, "rep").select("rep", "n", "cluster", F.col("cluster").alias("comp"))
    rows = written(guests.union(own).withColumn("r", _range(percent)), "dup-around")
    # a range holds its own rows and the visitors from the one below
    both = F.array(F.struct(F.col("r").alias("at"), F.lit(False).alias("visiting")), F.struct((F.col("r") + 1).alias("at"), F.lit(True).alias("visiting")))
    at = rows.select("rep", "cluster", "comp", F.explode(both).alias("p")).select("rep", "cluster", "comp", "p.at", "p.visiting")
    mine = F.col("comp") == F.col("cluster")
    counts = at.groupBy("cluster", "at").agg(F.count_if(mine).alias("own"), F.count_if(~mine & ~F.col("visiting")).alias("guests"), F.count_if(~mine).alias("others"))
    limits = counts.select(
        F.col("cluster").alias("k"), F.col("at").alias("a"), F.greatest(F.ceil(F.col("own") / node_limit), F.lit(1)).cast("int").alias("parts"),
        (F.max("guests").over(Window.partitionBy("cluster")) > node_limit).alias("crowded"), "others",
    )
    limits = written(limits.coalesce(8), "dup-limits")  # a row for each range of a hub's cluster
    calm = at.join(_few(limits.filter("others > 0")), (F.col("cluster") == F.col("k")) & (F.col("at") == F.col("a"))).filter("NOT crowded")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = calm.withColumn("part", F.explode(F.when(mine, F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))).otherwise(everywhere)))
    none = F.lit(None).cast("long").alias("origin")
    return dealt.select(F.xxhash64("cluster", "at", "part").alias("node"), "rep", "comp", "visiting", none), limits.filter("crowded").select(F.col("k").alias("cluster")).distinct()


def _blocked(rows: DataFrame, node_limit: int) -> DataFrame:
    """Crowded nodes as nodes of two blocks each: every pair of blocks, and so every pair, meets once or more."""
    n = F.ceil(F.col("size") / node_limit).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    node = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("node")
    return dealt.select(node, "rep", "comp", F.lit(False).alias("visiting"), F.lit(None).cast("long").alias("origin"))


def _candidates(classes: DataFrame, trees: int, threshold: float, percent: int, node_limit: int, levels: int, finish: int, seed: int) -> DataFrame:
    """Edges (u, v) between classes that the sketches allow; they span the clusters of all such pairs that met."""
    least = int(T_VALUES * threshold - 5 * (T_VALUES * threshold * (1 - threshold)) ** 0.5)
    keys = classes.select("rep", F.col("n").cast("int").alias("n"), "sig").mapInArrow(_root_keys(_roots(trees, threshold, seed)), "key long, rep long, n int")
    nodes, edges = keys.withColumn("comp", F.col("rep")), None
    for level in range(1, levels + 1):
        rows = written(_sized(nodes), "dup-nodes")
        ranges = written(_ranges(rows, node_limit, percent).coalesce(8), "dup-ranges")  # a row for each range of a large node
        found = written(_found(_dealt(rows, ranges, percent), classes, least, percent), "dup-found")
        met = found.filter("v IS NOT NULL").select("u", "v")
        edges = met if edges is None else edges.union(met)
        crowded = ranges.filter("crowded")
        if crowded.isEmpty():
            break
        clusters = written(components(edges), "dup-clusters")
        hubs = crowded.join(clusters, F.col("hub") == F.col("node"), "left").select("key", "r", F.coalesce("component", "hub").alias("cluster"))
        hubs = written(hubs.coalesce(8), "dup-hubs")
        small = hubs.count() <= BROADCAST_ROWS
        few = F.broadcast if small else lambda table: table
        named = classes.select("rep").distinct().join(clusters, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp"))
        named = written(named, "dup-named")  # a row a class
        strays = found.filter("v IS NULL").select(F.col("u").alias("rep"), "key")
        dealt, still = _around_clusters(strays, hubs, few, clusters, named, classes, node_limit, percent)
        edges = edges.union(written(_found(dealt, classes, least, percent), "dup-found").select("u", "v"))
        # the nodes of clusters with too many strays branch, each by itself
        branching = hubs.join(few(still), "cluster").select(F.col("key").alias("k")).distinct()
        rows = rows.join(few(branching), F.col("key") == F.col("k"), "left_semi")
        pairs = (rows.agg(F.sum("size").alias("s")).first()["s"] or 0) // 2
        if not pairs:
            break
        deep = rows.select("key", "rep", "n").join(named, "rep").select("key", "rep", "n", "comp")
        if pairs <= finish or level + 1 >= levels:
            blocks = _blocked(written(_sized(deep), "dup-nodes"), node_limit)
            edges = edges.union(written(_found(blocks, classes, least, percent), "dup-found").select("u", "v"))
            break
        deep = deep.join(classes.select("rep", "sig"), "rep").select("key", "rep", "n", "comp", "sig")
        nodes = deep.mapInArrow(_child_keys(threshold), "key long, rep long, n int, comp long").distinct()
    return edges


def _same_id(linkable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that have one id and different texts."""
    twice = linkable.groupBy("id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).filter("a <> b").select(F.col("id").alias("i"))
    twice = written(twice, "dup-ids")
    if twice.isEmpty():
        return classes.sparkSession.createDataFrame([], "u long, v long")
    reps = linkable.join(twice, F.col("id") == F.col("i")).select("id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key").select("id", "rep")
    first = reps.groupBy(F.col("id").alias("i")).agg(F.min("rep").alias("u"))
    return reps.join(first, F.col("id") == F.col("i")).filter("u <> rep").select("u", F.col("rep").alias("v"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    trees: int = 24, node_limit: int = 1536, levels: int = 6, finish: int = 50_000_000, block_shingles: int = 750_000, seed: int = 20_240_501,
) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (least id reachable), kept (the id is the component's).

    Links: 100 * |intersection| >= percent * |union| of whole shingle sets. Texts without a word (null and empty ones
    too) have no set and no links. Rows with one id are one document. A row without an id links with nothing; its
    component is null and it is kept. An empty table gives an empty result; other columns are left out.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    featured = written(docs.mapInArrow(_featured(shingle, seed), "id long, n long, set_key binary, sig binary"), "dup-sets")
    linkable = featured.filter("n > 0 AND id IS NOT NULL")
    classes = linkable.groupBy("set_key", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")).select("set_key", "rep", "sig", "n")
    classes = written(classes.mapInArrow(_with_sketch, "set_key binary, rep long, sig binary, n long, sketch binary"), "dup-classes")
    clusters = written(components(_candidates(classes, trees, percent / 100, percent, node_limit, levels, finish, seed)), "dup-clusters")
    links = written(_confirm(clusters, classes, docs, shingle, percent, block_shingles), "dup-links")
    comps = written(components(links.union(_same_id(linkable, classes))), "dup-comps")

    of_class = classes.select("set_key", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    slim = featured.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("set_key")).alias("set_key"))
    alone = slim.filter("set_key IS NULL").select("id", "n", F.col("id").alias("component"))
    joined = slim.filter("set_key IS NOT NULL").join(of_class, "set_key").select("id", "n", "component").union(alone)
    return joined.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _with_sketch(batches):
    for b in batches:
        if b.num_rows:
            sketch = _fixed(b.column(2), 4 * T_VALUES, np.uint32).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in sketch], pa.binary())], ["set_key", "rep", "sig", "n", "sketch"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of near-duplicates, columns as they were.

    Of rows with one id, the one with the least text stays (a null text last). Rows without an id all stay.
    """
    dropped = near_duplicates(docs, id_col, text_col, **how).filter("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    rest = docs.join(_few(written(dropped, "dup-dropped")), F.col(id_col) == F.col("__id"), "left_anti")
    twice = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    twice = written(twice, "dup-twice")
    if twice.isEmpty():
        return rest
    again = F.col(id_col) == F.col("__id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rest.join(_few(twice), again, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min_by(row, F.struct(F.col(text_col).isNull(), F.col(text_col))).alias("__row"))
    return rest.join(_few(twice), again, "left_anti").unionByName(one.select("__row.*"))
