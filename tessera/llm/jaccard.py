"""Exact Jaccard join of documents on word shingles, as a join in a metric space.

Documents with one set of shingles form a class, and classes are joined by their Jaccard distance.

1. The first pivots are the single shingles. A class is at distance 1 - 1/n from each of its n shingles and 1 from all
   others; of its nearest pivots the one that comes first in an order common to all (rare and long shingles first) is its
   region. Within the join's radius a partner holds all but n - ceil(t n) of the class's shingles, so the
   class is replicated to that many regions more, and any two linked classes meet in one.
2. In a region, classes are points in a space of parities: bit i tells whether an odd number of the set's hashes end in i.
   Two parities' Hamming distance is never more than the symmetric difference of the sets, and near it, as there are twice as
   many bits as shingles or more; folding the longer one in half makes parities of two sizes comparable. A region is searched from one pivot after another; only points in the window that the
   triangle inequality leaves around the pivot's distance to an origin are compared. In a large region all are first compared
   with one representative, so that a crowd of near copies is one component at once, and only what that has no link to with
   everything. Where much is left, the region is cut by windows around such an origin, with the points at the borders in both
   windows, again and again while that helps, and then into blocks. What comes out is a forest of possible links for each region.
3. The components of these forests hold all links between their members and few others. Each is joined exactly, set by set,
   large ones by a representative and in blocks, too. The components of the exact links are the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.reduce import sum_vectors
from tessera.plans.shipping import ships

from .common import cut, join_hot, map_text, slices, tidy
from .components import components
from .shingles import shingled

#: Production parameters: bits of a parity at least and at most, counters of the shingle sketch and how far above their mean one counts as common.
BITS, MOST_BITS, COUNTERS, COMMON = 256, 1 << 17, 1 << 20, 4
#: Classes of a region, and bytes of sets of a component, that one task compares; classes of possible links that are broadcast at most.
REGION, COMPONENT_BYTES, BROADCAST = 8192, 32 << 20, 200_000
TEXT_BYTES = 1 << 18
#: Members from which a representative is chosen.
CENTRAL = 16
#: A class's number ends in the class of its size, of so many, which grow by this factor.
SIZE_CLASSES, SIZE_STEP = 256, 1.05


def least_shared(n: int | np.ndarray, t: tuple[int, int]):
    """The fewest of n shingles that a linked set shares: the ceiling of t n."""
    return -(-n * t[0] // t[1])


def _sets(batch: pa.RecordBatch, text: str, n: int):
    """For each row of the batch its set (sorted hashes) and the bytes of each shingle's words."""
    hashes, size, where = shingled(batch[text], n)
    for a, b in zip(where, where[1:]):
        own, first = np.unique(hashes[a:b], return_index=True)
        yield own, size[a:b][first]


def sketch(df: DataFrame, text_col: str, n: int, counters: int = COUNTERS) -> np.ndarray:
    """How common the shingles of each counter are: 0 for ordinary ones, else 1 plus the binary logarithm of the excess. Its size is fixed."""
    pieces = 16
    side = counters // pieces

    def count(batches):
        total = None
        for batch in slices(batches, text_col, TEXT_BYTES):
            hashes, _, _ = shingled(batch[text_col], n)
            if len(hashes):
                total = np.zeros(counters, np.uint32) if total is None else total
                np.add.at(total, (hashes >> np.uint64(40)).astype(np.int64) % counters, np.uint32(1))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int64()), pa.array([total[k * side : (k + 1) * side].tobytes() for k in range(pieces)], pa.binary())], names=["k", "v"])
        tidy()

    counts = np.zeros(counters)
    for r in sum_vectors(df.select(text_col).mapInArrow(count, "k long, v binary"), "<u4").collect():
        counts[r.k * side : (r.k + 1) * side] = np.frombuffer(r.v)
    excess = counts / (64 + COMMON * counts.mean())
    return np.where(excess > 1, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def parity_of(hashes: np.ndarray) -> bytes:
    """The parity of a set: a power of 2 of bits, twice as many as hashes or more within BITS and MOST_BITS."""
    bits = min(MOST_BITS, max(BITS, 1 << (2 * len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of 64-bit words) of so many words, by adding halves."""
    while parity.shape[1] > words:
        half = parity.shape[1] // 2
        parity = parity[:, :half] ^ parity[:, half:]
    return parity


def signatures(df: DataFrame, common: np.ndarray, id_col: str, text_col: str, n: int, t: tuple[int, int], whole: bool = True) -> DataFrame:
    """id_col, n (size of the set), sig (16 bytes that name the set; null if empty), and if whole: parity (binary), origin (the same folded to BITS), regions (array of the shingles whose regions hold the class)."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        levels = shared.value
        sizes, sigs, parities, origins, regions = [], [], [], [], []
        for own, size in _sets(batch, text_col, n):
            sizes.append(len(own))
            if not whole:
                sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                continue
            if not len(own):
                sigs.append(None)
                parities.append(None)
                origins.append(None)
                regions.append(None)
                continue
            sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            parities.append(parity_of(own))
            origins.append(folded(np.frombuffer(parities[-1], np.uint64)[None], BITS // 64).tobytes())
            order = np.lexsort((own, -size, levels[(own >> np.uint64(40)).astype(np.int64) % len(levels)]))
            regions.append(own[order[: len(own) - least_shared(len(own), t) + 1]].view(np.int64))
        if not whole:
            return pa.RecordBatch.from_arrays([batch[id_col], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=[id_col, "n", "sig"])
        return pa.RecordBatch.from_arrays([batch[id_col], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(parities, pa.binary()), pa.array(origins, pa.binary()), pa.array(regions, pa.list_(pa.int64()))], names=[id_col, "n", "sig", "parity", "origin", "regions"])

    more = ", parity binary, origin binary, regions array<long>" if whole else ""
    return map_text(df, [id_col], text_col, f, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n long, sig binary{more}", TEXT_BYTES)


def possible_links(sizes: np.ndarray, parities: list[bytes], t: tuple[int, int], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest over the points whose sets may be linked: sizes compatible, and Hamming distance of the parities within the bound of the symmetric difference.

    left: True for the points of one block of two; links within a block aren't looked for then. Points are sorted by their
    distance to the first point (the pivot of the region); a point's partners lie in a window around its own distance.
    """
    p, q = t
    m = len(sizes)
    words = np.array([len(x) // 8 for x in parities])
    least = int(words.min())
    short = np.empty((m, least), np.uint64)
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        short[at] = folded(np.frombuffer(b"".join(parities[i] for i in at), np.uint64).reshape(-1, w), least)
    from_pivot = np.bitwise_count(short ^ short[0]).sum(1, dtype=np.int64)
    order = np.argsort(from_pivot, kind="stable")
    sizes, words, from_pivot = sizes[order], words[order], from_pivot[order]
    side = None if left is None else left[order]
    place = np.empty(m, np.int64)
    whole: dict[int, np.ndarray] = {}
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        place[at] = np.arange(len(at))
        whole[int(w)] = np.frombuffer(b"".join(parities[order[i]] for i in at), np.uint64).reshape(-1, w)

    def apart(x: int, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        own = whole[int(words[x])][place[x]][None]
        for w in np.unique(words[at]):
            of = words[at] == w
            common = int(min(w, words[x]))
            out[of] = np.bitwise_count(folded(whole[int(w)][place[at[of]]], common) ^ folded(own, common)).sum(1, dtype=np.int64)
        return out

    reach = (q - p) * 2 * int(sizes.max()) // (q + p)
    open_ = np.ones(m, bool)
    links = []
    for root in range(m):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            a, b = np.searchsorted(from_pivot, (from_pivot[x] - reach, from_pivot[x] + reach + 1))
            at = a + np.flatnonzero(open_[a:b])
            if side is not None:
                at = at[side[at] != side[x]]
            at = at[(q * np.minimum(sizes[at], sizes[x]) >= p * np.maximum(sizes[at], sizes[x]))]
            if not len(at):
                continue
            at = at[(q + p) * apart(x, at) <= (q - p) * (sizes[at] + sizes[x])]
            open_[at] = False
            links += [(int(order[x]), int(order[y])) for y in at]
            queue += at.tolist()
    return links


def near_first(sizes: np.ndarray, parities: list[bytes], t: tuple[int, int]) -> np.ndarray:
    """Which points may be linked to the first one, as in possible_links."""
    p, q = t
    words, own = np.array([len(x) // 8 for x in parities]), np.frombuffer(parities[0], np.uint64)[None]
    apart = np.empty(len(sizes), np.int64)
    for w in np.unique(words):
        at, common = np.flatnonzero(words == w), min(int(w), own.shape[1])
        of = np.frombuffer(b"".join(parities[i] for i in at), np.uint64).reshape(-1, w)
        apart[at] = np.bitwise_count(folded(of, common) ^ folded(own, common)).sum(1, dtype=np.int64)
    return (q * np.minimum(sizes, sizes[0]) >= p * np.maximum(sizes, sizes[0])) & ((q + p) * apart <= (q - p) * (sizes + sizes[0]))


def linked(a: np.ndarray, b: np.ndarray, t: tuple[int, int]) -> bool:
    """Whether two sets are linked: t[1] * intersection >= t[0] * union."""
    if t[1] * min(len(a), len(b)) < t[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return t[1] * both >= t[0] * (len(a) + len(b) - both)


def exact_links(sets: list[np.ndarray], t: tuple[int, int], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest over the sets that are linked. left as above.

    First all are compared with one of them, the representative; those linked to it are one component already. Only the others
    are compared with everything: exact counts within the group order the shingles, rarest first, and two linked sets share one
    of the first n - ceil(t n) + 1 of either, so that an index of the others by these finds all their partners.
    """
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links: list[tuple[int, int]] = []
    others = list(range(len(sets))) if left is None else np.flatnonzero(left).tolist()
    if left is None and len(sets) > 2:
        one = sorted(others, key=lambda i: len(sets[i]))[len(sets) // 2]
        links = [(one, x) for x in others if x != one and linked(sets[one], sets[x], t)]
        for _, x in links:
            parent[x] = one
        others = [x for x in others if parent[x] != one]
    if not others:
        return links
    every = np.concatenate(sets)
    ids, place, often = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, often))] = np.arange(len(ids))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    first = [np.sort(rank[place[a:b]])[: b - a - least_shared(b - a, t) + 1].tolist() for a, b in zip(bounds, bounds[1:])]
    holders: dict[int, list[int]] = {}
    for x in others:
        for s in first[x]:
            holders.setdefault(s, []).append(x)
    for y in range(len(sets)):
        if left is not None and left[y]:
            continue
        for x in sorted({x for s in first[y] for x in holders.get(s, ())}):
            if find(x) != find(y) and linked(sets[x], sets[y], t):
                parent[find(x)] = find(y)
                links.append((x, y))
    return links


def _groups(batches, keys: list[str]):
    """Runs of equal keys in batches that are sorted by them, as one table each."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_pylist() for k in keys]
        now = list(zip(*columns))
        cuts = [0, *(i for i in range(1, len(now)) if now[i] != now[i - 1]), len(now)]
        for a, b in zip(cuts, cuts[1:]):
            if last is not None and now[a] != last:
                yield pa.Table.from_batches(open_)
                open_ = []
            last = now[a]
            open_.append(batch.slice(a, b - a))
    if open_:
        yield pa.Table.from_batches(open_)


_EDGES = "a long, b long"


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])


def _per_group(df: DataFrame, keys: list[str], pairs_of) -> DataFrame:
    """Edges from pairs_of(table, left) for each group of df, streamed; df is dealt out by keys. Column left, if there, tells the blocks apart."""

    def run(batches):
        made: list[tuple[int, int]] = []
        for group in _groups(batches, keys):
            cid = group["cid"].to_pylist()
            left = np.array(group["left"].to_pylist()) if "left" in group.column_names else None
            if left is not None and left.all():  # a block with itself
                left = None
            made += [(cid[x], cid[y]) for x, y in pairs_of(group, left)]
            if len(made) > 20_000:
                yield _edge_batch(made)
                made = []
        yield _edge_batch(made)
        tidy()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _EDGES)


def _blocks(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows of a group in so many blocks, each replicated to the pairs of blocks that it is part of: columns i, j, left."""
    df = df.withColumn("_own", F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))).alias("_other")
    df = df.select("*", other)
    return df.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "left": F.col("_own") <= F.col("_other")}).drop("_own", "_other")


def _star(df: DataFrame, key: str, blocks: str, columns: list[str], near) -> tuple[DataFrame, DataFrame]:
    """Compares every member of each group (columns key, cid, columns, and blocks, their number) with the group's representative, which each block gets: of CENTRAL members by hash the one with links to most of them.

    Edges to the representative, and key, cid of the members that it has no link to. Near copies of one text are one component
    then, at a cost in proportion to their number. near(group) tells which rows of a table are linked to its first row.
    """
    df = df.select(key, "cid", blocks, *columns)
    some = df.groupBy(key, F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(CENTRAL))).agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid", blocks, *columns)).alias("one")).select(key, "one.*")

    def central(batches):
        for group in _groups(batches, [key]):
            rows = range(len(group))
            best = max(rows, key=lambda k: int(np.sum(near(group.take([k, *(i for i in rows if i != k)])))))
            yield from group.slice(best, 1).to_batches()

    one = some.repartition(key).sortWithinPartitions(key, "h").mapInArrow(central, some.schema)
    block = F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
    places = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    dealt = df.withColumns({"i": block, "member": F.lit(1)}).unionByName(one.drop("h").withColumns({"i": places, "member": F.lit(0)}))

    def run(batches):
        for group in _groups(batches, [key, "i"]):
            cid = group["cid"].to_pylist()
            found = pa.array([cid[0] if x else None for x in near(group)], pa.int64())
            yield pa.RecordBatch.from_arrays([group[key].combine_chunks(), group["cid"].combine_chunks(), found], names=[key, "a", "b"])
        tidy()

    kind = df.schema[key].dataType.simpleString()
    star = cut(dealt.repartition(key, "i").sortWithinPartitions(key, "i", "member").mapInArrow(run, f"{key} {kind}, a long, b long"))
    return star.filter("a <> b").select("a", "b"), star.filter("b IS NULL").select(key, F.col("a").alias("cid"))


def _others(df: DataFrame, others: DataFrame, key: str, blocks: str, columns: list[str], pairs_of) -> DataFrame:
    """Edges among the others of each group, and between them and the rest, in pairs of blocks: as many rows as others and rest, if the others fit into one block."""
    counts = others.groupBy(key).agg(F.count("*").alias("n_others"))
    sizes = df.groupBy(key).agg(F.count("*").alias("n_all")).join(counts, key)
    marked = df.join(sizes, key).join(others.withColumn("other", F.lit(True)), [key, "cid"], "left").withColumn("other", F.coalesce("other", F.lit(False)))
    marked = cut(marked.withColumn("other_blocks", F.greatest(F.lit(1), F.ceil(F.col(blocks) * F.col("n_others") / F.col("n_all"))).cast("int")))
    apart, block = marked.filter("other"), lambda b: F.pmod(F.xxhash64("cid"), F.col(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    first = apart.withColumns({"i": block("other_blocks"), "left": F.lit(True)}).withColumn("j", every(blocks))
    second = marked.filter("NOT other").withColumns({"j": block(blocks), "left": F.lit(False)}).withColumn("i", every("other_blocks"))
    across = first.unionByName(second).select(key, "cid", *columns, "i", "j", "left")
    return _per_group(across, [key, "i", "j"], pairs_of).unionByName(_per_group(_blocks(apart.select(key, "cid", "other_blocks", *columns), key, "other_blocks"), [key, "i", "j"], pairs_of))


def _cut_by_windows(members: DataFrame, t: tuple[int, int], region: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Cuts the regions with more than region members by windows of size and of distance to an origin; (small ones, what stays large). Columns key, cid, n, parity, origin."""
    p, q = t
    done = None
    for turn in range(rounds):
        counts = members.groupBy("key").agg(F.count("*").alias("members"))
        members = members.join(counts, "key")
        small, large = members.filter(F.col("members") <= region).drop("members"), members.filter(F.col("members") > region).drop("members")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done, large
        if turn == 0:
            # log base q/p of n: linked sizes differ by a factor of q/p at most, so that neighbouring windows overlap
            at = F.floor(F.log(F.col("n").cast("double")) / float(np.log(q / p)) + 1e-9).cast("long")
        else:
            origin = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), F.col("origin"))).alias("o"), F.max("n").alias("widest")).select("key", F.col("o.origin").alias("_o"), "widest")
            large = large.join(origin, "key")
            bits = sum(F.bit_count(F.conv(F.hex(F.substring("origin", 1 + 4 * k, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring("_o", 1 + 4 * k, 4)), 16, 10).cast("long"))) for k in range(BITS // 32))
            at = F.floor(bits / F.greatest(F.lit(1), F.floor(F.lit((q - p) * 2) * F.col("widest") / F.lit(q + p)))).cast("long")
        large = large.withColumn("_at", F.explode(F.array(at, at + 1))).withColumn("key", F.xxhash64("key", "_at", F.lit(turn))).select("key", "cid", "n", "parity", "origin")
        members = cut(large)
    counts = members.groupBy("key").agg(F.count("*").alias("members"))
    members = members.join(counts, "key")
    return done.unionByName(members.filter(F.col("members") <= region).drop("members")), members.filter(F.col("members") > region).drop("members")


def candidate_links(classes: DataFrame, t: tuple[int, int], region: int = REGION) -> DataFrame:
    """Edges (a, b of cid) such that linked classes are connected. classes: cid, n, parity, origin, regions."""
    rows = classes.select("cid", F.explode("regions").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    rows = cut(rows.join(shared, "key"))
    own = F.xxhash64("cid")
    cells = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("cid").alias("a"), F.max("cid").alias("b"), F.bit_xor(own).alias("h1"), F.sum(F.pmod(own, F.lit(1 << 40))).alias("h2"))
    # regions with one and the same set of members need be searched once, and those of two members only if their sizes allow a link
    cells = cut(cells.groupBy("members", "a", "b", "h1", "h2").agg(F.min("key").alias("key")))
    fits = F.abs(F.col("a") % SIZE_CLASSES - F.col("b") % SIZE_CLASSES) <= int(np.log(t[1] / t[0]) / np.log(SIZE_STEP)) + 1
    parity = classes.select("cid", F.col("n").cast("int").alias("n"), "parity")
    searched = cells.filter(F.col("members").between(2, region) & (fits | (F.col("members") > 2))).select("key")
    members = rows.drop("members").join(searched, "key").join(parity, "cid").select("key", "cid", "n", "parity")

    def pairs_of(group: pa.Table, left):
        return possible_links(group["n"].to_numpy().astype(np.int64), group["parity"].to_pylist(), t, left)

    found = _per_group(members, ["key"], pairs_of)
    hot = cells.filter(F.col("members") > region).select("key", F.ceil(F.col("members") * 2 / region).cast("int").alias("blocks"))
    if hot.isEmpty():
        return found.distinct()
    near = lambda group: near_first(group["n"].to_numpy().astype(np.int64), group["parity"].to_pylist(), t)
    columns = ["n", "parity"]
    hot = cut(rows.drop("members").join(hot, "key").join(classes.select("cid", F.col("n").cast("int").alias("n"), "parity", "origin"), "cid").select("key", "cid", "blocks", "n", "parity", "origin"))
    edges, others = _star(hot, "key", "blocks", columns, near)
    found = found.unionByName(edges)
    left = cut(others.groupBy("key").agg(F.count("*").alias("n")))
    few, many = left.filter(F.col("n") <= region).select("key"), left.filter(F.col("n") > region).select("key")
    found = found.unionByName(_others(hot.join(few, "key").drop("origin"), others.join(few, "key"), "key", "blocks", columns, pairs_of))
    if not many.isEmpty():
        small, large = _cut_by_windows(cut(hot.join(many, "key").drop("blocks")), t, region)
        found = found.unionByName(_per_group(small, ["key"], pairs_of))
        if not large.isEmpty():
            counts = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / region).cast("int").alias("blocks"))
            large = cut(large.join(counts, "key"))
            edges, others = _star(large, "key", "blocks", columns, near)
            found = found.unionByName(edges).unionByName(_others(large, others, "key", "blocks", columns, pairs_of))
    return found.distinct()


def sets_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of wanted (sig, doc, cid, root, blocks) with shingles (binary), from the documents that stand for the classes.

    If wanted has at most broadcast rows, tasks get it and look at its documents alone; otherwise texts and classes are joined.
    A document that is there twice gives its row twice.
    """
    few = wanted.limit(broadcast + 1).collect()
    chosen = df.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    shared = None
    if len(few) <= broadcast:
        shared = df.sparkSession.sparkContext.broadcast(({r.doc for r in few}, {bytes(r.sig): (r.cid, r.root, r.blocks) for r in few}))
    else:
        ids = wanted.select(F.col("doc").alias("_id")).distinct()
        chosen = chosen.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared is not None:
            docs = shared.value[0]
            batch = batch.filter(pa.array([x in docs for x in batch["_doc"].to_pylist()], pa.bool_()))
        sets = [own for own, _ in _sets(batch, "_text", n)] if batch.num_rows else []
        sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        known = shared.value[1] if shared is not None else {}
        rows = [(sig, s.tobytes(), *known.get(sig, (None, None, None))) for s, sig in zip(sets, sigs) if len(s) and (shared is None or sig in known)]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sig", "shingles", "cid", "root", "blocks"])

    made = map_text(chosen, ["_doc"], "_text", f, "sig binary, shingles binary, cid long, root long, blocks int", TEXT_BYTES)
    if shared is None:
        made = made.select("sig", "shingles").join(wanted.select("sig", "cid", "root", "blocks"), "sig")
    return made.select("cid", "root", "blocks", "shingles")


def join_links(classes: DataFrame, df: DataFrame, id_col: str, text_col: str, n: int, t: tuple[int, int], region: int = REGION, component_bytes: int = COMPONENT_BYTES) -> DataFrame:
    """Edges (a, b of cid): a forest over the linked classes. classes: cid, sig, doc (a document that has the set), n, parity, origin, regions."""
    coarse = cut(components(candidate_links(classes, t, region)))
    coarse = coarse.join(classes.select("cid", "sig", "doc", "n"), coarse["node"] == classes["cid"]).select("root", "cid", "sig", "doc", "n")
    blocks = F.when(F.col("shingles") * 8 > component_bytes, F.ceil(F.col("shingles") * 16 / component_bytes)).otherwise(1).cast("int")
    sizes = coarse.groupBy("root").agg(F.sum("n").alias("shingles")).select("root", blocks.alias("blocks"))
    coarse = cut(coarse.join(sizes, "root").select("cid", "sig", "doc", "root", "blocks"))
    members = sets_of(df, coarse, id_col, text_col, n)

    def pairs_of(group: pa.Table, left):
        return exact_links([np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()], t, left)

    def near(group: pa.Table) -> list[bool]:
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        return [linked(sets[0], s, t) for s in sets]

    found = _per_group(members.filter("blocks = 1"), ["root"], pairs_of)
    if coarse.filter("blocks > 1").isEmpty():
        return found
    members = cut(members.filter("blocks > 1"))
    edges, others = _star(members, "root", "blocks", ["shingles"], near)
    found = found.unionByName(edges)
    return found if others.isEmpty() else found.unionByName(_others(members, others, "root", "blocks", ["shingles"], pairs_of))


@ships
def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100), region: int = REGION, component_bytes: int = COMPONENT_BYTES) -> DataFrame:
    """id_col, n_shingles, component_id of every row: the least id that is reachable by links.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
    words words, or with fewer words the whole sequence. Two documents are linked if threshold[1] * intersection >=
    threshold[0] * union. A null text, or one without words, has an empty set and is linked with nothing, so that its
    component is its own id. Rows with the same id and different texts are documents of their own that share the id. An empty
    table gives an empty one; other columns are ignored. A null id is the component of its group only if the group has no
    other. Shingles are held as 64-bit hashes.
    """
    common = sketch(df, text_col, words)
    signed = signatures(df, common, id_col, text_col, words, threshold).withColumnRenamed(id_col, "doc")
    classes = cut(signed.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc").alias("doc"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("origin").alias("origin"), F.first("regions").alias("regions")))
    size_class = F.least(F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZE_STEP))), F.lit(SIZE_CLASSES - 1)).cast("long")
    classes = classes.withColumn("cid", F.monotonically_increasing_id() * SIZE_CLASSES + size_class)  # of rows that are written, so that it can't change
    found = components(join_links(classes, df, id_col, text_col, words, threshold, region, component_bytes))
    found = found.join(classes.select(F.col("cid").alias("node"), "sig", "doc"), "node")
    found = cut(found)
    least = found.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("rows"))
    joined = join_hot(found, least, "root", found.count()).select("sig", "component_id")
    of = classes.select("sig", "rows", F.col("doc").alias("_own")).join(joined, "sig", "left").select("sig", "rows", F.coalesce("component_id", "_own").alias("component_id"))
    # the documents' own rows are made again, without what only classes need, which is not worth the disk
    signed = cut(signatures(df, common, id_col, text_col, words, threshold, whole=False).withColumnRenamed(id_col, "doc"))
    named = signed.filter("sig IS NOT NULL").select("doc", "n", "sig")
    whole = join_hot(named, of, "sig", named.count()).select("doc", "n", "component_id")
    whole = whole.unionByName(signed.filter("sig IS NULL").select("doc", "n", F.col("doc").alias("component_id")))
    return whole.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
