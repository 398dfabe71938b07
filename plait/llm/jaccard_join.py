"""Operator 2: exact n-gram Jaccard join in the metric space of shingle sets.

Two documents link when 100 * |x & y| >= 80 * |x | y| over their sets of
distinct word shingles; documents of one set are copies and link. Jaccard
distance d = 1 - |x & y| / |x | y| is a metric; the radius is 0.2.

1. Each text's shingles are hashed (64 bits) on the executors, dealt out by
   hash range in packed blocks, and counted by distinct sets. Only a shingle of
   two sets or more can lie in an intersection, so a set keeps those alone
   (with its full size), and a set with more than a fifth of its shingles to
   itself can link with no other. A shingle of very many sets of one block is
   known to be shared without a count: it comes last in the order, and its sets
   don't meet in its range's task.
2. First pivots. Documents as pivots would all lie at distance 1 from unrelated
   texts, so the first regions come from rare shingles: of a linked pair, the
   smaller set has a common shingle among its |x| / 9 + 1 rarest, and the other
   one the same shingle among its |y| / 5 + 1 rarest. The least such smaller set
   is the pivot of the shingle's region, and regions of one pivot are its cell:
   every linked pair lies together in one cell at least.
3. Every member's exact distance to its cell's pivot is computed. Those within
   the radius link to it, and components of these links settle tight families
   at a multiple of their size: pairs within one component need no look. What
   is left of a cell are its open members, those outside its main component,
   each against all members.
4. Voronoi recursion. A cell with too many pairs left takes further pivots from
   its open members; every member's distances to them are computed in blocks.
   An open member belongs to its nearest pivot's region (Voronoi); a member x
   visits every region q with d(x, q) <= d(x, nearest) + 2 * radius and d(x, q)
   within the radius of the distances to q that the region's own members have:
   both follow from the triangle inequality for any x that links with one of
   them. Regions recurse, until they are small or no pivot tells members apart.
5. Windows. Within a region members are dealt to rings by their distance to its
   pivot; a ring's own members meet the visitors of that ring and the next ones
   on either side, |d(x, q) - d(y, q)| <= radius, and only pairs that pass this
   window and the sizes' are intersected.
6. Connected components, least doc_id.

No step drops or caps a partner. Rings are cut in blocks by their number of
shingles, so none lands in one task.

Defined edge cases: a null, empty or blank text has an empty set, links with
nothing and is its own component; a text of 1 to 4 words has its whole sequence
as its one shingle; rows that repeat a doc_id are separate members of one
component if they link; a null doc_id never is a component's id unless all its
members have none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import discard, materialize, releasing, shuffle_parts, slices, table
from plait.llm.components import components
from plait.llm.textvec import U, batches, mix, shingle_sets

#: Shingles and sets of a packed block; shingles of a block of a ring; bytes of text of a hash range.
_FLUSH, _ROWS = 1_000_000, 16_384
_WEIGHT = 65_536
_RANGE = 24 << 20
#: A shingle of so many sets of one block isn't counted, and comes last in the order.
_HOT = 256
#: Sets that a task remembers, so as not to send their copies.
_SEEN = 1 << 20
_DOCS = [("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("text_hash", pa.int64())]
_PACKED = pa.schema(
    [("bucket", pa.int32()), *[(c, pa.binary()) for c in ("entries", "owner", "node", "hot", "hot_node", "hot_id")], *[(c, pa.list_(t)) for c, t in _DOCS]]
)
_SCHEMA = "bucket int, entries binary, owner binary, node binary, hot binary, hot_node binary, hot_id binary, " + ", ".join(f"{c} array<bigint>" for c, _ in _DOCS)
_COUNTED = pa.schema([("kind", pa.string()), *_DOCS, ("ids", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32()))])
_OUT = "kind string, " + ", ".join(f"{c} bigint" for c, _ in _DOCS) + ", ids array<bigint>, dfs array<int>"


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat ^ U(salt)))])
        out.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(U)).view(np.int64))
    return n, out[0], out[1]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: where each value begins, and how often it comes."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.concatenate([at, [len(x)]]))


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range, by the high 32 bits."""
    return ((h >> U(32)) * U(parts)) >> U(32)


def _named(h: np.ndarray, bucket) -> np.ndarray:
    """The name of a shingle: its low 7 bytes, and its range."""
    return (h & U(2**56 - 1)) | (np.asarray(bucket, U) << U(56))


def _seven(h: np.ndarray) -> np.ndarray:
    """The low 7 bytes of hashes."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7])


def _eight(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return wide.view(U).ravel()


def _blocks(ids: list, text_hashes: list, sets: list[np.ndarray], parts: int, turn: int, seen: set[int]) -> pa.RecordBatch:
    """The shingles of some documents, packed by hash range, and a row of the documents themselves."""
    n, h1, h2 = _set_hashes(sets)
    some = np.flatnonzero(n)
    node, first = np.unique(h1[some], return_index=True)
    new = np.array([x not in seen for x in node.tolist()], bool)
    keep, node = some[first[new]], node[new]
    if len(seen) > _SEEN:
        seen.clear()
    seen.update(node.tolist())
    flat = np.concatenate([sets[i] for i in keep]) if len(keep) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(keep), dtype=np.uint16), n[keep])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    at, count = _runs(flat)
    hot = flat[at[count >= _HOT]]
    is_hot = np.repeat(count >= _HOT, count)
    hot_node, hot_id = node[owner[is_hot]], _named(flat[is_hot], _bucket(flat[is_hot], parts))
    flat, owner = flat[~is_hot], owner[~is_hot]
    edges = np.arange(parts + 1, dtype=U)
    cut, hot_cut = np.searchsorted(_bucket(flat, parts), edges), np.searchsorted(_bucket(hot, parts), edges)
    low, hot_low = _seven(flat), _seven(hot)
    rows: list[dict] = []
    for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(hot_cut) > 0)).tolist():
        here = slice(cut[b], cut[b + 1])
        mine, local = np.unique(owner[here], return_inverse=True)
        rows.append(
            {"bucket": b, "entries": low[here].tobytes(), "owner": local.astype(np.uint16).tobytes(), "node": node[mine].tobytes(), "hot": hot_low[hot_cut[b] : hot_cut[b + 1]].tobytes()}
        )
    docs = {"doc_id": ids, "n": n.tolist(), "h1": h1.tolist(), "h2": h2.tolist(), "text_hash": text_hashes}
    rows.append({"bucket": turn % parts, "hot_node": hot_node.tobytes(), "hot_id": hot_id.tobytes(), **docs})
    return pa.RecordBatch.from_pylist(rows, _PACKED)


def _pack(parts: int, k: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, sets, total, turn, seen = [], [], [], 0, 0, set()
        for whole in source:
            for b in slices(whole):
                doc_ids, texts, text_hashes = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()
                for part in batches(texts):
                    got = shingle_sets(texts[part], k)
                    ids += doc_ids[part]
                    hashes += text_hashes[part]
                    sets += got
                    total += sum(map(len, got))
                    if total >= _FLUSH or len(sets) >= _ROWS:
                        yield _blocks(ids, hashes, sets, parts, turn, seen)
                        ids, hashes, sets, total, turn = [], [], [], 0, turn + 1
        if sets:
            yield _blocks(ids, hashes, sets, parts, turn, seen)

    return releasing(run)


def _shared(node: np.ndarray, full: np.ndarray, df: np.ndarray | None) -> pa.Table:
    """Rows of sets (node) and their shared shingles; hot ones have no df."""
    order = np.lexsort((full, node))
    node, full = node[order], full[order]
    at, _ = _runs(node)
    offsets = pa.array(np.concatenate([at, [len(node)]]).astype(np.int32))
    cols = {"kind": pa.array(["hot" if df is None else "shared"] * len(at)), "h1": pa.array(node[at])}
    cols["ids"] = pa.ListArray.from_arrays(offsets, pa.array(full.view(np.int64)))
    if df is not None:
        cols["dfs"] = pa.ListArray.from_arrays(offsets, pa.array(df[order].astype(np.int32)))
    return pa.Table.from_arrays([cols.get(f.name, pa.nulls(len(at), f.type)) for f in _COUNTED], schema=_COUNTED)


def _counted(f: np.ndarray, node: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of shingles (f) of sets (node), those of two sets or more and those of
    hot: shingle, set, number of sets, whether it is hot."""
    order = np.argsort(f)
    f, node = f[order], node[order]
    some = np.zeros(len(f), bool)
    if len(hot):
        some = hot[np.minimum(np.searchsorted(hot, f), len(hot) - 1)] == f
    same = f[1:] == f[:-1]
    some[1:] |= same
    some[:-1] |= same
    f, node = f[some], node[some]
    order = np.lexsort((node, f))
    f, node = f[order], node[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (node[1:] != node[:-1])]) if len(f) else np.zeros(0, bool)  # copies from other blocks go
    f, node = f[new], node[new]
    at, count = _runs(f)
    is_hot = np.zeros(len(at), bool)
    if len(hot) and len(at):
        is_hot = hot[np.minimum(np.searchsorted(hot, f[at]), len(hot) - 1)] == f[at]
    df, is_hot = np.repeat(count, count), np.repeat(is_hot, count)
    some = (df > 1) | is_hot
    return f[some], node[some], df[some], is_hot[some]


def _count(parts: int):
    """Of one hash range: the documents that came along, and for each set its
    shingles that another set has, with their numbers of sets."""

    def run(group: pa.Table) -> pa.Table:
        hots, made = [], []
        bucket = group.column("bucket")[0].as_py()
        size = pc.sum(pc.binary_length(group.column("entries"))).as_py() or 0
        f, node, n = np.empty(size // 7, U), np.empty(size // 7, np.int64), 0
        for batch in group.to_batches():
            col = {c: batch.column(c) for c in group.column_names}
            for i in range(batch.num_rows):
                if col["entries"][i].is_valid:
                    owner = np.frombuffer(col["owner"][i].as_buffer(), np.uint16)
                    f[n : n + len(owner)] = _eight(col["entries"][i].as_buffer())
                    node[n : n + len(owner)] = np.frombuffer(col["node"][i].as_buffer(), np.int64)[owner]
                    n += len(owner)
                    hots.append(_eight(col["hot"][i].as_buffer()))
                else:
                    docs = {c: col[c][i].values for c, _ in _DOCS}
                    size = len(docs["n"])
                    cols = {"kind": pa.array(["doc"] * size), **docs}
                    made.append(pa.Table.from_arrays([cols.get(c.name, pa.nulls(size, c.type)) for c in _COUNTED], schema=_COUNTED))
                    hot_node, h = np.frombuffer(col["hot_node"][i].as_buffer(), np.int64), np.frombuffer(col["hot_id"][i].as_buffer(), U)
                    if len(h):
                        made.append(_shared(hot_node, h, None))
        if n:
            hot = np.unique(np.concatenate(hots))
            # an eighth of the shingles at a time
            found = [_counted(f[some], node[some], hot) for some in (np.flatnonzero(f >> U(53) == U(x)) for x in range(8))]
            del f, node
            f, node, df, is_hot = (np.concatenate([x[i] for x in found]) for i in range(4))
            name = _named(f, bucket)
            for some in ((df > 1) & ~is_hot, is_hot):
                if some.any():
                    made.append(_shared(node[some], name[some], None if some is is_hot else df[some]))
        return pa.concat_tables(made) if made else _COUNTED.empty_table()

    return releasing(run)


class _Sets:
    """The sets of a group's rows, as spans of one array of small numbers."""

    def __init__(self, group: pa.Table):
        ids = group.column("ids").combine_chunks()
        self.length = ids.value_lengths().to_numpy().astype(np.int64)
        self.at = np.cumsum(self.length) - self.length
        distinct, self.flat = np.unique(ids.flatten().to_numpy(), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)
        self.size = group.column("n").to_numpy()

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of row i with others."""
        mine, n = self.flat[self.at[i] : self.at[i] + self.length[i]], self.length[others]
        self.mark[mine] = 1
        spot = np.repeat(self.at[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total = np.concatenate([[0], np.cumsum(self.mark[self.flat[spot]])])
        self.mark[mine] = 0
        end = np.cumsum(n)
        return total[end] - total[end - n]


_ASSIGNED = "r bigint, q bigint, node bigint, d double, home boolean, open boolean, own boolean, idx boolean, root bigint, q_root bigint, n bigint, w bigint, link boolean"


def _assign(num: int, den: int):
    """Members of a block against their region's new pivots: a row for the
    nearest, and for each that a member's links may belong to."""

    def run(group: pa.Table) -> pa.Table:
        sets = _Sets(group)
        pivot = group.column("pivot").to_numpy(zero_copy_only=False)
        members, pivots = np.flatnonzero(~pivot), np.flatnonzero(pivot)
        dist, link = np.empty((len(pivots), len(members))), np.empty((len(pivots), len(members)), bool)
        for j, q in enumerate(pivots):
            both = sets.common(q, members)
            union = sets.size[q] + sets.size[members] - both
            dist[j], link[j] = 1.0 - both / union, den * both >= num * union
        near = dist.min(0) if len(members) else np.zeros(0)
        j, i = np.nonzero(dist <= near + 2 * (den - num) / den + 1e-9)
        home = j == dist.argmin(0)[i] if len(members) else np.zeros(0, bool)
        one, other = group.take(pa.array(members[i])), group.take(pa.array(pivots[j]))
        cols = {"q": other.column("node"), "q_root": other.column("root"), "d": pa.array(dist[j, i]), "home": pa.array(home), "link": pa.array(link[j, i])}
        names = [c.split()[0] for c in _ASSIGNED.split(", ")]
        return pa.table([cols[c] if c in cols else one.column(c) for c in names], names)

    return run


def _compare(num: int, den: int):
    """Links, as edges of roots, between the own members of a block and the
    visitors of another, within the windows."""

    def run(group: pa.Table) -> pa.Table:
        sets = _Sets(group)
        node, size, root = (group.column(c).to_numpy() for c in ("node", "n", "root"))
        dist = group.column("d").to_numpy()
        is_open, idx, owner = (group.column(c).to_numpy(zero_copy_only=False) for c in ("open", "idx", "owner"))
        owners, visitors = np.flatnonzero(owner), np.flatnonzero(~owner)
        _, label = np.unique(root, return_inverse=True)
        name = np.full(label.max() + 1, 0, np.int64)
        name[label] = root
        merged = np.arange(len(name))  # root of each label, kept flat
        a, b = [], []
        radius = (den - num) / den + 1e-9
        for i in owners:
            x, y = size[i], size[visitors]
            fits = (np.abs(dist[visitors] - dist[i]) <= radius) & (den * np.minimum(x, y) >= num * np.maximum(x, y))
            fits &= ~is_open[visitors] | (node[visitors] > node[i])  # two open ones meet twice
            fits &= np.where(y < x, idx[visitors], idx[i]) | (y == x) & idx[visitors]
            left = visitors[fits]
            left = left[np.argsort(np.abs(dist[left] - dist[i]), kind="stable")]
            for p in range(0, len(left), 256):
                some = left[p : p + 256]
                some = some[merged[label[some]] != merged[label[i]]]
                if not len(some):
                    continue
                both = sets.common(i, some)
                for j in some[den * both >= num * (x + size[some] - both)]:
                    s, t = merged[label[i]], merged[label[j]]
                    if s != t:
                        merged[merged == max(s, t)] = min(s, t)
                        a.append(int(name[s]))
                        b.append(int(name[t]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _cells(sets: DataFrame, num: int, den: int) -> DataFrame:
    """p, node, idx: the cells of the first pivots, from rows node, n, ids in
    order of rarity. idx: some shingle that made the cell may be the first
    common one of the member with a set of its size or more."""
    own = F.col("n") - F.size("ids")
    free = (F.floor(F.col("n") * (den - num) / den) + 1 - own).cast("int")
    first = (F.floor(F.col("n") * (den - num) / (den + num)) + 1 - own).cast("int")
    pre = sets.filter(free > 0).select("node", first.alias("first"), F.posexplode(F.slice("ids", F.lit(1), free)).alias("i", "s"))
    pre = pre.select("node", "s", (F.col("i") < F.col("first")).alias("idx"))
    pivots = pre.groupBy("s").agg(F.min(F.when(F.col("idx"), F.col("node"))).alias("p"), F.count(F.lit(1)).alias("c"))
    pivots = materialize(pivots.filter("c > 1 and p is not null").select("s", "p"), "regions")
    cells = materialize(pre.join(pivots, "s").groupBy("p", "node").agg(F.max("idx").alias("idx")), "cells")
    discard(pivots)
    return cells


def _regions(todo: DataFrame, sets: DataFrame, num: int, den: int, most_pairs: int, most_levels: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """Regions whose pairs are still too many, cut by Voronoi pivots of their
    own members, again and again; and the links to pivots found on the way."""
    links, radius = [], (den - num) / den + 1e-9
    for level in range(most_levels):
        stats = todo.groupBy("r").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("own").cast("int")).alias("u"), F.sum("w").alias("weight"), F.max("stuck").alias("stuck"))
        big = materialize(stats.filter((F.col("u") * F.col("m") > most_pairs) & ~F.col("stuck")).drop("stuck"), "big")
        if big.isEmpty():
            discard(big)
            break
        some = todo.join(big, "r")
        chosen = some.filter(F.col("own") & (F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("u") / 16).cast("long")) == 0))
        blocks = F.ceil(F.col("weight") / _WEIGHT).cast("long")
        every = chosen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("pivot", F.lit(True))
        each = some.withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), blocks)).withColumn("pivot", F.lit(False))
        rows = each.unionByName(every).join(sets.select("node", "ids"), "node")
        got = materialize(rows.groupBy("r", "block").applyInArrow(_assign(num, den), _ASSIGNED), "assigned")
        links.append(materialize(got.filter("link").select(F.col("root").alias("a"), F.col("q_root").alias("b")).filter("a <> b").distinct(), "links"))
        got = got.withColumn("own", F.col("own") & F.col("home"))
        rings = got.filter("own").groupBy("r", "q").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("u2"))
        near = got.join(rings, ["r", "q"]).filter((F.col("d") >= F.col("lo") - radius) & (F.col("d") <= F.col("hi") + radius))
        near = materialize(near, "near")
        work = near.groupBy("r", "q").agg((F.max("u2") * F.count(F.lit(1))).alias("pairs")).groupBy("r").agg(F.sum("pairs").alias("pairs"))
        # pivots that tell little apart would only repeat the visitors
        cut = big.join(work, "r", "left").select("r", (F.coalesce("pairs", F.lit(0)) <= 0.6 * F.col("u") * F.col("m")).alias("cut"))
        cut = materialize(cut, "cut")
        kept = todo.join(cut, "r", "left").withColumn("stuck", F.col("stuck") | F.coalesce(~F.col("cut"), F.lit(False))).filter("cut is null or not cut")
        new = near.join(cut.filter("cut").select("r"), "r", "left_semi").withColumn("r", F.xxhash64("r", "q")).withColumn("stuck", F.lit(False))
        old, todo = todo, materialize(kept.select(*todo.columns).unionByName(new.select(*todo.columns)), "todo")
        discard(old, big, got, near, cut)
    return todo, links


def _links(sets: DataFrame, num: int, den: int, most_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Roots (node, root) after the links with first pivots, and edges (a, b)
    of roots that connect what the other links connect."""
    cells = _cells(sets, num, den)

    def with_sets(df: DataFrame, key: str, mark: str) -> DataFrame:
        return df.join(sets.select(F.col("node").alias(key), F.col("n").alias(f"n{mark}"), F.col("ids").alias(f"ids{mark}")), key)

    inter = F.size(F.array_intersect("ids1", "ids2")).cast("long")
    far = with_sets(with_sets(cells, "node", "1"), "p", "2").select("p", "node", "idx", F.col("n1").alias("n"), F.size("ids1").cast("long").alias("w"), inter.alias("i"), (F.col("n1") + F.col("n2")).alias("t"))
    union = F.col("t") - F.col("i")
    far = materialize(far.select("p", "node", "idx", "n", "w", (F.lit(1.0) - F.col("i") / union).alias("d"), (F.col("i") * den >= union * num).alias("link")), "distances")
    discard(cells)
    roots = components(far.filter("link and node <> p").select(F.col("node").alias("a"), F.col("p").alias("b")))
    labelled = materialize(far.drop("link").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    main = labelled.groupBy("p", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("p").agg(
        F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("m"), F.max("c").alias("most")
    )
    todo = labelled.join(main.filter("most < m").select("p", "main"), "p").withColumn("open", F.col("root") != F.col("main"))
    todo = materialize(todo.select(F.col("p").alias("r"), "node", "n", "w", "d", "idx", "root", "open", F.col("open").alias("own"), F.lit(False).alias("stuck")), "todo")
    discard(far, labelled)
    todo, links = _regions(todo, sets, num, den, most_pairs)
    # rings by distance to the pivot, as wide as the radius, in blocks by weight
    todo = todo.withColumn("ring", F.floor(F.col("d") * den / (den - num)))
    weight = lambda c: F.ceil(F.sum(F.when(c, F.col("w"))) / _WEIGHT).cast("long")
    rings = materialize(todo.groupBy("r", "ring").agg(weight(F.col("own")).alias("ob"), weight(F.lit(True)).alias("vb")), "rings")
    pairs = rings.filter("ob is not null").select("r", F.col("ring").alias("x"), "ob", F.explode(F.array(*[F.col("ring") + i for i in (-1, 0, 1)])).alias("y"))
    pairs = pairs.join(rings.select("r", F.col("ring").alias("y"), "vb"), ["r", "y"])
    spot, every = F.xxhash64("node", F.lit(7)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["r", "x", "y", "i", "j", "node", "n", "d", "idx", "root", "open"]
    owners = todo.filter("own").withColumnRenamed("ring", "x").join(pairs, ["r", "x"]).withColumn("i", F.pmod(spot, F.col("ob"))).withColumn("j", every("vb"))
    visitors = todo.withColumnRenamed("ring", "y").join(pairs, ["r", "y"]).withColumn("j", F.pmod(spot, F.col("vb"))).withColumn("i", every("ob"))
    rows = owners.select(*cols, F.lit(True).alias("owner")).unionByName(visitors.select(*cols, F.lit(False).alias("owner")))
    rows = rows.join(sets.select("node", "ids"), "node")
    links.append(materialize(rows.groupBy("r", "x", "y", "i", "j").applyInArrow(_compare(num, den), "a bigint, b bigint"), "links"))
    discard(todo, rings)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return roots, edges


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, most_pairs: int = 1 << 22) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (least id that
    links reach, itself included), set_id (hash of the shingle set), root (of
    the component; null for an empty set) and text_hash (xxhash64 of the text).
    most_pairs: a region with more of them left to look at is cut again."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("text_hash", F.xxhash64("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, shuffle_parts(spark), -(-size // _RANGE))
    packed = src.mapInArrow(_pack(parts, k), _SCHEMA)
    got = materialize(packed.groupBy("bucket").applyInArrow(_count(parts), _OUT), "shingles", "kind")
    docs = got.filter("kind = 'doc'").select("doc_id", "n", "h1", "h2", "text_hash")
    # the size of a set comes from its documents; hot shingles may come again from each task
    of = lambda kind, c: F.collect_list(F.when(F.col("kind") == kind, F.col(c)))
    sets = got.filter("h1 is not null and (n is null or n > 0)").groupBy("h1").agg(
        F.max("n").alias("n"), F.flatten(of("shared", "ids")).alias("ids"), F.flatten(of("shared", "dfs")).alias("dfs"), of("hot", "ids").alias("hot")
    )
    sets = sets.withColumn("hot", F.array_distinct(F.flatten("hot")))
    sets = sets.filter((F.col("n") - F.size("ids") - F.size("hot")) * den <= F.col("n") * (den - num))
    # rarest first, the hot ones last
    rare = F.transform(F.array_sort(F.arrays_zip("dfs", "ids")), lambda x: x["ids"])
    sets = materialize(sets.select(F.col("h1").alias("node"), "n", F.concat(rare, F.array_sort("hot")).alias("ids")), "sets")
    roots, edges = _links(sets, num, den, most_pairs)
    upper = components(edges)
    discard(sets)
    # all documents: the copies of a set share its node; least id of each root
    keyed = docs.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    keyed = keyed.join(roots.withColumnsRenamed({"node": "h1", "root": "up"}), "h1", "left").withColumn("up", F.coalesce("up", "h1"))
    keyed = keyed.join(upper.withColumnRenamed("node", "up"), "up", "left").withColumn("root", F.coalesce("root", "up"))
    classes = materialize(keyed.select("h1", "h2", "least", "root"), "classes")
    tops = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(classes.join(tops, "root").select("h1", "h2", "root", "component_id"), "ids")
    discard(roots, upper, classes)
    out = docs.join(ids, ["h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.hex("h2").alias("set_id"), "root", "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op2: one per document."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
