"""Exact Jaccard self-join of shingle sets by signature trees.

1. Texts with equal sets form one class.
2. The token universe is cut into parts by hash, a few tokens of a set to a part, and more parts than two linked sets differ in
   tokens: they must agree on a whole part (``_Parts``).  Classes chained by equal parts are a *family*, and no link leaves a
   family.  Texts that share a passage rarely agree on a part.
3. Every family has one signature tree.  Its sets, sorted by their smallest hash so that similar ones are neighbours, fill leaves of
   bounded size; a node of each level spans up to 16 nodes below.  A node holds the OR of its sets' token bitmaps, the range of
   their sizes, and the most tokens that any of its sets loses to bit collisions.
4. Leaves link their own sets (and the last one of the leaf before) when they are made, which joins near copies into components.
   Families of several leaves that are not one component by then get trees sorted by component, and the dual traversal descends
   all of them together, one join per level.  A pair of nodes is dropped when its sizes cannot match, when the common bits plus the
   collisions allow too small an overlap, or when all sets of both are in one component already.  Pairs of leaves that are left
   are compared set by set, exactly.

A family may hold any share of the rows: its leaves lie in many partitions, each task sees bounded leaves or pairs, and
a group of near copies is one component after step 4's first half, so its tree is dropped at the top.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.llm import rolling
from tickpulse.llm.components import connected_components
from tickpulse.llm.files import RecordReader, RecordWriter
from tickpulse.llm.key_filter import build_filter, holds
from tickpulse.llm.rows import chosen_rows, screened, text_hash
from tickpulse.llm.scratch import discard, discard_folder, fresh_path, small_batches, written
from tickpulse.llm.shingles import shingle_sets

_LEAF_SETS, _LEAF_TOKENS = 32, 1 << 16  # a leaf is closed by whichever comes first
_FAN_BITS = 4  # 16 children
_MIN_BITS, _MAX_BITS = 1 << 8, 1 << 16
_OUT_BYTES = 1 << 22


def _digest(g: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.add.reduceat(rolling.mix(g ^ np.uint64(0x2545F4914F6CDD1D)), start), np.add.reduceat(rolling.mix(g + np.uint64(0x632BE59BD9B4E019)), start)


def _set_rows(base: DataFrame, words: int) -> DataFrame:
    """``doc_id, raw, n_shingles, node, cid``: set size, 128-bit digest of the set and its first half (null if empty)."""

    def digest(batches):
        for b in batches:
            rows = b.num_rows
            n, d = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
            for first, g, _, at, size in shingle_sets(b.column("text"), words):
                full = np.flatnonzero(size)
                n[first : first + len(size)] = size
                if len(full):
                    d[first + full, 0], d[first + full, 1] = _digest(g, at[full])
            nodes = [x.tobytes() if k else None for x, k in zip(d, n.tolist(), strict=True)]
            cid = pa.array(d[:, 0].view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("raw"), pa.array(n), pa.array(nodes, pa.binary()), cid], names=["doc_id", "raw", "n_shingles", "node", "cid"])

    return base.mapInArrow(digest, "doc_id long, raw long, n_shingles long, node binary, cid long")


class _Parts:
    """How sets of every size are cut into parts of the token universe.

    Sizes fall into classes so wide that sets that can link lie in one class or in two neighbours.  Group ``c`` holds the
    sets of classes ``c`` and ``c + 1``; each set is in two groups.  A group has one number of parts, and a token's part is its
    hash.  Two linked sets differ in at most ``most`` tokens, so in at most as many parts: a set whose tokens fill more
    parts than that agrees with every partner on a whole part that is not empty.  Sets that fill fewer, by bad luck, are
    told apart (``short``).
    """

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, low[-1] * 100 // percent + 1))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1  # largest size of each class
        differ = self._most(top[:-1], np.minimum(top[:-1] * 100 // percent, top[1:]))
        self.parts = np.ceil(1.1 * (differ + 1) + 1.5 * np.sqrt(differ + 1)).astype(np.int64)
        self.parts[differ == 0] = 0  # only equal sets link here

    def _most(self, n, m):
        """Tokens that two sets of these sizes may differ in and still link."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def keys(self, g: np.ndarray, r: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``key, row, need`` of every part that a set of the rows fills, in both of its groups, and the rows that are ``short`` in one.

        ``need`` is the least number of parts of that group on which the set agrees with any linked one."""
        of = np.searchsorted(self.low, size, side="right") - 1
        out, short = [], np.zeros(len(size), bool)
        token = rolling.mix(g ^ np.uint64(0xA24BAED4963EE407))
        place = rolling.mix(g + np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)
        for down in (0, 1):
            group = of - down
            parts = np.where((group >= 0) & (size > 0), self.parts[np.maximum(group, 0)], 0)
            partner = np.minimum(size * 100 // self.percent, self.low[np.maximum(group + 2, 0)] - 1) if not down else self.low[np.maximum(group + 1, 0)] - 1
            most = self._most(size, partner)
            here = np.flatnonzero(parts[r])
            if not len(here):
                continue
            row = r[here]
            # parts of all rows numbered through, so that one sort brings them together
            base = np.cumsum(parts) - parts
            number = base[row] + (place[here] * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(number, kind="stable")
            number, row = number[order], row[order]
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            row = row[first]
            with np.errstate(over="ignore"):
                content = np.add.reduceat(token[here][order], first)
                name = (group[row].astype(np.uint64) << np.uint64(40)) + (number[first] - base[row]).astype(np.uint64)
                key = rolling.mix(content ^ rolling.mix(name))
            need = np.bincount(row, minlength=len(size)) - most
            short |= (parts > 0) & (need <= 0)
            out.append((key, row, np.maximum(need, 1)[row]))
        if not out:
            e = np.empty(0, np.int64)
            return e.view(np.uint64), e, e, short
        return *(np.concatenate(x) for x in zip(*out, strict=True)), short


def _prefix(g: np.ndarray, r: np.ndarray, at: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which tokens belong to their set's prefix: the first ``n - ceil(percent * n / 100) + 1`` by value.  Linked sets share one of them."""
    return np.arange(len(g)) - at[r] < (size + (-percent * size) // 100 + 1)[r]


def _slices_once(b: pa.RecordBatch, words: int):
    """The sets of a batch by slices, equal sets of a slice once: tokens, row, first, size, and the half digest per row."""
    for _, g, r, at, size in shingle_sets(b.column("text"), words):
        full = np.flatnonzero(size)
        if not len(full):
            continue
        cid = np.zeros(len(size), np.uint64)
        cid[full], _ = _digest(g, at[full])
        once = np.zeros(len(size), bool)
        once[full[np.unique(cid[full], return_index=True)[1]]] = True
        keep = once[r]
        size = np.where(once, size, 0)
        yield g[keep], r[keep], np.cumsum(size) - size, size, cid


def _posts(key: np.ndarray, cid: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cid.view(np.int64)), pa.array(need, pa.int32())], names=["key", "cid", "need"])


def _met(posts: DataFrame) -> DataFrame:
    """The posts whose key another class has too."""
    line = Window.partitionBy("key").orderBy("cid")
    beside = [F.coalesce(f("cid").over(line) != F.col("cid"), F.lit(False)).alias(n) for f, n in ((F.lag, "a"), (F.lead, "b"))]
    return posts.select("*", *beside).where("a or b").drop("a", "b")


def _families(base: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, label``: classes (by half digest) chained by equal parts; classes that agree with no other on a part are left out.

    A class that agrees with all others together on fewer parts than it would with a single linked one links with nothing: it
    is dropped before the rest is chained.  That is what keeps texts out that merely share passages.
    """
    texts = base.select("text")

    def parts(batches):
        cut = _Parts(percent)
        for b in batches:
            for g, r, _, size, cid in _slices_once(b, words):
                key, row, need, _ = cut.keys(g, r, size)
                yield _posts(key, cid[row], need)

    def prefixes_of_short(batches):
        cut = _Parts(percent)
        for b in batches:
            for g, r, at, size, cid in _slices_once(b, words):
                keep = _prefix(g, r, at, size, percent) & cut.keys(g, r, size)[3][r]
                yield _posts(g[keep], cid[r[keep]], np.zeros(int(keep.sum())))

    schema = "key long, cid long, need int"
    met = written(_met(texts.mapInArrow(parts, schema)), "met-parts")
    for _ in range(2):  # what is dropped leaves others with too few
        enough = met.groupBy("cid", "need").agg(F.count("*").alias("k")).where("k >= need").select("cid").distinct()
        before_ = met
        met = written(_met(met.join(enough, "cid", "left_semi")), "met-parts")
        discard(before_)
    before = F.lag("cid").over(Window.partitionBy("key").orderBy("cid"))
    chain = met.select("cid", before.alias("prev")).where("prev is not null and prev <> cid").distinct()

    # the few sets that fill too few parts meet every partner under a token of their prefix
    asked = written(texts.mapInArrow(prefixes_of_short, schema).distinct(), "short-prefixes")
    wanted = build_filter(asked)

    def prefixes(batches):
        for b in batches:
            for g, r, at, size, cid in _slices_once(b, words):
                keep = np.flatnonzero(_prefix(g, r, at, size, percent))
                keep = keep[holds(wanted.value, g[keep])]
                yield _posts(g[keep], cid[r[keep]], np.zeros(len(keep)))

    partner = texts.mapInArrow(prefixes, schema).select("key", "cid").distinct()
    few = asked.select("key", F.col("cid").alias("prev")).join(partner, "key").where("prev <> cid").select("cid", "prev").distinct()
    chains = written(chain.unionByName(few), "chains")
    discard(met, asked)
    families = written(connected_components(chains, "cid", "prev"), "families")
    discard(chains)
    return families


def _bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The set's bitmap as bytes."""
    flags = np.zeros(bits, bool)
    flags[(rolling.mix(tokens) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all sets with each other, by blocks of tokens."""
    flat = np.concatenate(sets)
    _, place = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), np.int64)
    block = 1 << 15
    for low in range(0, int(place.max()) + 1, block):
        here = (place >= low) & (place < low + block)
        m = np.zeros((len(sets), block), np.float32)
        m[row[here], place[here] - low] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix connects: one less than members per component."""
    seen = np.zeros(len(linked), bool)
    edges = []
    for i in range(len(linked)):
        if seen[i]:
            continue
        seen[i] = True
        todo = [i]
        while todo:
            x = todo.pop()
            fresh = np.flatnonzero(linked[x] & ~seen)
            seen[fresh] = True
            edges += [(x, y) for y in fresh.tolist()]
            todo += fresh.tolist()
    return edges


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


_EDGES = pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())]))
_FIRST = {"family": pa.int64(), "links": _EDGES}
_KEPT = {c: pa.int64() for c in ("family", "pid", "seq", "low", "high", "excess", "file", "at", "size")} | {"bits": pa.binary(), "same": pa.binary(), "links": _EDGES}
_FIRST_SCHEMA = "family long, links array<struct<a: binary, b: binary>>"
_KEPT_SCHEMA = ", ".join(f"{c} long" for c in list(_KEPT)[:9]) + ", bits binary, same binary, links array<struct<a: binary, b: binary>>"


def _leaves(sets: DataFrame, percent: int, folder: str | None = None) -> DataFrame:
    """Leaves of all trees, cut from the sorted sets of each partition, with the links inside.

    ``label`` is the component a set is known to be in: a leaf of one component (``same``) is not searched.  A leaf does not
    reach over a change of ``family`` or ``cut``.  With a ``folder`` the leaves can be compared later: their sets are written
    there once, a row has their place (``file, at, size``), bitmap and bounds."""
    types = _KEPT if folder else _FIRST

    def close(family, pid, seq, bits, nodes, labels, tokens, carry, records):
        same = labels[0] if len(set(labels)) == 1 else None
        names, members = ([carry[0], *nodes], [carry[1], *tokens]) if carry else (nodes, tokens)
        search = len(members) > 1 and (carry or same is None)
        edges = [dict(a=names[i], b=names[j]) for i, j in _forest(_links(members, percent))] if search else []
        if records is None:
            return {"family": family, "links": edges}
        maps = [_bitmap(t, bits) for t in tokens]
        size = np.array([len(t) for t in tokens])
        excess = max(n - int(np.bitwise_count(m).sum()) for n, m in zip(size.tolist(), maps, strict=True))
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        file, at, length = records.add((nodes, size, flat[order], np.repeat(np.arange(len(size)), size)[order].astype(np.uint32)))
        both = np.bitwise_or.reduce(maps).tobytes()
        return {"family": family, "pid": pid, "seq": seq, "low": int(size.min()), "high": int(size.max()), "excess": excess, "file": file, "at": at, "size": length, "bits": both, "same": same, "links": edges}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))

    def cut(batches):
        records = RecordWriter(folder) if folder else None
        pid, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        now, bits, nodes, labels, tokens, carry = None, 0, [], [], [], None
        try:
            for b in batches:
                plain = zip(*[b.column(c).to_pylist() for c in ("family", "cut", "width", "node", "label")], strict=True)
                for i, (family, part, width, node, label) in enumerate(plain):
                    t = np.frombuffer(b.column("tokens")[i].as_buffer(), np.uint64)
                    if nodes and ((family, part) != now or len(nodes) == _LEAF_SETS or sum(map(len, tokens)) + len(t) > _LEAF_TOKENS):
                        out.append(close(now[0], pid, seq, bits, nodes, labels, tokens, carry, records))
                        held += len(out[-1].get("bits", b""))
                        seq += 1
                        carry = (nodes[-1], tokens[-1].copy())
                        nodes, labels, tokens = [], [], []
                        if held > _OUT_BYTES or len(out) == 2000:
                            yield batch(out)
                            out, held = [], 0
                    if (family, part) != now:
                        if now is None or family != now[0]:
                            carry = None
                        now, bits = (family, part), width
                    nodes.append(node)
                    labels.append(label)
                    tokens.append(t)
            if nodes:
                out.append(close(now[0], pid, seq, bits, nodes, labels, tokens, carry, records))
            if out:
                yield batch(out)
        finally:
            if records is not None:
                records.close()

    return sets.select("family", "cut", "width", "node", "label", "tokens").mapInArrow(cut, _KEPT_SCHEMA if folder else _FIRST_SCHEMA)


def _parents(level: DataFrame) -> DataFrame:
    """The next level up: up to 16 nodes of one family become one."""

    def merge(key, table):
        maps = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        same = table.column("same").to_pylist()
        one = same[0] if len(set(same)) == 1 else None
        pick = lambda c, f: [f(table.column(c).to_pylist())]
        bits = np.bitwise_or.reduce(maps).tobytes()
        return pa.table(
            {"family": [key[0].as_py()], "id": [key[1].as_py()], "low": pick("low", min), "high": pick("high", max), "excess": pick("excess", max), "bits": [bits], "same": pa.array([one], pa.binary())}
        )

    up = level.withColumn("id", F.shiftright("id", _FAN_BITS))
    return up.groupBy("family", "id").applyInArrow(merge, "family long, id long, low long, high long, excess long, bits binary, same binary")


_PLACE = ("file", "at", "size")


def _children(level: DataFrame, folder: str) -> DataFrame:
    """``family, x, file, at, size``: for every node of the level above the place of one record with all nodes below it."""

    def group(batches):
        records, now, rows = RecordWriter(folder), None, []

        def place():
            ids, low, high, excess = (np.array([r[c] for r in rows], np.int64) for c in ("id", "low", "high", "excess"))
            same = np.array([r["same"] for r in rows] + [None], object)[:-1]
            maps = np.stack([np.frombuffer(r["bits"], np.uint64) for r in rows])
            return [*now, *records.add((ids, low, high, excess, same, maps))]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["family", "x", *_PLACE])

        try:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if (r["family"], r["x"]) != now:
                        if rows:
                            out.append(place())
                        now, rows = (r["family"], r["x"]), []
                    rows.append(r)
                if out:
                    yield batch(out)
            if rows:
                yield batch([place()])
        finally:
            records.close()

    up = level.withColumn("x", F.shiftright("id", _FAN_BITS)).repartitionByRange("family", "x").sortWithinPartitions("family", "x", "id")
    return up.select("family", "x", "id", "low", "high", "excess", "same", "bits").mapInArrow(group, "family long, x long, file long, at long, size long")


def _placed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with the places of both sides' records, the same number of pairs to every task: what is shuffled are places, never
    tokens or bitmaps, and a pair is far more work than its bytes say."""
    side = lambda t, k: nodes.select("family", F.col("x").alias(k), *[F.col(c).alias(f"{c}_{t}") for c in _PLACE])
    both = pairs.join(side("a", "x"), ["family", "x"]).join(side("b", "y"), ["family", "y"])
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // 512)
    return both.repartitionByRange(tasks, "family", "x", "y").sortWithinPartitions("family", "x", "y")


def _read_pairs(b: pa.RecordBatch, records: RecordReader):
    """``family, x, y`` of every pair and its two records."""
    for r in b.to_pylist():
        yield r["family"], r["x"], r["y"], *(records.get(*[r[f"{c}_{t}"] for c in _PLACE]) for t in "ab")


def _descend(pairs: DataFrame, children: DataFrame, folder: str, percent: int) -> DataFrame:
    """Pairs of nodes below the ``pairs`` of the level above that may still hold links."""

    def overlap(batches):
        records = RecordReader(folder)
        try:
            for b in batches:
                out = [np.empty((3, 0), np.int64)]
                for family, x, y, one, two in _read_pairs(b, records):
                    ia, la, ha, ea, sa, ma = one
                    ib, lb, hb, eb, sb, mb = two
                    keep = (100 * ha[:, None] >= percent * lb) & (100 * hb >= percent * la[:, None])
                    keep &= ~np.array([[p is not None and p == q for q in sb] for p in sa])
                    if x == y:
                        keep &= ia[:, None] <= ib
                    i, j = np.nonzero(keep)
                    most = np.bitwise_count(ma[i] & mb[j]).sum(axis=1, dtype=np.int64)
                    ok = (ia[i] == ib[j]) | ((100 + percent) * (most + np.minimum(ea[i], eb[j])) >= percent * (la[i] + lb[j]))
                    i, j = i[ok], j[ok]
                    out.append(np.stack([np.full(len(i), family), ia[i], ib[j]]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["family", "x", "y"])
        finally:
            records.close()

    return _placed(pairs, children).mapInArrow(overlap, "family long, x long, y long")


def _cross_links(one: tuple, two: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two leaves, as many as connect them; the second leaf's sets are numbered behind the first's."""
    (_, na, ta, ra), (_, nb, tb, rb) = one, two
    can = (100 * na[:, None] >= percent * nb) & (100 * nb >= percent * na[:, None])
    if not can.any():
        return []
    first, last = (np.searchsorted(tb, ta, side) for side in ("left", "right"))
    count = last - first
    # every token of the first leaf with each equal one of the second, both in order
    end = np.cumsum(count)
    at = np.arange(int(end[-1])) + np.repeat(first - (end - count), count)
    both = np.bincount(np.repeat(ra, count).astype(np.int64) * len(nb) + rb[at], minlength=can.size).reshape(can.shape)
    linked = can & (100 * both >= percent * (na[:, None] + nb - both))
    if not linked.any():
        return []
    k = len(na)
    whole = np.zeros((k + len(nb), k + len(nb)), bool)
    whole[:k, k:], whole[k:, :k] = linked, linked.T
    return _forest(whole)


def _compared(pairs: DataFrame, leaves: DataFrame, folder: str, percent: int) -> DataFrame:
    """Links ``a, b`` between the sets of two leaves, as many as connect them."""

    def compare(batches):
        records = RecordReader(folder)
        try:
            for b in batches:
                out = []
                for _, _, _, one, two in _read_pairs(b, records):
                    names = [*one[0], *two[0]]
                    out += [(names[i], names[j]) for i, j in _cross_links(one, two, percent)]
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
        finally:
            records.close()

    return _placed(pairs, leaves.select("family", F.col("id").alias("x"), *_PLACE)).mapInArrow(compare, "a binary, b binary")


def _tree_links(sets: DataFrame, leaves: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """The links that the first leaves did not see, by dual traversal of the trees of families with several leaves and several
    components; None where there is no such family.

    The trees are made anew: a component's sets fill leaves of their own, so a pair of nodes inside one is dropped at once,
    and sets that are alone share leaves.
    """
    spark = leaves.sparkSession
    several = leaves.groupBy("family").agg(F.count("*").alias("k")).where("k > 1").select("family")
    named = sets.select("family", "node").join(several, "family", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    components = written(named.groupBy("family", "label").agg(F.count("*").alias("k")), "tall-components")
    open_ = written(components.groupBy("family").agg(F.count("*").alias("k")).where("k > 1").select("family"), "tall-families")
    trees = open_.count()
    if not trees:
        return None
    parts = components.join(open_, "family", "left_semi").select("family", "label", F.when(F.col("k") > 1, F.col("label")).alias("cut"))
    members = named.join(parts, ["family", "label"]).select("node", "label", "cut")
    tall = written(sets.join(members, "node"), "tall-sets")
    # sets that are alone lie by size: the bounds of their leaves are narrow, so few pairs of them can link
    members = tall.withColumn("n", F.when(F.col("cut").isNull(), F.length("tokens")).otherwise(0))
    order = ["family", "cut", "n", "lowest", "node"]
    folder = fresh_path(spark, "leaf-records")
    leaves = written(_leaves(members.repartitionByRange(*order).sortWithinPartitions(*order), percent, folder), "tall-leaves")
    discard(tall, components, open_)

    # one number per partition: leaves get gapless numbers in sorted order, so a family's leaves are neighbours
    counts = sorted((r["pid"], r["k"]) for r in leaves.groupBy("pid").agg(F.count("*").alias("k")).collect())
    before = np.cumsum([0] + [k for _, k in counts])[:-1].tolist()
    offsets = spark.createDataFrame([(p, o) for (p, _), o in zip(counts, before, strict=True)], "pid long, before long")
    numbered = leaves.join(offsets, "pid").withColumn("id", F.col("seq") + F.col("before"))
    levels = [written(numbered.select("family", "id", "low", "high", "excess", "bits", "same"), "level-0")]
    while levels[-1].count() > trees:
        levels.append(written(_parents(levels[-1]), f"level-{len(levels)}"))

    links = leaves.select(F.explode("links").alias("l")).select("l.a", "l.b")
    pairs = written(levels[-1].where("same is null").select("family", F.col("id").alias("x"), F.col("id").alias("y")), "node-pairs")
    for level in reversed(levels[:-1]):
        below = fresh_path(spark, "node-records")
        children = written(_children(level, below), "children")
        last = pairs
        pairs = written(_descend(last, children, below, percent), "node-pairs")
        discard(last, children)
        discard_folder(spark, below)
    discard(*levels)
    pairs = written(pairs.where("x < y"), "leaf-pairs")
    out = written(links.unionByName(_compared(pairs, numbered, folder, percent)), "tree-links")
    discard(pairs, leaves)
    discard_folder(spark, folder)
    return out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Link texts whose sets of ``words``-word shingles have ``100 * intersection >= percent * union``, exactly; one row per document.

    Returns ``doc_id, n_shingles, component_id``; the component is the smallest id reachable over links.  Shingles are of
    words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a shorter text is one shingle.

    Null and empty texts and texts without words have no shingles and no links; they keep their own id.  Rows without an id belong to the
    component of their text but never name one; a component of such rows only has a null id.  Rows that repeat an id are linked by
    their texts only.  Very long texts are slices of work of their own length.  An empty table gives no rows, and columns other than the
    two named are not read.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(f"`{text_col}`").alias("raw"))
    rows = written(_set_rows(base, words), "set-rows")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("cid").alias("cid"), F.min("doc_id").alias("low_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("rep")
    )
    classes = written(classes, "classes")
    families = _families(base, words, percent).select(F.col("node").alias("cid"), F.col("label").alias("family"))

    members = classes.join(families, "cid").select("node", "n", "family", F.col("rep.doc_id").alias("doc_id"), F.col("rep.raw").alias("raw"))
    members = written(members, "members")
    widest = members.groupBy("family").agg(F.max("n").alias("n")).where("n > 0")
    bits = F.least(F.lit(_MAX_BITS), F.greatest(F.lit(_MIN_BITS), F.pow(F.lit(2), F.ceil(F.log2(8 * F.col("n"))))).cast("long"))
    members = members.drop("n").join(widest.select("family", bits.alias("width")), "family")

    texts = chosen_rows(screened(base.select("doc_id", "text"), members), members, carry=("node", "family", "width"))

    def tokens(batches):
        for b in batches:
            for first, g, _, at, size in shingle_sets(b.column("text"), words):
                parts = np.split(g, at[1:])
                lowest = [int(rolling.mix(p).min()) >> 1 if len(p) else 0 for p in parts]
                here = [b.column(c).slice(first, len(size)) for c in ("family", "width", "node")]
                yield pa.RecordBatch.from_arrays([*here, pa.array(lowest, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["family", "width", "node", "lowest", "tokens"])

    sets = written(texts.mapInArrow(tokens, "family long, width long, node binary, lowest long, tokens binary"), "member-sets")
    ordered = sets.repartitionByRange("family", "lowest", "node").sortWithinPartitions("family", "lowest", "node")
    leaves = written(_leaves(ordered.withColumn("label", F.col("node")).withColumn("cut", F.lit(None).cast("binary")), percent), "leaves")

    links = leaves.select(F.explode("links").alias("l")).select("l.a", "l.b")
    labels = written(connected_components(links, "a", "b"), "labels")
    more = _tree_links(sets, leaves, labels, percent)
    if more is not None and not more.isEmpty():
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)
        labels = written(connected_components(links, "a", "b"), "labels")

    named = classes.select(F.col("node").alias("c_node"), "low_id").join(labels, F.col("c_node") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c_node"))
    lowest = named.groupBy("label").agg(F.min("low_id").alias("component_id"))
    named = written(named.select("c_node", "label").join(lowest, "label").select("c_node", "component_id"), "named")
    discard(classes, sets, leaves)
    out = rows.select("doc_id", "n_shingles", "node").join(named, F.col("node") == F.col("c_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
