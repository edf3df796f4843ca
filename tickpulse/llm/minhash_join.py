"""Near-duplicates by an inverted join over MinHash coordinates.

Every text is reduced to a set of shingle hashes and a signature of ``coords``
minima.  Texts with equal sets form one class.  A class is posted under its
coordinate-value pairs; two classes that agree in at least ``need`` of the
coordinates must meet under one of the ``coords - need + 1`` rarest pairs of both
(rarity is one global order), so only those are posted.  Collisions are
counted over all coordinates of the two signatures, skipping a pair in every
posting list but the first both have, and pairs that reach ``need`` are
confirmed on their full sets.

Lists of at most 64 members are compared all with all by their signatures, in the task that
reads them; of the pairs that agree only those between components go on to the full sets.
Longer lists are never expanded into all pairs.  Every list's members are compared with
its smallest one, the centre.  What a member lacks of its centre's set, and
which of its other shingles any further member has, bounds what two members can
share, so most members that the centre does not link are settled by this bound alone.
Long lists that still hold several components with members the bound leaves open, or
members that agree too little with their centre to have a bound, are settled exactly:
their classes, all groups together, go through the signature trees on their full sets, so
no link between components is left out and no pair is listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.llm import rolling
from tickpulse.llm.components import connected_components
from tickpulse.llm.rows import chosen_rows, screened
from tickpulse.llm.scratch import discard, small_batches, written
from tickpulse.llm.shingles import shingle_sets
from tickpulse.llm.signature_trees import jaccard_join

COORDS = 64
NEED = 34
_SHORT = 64  # members of a list that are compared all with all


def _multipliers(coords: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, coords, dtype=np.uint64) | np.uint64(1)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, coords: int) -> DataFrame:
    """``doc_id, raw, n_shingles, node, sig``: set size, 128-bit digest of the set (null if empty), 4 bytes per coordinate."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("raw", F.xxhash64(F.coalesce("text", F.lit(""))))
    by = _multipliers(coords)

    def sign(batches):
        for b in batches:
            rows = b.num_rows
            n, d1, d2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            sig = np.zeros((rows, coords), np.uint32)
            for first, g, _, at, size in shingle_sets(b.column("text"), words):
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                start = at[full]
                n[first : first + len(size)] = size
                with np.errstate(over="ignore"):
                    d1[first + full] = np.add.reduceat(g, start)
                    d2[first + full] = np.add.reduceat(rolling.mix(g ^ np.uint64(0x2545F4914F6CDD1D)), start)
                    for c in range(coords):
                        sig[first + full, c] = np.minimum.reduceat(((g * by[c]) >> np.uint64(32)).astype(np.uint32), start)
            nodes = [x.tobytes() if k else None for x, k in zip(np.stack([d1, d2], axis=1), n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("raw"), pa.array(n), pa.array(nodes, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "raw", "n_shingles", "node", "sig"],
            )

    return base.mapInArrow(sign, "doc_id long, raw long, n_shingles long, node binary, sig binary")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: key, size, smallest id, signature and a representative row."""
    return rows.where("n_shingles > 0").groupBy("node").agg(
        F.first("n_shingles").alias("n"),
        F.min("doc_id").alias("low_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("rep"),
        F.first("sig").alias("sig"),
    )


def _postings(classes: DataFrame, coords: int, need: int) -> DataFrame:
    """Rows ``token, node, n, sig, mask`` of the lists with two members or more; ``mask`` has the posted coordinates."""
    tokens = F.array(*[F.conv(F.hex(F.substring("sig", 4 * c + 1, 4)), 16, 10).cast("long") + F.lit(c << 32) for c in range(coords)])
    flat = classes.select("node", F.explode(tokens).alias("token"))
    often = flat.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    found = flat.join(often, "token")
    # tokens that no other class has are the rarest of all; they fill the prefix first
    ranked = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("common"))
    keep = F.greatest(F.lit(0), F.size("common") - F.lit(need - 1))
    posted = ranked.select("node", F.slice("common", 1, keep).alias("kept")).where(F.size("kept") > 0)
    mask = F.aggregate("kept", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["token"], 32).cast("int"))))
    rows = written(posted.select("node", F.explode("kept.token").alias("token"), mask.alias("mask")), "posted")
    several = rows.groupBy("token").agg(F.count("*").alias("often")).where("often > 1").select("token")
    lists = written(rows.join(several, "token").join(classes.select("node", "n", "sig"), "node"), "postings")
    discard(rows)
    return lists


def _agreeing(pairs: DataFrame, coords: int, need: int) -> DataFrame:
    """Count equal coordinates of ``sig_a`` and ``sig_b``; a pair passes in the first list that posts both."""

    def count(batches):
        for t in batches:
            if not t.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(-1, coords) for c in ("sig_a", "sig_b"))
            equal = a == b
            posted = (t.column("mask_a").to_numpy() & t.column("mask_b").to_numpy())[:, None] >> np.arange(coords) & 1
            both = equal & (posted > 0)
            coord = t.column("coord").to_numpy()
            ok = (equal.sum(axis=1) >= need) & ((coord < 0) | (both.argmax(axis=1) == coord))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok))], names=["a", "b"])

    return pairs.mapInArrow(count, "a binary, b binary")


def _agreeing_inside(lists: DataFrame, coords: int, need: int, percent: int) -> DataFrame:
    """``a, b`` of all pairs of a list's members that agree on ``need`` coordinates, for lists of at most ``_SHORT`` members; each in the first list that posts both."""
    ordered = lists.repartition("grp").sortWithinPartitions("grp", "node")

    def pairs(t: pa.Table):
        grp, n, mask = (t.column(c).to_numpy() for c in ("grp", "n", "mask"))
        nodes = t.column("node").combine_chunks()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, coords)
        for d in range(1, _SHORT):
            i = np.flatnonzero(grp[d:] == grp[:-d])
            if not len(i):
                break
            i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
            equal = sig[i] == sig[i + d]
            ok = equal.sum(axis=1) >= need
            i, equal = i[ok], equal[ok]
            posted = (mask[i] & mask[i + d])[:, None] >> np.arange(coords) & 1
            i = i[(equal & (posted > 0)).argmax(axis=1) == grp[i] >> 32]
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), nodes.take(pa.array(i + d))], names=["a", "b"])

    def count(batches):
        held = None  # the last list of a batch may go on in the next
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            grp = t.column("grp").to_numpy()
            head = int(np.searchsorted(grp, grp[-1]))
            if head:
                yield from pairs(t.slice(0, head))
            held = t.slice(head)
        if held is not None:
            yield from pairs(held)

    return ordered.select("grp", "node", "n", "sig", "mask").mapInArrow(count, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node, hashes`` of the wanted classes, from the texts of their representatives."""
    marks = wanted.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.raw").alias("raw"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = chosen_rows(screened(texts, marks), marks, carry=("node",))

    def collect(batches):
        for b in batches:
            nodes = b.column("node")
            for first, g, _, at, size in shingle_sets(b.column("text"), words):
                offsets = pa.array(np.append(at, len(g)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [nodes.slice(first, len(size)), pa.ListArray.from_arrays(offsets, pa.array(g.view(np.int64)))], names=["node", "hashes"]
                )

    return found.select("node", "text").mapInArrow(collect, "node binary, hashes array<bigint>")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, more``: set sizes, and the hashes of ``b`` that ``a`` lacks."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return two.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.array_except("hb", "ha").alias("more"))


def _linked_sets(percent: int):
    both = F.col("nb") - F.size("more")
    return 100 * both >= percent * (F.col("na") + F.col("nb") - both)


def _hubs(stars: DataFrame, percent: int) -> DataFrame:
    """Members of every centre with an exact bound on what two of them can share.

    With ``lost`` hashes of the centre missing in a member, and ``shared`` of its own others that some other member of the hub has too,
    two members share at most ``size of the centre - larger lost + smaller shared``.  ``probe`` is False for a member that cannot
    reach the similarity with any other member by this bound.
    """
    extra = stars.select("a", "b", F.explode("more").alias("h"))
    common = extra.groupBy("a", "h").agg(F.count("*").alias("k")).where("k > 1").select("a", "h")
    shared = extra.join(common, ["a", "h"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    rows = stars.select("a", "b", "na", F.col("nb").alias("n"), (F.col("na") - F.col("nb") + F.size("more")).alias("lost"))
    rows = rows.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    centre = stars.groupBy("a").agg(F.first("na").alias("na")).select("a", F.col("a").alias("b"), "na", F.col("na").alias("n"), F.lit(0).alias("lost"), F.lit(0).cast("long").alias("shared"))
    rows = rows.unionByName(centre)
    smallest = rows.groupBy("a").agg(F.min("n").alias("small"))
    room = (100 + percent) * (F.col("na") - F.col("lost") + F.col("shared")) >= percent * (F.col("n") + F.col("small"))
    rows = rows.join(smallest, "a").select(F.col("a").alias("grp"), F.col("b").alias("node"), "n", "na", "lost", "shared", room.alias("probe"))
    return rows.withColumn("mask", F.lit(-1).cast("long"))


def _settled(docs: DataFrame, classes: DataFrame, asked: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``a, b``: what connects the ``asked`` classes among themselves, decided exactly on their full sets (``signature_trees``)."""
    marks = classes.select("node", "rep").join(asked, "node", "left_semi")
    marks = written(marks.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.raw").alias("raw"), F.monotonically_increasing_id().alias("number")), "open-texts")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(chosen_rows(screened(texts, marks), marks, carry=("number",)).select("number", "text"), "asked-texts")  # read several times
    joined = jaccard_join(found.select("number", "text"), "number", "text", words, percent).where("doc_id <> component_id")
    at = lambda c, n: marks.select(F.col("number").alias(c), F.col("node").alias(n))
    return joined.join(at("doc_id", "a"), "doc_id").join(at("component_id", "b"), "component_id").select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    coords: int = COORDS,
    need: int = NEED,
) -> DataFrame:
    """Link texts whose shingle sets have ``100 * intersection >= percent * union``; one row per document.

    Returns ``doc_id, n_shingles, component_id, kept``; the component is the smallest id reachable over links and the
    document with that id stays.  ``need`` equal coordinates of ``coords`` make a candidate: at the threshold 0.8 a link is
    missed with a probability of about 3.2e-7, at 0.85 of about 3e-10.

    Null and empty texts and texts without words have no shingles and no links; they keep their own id.  Rows without an
    id belong to the component of their text, but never name one; a component of such rows only has a null id and
    none is kept.  Rows that repeat an id are linked by their texts only; all rows with the kept id are kept.  An empty
    table gives no rows.
    """
    found = _linked(docs, id_col, text_col, words, percent, coords, need).drop("raw", "stays")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coords: int = COORDS, need: int = NEED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of linked texts (the smallest id; without ids
    the first by a hash of the text), and every text without words."""
    marks = _linked(docs, id_col, text_col, words, percent, coords, need).where("stays").select("doc_id", "raw").distinct()
    return chosen_rows(docs, written(marks, "kept"), id_col, text_col)


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, coords: int, need: int) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = written(signatures(docs, id_col, text_col, words, coords), "signatures")
    classes = written(_classes(rows), "classes")
    posts = _postings(classes, coords, need)
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    lists = posts.withColumnRenamed("token", "grp")
    low = written(lists.groupBy("grp").agg(F.min("node").alias("low"), F.count("*").alias("members")), "centres")
    lists = lists.join(low, "grp")

    # every list's members against its smallest one; the group of a list is its token, with the coordinate in the upper half
    side = lambda rows, t: rows.select("grp", *[F.col(c).alias(f"{c}_{t}") for c in ("node", "n", "sig", "mask")])
    both = side(lists.where("node = low"), "a").join(side(lists.where("node <> low"), "b"), "grp").where(near)
    pairs = both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "sig_a", "sig_b", "mask_a", "mask_b", F.shiftright("grp", 32).cast("int").alias("coord"))
    found = _agreeing(pairs, coords, need).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = written(found.distinct(), "candidates")
    inside = written(_agreeing_inside(lists.where(F.col("members").between(3, _SHORT)), coords, need, percent).join(found, ["a", "b"], "left_anti"), "short-lists")
    asked = found.unionByName(inside).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = written(classes.select("node", "rep").join(asked, "node", "left_semi"), "asked")
    sets = written(_sets(docs, asked, id_col, text_col, words), "sets")
    stars = compared = written(_compare(found, sets), "stars")
    links = stars.where(_linked_sets(percent)).select("a", "b")
    labels = written(connected_components(links, "a", "b"), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    apart = inside.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not coalesce(label_a = label_b, false)").select("a", "b")
    more = written(_compare(apart, sets).where(_linked_sets(percent)).select("a", "b"), "short-list-links")
    if not more.isEmpty():
        labels = written(connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), "a", "b"), "labels")

    # long lists that this leaves open: of several components, with members that the bound allows more links or that the centre knows nothing of
    lists = lists.where(F.col("members") > _SHORT)
    stars = stars.join(low.where(F.col("members") > _SHORT).select(F.col("low").alias("a")).distinct(), "a", "left_semi")
    hubs = _hubs(stars, percent).select("grp", "node", "probe")
    known = stars.select(F.col("a").alias("low"), F.col("b").alias("node"), F.lit(True).alias("known"))
    odd = lists.join(known, ["low", "node"], "left").withColumn("probe", F.col("known").isNull() & (F.col("node") != F.col("low")))
    odd = odd.select(F.col("grp").cast("string").cast("binary").alias("grp"), "node", "probe")
    members = written(hubs.unionByName(odd), "members")
    parts = members.join(labels, "node", "left").groupBy("grp").agg(
        F.min(F.coalesce("label", "node")).alias("first"), F.max(F.coalesce("label", "node")).alias("last"), F.max("probe").alias("probe"))
    open_ = parts.where("probe and first <> last").select("grp")
    lists_done = [posts, low, found, inside, asked, sets, compared, members]
    asked = written(members.join(open_, "grp", "left_semi").select("node").distinct(), "open-classes")
    discard(*lists_done)
    if not asked.isEmpty():
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(_settled(docs, classes, asked, id_col, text_col, words, percent))
        labels = written(connected_components(links, "a", "b"), "labels")

    named = classes.select(F.col("node").alias("c_node"), "low_id", "rep")
    named = named.join(labels, F.col("c_node") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c_node")).drop("node")
    lowest = named.groupBy("label").agg(F.min("low_id").alias("component_id"), F.min("rep").alias("stays"))
    named = written(named.join(lowest, "label").select("c_node", "component_id", "stays"), "named")
    out = rows.select("doc_id", "raw", "n_shingles", "node").join(named, F.col("node") == F.col("c_node"), "left")
    alone = F.col("node").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("raw") == F.col("stays.raw"))
    return out.select("doc_id", "raw", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | stays).alias("stays"))
