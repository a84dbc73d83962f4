"""Near-duplicate documents by DartMinHash signatures over five-word shingles.

Darts are a Poisson process over (element, weight, rank), fixed by hashes of the element, so every
document that holds the element at that weight sees the same darts. A document collects the darts in
the region of each of its elements, up to its weight and up to the rank at which k (ln k + 4) darts
are expected for the whole document; each dart is hashed to one of k coordinates and the earliest
dart of each coordinate is kept. Two documents agree in a coordinate with probability equal to their
weighted Jaccard similarity. Weights are 1 for each distinct shingle by default, which makes it the
plain Jaccard similarity; ``signatures`` takes any weights.

Signatures are cut into bands and joined by band. Copies collapse to one node first. In each bucket the
member with the most company, the head, is compared with all others, which makes one component of most
large groups; this is repeated while it links many of those that are left. Then every bucket that still
holds several components is settled at once: the members outside its largest component meet all members
of other components, in blocks of bounded size, and a task compares a block of sets by matrix products
and returns the links that join two components, at most one per member. So no two members of a bucket
stay in different components without having been compared on their exact shingle sets, and pairs are
never rows. Components come from passing the least label along links, with every step kept in the
shared folder.

Defined results: NULL text counts as empty, and texts with the same words are copies (so all wordless
texts are one class); texts of one to four words are one shingle; a NULL doc_id gets a NULL class and
is never dropped; rows that share a doc_id are one document; an empty table gives an empty table;
other columns are carried by ``keep_one`` and ignored by ``classes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, forget, if_small, only, released, row_bytes, save
from .shingles import WordHashes, mix, shingle_set

BANDS, ROWS = 40, 8
SIMILARITY = 0.8
#: Shingles handled at once in a task.
BLOCK = 60_000
EDGES = [0.0, 1 / 16, 1 / 4, *[2.0**e for e in range(-1, 40)]]  # rank axis, the same for every document
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=None)
def _counts(cell: int) -> np.ndarray:
    """Cumulative probabilities of the number of darts in one cell."""
    width = EDGES[cell + 1] - EDGES[cell]
    n = np.arange(int(width + 12 * math.sqrt(width) + 24))
    logs = -width + n * math.log(width) - np.array([math.lgamma(i + 1) for i in n])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, docs: np.ndarray, n_docs: int, k: int, weights: np.ndarray | None = None, factor: float = 4.0) -> np.ndarray:
    """(n_docs, k) earliest darts; ``elements`` are hashes, ``docs`` the document of each (0..n_docs-1)."""
    best = np.full(n_docs * k, EMPTY)
    if weights is None:
        total, units, place, room = np.bincount(docs, minlength=n_docs).astype(float), elements, docs, None
    else:  # one unit of the weight axis each; the last may be cut
        total = np.bincount(docs, weights=weights, minlength=n_docs)
        n = np.ceil(weights).astype(np.int64)
        level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        units = mix(np.repeat(elements, n) + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        place, room = np.repeat(docs, n), np.repeat(weights, n) - level
        # the first unit of an element is the element itself, as without weights
        units = np.where(level == 0, np.repeat(elements, n), units)
    limit = k * (math.log(k) + factor) / np.maximum(total, 1e-12)
    reach = limit[place]
    for cell in range(len(EDGES) - 1):
        low = EDGES[cell]
        at = np.flatnonzero(reach > low)
        if not len(at):
            break
        seed = mix(units[at] ^ np.uint64((cell + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        n = np.searchsorted(_counts(cell), _unit(seed), side="right")
        hit = np.flatnonzero(n)
        at, seed, n = at[hit], seed[hit], n[hit]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(at, n)
        dart = mix(np.repeat(seed, n) + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rank = low + (EDGES[cell + 1] - low) * _unit(dart)
        inside = rank < reach[owner]
        if room is not None:
            inside &= _unit(mix(dart ^ np.uint64(0xE7037ED1A0B428DB))) < room[owner]
        owner, dart, rank = owner[inside], mix(dart[inside]), rank[inside]
        slot = place[owner] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, slot, key)
    best = best.reshape(n_docs, k)
    # a coordinate without a dart: throw further for that document
    short = np.flatnonzero((best == EMPTY).any(axis=1) & (total > 0))
    if len(short):
        again = np.full(n_docs, -1)
        again[short] = np.arange(len(short))
        rows = again[docs] >= 0
        best[short] = signatures(elements[rows], again[docs[rows]], len(short), k, None if weights is None else weights[rows], factor * 2 + 4)
    return best


def band_keys(signs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n_docs, bands) hashes of ``rows`` coordinates each; the band's number is part of the hash."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signs), bands)).copy()
    parts = signs.reshape(len(signs), bands, rows)
    for i in range(rows):
        out = mix(out + parts[:, :, i] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in released(batches):
            ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(texts):
                sets, content, held, end = [], [], 0, start
                while end < len(texts) and (held < BLOCK or end == start):
                    words = (texts[end].as_py() or "").encode().split()
                    content.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sets.append(shingle_set(words, known))
                    held += len(sets[-1])
                    end += 1
                sizes = np.array([len(s) for s in sets])
                place = np.repeat(np.arange(len(sets)), sizes)
                signs = signatures(np.concatenate(sets), place, len(sets), bands * rows)
                keys = band_keys(signs, bands, rows)
                flat = pa.array(keys.ravel())
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(content, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
                    ["doc_id", "content", "n", "bands"],
                )
                start = end

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in released(batches):
        texts = batch.column(1)
        for start in range(0, len(texts), 500):
            sets = [shingle_set((t.as_py() or "").encode().split(), known).view(np.int64) for t in texts.slice(start, 500)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, 500), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["node", "shingles"]
            )


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component, for links (a, b)."""
    edges = save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = save(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        known = if_small(labels)
        heard = edges.join(known, edges.b == labels.v).groupBy("a").agg(F.min("label").alias("heard"))
        told = labels.join(heard, labels.v == heard.a, "left").select("v", "label", F.least("label", "heard").alias("next"))
        # and the label of that label
        jump = labels.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
        jump = F.broadcast(jump) if labels.rows * row_bytes(jump) <= BROADCAST_BYTES else jump
        new = told.join(jump, told.next == jump._v, "left").select("v", F.least("next", "_label").alias("label"), F.col("label").alias("old"))
        new = save(new, "labels", changed=F.count_if(F.col("label") != F.col("old")))
        forget(labels)
        labels = save_view(new.select("v", "label"), new)
        if not new.measured["changed"]:
            forget(edges)
            return labels


def save_view(df: DataFrame, saved: DataFrame) -> DataFrame:
    """``df``, which has the rows of the saved table ``saved``, as a saved table."""
    df.saved_path, df.rows, df.measured = saved.saved_path, saved.rows, saved.measured
    return df


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` after the new links (a, b), a saved table: components of components."""
    if not links.rows:
        return labels
    if labels is None:
        return components(links)
    one, two = (if_small(save_view(labels.select(F.col("v").alias(c), F.col("label").alias(f"_{c}")), labels)) for c in "ab")
    ends = links.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("_a", "a").alias("la"), F.coalesce("_b", "b").alias("lb"))
    ends = save(ends, "ends")
    joined = components(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    named = labels.union(ends.select("a", "la")).union(ends.select("b", "lb")).distinct()
    over = if_small(save_view(joined.select(F.col("v").alias("_v"), F.col("label").alias("_label")), joined))
    return save(named.join(over, named.label == over._v, "left").select("v", F.coalesce("_label", "label").alias("label")), "labels")


def _mixed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets with several components, with ``mine``, the component of ``node``, ``most``, the bucket's largest, and sizes of both parts."""
    if labels is None:
        placed = rows.withColumn("mine", F.col("node"))
    else:
        known = if_small(save_view(labels.select(F.col("v").alias("node"), "label"), labels))
        placed = rows.join(known, "node", "left").withColumn("mine", F.coalesce("label", "node")).drop("label")
    placed = save(placed, "placed")
    parts = placed.groupBy("key", "mine").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    each = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "s", "mine")).alias("p"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    each = each.where("parts > 1").select(
        "key", F.col("p.mine").alias("most"), F.col("p.m").alias("most_m"), F.col("p.s").alias("most_s"), (F.col("m") - F.col("p.m")).alias("rest_m"), (F.col("s") - F.col("p.s")).alias("rest_s")
    )
    out = save(placed.join(if_small(save(each, "mixed-keys")), "key"), "mixed")
    forget(placed)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the saved ``pairs`` those (a, b) with similar shingle sets. Sets travel once, to the heads they are compared with."""
    worth = if_small(save_view(pairs.select("node", "head"), pairs))
    heads = if_small(save_view(pairs.select("head").distinct(), pairs))
    mine = sets.select("node", F.col("shingles").alias("x")).join(worth, "node")
    theirs = sets.select(F.col("node").alias("head"), F.col("shingles").alias("y")).join(heads, "head")
    both = F.size(F.array_intersect("x", "y"))
    near = both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9
    return save(mine.join(theirs, "head").where(near).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "links")


#: Members and shingles of one side of a block.
SIDE_ROWS, SIDE_SHINGLES, COLUMNS = 1024, 1_000_000, 4096


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``rows`` shares with each of ``columns``, by products of 0/1 matrices."""
    one, two = np.concatenate(rows), np.concatenate(columns)
    shared = np.intersect1d(one, two)
    out = np.zeros((len(rows), len(columns)), np.float32)
    place = [np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in (rows, columns)]
    for i in range(0, len(shared), COLUMNS):
        part = shared[i : i + COLUMNS]
        sides = []
        for flat, at, n in ((one, place[0], len(rows)), (two, place[1], len(columns))):
            where = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[where] == flat
            table = np.zeros((n, len(part)), np.float32)
            table[at[hit], where[hit]] = 1
            sides.append(table)
        out += sides[0] @ sides[1].T
    return out


def _settled(similarity: float):
    """Links of a block between members of different components: a spanning forest of them, so at most one per component."""

    def run(block: pa.Table) -> pa.Table:
        node, mine, n = (block.column(c).to_numpy() for c in ("node", "mine", "n"))
        side = block.column("first").to_numpy()
        sets = [x.values.to_numpy(zero_copy_only=False) for x in block.column("shingles")]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if block.column("both")[0].as_py():  # the first side also meets itself
            right = np.concatenate([right, left])
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            least, most = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
            open_ = (mine[left][:, None] != mine[right]) & (least >= similarity * most - 1e-9)
            rows, columns = open_.any(axis=1), open_.any(axis=0)
            left, right, open_ = left[rows], right[columns], open_[rows][:, columns]
            if len(left):
                both = overlaps([sets[i] for i in left], [sets[i] for i in right])
                near = open_ & (both >= similarity * (n[left][:, None] + n[right] - both) - 1e-6)
                above: dict[int, int] = {}

                def top(x: int) -> int:
                    while x in above:
                        x = above[x]
                    return x

                for i, j in zip(*np.nonzero(near)):
                    a, b = top(int(mine[left[i]])), top(int(mine[right[j]]))
                    if a != b:
                        above[max(a, b)] = min(a, b)
                        found.append((int(node[left[i]]), int(node[right[j]])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _settle(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components of each bucket of ``mixed``.

    The largest component of a bucket is cut into blocks, the rest of it too; each block of the rest meets
    each block of the largest, itself, and each other block of the rest.
    """
    count = lambda m, s: F.greatest(F.ceil(F.col(m) / SIDE_ROWS), F.ceil(F.col(s) / SIDE_SHINGLES)).cast("int")
    main, deal = F.col("mine") == F.col("most"), F.xxhash64("node", F.lit(7))
    rows = mixed.select("key", "node", "mine", "n", main.alias("main"), count("most_m", "most_s").alias("nm"), count("rest_m", "rest_s").alias("nr"))
    own = F.pmod(deal, F.when(F.col("main"), F.col("nm")).otherwise(F.col("nr"))).cast("int")
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    mine = F.transform(upto(F.col("nr")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("first")))
    against = F.transform(upto(F.col("nm")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("first")))
    others = F.transform(
        F.filter(upto(F.col("nr")), lambda b: b != F.col("own")),
        lambda b: F.struct(F.least(b, F.col("own")).alias("i"), (F.col("nm") + F.greatest(b, F.col("own"))).alias("j"), (F.col("own") < b).alias("first")),
    )
    spread = rows.withColumn("own", own).withColumn("g", F.explode(F.when(F.col("main"), mine).otherwise(F.concat(against, others))))
    spread = save(spread.select("key", "node", "mine", "n", "g.i", "g.j", "g.first", (F.col("g.j") == 0).alias("both")), "spread")
    held = sets.join(if_small(spread), "node")
    found = held.groupBy("key", "i", "j").applyInArrow(_settled(similarity), "a long, b long")
    return save(found.distinct(), "links")


def component_labels(docs: DataFrame, signed: DataFrame, copies: DataFrame, similarity: float, labels: DataFrame | None) -> DataFrame | None:
    """(v, label) after linking all nodes that are similar; ``labels`` holds what is linked already.

    Pairs whose nodes lie in one component need no check, which keeps large groups of near copies linear:
    their head links most of them. What it leaves is compared in ``_settle``. Head turns end when one
    links less than a tenth of the nodes it looks at: they only save work for ``_settle``.
    """
    reps = signed.where("doc_id is not null and n > 0").join(if_small(copies), ["doc_id", "content"], "left_anti")
    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"), "n")
    sizes = save(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    rows = save(rows.join(if_small(sizes), "key"), "shared")
    weight = rows.groupBy("node").agg(F.sum("m").alias("w"))
    alive = save(rows.join(weight, "node").select("key", "node", "n", "w"), "buckets")
    forget(rows)
    sets = None
    while True:
        mixed = _mixed(alive, labels)
        if not mixed.rows:
            return labels
        if sets is None:  # every node that can ever be compared shares a mixed bucket now
            named = save(mixed.select(F.col("node").alias("doc_id")).distinct(), "named")
            texts = docs.join(if_small(named), "doc_id", "left_semi")
            sets = save(texts.select("doc_id", "text").mapInArrow(_sets, "node long, shingles array<long>"), "shingles")
            asked = named.rows
        else:
            asked = save(mixed.where("mine <> most").select("node").distinct(), "rest").rows
        # the weightiest member of each bucket, and for each node of another component the weightiest of its heads
        top = F.max(F.struct("w", (-F.col("node")).alias("node"), "n", "mine")).alias("h")
        heads = mixed.groupBy("key").agg(top).select("key", (-F.col("h.node")).alias("head"), F.col("h.n").alias("head_n"), F.col("h.w").alias("head_w"), F.col("h.mine").alias("theirs"))
        heads = save(heads, "heads")
        # sizes alone rule many pairs out
        worth = F.least("n", "head_n") >= similarity * F.greatest("n", "head_n")
        crossed = mixed.join(if_small(heads), "key").where(F.expr("mine <> theirs") & worth)
        pairs = crossed.groupBy("node").agg(F.max(F.struct("head_w", "head")).alias("p")).select("node", F.col("p.head").alias("head"))
        links = _similar(save(pairs, "pairs"), sets, similarity)
        labels = _merged(labels, links)
        if 10 * links.rows < asked:
            break
        alive = _without_weight(alive, save_view(heads.select("key", F.col("head").alias("node")), heads))
    mixed = _mixed(alive, labels)
    if mixed.rows:
        labels = _merged(labels, _settle(mixed, sets, similarity))
    return labels


def _without_weight(alive: DataFrame, met: DataFrame) -> DataFrame:
    """``alive`` with weight 0 for the heads that were used, so that others come next."""
    used = if_small(save_view(met.withColumn("used", F.lit(True)), met))
    out = alive.join(used, ["key", "node"], "left").select("key", "node", "n", F.when(F.col("used"), F.lit(0).cast("long")).otherwise(F.col("w")).alias("w"))
    return save(out, "buckets")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class), one row per row of ``docs``."""
    base = only(docs, doc_id="long", text="string")
    signed = save(base.mapInArrow(_sign(bands, rows), "doc_id long, content binary, n int, bands array<long>"), "signatures")
    nodes = save(signed.where("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("node")), "nodes")
    members = save(signed.select("doc_id", "content").join(nodes, "content", "left"), "members")
    # rows that share a doc_id are one document, so their texts are linked
    shared = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b").select("a", "b")
    copies = save(members.where("doc_id <> node").select("doc_id", "content").distinct(), "copies")
    labels = component_labels(base, signed, copies, similarity, _merged(None, save(shared, "same-id")))
    if labels is None:
        return members.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("class_id"))
    return members.join(labels, members.node == labels.v, "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("class_id")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class; NULL ids stay; repeated rows stay once."""
    found = save(classes(docs, similarity), "classes")
    dropped = save(found.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    out = docs.join(if_small(dropped), "doc_id", "left_anti").select(*docs.columns)
    twice = save(found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    if twice.rows:
        # of different rows under one doc_id the one whose JSON has the least digest stays, wherever it lies
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        again = out.join(if_small(save_view(twice.select("doc_id"), twice)), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.md5(F.to_json(row).cast("binary"))).alias("_row"))
        out = again.select("_row.*").unionByName(out.join(if_small(save_view(twice.select("doc_id"), twice)), "doc_id", "left_anti").select(*docs.columns))
    return out
