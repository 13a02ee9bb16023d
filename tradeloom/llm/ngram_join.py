"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sets are put in equal-size bands in which
sizes differ by at most the similarity, so linked sets lie in the same or in neighbouring bands,
and a bound on the size gives a bound k on the number of elements in which linked sets differ.
Per band the feature domain is hashed into n1 first-level partitions, so many that in one of
them linked sets differ in at most one element; that partition is cut into three parts, and each
pair of its parts is enumerated as a signature. Linked sets share a signature of their band.

Shingles that many documents hold (boilerplate) tell little and would make unlike documents
share signatures, so the domain leaves them out: linked sets differ there by k at most as well.
A set keeps this short cut only if what is left of it proves that a match will show; a set that
is mostly boilerplate sends signatures over the whole domain too. Nothing is missed either way.

The sets that share a signature form a candidate group. Groups are not merged, as unlike sets that
meet by chance would soon chain most sets together. Pairs are first held against a lower bound on
their difference, from a small histogram of each set: in each group the pairs with its least set, and
then, in groups that this leaves in several components, the others. What can still be linked
forms finer groups, whose pairs are compared exactly. Large groups are cut into square tiles of
bounded size, and a tile returns a forest of links, never all pairs. Links give components; equal
sets count as one until the end.

Shingles, sets and signatures are 64-bit hashes. Null and empty texts, and texts without words,
have the empty set and link with nothing. A null `doc_id` ranks below all others. Repeated rows each
get a row and are linked if they have words. Texts of any length are taken whole. An empty table
gives no rows. `doc_id` is cast to long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import (
    boxed,
    bucket_count,
    by_bucket,
    components,
    importable,
    map_batches,
    packed_schema,
    unboxed,
    written,
)
from tradeloom.llm.text import U64, mix

_CHUNK = 1_500_000  # signatures a task sorts at once
_FREQUENT = 1 / 1000  # share of documents from which a shingle is left out of the domain
_SLACK = 1.15  # first-level partitions, times the least number
_TILE = 64  # sets on a side of a tile, while a group needs at most _SIDES of them
_SIDES = 32
_MOST = 4096  # sets on a side of a tile, in the largest groups
_BINS = 128  # at least, of the histogram that bounds differences from below
_PER_BIN = 8  # elements a bin, at most on average
_PART = 1 << 22  # bins of pairs that are compared at once
_BUCKET_BYTES = 4 << 20  # input bytes per signature bucket


def shingle_sets(block: tx.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and the bounds of each text's run."""
    words = tx.Words(block, tx.WHITE, lower=True)
    hashes = words.hashes()
    starts, shingles = tx.windows(hashes, words.bounds, width)
    doc = words.docs()[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = tx.range_hash(hashes, words.bounds[short], words.bounds[short + 1])
        at = np.searchsorted(doc, short)
        doc, shingles = np.insert(doc, at, short), np.insert(shingles, at, whole)
    edges = np.searchsorted(doc, np.arange(block.n + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        shingles[a:b].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    kept = np.r_[0, np.cumsum(new)]
    return shingles[new], kept[edges]


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on order; equal sets have equal ids."""
    total = np.r_[U64(0), np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)), dtype=U64)]
    sizes = np.diff(bounds).astype(U64)
    return mix(total[bounds[1:]] - total[bounds[:-1]] + sizes)


@dataclass(frozen=True)
class Bands:
    """Equal-size bands for one similarity, and the signature scheme of each.

    Band i holds sizes low[i]..low[i + 1] - 1. Scheme i serves pairs whose larger set is in
    band i: its k bounds their difference, 2 * n1 > k, and a little slack in n1 lets nearly
    every set do without signatures of empty parts.
    """

    low: np.ndarray
    k: np.ndarray
    n1: np.ndarray
    similarity: Fraction

    @staticmethod
    def of(similarity: Fraction, largest: int) -> Bands:
        low = [1]
        while low[-1] <= largest:
            low.append(int(low[-1] / similarity) + 1)
        low.append(int(low[-1] / similarity) + 1)
        high = np.array(low[1:]) - 1
        k = np.array([int(2 * int(u) * (1 - similarity) / (1 + similarity)) for u in high])
        n1 = np.ceil((k + 1) / 2 * _SLACK).astype(np.int64)
        return Bands(np.array(low), k, n1, similarity)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def apart(self, sizes: np.ndarray, scheme: np.ndarray) -> np.ndarray:
        """In how many elements sets of these sizes differ at most from those they link with in a scheme."""
        p, q = self.similarity.numerator, self.similarity.denominator
        other = np.minimum(sizes * q // p, self.low[scheme + 1] - 1)
        return (sizes + other) * (q - p) // (q + p)


def signatures(
    values: np.ndarray, bounds: np.ndarray, bands: Bands, frequent: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(set index, signature) pairs of the non-empty sets.

    frequent: sorted shingles to leave out of the domain where that is safe.
    """
    sizes = np.diff(bounds)
    every = np.flatnonzero(sizes)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rare = frequent[at] != values
        rare_bounds = np.r_[0, np.cumsum(rare)][bounds]
    heads, sigs = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for step in (0, 1):
        scheme = bands.band(np.maximum(sizes, 1)) + step
        useful = every[bands.apart(sizes, scheme)[every] > 0]  # otherwise only equal sets link
        if len(frequent):
            who, sig, safe = _domain(values[rare], rare_bounds, sizes, scheme, useful, bands, 1, False)
            heads.append(who)
            sigs.append(sig)
            useful = useful[~safe[useful]]
        who, sig, _ = _domain(values, bounds, sizes, scheme, useful, bands, 0, True)
        heads.append(who)
        sigs.append(sig)
    return np.concatenate(heads), np.concatenate(sigs)


def _domain(values, bounds, full, scheme, useful, bands: Bands, tag: int, last: bool):
    """Signatures of the `useful` sets over one domain, and which sets are safe there.

    full: sizes of the sets with all their elements. Linked sets spoil a first-level partition only by two differences, so of any `need` of them one
    gives a match, on the pair of parts that one difference leaves alone. A set therefore sends only
    pairs that hold as many elements as every pair of its `need` fullest partitions: of two linked sets
    the one that asks for more finds its match, and the other one sends that pair too. The set is safe
    if that is one element at least; the `last` domain sends the empty pairs of sets that are not.
    """
    sizes = np.diff(bounds)
    own = np.repeat(np.arange(len(sizes)), sizes)
    wanted = np.zeros(len(sizes), bool)
    wanted[useful] = True
    picked = wanted[own]
    values, own = values[picked], own[picked]
    n1 = np.where(wanted, bands.n1[scheme], 0)
    base = np.r_[0, np.cumsum(3 * n1)]
    total = np.r_[U64(0), np.cumsum(mix(values + U64(0x632BE59BD9B4E019)), dtype=U64)]
    # Values are sorted and uniform, so a part is a range of them.
    part = ((values >> U64(32)) * (3 * n1[own]).astype(U64) >> U64(32)).astype(np.int64)
    filled = np.bincount(base[own] + part, minlength=base[-1])
    ends = np.cumsum(filled)
    sums = (total[ends] - total[ends - filled]).reshape(-1, 3)
    filled = filled.reshape(-1, 3)
    who = np.repeat(np.arange(len(sizes)), n1)
    place = tx.spans(np.zeros(len(n1), np.int64), n1)
    code = (scheme[who].astype(U64) << U64(40)) + (place.astype(U64) << U64(3)) + U64(4 * tag)
    least = filled.sum(1) - filled.max(1)  # elements of each partition's emptiest pair
    least = least[np.lexsort((-least, who))]
    need = bands.apart(full, scheme) // 2 + 1
    asked = np.zeros(len(sizes), np.int64)
    asked[useful] = least[base[useful] // 3 + need[useful] - 1]
    safe = asked > 0
    least_sent = (asked if last else np.maximum(asked, 1))[who]
    heads, sigs = [], []
    for s, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        emit = filled[:, a] + filled[:, b] >= least_sent
        mixed = sums[emit, a] + mix(sums[emit, b] + U64(s)) + mix(code[emit] + U64(s))
        heads.append(who[emit])
        sigs.append(mix(mixed))
    return np.concatenate(heads), np.concatenate(sigs), safe


def _six(values: np.ndarray) -> np.ndarray:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _pack(sigs: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: set ids, how many signatures each has, and six bytes of each."""
    bucket = (sigs >> U64(48)).astype(np.int64) * buckets >> 16
    order = np.lexsort((ids, bucket))
    bucket, ids, sigs = bucket[order], ids[order], _six(sigs[order])
    new = np.r_[True, (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])]
    head = np.flatnonzero(new)
    many = np.diff(np.r_[head, len(ids)]).astype(np.uint32)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[at[1:], len(bucket)]
    h0, h1 = np.searchsorted(head, at), np.searchsorted(head, ends)
    blob = lambda values, a, b: pa.array(
        [values[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()
    )
    columns = [pa.array(bucket[at].astype(np.int32)), blob(ids[head], h0, h1), blob(many, h0, h1), blob(sigs, at, ends)]
    return pa.record_batch(columns, names=["bucket", "a0", "a1", "a2"])


def _groups(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, u, v): each other set v that has a signature in common with the least set u of those that send it.

    The group tells which sets share the signature, and comes once; a group of two is 0.
    """
    order = np.lexsort((ids, sigs))
    sigs, ids = sigs[order], ids[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])
    sigs, ids = sigs[new], ids[new]
    head = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, np.int64)
    bounds = np.r_[head, len(ids)]
    sizes = np.diff(bounds)
    group = np.where(sizes > 2, set_ids(ids, bounds) | U64(1), U64(0))
    first = np.zeros(len(head), bool)
    first[np.unique(group, return_index=True)[1]] = True
    keep = np.repeat((sizes > 1) & (first | (group == 0)), sizes)
    keep[head] = False
    group, u, v = np.repeat(group, sizes)[keep], np.repeat(ids[head], sizes)[keep], ids[keep]
    order = np.lexsort((v, u, group))
    group, u, v = group[order], u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (group[1:] != group[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return group[new], u[new], v[new]


def candidate_groups(docs: DataFrame, similarity: Fraction, width: int, frequent: np.ndarray) -> DataFrame:
    """(g, u, v) as `_groups` makes them of the sets that share a signature."""
    buckets = bucket_count(docs, _BUCKET_BYTES)
    sent_frequent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        schemes = Bands.of(similarity, 64)
        seen: set[int] = set()
        ids, sigs, held = [], [], 0
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                values, bounds = shingle_sets(block, width)
                sizes = np.diff(bounds)
                if len(sizes) and sizes.max() >= schemes.low[-2]:
                    schemes = Bands.of(similarity, int(sizes.max()))
                own = set_ids(values, bounds)
                who, sig = signatures(values, bounds, schemes, sent_frequent.value)
                fresh = np.array([not (x in seen or seen.add(x)) for x in own.tolist()], bool)
                who, sig = who[fresh[who]], sig[fresh[who]]
                ids.append(own[who])
                sigs.append(sig)
                held += len(sig)
                if held >= _CHUNK:
                    yield _pack(np.concatenate(sigs), np.concatenate(ids), buckets)
                    ids, sigs, held = [], [], 0
        if held:
            yield _pack(np.concatenate(sigs), np.concatenate(ids), buckets)

    def meet(ids: np.ndarray, many: np.ndarray, raw: np.ndarray) -> pa.Table:
        made = _groups(_from_six(raw), np.repeat(ids, many))
        return pa.table({name: x.view(np.int64) for name, x in zip("guv", made, strict=True)})

    sent = map_batches(docs, ["text"], run, packed_schema(3))
    return by_bucket(sent, [U64, np.uint32, np.uint8], meet, "g long, u long, v long")


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(kind, doc_id, id, n, bins): kind 0, the set id, size and histogram of each row; kind 1, a
    shingle that is frequent in one chunk of a task, and how many of the chunk's sets hold it."""

    def frequent(held: list[np.ndarray], sets: int):
        if not held:
            return None
        values = np.sort(np.concatenate(held))
        head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        many = np.diff(np.r_[head, len(values)])
        keep = many >= max(3, sets * _FREQUENT / 2)
        return values[head[keep]], many[keep]

    def rows(kind: int, docs_: pa.Array, ids: np.ndarray, n: np.ndarray, bins: pa.Array) -> pa.RecordBatch:
        columns = [np.full(len(ids), kind, np.int32), docs_, ids.view(np.int64), n.astype(np.int64), bins]
        return pa.record_batch([pa.array(c) for c in columns], names=["kind", "doc_id", "id", "n", "bins"])

    def common(found) -> pa.RecordBatch:
        none = len(found[0])
        return rows(1, pa.nulls(none, pa.int64()), *found, pa.nulls(none, pa.binary()))

    def run(batches):
        held, sets, size = [], 0, 0
        seen: set[int] = set()
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                values, bounds = shingle_sets(block, width)
                ids, sizes = set_ids(values, bounds), np.diff(bounds)
                bins = pa.array([h.tobytes() for h in histograms(values, bounds)], pa.binary())
                yield rows(0, batch.column(0).slice(block.first, block.n), ids, sizes, bins)
                fresh = np.array([not (x in seen or seen.add(x)) for x in ids.tolist()], bool)
                held.append(values[np.repeat(fresh, sizes)])
                sets, size = sets + int(fresh.sum()), size + len(held[-1])
                if size > 4 * _CHUNK:
                    yield common(frequent(held, sets))
                    held, sets, size = [], 0, 0
        found = frequent(held, sets)
        if found is not None:
            yield common(found)

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(typed, ["doc_id", "text"], run, "kind int, doc_id long, id long, n long, bins binary")


def histograms(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """How many elements of each set fall into each of some ranges of equal width, 255 at most.

    There are _BINS ranges, doubled until they hold _PER_BIN elements on average at most: with more
    elements a range, chance would make the histograms of unlike sets too similar.
    """
    sizes = np.diff(bounds)
    finer = np.ceil(np.log2(np.maximum(sizes / (_BINS * _PER_BIN), 1))).astype(np.int64)
    base = np.r_[0, np.cumsum(_BINS << finer)]
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = base[own] + (values >> (57 - finer[own]).astype(U64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=base[-1]), 255).astype(np.uint8)
    return [counts[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _coarser(bins: np.ndarray, ranges: int) -> np.ndarray:
    """Rows of histograms as they would be with so many ranges."""
    bins = bins.astype(np.int16)
    return bins if bins.shape[1] == ranges else np.minimum(bins.reshape(len(bins), ranges, -1).sum(2), 255).astype(np.int16)


def _may_link(similarity: Fraction, one: np.ndarray, other: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in `apart` elements at least can be linked."""
    p, q = similarity.numerator, similarity.denominator
    return (p + q) * (one + other - apart) >= 2 * p * (one + other)


class _Sets:
    """Some sets, by size and histogram alone or with their elements."""

    def __init__(self, similarity: Fraction, sizes: np.ndarray, bins: list[np.ndarray], values: list | None):
        self.similarity, self.sizes, self.values = similarity, sizes, values
        self.ranges = np.array([len(b) for b in bins])
        self.place = np.zeros(len(bins), np.int64)  # among the histograms of as many ranges
        self.bins = {}
        for n in np.unique(self.ranges).tolist():
            own = np.flatnonzero(self.ranges == n)
            self.place[own] = np.arange(len(own))
            self.bins[n, n] = np.stack([bins[x] for x in own]).astype(np.int16)

    def _histograms(self, n: int, ranges: int) -> np.ndarray:
        if (n, ranges) not in self.bins:
            self.bins[n, ranges] = _coarser(self.bins[n, n], ranges)
        return self.bins[n, ranges]

    def _apart(self, a: int, others: np.ndarray) -> np.ndarray:
        """In how many elements the others differ from a, at least."""
        apart, own = np.zeros(len(others), np.int64), int(self.ranges[a])
        for n in np.unique(self.ranges[others]).tolist():
            some, ranges = self.ranges[others] == n, min(n, own)
            rows = self._histograms(n, ranges)[self.place[others[some]]]
            apart[some] = np.abs(rows - self._histograms(own, ranges)[self.place[a]]).sum(1, dtype=np.int64)
        return apart

    def linked(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that can be linked with a, or that are if elements are given."""
        size = self.sizes[a]
        others = others[_may_link(self.similarity, size, self.sizes[others], np.abs(self.sizes[others] - size))]
        others = others[_may_link(self.similarity, size, self.sizes[others], self._apart(a, others))]
        if self.values is None or not len(others):
            return others
        own = self.values[a]
        pool = np.concatenate([self.values[b] for b in others])
        at = np.minimum(np.searchsorted(own, pool), len(own) - 1)
        ends = np.cumsum(self.sizes[others])
        same = np.r_[0, np.cumsum(own[at] == pool)]
        common = same[ends] - same[ends - self.sizes[others]]
        return others[_may_link(self.similarity, size, self.sizes[others], size + self.sizes[others] - 2 * common)]

    def forest(self, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
        """Links that join whatever the links between the two sides join of the given groups."""
        group, links, square = group.copy(), [], left is right
        for i, a in enumerate(left.tolist()):
            others = right[i + 1 :] if square else right
            others = others[group[others] != group[a]]
            if len(others):
                found = self.linked(a, others)
                joined, first = np.unique(group[found], return_index=True)
                links += [(a, b) for b in found[first].tolist()]
                group[np.isin(group, joined)] = group[a]
        return links


def possible_links(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and histograms leave it open that they are linked.

    sets: id, size and bins.
    """
    importable(pairs.sparkSession)
    both = pairs
    for side in "uv":
        both = both.join(sets.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("bins").alias(f"bins_{side}")), side)
    both = both.select("u", "v", "size_u", "size_v", "bins_u", "bins_v")

    def run(batches):
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in (2, 3)]
            open_ = np.flatnonzero(_may_link(similarity, *sizes, np.abs(sizes[0] - sizes[1])))
            ranges = [pc.binary_length(batch.column(c)).to_numpy()[open_] for c in (4, 5)]
            keep = []
            for n, m in np.unique(np.stack(ranges, 1), axis=0).tolist():
                some, least = open_[(ranges[0] == n) & (ranges[1] == m)], min(n, m)
                for part in np.array_split(some, math.ceil(len(some) * max(n, m) / _PART)):
                    rows = [
                        _coarser(np.frombuffer(b"".join(batch.column(c).take(pa.array(part)).to_pylist()), np.uint8).reshape(-1, k), least)
                        for c, k in ((4, n), (5, m))
                    ]
                    apart = np.abs(rows[0] - rows[1]).sum(1, dtype=np.int64)
                    keep.append(part[_may_link(similarity, sizes[0][part], sizes[1][part], apart)])
            if keep:
                yield batch.select([0, 1]).take(pa.array(np.concatenate(keep)))

    return both.mapInArrow(run, "u long, v long")


def open_groups(groups: DataFrame, stars: DataFrame) -> DataFrame:
    """(set_id, label, root, n): the groups whose sets the links `stars` leave in several components.

    label: a set's component; what lies in one needs no comparison. n: sets of the group `root`.
    Many signatures of a large family of similar sets make as many groups that differ little.
    Large groups that overlap are taken as one where that makes fewer pairs to compare.
    """
    many = groups.where("g <> 0")
    members = many.select("g", F.col("v").alias("set_id")).union(many.select("g", "u")).distinct()
    joined = components(stars, "joined").select(F.col("node").alias("set_id"), F.col("root").alias("label"))
    members = members.join(joined, "set_id", "left").select("g", "set_id", F.coalesce("label", "set_id").alias("label"))
    members = written(members, "members")
    sizes = members.groupBy("g").agg(
        F.count("*").alias("n"), F.min("set_id").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    sizes = written(sizes.where("low <> high").select("g", "n", "first"), "open")
    large = sizes.where(F.col("n") > _TILE)
    edges = members.join(large, "g").select(F.col("first").alias("u"), F.col("set_id").alias("v"))
    merged = written(components(edges, "families"), "families")
    pairs = large.join(merged, F.col("first") == F.col("node")).select("g", "root", F.expr("n * n").alias("pairs"))
    families = pairs.groupBy("root").agg(F.sum("pairs").alias("pairs"))
    families = merged.groupBy("root").agg(F.count("*").alias("n")).join(families, "root").where("n * n <= pairs").select("root", "n")
    taken = pairs.join(families, "root").select("g")
    single = members.join(sizes.join(taken, "g", "left_anti"), "g").select("set_id", "label", F.col("g").alias("root"), "n")
    whole = merged.join(families, "root").join(members.select("set_id", "label").distinct(), F.col("node") == F.col("set_id"))
    return single.union(whole.select("set_id", "label", "root", "n"))


def _tile_links(members: DataFrame, similarity: Fraction, buckets: int, exact: bool) -> DataFrame:
    """(u, v): a forest of links per tile.

    members: set_id, root and group size n, and `bins` with `size` and `label`, or the elements as
    `values`. Sets of one label count as joined.
    """
    importable(members.sparkSession)
    sides = F.greatest(F.least(F.ceil(F.col("n") / _TILE), F.lit(_SIDES)), F.ceil(F.col("n") / _MOST))
    sets = members.withColumn("sides", sides.cast("int"))
    sets = sets.withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("sides")).cast("int"))
    payload = ["values"] if exact else ["bins", "size", "label"]
    tiled = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        "root", "set_id", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), *payload
    )
    tiled = tiled.withColumn("bucket", F.pmod(F.xxhash64("root", "i", "j"), F.lit(buckets)).cast("int"))

    def load(table: pa.Table, own: np.ndarray) -> _Sets:
        blobs = table.column(payload[0])
        if exact:
            values = [np.frombuffer(blobs[int(x)].as_py(), U64) for x in own]
            sizes = np.array([len(v) for v in values], np.int64)
            bins = histograms(np.concatenate(values), np.r_[0, np.cumsum(sizes)])
            return _Sets(similarity, sizes, bins, values)
        bins = [np.frombuffer(blobs[int(x)].as_py(), np.uint8) for x in own]
        return _Sets(similarity, table.column("size").to_numpy()[own], bins, None)

    def compare(table: pa.Table) -> pa.Table:
        u, v = [], []
        roots, i, j, side, ids = (table.column(c).to_numpy() for c in ("root", "i", "j", "side", "set_id"))
        label = ids if exact else table.column("label").to_numpy()
        order = np.lexsort((ids, j, i, roots))
        new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (roots, i, j)], axis=0)]
        for own in np.split(order, np.flatnonzero(new)[1:]):
            own = own[np.r_[True, ids[own][1:] != ids[own][:-1]]]  # a doc_id may repeat
            place = np.arange(len(own))
            square = i[own[0]] == j[own[0]]
            left = place if square else place[side[own] == i[own]]
            right = place if square else place[side[own] == j[own]]
            group = np.unique(label[own], return_inverse=True)[1]
            for a, b in load(table, own).forest(left, right, group):
                u.append(ids[own[a]])
                v.append(ids[own[b]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return tiled.groupBy("bucket").applyInArrow(compare, "u long, v long")


def _grouped(pairs: DataFrame, name: str) -> DataFrame:
    """(node, root, n): components of the pairs, with their sizes."""
    groups = written(components(pairs, name), name)
    return groups.join(groups.groupBy("root").agg(F.count("*").alias("n")), "root")


def with_elements(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """`members` (doc_id, set_id, root, n: one document per set) with the elements of the sets."""
    importable(docs.sparkSession)
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    side = members.withColumnRenamed("doc_id", "member").hint("shuffle_hash")
    texts = doc.join(side, doc["doc_id"].eqNullSafe(side["member"])).select("set_id", "root", "n", "text")

    def run(batches):
        for batch in batches:
            for block in tx.blocks(batch.column(3)):
                values, bounds = shingle_sets(block, width)
                ids = set_ids(values, bounds).view(np.int64)
                own = batch.slice(block.first, block.n)
                # A doc_id may repeat with another text.
                right = np.flatnonzero(ids == own.column(0).to_numpy())
                blobs = [values[bounds[d] : bounds[d + 1]].tobytes() for d in right]
                taken = own.take(pa.array(right))
                yield pa.record_batch([*taken.columns[:3], pa.array(blobs, pa.binary())], names=["set_id", "root", "n", "values"])

    return texts.mapInArrow(run, "set_id long, root long, n long, values binary")


def jaccard_components(docs: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """Per row: doc_id, set_id, n_shingles, component_id (the least doc_id reachable by links)."""
    spark = docs.sparkSession
    table = written(set_table(docs, width), "sets")
    rows = table.where("kind = 0").select("doc_id", F.col("id").alias("set_id"), F.col("n").alias("n_shingles"))
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    # Sets hold n / rows shingles on average, so at most average / _FREQUENT shingles are frequent.
    least = rows.where("n_shingles > 0").select("set_id").distinct().count() * _FREQUENT
    common = table.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(3.0, least)))
    frequent = np.sort(np.array([r["id"] for r in common.select("id").toLocalIterator()], np.int64).view(np.uint64))
    buckets = bucket_count(docs, _BUCKET_BYTES)
    groups = written(candidate_groups(docs, similarity, width, frequent), "candidates")
    sets = table.where("kind = 0 AND n > 0").groupBy("id").agg(F.first("bins").alias("bins"), F.first("n").alias("size"))
    stars = written(possible_links(groups.select("u", "v").distinct(), sets, similarity), "stars")
    rough = open_groups(groups, stars).join(sets, F.col("set_id") == F.col("id")).drop("id")
    possible = written(stars.union(_tile_links(rough, similarity, buckets, exact=False)), "possible")
    fine = _grouped(possible, "finer").join(classes, F.col("node") == F.col("set_id"))
    members = fine.select(F.col("least").alias("doc_id"), "set_id", "root", "n")
    links = _tile_links(with_elements(docs, members, width), similarity, buckets, exact=True)
    found = components(links, "links")
    near = found.join(classes, F.col("node") == F.col("set_id")).select("root", "set_id", "least")
    near = written(near, "near")
    tops = near.groupBy("root").agg(F.min("least").alias("top"))
    merged = near.join(tops, "root").select("set_id", "top")
    best = classes.join(merged, "set_id", "left").select("set_id", F.coalesce("top", "least").alias("component_id"))
    best = written(best, "components")
    joined = rows.join(best, "set_id", "left")
    return joined.select("doc_id", "set_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_unique(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents, all columns, of which one of each component stays: that of least doc_id.

    A document without a doc_id has no rank and stays. Rows that share a doc_id share their fate.
    """
    found = jaccard_components(docs, width, similarity)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull())
    ids = kept.select(F.col("doc_id").alias("_kept")).distinct().hint("shuffle_hash")
    rows = boxed(docs).join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")))
    return unboxed(rows, docs.columns)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = jaccard_components(docs, 3, Fraction(9, 10))
    return found.select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, w, least(3, len(w)) AS size, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS k FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + size - 1], ' ') AS gram FROM p
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS whole FROM s GROUP BY doc_id
), r AS (
  SELECT whole, min(doc_id) AS rep, min(n) AS n FROM n GROUP BY whole
), t AS (
  SELECT rep, r.n, gram FROM s JOIN n USING (doc_id) JOIN r USING (whole) WHERE doc_id = rep
), links AS (
  SELECT a.rep AS u, b.rep AS v
  FROM t a JOIN t b ON a.gram = b.gram AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT rep AS u, rep AS v FROM r UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u
), c AS (
  SELECT u AS rep, min(v) AS component_id FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (whole) LEFT JOIN c USING (rep)
"""


def brute_force(documents: list, width: int, similarity: Fraction) -> dict:
    """The same by comparing all pairs, for tests: {doc_id: (n_shingles, component_id)}."""
    import re

    sets, parent = {}, {}
    for doc_id, text in documents:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(width, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        parent[doc_id] = doc_id

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: (len(sets[i]), top(i)) for i in ids}
