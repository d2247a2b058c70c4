"""An n-gram Jaccard join with prefix trees.

A document's set holds the hashes of its distinct word n-grams.  Two documents link when
100 * intersection >= PERCENT * union.  All of the steps below keep every link:

1. Equal sets become one (by two sums of mixed hashes and the size); links join distinct sets.
2. The Jaccard index of a set of n grams with another set is at most n / (n + 1), so a set for which that
   is too little can't link.  It can lack at most miss = n - ceil(n * PERCENT / 100) grams of its partner,
   so a set with more than `miss` grams that no other set has can't link.  This is tested first on the fixed
   quarter of the grams whose hashes are smallest, of which at most `miss` may be unshared too,
   and then, for the sets that are left, on all grams.
3. Grams are ordered from rare to frequent, equally frequent ones by hash; this order is the same everywhere.
   Linked sets share one of their first miss + 1 grams, and their sizes are in the same or in neighbouring
   classes, so the sets are put into buckets: the connected components of sharing such a gram in such classes.
4. In a bucket the sets, from frequent to rare, are stored in a compressed trie.  Each set walks the trie; the
   overlap so far is shared by all sets below a node, and a subtree is left when even all remaining grams
   couldn't reach the overlap that its smallest set needs, or when all its sets are joined with the walker.
5. A bucket over BLOCK sets or BLOCK_GRAMS grams is dealt to blocks of that size, twice by different hashes, so
   that sets of large groups of copies join.  All sets but those of its largest group so far then meet all
   blocks, which gives the links that are left.

The links found in a bucket are returned as a forest, and joined to components.  A null or empty text, or
one without words, has an empty set and no links.  Ties don't matter: all links at the bound count.  Long
texts are cut into words in pieces, and their sets used whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.batches import chunked, mix, text_buffer, word_hashes
from lumenframe.llm.graph import components
from lumenframe.llm.tables import cut, drop

U64 = np.uint64
#: Sets that one trie holds, about, and grams of those sets.
BLOCK, BLOCK_GRAMS = 2_000, 1 << 21
#: Grams that an edge of a trie holds at most.
EDGE = 32
#: Grams whose hash, as unsigned, is below this are counted in step 2.
QUARTER = U64(1 << 62)
#: Bits of the filter of the keys whose texts are read a second time (4 MB), a power of 2.
FILTER_BITS = 1 << 25


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of all texts, and the offsets of each text's."""
    data, offsets = text_buffer(column)
    words, of = word_hashes(data, offsets)
    texts = len(offsets) - 1
    if len(words) == 0:
        return np.zeros(0, dtype=U64), np.zeros(texts + 1, dtype=np.int64)
    per = np.bincount(of, minlength=texts)
    width = np.minimum(per, n)[of]  # a text of fewer words is one gram
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    place = np.arange(len(words)) - first[of]
    heads = np.flatnonzero(place + width <= per[of])
    gram = np.zeros(len(heads), dtype=U64)
    for k in range(n):
        inside = width[heads] > k
        gram[inside] = mix(gram[inside] * U64(0x9E3779B97F4A7C15) + words[heads[inside] + k] + U64(k + 1))
    where = of[heads]
    order = np.lexsort((gram, where))
    gram, where = gram[order], where[order]
    fresh = np.append(True, (gram[1:] != gram[:-1]) | (where[1:] != where[:-1]))
    gram, where = gram[fresh], where[fresh]
    return gram, np.searchsorted(where, np.arange(texts + 1))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64), pa.int64()))


def shingled(docs: DataFrame, n: int, everything: bool, wanted: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """(doc_id, h, n, sig_a, sig_b, grams) for rows (doc_id, text); grams are all, or the smallest quarter; h is the text's hash.

    wanted tells of a batch's keys which rows to take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = batches if wanted is None else (b.filter(wanted(b.column("doc_id"))) for b in batches)
        for batch in chunked(some, "text"):
            gram, offsets = shingle_sets(batch.column("text"), n)
            sums = []
            for salt in (0x51ED270B35D89F1D, 0xC3A5C85C97CB3127):
                total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(gram ^ U64(salt)), dtype=U64)])
                sums.append(pa.array((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64), pa.int64()))
            sizes = np.diff(offsets)
            if not everything:
                few = gram < QUARTER
                offsets = np.concatenate([[0], np.cumsum(few)])[offsets]
                gram = gram[few]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), *sums, _lists(gram, offsets)], names=["doc_id", "h", "n", "sig_a", "sig_b", "grams"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n long, sig_a long, sig_b long, grams array<long>")


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Three places in a filter of so many bits for each key, a row for each of the three."""
    h = keys.astype(np.int64).view(U64)
    return np.stack([mix(h + U64((k * 0x9E3779B97F4A7C15) % (1 << 64))) & U64(size - 1) for k in (1, 2, 3)]).astype(np.int64)


def key_filter(keys: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of a column of longs without nulls, as 64-bit words; it never misses one of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch.column(0).to_numpy(), size))
            words, start = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), start) if len(at) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(bits.view(np.int64), pa.int64())], names=["w", "bits"])

    rows = keys.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(max(1, size >> 6), dtype=U64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return out


def _passed(keys: pa.Array, words: np.ndarray, size: int) -> pa.Array:
    at = _bits(keys.fill_null(0).to_numpy(zero_copy_only=False), size)
    ok = ((words[at >> 6] >> (at & 63).astype(U64)) & U64(1)).all(axis=0)
    return pa.array(ok & keys.is_valid().to_numpy(zero_copy_only=False))


def whole_sets(docs: DataFrame, likely: DataFrame, n: int) -> DataFrame:
    """likely (id, doc_id, n, sig_a, sig_b) with h and all grams, once for each set, from the texts of docs (doc_id, text).

    Texts are not dealt by key for this: a filter of the keys, of fixed size however many there are, goes to
    all tasks, and what it lets through is shingled where it is read.  The join that follows is exact.
    """
    size = FILTER_BITS
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(likely.select("doc_id"), size))
    same = ["doc_id", "n", "sig_a", "sig_b"]
    # Told in the function that shingles: a task with two Python nodes holds two workers, and an executor keeps them all.
    some = shingled(docs, n, True, lambda keys: _passed(keys, shared.value, size))
    # A set has one id, so rows of one key and set are told by the columns that the join has dealt them by.
    return some.join(likely, same).dropDuplicates(same)


def need(x: int | np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of these sizes need to link."""
    return -(-(percent * (x + y)) // (100 + percent))


class Trie:
    """A compressed trie over sets of small integers, each sorted; nodes are in breadth-first order."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        ranked = [sets[i] for i in self.order]
        shared = [0] * len(ranked)  # with the set before
        for k in range(1, len(ranked)):
            a, b = ranked[k - 1], ranked[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(differ[0]) if len(differ) else m
        # A node: [depth where its edge starts, where it ends, first and last set, children].
        # A set that is the beginning of the next one is a leaf with an empty edge.
        root = [0, 0, 0, 0, []]
        path = [root]
        for k, s in enumerate(ranked):
            depth = shared[k]
            last = None
            while path[-1][1] > depth:
                last = path.pop()
            if path[-1][1] < depth or (last is not None and path[-1][0] > depth):
                # the edge of `last` is split at depth
                upper = [last[0], depth, last[2], k, [last]]
                path[-1][4][-1] = upper
                last[0] = depth
                path.append(upper)
            leaf = [depth, len(s), k, k, []]
            top = path[-1]
            if top is not root and not top[4]:  # the set before ends here: give it an own leaf
                top[4].append([top[1], top[1], top[2], top[2], []])
            top[4].append(leaf)
            path.append(leaf)
        level, nodes = [root], []
        children: list[tuple[int, int]] = []
        at = 1
        while level:
            below = []
            for node in level:
                if node[1] - node[0] > EDGE:
                    node[1], node[4] = node[0] + EDGE, [[node[0] + EDGE, node[1], node[2], node[3], node[4]]]
                children.append((at, at + len(node[4])))
                at += len(node[4])
                below += node[4]
            nodes += level
            level = below
        self.begin, self.end = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.child, self.past = np.array([c[0] for c in children]), np.array([c[1] for c in children])
        self.leaf = np.array([-1 if n[4] else n[2] for n in nodes])
        if len(nodes) == 1:
            self.leaf[0] = -1
        runs = [ranked[n[2]][n[0] : n[1]] for n in nodes]
        self.flat = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        # The last gram on the way to a node, its smallest and largest set, and the first and last of its sets in order.
        size = np.array([len(s) for s in ranked])
        self.small, self.large, self.tail = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.full(len(nodes), -1, np.int64)
        self.first, self.last = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for i in range(len(nodes) - 1, -1, -1):
            if self.leaf[i] >= 0:
                self.small[i] = self.large[i] = size[self.leaf[i]]
                self.first[i] = self.last[i] = self.leaf[i]
            elif self.past[i] > self.child[i]:
                below = slice(self.child[i], self.past[i])
                self.small[i], self.large[i] = self.small[below].min(), self.large[below].max()
                self.first[i], self.last[i] = self.first[below].min(), self.last[below].max()
            if self.end[i] > 0:
                self.tail[i] = ranked[nodes[i][2]][self.end[i] - 1]
        self.inside = np.zeros(int(self.flat.max(initial=-1)) + 1, dtype=bool)

    def partners(self, x: np.ndarray, percent: int, label: np.ndarray | None = None, own: int = -1) -> np.ndarray:
        """Places, in the trie's order, of sets that link with x.

        Subtrees whose sets all have the label `own` are left out; label is by place.
        """
        label = np.full(len(self.order), -2) if label is None else label
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        self.inside[x[x < len(self.inside)]] = True
        nodes, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        found = [np.zeros(0, dtype=np.int64)]
        while len(nodes):
            n = self.past[nodes] - self.child[nodes]
            overlap = np.repeat(overlap, n)
            nodes = _ranges(self.child[nodes], n)
            other = (changes[self.last[nodes]] != changes[self.first[nodes]]) | (label[self.first[nodes]] != own)
            nodes, overlap = nodes[other], overlap[other]
            grams = self.at[nodes + 1] - self.at[nodes]
            hits = np.concatenate([[0], np.cumsum(self.inside[self.flat[_ranges(self.at[nodes], grams)]])])
            ends = np.cumsum(grams)
            overlap = overlap + hits[ends] - hits[ends - grams]
            left = np.minimum(len(x) - np.searchsorted(x, self.tail[nodes], side="right"), self.large[nodes] - self.end[nodes])
            alive = overlap + left >= need(len(x), self.small[nodes], percent)
            nodes, overlap = nodes[alive], overlap[alive]
            found.append(self.leaf[nodes][self.leaf[nodes] >= 0])
        self.inside[x[x < len(self.inside)]] = False
        return np.concatenate(found)


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] numbers), then the same for the next."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)


def forest(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], often: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (id, id) that, with sets of equal groups being joined, join exactly what all links of these sets join.

    often are the numbers of sets in which the grams occur.
    """
    grams, at, flat = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    rank = np.empty(len(grams), dtype=np.int64)
    rank[np.lexsort((grams, -np.concatenate(often)[at]))] = np.arange(len(grams))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    local = [np.sort(part) for part in np.split(rank[flat], cuts)]
    trie = Trie(local)
    order = np.array(trie.order)
    label = np.unique(groups, return_inverse=True)[1][order]
    links, left = [], len(np.unique(label))
    for place, k in enumerate(trie.order):
        if left == 1:
            break
        for j in trie.partners(local[k], percent, label, label[place]).tolist():
            if label[j] != label[place]:
                label[label == label[j]] = label[place]
                left -= 1
                links.append((int(ids[k]), int(ids[order[j]])))
    return links


def walked(units: DataFrame, percent: int) -> DataFrame:
    """(a, b): links found in the tries of rows (unit, id, comp, grams, often), one trie for each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m = batch.column("m").slice(k, 1).flatten()
                ids, comp, lists, often = m.field("id").to_numpy(), m.field("comp").to_numpy(), m.field("grams"), m.field("often")
                places = np.unique(ids, return_index=True)[1]
                found = forest(ids[places], comp[places], [lists[int(i)].values.to_numpy() for i in places], [often[int(i)].values.to_numpy() for i in places], percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return units.groupBy("unit").agg(F.collect_list(F.struct("id", "comp", "grams", "often")).alias("m")).select("m").mapInArrow(run, "a long, b long")


def buckets_of(ordered: DataFrame, miss: Column, percent: int) -> DataFrame:
    """(id, root): sets that may link, and the smallest one of their bucket."""
    # Sizes of linked sets have at most this ratio; the classes are a little wider, for rounding.
    size = F.col("n").cast("int") if percent == 100 else F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.0001)).cast("int")
    both = F.arrays_zip(F.slice("grams", F.lit(1), (miss + 1).cast("int")).alias("g"), F.slice("often", F.lit(1), (miss + 1).cast("int")).alias("df"))
    first = cut(ordered.select("id", size.alias("c"), F.explode(both).alias("p")).filter("p.df > 1").select("id", "c", F.col("p.g").alias("g")))
    heads = cut(first.groupBy("g", "c").agg(F.min("id").alias("head")))
    stars = first.join(heads, ["g", "c"]).filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    beside = heads.select("g", (F.col("c") + 1).alias("c"), F.col("head").alias("a"))
    if percent < 100:
        stars = stars.unionByName(heads.join(beside, ["g", "c"]).filter("a != head").select("a", F.col("head").alias("b")))
    out = components(stars).select(F.col("node").alias("id"), "root")
    drop(first, heads)
    return out


def link(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join exactly the linked sets of rows (id, n, grams); written to the shared folder."""
    miss = F.col("n") - F.ceil(F.col("n") * percent / 100)
    sets = cut(sets)
    # The same test as on the quarter, now on all grams: only sets that can link are ordered below.
    alone = sets.select("id", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"), F.min("id").alias("id")).filter("df = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sets = cut(sets.join(alone, "id", "left").filter(F.coalesce("alone", F.lit(0)) <= miss).drop("alone"), sets)
    spread = sets.select("id", "n", F.explode("grams").alias("g"))
    often = spread.groupBy("g").agg(F.count("*").cast("int").alias("df"))
    pairs = spread.join(often, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    ordered = cut(pairs.select("id", "n", F.col("o.g").alias("grams"), F.col("o.df").alias("often")), sets)
    members = cut(buckets_of(ordered, miss, percent).join(ordered.select("id", "n"), "id"))
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    members = cut(members.join(sizes, "root").select("root", "id", "blocks"), members)
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    rounds = F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("round", F.explode(rounds)).select("id", F.col("id").alias("comp"), F.struct("root", "round", deal(F.col("blocks"), F.col("round"))).alias("unit"))
    links = cut(walked(dealt.join(ordered.select("id", "grams", "often"), "id"), percent))
    large = members.filter("blocks > 1")
    if large.isEmpty():
        drop(ordered, members)
        return links
    # What is left in large buckets: sets outside the largest group meet all sets.
    known = components(links.join(large.select(F.col("id").alias("a")), "a", "left_semi"))
    grouped = cut(large.join(known.select(F.col("node").alias("id"), F.col("root").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id")), known)
    largest = grouped.groupBy("root", "comp").agg(F.count("*").alias("k")).groupBy("root").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"))
    grouped = cut(grouped.join(largest, "root"), grouped)
    parts = grouped.filter("comp != main").groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    grouped = cut(grouped.join(parts, "root"), grouped)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every = grouped.select("id", "comp", "root", deal(F.col("blocks"), 2).alias("i"), upto("parts").alias("j"))
    rest = grouped.filter("comp != main").select("id", "comp", "root", upto("blocks").alias("i"), deal(F.col("parts"), 3).alias("j"))
    met = every.unionByName(rest).select("id", "comp", F.struct("root", "i", "j").alias("unit"))
    more = cut(walked(met.join(ordered.select("id", "grams", "often"), "id"), percent), grouped, ordered, members)
    return cut(links.unionByName(more), links, more)


def join(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id", mark: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs, and the hash of its text if `mark` names it.

    component_id is the smallest key that can be reached by links; that of a row without a key is null.
    Rows of equal key and text are one node; rows of equal key and different text are nodes of their own.
    Other columns are not looked at.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = cut(shingled(plain, n, False))
    some = sets.filter("n > 0 and doc_id is not null")
    same = ["sig_a", "sig_b", "n"]
    reps = some.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    # A set is known by its smallest key, or, where several sets have the same one, by a hash.
    twice = reps.groupBy("rep").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1").select("rep", F.lit(True).alias("several"))
    equal = cut(reps.join(twice, "rep", "left").select(*same, "rep", F.when(F.col("several"), F.xxhash64(*same)).otherwise(F.col("rep")).alias("id")))
    miss = F.col("n") - F.ceil(F.col("n") * percent / 100)
    # Of sets of other grams, one of n + 1 that holds all n is the nearest that a set of n can have.
    fits = 100 * F.col("n") >= percent * (F.col("n") + 1)
    # Rows are not brought to one for each set here: a gram of one set has one hash of sets, however many rows there are.
    spread = some.filter(fits).select(F.xxhash64(*same).alias("s"), F.explode("grams").alias("g"))
    alone = spread.groupBy("g").agg(F.max("s").alias("other"), F.min("s").alias("s")).filter("s = other").groupBy("s").agg(F.count("*").alias("alone"))
    open_ = equal.filter(fits).select("id", F.col("rep").alias("doc_id"), *same, F.xxhash64(*same).alias("s"))
    likely = cut(open_.join(alone, "s", "left").filter(F.coalesce("alone", F.lit(0)) <= miss).drop("alone", "s"))
    links = link(whole_sets(plain, likely, n).select("id", "n", "grams"), percent)
    roots = components(links)
    least = roots.join(equal.select(F.col("id").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    named = cut(equal.join(roots.select(F.col("node").alias("id"), "root").join(least, "root"), "id", "left").select(*same, F.coalesce("component", "rep").alias("component")), roots, links, likely, equal)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id"))).alias("component_id")
    out = ["doc_id", F.col("n").alias("n_shingles"), component] + ([F.col("h").alias(mark)] if mark else [])
    return sets.select("doc_id", "h", *same).join(named, same, "left").select(*out)
