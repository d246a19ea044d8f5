"""Near copies by exact similarity of shingle sets: a prefix-tree join.

Two texts are linked when the Jaccard similarity of their sets of word
shingles is at least 4/5. Shingles are told apart by their XXH64 hashes.

Order. All sets are sequences in one global order: shingles that recur in a
sample of the texts come last, the commonest at the very end; the others by
their hash. The order decides only how much work there is.

Meeting. A set of n that is to be 4/5 similar to another shares at least
ceil(4n/5) of its shingles with it, so the two share one of the first
n - ceil(4n/5) + 1 of each: these are the keys, under which the sets meet.
Where the first key that two sets of n and m share stands at i and j, they
share at most min(n - i, m - j) shingles, and a pair for which that is too
little goes; so the smaller set of a pair has that key among its first ninth.
A pair whose sketches (parities of cells) differ too much goes as well.

Verifying. The sets that met one probe form a prefix tree (``prefixtree``),
which the probe walks, with partial overlaps shared along common prefixes and
subtrees left by what remains of the lengths. A probe whom many sets met has
several trees, each of bounded size.

Rounds. First every set of a key is held against the key's leader alone, its
smallest set. What that links needs no more looking at, and neither do keys of
two sets nor the leaders. Where many sets of a
key are still outside its commonest component, further rounds hold the key's
sets against one other leader from within that component and one from without;
neighbouring keys take different ones, so loosely linked groups grow together
at a few pairs a set. Last, for every key whose other sets are still in
different components, each set outside the key's commonest component is held
against all others of the key. A similar pair
that the first round has left apart meets there, so no link between components
is lost, and a group of many near copies costs one pair each and not all.
Sketches travel with the rows of keys of many sets alone; the pairs of keys of
few sets are made first, once each however many keys they share.

A key that the sample shows to be very frequent is salted: each of its parts
has a leader, and the leaders of the parts are paired with the smallest one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, release, text_batches, unused
from .components import components
from .pretokens import forget
from .prefixtree import PrefixTree
from .simhash import majority, near_links, shingle_hashes

SHINGLE = 5
#: One of so many texts is looked at for common shingles.
SAMPLE = 32
#: Common shingles that are put last; the order of the others is that of their hashes.
COMMON = 200_000
#: Cells of the sketch of a set of up to as many shingles; larger sets have more, up to ``MOST_CELLS``.
CELLS, MOST_CELLS = 512, 16_384
#: Rows of a key, by the sample's count, beyond which it is cut into parts.
PART_ROWS = 200_000
#: Sets to a prefix tree.
TREE = 128
#: Sets of a key outside its commonest component from which on it gets other leaders, the rounds of that, and the different leaders of a round that equal sets of keys are given.
MANY, ROUNDS, LEADERS = 32, 2, 8
#: Marks of texts that are small enough to be sent to every task.
MARKS = 1_000_000


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the hashes, as longs. Two sets differ in as many hashes as their cells do, at least. Cells are the lowest bits of a hash, so a longer sketch folds onto a shorter one."""
    cells = CELLS
    while cells < min(len(own), MOST_CELLS):
        cells *= 2
    odd = np.bincount((own % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class CommonOrder:
    """Puts the hashes of a set into the global order; ``common`` are the common ones, rarest first, with their counts."""

    def __init__(self, common: np.ndarray, counts: np.ndarray):
        self.by_hash = np.argsort(common)
        self.ranked, self.common = common, common[self.by_hash]
        self.parts = np.minimum(counts * SAMPLE // PART_ROWS + 1, 30_000)

    def __call__(self, own: np.ndarray, node: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in order, and the part that the node has in each: 0 where a hash is not cut into parts, else from 1 on."""
        salts = np.zeros(len(own), np.int16)
        if not len(self.common) or not len(own):
            return own, salts
        at = np.minimum(np.searchsorted(self.common, own), len(self.common) - 1)
        known = self.common[at] == own
        ranks = np.sort(self.by_hash[at[known]])
        parts = self.parts[ranks]
        if len(ranks):
            salts[len(own) - len(ranks) :] = np.where(parts > 1, 1 + np.uint64(node) % parts.astype(np.uint64), 0)
        return np.concatenate([own[~known], self.ranked[ranks]]), salts


SETS = "doc_id struct<doc_id: long, mark: long>, node long, size int, hashes array<long>, salts array<smallint>, fp long, sketch array<long>"


class _Sets:
    """(row, text) to the row's set: its node, its size, and its hashes in the global order, all of them or the keys alone; with the keys also their parts, the fingerprint and the sketch."""

    def __init__(self, shingle: int, order: CommonOrder | None, keys: bool):
        self.shingle, self.order, self.keys = shingle, order, keys

    def __call__(self, batches):
        forget()
        for batch in batches:
            nodes, sizes, parts, salts, fps, marks = [], [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), self.shingle)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                n = len(own)
                sizes.append(n)
                ordered, salt = self.order(own, nodes[-1]) if self.order else (own, np.empty(0, np.int16))
                count = n - (4 * n + 4) // 5 + 1 if n else 0
                parts.append(ordered[:count] if self.keys else ordered)
                salts.append(salt[:count] if self.keys else salt[:0])
                fps.append(majority(hashes) if self.keys else 0)
                marks.append(parities(own) if self.keys else np.empty(0, np.int64))
            longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, fps)]
            arrays = [batch.column(0), longs[0], pa.array(sizes, pa.int32()), _lists(parts, np.uint64, np.int64), _lists(salts, np.int16, np.int16), longs[1], _lists(marks, np.int64, np.int64)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "size", "hashes", "salts", "fp", "sketch"])


def _lists(parts: list[np.ndarray], kind, shown) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(shown)))


def _sets(docs: DataFrame, shingle: int, order: CommonOrder | None = None, keys: bool = False) -> DataFrame:
    """(doc_id, mark, node, size, hashes, ...) of every row; mark tells texts of one id apart, node names the set."""
    rows = text_batches(docs).select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark")).alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(_Sets(shingle, order, keys), SETS).select("doc_id.*", *[c.split()[0] for c in SETS.split(", ")[2:]])


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> CommonOrder:
    """The order: shingles that recur in the sample, rarest first, come after all others."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = _sets(some, shingle).dropDuplicates(["node"]).select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    return CommonOrder(rows.column("h").to_numpy().view(np.uint64)[::-1].copy(), rows.column("count").to_numpy()[::-1].copy())


def _reaches(n: str, i: str, m: str, j: str) -> Column:
    """Whether sets of n and m that share their first key at i and j can be 4/5 similar."""
    return (F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * 9) >= (F.col(n) + F.col(m)) * 4


#: Whether a set has a key so early that it may be the smaller one of a similar pair whose first shared key this is.
EARLY = "(size - at) * 9 >= size * 8"


def _close_sketches(a: str, b: str, n: str, m: str) -> Column:
    """Whether two sketches leave it open that sets of n and m are 4/5 similar: they may differ in a ninth of n + m. Sizes within 4/5 differ by one doubling of the cells at most, and the longer sketch is folded."""
    fold = lambda s, t: F.when(F.size(s) > F.size(t), F.zip_with(F.slice(s, 1, F.size(t)), F.slice(s, F.size(t) + 1, F.size(t)), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))
    differ = F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda s, c: s + c) * 9 <= F.col(n) + F.col(m)


STARS = "key long, salt smallint, node long, size int, at int, lead long, lead_size int, more boolean"


class _Stars:
    """Rows (key, salt, node, size, at), sorted by key, salt and node, to ``STARS``: those of keys with several sets, each with the key's first set as leader, its size, and whether the key has sets that the leader's pairs leave out (three sets or more, or parts). One pass; of a key at most two rows are held back."""

    def __call__(self, batches):
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, salt = (batch.column(k).to_numpy() for k in (0, 1))
            first = np.r_[last is None or (key[0], salt[0]) != last[:2], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            starts = np.flatnonzero(first)
            # What may yet become a key of three sets waits for the next batch.
            cut = starts[-1] if len(starts) and len(key) - starts[-1] < 3 else len(key)
            held = batch.slice(cut) if cut < len(key) else None
            yield from self.led(batch.slice(0, cut), starts[starts < cut], last)
            if held is not None:
                last = None
            elif len(starts):
                last = (key[-1], salt[-1], *(batch.column(k).to_numpy()[starts[-1]] for k in (2, 3)))
        if held is not None:
            yield from self.led(held, np.zeros(1, np.int64), None)

    @staticmethod
    def led(batch: pa.RecordBatch, starts: np.ndarray, last: tuple | None):
        """The rows of keys that begin at ``starts``; those before the first belong to the key of ``last``, of which three rows or more are known."""
        salt, node, size = (batch.column(k).to_numpy() for k in (1, 2, 3))
        begun = len(batch) if not len(starts) else starts[0]
        counts = np.diff(np.r_[starts, len(batch)])
        of = lambda before, each: np.r_[np.full(begun, before, each.dtype), np.repeat(each, counts)]
        count = of(3, counts)
        added = [of(last[2] if last else 0, node[starts]), of(last[3] if last else 0, size[starts]), (count > 2) | (salt > 0)]
        shown = (count > 1) | (salt > 0)
        if shown.any():
            rows = pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[c.split()[0] for c in STARS.split(", ")])
            yield rows.filter(pa.array(shown))


def _verify(shingle_sets: pa.Table) -> pa.Table:
    """One tree and its probe, or several probes' rows of one group: (node, probe, hashes) to (a, b)."""
    nodes, probe = shingle_sets.column("node").to_numpy(), shingle_sets.column("probe").to_numpy(zero_copy_only=False)
    hashes = shingle_sets.column("hashes").combine_chunks()
    flat, ends = hashes.values.to_numpy().view(np.uint64), hashes.offsets.to_numpy()
    of = lambda i: flat[ends[i] : ends[i + 1]]
    held = np.flatnonzero(~probe)
    tree = PrefixTree([of(i) for i in held])
    pairs = [(int(nodes[held[j]]), int(nodes[p])) for p in np.flatnonzero(probe) for j in tree.similar(of(p))]
    a, b = zip(*pairs, strict=True) if pairs else ([], [])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Join:
    """What a run of the join needs again and again; ``temporary`` gets the tables that are to be dropped in the end."""

    def __init__(self, spark: SparkSession, docs: DataFrame, shingle: int, temporary: list[Stored]):
        self.spark, self.docs, self.shingle, self.temporary = spark, docs, shingle, temporary
        self.order = common_shingles(docs, shingle)
        found = Stored(spark, _sets(docs, shingle, self.order, keys=True), "found")
        self.rows = self.kept(found.df.select("doc_id", "mark", "node", "size"), "rows")
        # One row stands for all that have the same set; the keys travel with it.
        sets = found.df.drop("doc_id").dropDuplicates(["node"])
        self.sketches = self.kept(sets.select("node", "mark", "size", "fp", "sketch"), "sketches")
        keyed = sets.select("node", "size", F.posexplode(F.arrays_zip("hashes", "salts")).alias("at", "k")).select(F.col("k.hashes").alias("key"), F.col("k.salts").alias("salt"), "node", "size", "at")
        dealt = keyed.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
        self.met = self.kept(dealt.mapInArrow(_Stars(), STARS), "met")
        found.drop()

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as a table that is dropped with the others; the shuffles that made it go at once."""
        self.temporary.append(Stored(self.spark, df, label))
        release(self.spark)
        return self.temporary[-1].df

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sizes and sketches leave it open that they are similar."""
        pairs = self.kept(pairs, "pairs")
        near = self.sketches_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        known = lambda end, size: near.select(F.col("node").alias(end), F.col("size").alias(size), F.col("sketch").alias(f"of_{end}"))
        sized = pairs.join(known("a", "n"), "a").join(known("b", "m"), "b").where("least(n, m) * 5 >= greatest(n, m) * 4")
        return sized.where(_close_sketches("of_a", "of_b", "n", "m")).select("a", "b")

    def sketches_of(self, nodes: DataFrame) -> DataFrame:
        """(node, size, sketch) of some nodes; a table, as later steps would else deal out all sketches for them."""
        ends = self.kept(nodes.distinct(), "ends")
        return self.kept(self.sketches.select("node", "size", "sketch").join(ends, "node", "left_semi"), "near")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b), a stored table, that are similar: b walks the prefix trees of its a's."""
        trees = F.ceil(F.col("count") / TREE).cast("int")
        cut = pairs.join(pairs.groupBy("b").count(), "b").select("a", "b", F.pmod(F.xxhash64("a"), trees).cast("int").alias("part"))
        members = cut.select("b", "part", F.col("a").alias("node"), F.lit(False).alias("probe")).unionAll(cut.select("b", "part", F.col("b").alias("node"), F.lit(True).alias("probe")).distinct())
        members = Stored(self.spark, members, "members")
        shown = Stored(self.spark, self.sketches.join(members.df.select("node").distinct(), "node", "left_semi").select(F.col("mark").alias("_mark")).distinct(), "shown")
        marks = F.broadcast(shown.df) if shown.df.count() <= MARKS else shown.df
        texts = self.docs.select("doc_id", "text").withColumn("_mark", F.xxhash64("text")).join(marks, "_mark", "left_semi").dropDuplicates(["_mark"])
        whole = Stored(self.spark, _sets(texts, self.shingle, self.order).select("node", "hashes"), "sets")
        release(self.spark)
        similar = members.df.join(whole.df, "node").groupBy("b", "part").applyInArrow(_verify, "a long, b long")
        similar = self.kept(similar, "similar")
        for table in (members, shown, whole):
            table.drop()
        return similar

    def leaders(self) -> DataFrame:
        """Pairs (a, b) of a set and the leader of a key of its, of sizes that may be similar, and of the leaders of a salted key's parts."""
        own = self.met.where("least(size, lead_size) * 5 >= greatest(size, lead_size) * 4").select(F.col("node").alias("a"), F.col("lead").alias("b"))
        parts = self.met.where("salt > 0").select("key", F.col("lead").alias("a")).distinct()
        top = parts.groupBy("key").agg(F.min("a").alias("b"))
        return own.unionAll(parts.join(top, "key").select("a", "b")).where("a <> b").distinct()

    def split(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of keys whose sets are in different components, leaders aside, which have met all, with their component: those of keys of ``MANY`` sets at most, and those of the others with the key's commonest component and the number of sets outside it."""
        rest = self.met.where("more and (salt > 0 or node <> lead)").select("key", "salt", "node", "size", "at")
        named = self.kept(rest.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
        # The smaller set of a similar pair has the key early.
        keys = named.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.expr(EARLY)).alias("early"))
        split = self.kept(named.join(keys.where("low <> high and early").select("key", "sets"), "key"), "split")
        few, wide = split.where(F.col("sets") <= MANY), split.where(F.col("sets") > MANY)
        usual = wide.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"))
        usual = usual.select("key", F.col("most.label").alias("usual"), F.col("most.count").alias("within"))
        return few, self.kept(wide.join(usual, "key").withColumn("apart", F.expr("sets - within")), "wide")

    def other_leaders(self, wide: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) in different components of a set and another leader of a key of its: one out of the key's commonest component, one from outside it."""
        order = F.xxhash64("node", F.pmod("key", F.lit(LEADERS)), F.lit(turn))
        many, pairs = wide.where(F.col("apart") >= MANY).repartition("key", "salt"), []
        for within in (F.col("label") == F.col("usual"), F.col("label") != F.col("usual")):
            dealt = many.sortWithinPartitions("key", "salt", F.desc(within), order).select("key", "salt", "node", "size", "at")
            pairs.append(dealt.mapInArrow(_Stars(), STARS).select(F.col("node").alias("a"), F.col("lead").alias("b")))
        met = pairs[0].unionAll(pairs[1]).where("a <> b").distinct()
        return self.labelled(met, groups).where("of_a <> of_b").select("a", "b")

    def outsiders(self, split: tuple[DataFrame, DataFrame]) -> DataFrame:
        """Pairs (a, b) that meet in a key and are in different components, one of which is not the key's commonest. In keys of many sets sizes and sketches are compared where two sets meet, so that no row is made of what they rule out; the others make few pairs, whose sketches are looked up afterwards."""
        few, wide = split
        wide = self.kept(wide.join(self.sketches_of(wide.select("node")).select("node", "sketch"), "node"), "sketched")
        apart, sized = F.col("label") != F.col("usual"), F.expr("of_a <> of_b and least(n, m) * 5 >= greatest(n, m) * 4") & _reaches("n", "i", "m", "j")

        def pairs(left: DataFrame, right: DataFrame, may: Column, *more: str) -> DataFrame:
            x = left.select("key", F.col("node").alias("a"), F.col("size").alias("n"), F.col("at").alias("i"), F.col("label").alias("of_a"), *[F.col(c).alias("s") for c in more])
            y = right.select("key", F.col("node").alias("b"), F.col("size").alias("m"), F.col("at").alias("j"), F.col("label").alias("of_b"), *[F.col(c).alias("t") for c in more])
            return x.withColumnRenamed("key", "k").join(y, (F.col("k") == F.col("key")) & may).select("a", "b")

        # Nested, as sketches are only comparable where the sizes are.
        close = F.when(sized, _close_sketches("s", "t", "n", "m")).otherwise(False)
        # The smaller set of a pair has the key early, so the one or the other is among the early rows.
        met = pairs(wide.where(apart & F.expr(EARLY)), wide, close, "sketch").unionAll(pairs(wide.where(apart), wide.where(EARLY), close, "sketch"))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return met.unionAll(self.sketched(pairs(few, few, F.expr("a < b") & sized).distinct())).distinct()

    def groups(self, proposed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(node, label) of every node that is linked to another; ``proposed`` makes more pairs (a, b) for the first round from (node, fp)."""
        pairs = self.leaders()
        if proposed is not None:
            pairs = pairs.unionAll(proposed(self.sketches.select("node", "fp"))).distinct()
        first = self.kept(self.sketched(pairs), "first")
        ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried, found = ordered(first), self.linked(self.verified(first))
        split = self.split(found)
        for turn in range(ROUNDS):
            if split[1].where(F.col("apart") >= MANY).isEmpty():
                break
            again = self.kept(self.sketched(self.other_leaders(split[1], found, turn)), "again")
            more = self.verified(again)
            tried = tried.unionAll(ordered(again))
            if more.isEmpty():
                break
            found = self.linked(more, found)
            split = self.split(found)
        last = self.kept(self.outsiders(split).join(tried, ["a", "b"], "left_anti"), "last")
        if last.isEmpty():
            return found
        more = self.verified(last)
        return found if more.isEmpty() else self.linked(more, found)

    def linked(self, links: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """(node, label) of the nodes of the links, and of ``groups``, which the links join: then only pairs of components go through the rounds, however many links there are between two."""
        if groups is not None:
            named = self.labelled(links, groups)
            met = named.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_a").alias("label")), F.struct(F.col("b").alias("node"), F.col("of_b").alias("label")))).alias("x")).select("x.*")
            nodes = self.kept(groups.unionAll(met).distinct(), "nodes")
            links = self.kept(named.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "merges")
        found = components(self.spark, links)
        self.temporary.append(found)
        if groups is None:
            return found.df
        roots = found.df.select(F.col("node").alias("label"), F.col("label").alias("root"))
        return self.kept(nodes.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "groups")

    @staticmethod
    def labelled(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with of_a and of_b, the components of their ends."""
        for end in ("a", "b"):
            pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        return pairs


def _ball_pairs(join: _Join, sets: DataFrame) -> DataFrame:
    """Pairs of sets that ball hashing of their fingerprints proposes; equal fingerprints go through their smallest set."""
    near = join.kept(sets.groupBy("fp").agg(F.min("node").alias("own")), "fps")
    links = near_links(join.spark, near.select("fp"))
    far = near.select(F.col("fp").alias("b"), F.col("own").alias("to"))
    across = links.join(near, F.col("a") == F.col("fp")).join(far, "b").select(F.col("own").alias("a"), F.col("to").alias("b"))
    same = sets.join(near, "fp").where("node <> own").select(F.col("node").alias("a"), F.col("own").alias("b"))
    return join.kept(across.unionAll(same), "balls")


def _owners(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, owner): the smallest doc_id that a node's links reach, its own included."""
    own = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = own.join(groups, "node")
    best = linked.groupBy("label").agg(F.min("least").alias("best"))
    return own.join(linked.select("node", "label").join(best, "label").select("node", "best"), "node", "left").select("node", F.coalesce("best", "least").alias("owner"))


def jaccard_groups(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id that links reach, its own included.

    The set of a text are its distinct shingles of so many words, A-Z
    lower-cased; with fewer words the whole sequence is one. A text that is
    null, empty or without words has an empty set, is linked with nothing and
    is its own component. Equal sets are always linked. Repeated rows are
    repeated in the result; null ids take part in links but name a component
    only where all of it is null. Texts are taken whole, however long. Other
    columns, whatever their names, are ignored; an empty table gives an empty
    result. The result is a table in the shared folder; all others are dropped.
    """
    temporary: list[Stored] = []
    join = _Join(spark, docs, shingle, temporary)
    owner = _owners(join.rows.where("size > 0"), join.groups())
    result = join.rows.join(owner, "node", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("owner")).otherwise(F.col("doc_id")).alias("component_id"))
    result = Stored(spark, result, "components").df
    for table in temporary:
        table.drop()
    return result


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose group of near copies has a smaller doc_id; all columns stay, whatever their names.

    A group is all that links reach. Texts without words are one group. Rows
    without an id link others but are never dropped. A row is dropped by id
    and text, so another text of the same id stays. An empty table stays
    empty. Pairs come from ball hashing of SimHash fingerprints and from the
    set join, and all are verified on the full sets. One narrow table, of the
    rows that go, stays in the shared folder.
    """
    temporary: list[Stored] = []
    join = _Join(spark, docs, shingle, temporary)
    owner = _owners(join.rows, join.groups(lambda sets: _ball_pairs(join, sets)))
    name, mark = unused(docs, "gone"), unused(docs, "mark")
    gone = join.rows.join(owner, "node").where("owner < doc_id").select(F.col("doc_id").alias(name), F.col("mark").alias(mark)).distinct()
    gone = Stored(spark, gone, "gone").df
    for table in temporary:
        table.drop()
    return docs.join(gone, (docs.doc_id == gone[name]) & (F.xxhash64(docs.text) == gone[mark]), "left_anti")
