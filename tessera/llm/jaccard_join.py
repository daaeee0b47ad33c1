"""N-gram Jaccard join: a size-aware heavy-light join (operator 7).

Texts become sets of distinct five-word shingles; two are linked when
100 * intersection >= 75 * union.  Equal sets are one class from the start, named
by a fingerprint, so exact copies are never compared.

Small sets are *light*: they name their subsets of fixed sizes, the overlaps
that a linked partner must share, and meet where a subset is equal.  Large sets
are *heavy*: they are entered in inverted lists under the shingles of a prefix,
which every linked partner must share too, and the lists are scanned.  The
boundary between them is where enumerating gets dearer than scanning.  Prefixes
take rare shingles first: shingles that many texts share are counted over the
whole corpus and come last in the order, so boilerplate makes no long lists.
The order is the same for all sets, which is all that completeness needs.

Within a list all members are first compared with one of them, the list's
leader, instead of pairwise; what links is merged into components.  The leader is
the member in which the list's shingle comes first in the order: of a text and
its variants that is the text itself, as a variant's own rare shingles push the
shared ones back.  Only lists that still hold several components are looked at
again: with the leader of the whole list and the first member outside that
leader's component, and once more while the pairs left would cost more than another
turn, and at last with every pair across components whose places in the order allow
a link, so no link between components is lost, while a group of thousands of near
copies costs a few comparisons each.  Between the turns components are only nearly
known (a few steps towards them), which may cost comparisons but no link.
Pairs are first held against bit sketches: the parities of a set's hashes in a
power of two of buckets.  Each shingle that only one of two sets has flips one
bit, so the number of unlike bits is a lower bound of their difference, and a
pair beyond the difference that a link allows is dropped without its sets.
Pairs that pass are compared exactly.

Lists and candidate pairs carry a set's short name of 64 bits; classes are told
apart by 128 bits and numbered, and links and components use the numbers, so two
sets that share a short name stay apart.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.components import components, contract
from tessera.llm.shingles import FOLD, mix, shingles, signed
from tessera.llm.storage import Stored, materialise

HOT_KEPT = 1 << 18  # shared shingles whose counts order the prefixes
HOT_LEAST = 8
HOT_WINDOW = 1 << 21  # shingles counted together in a task
HOT_ROWS = 1 << 17  # counts sent on from each of these windows
LIGHT_MOST = 12
SCAN_COST = 4  # a scanned entry costs so many enumerated ones
FILTER_BITS = 1 << 23
LEADER_ROUNDS = 3
KEYS_AT_ONCE = 2048  # texts, and entries of lists, of a batch
LEFT_COST = 4  # pairs left over, for each entry of the lists, that are cheaper than another turn
SPLIT_LEAST = 2048  # lists of shingles that so many sets share are dealt over parts
PARTS = 64
SEEN = 1 << 18  # names of sets that a task remembers, to pass copies by
SETS_AT_ONCE, SKETCHES_AT_ONCE, TEXTS_AT_ONCE = 128, 1024, 1024  # rows with sets, sketches or texts of a batch


def overlap(a: int, b: int) -> int:
    """Shingles that sets of ``a`` and ``b`` share at least if they are linked."""
    return -(-3 * (a + b) // 7)


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def partner_sizes(n: int) -> range:
    """Sizes that a set linked with one of ``n`` can have."""
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a set of ``n`` names to meet partners when the smaller one is light."""
    return sorted({overlap(n, b) for b in partner_sizes(n) if min(n, b) <= boundary})


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def light_boundary(sizes: dict[int, int]) -> int:
    """The largest size up to which naming subsets is cheaper than scanning lists; ``sizes``: sets by size."""
    from math import comb

    best, enum, scan = 0, 0, 0
    for n in range(1, LIGHT_MOST + 1):
        enum += sizes.get(n, 0) * sum(comb(n, c) for c in subset_sizes(n, n))
        scan += sizes.get(n, 0) * prefix_size(n) * SCAN_COST
        if enum <= scan:
            best = n
    return best


def _set(found: np.ndarray) -> np.ndarray:
    """Distinct shingles in order."""
    return np.unique(found)


def _print(found: np.ndarray) -> int:
    """A set's short name."""
    with np.errstate(over="ignore"):
        total = np.array([np.sum(mix(found)), np.uint64(len(found))], np.uint64)
        return int(mix(total[:1] * FOLD + total[1:])[0])


def _name(found: np.ndarray) -> bytes:
    """A set's full name: the short one and 64 bits of another sum."""
    with np.errstate(over="ignore"):
        other = np.sum(mix(found ^ FOLD) * mix(found + FOLD))
    return _print(found).to_bytes(8, "little") + int(other).to_bytes(8, "little")


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch(found: np.ndarray) -> bytes:
    """Parities of a set's hashes in at least twice as many buckets."""
    size = 1 << min(17, max(8, (2 * len(found)).bit_length()))
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def unlike(x: bytes, y: bytes) -> int:
    """Unlike bits of two sketches, the larger one folded to the size of the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _scan(docs: DataFrame, id_col: str, text_col: str) -> Stored:
    """One pass over the texts: a row of kind 0 for each (k: id, fp, n: set size, sketch, name), and
    rows of kind 1 for shingles that recur (k: shingle, n: sets that hold it)."""
    columns = ["kind", "k", "fp", "n", "sketch", "name"]

    def run(batches):
        held, count = [], 0

        def recurring():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = np.flatnonzero(n > 1)
            if len(some) > HOT_ROWS:
                some = some[np.argpartition(-n[some], HOT_ROWS)[:HOT_ROWS]]
            m = len(some)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), signed(h[some]), pa.array(np.zeros(m, np.int64)), pa.array(n[some].astype(np.int64)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], columns)

        for part in slices(batches, "text"):
            fps, sizes, bits, names = [], [], [], []
            for found in shingles(part.column("text")):
                s = _set(found)
                names.append(_name(s))
                fps.append(_long(_print(s)))
                sizes.append(len(s))
                bits.append(sketch(s))
                held.append(s)
                count += len(s)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), part.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(names, pa.binary())], columns)
            if count >= HOT_WINDOW:
                yield recurring()
                held, count = [], 0
        if count:
            yield recurring()

    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(only.mapInArrow(run, "kind byte, k long, fp long, n long, sketch binary, name binary"), "sets", batch_rows=TEXTS_AT_ONCE)


def _hot(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most shared shingles and their counts; a bounded number whatever the corpus."""
    rows = scan.where("kind = 1").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "k").limit(HOT_KEPT).toPandas()
    h = rows["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def _keys(docs: DataFrame, boundary: int, hot, id_col: str, text_col: str) -> DataFrame:
    """``key, part, fp, n, pos``: what each set is entered under; part -1 is a whole list.

    ``pos`` is the shingle's place in the order of all sets, 0 for subsets.
    """
    share = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot_h, hot_n = share.value
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for part in slices(batches, "text"):
                keys, parts, fps, sizes, places = [], [], [], [], []
                for found in shingles(part.column("text")):
                    s = _set(found)
                    n = len(s)
                    if not n:
                        continue
                    fp = _long(_print(s))
                    if fp in seen:  # another copy; the lists need one
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(fp)
                    own, dealt, at_place = [], [], []
                    if n > boundary:
                        count = np.zeros(n, np.int64)
                        if len(hot_h):
                            at = np.minimum(np.searchsorted(hot_h, s), len(hot_h) - 1)
                            count = np.where(hot_h[at] == s, hot_n[at], 0)
                        rare = np.lexsort((s, count))[: prefix_size(n)]
                        own.append(s[rare])
                        at_place.append(np.arange(len(rare), dtype=np.int32))
                        dealt.append(np.where(count[rare] >= SPLIT_LEAST, fp % PARTS, -1).astype(np.int32))
                    for c in subset_sizes(n, boundary):
                        named = np.array(list(combinations(s.tolist(), c)), np.uint64).reshape(-1, c)
                        total = np.full(len(named), c, np.uint64)
                        for column in named.T:
                            total = total * FOLD + column
                        own.append(mix(total))
                        dealt.append(np.full(len(named), -1, np.int32))
                        at_place.append(np.zeros(len(named), np.int32))
                    if own:
                        all_keys = np.concatenate(own)
                        keys.append(all_keys)
                        parts += dealt
                        places += at_place
                        fps.append(np.full(len(all_keys), fp, np.int64))
                        sizes.append(np.full(len(all_keys), n, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(parts)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["key", "part", "fp", "n", "pos"])

    only = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return only.mapInArrow(run, "key long, part int, fp long, n int, pos int")


def _lists(keys: DataFrame) -> DataFrame:
    """Entries of the lists that have two classes or more, each beside its list's leader, the
    class in which the key has the first place: ``key, fp, n, pos, lead, lead_n, lead_pos``.

    Parts of a dealt list have a leader each, and name it also beside itself.
    """
    names = ["key", "part", "fp", "n", "pos"]

    def run(batches):
        last = None  # the last row and its leader
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in names]
            if last is not None:
                rows = [np.append(x, y) for x, y in zip(last, rows)]
            key, part, fp, *_ = rows
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            fresh = head.copy()
            fresh[1:] |= fp[1:] != fp[:-1]
            key, part, fp, n, pos = (x[fresh] for x in rows)
            head = head[fresh]
            first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            lead, lead_n, lead_pos = fp[first], n[first], pos[first]
            if last is not None:  # rows of the list that was open
                open_ = first == 0
                lead, lead_n, lead_pos = (np.where(open_, x, y) for x, y in zip(last[5:], (lead, lead_n, lead_pos)))
            out = (fp != lead) | (part >= 0)
            out[0] &= last is None  # it went out before
            last = [x[-1:] for x in (key, part, fp, n, pos)] + [lead[-1], lead_n[-1], lead_pos[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, fp, n, pos, lead, lead_n, lead_pos)], ["key", "fp", "n", "pos", "lead", "lead_n", "lead_pos"])

    return keys.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "pos", "fp").mapInArrow(run, "key long, fp long, n int, pos int, lead long, lead_n int, lead_pos int")


def _possible():
    """Whether sizes and places allow a link between a member and its leader.

    The first shared shingle of a linked pair is followed, in the order of all
    sets, by enough others in both of them; another shared one needn't be, but then
    the pair is met under the first.
    """
    n, m = F.col("n"), F.col("lead_n")
    need = 3 * (n + m)
    return (n * 4 >= m * 3) & (m * 4 >= n * 3) & (7 * (n - F.col("pos")) >= need) & (7 * (m - F.col("lead_pos")) >= need)


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> Stored:
    """``class, items``: the sets of the classes in ``wanted`` (class, name, fp), once each, as packed sorted hashes.

    Texts are read again; a bit filter of fixed size tells which ones may be
    wanted, and an exact join on the full name removes its false hits.
    """
    words = wanted.select(F.pmod(F.col("fp"), F.lit(FILTER_BITS)).alias("bit")).groupBy(F.expr("bit div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    rows = words.toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    share = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches):
        may, seen = share.value, set()
        for part in slices(batches, "text"):
            names, items = [], []
            for found in shingles(part.column("text")):
                s = _set(found)
                bit = _print(s) % FILTER_BITS
                if len(s) and may[bit >> 3] >> (bit & 7) & 1:
                    name = _name(s)
                    if name in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    items.append(s.tobytes())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(items, pa.binary())], ["name", "items"])

    only = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = only.mapInArrow(run, "name binary, items binary")
    return materialise(found.join(wanted.select("class", "name"), "name").select("class", "items").dropDuplicates(["class"]), "set-items", batch_rows=TEXTS_AT_ONCE)


def _verified(pairs: DataFrame, sets: DataFrame) -> Stored:
    """The linked ones among ``pairs`` (a, b: classes), by exact comparison of their sets."""

    def run(batches):
        for part in batches:
            ok = []
            for x, y in zip(part.column("x"), part.column("y")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                ok.append(linked(int(np.count_nonzero(t[at] == s)), len(s), len(t)))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    return materialise(both, "links", batch_rows=SETS_AT_ONCE)


def _plausible(pairs: DataFrame, classes: DataFrame) -> Stored:
    """The ``pairs`` (a, b: short names) whose sketches allow a link, as ``a, b`` (classes)."""

    def run(batches):
        for batch in batches:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("n").to_pylist())
            keep = pa.array([7 * unlike(x, y) <= n for x, y, n in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    x = classes.select(F.col("fp").alias("fp_a"), F.col("class").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    y = classes.select(F.col("fp").alias("fp_b"), F.col("class").alias("b"), F.col("n").alias("n"), F.col("sketch").alias("y"))
    short = pairs.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    both = short.join(x, "fp_a").join(y, "fp_b").where("a <> b").select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("n"))
    return materialise(both.mapInArrow(run, "a long, b long"), "likely", batch_rows=SKETCHES_AT_ONCE)


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _union(parts: list[Stored]) -> DataFrame:
    out = parts[0].df
    for more in parts[1:]:
        out = out.unionAll(more.df)
    return out


class _Linker:
    """Compares pairs of classes, each once, and merges what is linked."""

    def __init__(self, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str):
        self.docs, self.classes, self.id_col, self.text_col = docs, classes, id_col, text_col
        self.tried: list[Stored] = []
        self.sets: list[Stored] = []
        self.edges: Stored | None = None  # with the components of all links

    def compare(self, pairs: DataFrame, steps: int = 0) -> bool:
        """Compare ``pairs`` (a, b: short names) that have not been compared; whether any are linked.

        ``steps``: star steps over all links that follow.
        """
        pairs = pairs.distinct()
        if self.tried:
            pairs = pairs.join(_union(self.tried), ["a", "b"], "left_anti")
        self.tried.append(materialise(pairs, "pairs"))
        likely = _plausible(self.tried[-1].df, self.classes)
        if likely.df.isEmpty():
            likely.drop()
            return False
        ends = likely.df.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        for old in self.sets:
            ends = ends.join(old.df.select("class"), "class", "left_anti")
        asked = materialise(self.classes.select("class", "name", "fp").join(ends, "class", "left_semi"), "wanted")
        if not asked.df.isEmpty():
            self.sets.append(_sets_of(self.docs, asked.df, self.id_col, self.text_col))
        asked.drop()
        links = _verified(likely.df, _union(self.sets))
        likely.drop()
        some = not links.df.isEmpty()
        if some:
            before = self.edges
            self.edges = contract(links.df if before is None else links.df.unionAll(before.df), steps)
            if before is not None:
                before.drop()
        links.drop()
        return some

    def nearly(self) -> DataFrame:
        """``fp, root`` of every class: the least class that its edges lead to, which may be short of its component's."""
        if self.edges is None:
            return self.classes.select("fp", F.col("class").alias("root"))
        least = self.edges.df.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("root"))
        return self.classes.select("class", "fp").join(least, "class", "left").select("fp", F.coalesce("root", "class").alias("root"))

    def components(self) -> Stored:
        """``node, root`` of the classes that have links."""
        return components(self.edges.df if self.edges is not None else self.classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0))

    def drop(self) -> None:
        for x in (*self.tried, *self.sets, *([self.edges] if self.edges is not None else [])):
            x.drop()


def _leaders(mixed: DataFrame) -> DataFrame:
    """``key, lead, lead_n, lead_pos, lead_root``: of each list the first member, and the first one outside its component."""
    first = mixed.groupBy("key").agg(F.min(F.struct("pos", "fp", "n", "root")).alias("l"))
    outside = mixed.join(first.select("key", F.col("l.root").alias("not")), "key").where("root <> not")
    both = first.unionAll(outside.groupBy("key").agg(F.min(F.struct("pos", "fp", "n", "root")).alias("l")))
    return both.select("key", F.col("l.fp").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.pos").alias("lead_pos"), F.col("l.root").alias("lead_root"))


def _left_over(mixed: DataFrame) -> float:
    """About how many pairs across components are left for each entry of the lists, sets being of about one size:
    then both places have to be in the first seventh."""
    by_list = mixed.where(7 * F.col("pos") <= F.col("n")).groupBy("key", "root").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    row = by_list.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2).alias("pairs"), F.sum("m").alias("entries")).first()
    return row.pairs / row.entries if row.entries else 0.0


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies`` of every row.

    ``n_copies`` counts the rows with an equal set, this one included.  Texts
    without words, and nulls, have no set: 0 shingles, linked with nothing, not
    even each other, and a component of their own.  A null id is passed on and
    never names a component, unless all ids of it are null.  Repeated rows are
    rows of their own in one class; other columns are left out.  Texts of any
    length are read in pieces; an empty table gives an empty result.
    """
    scan = _scan(docs, id_col, text_col)
    rows = scan.df.where("kind = 0").select(F.col("k").alias("doc_id"), "fp", "n", "name")
    # one row for each class; the sketch of equal sets is the same
    grouped = scan.df.where("kind = 0 AND n > 0").groupBy("name").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("k").alias("least"), F.count("*").alias("copies"))
    classes = materialise(grouped.withColumn("class", F.monotonically_increasing_id()), "classes").df
    sizes = {r.n: r.c for r in classes.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("c")).collect()}
    lists = materialise(_lists(_keys(docs, light_boundary(sizes), _hot(scan.df), id_col, text_col)), "lists", batch_rows=KEYS_AT_ONCE)
    linker = _Linker(docs, classes.select("class", "name", "fp", "n", "sketch"), id_col, text_col)

    def mixed_lists(before: Stored | None) -> Stored:
        """Entries, with their components, of the lists that hold several; lists only get fewer."""
        if before is None:
            led = lists.df.select("key", F.col("lead").alias("fp"), F.col("lead_n").alias("n"), F.col("lead_pos").alias("pos"))
            entries = lists.df.select("key", "fp", "n", "pos").unionAll(led).distinct()
        else:
            entries = before.df.select("key", "fp", "n", "pos")
        marked = entries.join(linker.nearly(), "fp")
        several = marked.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
        out = materialise(marked.join(several, "key", "left_semi"), "mixed")
        if before is not None:
            before.drop()
        return out

    across = lambda pairs: pairs.where((F.col("root") != F.col("lead_root")) & _possible()).select(*_pair("fp", "lead"))
    linker.compare(lists.df.where((F.col("fp") != F.col("lead")) & _possible()).select(*_pair("fp", "lead")), steps=2)
    mixed = mixed_lists(None)
    lists.drop()
    for _ in range(LEADER_ROUNDS):
        if not linker.compare(across(mixed.df.join(_leaders(mixed.df), "key")), steps=1):
            break
        mixed = mixed_lists(mixed)
        if _left_over(mixed.df) <= LEFT_COST:
            break
    other = mixed.df.select("key", F.col("fp").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos"), F.col("root").alias("lead_root"))
    linker.compare(across(mixed.df.join(other, "key").where(F.col("fp") < F.col("lead"))))
    mixed.drop()
    roots = linker.components()
    linker.drop()

    named = classes.join(roots.df.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("name", "component_id", "copies")
    return rows.join(by_class, "name", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(F.lit(1).cast("long")).alias("n_copies"),
    )
