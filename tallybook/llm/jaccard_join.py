"""Join of documents by the Jaccard similarity of their word n-grams, by pigeonhole.

A document's set has the 64-bit hashes of its distinct n-grams. Sets that are
equal are one class. Classes are grouped by bands of set sizes; a set near the
lower bound of a band is in the band's group too. Two linked sets of a group
differ by at most H elements, which follows from the largest sizes of the band.
The universe is parted by hash into m segments. Every set is indexed by its
elements in each segment, and in d segments also by what is left after deleting
one element. Of its other segments that are empty, which many sets share, a set
leaves out the first e; a pair loses 2 e agreements by that at most. So if
``m - 2 e + d > H``, two linked sets agree in an indexed segment, or differ by
one element in one of the d. Each band takes the ``(m, d, e)`` of least cost:
index entries, plus the coincidences of near-empty segments that its share of
the corpus makes likely.

Classes that share an entry are candidates, unless their sizes or a sketch of
element parities, which bounds the difference of two sets from below, rule the
pair out; a sketch of more words is folded to be compared with one of fewer.
Classes in an entry of many are parted once more by an independent pigeonhole.
In entries that are large there too, classes are compared by their sketches with
one of them, and only what isn't connected by that in blocks. What candidates connect is a cluster; its whole sets are compared
exactly, in blocks bounded by sets and by bytes, from which only a spanning
forest of the links leaves. Nothing is capped, and no linked pair is lost.

Entries are dealt once. One that very many classes have, found in a sample of
the classes, is known to be shared and isn't gathered to see that.

Null and empty texts have no n-gram and are linked with nothing; a text of fewer
words is one n-gram. Repeated rows are equal sets, so one class, and one
component; null ids take part, but name no component unless all ids of it are
null. An empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.components import components
from tallybook.llm.memory import tidy
from tallybook.llm.storage import stored
from tallybook.llm.tokens import SPACED_WORDS, filled, word_codes

INDEXED = "doc_id bigint, n bigint, set_id bigint, sketch array<bigint>, entries array<bigint>"
# Words of 64 bits in the sketch of sets below a size; the last is for all larger ones.
SKETCHES = [(700, 8), (5000, 32), (1 << 62, 128)]
# Bits of an entry, which is most of what is stored and shuffled; entries that are equal by chance only cost a comparison.
ENTRY_BITS = 48
SEED, SECOND_SEED = 0x51ED270B, 0x2545F491


@dataclass(frozen=True)
class Settings:
    """``few``: most classes of an entry that one task compares by their sketches; ``block``, ``block_bytes``:
    about so many sets, and bytes of them, on one side of a block; ``band``: ratio of the bounds of a band;
    ``slots``: bits of the filter that spares the second scan from texts without candidates; ``sampled``: one
    class of so many is looked at for ``hot`` entries, those of at least so many of these."""

    words: int = 4
    percent: int = 85
    few: int = 256
    block: int = 1024
    block_bytes: int = 64 << 20
    band: float = 1.25
    coincidence: float = 2.0
    slots: int = 1 << 23
    sampled: int = 64
    hot: int = 1024


@dataclass(frozen=True)
class Group:
    number: int
    low: int  # smallest size of the band
    least: int  # smallest size that takes part
    high: int  # largest size
    segments: int
    deletions: int
    skipped: int  # empty segments, besides those with deletions, that a set leaves out


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def allocation(least: int, high: int, population: float, settings: Settings) -> tuple[int, int, int]:
    """``(m, d, e)`` of least cost for sets of these sizes, with ``m - 2 e + d > H``."""
    need = most_apart(high, high, settings.percent) + 1
    size = (least * high) ** 0.5
    best = None
    for e in range(0, 13):
        for d in range(0, min(need // 2 + e, 40) + 1):
            m = need + 2 * e - d
            if d > m:
                break
            mean = size / m
            empty, single = exp(-mean), mean * exp(-mean)
            # Expected empty segments beyond those left out, of a Poisson law.
            expected = term = (m - d) * empty
            left, chance = expected - e, exp(-term)
            for k in range(e):
                left += (e - k) * chance
                chance *= term / (k + 1)
            met = population * (max(left, 0.0) ** 2 / max(1, m - d) + d * (empty + single) ** 2)
            cost = m + d * mean + settings.coincidence * met
            if best is None or cost < best[0]:
                best = (cost, m, d, e)
    return best[1:]


def groups(rows: int, settings: Settings, largest: int = 1 << 40) -> list[Group]:
    """Bands from the smallest size that has a link to another set."""
    low = 1
    while most_apart(low, low + 1, settings.percent) < 1:
        low += 1
    out: list[Group] = []
    share = rows / 20  # texts of one order of size spread over about twenty bands
    while low <= largest:
        high = max(low, int(low * settings.band) - 1)
        least = -(-settings.percent * low // 100)
        out.append(Group(len(out), low, least, high, *allocation(least, high, share, settings)))
        low = high + 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: pa.StringArray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    import xxhash

    codes, per_text, names = word_codes(texts, SPACED_WORDS)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names.to_pylist()], np.uint64)
    own = hashes[codes] if len(codes) else np.empty(0, np.uint64)
    whole = own.copy()
    step = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, words):
        whole[: len(own) - k] = _mix(whole[: len(own) - k] * step + own[k:])
    ends = np.cumsum(per_text)
    for end, n in zip(ends.tolist(), per_text.tolist()):
        if n >= words:
            yield np.unique(whole[end - n : end - words + 1])
        elif n:
            short = own[end - n : end]
            value = short[:1] + np.uint64(n)
            for k in range(1, n):
                value = _mix(value * step + short[k : k + 1])
            yield value
        else:
            yield np.empty(0, np.uint64)


def entries(mixed: np.ndarray, hashed: np.ndarray, group: Group, seed: int) -> np.ndarray:
    """Index entries in a group of one set, whose elements have these two hashes."""
    m = group.segments
    # 16 bits, where they do, are sorted by their digits.
    segment = ((mixed >> np.uint64(33)) % np.uint64(m)).astype(np.uint16 if m < 1 << 16 else np.int64)
    order = np.argsort(segment, kind="stable")
    value = hashed[order]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(segment, minlength=m))))
    content = sums[bounds[1:]] - sums[bounds[:-1]]
    salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64(((group.number + 1) << 32) ^ seed))
    own = _mix(content ^ salt)
    if group.skipped:
        empty = np.flatnonzero(bounds[group.deletions + 1 :] == bounds[group.deletions : -1])
        own = np.delete(own, group.deletions + empty[: group.skipped])
    found = [own]
    if group.deletions:
        inside = segment[order[: bounds[group.deletions]]]
        found.append(_mix((content[inside] - value[: len(inside)]) ^ salt[inside]))
    return (np.concatenate(found) >> np.uint64(64 - ENTRY_BITS)).view(np.int64)


def all_entries(elements: np.ndarray, plan: list[Group], seed: int) -> np.ndarray:
    n = len(elements)
    mixed = _mix(elements ^ np.uint64(seed))
    hashed = _mix(mixed + np.uint64(0x632BE59BD9B4E019))
    own = [entries(mixed, hashed, g, seed) for g in plan if g.least <= n <= g.high]
    return np.concatenate(own) if own else np.empty(0, np.int64)


def sketch(elements: np.ndarray, longer: int = 1) -> np.ndarray:
    """Parities of the elements in each of the sketch's bits; ``longer`` times the usual number."""
    bits = 64 * longer * next(words for below, words in SKETCHES if len(elements) < below)
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


@dataclass(frozen=True)
class Sketches:
    """Sketches of many sets, one after the other. A shorter one is the longer's parities folded, so any two can be compared."""

    values: np.ndarray
    first: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(lists: pa.ListArray) -> Sketches:
        words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        return Sketches(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(words) - words, words)

    @staticmethod
    def made(sketches: list[np.ndarray]) -> Sketches:
        words = np.array([len(x) for x in sketches], np.int64)
        return Sketches(np.concatenate(sketches).view(np.uint64), np.cumsum(words) - words, words)

    def followed_by(self, other: Sketches) -> Sketches:
        first = np.concatenate((self.first, other.first + len(self.values)))
        return Sketches(np.concatenate((self.values, other.values)), first, np.concatenate((self.words, other.words)))

    def part(self, start: int, end: int) -> Sketches:
        return Sketches(self.values, self.first[start:end], self.words[start:end])

    def folded(self, some: np.ndarray, words: int) -> np.ndarray:
        """A row of so many words for each of some sketches that have as many or more."""
        out = np.empty((len(some), words), np.uint64)
        for own in np.unique(self.words[some]):
            at = np.flatnonzero(self.words[some] == own)
            rows = self.values[self.first[some[at]][:, None] + np.arange(own)]
            out[at] = np.bitwise_xor.reduce(rows.reshape(len(at), -1, words), axis=1)
        return out

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Unlike parities of the pairs ``x[k], y[k]``."""
        out = np.empty(len(x), np.int64)
        least = np.minimum(self.words[x], self.words[y])
        for words in np.unique(least):
            every = np.flatnonzero(least == words)
            for k in range(0, len(every), 1 << 14):
                at = every[k : k + (1 << 14)]
                unlike = self.folded(x[at], words) ^ self.folded(y[at], words)
                out[at] = np.bitwise_count(unlike).sum(axis=1, dtype=np.int64)
        return out


def set_id(elements: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).astype(np.int64))


def indexed(docs: DataFrame, plan: list[Group], settings: Settings) -> DataFrame:
    """One row per document; entries and sketch go with the first of a set in each task."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            sizes, ids, sketches, lists = [], [], [], []
            for elements in ngram_sets(filled(batch["text"]), settings.words):
                sizes.append(len(elements))
                name = set_id(elements) if len(elements) else None
                ids.append(name)
                if name is None or name in met:
                    sketches.append(None)
                    lists.append(None)
                else:
                    met.add(name)
                    sketches.append(sketch(elements))
                    lists.append(all_entries(elements, plan, SEED))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, longs), pa.array(lists, longs)],
                names=["doc_id", "n", "set_id", "sketch", "entries"],
            )

    return docs.mapInArrow(tidy(index), INDEXED)


def shared_entries(lists: DataFrame, settings: Settings) -> DataFrame:
    """``entry set_id`` (distinct) of the entries that more than one class has; ``lists``: ``set_id entries``.

    A window, so that the entries, which are most of what this join shuffles,
    are dealt once. Those of a great many classes don't go there: a sample by
    hash of the classes shows them, and that they are shared. Of ``n`` entries
    at most ``n / (sampled * hot)`` can be such, and ``n / 100,000`` in a large
    corpus, which bounds what is broadcast.
    """
    own = lists.filter(F.col("entries").isNotNull()).select("set_id", "entries")
    rows = own.select(F.explode("entries").alias("entry"), "set_id")
    some = own.filter(F.pmod(F.xxhash64("set_id"), F.lit(settings.sampled)) == 0).distinct()
    seen = some.select(F.explode("entries").alias("entry"), "set_id").distinct().groupBy("entry").count()
    total = own.agg(F.coalesce(F.sum(F.size("entries").cast("long")), F.lit(0))).first()[0]
    least = max(settings.hot, 2, total // (settings.sampled * 100_000))
    hot = stored(seen.filter(F.col("count") >= least).select("entry"), "hot-entries")
    by_entry = Window.partitionBy("entry")
    spread = rows.join(F.broadcast(hot), "entry", "left_anti").withColumns(
        {"_x": F.min("set_id").over(by_entry), "_y": F.max("set_id").over(by_entry)}
    )
    cold = spread.filter("_x <> _y").select("entry", "set_id").distinct()
    return cold.union(rows.join(F.broadcast(hot), "entry", "left_semi").distinct())


def by_size(shared: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows of entries of at most ``few`` classes, and the others.

    The others' entries are stored: they are few as a rule, so that rows needn't be dealt to be told apart.
    """
    counts = shared.groupBy("entry").count()
    large = stored(counts.filter(F.col("count") > settings.few).select("entry"), "large-entries")
    return shared.join(large, "entry", "left_anti"), shared.join(large, "entry", "left_semi")


def near_pairs(small: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Forests ``a b`` of the pairs within entries that sizes and sketches don't rule out.

    ``small`` has the rows of entries of at most ``few`` classes. Linked sets
    meet in most of their entries, so equal lists of classes are tried once.
    Most lists are near their first class as a whole, which a batch shows at once.
    """
    lists = small.groupBy("entry").agg(F.array_sort(F.collect_set("set_id")).alias("m")).select("m").distinct()
    met = lists.select(F.xxhash64("m").alias("list"), F.explode("m").alias("set_id"))
    described = met.join(classes, "set_id").groupBy("list").agg(
        F.collect_set(F.struct("set_id", "n", "sketch")).alias("m")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                a, b = _near_forests(batch["m"].slice(k, 512), settings.percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return described.select("m").mapInArrow(tidy(compare), "a bigint, b bigint").distinct()


def near_first(large: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs ``a b`` of the first class of each entry (``entry set_id first``) and those near it."""
    names = {"set_id": "first", "n": "first_n", "sketch": "first_sketch"}
    described = large.join(classes.withColumnsRenamed(names), "first").join(classes, "set_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            both = Sketches.of(batch["sketch"]).followed_by(Sketches.of(batch["first_sketch"]))
            n, first_n = (batch[name].to_numpy(zero_copy_only=False) for name in ("n", "first_n"))
            near = pa.array(_passes(n, first_n, both.apart(every, every + len(every)), settings.percent))
            yield batch.select(["first", "set_id"]).rename_columns(["a", "b"]).filter(near)

    columns = described.select("first", "set_id", "n", "sketch", "first_n", "first_sketch")
    return columns.mapInArrow(tidy(compare), "a bigint, b bigint").filter("a <> b").distinct()


def near_in_blocks(large: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that connect the same classes, for entries of many classes.

    Entries that have the same classes, told by two hashes over them, are tried
    once. Classes are compared with the first, in an order by hash, of each of
    their entries, and what that connects isn't compared again. Strangers, those
    of an entry that aren't connected with its first class, are compared with all
    of it, a block of two parts at a time.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "set_id")).alias(f"_{seed}") for seed in (1, 2)]
    first = F.min_by("set_id", F.xxhash64("entry", "set_id")).alias("first")
    alike = large.groupBy("entry").agg(F.count(F.lit(1)).alias("count"), first, *marks)
    once = alike.groupBy("count", "_1", "_2").agg(F.min_by(F.struct("entry", "first"), "entry").alias("one"))
    rows = stored(large.join(once.select("one.entry", "one.first"), "entry"), "crowded")
    stars = stored(near_first(rows, classes, settings), "stars")
    dealt = dealt_in_blocks(rows, components(stars), classes, settings)

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.combine_chunks()
        side, ids, n = (table[name].to_numpy() for name in ("own", "set_id", "n"))
        # A class of both parts, where they are the same one, comes once.
        _, kept = np.unique(ids, return_index=True)
        x, y = (kept[side[kept] == part] for part in (i, j))
        edges: list[tuple[int, int]] = []
        if len(x) and len(y):
            near = _near(n, Sketches.of(table["sketch"].combine_chunks()), settings.percent)
            edges = _forest(lambda one, k, some: near[x[k], y[some]] if one == 0 else near[x[some], y[k]], ids[x], ids[y])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return stars.union(dealt.groupBy("entry", "i", "j").applyInArrow(compare, "a bigint, b bigint")).distinct()


def dealt_in_blocks(rows: DataFrame, known: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Classes of entries (``entry set_id first``) that have strangers, by the blocks ``entry i j`` they are compared in.

    ``known`` (``node root``) has what is connected. Parts (``own``) of strangers
    are numbered from 0, those of the others downward from -1; a block has
    strangers on one side at least.
    """
    of_first = known.withColumnsRenamed({"node": "first", "root": "first_root"})
    met = rows.join(known.withColumnRenamed("node", "set_id"), "set_id", "left").join(of_first, "first", "left")
    stranger = ~(F.col("set_id").eqNullSafe(F.col("first")) | F.coalesce(F.col("root") == F.col("first_root"), F.lit(False)))
    placed = met.select("entry", "set_id", stranger.alias("stranger"))
    in_parts = lambda c: F.ceil(F.count(F.when(c, 1)) / settings.block).cast("int")
    parts = placed.groupBy("entry").agg(in_parts(F.col("stranger")).alias("k"), in_parts(~F.col("stranger")).alias("rest"))
    placed = placed.join(parts.filter("k > 0"), "entry")
    own = F.when(F.col("stranger"), F.pmod(F.xxhash64("set_id"), F.col("k"))).otherwise(
        -1 - F.pmod(F.xxhash64("set_id"), F.col("rest"))
    )
    others = F.when(F.col("stranger"), F.sequence(-F.col("rest"), F.col("k") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("k") - 1)
    )
    described = placed.join(classes, "set_id").select("entry", own.cast("int").alias("own"), F.explode(others).alias("other"), "set_id", "n", "sketch")
    return described.select(
        "entry", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "n", "sketch"
    )


def _near_forests(lists: pa.ListArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Forests of the pairs that aren't ruled out, inside each of many lists of ``set_id n sketch``."""
    per_list = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    members = lists.flatten()
    ids, n = (members.field(name).to_numpy(zero_copy_only=False) for name in ("set_id", "n"))
    sketches = Sketches.of(members.field("sketch"))
    first = np.cumsum(per_list) - per_list
    x, y = np.repeat(first, per_list), np.arange(len(ids))
    near = _passes(n[x], n[y], sketches.apart(x, y), percent)
    whole = np.bitwise_and.reduceat(near, first) if len(first) else np.empty(0, bool)
    some = np.repeat(whole, per_list) & (x != y)
    a, b = [ids[x[some]]], [ids[y[some]]]
    for k in np.flatnonzero(~whole & (per_list > 2)).tolist():
        start, end = first[k], first[k] + per_list[k]
        own, among = ids[start:end], _near(n[start:end], sketches.part(start, end), percent)
        edges = np.array(_forest(lambda _, k, some: among[k, some], own, own), np.int64).reshape(-1, 2)
        a.append(edges[:, 0])
        b.append(edges[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _passes(a: np.ndarray, b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, unlike in so many parities, can be linked."""
    near = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return near & (apart * (100 + percent) <= (100 - percent) * (a + b))


def _near(n: np.ndarray, sketches: Sketches, percent: int) -> np.ndarray:
    """Pairs that sizes and sketches don't rule out."""
    apart = np.zeros((len(n), len(n)), np.int64)
    for words in np.unique(sketches.words):
        some = np.flatnonzero(sketches.words >= words)
        table = sketches.folded(some, words)
        for row in np.flatnonzero(sketches.words[some] == words).tolist():
            unlike = np.bitwise_count(table ^ table[row]).sum(axis=1, dtype=np.int64)
            apart[some[row], some] = apart[some, some[row]] = unlike
    return _passes(n[:, None], n, apart, percent)


def sets_of(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``set_id elements`` (bytes) of the classes in ``wanted`` (``set_id``, and a ``doc_id`` that has it).

    Texts whose id isn't in a filter of a fixed number of bits are not cut up again.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(settings.slots))
    words = wanted.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(s % 32 AS INT))")).alias("bits")
    )
    table = np.zeros(settings.slots // 32, np.int64)
    for r in words.collect():  # at most slots / 32 rows
        table[r["w"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["slot"].to_numpy(zero_copy_only=False)
            some = pa.array((sent.value[at // 32] >> (at % 32)) & 1 == 1)
            found = [x for x in ngram_sets(filled(batch.filter(some)["text"]), settings.words) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                names=["set_id", "elements"],
            )

    rows = docs.select(slot.alias("slot"), "text").mapInArrow(tidy(cut), "set_id bigint, elements binary")
    return rows.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def _linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def _forest(
    links: Callable[[int, int, np.ndarray], np.ndarray], ids_x: np.ndarray, ids_y: np.ndarray
) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two lists.

    ``links(side, k, others)`` tells which of the ``others`` the k-th of one list
    (0 the first) is linked with; what is connected already isn't asked again.
    """
    out, open_x, open_y = [], np.ones(len(ids_x), bool), np.ones(len(ids_y), bool)
    for first in range(len(ids_x)):
        if not open_x[first]:
            continue
        open_x[first] = False
        queue = [(0, first)]
        while queue:
            side, k = queue.pop()
            others = np.flatnonzero(open_y if side == 0 else open_x)
            if not len(others):
                continue
            new = others[links(side, k, others)]
            (open_y if side == 0 else open_x)[new] = False
            own = ids_x[k] if side == 0 else ids_y[k]
            found = (ids_y if side == 0 else ids_x)[new]
            out += [(int(own), int(o)) for o in found if o != own]
            queue += [(1 - side, int(j)) for j in new]
    return out


def _exact_links(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], near: np.ndarray, percent: int):
    """For :func:`_forest`: pairs not ruled out, compared on whole sets."""

    def links(side: int, k: int, others: np.ndarray) -> np.ndarray:
        me, rest = (x[k], y[others]) if side == 0 else (y[k], x[others])
        out = near[me, rest]
        some = rest[out]
        if len(some):
            own, sizes = sets[me], np.array([len(sets[o]) for o in some])
            every = np.concatenate([sets[o] for o in some])
            met = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes) - sizes)
            out[out] = _linked(both, len(own), sizes, percent)
        return out

    return links


def verified_clusters(members: DataFrame, settings: Settings) -> DataFrame:
    """Links (spanning forests of blocks) within clusters; ``members``: ``root set_id elements``."""
    by_bytes = F.ceil(F.sum(F.length("elements")) / settings.block_bytes)
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / settings.block), by_bytes).cast("int")
    sizes = members.groupBy("root").agg(parts.alias("k"))
    own = F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int")
    placed = members.join(sizes, "root").withColumn("own", own)
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "elements"
    )

    def check(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        own = table["own"].to_numpy()
        ids = table["set_id"].to_numpy()
        order = np.argsort(ids)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"]]
        x, y = order[own[order] == i], order[own[order] == j]
        edges: list[tuple[int, int]] = []
        if len(x) and len(y):
            near = _near(np.array([len(s) for s in sets]), Sketches.made([sketch(s, 8) for s in sets]), settings.percent)
            edges = _forest(_exact_links(x, y, sets, near, settings.percent), ids[x], ids[y])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return dealt.groupBy("root", "i", "j").applyInArrow(check, "a bigint, b bigint")


def second_layer(sets: DataFrame, plan: list[Group]) -> DataFrame:
    """``set_id entries`` by the independent parting of the universe."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [all_entries(np.frombuffer(x.as_buffer(), np.uint64), plan, SECOND_SEED) for x in batch["elements"]]
            yield pa.RecordBatch.from_arrays(
                [batch["set_id"], pa.array(lists, pa.list_(pa.int64()))], names=["set_id", "entries"]
            )

    return sets.select("set_id", "elements").mapInArrow(index, "set_id bigint, entries array<bigint>")


def linked(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id n_shingles component_id`` of all documents."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plan = groups(docs.count(), settings)
    own = stored(indexed(docs, plan, settings), "sets")
    shared = stored(shared_entries(own, settings), "shared")
    small, many = by_size(shared, settings)
    crowded = stored(many.select("set_id").distinct(), "crowded-sets")

    classes = own.filter(F.col("sketch").isNotNull()).select("set_id", "n", "sketch")
    pairs = stored(near_pairs(small, classes.dropDuplicates(["set_id"]), settings), "pairs")

    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(crowded).distinct()
    first = own.filter(F.col("entries").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    sets = stored(sets_of(docs, first.join(wanted, "set_id", "left_semi"), settings), "elements")

    if not crowded.isEmpty():
        parted = stored(second_layer(sets.join(crowded, "set_id", "left_semi"), plan), "parted")
        again = stored(shared_entries(parted, settings), "shared-again")
        small, large = by_size(again, settings)
        classes = stored(classes.join(crowded, "set_id", "left_semi").dropDuplicates(["set_id"]), "crowded-classes")
        more = near_pairs(small, classes, settings).union(near_in_blocks(large, classes, settings))
        pairs = pairs.union(stored(more, "more-pairs"))
    # Every candidate pair is inside one cluster, and a set is sent to its cluster only.
    clusters = components(pairs)
    edges = verified_clusters(clusters.withColumnRenamed("node", "set_id").join(sets, "set_id"), settings)

    labels = components(edges).withColumnRenamed("node", "set_id")
    rooted = own.select("doc_id", "n", "set_id").join(labels, "set_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "set_id"))
    smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
