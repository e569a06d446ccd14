"""Problem 4: near-duplicate records with small edits.

A record is the set of its runs of three words; two are similar if they share at
least half of their union. All such pairs are found, by the generalised
pigeonhole principle on the sets seen as bit vectors:

- Bits that are correlated form a partition: runs of like frequency that share
  their anchor, the word of the least hash. (They are neighbours of one word, and
  one edit of it removes them all.)
- Of two similar records, at most H = |A|/3 bits of the smaller are missing in the
  larger, and at most |B|/2 of the larger in the smaller. With thresholds T over
  a record's partitions and sum(T + 1) = H + 1, there is a partition in which at
  most T bits are missing: the other shares s = k - T of its k bits there, which
  is to say a subset of s bits.
- s is 1, 2 or 3 and belongs to the partition, so that both sides name the same
  subsets. A dynamic program chooses it by class of partition (the frequency of
  its bits) such that the thresholds suffice at the least estimated cost: pairs
  that meet, from a hash sample of all subsets, and subsets named. What it
  chooses is what runs; it is logged.
- Partitions have one order for all records, the cheapest first, and a record
  names subsets of as many as it takes to reach H + 1, as the smaller one (it
  probes) and as the larger one. The first partition that two records share a
  subset of is then within reach of both, so probing is a join on subsets.

Records whose partitions cannot reach H + 1 under those thresholds are matched
with s = 1 in a second probe, which misses nothing. What a record names is packed
(16 bytes a subset) and sent to buckets of bounded size, in which all pairs of a
subset are looked at; a subset of very many records is split into groups, every
two of which meet in a bucket of their own. Candidates are verified on the whole
sets. Equal sets are matched once and carried as members of a class. The sets are
made from the texts once and kept as a checkpoint of hashes.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._util import cut

log = logging.getLogger(__name__)

#: Buckets of the frequency table of runs, and bits of the maps of keys and of subsets: what is sent to the workers has this many numbers whatever the data.
RUN_BUCKETS, KEY_BUCKETS, WHAT_BUCKETS = 1 << 20, 1 << 22, 1 << 22
#: Numbers of a table in one row of its partial sums.
SLICE = 1 << 15
#: Classes from this one on hold few runs that very many records have: a sample of partitions misses those that decide.
OFTEN = 4
#: To estimate candidates, one in so many partitions (by anchor) of rarer classes is counted in all records, and all partitions of the classes from `OFTEN` on in one of so many records.
SAMPLE, SOME = 8, 16
#: Bits of a partition at most of which subsets of 1, 2 and 3 are named (a thousand subsets or so); a record with a larger one is matched by single bits.
LARGEST = np.array([1 << 62, 1 << 62, 45, 19])
#: Sets of more bits have no sketch: one of 128 places could tell no two of them apart.
SKETCHED = 110
#: How far the thresholds overshoot on average, so that few records fall short.
SLACK = 1.3
#: Cost of naming a subset, in pairs to be looked at.
POSTING_COST = 20
#: Classes of partitions: the frequency of their bits by powers of `BASE`.
BASE, CLASSES = 4, 20
#: Bytes of texts and of packed sets that are looked at together.
CHARS, PACKED = 1 << 18, 1 << 20
#: Postings of a bucket, pairs looked at at once, and pairs met (of which most do not get that far) for a bucket of pairs.
POSTINGS, PAIRS, MET = 1 << 19, 1 << 16, 1 << 24
#: A subset that so many sets name is split into groups; so many such subsets at most.
HOT, HEAVIEST = 1 << 13, 1 << 16
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def word_codes(records: list[list[str | None] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, record, text) of every word of a batch of records, each a list of texts.

    Words are maximal runs of letters or digits, lower-cased. All words of a
    batch are hashed at once: a word's code is the sum of its characters, mixed
    with their places.
    """
    texts = [t or "" for parts in records for t in parts or ()]
    owners = np.repeat(np.arange(len(records)), [len(parts or ()) for parts in records])
    joined = "\n".join(texts).lower() + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _letters()[points]
    edges = np.nonzero(np.diff(inside, prepend=False))[0]
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = points[inside].astype(np.uint64)
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(offsets, sizes)
    codes = _mix(np.add.reduceat(_mix(chars * _M3 + place.astype(np.uint64) * _M1), offsets) + sizes.astype(np.uint64))
    breaks = np.nonzero(points == 10)[0]
    lines = np.array([t.count("\n") for t in texts], dtype=np.int64)
    text_ends = breaks[np.cumsum(lines + 1) - 1]
    text = np.searchsorted(text_ends, starts)
    return codes, owners[text], text


def bits(records: list[list[str | None] | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, bit, anchor) of the distinct runs of `size` words in one text, by record, anchor and bit.

    A bit is a hash of 36 bits of the run, the anchor one of 12 bits of its word
    of the least hash. At most 65,536 records at a time, so that a number holds all three.
    """
    codes, record, text = word_codes(records)
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    here = np.nonzero(text[:n] == text[size - 1 :])[0]
    run, anchor = np.zeros(len(here), dtype=np.uint64), codes[here]
    for i in range(size):
        run = _mix(run * _M3 + codes[here + i])
        anchor = np.minimum(anchor, codes[here + i])
    all_ = np.sort((record[here].astype(np.uint64) << np.uint64(48)) | ((anchor & np.uint64(0xFFF)) << np.uint64(36)) | (run >> np.uint64(28)))
    all_ = all_[np.append(True, all_[1:] != all_[:-1])[: len(all_)]]
    return (all_ >> np.uint64(48)).astype(np.int64), all_ & np.uint64(2**36 - 1), (all_ >> np.uint64(36)) & np.uint64(0xFFF)


def _pack(run: np.ndarray, anchor: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Sets of so many bits each, six bytes a bit: the bit and its anchor."""
    data = np.ascontiguousarray(((run << np.uint64(12)) | anchor).view(np.uint8).reshape(-1, 8)[:, :6])
    offsets = 6 * np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, bit, anchor) of packed sets."""
    packed = packed.cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    wide = np.zeros((int(offsets[-1] - offsets[0]) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 6)
    both = wide.reshape(-1).view(np.uint64)
    return np.repeat(np.arange(len(packed)), np.diff(offsets) // 6), both >> np.uint64(12), both & np.uint64(0xFFF)


def partitions(owner: np.ndarray, run: np.ndarray, anchor: np.ndarray, level: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Bits sorted by (record, rank of class, anchor, bit), with starts, sizes and classes of the partitions.

    A partition holds the bits of one anchor and one class of frequency: both are
    properties of the bit, so all records are divided alike. The bits come by
    record, anchor and bit, so only records and classes are left to sort by: two
    bytes, if records are 3,276 at most, which are sorted without comparing.
    """
    kind = level[(run & np.uint64(RUN_BUCKETS - 1)).astype(np.int64)].astype(np.int64)
    place = owner * CLASSES + (rank[kind] if rank is not None else kind)
    order = np.argsort(place.astype(np.uint16) if len(place) and owner[-1] < (1 << 16) // CLASSES else place, kind="stable")
    owner, run, anchor, kind = owner[order], run[order], anchor[order], kind[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.append(starts, len(run)))
    return owner, run, anchor, starts, sizes, kind[starts]


def _single(run: np.ndarray) -> np.ndarray:
    """The subsets of one bit."""
    return _mix(run + _M3)


def subsets(run: np.ndarray, starts: np.ndarray, sizes: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partition, subset) of all subsets of s bits of each partition."""
    where, what = [], []
    for k, t in ((x >> 2, x & 3) for x in np.unique(np.where((s == 1) | (sizes < s), 0, sizes * 4 + s)).tolist()):
        if not t:
            continue
        mine = np.nonzero((sizes == k) & (s == t))[0]
        picks = np.array(list(combinations(range(k), t)), dtype=np.int64)
        step = max(1, (1 << 17) // len(picks))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            h = np.uint64(t)
            for i in range(t):
                h = _mix(h * _M3 + run[(starts[some][:, None] + picks[:, i]).reshape(-1)])
            where.append(np.repeat(some, len(picks)))
            what.append(h)
    mine = np.nonzero((s == 1) & (sizes > 0))[0]
    if len(mine):
        many = sizes[mine]
        where.append(np.repeat(mine, many))
        what.append(_single(run[np.arange(int(many.sum())) + np.repeat(starts[mine] - np.cumsum(many) + many, many)]))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(where), np.concatenate(what)


def allocate(units: np.ndarray, candidates: np.ndarray, needed: float, steps: int = 400) -> np.ndarray:
    """The subset size of each class (0: not used) that reaches `needed` units at the fewest candidates.

    units[c, s] and candidates[c, s] are totals over all records for class c and
    subset size s. Dynamic program over classes and units in `steps` steps,
    rounded down, so the choice never falls short by rounding. If all classes
    together cannot reach it, single bits are used throughout.
    """
    classes, sizes = units.shape
    if units[:, 1:].max(axis=1).sum() < needed or needed <= 0:
        return np.ones(classes, dtype=np.int64)
    step = needed / steps
    cost = np.full(steps + 1, np.inf)
    cost[0] = 0
    picks = []
    for c in range(classes):
        new, pick = cost.copy(), np.zeros(steps + 1, dtype=np.int64)
        for s in range(1, sizes):
            gain = int(units[c, s] / step)
            if not gain:
                continue
            to = np.minimum(np.arange(steps + 1) + gain, steps)
            trial = cost + candidates[c, s]
            for a, b in enumerate(to):
                if trial[a] < new[b]:
                    new[b], pick[b] = trial[a], s * (steps + 1) + a
        picks.append(pick)
        cost = new
    if not np.isfinite(cost[steps]):
        return np.ones(classes, dtype=np.int64)
    out, at = np.zeros(classes, dtype=np.int64), steps
    for c in range(classes - 1, -1, -1):
        if picks[c][at]:
            out[c], at = divmod(int(picks[c][at]), steps + 1)
    return out


def _surplus(sizes: np.ndarray) -> np.ndarray:
    """Units beyond the pigeonhole's, so that similar sets share several subsets: two thirds of the root of the size."""
    return (np.sqrt(sizes) * 2 / 3).astype(np.int64)


def _needed(sizes: np.ndarray, divisor: int = 2) -> np.ndarray:
    """Units by size of the set: one more than the bits that a similar set may lack and a surplus, but no more than there are bits."""
    return np.minimum(sizes // divisor + 1 + _surplus(sizes), sizes)


def sets(records: DataFrame, size: int) -> DataFrame:
    """`id, key, bits`: every non-empty set of `id string, texts array<string>`, packed; equal sets have equal keys. Checkpointed."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1, CHARS):
                owner, run, anchor = bits(batch.column(1).to_pylist(), size)
                starts = np.nonzero(np.diff(owner, prepend=-1))[0]
                mixed = _mix(run * _M2 + _M3)
                key = _mix(np.add.reduceat(mixed, starts) ^ (np.add.reduceat(mixed * mixed, starts) * _M1)) if len(starts) else run
                packed = _pack(run, anchor, np.diff(np.append(starts, len(run))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[starts])), pa.array(key.view(np.int64)), packed], names=["id", "key", "bits"])

    return cut(records.select("id", "texts").where("id IS NOT NULL").mapInArrow(run_, "id string, key long, bits binary"))


def _parts(whole: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of at most 2,000 rows and about `most` bytes of a column: their arrays stay in the processor's cache."""
    step = max(50, min(2000, len(whole) * most // max(1, whole.column(column).nbytes)))
    return (whole.slice(at, step) for at in range(0, len(whole), step))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(keys, unpacked sets) of `key, bits` in parts of bounded size; equal sets of a task mostly only once."""
    seen: set[int] = set()
    for whole in batches:
        for batch in _parts(whole, 1, PACKED):
            key, packed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = [i for i, k in enumerate(key.tolist()) if not (k in seen or seen.add(k))]
            if len(fresh) == len(key):
                yield key, _unpack(packed)
            elif fresh:
                yield key[fresh], _unpack(packed.take(pa.array(fresh)))


def _gathered(parts: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type, numbers: int) -> np.ndarray:
    """One table of fixed size from `slice int, part binary` rows of the workers, combined slice by slice on the workers."""
    size = min(SLICE, numbers)

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(size, kind)
        for x in part.column("part").to_pylist():
            total = combine(total, np.frombuffer(x, kind))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((numbers // size, size), kind)
    for r in parts.groupBy("slice").applyInArrow(add, "slice int, part binary").collect():
        out[r["slice"]] = np.frombuffer(r["part"], kind)
    return out.reshape(-1)


def _slices(table_: np.ndarray) -> pa.RecordBatch:
    """The slices of a worker's table that hold anything."""
    slices = table_.reshape(-1, min(SLICE, len(table_)))
    used = np.nonzero(slices.any(axis=1))[0]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([slices[i].tobytes() for i in used], pa.binary())], names=["slice", "part"])


def table(found: DataFrame) -> np.ndarray:
    """Frequency of runs by bucket, over all sets. Every task sends its sums in slices of fixed size; they add up to a table of fixed size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held, many = np.zeros(RUN_BUCKETS, np.uint32), [], 0
        for _, (_, run, _) in _batches(batches):
            held.append((run & np.uint64(RUN_BUCKETS - 1)).astype(np.int32))
            many += len(run)
            if many > RUN_BUCKETS:
                runs += np.bincount(np.concatenate(held), minlength=RUN_BUCKETS).astype(np.uint32)
                held, many = [], 0
        if many:
            runs += np.bincount(np.concatenate(held), minlength=RUN_BUCKETS).astype(np.uint32)
        yield _slices(runs)

    add = lambda a, b: np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32)
    return _gathered(found.select("key", "bits").mapInArrow(partial, "slice int, part binary"), add, np.uint32, RUN_BUCKETS)


def bitmap(values: DataFrame, numbers: int) -> np.ndarray:
    """A map of `numbers` bits, packed: the places that the one long column of `values` falls in. Made on the workers, slice by slice."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(numbers, dtype=bool)
        for batch in batches:
            there[batch.column(0).to_numpy(zero_copy_only=False) & (numbers - 1)] = True
        yield _slices(np.packbits(there))

    return _gathered(values.mapInArrow(partial, "slice int, part binary"), np.bitwise_or, np.uint8, numbers // 8)


def _has(map_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether a map has the places of the values."""
    at = (values & np.uint64(8 * len(map_) - 1)).astype(np.int64)
    return (map_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


@dataclass
class Plan:
    """The allocation: class of each bucket of runs, subset size and rank of each class; at most so many subsets are named in all, and about so many pairs meet."""

    level: np.ndarray
    mode: np.ndarray
    rank: np.ndarray
    postings: int
    pairs: float = 0.0

    def single(self) -> Plan:
        """The same with single bits throughout, from rare to frequent."""
        return replace(self, mode=np.ones(CLASSES, np.int64), rank=np.arange(CLASSES))


def plan(found: DataFrame) -> Plan:
    """The allocation of thresholds by the dynamic program.

    The cost of naming subsets of s bits of a class of partitions is the pairs of
    records that would meet, and `POSTING_COST` for every subset named. Pairs on
    single bits come from the table of runs, those on larger subsets from the
    subsets of sampled partitions in all records, or of all partitions in sampled
    records where few partitions make most of the pairs.
    """
    level = np.minimum(np.log2(np.maximum(runs := table(found), 1)) / np.log2(BASE), CLASSES - 1).astype(np.uint8)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, needed = np.zeros((2, CLASSES, 4)), 0
        rows = lambda kind, s, what, n, m: pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(s, pa.int32()), pa.array(what, pa.int64()), pa.array(n, pa.float64()), pa.array(m, pa.float64())], names=["kind", "s", "what", "n", "m"])
        for key, unpacked in _batches(batches):
            owner, run, anchor, starts, sizes, kind = partitions(*unpacked, level)
            sampled = np.where(kind < OFTEN, (_mix(anchor[starts]) & np.uint64(SAMPLE - 1)) == 0, ((key & (SOME - 1)) == 0)[owner[starts]])
            needed += int(_needed(np.bincount(owner, minlength=len(key))).sum())
            k = sizes.astype(np.float64)
            for s, many in ((1, k), (2, k * (k - 1) / 2), (3, k * (k - 1) * (k - 2) / 6)):
                totals[0, :, s] += np.bincount(kind, weights=np.maximum(sizes - s + 1, 0), minlength=CLASSES)
                totals[1, :, s] += np.bincount(kind, weights=many, minlength=CLASSES)
                if s > 1:
                    where, what = subsets(run, starts, sizes, np.where(sampled & (sizes <= LARGEST[s]), s, 0))
                    what = np.sort((what & ~np.uint64(63)) | (kind[where].astype(np.uint64) << np.uint64(1)) | np.uint64(1))  # the class in place of the lowest bits
                    first = np.nonzero(np.append(True, what[1:] != what[:-1])[: len(what)])[0]
                    what, n = what[first], np.diff(np.append(first, len(what)))
                    yield rows((what >> np.uint64(1)) & np.uint64(31), np.full(len(what), s), what.view(np.int64), n, np.zeros(len(what)))
        yield rows(np.repeat(np.arange(CLASSES), 3), np.tile([1, 2, 3], CLASSES), np.zeros(3 * CLASSES, np.int64), totals[0, :, 1:].reshape(-1), totals[1, :, 1:].reshape(-1))
        yield rows(np.array([-1]), np.array([0]), np.zeros(1, np.int64), np.array([float(needed)]), np.zeros(1))

    sums = found.select("key", "bits").mapInArrow(measure, "kind int, s int, what long, n double, m double").groupBy("kind", "s", "what").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    units, postings_, pairs, needed = np.zeros((CLASSES, 4)), np.zeros((CLASSES, 4)), np.zeros((CLASSES, 4)), 0.0
    for r in sums.groupBy("kind", "s").agg(F.sum(F.when(F.col("what") == 0, F.col("n"))).alias("units"), F.sum("m").alias("postings"), F.sum(F.when(F.col("what") != 0, F.col("n") * (F.col("n") - 1) / 2)).alias("pairs")).collect():
        if r.kind < 0:
            needed = r.units
        else:
            units[r.kind, r.s], postings_[r.kind, r.s], pairs[r.kind, r.s] = r.units or 0, r.postings or 0, (SAMPLE if r.kind < OFTEN else SOME**2) * (r.pairs or 0)
    often = runs.astype(np.float64)
    pairs[:, 1] = np.bincount(level, weights=often * (often - 1) / 2, minlength=CLASSES)
    cost = pairs + POSTING_COST * postings_
    mode = allocate(units, cost, needed * SLACK)
    own = np.arange(CLASSES)
    price = np.where(mode > 0, cost[own, mode] / np.maximum(units[own, mode], 1), np.inf)
    log.info("near-duplicates: %d units needed; subset sizes by class of frequency (powers of %d): %s", needed, BASE, {int(c): int(mode[c]) for c in own if units[c, 1]})
    used = mode > 0
    return Plan(level, mode, np.argsort(np.argsort(price, kind="stable"), kind="stable"), int(postings_[own, mode][used].sum()), float(pairs[own, mode][used].sum()))


def named(batches: Iterator[pa.RecordBatch], plan_: Plan, part: str = "all", among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(subset, key, size of the set, units before the partition, sketch in two halves) of the subsets that the sets of `key, bits` name, batch by batch; subset and key in 40 bits.

    The sketch has the parity of the bits at each of 128 places, so two sets differ
    in as many bits at least as their sketches do. It is 0, which tells nothing, for
    subsets of the rarest class and for sets of more than `SKETCHED` bits.

    `part`: "all" sets that can do so by the plan; "short" ones, which cannot
    reach their threshold by it or have a partition too large for its subsets, by
    single bits; "rest", the first again, by single bits as far as the map `among`
    has them.
    """
    for key, (owner, run, anchor) in _batches(batches):
        if among is not None:  # only sets of which the map has a bit
            some = np.bincount(owner, weights=_has(among, _single(run)), minlength=len(key)) > 0
            keep = some[owner]
            key, owner, run, anchor = key[some], (np.cumsum(some) - 1)[owner[keep]], run[keep], anchor[keep]
        if not len(key):
            continue
        many, count = len(key), np.bincount(owner, minlength=len(key))
        placed, out = _placed(owner, run, anchor, plan_), np.full(len(key), part == "short")
        out ^= _short(placed, count)
        if out.all():
            continue
        s1, s2 = _sketches(run, count)
        if part != "all":
            keep = ~out[owner]
            placed = _placed(owner[keep], run[keep], anchor[keep], plan_.single())
        run, mine, starts, sizes, s, units, kind = placed
        before = np.cumsum(units) - units
        first = np.searchsorted(mine, np.arange(many))
        reach = before - before[np.minimum(first, len(before) - 1)][mine]
        left = _needed(count)[mine] - reach
        where, what = subsets(run, starts, np.minimum(sizes, np.maximum(left, 0) + s - 1), np.where((left > 0) & ~out[mine], s, 0))  # of the last partition only as many bits as give the units still needed
        if among is not None:
            some = _has(among, what)
            where, what = where[some], what[some]
        of = mine[where]
        often = np.where(kind[where] > 0, np.uint64(2**64 - 1), np.uint64(0))
        yield what & np.uint64(2**40 - 1), key[of].view(np.uint64) >> np.uint64(24), count[of], reach[where], s1[of] & often, s2[of] & often


def _short(placed: tuple[np.ndarray, ...], count: np.ndarray) -> np.ndarray:
    """Whether sets of `count` bits, placed by a plan, can't reach their threshold by it or have a partition too large for its subsets."""
    _, mine, _, sizes, s, units, _ = placed
    short = np.bincount(mine, weights=units, minlength=len(count)) < _needed(count)
    short[mine[(s > 0) & (sizes > LARGEST[s])]] = True
    return short


def lacking(found: DataFrame, plan_: Plan) -> DataFrame:
    """`key, bits` of the sets that the plan falls short of. Checkpointed."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (owner, run, anchor) in _batches(batches):
            count = np.bincount(owner, minlength=len(key))
            short = _short(_placed(owner, run, anchor, plan_), count)
            keep = short[owner]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[short]), _pack(run[keep], anchor[keep], count[short])], names=["key", "bits"])

    return cut(found.select("key", "bits").mapInArrow(run_, "key long, bits binary"))


def _sketches(run: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of sets of `count` bits, one after the other, in two halves; 0 for sets of more than `SKETCHED`."""
    small = count <= SKETCHED
    out = np.zeros((2, len(count)), np.uint64)
    if small.any():
        heads = np.cumsum(count[small]) - count[small]
        mixed = _mix(run[np.repeat(small, count)] * _M2 + _M3)
        place, half = np.uint64(1) << (mixed >> np.uint64(58)), (mixed >> np.uint64(57)) & np.uint64(1)
        for h in (0, 1):
            out[h, small] = np.bitwise_xor.reduceat(np.where(half == h, place, np.uint64(0)), heads)
    return out[0], out[1]


def _placed(owner: np.ndarray, run: np.ndarray, anchor: np.ndarray, plan_: Plan) -> tuple[np.ndarray, ...]:
    """(bits; record, start, size, size of subsets, units and class of each partition), in the plan's order."""
    owner, run, _, starts, sizes, kind = partitions(owner, run, anchor, plan_.level, plan_.rank)
    s = plan_.mode[kind]
    return run, owner[starts], starts, sizes, s, np.where(s > 0, np.maximum(sizes - s + 1, 0), 0), kind


def heavy(found: DataFrame, plan_: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(subsets that about `HOT` sets name or more, sorted; how many groups their sets are split into).

    Told from one set in sixteen by hash, of which all are counted. This decides
    how the work is split, not what is found: a subset that is missed here is
    paired whole. At most `HEAVIEST` subsets, the most frequent.
    """

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array((b.column(0).to_numpy(zero_copy_only=False) & 15) == 0)) for b in batches)
        for what, *_ in named(some, plan_):
            what, n = np.unique(what, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(what.view(np.int64)), pa.array(n, pa.int64())], names=["what", "n"])

    rows = found.select("key", "bits").mapInArrow(run_, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT // 16).orderBy(F.desc("n")).limit(HEAVIEST).collect()
    rows.sort(key=lambda r: r.what)
    return np.array([r.what for r in rows], np.uint64), np.array([-(-16 * r.n // HOT) for r in rows], np.int64)


def _salted(posting: tuple[np.ndarray, ...], hot: np.ndarray, groups_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings with those of heavy subsets spread: each of g groups of sets meets itself and every other one under a subset of its own. The side last: 0 within a group, 1 and 2 between two."""
    what, key = posting[:2]
    side = np.zeros(len(what), np.uint8)
    at = np.minimum(np.searchsorted(hot, what), len(hot) - 1) if len(hot) else None
    if at is None or not (is_hot := hot[at] == what).any():
        return *posting, side
    g = groups_[at[is_hot]]
    own = (_mix(key[is_hot] * _M1 + _M2) % g.astype(np.uint64)).astype(np.int64)
    copy = np.repeat(np.nonzero(is_hot)[0], g)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(g) - g, g)
    mine = np.repeat(own, g)
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    fresh = _mix(what[copy] * _M3 + low.astype(np.uint64) * _M1 + high.astype(np.uint64) * _M2 + np.uint64(1)) & np.uint64(2**40 - 1)
    spread = fresh, *(x[copy] for x in posting[1:]), np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.uint8)
    return tuple(np.concatenate([x[~is_hot], y]) for x, y in zip((*posting, side), spread, strict=True))


def _packed(bucket: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    """`bucket, sketched, packed`: a row per bucket with the numbers of each column in planes of bytes, as many as given; the first column rises within a bucket and is kept as steps."""
    starts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    ends = np.append(starts[1:], len(bucket))
    first = columns[0][0]
    steps = first - np.concatenate([np.zeros(1, first.dtype), first[:-1]])
    steps[starts] = first[starts]
    planes, at = np.empty((sum(k for _, k in columns), len(bucket)), np.uint8), 0
    for x, k in [(steps, columns[0][1]), *columns[1:]]:
        planes[at : at + k] = x.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)[:, :k].T
        at += k
    data, offsets = np.empty(planes.size, np.uint8), np.append(0, ends).astype(np.int64) * len(planes)
    for a, b, c, d in zip(starts.tolist(), ends.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        data[c:d].reshape(len(planes), -1)[:] = planes[:, a:b]
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), len(columns) == len(_POSTING + _SKETCH))), packed], names=["bucket", "sketched", "packed"])


def _unpacked(planes: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The numbers in planes of so many bytes each."""
    out, at = [], 0
    for k in widths:
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :k] = planes[at : at + k].T
        out.append(wide.reshape(-1).view(np.uint64))
        at += k
    return out


#: Bytes of the columns of postings (subset, key, size, units before, flags) and of pairs (a, b, subsets shared, subsets to share).
_POSTING, _PAIR = (5, 5, 4, 4, 1), (5, 5, 2, 2)
#: Bytes of a sketch, which postings of frequent subsets have besides.
_SKETCH = (8, 8)


def postings(found: DataFrame, plan_: Plan, buckets: int, hot: tuple[np.ndarray, np.ndarray], part: str = "all", among: np.ndarray | None = None, tag: bool = False) -> DataFrame:
    """`bucket, sketched, packed`: what the sets name, by ranges of subsets; `tag` marks them. Of the 19 bytes of a posting, the upper ones of most columns are alike and compress."""

    def pack(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        what, key, n, reach, s1, s2, side = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(what)
        for some in (order[(s1 | s2)[order] == 0], order[(s1 | s2)[order] != 0]):
            if not len(some):
                continue
            columns = [(what, 5), (key, 5), (n, 4), (reach, 4), (side | (4 if tag else 0), 1)] + [(s1, 8), (s2, 8)] * bool((s1 | s2)[some[:1]].any())
            yield _packed(((what[some] * np.uint64(buckets)) >> np.uint64(40)).astype(np.int64), [(x[some], k) for x, k in columns])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for one in named(batches, plan_, part, among):
            held.append(_salted(one, *hot))
            many += len(held[-1][0])
            if many > POSTINGS:
                yield from pack(held)
                held, many = [], 0
        if many:
            yield from pack(held)

    return found.select("key", "bits").mapInArrow(run_, "bucket int, sketched boolean, packed binary")


def _within(what: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many of the postings after each one are of the same subset and of sets that its own, as the smaller one, can be similar to.

    The postings are sorted by subset and size of the set. The larger set is
    within twice the smaller, and the more units the smaller one has before, the
    less it may lack of the larger one, which bounds the larger one's size too.
    """
    most = 2 * n - 3 * np.maximum(reach - _surplus(n), 0)
    group, wide = np.cumsum(np.append(0, what[1:] != what[:-1])), int(n.max()) + 1
    upto = np.searchsorted(group * wide + n, group * wide + np.clip(most, 0, wide - 1), "right")
    return np.maximum(upto - np.arange(len(what)) - 1, 0)


def _several(what: np.ndarray) -> np.ndarray:
    """Whether a number is there more than once."""
    order = np.argsort(what)
    same = what[order[1:]] == what[order[:-1]]
    out = np.zeros(len(what), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _counted(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, count, shares) with the counts of equal pairs added up."""
    a, b, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, c, s = a[order], b[order], c[order], s[order]
    starts = np.nonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[0]
    return a[starts], b[starts], np.add.reduceat(c, starts), s[starts]


def spread(plan_: Plan, hot: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(buckets of postings, buckets of pairs) that keep to their size: the copies that heavy subsets need for their groups count as well."""
    copies = int((HOT * hot[1] * (hot[1] - 1)).sum())
    buckets = 1 + (plan_.postings + copies) // POSTINGS
    return buckets, max(buckets, 1 + int(plan_.pairs / MET))


def candidates(packed: DataFrame, buckets: int, tagged: bool = False, pair_buckets: int = 0) -> DataFrame:
    """`a, b` (keys of 40 bits, a < b) of the sets that may be similar.

    The larger must be within twice the smaller. Similar sets share at least a
    third of both sizes together, so as many subsets as the surplus and one are
    shared within that many units and those of the bits that each may lack; pairs
    are counted on no others, and must reach that number (or that third, where it
    is less). A bucket is one partition of about `POSTINGS` postings whatever the
    input; it counts what its pairs share before they go, packed, to buckets of
    pairs (`pair_buckets`, or as many). `tagged`: at least one of the two is tagged,
    so a subset's tagged sets come first and only they look for others.
    """
    pair_buckets = pair_buckets or buckets

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(sketched, np.frombuffer(x, np.uint8).reshape(sum(_POSTING + _SKETCH * sketched), -1)) for batch in batches for sketched, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if not parts:
            return
        whats = [np.cumsum(_unpacked(x, _POSTING[:1])[0], dtype=np.uint64) for _, x in parts]
        several, at, columns = _several(np.concatenate(whats)), 0, []
        for i, (sketched, x) in enumerate(parts):
            some = several[at : at + len(whats[i])]
            at += len(some)
            one = [whats[i][some], *_unpacked(x[_POSTING[0] :, some], _POSTING[1:] + _SKETCH * sketched)]
            columns.append(one if sketched else [*one, *[np.zeros(len(one[0]), np.uint64)] * 2])
        what, key, n, reach, flags, s1, s2 = (np.concatenate(x) for x in zip(*columns, strict=True))
        del parts, whats, columns
        if not len(what):
            return
        order = np.lexsort((key, flags & np.uint64(3), (flags & np.uint64(4)) == 0, what) if tagged else (key, n, what))
        new = np.ones(len(what), bool)
        w, k, f = what[order], key[order], flags[order]
        new[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1]) | (f[1:] != f[:-1])  # equal sets of several tasks
        order = order[new]
        what, key, n, reach, flags, s1, s2 = what[order], key[order], n[order].astype(np.int64), reach[order].astype(np.int64), flags[order].astype(np.uint8), s1[order], s2[order]
        del w, k, f, new, order
        shares = _surplus(n) + 1
        if tagged:
            later = np.searchsorted(what, what, "right") - np.arange(len(what)) - 1
            later[(flags & 4) == 0] = 0
        else:
            later = _within(what, n, reach)
        upto = np.cumsum(later)

        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b, c, s = _counted(parts)
            bucket = ((_mix(a * _M1 + b * _M2) >> np.uint64(24)) * np.uint64(pair_buckets) >> np.uint64(40)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            return _packed(bucket[order], [(x[order], k) for x, k in zip((a, b, np.minimum(c, 65535), s), _PAIR, strict=True)])

        at, seen, held = 0, [], 0
        while at < len(what):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            many = later[at:to]
            small = np.repeat(np.arange(at, to), many)
            big = small + 1 + np.arange(len(small)) - np.repeat(np.cumsum(many) - many, many)
            at = to
            if tagged:
                swap = n[small] > n[big]
                small, big = np.where(swap, big, small), np.where(swap, small, big)
            p, q = n[small], n[big]
            fit = reach[big] < (2 * q - p) // 3 + shares[small]
            if tagged:
                fit &= (q <= 2 * p) & (reach[small] < (2 * p - q) // 3 + shares[small])
            fit &= (key[small] != key[big]) & (((flags[small] & 3) == 0) | ((flags[small] & 3) != (flags[big] & 3)))
            small, big, pq = small[fit], big[fit], (p + q)[fit]
            a1, a2, b1, b2 = s1[small], s2[small], s1[big], s2[big]
            known = ((a1 | a2) != 0) & ((b1 | b2) != 0)
            fit = ~known | (3 * (np.bitwise_count(a1 ^ b1).astype(np.int64) + np.bitwise_count(a2 ^ b2)) <= pq)
            small, big, pq = small[fit], big[fit], pq[fit]
            enough = np.minimum(shares[small], -(-pq // 3))
            if len(small):
                seen.append(_counted([(np.minimum(key[small], key[big]), np.maximum(key[small], key[big]), np.ones(len(small), np.int64), enough)]))
                held += len(seen[-1][0])
            if held > 16 * PAIRS:
                yield out(seen)
                seen, held = [], 0
        if held:
            yield out(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, most = [], 0, 32 * PAIRS
        for batch in batches:
            for x in batch.column(2).to_pylist():
                a, b, c, s = _unpacked(np.frombuffer(x, np.uint8).reshape(sum(_PAIR), -1), _PAIR)
                seen.append((np.cumsum(a, dtype=np.uint64), b, c.astype(np.int64), s.astype(np.int64)))
                held += len(seen[-1][0])
                if held > most:
                    seen = [_counted(seen)]
                    held = len(seen[0][0])
                    most = max(32 * PAIRS, 2 * held)
        if seen:
            a, b, c, s = _counted(seen)
            yield pa.RecordBatch.from_arrays([pa.array(x[c >= s].view(np.int64)) for x in (a, b)], names=["a", "b"])

    met = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "bucket int, sketched boolean, packed binary")
    return met.repartitionById(pair_buckets, F.col("bucket")).mapInArrow(count, "a long, b long")


def similar_sets(records: DataFrame, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pairs of keys of different sets that share half their union or more, with `inter` and `total`; `id, key` of all non-empty sets).

    `records` has `id string, texts array<string>`; a record's set is the union
    over its texts of their runs of `size` words.
    """
    found = sets(records, size)
    by = plan(found)
    hot = heavy(found, by)
    buckets, pair_buckets = spread(by, hot)
    pairs = cut(candidates(postings(found, by, buckets, hot), buckets, pair_buckets=pair_buckets))
    short = lacking(found, by)
    whats = lambda batches: (pa.RecordBatch.from_arrays([pa.array(w.view(np.int64))], names=["what"]) for w, *_ in named(batches, by, "short"))
    wanting = bitmap(short.mapInArrow(whats, "what long"), WHAT_BUCKETS)
    if wanting.any():
        hot = heavy(found, by.single())
        buckets, pair_buckets = spread(by, hot)
        both = postings(short, by, buckets, hot, "short", tag=True).unionByName(postings(found, by, buckets, hot, "rest", among=wanting))
        pairs = cut(pairs.unionByName(candidates(both, buckets, tagged=True, pair_buckets=pair_buckets)).distinct())
    wanted = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("k")), KEY_BUCKETS)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            short = key.view(np.uint64) >> np.uint64(24)
            mask = pa.array(_has(wanted, short))
            yield pa.RecordBatch.from_arrays([pa.array(key).filter(mask), pa.array(short.view(np.int64)).filter(mask), batch.column(1).filter(mask)], names=["key", "k", "bits"])

    def wide(packed: bytes) -> np.ndarray:
        out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
        out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
        return out.reshape(-1).view(np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, sums = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = wide(x), wide(y)
                shared.append(len(np.intersect1d(p, q, assume_unique=True)))
                sums.append(len(p) + len(q))
            inter = np.array(shared, dtype=np.int64)
            total = np.array(sums, dtype=np.int64) - inter
            keep = pa.array(2 * inter >= total)
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x).filter(keep) for x in (np.minimum(a, b), np.maximum(a, b), inter, total)], names=["a", "b", "inter", "total"])

    whole = found.select("key", "bits").mapInArrow(needed, "key long, k long, bits binary").dropDuplicates(["key"])
    side = lambda x: whole.select(F.col("k").alias(x), F.col("key").alias(f"key_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.hint("merge").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    verified = both.select("key_a", "key_b", "bits_a", "bits_b").mapInArrow(compare, "a long, b long, inter long, total long")
    return cut(verified), cut(found.select("id", "key").distinct())


def similar_pairs(records: DataFrame, size: int = 3) -> DataFrame:
    """`id_a, id_b` of all similar records, equal sets included, id_a < id_b.

    Records without a run of `size` words, null texts and null ids are similar to
    none. Rows that repeat an id and its text are one record; the text itself is
    never shuffled for that. A class of equal sets is expanded into
    its pairs because the pairs are what is asked for.
    """
    pairs, members = similar_sets(records, size)
    a, b = members.select(F.col("id").alias("x"), F.col("key").alias("a")), members.select(F.col("id").alias("y"), F.col("key").alias("b"))
    between = pairs.join(a, "a").join(b, "b").select("x", "y")
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    copies = members.join(many, "key", "left_semi")
    equal = copies.select("key", F.col("id").alias("x")).join(copies.select("key", F.col("id").alias("y")), "key").where("x < y").select("x", "y")
    return between.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """`id, group, n_links`: the connected classes of similar sets, a row per record, `group` the least id of the class.

    Every round joins each key's neighbours to the least key among them and
    itself, first the greater ones, then the lesser ones, until the edges are
    stars; the rounds grow with the logarithm of a chain's length. A round writes
    one table of edges, no more than it began with, and the one before is let go;
    both sides of its joins grow, so none is broadcast. `n_links` counts the other
    sets a record's set is similar to.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    stars = cut(edges.where("b < a").select(F.col("a").alias("u"), F.col("b").alias("v")))
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.distinct()
        first = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(first.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(first.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        same = new.count() == stars.count() and new.join(stars.hint("merge"), ["u", "v"], "left_anti").isEmpty()
        stars = new
        del both, least, large, low, first, small, new
        if same:
            break
    root = stars.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root"))
    of = members.join(root.hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    name = of.groupBy("root").agg(F.min("id").alias("group"))
    links = edges.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n_links"))
    out = of.join(name.hint("merge"), "root").join(links.hint("merge"), "key", "left")
    return out.select("id", "group", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
