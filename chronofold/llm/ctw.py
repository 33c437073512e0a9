"""Language-model scoring by context-tree weighting over byte contexts.

Every byte is coded as eight binary decisions. A decision's node is (context of d
preceding bytes, the bits of the byte so far); each node keeps the counts of its two
outcomes, and all depths d = 0 .. depth are mixed: with the Krichevsky-Trofimov block
probability P_e of a node's counts and the weighted probability P_w = (P_e + product of
the children's P_w) / 2, the share of the node's own estimate is P_e / (2 P_w), the rest
goes on to the next longer context. P_w depends on the counts alone, so the tree is
learned from one aggregate over the corpus and its probabilities are then fixed.

The work is dealt in blocks of texts, so that the exchanges move packed rows and not one
row per context, and the tree in three tiers, each by the context bytes that are latest:

1. blocks: documents are dealt by a hash of their id. A block's distinct (context, byte)
   grams and words are packed, sorted and delta coded, per deep shard.
2. deep shards, by ``ROUTE`` latest bytes (at most 2 ** 24 grams share them): a shard
   merges its requests to the table of counts, the model, which grows with the corpus, is
   written to the shared folder and is never collected. It weighs its trees and sends the
   sums of its shallowest nodes up.
3. middle shards, by two latest bytes (at most 2 ** 16 grams share them), weigh the levels
   up to two bytes in the same way.
4. the two shallowest levels (at most 256 * 255 nodes, whatever the corpus) go through the
   driver, which sends their shares back; the middle shards answer the deep ones, these
   answer the blocks' requests with the costs of their grams, and texts and answers meet.

The number of shards grows with the root of the number of blocks and has no bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, released, small, text_of

DEPTH = 6
ROUTE = 4
END = 0  # the byte that ends a text and pads the context before it
NODES = 256
_WORD = np.uint64(1 << 63)  # sets words apart from grams
_ZSTD = pa.Codec("zstd", 1)


# ---- packing ---------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """64-bit integers, byte by byte and compressed."""
    return _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def _from_planes(raw: bytes, n: int, kind: type) -> np.ndarray:
    flat = np.frombuffer(_ZSTD.decompress(raw, decompressed_size=8 * n, asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view(kind).ravel()


def pack(*parts: bytes) -> bytes:
    return b"".join([len(p).to_bytes(8, "little") + p for p in parts])


def unpack(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and their 64-bit counts."""
    return pack(len(keys).to_bytes(8, "little"), _planes(np.diff(keys, prepend=np.uint64(0))), _planes(counts.astype(np.int64)))


def unpack_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, gaps, counts = unpack(raw)
    n = int.from_bytes(size, "little")
    return np.cumsum(_from_planes(gaps, n, np.uint64), dtype=np.uint64), _from_planes(counts, n, np.int64)


def pack_floats(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), asbytes=True)


def unpack_floats(raw: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=n * width, asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def _dealt(routes: np.ndarray, shards: int) -> np.ndarray:
    return (((routes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)


def shard_of(keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """Grams by their latest context bytes, words by their hash."""
    late = keys >> np.uint64(8 + 8 * (depth - min(ROUTE, depth)))
    return _dealt(np.where(keys >= _WORD, keys, late), shards)


def middle_of(keys: np.ndarray, depth: int, middles: int) -> np.ndarray:
    """Middle shard of grams of ``depth``, by their two latest context bytes."""
    return _dealt(keys >> np.uint64(8 + 8 * (depth - 2)), middles)


class Tally:
    """Counts of keys, merged whenever the unmerged part has outgrown the merged one."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((keys, counts))
        self.held += len(keys)
        if self.held > max(500_000, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.more:
            keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
            counts = np.concatenate([self.counts, *(c for _, c in self.more)])
            self.more, self.held = [], 0
            order = np.argsort(keys, kind="stable")  # of sorted runs
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(_changes(keys))
            self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        return self.keys, self.counts


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


# ---- one block of documents -------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    """Words and then one end, which counts as a token and has the empty word's key."""
    words = text.split()
    words.append(b"")
    return words


def word_keys(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in words), np.uint64, len(words)) | _WORD


class Joined:
    """Texts end to end, each behind ``depth`` zero bytes; the first byte behind a text is its end."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth = depth
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = np.frombuffer(bytes(8) + bytes(depth).join(texts) + bytes(depth), np.uint8)
        self.starts = 8 + np.cumsum(self.sizes + depth) - self.sizes - depth

    def slices(self, most: int, docs: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end text, gram of each byte and end, number of them per text), a long text in several slices.

        A gram has the latest context byte first and the byte itself last.
        """
        ends = self.starts + self.sizes + 1
        at, stop = 8, int(ends[-1]) if len(ends) else 8
        while at < stop:
            first = int(np.searchsorted(ends, at, "right"))
            at = max(at, int(self.starts[first]))
            to = min(at + most, stop)
            if docs is not None and first + docs < len(ends):
                to = min(to, int(self.starts[first + docs]))
            last = int(np.searchsorted(self.starts, to, "left"))
            window = np.ndarray((to - at,), "<u8", self.raw, at - 7, (1,))
            shift = np.uint64(56 - 8 * self.depth)
            keys = ((window & np.uint64((1 << 56) - 1)) >> shift << np.uint64(8)) | window >> np.uint64(56)
            gaps = (ends[first:last, None] + np.arange(self.depth - 1)).ravel() - at
            valid = np.ones(len(keys), bool)
            valid[gaps[gaps < len(keys)]] = False
            counts = np.minimum(ends[first:last], to) - np.maximum(self.starts[first:last], at)
            yield first, last, keys[valid], counts
            at = to


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    starts = np.flatnonzero(_changes(keys))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def block_keys(texts: list[bytes], learn: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys of a block, sorted, with their counts in the texts to learn from (0 for others)."""
    tally = Tally()
    for taught in (True, False):
        some = [t for t, x in zip(texts, learn) if x is taught]
        for _, _, grams, _ in Joined(some, depth).slices(1 << 21):
            keys, counts = _distinct(grams)
            tally.add(keys, counts if taught else np.zeros(len(keys), np.int64))
        seen: Counter = Counter()
        for t in some:
            seen.update(words_of(t))
        if seen:
            keys = word_keys(seen)
            order = np.argsort(keys)
            counts = np.fromiter(seen.values(), np.int64, len(seen)) if taught else np.zeros(len(seen), np.int64)
            tally.add(keys[order], counts[order])
    return tally.settle()


def block_costs(texts: list[bytes], grams: np.ndarray, costs: np.ndarray, words: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: log10 probability, tokens, known tokens, sum of log10(count + 1)."""
    n = len(texts)
    score, tokens, known, base = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for first, last, keys, sizes in Joined(texts, depth).slices(1 << 20, 256):
        packed = keys << np.uint64(8) | np.repeat(np.arange(last - first, dtype=np.uint64), sizes)
        packed.sort()
        of, doc = packed >> np.uint64(8), (packed & np.uint64(255)).astype(np.int64)
        starts = np.flatnonzero(_changes(of))
        cost = np.repeat(costs[np.searchsorted(grams, of[starts])].astype(np.float64), np.diff(np.append(starts, len(of))))
        score[first:last] += np.bincount(doc, weights=cost, minlength=last - first)
    place: dict[bytes, int] = {}
    numbers = []
    for t in texts:
        own = words_of(t)
        numbers.append(np.fromiter((place.setdefault(w, len(place)) for w in own), np.int32, len(own)))
    count = counts[np.searchsorted(words, word_keys(place))]
    logs, seen = np.log10(count.astype(np.float64) + 1), count > 0
    for k, at in enumerate(numbers):
        tokens[k], known[k] = len(at), np.count_nonzero(seen[at])
        base[k] = math.fsum(logs[at]) if len(at) < 64 else logs[at].sum()
    return score, tokens, known, base


# ---- the context tree ---------------------------------------------------------------------

_SMALL = 1024
_LOG_GAMMA_HALF = np.cumsum(np.log(np.r_[math.sqrt(math.pi), np.arange(_SMALL) + 0.5]))
_LOG_FACTORIAL = np.cumsum(np.log(np.r_[1.0, np.arange(1, _SMALL + 1)]))


def _stirling(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """log Gamma(n + plus) for whole n >= 0: a table for small n and Stirling's series beyond."""
    out = table[np.minimum(n, _SMALL).astype(np.int64)]
    big = np.flatnonzero(n > _SMALL)
    if len(big):
        x = n[big] + plus
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of these counts."""
    return _stirling(zeros, _LOG_GAMMA_HALF, 0.5) + _stirling(ones, _LOG_GAMMA_HALF, 0.5) - math.log(math.pi) - _stirling(zeros + ones, _LOG_FACTORIAL, 1.0)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log((e^a + e^b) / 2)"""
    return np.logaddexp(a, b) - math.log(2)


class Level:
    """Nodes of one depth over its sorted distinct grams. A node is a run of grams with one context and the same first bits.

    A node without counts gives one half to either outcome and has log P_w = 0, so grams
    that were only asked for change nothing.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.first: list[np.ndarray] = []  # by bit: each node's first gram
        self.node: list[np.ndarray] = []  # by bit: each gram's node
        for bit in range(8):
            change = _changes(keys >> np.uint64(8 - bit))
            self.first.append(np.flatnonzero(change))
            self.node.append(np.cumsum(change, dtype=np.int32) - np.int32(1))

    def outcome(self, bit: int) -> np.ndarray:
        return (self.keys >> np.uint64(7 - bit)) & np.uint64(1) == 1

    def sums(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(zeros, ones) by node."""
        every = np.add.reduceat(self.counts, self.first[bit])
        ones = np.add.reduceat(np.where(self.outcome(bit), self.counts, 0.0), self.first[bit])
        return every - ones, ones

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """below: by bit and node, the sum of the children's log P_w (none at the greatest depth).

        Sets log_w by bit and node, and by bit and gram the share of the own estimate and
        that estimate of the gram's own outcome.
        """
        n = len(self.keys)
        self.log_w, self.share, self.own = [], np.empty((8, n), np.float32), np.empty((8, n), np.float32)
        for bit in range(8):
            zeros, ones = self.sums(bit)
            log_e = kt_log(zeros, ones)
            log_w = log_e if below is None else _half(log_e, below[bit])
            self.log_w.append(log_w)
            node = self.node[bit]
            self.share[bit] = 1.0 if below is None else np.exp(np.minimum(log_e - log_w - math.log(2), 0)).astype(np.float32)[node]
            every = zeros + ones + 1
            self.own[bit] = np.where(self.outcome(bit), ((ones + 0.5) / every)[node], ((zeros + 0.5) / every)[node])

    def shorter(self) -> tuple[Level, np.ndarray, list[np.ndarray]]:
        """The level above (contexts without their oldest byte), each gram's place there, and what its nodes get from below."""
        keys = (self.keys >> np.uint64(16)) << np.uint64(8) | self.keys & np.uint64(255)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        change = _changes(keys)
        place = np.empty(len(keys), np.int32)
        place[order] = np.cumsum(change, dtype=np.int32) - np.int32(1)
        above = Level(keys[change], np.bincount(place, weights=self.counts, minlength=int(change.sum())))
        return above, place, self.sent(above, place)

    def sent(self, above: Level, place: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(above.node[bit][place[self.first[bit]]], weights=self.log_w[bit], minlength=len(above.first[bit])) for bit in range(8)]

    def mixed(self, bit: int, p: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The estimates so far, and what is left for deeper levels, with this level's added."""
        w = self.share[bit]
        return p + rest * w * self.own[bit], rest * (1 - w)


def tree(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> tuple[list[Level], list[np.ndarray]]:
    """(levels from the deepest to ``least``, each gram's place in the next)."""
    levels, places, below = [Level(keys, counts.astype(np.float64))], [], None
    for _ in range(depth - least):
        levels[-1].weigh(below)
        above, place, below = levels[-1].shorter()
        levels.append(above)
        places.append(place)
    levels[-1].weigh(below)
    return levels, places


def descended(levels: list[Level], places: list[np.ndarray], bit: int, p: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, rest) of the deepest level's grams from those that its shallowest level's grams start with."""
    p, rest = levels[-1].mixed(bit, p, rest)
    for level, place in zip(reversed(levels[:-1]), reversed(places)):
        p, rest = level.mixed(bit, p[place], rest[place])
    return p, rest


def top(rows: list[tuple[int, float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(share, estimate of a one) of the nodes at depths 0 and 1, as [depth 0: 256, depth 1: 256 * 256].

    rows: (context byte << 8 | node, zeros, ones, sum of the log P_w at depth 2 below it).
    """
    ids = np.array([r[0] for r in rows], np.int64)
    zeros, ones, below = (np.array([r[k] for r in rows], np.float64) for k in (1, 2, 3))
    share, one = np.ones(NODES + NODES * NODES), np.full(NODES + NODES * NODES, 0.5)
    log_e = kt_log(zeros, ones)
    log_w = _half(log_e, below)
    share[NODES + ids] = np.exp(np.minimum(log_e - log_w - math.log(2), 0))
    one[NODES + ids] = (ones + 0.5) / (zeros + ones + 1)
    z0, o0, w0 = (np.bincount(ids & 255, weights=x, minlength=NODES) for x in (zeros, ones, log_w))
    e0 = kt_log(z0, o0)
    share[:NODES] = np.exp(np.minimum(e0 - _half(e0, w0) - math.log(2), 0))
    one[:NODES] = (o0 + 0.5) / (z0 + o0 + 1)
    return share, one


def started(keys: np.ndarray, depth: int, shallow: tuple[np.ndarray, np.ndarray], bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, rest) of grams after the two shallowest levels."""
    byte = keys & np.uint64(255)
    node = ((np.uint64(256) | byte) >> np.uint64(8 - bit)).astype(np.int64)
    one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
    latest = (keys >> np.uint64(8 * depth)).astype(np.int64)
    p, rest = np.zeros(len(keys)), np.ones(len(keys))
    for index in (node, NODES + latest * NODES + node):
        w, q = shallow[0][index], shallow[1][index]
        p, rest = p + rest * w * np.where(one, q, 1 - q), rest * (1 - w)
    return p, rest


# ---- Spark ----------------------------------------------------------------------------------


def _lowered(column: pa.ChunkedArray) -> list[bytes]:
    return [t.lower() for t in column.cast(pa.binary()).to_pylist()]


def _requests(depth: int, shards: int):
    def run(key, table):
        pid = key[0].as_py()
        keys, counts = block_keys(_lowered(table.column("text")), table.column("learn").to_pylist(), depth)
        route = shard_of(keys, depth, shards)
        order = np.argsort(route, kind="stable")
        ends = np.searchsorted(route[order], np.arange(shards + 1))
        rows = [(s, pack_keys(keys[order[a:b]], counts[order[a:b]])) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
        out = pa.table({"pid": pa.array([pid] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})
        give_back()
        return out

    return run


def _by_shard(batches, column: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with one shard, each run as an iterator that is to be used up."""
    rows = (r for batch in small(batches, 64) for r in zip(*(c.to_pylist() for c in batch.columns)))
    held = next(rows, None)

    def run(shard):
        nonlocal held
        while held is not None and held[column] == shard:
            yield held
            held = next(rows, None)

    while held is not None:
        yield held[column], run(held[column])


def _up(level: Level, below: list[np.ndarray], depth: int, middles: int) -> Iterator[tuple[int, bytes]]:
    """(middle shard, packed grams of ``level`` with what their nodes get from below)."""
    route = middle_of(level.keys, depth, middles)
    for m in np.unique(route).tolist():
        own = np.flatnonzero(route == m)
        part = Level(level.keys[own], level.counts[own])
        sums = [below[bit][level.node[bit][own[part.first[bit]]]] for bit in range(8)]
        yield m, pack(pack_keys(part.keys, part.counts.astype(np.int64)), pack_floats(np.concatenate(sums)))


_LEARNED = "shard long, middle long, packed binary, n long, v long"


def _learned(depth: int, middles: int):
    """Rows come sorted by shard: one tally at a time, then its model and what goes up from its trees."""

    def run(batches):
        for shard, rows in _by_shard(batches):
            tally = Tally()
            for _, raw in rows:
                tally.add(*unpack_keys(raw))
            keys, counts = tally.settle()
            split = int(np.searchsorted(keys, _WORD))
            words = counts[split:]
            out = [(shard, None, pack_keys(keys, counts), int(words.sum()), int(np.count_nonzero(words)))]
            del tally
            if split:
                levels, _ = tree(keys[:split], counts[:split], depth, min(ROUTE, depth))
                above, _, below = levels[-1].shorter()
                out += [(shard, m, raw, 0, 0) for m, raw in _up(above, below, min(ROUTE, depth) - 1, middles)]
                del levels, above, below
            yield _batch(out, _LEARNED)

    return run


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


class Middle:
    """The levels ``depth`` .. 2 over what a middle shard was sent."""

    def __init__(self, messages: list[bytes], depth: int):
        sent = [unpack(raw) for raw in messages]
        tally = Tally()
        for packed, _ in sent:
            tally.add(*unpack_keys(packed))
        keys, counts = tally.settle()
        self.levels, self.places = [Level(keys, counts.astype(np.float64))], []
        deep = self.levels[0]
        below = [np.zeros(len(f)) for f in deep.first]
        for packed, sums in sent:
            own, _ = unpack_keys(packed)
            part, at = Level(own, np.zeros(len(own))), np.searchsorted(keys, own)
            sizes = np.cumsum([len(f) for f in part.first])
            for bit, x in enumerate(np.split(unpack_floats(sums, np.float64), sizes[:-1])):
                below[bit] += np.bincount(deep.node[bit][at[part.first[bit]]], weights=x, minlength=len(below[bit]))
        for _ in range(depth - 2):
            self.levels[-1].weigh(below)
            above, place, below = self.levels[-1].shorter()
            self.levels.append(above)
            self.places.append(place)
        self.levels[-1].weigh(below)

    def up(self) -> list[tuple[int, float, float, float]]:
        """Rows for ``top``, from the nodes of depth 2."""
        two = self.levels[-1]
        found: list[tuple] = []
        for bit in range(8):
            zeros, ones = two.sums(bit)
            first = two.keys[two.first[bit]]
            ids = ((first >> np.uint64(16)) << np.uint64(8) | (np.uint64(256) | first & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)
            own, at = np.unique(ids, return_inverse=True)
            found += zip(own.tolist(), *(np.bincount(at, weights=x, minlength=len(own)).tolist() for x in (zeros, ones, two.log_w[bit])))
        return found

    def down(self, depth: int, shallow) -> np.ndarray:
        """By bit, then p and rest, of every gram."""
        two, out = self.levels[-1], np.empty((8, 2, len(self.levels[0].keys)), np.float32)
        for bit in range(8):
            out[bit] = descended(self.levels, self.places, bit, *started(two.keys, 2, shallow, bit))
        return out


def _tops(depth: int):
    def run(batches):
        for _, rows in _by_shard(batches):
            found = Middle([raw for _, raw in rows], depth).up()
            yield _batch(found, "node long, zeros double, ones double, below double")

    return run


def _downs(depth: int, shallow):
    def run(batches):
        for middle, rows in _by_shard(batches):
            rows = list(rows)
            tier = Middle([raw for _, raw, _ in rows], depth)
            values = tier.down(depth, shallow)
            for _, raw, shard in rows:
                keys, _ = unpack_keys(unpack(raw)[0])
                yield _batch([(shard, middle, pack_floats(values[:, :, np.searchsorted(tier.levels[0].keys, keys)].ravel()))], "shard long, middle long, packed binary")
            del tier, values

    return run


def _model(packed: bytes, downs: list[tuple[int, bytes]], depth: int, middles: int, shallow) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, their costs, word keys, their counts) of a deep shard."""
    keys, counts = unpack_keys(packed)
    split = int(np.searchsorted(keys, _WORD))
    costs = np.zeros(split, np.float32)
    if split:
        route = min(ROUTE, depth)
        levels, places = tree(keys[:split], counts[:split], depth, route)
        above, place, _ = levels[-1].shorter()
        if route > 2:
            start = np.empty((8, 2, len(above.keys)), np.float32)
            of = middle_of(above.keys, route - 1, middles)
            for m, raw in downs:
                own = np.flatnonzero(of == m)
                start[:, :, own] = unpack_floats(raw, np.float32).reshape(8, 2, len(own))
        for bit in range(8):
            p, rest = start[bit].astype(np.float64)
            costs += np.log10(descended(levels, places, bit, p[place], rest[place])[0]).astype(np.float32)
    return keys[:split], costs, keys[split:], counts[split:]


_ANSWERED = "pid long, shard long, packed binary"


def _answers(depth: int, middles: int, shallow):
    """Of a shard's rows its model comes first, then what came down to it, then its requests, each answered by itself."""

    def run(batches):
        for shard, rows in _by_shard(batches):
            model, downs, known = None, [], None
            for _, kind, number, raw in rows:
                if kind == 0:
                    model = raw
                elif kind == 1:
                    downs.append((number, raw))
                else:
                    if known is None:
                        known, downs = _model(model, downs, depth, middles, shallow), []
                    keys, _ = unpack_keys(raw)
                    split = int(np.searchsorted(keys, _WORD))
                    cost = known[1][np.searchsorted(known[0], keys[:split])]
                    count = known[3][np.searchsorted(known[2], keys[split:])]
                    yield _batch([(number, shard, pack(pack_floats(cost), pack_floats(count)))], _ANSWERED)
            known = None

    return run


def _scores(depth: int, shards: int):
    def run(key, docs, answers):
        texts, learn = _lowered(docs.column("text")), docs.column("learn").to_pylist()
        keys, _ = block_keys(texts, learn, depth)
        split = int(np.searchsorted(keys, _WORD))
        route = shard_of(keys, depth, shards)
        costs, counts = np.empty(split, np.float32), np.empty(len(keys) - split, np.int64)
        order = np.argsort(route, kind="stable")
        ends = np.searchsorted(route[order], np.arange(shards + 1))
        for shard, raw in zip(answers.column("shard").to_pylist(), answers.column("packed").to_pylist()):
            own = order[ends[shard] : ends[shard + 1]]
            cost, count = unpack(raw)
            costs[own[own < split]] = unpack_floats(cost, np.float32)
            counts[own[own >= split] - split] = unpack_floats(count, np.int64)
        score, tokens, known, base = block_costs(texts, keys[:split], costs, keys[split:], counts, depth)
        n_bytes = pa.array([len(t) for t in texts], pa.int64())
        out = pa.table({"id": docs.column("id"), "learn": docs.column("learn"), "n_bytes": n_bytes, "n_tokens": tokens, "n_known": known, "base": base, "score": score})
        del texts, keys, order, route, costs, counts
        give_back()
        return out

    return run


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = 12 << 20) -> DataFrame:
    """Score every whole text by the model of the texts for which ``learn`` is true.

    Returns one row per input row: id, learn, n_bytes (of the lower-cased text), n_tokens,
    n_known, train_tokens, base_score (add-one unigram words), score (log10 probability of
    the text's bytes and its end), bits_per_byte (code length). Null texts count as empty:
    their only token is the end. Ids of any type are given as they are; null ids stay
    (hashed as null); repeated rows stay; with nothing to learn from, every binary decision
    costs one bit; an empty table gives none; other columns are ignored. A text is
    held whole by one task, its grams a slice at a time.
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6: a gram and a number up to 256 share 64 bits")
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    shards = max(4, math.ceil(10 * math.sqrt(blocks)))
    middles = max(2, math.ceil(shards**0.75))
    route = min(ROUTE, depth)
    dealt = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("pid"), "id", "text", "learn").repartition(blocks, "pid")
    requests = cut(dealt.groupBy("pid").applyInArrow(_requests(depth, shards), "pid long, shard long, keys binary"), "requests")
    by_shard = requests.select("shard", "keys").repartition(shards, "shard").sortWithinPartitions("shard")
    learned = cut(by_shard.mapInArrow(released(_learned(depth, middles)), _LEARNED), "model")
    ups = learned.where("middle is not null")
    by_middle = ups.select("middle", "packed", "shard").repartition(middles, "middle").sortWithinPartitions("middle")
    tops = by_middle.select("middle", "packed").mapInArrow(released(_tops(route - 1)), "node long, zeros double, ones double, below double")
    sums = tops.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).collect()
    totals = learned.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)
    shallow = top(sorted(tuple(r) for r in sums))
    downs = by_middle.mapInArrow(released(_downs(route - 1, shallow)), "shard long, middle long, packed binary")
    asked = (
        learned.where("middle is null").select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("number"), "packed")
        .unionByName(downs.select("shard", F.lit(1).alias("kind"), F.col("middle").alias("number"), "packed"))
        .unionByName(requests.select("shard", F.lit(2).alias("kind"), F.col("pid").alias("number"), F.col("keys").alias("packed")))
    )
    answered = asked.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(released(_answers(depth, middles, shallow)), _ANSWERED)
    scored = dealt.groupBy("pid").cogroup(answered.groupBy("pid")).applyInArrow(_scores(depth, shards), f"id {df.schema[id_col].dataType.simpleString()}, learn boolean, n_bytes long, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.select("id", "learn", "n_bytes", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
