"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

A document's fingerprint is the per-bit majority of the XXH64 hashes of its word
shingles. Fingerprints are cut into a ring of m segments. If two of them differ in at
most t bits, some segment starts a chain of consecutive segments whose running
differences never exceed length * t / m. With m = t + 1 the first segment of that chain
is equal, the first two differ in one bit at most, the first three in two.

The chain is in the join: rows are dealt by its start and the content of its first
segments, once as they are and once for each set of bits that the budgets allow to
differ, cleared; two fingerprints meet at the content that they have in common. Chains
of two segments (26 key bits, some 37 rows a fingerprint) are keys up to 2 ** 26
fingerprints, beyond that chains of three (39 bits). Pairs that meet are held against
the budgets of the longer prefixes, one by one, before the full Hamming check.

Equal fingerprints are one vertex. Hot keys are split into bounded cells; a cell
answers with a spanning forest of the links that it found, never with all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_number, by_sort, cut, deal_into_cells, parts, released, scratch, small, text_of, unused, whole_cells, whole_numbers
from .components import components

BITS = 64


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> bytes:
    """8 bytes, big-endian; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return majority(np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8))


def majority(raw: np.ndarray) -> bytes:
    """The bits that more than half of the big-endian hashes have; zero for no hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[start : start + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(raw)).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row per input row, fp the fingerprint as a signed long."""

    def run(batches):
        for batch in small(batches):
            prints = b"".join(fingerprint(t, width, seed) for t in batch.column(1).to_pylist())
            values = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values, pa.int64())], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(released(run), "id long, fp long")


def ring(m: int) -> list[int]:
    """Bit borders of the m segments, as equal as they can be."""
    return [round(k * BITS / m) for k in range(m + 1)]


def _mask(lo: int, hi: int) -> int:
    return ((1 << (hi - lo)) - 1) << lo


def chains(t: int) -> list[list[tuple[int, int]]]:
    """For each of the t + 1 starts the (mask of the first l segments, budget) pairs, l = 1 .. t + 1."""
    m = t + 1
    border = ring(m)
    out = []
    for start in range(m):
        mask, steps = 0, []
        for length in range(1, m + 1):
            k = (start + length - 1) % m
            mask |= _mask(border[k], border[k + 1])
            steps.append((mask, length * t // m))
        out.append(steps)
    return out


def key_length(n: int) -> int:
    """Segments of a chain that are a key for n fingerprints."""
    return 2 if n <= 1 << 26 else 3


def chain_keys(start: int, t: int, length: int) -> list[tuple[int, int]]:
    """(mask of the key's segments, bits to clear) for every set of bits that the budgets of ``length`` segments allow to differ."""
    steps = chains(t)[start][:length]
    sets = [0]
    inner = 0
    for mask, budget in steps:
        bits = [1 << k for k in range(BITS) if (mask & ~inner) >> k & 1]
        inner = mask
        grown = sets
        for _ in range(budget):
            grown = sorted({s | bit for s in grown for bit in bits} | set(grown))
            grown = [s for s in grown if s.bit_count() <= budget]
        sets = grown
    return [(steps[-1][0], s) for s in sets]


def follows(diff: np.ndarray, start: np.ndarray, t: int) -> tuple[np.ndarray, list[int]]:
    """Which XOR values keep the budgets of the chain from their start, and how many were left after each length."""
    steps = chains(t)
    masks = np.array([[mask for mask, _ in chain] for chain in steps], np.uint64)
    rest, left = np.arange(len(diff)), []
    for length in range(t + 1):
        rest = rest[np.bitwise_count(diff[rest] & masks[start[rest], length]) <= steps[0][length][1]]
        left.append(len(rest))
    return rest, left


def _forest(fps: np.ndarray, ids: np.ndarray, start: int, t: int):
    """Edges of a spanning forest of the links among one cell's fingerprints."""
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near, _ = follows(fps[left] ^ fps[at], np.full(len(left), start), t)
            for k in left[near]:
                yield ids[at], ids[k]
            queue.extend(left[near])
            left = np.delete(left, near)


def _cell_links(t: int):
    """Rows come sorted by cell."""

    def run(batches):
        for table in whole_cells(batches):
            cell, tab, fp, rep = (table.column(k).to_numpy() for k in range(4))
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            out: list[tuple[np.ndarray, np.ndarray]] = []
            few = np.repeat(sizes <= 16, sizes)
            for step in range(1, 16):
                here = np.flatnonzero(few[:-step] & (cell[step:] == cell[:-step])) if len(cell) > step else np.empty(0, int)
                if not len(here):
                    break
                here = here[follows(fp[here] ^ fp[here + step], tab[here], t)[0]]
                out.append((rep[here], rep[here + step]))
            for s, n in zip(starts[sizes > 16], sizes[sizes > 16]):
                pairs = list(_forest(fp[s : s + n], rep[s : s + n], int(tab[s]), t))
                if pairs:
                    out.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
            for a, b in out:
                different = a != b
                if different.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[different], pa.int64()), pa.array(b[different], pa.int64())], ["a", "b"])

    return run


def links(reps: DataFrame, t: int = 4, cell_rows: int = 2048, length: int | None = None) -> DataFrame:
    """(a, b): links that connect the representatives (rep, fp) whose fingerprints differ in at most t bits.

    A set of bits is cleared only where the fingerprint has them all: of two fingerprints
    each clears what it has and the other lacks, and they meet at their common content.
    """
    length = length or key_length(reps.count())
    keys = []
    for start in range(t + 1):
        for mask, clear in chain_keys(start, t, length):
            has = F.col("fp").bitwiseAND(F.lit(_signed(clear))) == F.lit(_signed(clear)) if clear else F.lit(True)
            keys.append(F.when(has, F.struct(F.lit(start).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(mask & ~clear))).alias("key"))))
    rows = reps.select("rep", "fp", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("rep", "fp", "k.tab", "k.key")
    cells = deal_into_cells(rows, ["tab", "key"], "fp", cell_rows)
    dealt = cells.select("cell", "tab", "fp", "rep").repartition(parts(reps), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(released(_cell_links(t)), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 4, width: int = 4) -> DataFrame:
    """(id, fp, component): one row per input row.

    component is the smallest id reachable over links of at most t differing bits. The
    shingles have four words, as the fingerprint's contract says; ``keep_one`` goes by
    five-word shingles, in which its similarity is measured. Ids that
    are not whole numbers are numbered in their order. Rows with a null id are
    fingerprinted but join no group (component null); null and empty texts have fingerprint
    zero and link like any other; rows that share an id are one vertex; an empty table
    gives an empty result; other columns are ignored.
    """
    if not whole_numbers(df, id_col):
        return by_number(df, id_col, lambda numbered: near_duplicates(numbered, "number", text_col, t, width))
    prints = cut(fingerprints(df, id_col, text_col, width), "fingerprints")
    reps = cut(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    # an id that occurs with several texts ties its fingerprints together
    ids = prints.where("id is not null").join(by_sort(reps), "fp").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    found = components(links(reps, t).unionByName(ids))
    classes = reps.join(by_sort(found), reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = prints.join(by_sort(classes), "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; a text of at most ``width`` words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(g), seed) for g in zip(*(words[k:] for k in range(width)))), np.uint64, len(words) - width + 1))


def _prefix_size(n: int, threshold: float) -> int:
    """Two sets of similarity ``threshold`` or more share one of their first so many members in any common order."""
    return n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0


def _common(df: DataFrame, id_col: str, text_col: str, width: int, docs: int = 8000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that occur in several of a sample of texts; they only set the order of prefixes, not what is found."""
    every = max(1, df.count() // docs)

    def run(batches):
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, width).view(np.int64))], ["h"])

    sample = df.where(F.pmod(F.xxhash64(F.lit(3), id_col, text_col), F.lit(every)) == 0).select(text_of(text_col).alias("text"))
    counted = cut(sample.mapInArrow(released(run), "h long").groupBy("h").count().where("count > 1"), "common")
    rows = commonest(counted, most).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows (h, count) of the highest counts, about ``most`` if there are more; of the last count's rows those with the lowest h.

    Sorting with a limit would send the driver so many rows of every partition. It gets a
    row for each distinct count instead, no more than there are texts in the sample.
    """
    room = most
    for level in counted.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():
        if level["n"] > room:  # hashes are even, so a share of their range holds that share of the rows
            end = room * 2**64 // level["n"] - 2**63
            return counted.where((F.col("count") > level["count"]) | ((F.col("count") == level["count"]) & (F.col("h") < end)))
        room -= level["n"]
    return counted


def _prefixes(df: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """(id, sig, mark, size, fp, prefix, few, members): of each text's set of shingles two names, its size and SimHash, its rarest members, a sample, and all (32 bits each)."""
    hashes, counts = _common(df, id_col, text_col, width)
    names = ["id", "sig", "mark", "size", "fp", "prefix", "few", "members"]

    def run(batches):
        for batch in small(batches):
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                h = shingles(text, width)
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                often = np.where(hashes[at] == h, counts[at], 0) if len(hashes) else np.zeros(len(h), np.int64)
                first = np.lexsort((h, often))[: _prefix_size(len(h), threshold)]
                raw = h.tobytes()
                print_ = int.from_bytes(majority(h.astype(">u8").view(np.uint8).reshape(-1, 8)), "big", signed=True)
                short = (h[first] & np.uint64(2**40 - 1)).view(np.int64)  # a collision only adds a candidate
                for column, value in zip(out, (xxhash.xxh3_128_digest(raw), xxhash.xxh3_64_intdigest(raw) >> 1, len(h), print_, short, sample((h >> np.uint64(32)).astype("<u4")).tobytes(), (h >> np.uint64(32)).astype("<u4").tobytes())):
                    column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    return df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(released(run), "id long, sig binary, mark long, size int, fp long, prefix array<long>, few binary, members binary")


def depth_of(size: int) -> int:
    """How often a set is halved by its members' hashes to leave a sample of 64 to 128, about."""
    return max(0, int(np.log2(max(size, 1) / 64)))


def sample(members: np.ndarray) -> np.ndarray:
    """Sorted members below a bound; a larger set's sample is nested in a smaller's way of sampling."""
    return members[: np.searchsorted(members, np.uint64(1 << 32) >> np.uint64(depth_of(len(members))))]


def maybe_alike(few: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs' sizes and samples allow the threshold: a sample must miss it by 0.3, some six deviations, to rule a pair out."""
    depth = np.array([depth_of(int(n)) for n in sizes])
    inner = overlaps(few)
    counts = np.array([np.searchsorted(x, [np.uint64(1 << 32) >> np.uint64(k) for k in range(depth.max() + 1)]) for x in few])
    deep = np.maximum(depth[:, None], depth)
    own = counts[np.arange(len(few))[:, None], deep]
    both = own + own.T - inner
    low, high = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    return (low >= threshold * high - 1e-6) & (inner >= (threshold - 0.3) * both - 1e-6)


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many members each two of the sets share."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    shared = (np.bincount(number) > 1)[number] if len(flat) else new
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    every = int(number[-1]) + 1 if len(number) else 0
    for lo in range(0, every, columns):
        here = slice(*np.searchsorted(number, [lo, lo + columns]))
        m = np.zeros((len(sets), min(columns, every - lo)), np.float32)
        m[owner[here], number[here] - lo] = 1
        out += m @ m.T
    return out


def _cells_of(batches, rows: int):
    """(first row, end, columns) of each cell of several groups; rows come sorted by cell, with a group in the third column."""
    for table in whole_cells(small(batches), rows):
        cell, group = table.column(0).to_numpy(), table.column(2).to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        spans = [(lo, hi) for lo, hi in zip(starts, np.r_[starts[1:], len(cell)]) if hi - lo > 1 and not (group[lo:hi] == group[lo]).all()]
        yield table, spans


def _asked(threshold: float):
    """(block, rep): the members of each cell that may be like one of another group, by sizes and samples."""

    def run(batches):
        for table, spans in _cells_of(batches, 1 << 14):
            rep, group, size, block = (table.column(k).to_numpy() for k in (1, 2, 3, 4))
            few = table.column(5).to_pylist()
            kept = []
            for lo, hi in spans:
                near = maybe_alike([np.frombuffer(x, "<u4") for x in few[lo:hi]], size[lo:hi].astype(np.int64), threshold)
                near &= group[lo:hi, None] != group[lo:hi]
                kept.append(lo + np.flatnonzero(near.any(axis=1)))
            if kept:
                at = np.concatenate(kept)
                yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int64()), pa.array(rep[at], pa.int64()), pa.array(group[at], pa.int64()), pa.array(size[at], pa.int32())], ["block", "rep", "group", "size"])

    return run


def _alike(threshold: float):
    """A forest of the links among each cell's members."""

    def run(batches):
        for table, spans in _cells_of(batches, 2048):
            rep, members = table.column(1).to_numpy(), table.column(3).to_pylist()
            tails, heads = [], []
            for lo, hi in spans:
                sets = [np.frombuffer(x, "<u4") for x in members[lo:hi]]
                sizes = np.array([len(x) for x in sets])
                inner = overlaps(sets)
                near = inner >= threshold * (sizes[:, None] + sizes - inner) - 1e-6
                left = np.arange(hi - lo)
                while len(left) > 1:
                    front, left = left[:1], left[1:]
                    while len(front) and len(left):
                        one, front = front[0], front[1:]
                        hit = near[one, left]
                        tails.append(np.full(int(hit.sum()), rep[lo + one]))
                        heads.append(rep[lo + left[hit]])
                        front, left = np.concatenate([front, left[hit]]), left[~hit]
            if tails:
                a, b = np.concatenate(tails), np.concatenate(heads)
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], ["a", "b"])

    return run


def _linked(blocks: DataFrame, rows: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """(a, b): links that connect the members (block, rep, group, size) whose sets reach the threshold.

    Samples of the sets are sent to the blocks first; whole sets only of members that these
    leave some partner.
    """

    def met(those: DataFrame, column: str, *more: str) -> DataFrame:
        cells = deal_into_cells(those, ["block"], "rep", cell_rows).select("cell", "rep", "group", "size", *more)
        found = cells.join(by_sort(rows.select(F.col("id").alias("rep"), "size", column)), ["rep", "size"])
        return found.repartition(parts(blocks), "cell").sortWithinPartitions("cell")

    few = met(blocks, "few", "block").select("cell", "rep", "group", "size", "block", "few")
    asked = cut(few.mapInArrow(released(_asked(threshold)), "block long, rep long, group long, size int").distinct(), "asked")
    whole = met(asked, "members").select("cell", "rep", "group", "members")
    return cut(whole.mapInArrow(released(_alike(threshold)), "a long, b long").distinct(), "alike")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, cell_rows: int = 512, t: int = 4) -> DataFrame:
    """(id, component) per row with an id: groups over links of Jaccard similarity ``threshold`` or more of the sets of word shingles.

    Two sets that are so alike share a member of their prefixes (a set's rarest members, one
    more than the threshold allows to differ), so texts meet by the members of prefixes.
    All that meet at some member form a block with the smallest of them, whichever members
    these are, and a text comes into a block once. Blocks are dealt into cells of bounded
    size. Samples of 64 to 128 members are sent there first and rule out members without a
    partner (a pair at the threshold is lost with a chance of about 1e-8); then whole sets
    are held against each other, and a cell answers with a forest of the links found.
    Equal sets are one vertex. SimHash comes first: texts whose
    fingerprints differ in at most ``t`` bits (``links``) are held against each other, and
    a block's cells whose members these have connected already are not looked at again.
    The sets' members are compared by 32 bits. A block of n texts that aren't all connected
    costs n * n / ``cell_rows`` rows. Ids that are not whole numbers are numbered in order.
    """
    if not whole_numbers(df, id_col):
        return by_number(df, id_col, lambda numbered: similar_groups(numbered, "number", text_col, width, threshold, cell_rows, t))
    rows = cut(_prefixes(df, id_col, text_col, width, threshold).where("id is not null"), "prefixes")
    reps = cut(rows.groupBy("sig").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("size").alias("size")), "reps")
    named = cut(rows.select("id", "sig").join(by_sort(reps.select("sig", "rep", "size")), "sig"), "names")
    ids = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    # members that meet: only where sets of different names do
    members = rows.select("id", "mark", F.explode("prefix").alias("key"))
    counted = members.groupBy("key").agg(F.min("id").alias("block"), F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select(F.struct("key").alias("of"), "block")
    met = members.join(by_sort(counted), F.struct("key") == F.col("of")).select("block", "id").distinct()
    # a member of prefixes that the smallest text has is in its every copy's, so blocks are named by representatives
    blocks = cut(met.join(by_sort(named.select("id", "rep", "size")), "id").select("block", "rep", "size").distinct(), "blocks")
    # texts with equal fingerprints, and those that the chains bring together
    prints = reps.groupBy("fp").agg(F.min("rep").alias("rep"))
    equal = reps.join(by_sort(prints.withColumnRenamed("rep", "block")), "fp").select("block", "rep")
    hashed = links(prints, t).select(F.least("a", "b").alias("block"), F.greatest("a", "b").alias("rep"))
    near = equal.unionByName(hashed).where("block <> rep").distinct()
    stars = near.unionByName(near.select("block", F.col("block").alias("rep")).distinct())
    # only what shares a member of its prefix can be alike
    sized = stars.join(by_sort(blocks.select("rep", "size").distinct()), "rep").withColumn("group", F.col("rep"))
    first = _linked(cut(sized, "stars"), rows, threshold, cell_rows)
    groups = cut(components(first), "groups")
    grouped = blocks.join(by_sort(groups), blocks.rep == groups.node, "left").select("block", "rep", "size", F.coalesce("component", "rep").alias("group"))
    mixed = grouped.groupBy("block").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x < y").select(F.struct("block").alias("of"))
    second = _linked(cut(grouped.join(by_sort(mixed), F.struct("block") == F.col("of"), "left_semi"), "mixed"), rows, threshold, cell_rows)
    found = components(first.unionByName(second).unionByName(ids))
    classes = reps.join(by_sort(found), reps.rep == found.node, "left").select("sig", F.coalesce("component", "rep").alias("component"))
    return named.select("id", "sig").join(by_sort(classes), "sig").select("id", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``df`` that stay when each group of near copies (``similar_groups``) keeps its smallest id.

    Rows with a null id stay. Of rows that share the kept id the one stays whose text has
    the smallest hash. All columns of ``df`` are returned.
    """
    kept, place = unused(df, "_kept", "_place")
    with scratch(df.sparkSession) as keep:
        groups = keep(cut(similar_groups(df, id_col, text_col, width, threshold), "near-copies"))
    firsts = groups.where("id = component").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    plain = df.join(by_sort(firsts.where("n = 1").select(F.col("id").alias(kept))), F.col(id_col) == F.col(kept), "left_semi")
    twice = df.join(by_sort(firsts.where("n > 1").select(F.col("id").alias(kept))), F.col(id_col) == F.col(kept), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_of(text_col)))
    once = twice.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return plain.unionByName(once).unionByName(df.where(F.col(id_col).isNull())).select(*df.columns)
