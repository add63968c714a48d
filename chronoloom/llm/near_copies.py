"""Near copies of lyrics: SimHash fingerprints, linked through segment bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .batches import sliced
from .store import written

BITS = 64
SEGMENT = 2  # bits per segment


def simhash(text: str, width: int, block: int = 1 << 16) -> int:
    """64-bit SimHash over hashed word shingles, repeats included; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(width, len(words))
    n = len(words) - size + 1
    hashed = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, block):
        a, b = starts[at : min(at + block, n)].tolist(), ends[at + size - 1 : min(at + block, n) + size - 1].tolist()
        hashes = np.array([hashed(joined[i:j], 42) for i, j in zip(a, b)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(tracks: DataFrame, width: int) -> DataFrame:
    """track_id, print: the SimHash as a signed long."""

    def sketch(batches):
        for batch in sliced(batches):
            prints = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["track_id", "print"])

    rows = tracks.select("track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"))
    kind = rows.schema["track_id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"track_id {kind}, print long")


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """Set bits of each segment: a point whose Manhattan distances never exceed Hamming ones."""
    shifts = np.arange(0, BITS, SEGMENT, dtype=np.uint64)
    parts = prints[:, None] >> shifts & np.uint64((1 << SEGMENT) - 1)
    return np.bitwise_count(parts).astype(np.int64)


def grid_cells(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid cells of each print: cell, index of the print, whether it is a neighbour's cell.

    Segments are split into distance // 2 + 1 groups. Two prints within `distance` have a group in
    which their counts differ by at most 1 in all; so they share that group's cell, or one is in
    the cell one step above the other's. Each print goes to its own cell and to those above.
    """
    counts = segment_counts(prints)
    segments = counts.shape[1]
    groups = np.array_split(np.arange(segments), distance // 2 + 1)
    base = SEGMENT + 1
    cells, owners, above = [], [], []
    for g, group in enumerate(groups):
        powers = base ** np.arange(len(group), dtype=np.int64)
        own = counts[:, group] @ powers * len(groups) + g
        cells.append(own)
        owners.append(np.arange(len(prints)))
        above.append(np.zeros(len(prints), bool))
        for i, segment in enumerate(group):
            fits = np.flatnonzero(counts[:, segment] < SEGMENT)
            cells.append(own[fits] + powers[i] * len(groups))
            owners.append(fits)
            above.append(np.ones(len(fits), bool))
    return np.concatenate(cells), np.concatenate(owners), np.concatenate(above)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, root[a], low)
        np.minimum.at(fresh, root[b], low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def cell_links(cell: np.ndarray, prints: np.ndarray, above: np.ndarray, distance: int, block: int = 1 << 20):
    """Links within cells: own prints against all later rows of the cell, checked exactly.

    Rows come by cell, own prints first. Of the links of a batch a spanning forest is kept: each linked
    print with the first one it reaches.
    """
    n = len(cell)
    last = np.searchsorted(cell, cell, "right")  # end of each row's cell
    rows = np.flatnonzero(~above & (last - np.arange(n) > 1))
    found_a, found_b = [], []
    root = np.arange(n)
    step = 1
    while len(rows):
        rows = rows[rows + step < last[rows]]
        for at in range(0, len(rows), block):
            a = rows[at : at + block]
            b = a + step
            near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
            near &= prints[a] != prints[b]
            found_a.append(a[near])
            found_b.append(b[near])
        step += 1
        if sum(map(len, found_a)) > block:  # keep what the links so far reach, not the links
            root = _joined(root, found_a, found_b)
            found_a, found_b = [], []
    root = _joined(root, found_a, found_b)
    linked = np.flatnonzero(root != np.arange(n))
    return prints[root[linked]], prints[linked]


def _joined(root: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    every = np.arange(len(root))
    return _roots(len(root), np.concatenate([every, *a]), np.concatenate([root, *b]))


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """Adds `pair` to rows (cell, above, print): rows of one cell and pair are compared with each other.

    A cell of more than `most` rows is dealt into blocks of about half of that, by a hash of the print,
    and each two blocks are a pair of their own; so any two rows of a cell meet, and no group is large.
    """
    sizes = rows.groupBy(F.col("cell").alias("hot")).agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > most).select("hot", F.expr(f"(2 * n + {most} - 1) div {most}").alias("blocks"))
    split = rows.join(F.broadcast(hot), F.col("cell") == F.col("hot"), "left")  # one row per hot cell
    pairs = F.expr(
        "CASE WHEN blocks IS NULL THEN array(0L) ELSE transform(filter(sequence(0L, blocks - 1), o -> o <> block), "
        "o -> least(o, block) * blocks + greatest(o, block)) END"
    )
    return split.withColumn("block", F.expr("pmod(xxhash64(print), blocks)")).select(
        "cell", F.explode(pairs).alias("pair"), "above", "print"
    )


def links(prints: DataFrame, distance: int, most: int = 50_000) -> DataFrame:
    """Links a, b between distinct prints (column print) that connect all within `distance`.

    No task compares many more than `most` rows with each other.
    """

    def emit(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 50_000):
                part = own[at : at + 50_000]
                cells, owners, above = grid_cells(part, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(above), pa.array(part[owners].view(np.int64))], ["cell", "above", "print"]
                )

    def compare(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(pair) for pair in zip(held, now)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            whole = int(last.argmax())  # the last group may go on
            yield _linked([h[:whole] for h in held], distance)
            held = [h[whole:] for h in held]
        if held is not None:
            yield _linked(held, distance)

    rows = prints.select("print").mapInArrow(emit, "cell long, above boolean, print long")
    groups = dealt(rows, most).repartition("cell", "pair").sortWithinPartitions("cell", "pair", "above", "print")
    return groups.mapInArrow(compare, "a long, b long").distinct()


def _linked(columns: list[np.ndarray], distance: int) -> pa.RecordBatch:
    cell, pair, above, prints = columns
    begins = (np.diff(cell, prepend=cell[:1]) != 0) | (np.diff(pair, prepend=pair[:1]) != 0)
    a, b = cell_links(np.cumsum(begins), prints.view(np.uint64), above, distance)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step of `components`: edges (u, v) by u, in ascending v, handed to the smallest of u and its neighbours.

    With `larger`, u's larger neighbours go to that smallest one; without, all of them and u itself do. Repeated edges
    lie side by side and count once. A group is read as a stream: only its smallest node is kept.
    """

    def hand(batches):
        node = lowest = previous = None
        for batch in batches:
            u, v = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(u):
                continue
            begins = np.append(node is None or u[0] != node, u[1:] != u[:-1])
            fresh = begins | np.append(previous is None or v[0] != previous, v[1:] != v[:-1])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(u)), -1))
            low = np.where(first >= 0, np.minimum(u, v[first]), lowest if lowest is not None else 0)
            node, lowest, previous = int(u[-1]), int(low[-1]), int(v[-1])
            go = fresh & (v > u) if larger else fresh & (v > low)
            a, b = v[go], low[go]
            if not larger:
                a, b = np.append(a, u[begins]), np.append(b, low[begins])
            linked = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["u", "v"])

    return edges.repartition("u").sortWithinPartitions("u", "v").mapInArrow(hand, "u long, v long")


def components(pairs: DataFrame) -> DataFrame:
    """node, root: for every node of the links a, b the smallest node it reaches.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest node it knows,
    then its smaller ones. Rounds grow with the logarithm of the longest chain. A round is two shuffles and one written
    table; the writing itself counts its rows and sums their hashes, by which two rounds are compared.
    """
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = Observation()
        small = _stars(_stars(both, larger=True), larger=False)
        edges = written(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")))
        now = seen.get
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_copies(tracks: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """Groups of tracks whose lyrics' SimHash fingerprints link within `distance` bits.

    tracks: track_id, lyrics_text. Fingerprint: words in lower-case A-Z, shingles of `width`
    words (all words if fewer, 0 if none), XXH64 with seed 42, majority of bits. Fingerprints are
    embedded as bit counts of two-bit segments; a range join on a grid of these finds all within
    the Manhattan distance, which never exceeds the Hamming distance, and the latter is then
    checked. Chains of links form a group. Returns track_id, fingerprint (16 hexadecimal
    digits), component_id (smallest track_id of the group).

    Null lyrics count as empty: fingerprint zero, which links like any other. Rows repeat as
    they come; null ids get the group's smallest known id, or null. An empty table gives an empty
    result; other columns are ignored. Only distinct fingerprints are compared, so exact copies cost one
    row; each cell hands on a spanning forest, not its pairs, and a large cell is compared by many tasks.
    Prints, links and groups stay in tables.
    """
    prints = written(fingerprints(tracks, width))
    distinct = written(prints.groupBy("print").agg(F.min("track_id").alias("lowest")))
    grouped = components(written(links(distinct, distance)))
    roots = distinct.join(grouped, distinct["print"] == grouped["node"], "left").select(
        "print", "lowest", F.coalesce("root", "print").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = roots.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "track_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
