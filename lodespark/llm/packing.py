"""Filling containers of a fixed capacity with documents that are neighbours on a space-filling curve.

Each document's hashed token vector is projected to a few dimensions, each of which is spread evenly by
the corpus's own quantiles, and given its place on a Hilbert curve. Documents are range-sorted by that
place, and each range is packed along the curve: a container begins with the earliest document not yet
placed and takes the next ones in order; its last room goes to what fits best among the next ``AHEAD``
documents. No item is split unless it exceeds the capacity by itself.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.joins import spread
from lodespark.llm.bpe import default_path, encoder
from lodespark.storage import stored

#: Features to which tokens are hashed, dimensions of the curve, bits in each dimension.
FEATURES, DIMS, BITS = 256, 4, 10
#: Quantiles by which a dimension is spread.
STEPS = 128
#: Documents of one range, the most that are packed at once, and how many not yet placed may be looked at along the curve.
RANGE_ROWS, BLOCK_ROWS, AHEAD = 50_000, 100_000, 128
#: Capacities that are filled in one pass over the documents.
SPECS = 1_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with integer coordinates of ``bits`` bits each.

    Coordinates become the transposed curve index by undoing, from the highest bit down, the
    exchanges and inversions of each sub-cube, then Gray-decoding; their bits interleave to the key.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(id_lists: list[list[int]]) -> np.ndarray:
    """The coordinates of documents given as token ids, one row each; zeros for no tokens."""
    plane = np.random.default_rng(20_240_229).standard_normal((FEATURES, DIMS))
    vecs = np.zeros((len(id_lists), FEATURES))
    for i, ids in enumerate(id_lists):
        if ids:
            hashed = (np.asarray(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            vecs[i] = np.sqrt(np.bincount(hashed.astype(np.int64) % FEATURES, minlength=FEATURES))
    norms = np.linalg.norm(vecs, axis=1, keepdims=True)
    return (vecs / np.where(norms == 0, 1, norms)) @ plane


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, coords of every document; 0 tokens for null and empty texts. One pass, no shuffle."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [enc.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(list(project(ids)), pa.list_(pa.float64()))], names=["id", "n_tokens", "coords"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, n_tokens long, coords array<double>")


def placed(sized: DataFrame) -> DataFrame:
    """id, n_tokens, place on the curve; ``sized``: a stored table of ``measured``.

    Each coordinate becomes its rank among the corpus's quantiles, which come from mergeable sketches of
    bounded size, so that documents fill the curve evenly wherever the projection puts them.
    """
    shares = [i / STEPS for i in range(STEPS + 1)]
    found = sized.agg(*(F.percentile_approx(F.col("coords")[d], shares, 10_000).alias(f"d{d}") for d in range(DIMS))).collect()[0]
    edges = [np.unique(np.array(found[f"d{d}"] or [0.0])) for d in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).values.to_numpy().reshape(-1, DIMS)
            ranks = np.stack([np.interp(flat[:, d], e, np.linspace(0, (1 << BITS) - 1, len(e))) for d, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hilbert_key(np.rint(ranks).astype(np.int64)))], names=["id", "n_tokens", "place"])

    kind = sized.schema["id"].dataType.simpleString()
    return sized.select("id", "n_tokens", "coords").mapInArrow(run, f"id {kind}, n_tokens long, place long")


def pack(sizes: np.ndarray, capacity: int, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of the items, which come in the curve's order: item, first token within it, tokens, container.

    An item over the capacity fills containers of its own; its rest is an item like any other. Items
    without size take part in the container begun last before them, or in the first; in none (-1) if
    no item has a size.
    """
    item, start, size, into = [], [], [], []
    made = 0
    rest = np.where(sizes > capacity, sizes % capacity, sizes).tolist()
    pending: list[tuple[int, int]] = []  # (size, -item) of the next items, by size; of equals the earlier one last
    gone = [r == 0 for r in rest]
    nxt = oldest = held = 0

    def take(i: int) -> None:
        nonlocal held
        pending.pop(bisect_left(pending, (rest[i], -i)))
        gone[i] = True
        held -= rest[i]
        item.append(i), start.append(int(sizes[i]) - rest[i]), size.append(rest[i]), into.append(made)

    while True:
        while nxt < len(rest) and len(pending) < ahead:
            if sizes[nxt] > capacity:
                for s in range(0, int(sizes[nxt]) // capacity * capacity, capacity):
                    item.append(nxt), start.append(s), size.append(capacity), into.append(made)
                    made += 1
            elif sizes[nxt] == 0:
                item.append(nxt), start.append(0), size.append(0), into.append(max(made - 1, 0))
            if rest[nxt]:
                insort(pending, (rest[nxt], -nxt))
                held += rest[nxt]
            nxt += 1
        if not pending:
            break
        while gone[oldest]:
            oldest += 1
        usual = min(held / len(pending), capacity / 2)  # room in which some item ahead fits well
        room, i = capacity, oldest
        while i < nxt and (room > usual or room == capacity):
            if not gone[i]:
                if rest[i] > room:
                    break
                room -= rest[i]
                take(i)
            i += 1
        while room and (k := bisect_right(pending, (room, 1))):
            room -= pending[k - 1][0]
            take(-pending[k - 1][1])
        made += 1
    c = np.array(into, np.int64)
    return np.array(item, np.int64), np.array(start, np.int64), np.array(size, np.int64), c if made else np.full(len(c), -1)


def fill(places: DataFrame, capacities: dict[int, int], range_rows: int = RANGE_ROWS) -> DataFrame:
    """spec_id, container_id, id, piece_start, n_tokens: every document in containers of each capacity.

    ``places``: rows of ``placed``. A document within the capacity is one piece; a longer one fills
    containers of its own and its rest is placed like any other item. An empty document takes part in
    a container without room, or in none (null) where a whole range is empty. Documents of one place
    on the curve (copies, perhaps a third of all) are spread over ranges by a hash of the id. Each range
    leaves a few containers part-filled, whatever the size of the corpus.
    """
    specs = sorted((int(s), int(c)) for s, c in capacities.items() if s is not None and c and c > 0)
    kind = places.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {s: TaskContext.get().partitionId() << 36 for s, _ in specs}
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, sizes = whole.column(0).combine_chunks(), whole.column(1).to_numpy()
            for s, cap in specs:
                item, start, size, into = pack(sizes, cap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(item), s, np.int32)), pa.array(into + made[s], pa.int64(), mask=into < 0), ids.take(pa.array(item)), pa.array(start), pa.array(size)],
                    names=["spec_id", "container_id", "id", "piece_start", "n_tokens"],
                )
                made[s] += int(into.max(initial=-1)) + 1

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield from block()
                n = 0
        if n:
            yield from block()

    parts = max(1, -(-places.count() // range_rows))
    ranged = places.withColumn("tie", F.xxhash64("id")).repartitionByRange(parts, "place", "tie").sortWithinPartitions("place", "tie")
    return ranged.select("id", "n_tokens").mapInArrow(run, f"spec_id int, container_id long, id {kind}, piece_start long, n_tokens long")


def pack_documents(docs: DataFrame, specs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents measured once, their sizes and places stored, then packed for every spec, ``SPECS`` of them in one pass."""
    places = stored(placed(stored(measured(docs, path=path), "measured")), "places")
    wanted = specs.select("spec_id", "capacity_tokens").where("spec_id is not null and capacity_tokens > 0").distinct()
    turn: dict[int, int] = {}
    out = None
    for row in [*wanted.orderBy("spec_id").toLocalIterator(), None]:
        if row is None and (turn or out is None) or len(turn) == SPECS:
            done = fill(places, turn)
            out, turn = done if out is None else out.unionByName(done), {}
        if row is not None:
            turn[row[0]] = row[1]
    return out.withColumnRenamed("id", "doc_id")
