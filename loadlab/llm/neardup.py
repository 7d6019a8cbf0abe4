"""Near-duplicate documents: SetSketch registers, bands, a joint likelihood estimate, exact sets.

1. Every document's distinct word shingles give a sketch; equal sets are one class
   with the smallest key as its representative.
2. Bands of register values put representatives into buckets.  Each is paired
   with the smallest one of its bucket; pairs whose registers make a similarity near
   the threshold unlikely are dropped.  What hangs together is a family.  In buckets with several
   families everyone outside the largest is compared with all of the other families, block by
   block, and families so met are one.
3. Within families links are confirmed on full sets, in chunks of a bounded number of
   members: likeliest pair first, leaving out what is connected already.  In
   families of several chunks the components then meet through their hubs, chunks of hubs again
   being bounded; whoever is still outside the family's largest component is
   compared with all others, chunk by chunk.
4. Components of the confirmed links.

No group is ever in one task, and no list of a group's pairs is made.  Step 2 takes the square of
a bucket's members only as far as they are in many families there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.llm import setsketch
from loadlab.llm.graph import components, lowest
from loadlab.llm.groups import per_group
from loadlab.llm.membership import filter_bits, passing, place_of
from loadlab.llm.words import distinct_per_row, lowered, shingles, slices, split_words
from loadlab.session import stage

ROWS_PER_BAND = 6
CHUNK = 128
#: Members of a bucket that are compared with as many others at once.
BLOCK = 512
#: Pairs with a likelihood estimate this far below the threshold are not looked at:
#: about four standard deviations of the estimate, six for families.
SURELY_BELOW = 0.10
FAMILY_BELOW = 0.15


def sets_of(texts: pa.Array, width: int):
    """Distinct shingle hashes of each text: A-Z lower-cased, words between ASCII blanks."""
    words = split_words(lowered(texts, ascii_only=True))
    hash, row = shingles(words.hash, words.first, width)
    return distinct_per_row(hash, row, words.n)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                hash, first = sets_of(part.column("text"), width)
                sketch = setsketch.registers(hash, first)
                filled = np.flatnonzero(np.diff(first))
                digest = np.zeros((2, part.num_rows), dtype=np.uint64)
                if len(filled):
                    digest[0, filled] = np.add.reduceat(hash, first[filled])
                    digest[1, filled] = np.bitwise_xor.reduceat(hash * np.uint64(0x9E3779B97F4A7C15), first[filled])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k"),
                        pa.array(np.diff(first)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                    ],
                    names=["k", "n", "h1", "h2", "sketch"],
                )

    return run


def _likely(threshold: float):
    """Pairs with an estimate of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_matrix(batch.column(c)) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = pa.array(setsketch.similarity(a, b, n_a, n_b) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(len(column), setsketch.REGISTERS)


class _Members:
    """Sketches, sets and known components of some documents."""

    def __init__(self, table: pa.Table):
        self.ids = table["k"].to_numpy()
        self.sketch = _matrix(table["sketch"])
        self.sets = [np.frombuffer(s, dtype=np.uint64) for s in table["set"].to_pylist()]
        self.size = np.array([len(s) for s in self.sets], dtype=float)


def _confirmed(own: _Members, other: _Members | None, known: np.ndarray, threshold: float):
    """Links that join components not yet joined, and the hub of each component of several members, a
    link with itself.  ``known`` numbers the components of ``own``, then ``other``.

    With ``other`` None all pairs of ``own``, else those of one with the other.
    Pairs go from the highest estimate down, so most are found connected before their sets are compared.
    """
    parent = list(range(int(known.max()) + 1 if len(known) else 0))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    right = own if other is None else other
    offset = 0 if other is None else len(own.ids)
    percent = round(100 * threshold)
    left_parts, right_parts, estimates = [], [], []
    for i in range(len(own.ids)):
        j = np.arange(i + 1 if other is None else 0, len(right.ids))
        j = j[known[offset + j] != known[i]]
        low, high = np.minimum(right.size[j], own.size[i]), np.maximum(right.size[j], own.size[i])
        j = j[100 * low >= percent * high]
        if not len(j):
            continue
        equal = (right.sketch[j] == own.sketch[i]).sum(axis=1)
        j = j[equal >= (threshold - 2 * SURELY_BELOW) * setsketch.REGISTERS]
        if not len(j):
            continue
        sketch = np.broadcast_to(own.sketch[i], (len(j), setsketch.REGISTERS))
        estimate = setsketch.similarity(sketch, right.sketch[j], np.full(len(j), own.size[i]), right.size[j])
        near = estimate >= threshold - SURELY_BELOW
        left_parts.append(np.full(int(near.sum()), i))
        right_parts.append(j[near])
        estimates.append(estimate[near])
    if not estimates:
        return []
    left, other_at, estimate = np.concatenate(left_parts), np.concatenate(right_parts), np.concatenate(estimates)
    links = []
    for p in np.argsort(-estimate, kind="stable").tolist():
        i, j = left[p], other_at[p]
        x, y = root(int(known[i])), root(int(known[offset + j]))
        if x == y:
            continue
        both = len(np.intersect1d(own.sets[i], right.sets[j], assume_unique=True))
        if 100 * both >= percent * (len(own.sets[i]) + len(right.sets[j]) - both):
            parent[max(x, y)] = min(x, y)
            links.append((own.ids[i], right.ids[j]))
    if other is None:
        near = estimate >= threshold
        degree = np.bincount(left[near], minlength=len(own.ids)) + np.bincount(other_at[near], minlength=len(own.ids))
        hubs: dict[int, int] = {}
        for i in np.argsort(-degree, kind="stable").tolist():
            hubs.setdefault(root(int(known[i])), i)
        joined = {root(int(known[i])) for i in left} & {root(int(known[i])) for i in other_at}
        links += [(own.ids[i], own.ids[i]) for at, i in hubs.items() if at in joined]
    return links


def _links_table(links: list) -> pa.Table:
    a, b = (pa.array([int(link[i]) for link in links], pa.int64()) for i in (0, 1))
    return pa.table({"a": a, "b": b})


def _near_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links that connect all who share a bucket and whose estimate is near the threshold."""
    bytes_per_band = 2 * ROWS_PER_BAND
    bands = setsketch.REGISTERS // ROWS_PER_BAND
    keys = [
        F.xxhash64(F.lit(i), F.substring("sketch", i * bytes_per_band + 1, bytes_per_band)) for i in range(bands)
    ]
    rows = reps.select("k", F.explode(F.array(*keys)).alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("k").alias("a"), F.max("k").alias("_last")).where("a < _last").select("bucket", "a")
    members = stage(rows.join(buckets, "bucket").select("bucket", "a", "k"), "bucket-members")
    pairs = stage(members.where("k > a").select("a", F.col("k").alias("b")).distinct(), "star-pairs")
    one = reps.select(F.col("k").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    two = reps.select(F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    percent = round(100 * threshold)
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(one, "b").join(two, "a").where(sized)
    near = stage(both.mapInArrow(_likely(threshold - FAMILY_BELOW), "a bigint, b bigint"), "near-pairs")
    return near.unionByName(_across(members, near, reps, threshold))


def _across(members: DataFrame, near: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links between members of a bucket whom ``near`` leaves in different families."""
    families = components(near).select(F.col("id").alias("k"), "component_id")
    of = members.join(families, "k", "left").select("bucket", "k", F.coalesce("component_id", "k").alias("family"))
    of = stage(of, "bucket-families")
    sizes = of.groupBy("bucket", "family").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(
        F.max_by("family", F.struct("size", "family")).alias("largest"), F.max("size").alias("most"), F.sum("size").alias("n")
    )
    # Two alone have been compared already.
    mixed = mixed.where("n > 2 and most < n").select(
        "bucket", "largest", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"),
        F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("parts"),
    )
    # As a table of its own, so that adaptive execution can split a bucket with very many members in the join.
    mixed = stage(mixed, "mixed-buckets")
    inside = of.join(mixed, "bucket").withColumn("large", F.col("family") == F.col("largest"))
    place = F.pmod(F.xxhash64(F.lit(2), "k"), F.lit(1 << 20))
    columns = ["bucket", "k", "family", "large"]
    asking = inside.where("not large").select(
        *columns, (place % F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"),
    )
    asked = inside.select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (place % F.col("chunks")).cast("int").alias("chunk"),
        F.lit(False).alias("asks"),
    )
    both = asking.unionByName(asked).join(reps.select("k", "n", "sketch"), "k")
    compared = per_group(both, ["bucket", "part", "chunk"], _meeting(threshold), "a bigint, b bigint")
    return stage(compared, "met-pairs")


def _meeting(threshold: float):
    """Links between those who ask and those asked, of different families; each two meet once."""
    percent = round(100 * threshold)

    def work(table: pa.Table) -> pa.Table | None:
        asks = table["asks"].to_numpy()
        k, family, large = (table[c].to_numpy() for c in ("k", "family", "large"))
        n, sketch = table["n"].to_numpy(), _matrix(table["sketch"])
        others = np.flatnonzero(~asks)
        left, right = [], []
        for i in np.flatnonzero(asks).tolist():
            j = others[(family[others] != family[i]) & (large[others] | (k[others] > k[i]))]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= (threshold - 2 * SURELY_BELOW) * setsketch.REGISTERS]
            left.append(np.full(len(j), i))
            right.append(j)
        if not sum(map(len, right)):
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        near = []
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            near.append(setsketch.similarity(sketch[x], sketch[y], n[x].astype(float), n[y].astype(float)) >= threshold - SURELY_BELOW)
        near = np.concatenate(near)
        ids, at = np.unique(np.concatenate([k[a[near]], k[b[near]]]), return_inverse=True)
        low = lowest(at[: len(at) // 2], at[len(at) // 2 :], len(ids))
        moved = np.flatnonzero(low != np.arange(len(ids)))
        return pa.table({"a": ids[low[moved]], "b": ids[moved]})

    return work


def _family_sets(documents: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` with the sketch and the full set of each, from the texts."""
    filter_ = filter_bits(members, place_of("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in batches:
            kept = batch.filter(pa.array(passing(bits, batch.column("place").to_numpy())))
            for part in slices(kept, "text", 1 << 19):
                hash, first = sets_of(part.column("text"), width)
                sketch = setsketch.registers(hash, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k"),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                        pa.array([hash[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary()),
                    ],
                    names=["k", "sketch", "set"],
                )

    source = documents.where("k is not null").select("k", place_of("k").alias("place"), "text")
    sets = source.mapInArrow(run, "k bigint, sketch binary, set binary")
    # A repeated key has one row here; which of its texts does not matter, see near_duplicates().
    return stage(members.join(sets, "k").dropDuplicates(["k"]), "family-sets")


def _chunked(members: DataFrame, chunk: int) -> DataFrame:
    """``k, family`` with the number of ``chunks`` of the family and one's own."""
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    return members.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int"))


def _links(documents: DataFrame, pairs: DataFrame, threshold: float, width: int, chunk: int) -> DataFrame:
    """Confirmed links between representatives, enough to connect what is connected."""
    families = components(pairs).select(F.col("id").alias("k"), F.col("component_id").alias("family"))
    members = _family_sets(documents, stage(_chunked(families, chunk), "families"), width)

    def inside(table: pa.Table) -> pa.Table:
        own = _Members(table)
        return _links_table(_confirmed(own, None, np.arange(len(own.ids)), threshold))

    found = stage(per_group(members, ["family", "chunk"], inside, "a bigint, b bigint"), "links")
    links, asking = found, members.where("chunks > 1").select("k", "family", "chunks")
    if asking.isEmpty():
        return links
    large = members.where("chunks > 1")
    while True:
        hubs = found.where("a = b").select(F.col("a").alias("k")).join(asking, "k").select("k", "family")
        hubs = stage(_chunked(hubs, chunk), "hubs")
        if hubs.isEmpty():
            break
        meeting = hubs.join(large.select("k", "sketch", "set"), "k")
        found = stage(per_group(meeting, ["family", "chunk"], inside, "a bigint, b bigint"), "links")
        links = links.unionByName(found)
        asking = hubs.where("chunks > 1")

    of = components(links).withColumnRenamed("id", "k")
    now = large.select("k", "family", "chunk", "chunks").join(of, "k", "left")
    now = stage(now.withColumn("component_id", F.coalesce("component_id", "k")), "components")
    # The rest: everyone outside the largest component of his family, against every chunk of it.
    weights = now.groupBy("family", "component_id").agg(F.count("*").alias("size"))
    largest = weights.groupBy("family").agg(F.max_by("component_id", F.struct("size", "component_id")).alias("largest"))
    rest = now.join(largest, "family").where("component_id <> largest").select("k", "family", "chunks", "component_id")
    rest_parts = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(1 << 20)))
    counts = rest.groupBy("family").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    asking = rest_parts.join(counts, "family").select(
        "k", "family", "component_id", (F.col("part") % F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"),
    )
    asked = now.join(counts, "family").select(
        "k", "family", "component_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk",
        F.lit(False).alias("asks"),
    )
    both = asking.unionByName(asked.select(*asking.columns)).join(large.select("k", "sketch", "set"), "k")

    def against(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        own, others = table.filter(asks), table.filter(pa.compute.invert(asks))
        numbers = np.unique(np.concatenate([own["component_id"].to_numpy(), others["component_id"].to_numpy()]), return_inverse=True)[1]
        return _links_table(_confirmed(_Members(own), _Members(others), numbers, threshold))

    compared = per_group(both, ["family", "chunk", "part"], against, "a bigint, b bigint")
    return links.unionByName(stage(compared, "links"))


def near_duplicates(
    documents: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Documents whose distinct ``width``-word shingles have a Jaccard similarity of
    at least ``threshold`` are linked; ``component_id`` is the smallest key
    reachable.  With fewer words than ``width`` the whole sequence is the one
    shingle.  NULL texts and texts without words have no shingle and are linked with nothing.
    A row with a NULL key is its own class: ``component_id`` NULL, kept.  Rows with the
    same key are one document in links (that of one of them, should their texts differ).
    ``key`` is an integer; other columns are not read.
    """
    source = documents.select(documents[key].cast("bigint").alias("k"), documents[text].alias("text"))
    sketched = stage(source.mapInArrow(_sketches(width), "k bigint, n bigint, h1 bigint, h2 bigint, sketch binary"), "sketches")
    same = ["n", "h1", "h2"]
    filled = sketched.where("n > 0 and k is not null")
    classes = stage(filled.groupBy(*same).agg(F.min("k").alias("rep")), "classes")
    reps = stage(
        filled.join(classes.select("rep"), filled["k"] == classes["rep"], "left_semi").dropDuplicates(["k"]), "representatives"
    )
    links = _links(source, _near_pairs(reps, threshold), threshold, width, chunk)
    found = components(links).select(F.col("id").alias("rep"), "component_id")
    of_class = classes.join(found, "rep", "left").select(*same, F.coalesce("component_id", "rep").alias("component_id"))
    rows = sketched.select("k", *same).join(of_class, same, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k"))
    component = F.when(F.col("k").isNotNull(), component)
    return rows.select(
        F.col("k").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (component.isNull() | (component == F.col("k"))).alias("kept"),
    )
