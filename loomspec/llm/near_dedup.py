"""Near-duplicate documents: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set holds the hashes of its distinct word shingles. One hash of each element serves all bins: the element's
place picks the bin, its value competes there, and an empty bin copies a bin picked by a hash of its own number and of the
attempt (optimal densification). Bands of `ROWS` bins are bucket keys.

Documents with equal sets are one node. Candidates are stars: in each bucket a hub is compared with the other members, so a
bucket of m members gives m - 1 pairs. A pair's sketches (`Parity`) tell at least how far apart the sets are; pairs that this
rules out are dropped, all others are confirmed on the full sets.

A star does not settle a bucket whose members are still in different components, unless it had two members. Nodes of such
buckets, and of those that share a node with them, form a group, and the links within it are completed exactly, without its
pairs being made (`_completed`): what each set differs by from the elements that most of the group hold is a small set, and
two sets are linked where these differences have enough in common. Sets near the middle are linked with the nearest
one; of the others, those can be linked whose differences share one of their rarest elements (prefix filter), at places that
leave room for enough more (positional filter). Such lists of elements give stars first, then what is left between
components. No link that any bucket holds is lost. At the threshold, a linked pair shares no bucket with a probability of
(1 - s**ROWS)**BANDS, 7e-9 for 0.85 and 3e-6 for 0.8, if its bins are independent.

A null text or one without words has an empty set and is linked with nothing; a very long text is one row, read whole, with a
set as long as the text. Rows that share an id are one document and get the same answer; if their texts differ, all their
links count. Rows without an id are linked with nothing and kept. An empty table gives an empty result. Only ids and texts
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, TEXT, id_text, lean, pieces, saved, spread_join, unused
from loomspec.llm.graph import components, relabelled
from loomspec.llm.shingles import WordHashes, mix, shingles

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
ATTEMPTS = 4096
#: Longs of a set's sketch, and members of a group that share a copy of its common elements.
PARITY, GROUP_PART = 8, 100


def _probes() -> np.ndarray:
    """For each attempt and bin the bin that an empty one looks at."""
    x = np.arange(ATTEMPTS * BINS, dtype=np.uint64).reshape(ATTEMPTS, BINS)
    return (mix(x + np.uint64(0x51ED27)) % np.uint64(BINS)).astype(np.int16)


class Signer:
    def __init__(self):
        self.probes = _probes()

    def bins(self, elements: np.ndarray) -> np.ndarray:
        """The densified signature of a set, given as distinct hashes."""
        x = np.sort(mix(elements))
        place = ((x >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)  # rises with x, so the first of a bin is its least
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
        out[place[first]], full[place[first]] = x[first], True
        empty = np.flatnonzero(~full)
        if len(first) == 1:
            out[:] = x[0]
            return out
        for attempt in self.probes:
            if not len(empty):
                break
            seen = attempt[empty]
            hit = full[seen]
            out[empty[hit]] = out[seen[hit]]
            empty = empty[~hit]
        if len(empty):  # after thousands of attempts: the next full bin
            filled = np.flatnonzero(full)
            out[empty] = out[filled[np.searchsorted(filled, empty) % len(filled)]]
        return out

    def bands(self, elements: np.ndarray) -> np.ndarray:
        rows = self.bins(elements).reshape(BANDS, ROWS)
        with np.errstate(over="ignore"):
            key = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
            for k in range(ROWS):
                key = mix(key * np.uint64(31) + rows[:, k])
        return key.view(np.int64)


class Parity:
    """A sketch of a set: bit h(x) is flipped for each element x, so two sketches differ in no more bits than the sets in elements."""

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        place = (mix(elements ^ np.uint64(0x9A71)) >> np.uint64(32)).astype(np.int64) % (64 * PARITY)
        bits = (np.bincount(place, minlength=64 * PARITY) & 1).astype(np.uint8)
        return np.packbits(bits).view(np.int64)


def signatures(texts: DataFrame, size: int) -> DataFrame:
    """(ID, n, s1, s2, parity, bands): the set's size, digest, sketch and bucket keys; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign, parity = WordHashes(), Signer(), Parity()
        for batch in pieces(batches):
            n, low, high, sketches, bands = [], [], [], [], []
            for text in batch.column("data").to_pylist():
                elements = np.unique(shingles(hashes(text), size))
                digest = xxhash.xxh3_128_digest(elements.tobytes())
                n.append(len(elements))
                low.append(int.from_bytes(digest[:8], "little", signed=True))
                high.append(int.from_bytes(digest[8:], "little", signed=True))
                sketches.append(parity(elements) if len(elements) else None)
                bands.append(sign.bands(elements) if len(elements) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sketches, longs), pa.array(bands, longs)], names=[ID, "n", "s1", "s2", "parity", "bands"])

    data = texts.select(ID, texts[TEXT].cast("binary").alias("data"))
    return data.mapInArrow(lean(run), f"{ID} bigint, n bigint, s1 bigint, s2 bigint, parity array<bigint>, bands array<bigint>")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(ID, s1, s2, elements): the sorted distinct hashes of each text's shingles, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [np.unique(shingles(hashes(x), size)) for x in batch.column("data").to_pylist()]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            low, high = ([int.from_bytes(x[k : k + 8], "little", signed=True) for x in digests] for k in (0, 8))
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=[ID, "s1", "s2", "elements"])

    return texts.select(ID, texts[TEXT].cast("binary").alias("data")).mapInArrow(lean(run), f"{ID} bigint, s1 bigint, s2 bigint, elements array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _possible(n_a: Column, parity_a: Column, n_b: Column, parity_b: Column, percent: int) -> Column:
    """Whether sizes and sketches allow a link: linked sets differ in (100 - percent) / (100 + percent) of their sizes' sum at most."""
    apart = sum((F.bit_count(parity_a[k].bitwiseXOR(parity_b[k])).cast("bigint") for k in range(1, PARITY)), F.bit_count(parity_a[0].bitwiseXOR(parity_b[0])).cast("bigint"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * apart <= (100 - percent) * (n_a + n_b))


def _likely(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of different nodes that can be links."""
    sides = [info.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "ab"]
    distinct = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return distinct.join(sides[0], "a").join(sides[1], "b").where(_possible(F.col("n_a"), F.col("p_a"), F.col("n_b"), F.col("p_b"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links) and kept."""
    texts = id_text(docs, id_col, text_col)
    signed = saved(signatures(texts, size), "signatures")
    usable = signed.where(F.col(ID).isNotNull() & (F.col("n") > 0))
    # equal sets are one node; its number is written once and read from then on
    distinct = usable.groupBy("s1", "s2").agg(F.min(ID).alias("first"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("bands").alias("bands"))
    nodes = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = _labels(nodes, texts, size, percent)
    # rows of one id with different texts
    twice = usable.groupBy(ID).agg(F.count("*").alias("rows")).where("rows > 1").select(ID)
    sets_of = usable.join(twice, ID, "left_semi").select(ID, "s1", "s2").distinct().join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    firsts = sets_of.groupBy(ID).agg(F.min("node").alias("a"))
    same = saved(sets_of.join(firsts, ID).where("a <> node").select("a", F.col("node").alias("b")), "same-ids")
    found = labels if same.isEmpty() else relabelled(labels, same)
    linked = nodes.select("node", "s1", "s2", "first", "m").join(found, "node", "left")
    smallest = linked.where("component is not null").groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "component", "left").select("s1", "s2", "m", F.coalesce("component_id", "first").alias("component_id"))
    out = spread_join(signed.select(ID, "n", "s1", "s2"), saved(named.where("m > 1 or component_id is not null"), "named"), ["s1", "s2"], "component_id", "m", F.xxhash64(ID))
    component = F.when(F.col(ID).isNotNull() & (F.col("n") > 0), F.coalesce("component_id", ID)).otherwise(F.col(ID))
    return out.select(F.col(ID).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col(ID), F.lit(True)).alias("kept"))


def _labels(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of nodes that confirmed links connect, of all that nodes that share a bucket have."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = saved(rows.join(hubs, "key").select("key", "node", "hub", "m"), "members")
    if members.isEmpty():
        return nodes.sparkSession.createDataFrame([], "node bigint, component bigint")
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi")
    info = nodes.select("node", "n", "parity")
    owners = chosen.select("node", F.col("first").alias(ID), "s1", "s2")
    whose = texts.join(owners.select(ID).distinct(), ID, "left_semi")
    sets = saved(full_sets(whose, size).dropDuplicates([ID, "s1", "s2"]).join(owners, [ID, "s1", "s2"]).select("node", "elements"), "sets")
    pairs = _likely(members.select(F.col("hub").alias("a"), F.col("node").alias("b")), info, percent)
    labels = components(confirmed(pairs, sets, percent))
    labelled = members.where("m > 2").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    live = saved(labelled.join(several.select("key", "low"), "key").select("node", "component", "low").distinct(), "live")
    return labels if live.isEmpty() else _completed(live, labels, info, sets, percent)


def _completed(live: DataFrame, labels: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels after the links that they lack within the groups of components that live, (node, component, low), connects.

    With p for percent, sets A and B are linked if (100 + p) * |A xor B| <= (100 - p) * (|A| + |B|). For D(A) = A xor C, of any
    C, A xor B is D(A) xor D(B): with excess(A) = (100 + p) * |D(A)| - (100 - p) * |A|, they are linked if
    2 * (100 + p) * |D(A) & D(B)| >= excess(A) + excess(B).
    """
    up, down = 100 + percent, 100 - percent
    near = components(live.where("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b")).distinct())
    group = live.select("node", "component").distinct().join(near.select(F.col("node").alias("component"), F.col("component").alias("g")), "component").select("node", "g")
    sizes = group.groupBy("g").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / GROUP_PART).cast("int")
    grouped = saved(group.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("members").join(sets, "node"), "group-sets")
    held = grouped.select("g", F.explode("elements").alias("element")).groupBy("g", "element").agg(F.count("*").alias("c")).where("c > 1")
    common = held.join(sizes, "g").where("2 * c > members").groupBy("g").agg(F.collect_list("element").alias("common"))  # at most twice a mean set
    # a group's common elements go to as many tasks as it has hundreds of members
    middle = sizes.join(common, "g", "left").select("g", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    differing = grouped.join(middle, ["g", "part"]).select("g", "node", F.size("elements").cast("bigint").alias("n"), F.concat(F.array_except("elements", "common"), F.array_except("common", "elements")).alias("d"))
    size_d = F.size("d").cast("bigint")
    differing = saved(differing.withColumns({"size": size_d, "excess": up * size_d - down * F.col("n")}), "differences")
    facts = differing.drop("d")
    nearest = facts.groupBy("g").agg(F.min("excess").alias("least"), F.min_by("node", F.struct("excess", "node")).alias("middle"))
    facts = facts.join(nearest, "g")
    star = facts.where((F.col("excess") + F.col("least") <= 0) & (F.col("node") != F.col("middle"))).select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b"))
    labels = relabelled(labels, star)
    labelled = _labelled(differing, labels)
    open_groups = labelled.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    # elements that two differences hold, the rarest first; those of one alone come before all others
    left = facts.join(open_groups, "g", "left_semi")
    rows = differing.select("node", "d").join(left.select("g", "node"), "node").select("g", "node", F.explode("d").alias("element"))
    often = rows.groupBy("g", "element").agg(F.count("*").alias("c")).where("c > 1")
    ordered = rows.join(often, ["g", "element"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "element"))).alias("shared"))  # a document's own
    places = left.join(ordered, "node").select("g", "node", "n", "size", "excess", "least", F.posexplode("shared").alias("at", "one"), F.size("shared").alias("k"))
    places = places.select("g", "node", "n", "size", "excess", F.col("one.element").alias("element"), (F.col("size") - F.col("k") + F.col("at")).alias("at"), F.ceil((F.col("least") + F.col("excess")) / (2 * up)).alias("asked"), F.ceil(F.col("excess") / up).alias("given"))
    # a partner of less excess asks for as much in common as the least of the group would at least, one of more for what a partner alike would
    probes = saved(places.where(F.col("at") <= F.col("size") - F.greatest(F.lit(1), "asked")).withColumn("indexed", F.col("at") <= F.col("size") - F.greatest(F.lit(1), "given")), "prefixes")
    if probes.isEmpty():
        return labels
    heads = probes.where("indexed").groupBy("g", "element").agg(F.min_by("node", F.struct("excess", "node")).alias("a"))
    stars = _likely(probes.join(heads, ["g", "element"]).select("a", F.col("node").alias("b")), info, percent)
    stars = _between(stars, labelled)
    more = saved(confirmed(stars, sets, percent), "links")
    if not more.isEmpty():
        labels = relabelled(labels, more)
        labelled = _labelled(differing, labels)
    full = probes.join(labelled.drop("g"), "node").join(info.select("node", "parity"), "node")
    side = lambda x: full.where("indexed" if x == "a" else "true").select("g", "element", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "size", "excess", "at", "component", "parity")))
    room = 2 * up * F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= F.col("excess_a") + F.col("excess_b")
    first = (F.col("excess_a") < F.col("excess_b")) | (F.col("excess_a") == F.col("excess_b")) & (F.col("node_a") < F.col("node_b"))
    last = side("a").join(side("b"), ["g", "element"]).where((F.col("component_a") != F.col("component_b")) & first & room & _possible(F.col("n_a"), F.col("parity_a"), F.col("n_b"), F.col("parity_b"), percent))
    last = last.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    final = saved(confirmed(last, sets, percent), "links")
    return labels if final.isEmpty() else relabelled(labels, final)


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.select("g", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _between(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The pairs of different components."""
    one, two = (labelled.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").where("of_a <> of_b").select("a", "b")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps: the one with the smallest id of each group, and rows without an id."""
    name = unused("__gone", docs.columns)
    gone = near_duplicates(docs, size, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == F.col(name), "left_anti")
