"""Near duplicates: DartMinHash signatures, banded joins, exact verification, connected groups.

Darts are points of a random set in (element, weight, rank) space, the same for all texts.
A text is hit by the darts whose weight lies below the weight of their element. Each dart
belongs to one coordinate of the signature; the coordinate takes the dart of least rank that
hits. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. Work per text is that of its elements plus a few darts per coordinate, whatever
the weights are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.llm.base import byte_slices, checkpoint
from answerrec.llm.grams import WORD, mix, packs, shingles, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6  # a pair at 0.8 agrees in no band with a probability of 5e-6
LONGS = 16  # the bitmap of a text's shingles has 64 times as many bits
LEAST = -8  # the first layer of ranks ends at 2^LEAST


#: What separates words beyond ASCII, and letters of scripts without spaces between words.
SEPARATOR = regex.compile(r"[^\x00-\x7F\p{L}\p{M}\p{N}]")
ALONE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def plain(text: str) -> bytes:
    """Lower case; beyond ASCII, all but letters, marks and digits become blanks, and letters of
    scripts that put no spaces between words stand alone."""
    text = text.lower()
    if not text.isascii():
        if SEPARATOR.search(text):
            text = SEPARATOR.sub(" ", text)
        if ALONE.search(text):
            text = ALONE.sub(r" \g<0> ", text)
    return text.encode("utf-8", "replace")


def shingle_sets(texts: list[str], n: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, their counts) of each text.

    Words are stretches of letters, marks, digits and underscores, lower case; a letter of a
    script without spaces is a word. A text of fewer than n words is one shingle of all its
    words; a text without words has none.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    words = np.zeros(len(texts), np.int64)
    tail, tail_of = np.empty(0, np.uint64), -1  # the last words of a text that may go on in the next buffer
    short: dict[int, list[np.ndarray]] = {}  # all words of texts that have had fewer than n so far
    for buffer, starts, owner in packs([plain(t) for t in texts]):
        hashes, begin, _ = word_hashes(buffer, WORD[buffer])
        of = owner[np.searchsorted(starts, begin, "right") - 1]
        number = np.bincount(of, minlength=len(texts))
        words += number
        for i in np.flatnonzero((number > 0) & (words < n)):
            short.setdefault(int(i), []).append(hashes[of == i])
        hashes, of = np.concatenate((tail, hashes)), np.concatenate((np.full(len(tail), tail_of), of))
        whole, whole_of = shingles(hashes, of, n)
        first = np.searchsorted(whole_of, np.arange(len(texts) + 1))
        for i in np.unique(whole_of):
            found[i].append(whole[first[i] : first[i + 1]])
        if len(of):
            tail_of = int(of[-1])
            tail = hashes[of == tail_of][-(n - 1) :]
    out = []
    for i, parts in enumerate(found):
        if not parts and words[i]:
            h = np.full(1, 0x5851F42D4C957F2D, np.uint64)
            for word in np.concatenate(short[i]):
                h = mix(h ^ word)
            parts = [h]
        out.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64)))
    return out


def unit(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from a hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def poisson(mean: float) -> np.ndarray:
    """The chances of at most 0, 1, 2 ... events, until the rest is too rare for a double."""
    terms = [np.exp(-mean)]
    while terms[-1] > 1e-18 or len(terms) < mean:
        terms.append(terms[-1] * mean / len(terms))
    return np.cumsum(terms)


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, region: tuple[float, float, float, float], k: int):
    """The darts in one region of each element: (owner, coordinate, rank, identity).

    A region spans the ranks `low` to `high` and the weights `floor` to `roof`. The number of
    its darts is drawn from a Poisson law with the region's area as mean, by a hash of element
    and region; so are their places. Darts beyond an element's weight miss it.
    """
    low, high, floor, roof = region
    corner = np.array([low, floor], np.float64).view(np.uint64)
    seed = mix(elements ^ mix(corner * np.array([3, 5], np.uint64)).sum(dtype=np.uint64))
    count = np.searchsorted(poisson((high - low) * (roof - floor)), unit(seed))
    thrower = np.repeat(np.arange(len(seed)), count)
    number = np.arange(1, len(thrower) + 1) - np.repeat(np.cumsum(count) - count, count)
    h = mix(seed[thrower] + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    hit = floor + unit(mix(h ^ np.uint64(0xA5A5A5A5))) * (roof - floor) <= weights[thrower]
    h, thrower = h[hit], thrower[hit]
    rank = low + unit(mix(h ^ np.uint64(0x5A5A5A5A))) * (high - low)
    return owner[thrower], (h % np.uint64(k)).astype(np.int64), rank, h


def slabs(heaviest: float, height: float) -> Iterator[tuple[float, float]]:
    """Stretches of weight up to the heaviest: doubling, and none higher than `height` after the first."""
    floor, roof = 0.0, 1.0
    while floor < heaviest:
        yield floor, roof
        floor, roof = roof, roof + min(roof, max(1.0, height))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k darts per weighted set; sets without elements get a row of zeros.

    Ranks are dealt in layers, the first up to 2^LEAST, each as wide as all before, at most
    16. A set takes part until every coordinate has a dart; later ones would rank higher.
    """
    out = np.zeros((len(sets), k), np.uint64)
    best = np.full((len(sets), k), np.inf)
    names, ranks = out.reshape(-1), best.reshape(-1)
    todo = np.flatnonzero([len(s) > 0 for s, _ in sets])
    low, high = 0.0, 2.0**LEAST
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(todo, [len(sets[i][0]) for i in todo])
        # the height depends on the layer alone, so that all texts see the same regions
        for floor, roof in slabs(weights.max(), 2.0 ** np.floor(np.log2(16 / (high - low)))):
            more = weights > floor
            who, place, rank, name = darts(elements[more], weights[more], owner[more], (low, high, floor, roof), k)
            flat = who * k + place
            np.minimum.at(ranks, flat, rank)
            won = ranks[flat] == rank
            names[flat[won]] = name[won]
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        low, high = high, high + min(high, 16.0)
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One hash per band of each signature."""
    split = rows.reshape(len(rows), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = np.repeat(h, len(rows), axis=0)
    for j in range(ROWS):
        h = mix(h ^ split[:, :, j])
    return h.view(np.int64)


def weighted_sets(texts: list[str], weighted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    sets = shingle_sets(texts)
    return sets if weighted else [(s, np.ones(len(s), np.int64)) for s, _ in sets]


def some_texts(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, some hundred kilobytes at a time; null counts as empty."""
    for some in byte_slices(pa.RecordBatch.from_arrays([batch], names=["text"]), limit=2**19):
        yield [t or "" for t in some.column(0).to_pylist()]


def sketch(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(doc_id, fp, size, bands) of each row: the fingerprint of its shingles and its band keys."""
    schema = pa.struct([("fp", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("fp binary, size long, bands array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for part in some_texts(batch):
                sets = weighted_sets(part, weighted)
                for (s, w), text, keys in zip(sets, part, band_keys(signatures(sets))):
                    body = s.tobytes() + w.tobytes() if len(s) else b"raw" + text.encode("utf-8", "replace")
                    rows.append({"fp": hashlib.blake2b(body, digest_size=16).digest(), "size": int(w.sum()), "bands": keys if len(s) else keys[:0]})
            yield pa.array(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("_s")).select("doc_id", "_s.*")


def elements(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one, sorted: the repeats of a shingle count as different elements."""
    number = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return np.sort(mix(np.repeat(s, w) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def bitmap(s: np.ndarray) -> np.ndarray:
    flags = np.zeros(64 * LONGS, np.uint8)
    flags[s % np.uint64(64 * LONGS)] = 1
    return np.packbits(flags).view(np.int64)


def element_sets(texts: DataFrame, weighted: bool) -> DataFrame:
    """(id, version, n, s, bits): the packed elements of each text, their number and their bitmap.

    Shingles are taken from a candidate's text once; all that follows works on these sets.
    """
    schema = pa.struct([("s", pa.binary()), ("bits", pa.list_(pa.int64()))])

    @F.arrow_udf("s binary, bits array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for some in some_texts(batch):
                sets = [elements(s, w) for s, w in weighted_sets(some, weighted)]
                parts.append(pa.array([{"s": s.tobytes(), "bits": bitmap(s)} for s in sets], schema))
            yield pa.concat_arrays(parts) if parts else pa.array([], schema)

    rows = texts.select("id", "version", run("text").alias("e"))
    return rows.select("id", "version", (F.octet_length("e.s") / 8).cast("int").alias("n"), "e.s", "e.bits")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 0.0


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose exact similarity is at least `least`."""

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        return pa.array([similarity(read(x), read(y)) >= least for x, y in zip(left, right)], pa.bool_())

    side = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(near("s_a", "s_b")).select("a", "b").distinct()


def prefix_pairs(ids: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes among the given (id, class) that can have the similarity.

    Of n elements in any common order, the first n - ceil(least x n) + 1 hold one that both
    texts share. In the order of rarity these are mostly a text's own, so texts that share a
    frequent passage, or differ a little too much, rarely meet. Before a pair is made, two
    bounds on what the two can share must allow it: from the places of the element in both
    orders, as nothing before the first shared one is shared, and from a bitmap of the
    elements. Both are exact, so they lose no pair. Bitmaps join the few elements of a prefix
    that others have too; the many rows that are counted and ordered hold ids and elements.
    """

    @F.arrow_udf("array<long>")
    def unpacked(batch: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch], pa.list_(pa.int64()))

    known = checkpoint(sets.join(ids, "id"))
    rows = checkpoint(known.select("id", "version", F.explode(unpacked("s")).alias("s")))
    counts = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # an element that no other text has is in no pair, but it takes its place in the order: the first
    ordered = rows.join(counts, "s", "left").select("id", "version", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s").alias("e"))
    shared = ordered.groupBy("id", "version").agg(
        F.sort_array(F.collect_list(F.when(F.col("e.df") > 1, F.col("e")))).alias("shared"), F.count_if(F.col("e.df") == 1).alias("alone")
    )
    first = F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1 - F.col("alone")
    bits = [f"bits{i}" for i in range(LONGS)]
    rare = shared.where("size(shared) > 0").join(known.drop("s"), ["id", "version"]).where(first > 0)
    rare = rare.select("id", "class", "n", "alone", *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(bits)], F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))).alias("at", "e"))
    rare = checkpoint(rare.select("id", "class", "n", *bits, "e.s", (F.col("n") - F.col("alone") - F.col("at")).alias("left")))
    x, y = (rare.select("s", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "left", "class", *bits)]) for side in "ab")
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least)
    # every bit of one text that the other lacks is an element that they do not share
    only = lambda p, q: sum((F.bit_count(F.col(f"{c}_{p}").bitwiseAND(F.bitwise_not(F.col(f"{c}_{q}")))) for c in bits), F.lit(0))
    both = F.least("left_a", "left_b", F.col("n_a") - only("a", "b"), F.col("n_b") - only("b", "a"))
    enough = both * F.lit(1 + least) >= (F.col("n_a") + F.col("n_b")) * F.lit(least) - F.lit(1e-6)
    return x.join(y, "s").where("class_a < class_b").where(fits & enough).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def groups(edges: DataFrame) -> DataFrame:
    """(id, class) of every id in an edge; the class is the smallest id of its connected component.

    Every round takes the smallest label of the neighbours and then the label of that label,
    so the rounds grow with the logarithm of a component's diameter. Each is checkpointed.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("class").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("class", "near").alias("class"), F.col("class").alias("was"))
        jump = step.select(F.col("id").alias("class"), F.col("class").alias("next"))
        step = checkpoint(step.join(jump, "class").select("id", F.least("class", "next").alias("class"), "was"))
        if not step.where("class < was").head(1):
            return step.select("id", "class")
        labels = step.select("id", "class")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """`doc_id, class_id` for every row of `docs`.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
    least `least` (with `weighted`, a shingle counts as often as it occurs); classes are the
    connected components, named by their smallest doc_id. Texts with the same shingles are
    one node. Texts of fewer than five words have one shingle, all their words. Texts without
    words (null counts as empty) are in one class only if they are equal as they stand. Rows
    that share a doc_id are one document, in the class that the links of all its texts give;
    a row without doc_id makes no class, it gets that of its shingles or null. An empty table
    gives an empty table.

    Buckets of equal band keys never emit all their pairs. Every bucket first compares its
    members with the most central one, the member that shares buckets with most others. Members
    that are in different classes after that meet by a prefix filter instead, which loses no
    pair: only two texts that share one of their rarest shingles can be so similar. Signatures
    are read from whole texts; only the shingle sets of candidates are shuffled. Counts are
    combined map-side, and joins with hot keys are left to adaptive execution, which splits them.
    """
    sketches = checkpoint(sketch(docs, weighted))
    named = sketches.where(F.col("doc_id").isNotNull())
    nodes = checkpoint(named.groupBy("fp").agg(F.min("doc_id").alias("id")))
    first = named.join(nodes, (named["doc_id"] == nodes["id"]) & (named["fp"] == nodes["fp"]))
    keys = first.select("id", "size", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpoint(keys.join(shared.select("key", "n"), "key"))
    links = members.groupBy("id").agg(F.sum("n").alias("degree"))
    central = F.struct("degree", (-F.col("id")).alias("other"))
    pivots = members.join(links, "id").groupBy("key").agg((-F.max(central)["other"]).alias("pivot"))
    members = members.select("key", "id", "size")
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(least)
    at_pivot = members.select("key", F.col("id").alias("pivot"), F.col("size").alias("pivot_size"))
    sizes = pivots.join(at_pivot, ["key", "pivot"]).distinct()
    star = members.join(sizes, "key").where(F.col("id") != F.col("pivot")).where(fits(F.col("size"), F.col("pivot_size")))
    star = checkpoint(star.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    sets = checkpoint(element_sets(candidate_texts(docs, members), weighted))
    found = checkpoint(verify(star, sets, least))
    classes = groups(found)
    labelled = checkpoint(members.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")))
    mixed = labelled.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    rest = labelled.join(mixed, "key")
    cross = prefix_pairs(rest.select("id", "class").distinct(), sets, least)
    tested = star.select(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("t"))
    cross = cross.withColumn("s", F.least("a", "b")).withColumn("t", F.greatest("a", "b")).join(tested, ["s", "t"], "left_anti")
    more = checkpoint(verify(cross, sets, least))
    # a doc_id with several texts links the nodes of all of them
    of_doc = named.select("doc_id", "fp").join(nodes, "fp").select("doc_id", "id")
    several = of_doc.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    own = of_doc.join(several, "doc_id").select(F.col("id").alias("a"), F.col("lo").alias("b")).where("a <> b")
    classes = groups(found.union(more).union(own))
    node_class = nodes.join(classes, "id", "left").select("fp", F.coalesce("class", "id").alias("class_id"))
    return sketches.select("doc_id", "fp").join(node_class, "fp", "left").select("doc_id", "class_id")


def candidate_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, version, text) of documents that share a bucket with another; repeated rows count once."""
    ids = members.select("id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), "text")
    return rows.join(ids, "id", "left_semi").dropDuplicates(["id", "version"])


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id names its class, with the columns of `docs`."""
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(first, docs["doc_id"] == first["_id"], "left_semi")
