"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. Its signature comes from Poisson processes over (shingle, weight
level): levels are grouped in blocks that double in width, each block has one process whose rate is its width, each
point gets a level in its block, drawn at once by 24 bits, and a register, and counts only if the level is below the
shingle's count.
The first counting point of a register is the same for two documents with the probability of their weighted Jaccard
similarity. Only the earliest points are made: time goes on just until every register has one.

Registers are banded; documents that share a band are compared by their multisets. Inside a band's bucket documents are
compared with a hub at first, then only those that are still in different groups, so that a bucket of many copies
costs about its size, and no link that would join two groups is left out.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import joined, map_rows, materialise, part_of, parted
from strata.llm.line_dedup import hash_words, mixed

SHINGLE, SIMILAR = 5, 0.8
#: 20 bands of 4 registers find a pair of similarity 0.8 with probability 1 - 3e-5.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
MASKS = 8
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the five-word shingles, sorted, and their counts. Fewer words are one shingle."""
    h = hash_words(words)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = mixed(out + h[i : i + n] + GOLD)
    return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of REGISTERS 64-bit numbers for each non-empty bag (keys, counts)."""
    sizes = np.array([int(c.sum()) for _, c in bags])
    doc = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    key, count = np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags])
    # Blocks: [0, 1), [1, 2), [2, 4), [4, 8) ...; an element has those that start below its count.
    seeds, docs, rates, starts, counts = [], [], [], [], []
    start, width = 0, 1
    while (has := count > start).any():
        seeds.append(mixed(key[has] ^ mixed(np.array([start + 1], np.uint64))))
        docs.append(doc[has])
        counts.append(count[has])
        rates.append(np.full(int(has.sum()), width, np.float64))
        starts.append(np.full(int(has.sum()), start))
        start, width = start + width, max(1, start + width)
    seed, doc, rate, start, count = (np.concatenate(x) for x in (seeds, docs, rates, starts, counts))
    until = np.log(50 * REGISTERS) * REGISTERS / sizes
    time, step = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    best, value = np.full(len(bags) * REGISTERS, np.inf), np.zeros(len(bags) * REGISTERS, np.uint64)
    live = np.arange(len(seed))
    waiting: list[np.ndarray] = []
    while True:
        while len(live):
            bits = mixed(seed[live] + step[live] * GOLD)
            gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate[live]
            at = time[live] + gap
            early = at < until[doc[live]]
            waiting.append(live[~early])
            live, at, bits = live[early], at[early], bits[early]
            time[live] = at
            step[live] += np.uint64(1)
            mark = mixed(bits ^ GOLD)
            level = start[live] + ((mark >> np.uint64(40)).astype(np.float64) / (1 << 24) * rate[live]).astype(np.int64)
            counts_in = level < count[live]
            slot = doc[live][counts_in] * REGISTERS + ((mark[counts_in] & np.uint64(0xFFFFFFFF)) % np.uint64(REGISTERS)).astype(np.int64)
            when = at[counts_in]
            np.minimum.at(best, slot, when)
            first = best[slot] == when
            value[slot[first]] = mark[counts_in][first]
        lacking = np.isinf(best).reshape(len(bags), REGISTERS).any(axis=1)
        if not lacking.any():
            return value.reshape(len(bags), REGISTERS)
        until[lacking] *= 2
        later = np.concatenate(waiting)
        here = lacking[doc[later]]
        live, waiting = later[here], [later[~here]]


def band_keys(signature: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD
    by_band = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(out, by_band.shape[:2]).copy()
    for i in range(ROWS):
        out = mixed(out + by_band[:, :, i])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the words, n (shingles) and bands of each document; without words the last three are null."""
    def make():
        def handle(batch):
            rows = [(doc, part, text.encode("utf-8", "replace").split()) for doc, part, text in zip(batch["doc_id"], batch["part"], batch["text"], strict=True)]
            yield from ((doc, part, None, None, None) for doc, part, words in rows if not words)
            rows = [row for row in rows if row[2]]
            while rows:  # about as many words at a time, however long the texts
                k, size = 0, 0
                while k < len(rows) and (k == 0 or size + len(rows[k][2]) < 150_000):
                    size += len(rows[k][2])
                    k += 1
                some, rows = rows[:k], rows[k:]
                bags = [shingles(words) for *_, words in some]
                bands = band_keys(signatures(bags))
                for (doc, part, words), (_, counts), own in zip(some, bags, bands, strict=True):
                    yield doc, part, xxhash.xxh3_128_digest(b" ".join(words)), int(counts.sum()), own
        return handle

    return map_rows(docs.select("doc_id", "part", "text"), make, "doc_id long, part long, hash binary, n long, bands array<long>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """The overlap of two multisets of shingles, and the keys of b of which a has fewer."""
    (ka, ca), (kb, cb) = a, b
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    short = np.ones(len(kb), bool)
    short[j] = ca[i] < cb[j]
    return int(np.minimum(ca[i], cb[j]).sum()), kb[short]


def compared(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes a_n and b_n, the overlap `both`, and 64 * MASKS bits of which shingles of b a lacks.

    A text goes along once a pair, from which the multisets are made again: they are larger.
    """
    with_a = pairs.join(candidates.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(candidates.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        def handle(batch):
            for a, b, *text in zip(*(batch[c] for c in ("a", "b", "text_a", "text_b")), strict=True):
                bag_a, bag_b = (shingles(t.encode("utf-8", "replace").split()) for t in text)
                common, lacks = overlap(bag_a, bag_b)
                mask = np.zeros(MASKS, np.uint64)
                np.bitwise_or.at(mask, (lacks % np.uint64(MASKS)).astype(np.int64), np.uint64(1) << (lacks >> np.uint64(32)) % np.uint64(64))
                yield a, b, int(bag_a[1].sum()), int(bag_b[1].sum()), common, *mask.view(np.int64).tolist()
        return handle

    return map_rows(both, make, f"a long, b long, a_n long, b_n long, both long, {', '.join(f'm{i} long' for i in range(MASKS))}")


def similar_pairs(found: DataFrame, similar: float) -> DataFrame:
    return found.where(F.col("both") >= similar * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, group (its smallest node) of the nodes in links (a, b): least labels spread along links and by jumps."""
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("group")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), F.col("group").alias("g")), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("g"))
        step = labels.join(near, "node").select("node", F.least("group", "g").alias("next"), F.col("group").alias("was"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("group").alias("far")), "next", "left")
        new = materialise(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("group"), "was"))
        labels = new.select("node", "group")
        if new.where("group != was").limit(1).count() == 0:
            return labels


def lone_shingles(candidates: DataFrame) -> DataFrame:
    """node, alone: how many of the node's shingles (with repeats) no other candidate has."""
    def make():
        def handle(batch):
            for node, text in zip(batch["node"], batch["text"], strict=True):
                keys, counts = shingles(text.encode("utf-8", "replace").split())
                yield from zip([node] * len(keys), keys.view(np.int64).tolist(), counts.tolist(), strict=True)
        return handle

    rows = map_rows(candidates, make, "node long, key long, n int")
    alone = rows.groupBy("key").agg(F.count("*").alias("docs"), F.first("node").alias("node"), F.first("n").alias("n")).where("docs = 1")
    return alone.groupBy("node").agg(F.sum("n").alias("alone"))


def links(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every, classes, labels): doc_id, part and hash of each row of docs (as of parted); hash, node and first (doc_id and
    part of the smallest row) of each text, by its words; node and group of nodes with links. Nodes are any numbers.

    Pairs that share a band are compared unless an upper bound of their overlap is too small, and these bounds are exact:
    a shingle that no other candidate has is in no overlap; and what two documents lack of the hub that both were
    compared with, they can't have in common.
    """
    every = materialise(signed(docs))
    by_text = every.where("hash is not null").groupBy("hash").agg(F.min(F.struct("doc_id", "part")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialise(by_text.withColumn("node", F.monotonically_increasing_id()))  # written, so they don't change any more
    buckets = classes.select("node", "n", F.explode(F.array_distinct("bands")).alias("key"))
    full = materialise(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = materialise(joined(buckets, full, "key", "inner"))
    nodes = materialise(members.select("node").distinct())
    rows = materialise(joined(classes, nodes, "node", "left_semi").select("node", "first.doc_id", "first.part"))
    candidates = materialise(joined(docs, rows, ["doc_id", "part"], "inner").select("node", "text").dropDuplicates(["node"]))
    members = joined(members, materialise(lone_shingles(candidates)), "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    share = similar / (1 + similar)
    members = members.where(F.col("most") >= similar * F.col("n") - 1e-6)  # overlap >= share * (n + similar * n) at least
    members = materialise(members.join(members.groupBy("node").agg(F.sum("size").alias("degree")), "node").drop("size"))

    # First each node with the hub of largest degree that it meets.
    best = to_hub(members).groupBy("a").agg(F.max(F.struct("b_degree", "b")).alias("hub")).select("a", F.col("hub.b").alias("b"))
    with_hub = materialise(compared(best, candidates))
    linked, tested = similar_pairs(with_hub, similar), with_hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = components(linked)
    masks = [f"m{i}" for i in range(MASKS)]
    seen = with_hub.dropDuplicates(["a"]).select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("b_n").alias("hub_n"), (F.col("a_n") - F.col("both")).alias("extra"), *masks)
    members = materialise(members.join(seen, "node", "left").withColumn("extra", F.col("extra") - F.coalesce("alone", F.lit(0))))
    carried = ["node", "n", "most", "hub", "hub_n", "extra", "group", *masks]
    lack = sum((F.bit_count(F.col(f"a_{m}").bitwiseOR(F.col(f"b_{m}"))) for m in masks), F.lit(0))
    by_hub = F.col("a_hub").isNull() | F.col("b_hub").isNull() | (F.col("a_hub") != F.col("b_hub")) | (F.col("a_hub_n") - lack + F.least("a_extra", "b_extra") >= share * (F.col("a_n") + F.col("b_n")) - 1e-6)
    able = (F.least("a_most", "b_most") >= share * (F.col("a_n") + F.col("b_n")) - 1e-6) & by_hub

    # Then every bucket's hub, for nodes still in another group; at last any pair of a bucket still in two groups, which
    # are the nodes outside the bucket's largest group with all others.
    for last in (False, True):
        now = members.join(labels, "node", "left").withColumn("group", F.coalesce("group", "node"))
        sizes = now.groupBy("key", "group").agg(F.count("*").alias("m"), F.max(F.struct("degree", "node")).alias("top"))
        open_keys = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("m", "group")).alias("most"), F.max("top").alias("top")).where("k > 1")
        now = materialise(joined(now, materialise(open_keys.select("key", F.col("most.group").alias("largest"), "top")), "key", "inner"))
        a, b = (now.select("key", "largest", "top", *(F.col(c).alias(f"{side}_{c}") for c in carried)).withColumnRenamed("key", f"{side}_key") for side in "ab")
        if last:
            a, b = a.where("a_group != largest"), b.drop("largest", "top")
            which = (F.col("b_group") == F.col("largest")) | (F.col("a_node") < F.col("b_node"))
        else:
            b, which = b.where("b_node = top.node").drop("largest", "top"), F.lit(True)
        pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_group") != F.col("b_group")) & which & able)
        pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        more = materialise(similar_pairs(compared(pairs, candidates), similar))
        if more.limit(1).count():
            linked = linked.union(more)
            labels = components(linked)
    return every.select("doc_id", "part", "hash"), classes.select("hash", "node", "first"), labels


def to_hub(members: DataFrame) -> DataFrame:
    """(a, b, b_degree): each node with the hub, the node of largest degree, of each of its buckets."""
    hubs = materialise(members.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub"))
    return joined(members, hubs, "key", "inner").where("node != hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("hub.degree").alias("b_degree"))


def classified(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, part, class (doc_id and part of the first row of its group) and text_id of each row with an id."""
    every, classes, labels = links(parted(docs), similar)
    named = labels.join(classes.select("node", "first"), "node")
    firsts = named.groupBy("group").agg(F.min("first").alias("class"))
    groups = materialise(named.select("node", "group").join(firsts, "group").select("node", "class"))
    by_text = joined(classes, groups, "node", "left").select("hash", F.coalesce("class", "first").alias("class"), F.col("first.doc_id").alias("text_id"))
    found = every.join(by_text, "hash").select("doc_id", "part", "class", "text_id")
    alone = every.where("hash is null").select("doc_id", "part", F.struct("doc_id", "part").alias("class"), F.col("doc_id").alias("text_id"))
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the smallest id of the document's group) and text_id (the smallest id with the same words).

    docs: doc_id, text; other columns are ignored. Words are split at ASCII white space, whole texts count, however long.
    Groups are the connected components of pairs with a weighted Jaccard similarity of at least `similar`, so two of a
    group may be less alike than that. Texts without words (null, empty) are each a class of their own. A row per row of
    docs: rows that repeat an id are judged each by its own text; a null id has null classes and takes no part. An empty
    table gives an empty one.
    """
    rows = classified(docs, similar).select("doc_id", F.col("class.doc_id").alias("class_id"), "text_id")
    return rows.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id")))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that are the first of their group, by id, then by text; rows with null ids stay.

    A group is a chain of similar documents: a member goes with it even if it is unlike the one that stays. Rows of equal
    id and text are one document, and stay or go together.
    """
    gone = classified(docs, similar).where((F.col("doc_id") != F.col("class.doc_id")) | (F.col("part") != F.col("class.part")))
    gone = materialise(gone.select(F.col("doc_id").alias("__gone"), F.col("part").alias("__of")).distinct())
    rows = docs.withColumn("__part", part_of("text"))
    return joined(rows, gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__part") == F.col("__of")), "left_anti").drop("__part")
