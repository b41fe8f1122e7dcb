"""Line deduplication: a deletion-neighbourhood join over the words of lines.

Two lines are near if one word is replaced, added or left out (word edit distance 1), or none. A line's deletion
variants are the line without its i-th word. Two lines of n words differ in word i alone if and only if they have the
same variant at i; a line of n words is another's n + 1 words without one if its whole is a variant of that other. So
equal hashed keys find the partners, without pairs inside a group: a key's earliest line of a role is enough.

Most lines have no partner, and variants of them would be wasted. As one edit leaves one half of a line as it is, lines
first exchange hashes of their halves, and only lines that share a half with another emit variants; no partner is lost.

With `per`, the bound grows: one word per `per` words of the shorter line, one at least. A line of n words has too many
variants inside a bound of k words, so lines of two edits or more emit variants that stand for all of them: words are dealt
to 2 * k + 1 classes by their hash, and a variant is the line without all words but those of one class, in any order. Words
that repeat in a line are numbered, and a word with its number is what is dealt, so hardly a class is empty; an edit
takes one such word away, adds one, or both. So it changes the words of two classes at most, and lines within k edits have
one class in common. It holds some ten words of all over the line, so lines that just share a passage hardly have one. A
line meets the earliest line of each of its keys, where lengths and parity masks of words (an edit flips two bits at most)
drop pairs inside the join; what is left is verified. So a group of a key costs its size where its lines are near the
earliest. What is left may be near a later holder of its keys only: with `rounds=None` it meets all of them, so no near line
is missed. Holders of a key of FEW or fewer later ones all meet each other. In larger groups, which may hold many lines that
lie just beyond the bound of each other, lines are told apart by their differences from the earliest holder: the numbered
words that just one of the two has. What two lines differ in is what their differences differ in, so in any order of words
that both keep to, lines within k edits share one of the first k + 1 words of the smaller difference and of the first
2 * k + 1 of the larger (those who share none have few, and meet in a mark that all have). In order of how many of the group
have them, rarest first, these are a line's own edits, so lines that differ from the earliest each in its own way don't meet.
What still costs the square of a group is lines of the same words in other orders, and those about as near each other as
their bound. `rounds=n` meets n holders alone.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import joined, map_columns, map_rows, materialise, part_of, parted

#: Lines of fewer words are compared for equality alone: one word of four is a similarity under 0.8, another line.
MIN_WORDS = 5
#: The query's `per`: one edit for so many words.
PER = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters of documents whose words a Python worker has at a time.
AT_ONCE = 1 << 20
SAME, WHOLE, LESS = 0, 1, 2
MASKS = 4
#: Later holders of a key that all meet each other; those of larger groups meet by their differences from the earliest.
FEW = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def hash_words(words: list[bytes], some: int = 1 << 15) -> np.ndarray:
    """64-bit hashes of words (not empty), some at a time: sums of their bytes, each times an odd number of its place."""
    out = np.zeros(len(words), np.uint64)
    for at in range(0, len(words), some):
        part = words[at : at + some]
        data, n = np.frombuffer(b"".join(part), np.uint8), np.fromiter(map(len, part), np.int64, len(part))
        start = np.cumsum(n) - n
        odd = mixed(np.arange(1, n.max() + 1).astype(np.uint64)) | np.uint64(1)
        place = np.arange(len(data)) - np.repeat(start, n)
        out[at : at + len(part)] = mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * odd[place], start) + n.astype(np.uint64))
    return out


def numbered(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of words with their number among the equal words of their line, in some order in each line of n words.

    So words that repeat are unlike, and an edit still takes one away and adds one at most: the last of its equals.
    """
    of = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    part = (of << np.uint64(44)) | (h >> np.uint64(20))  # sorts faster than both
    order = np.argsort(part)
    part, own = part[order], h[order]
    if len(n) >> 20 or ((part[1:] == part[:-1]) & (own[1:] != own[:-1])).any():  # too many lines, or unlike words with like parts
        order = np.lexsort((h, of))
        part, own = of[order], h[order]
    first = np.ones(len(own), bool)
    first[1:] = (part[1:] != part[:-1]) | (own[1:] != own[:-1])
    at = np.arange(len(own))
    return mixed(own + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * BASE)


class Lines:
    """Hashes of many lines at once; a line's sum over words of hash * BASE ** position gives those of its parts.

    Sums run on from line to line, modulo 2 ** 64, so a part's sum is a difference of two.
    """

    def __init__(self):
        self.up, self.down = powers(BASE, 4096), powers(INVERSE, 4096)

    def sums(self, lines: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Words of each line, where it starts, the position of each word in its line, the running sums, and the words' hashes."""
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        start = np.cumsum(n) - n
        longest = int(n.max(initial=0))
        if longest >= len(self.up):
            self.up, self.down = powers(BASE, 2 * longest), powers(INVERSE, 2 * longest)
        at = np.arange(n.sum()) - np.repeat(start, n)
        h = hash_words(list(chain.from_iterable(lines)))
        return n, start, at, np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[at], dtype=np.uint64)]), h

    def halves(self, lines: list[list[bytes]], least: int, sums: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many keys each line has, and the keys: of its two halves, for partners of which the shorter has n or n - 1 words."""
        n, start, _, run, _ = sums or self.sums(lines)
        keys, has = np.zeros((len(n), 4), np.uint64), np.zeros((len(n), 4), bool)
        for i, c in enumerate((n, n - 1)):
            c = np.maximum(c, 0)
            half, skip = c // 2, n - (c - c // 2)
            keys[:, 2 * i] = (run[start + half] - run[start]) ^ (2 * c).astype(np.uint64)
            keys[:, 2 * i + 1] = ((run[start + n] - run[start + skip]) * self.down[skip]) ^ (2 * c + 1 << 32).astype(np.uint64)
            has[:, 2 * i] = has[:, 2 * i + 1] = c >= least
        return has.sum(axis=1), mixed(keys[has]).view(np.int64)

    @staticmethod
    def classes(n: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many keys each line of n words has, and the keys: of the words (their hashes h, in a row; see numbered) of each of
        its 2 * bound + 1 classes; none for bound 0."""
        n_classes = np.where(bounds > 0, 2 * bounds + 1, 0)
        base, size = np.cumsum(n_classes) - n_classes, int(n_classes.sum())
        of = np.repeat(np.arange(len(n)), n)
        if (bounds == 0).any():
            some = n_classes[of] > 0
            of, h = of[some], h[some]
        at = base[of] + ((mixed(h ^ BASE) >> np.uint64(32)).astype(np.int64) % n_classes[of])
        # sums of 32-bit halves are exact in doubles, up to 2 ** 21 words of a line
        low, high = (np.bincount(at, part.astype(np.float64), size).astype(np.uint64) for part in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)))
        which = (np.arange(size) - np.repeat(base, n_classes) + (np.repeat(n_classes, n_classes) << 32)).astype(np.uint64)
        return n_classes, (mixed(mixed(low + which * BASE) + high) | np.uint64(1)).view(np.int64)

    def keys(self, lines: list[list[bytes]], least: int, per: int | None) -> tuple[list[np.ndarray], pa.ListArray]:
        """The parity masks (MASKS columns of 64 bits) of each line's words, and its keys: even ones of halves, for partners within one word, odd ones of
        classes, for larger bounds.

        The bound of a pair is that of its shorter line, so a line of n words has keys for n // per, and for each smaller
        bound of a line so short that the difference of lengths is inside it.
        """
        n, start, _, _, h = every = self.sums(lines)
        h = numbered(n, h) if per else h
        bits = mixed(h)
        bit, which = np.uint64(1) << (bits & np.uint64(63)), (bits >> np.uint64(6)) % np.uint64(MASKS)
        masks = [np.bitwise_xor.reduceat(np.where(which == i, bit, np.uint64(0)), start).view(np.int64) if len(n) else np.zeros(0, np.int64) for i in range(MASKS)]
        sizes, halves = self.halves(lines, least, every)
        of, found = [np.repeat(np.arange(len(n)), sizes)], [halves & ~np.int64(1)]
        bound = n // per if per else np.zeros(len(n), np.int64)
        while (has := (n >= least) & (bound >= 2)).any():
            sizes, keys = self.classes(n, h, np.where(has, bound, 0))
            of.append(np.repeat(np.arange(len(n)), sizes))
            found.append(keys)
            longest = per * bound - 1  # of the lines of the next smaller bound
            bound = np.where(n - longest <= bound - 1, bound - 1, 0)
        of, found = np.concatenate(of), np.concatenate(found)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int32)
        return masks, pa.ListArray.from_arrays(ends, pa.array(found[np.argsort(of, kind="stable")]))

    def variants(self, lines: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, role, key): role SAME meets SAME for partners of as many words, WHOLE meets LESS for those of one more."""
        n, start, at, run, _ = self.sums(lines)
        of, word = np.repeat(np.arange(len(n)), n), np.arange(len(at))
        without = (run[word] - run[start[of]]) + (run[(start + n)[of]] - run[word + 1]) * INVERSE
        size = n.astype(np.uint64) << np.uint64(32)
        same = mixed(without + size[of]) ^ mixed((at + 1).astype(np.uint64))
        whole = mixed(run[start + n] - run[start] + size + np.uint64(1))
        longer = np.flatnonzero(n[of] > least)
        less = mixed(without[longer] + (size - np.uint64(1 << 32))[of[longer]] + np.uint64(1))
        role = np.repeat([SAME, WHOLE, LESS], [len(same), len(whole), len(less)])
        return np.concatenate([of, np.arange(len(n)), of[longer]]), role, np.concatenate([same, whole, less]).view(np.int64)


def near(a: list, b: list) -> bool:
    """Is the edit distance of two lists at most 1?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def within(a: list, b: list, k: int) -> bool:
    """Is the edit distance of two lists at most k? By the furthest place on each diagonal after 0, 1, ... edits, or, if they
    may be many, by columns.

    An edit brings in one word at most that the other list lacks, which is told at once.
    """
    if abs(len(a) - len(b)) > k or len(set(a).difference(b)) > k or len(set(b).difference(a)) > k:
        return False
    if k > 6:
        return within_by_columns(a, b, k)
    far = {}
    for edits in range(k + 1):
        old, far = far, {}
        for d in range(-edits, edits + 1):
            i = max(old.get(d, -2) + 1, old.get(d - 1, -2), old.get(d + 1, -2) + 1) if edits else 0
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            far[d] = i
        if far.get(len(b) - len(a), -1) >= len(a):
            return True
    return False


PLACE = ["doc_id", "part", "line_no"]
MASK = [f"m{i}" for i in range(MASKS)]
PLACED = "doc_id long, part long, line_no int"
FIRST = ["first_doc", "first_part", "first_line"]
PAIRED = f"{PLACED}, first_doc long, first_part long, first_line int"


def within_by_columns(a: list, b: list, k: int) -> bool:
    """As within, by the columns of the table of distances, each as bits: where it is one more, or one less, than a row above."""
    if not a:
        return len(b) <= k
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    every, last, end = (1 << len(a)) - 1, 1 << len(a) >> 1, len(a)  # end: the distance of all of a to the part of b so far
    more, less = every, 0
    for left, x in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = rows.get(x, 0)
        down = ((same & more) + more ^ more) | same
        up, fall = less | every & ~(down | more), more & down
        end += (1 if up & last else 0) - (1 if fall & last else 0)
        if end - left > k:  # a word of b takes one off at most
            return False
        either, up = same | less, up << 1 | 1
        more, less = (fall << 1 | ~(either | up)) & every, up & either
    return end <= k


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").lower().split()


def lines(docs: DataFrame, least: int, per: int | None = None) -> DataFrame:
    """Place, hash of the words (h1, h2), n_words, masks and keys of each line with a word. docs: as of parted."""
    def make():
        from_words = Lines()

        def columns(docs, parts, nos, words):
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(w)) for w in words]), np.int64).reshape(-1, 2)
            masks, keys = from_words.keys(words, least, per)
            return docs, parts, nos, hashes[:, 0], hashes[:, 1], list(map(len, words)), *masks, keys

        def handle(batch):
            some, size = ([], [], [], []), 0
            for doc, part, text in zip(batch["doc_id"], batch["part"], batch["text"], strict=True):
                for i, line in enumerate(text.encode("utf-8", "replace").lower().split(b"\n")):
                    if own := line.split():
                        for values, x in zip(some, (doc, part, i, own), strict=True):
                            values.append(x)
                size += len(text)
                if size >= AT_ONCE:
                    yield columns(*some)
                    some, size = ([], [], [], []), 0
            yield columns(*some)
        return handle

    return map_columns(docs.select("doc_id", "part", "text"), make, f"{PLACED}, h1 long, h2 long, n_words int, {', '.join(f'{m} long' for m in MASK)}, keys array<long>")


def line_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Place and line of the places, which may repeat."""
    some = places.groupBy("doc_id", "part").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))
    wanted = joined(docs, materialise(some), ["doc_id", "part"], "inner")

    def make():
        def handle(batch):
            for doc, part, text, nos in zip(*(batch[c] for c in ("doc_id", "part", "text", "line_nos")), strict=True):
                all_lines = text.split("\n")
                for i in nos:
                    if i < len(all_lines):
                        yield doc, part, i, all_lines[i]
        return handle

    return materialise(map_rows(wanted, make, f"{PLACED}, line string").dropDuplicates(PLACE))


def near_lines(some: DataFrame, least: int) -> DataFrame:
    """The place of each of the lines (place, line; distinct ones) that is within one word of an earlier one, and that one's."""
    def make_keys():
        from_words = Lines()

        def handle(batch):
            of, role, key = from_words.variants([words_of(x) for x in batch["line"]], least)
            yield *(np.array(batch[c], t)[of] for c, t in zip(PLACE, (np.int64, np.int64, np.int32), strict=True)), role, key
        return handle

    keys = map_columns(some, make_keys, f"{PLACED}, role int, key long")
    place = F.struct(*PLACE)
    # A key's lines without a word needn't be near each other, only to the whole; so each role meets the earliest of its own.
    first = keys.groupBy("key").agg(F.min(F.when(F.col("role") == WHOLE, place)).alias("whole"), F.min(F.when(F.col("role") != WHOLE, place)).alias("other"), F.max("role").alias("role"), F.count("*").alias("n"))
    first = materialise(first.where(f"whole is not null and other is not null or role = {SAME} and n > 1").select("key", "whole", "other"))
    met = joined(keys, first, "key", "inner").withColumn("first", F.when(F.col("role") == LESS, F.col("whole")).otherwise(F.col("other")))
    return verified(met.where(F.col("first") < place).select(*PLACE, "first"), some, near)


def verified(pairs: DataFrame, some: DataFrame, test: Callable[[list, list], bool]) -> DataFrame:
    """Those of the pairs (place, first: another place) whose lines (place, line) pass the test."""
    pairs = pairs.select(*PLACE, *(F.col("first")[a].alias(b) for a, b in zip(PLACE, FIRST, strict=True))).distinct()
    both = pairs.join(some, PLACE).join(some.toDF(*FIRST, "other"), FIRST)

    def make():
        def handle(batch):
            for *places, line, other in zip(*(batch[c] for c in (*PLACE, *FIRST, "line", "other")), strict=True):
                if test(words_of(line), words_of(other)):
                    yield tuple(places)
        return handle

    return materialise(map_rows(both, make, PAIRED))


def holders(met: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """key and first: the earliest line of each key, or the one that follows last's."""
    if last is not None:
        met = joined(met, last, "key", "inner").where(F.col("first") < F.col("line")).drop("first")
    return materialise(met.groupBy("key").agg(F.min("line").alias("first")))


def may_be_near(a: Callable[[str], Column], b: Callable[[str], Column], per: int, apart: Column | None = None) -> Column:
    """May two lines, of which a and b give the columns n_words and masks, be within a bound of two words or more? apart: how many
    words they differ in at least.

    k edits of lines whose lengths differ by d replace k - d words at most, so they differ in 2 * k - d words at most, and so
    many bits of the masks.
    """
    x, y = a("n_words"), b("n_words")
    k, d = F.floor(F.least(x, y) / per), F.abs(x - y)
    bits = sum((F.bit_count(a(m).bitwiseXOR(b(m))) for m in MASK), F.lit(0))
    near = (d <= k) & (bits <= 2 * k - d)
    return near if apart is None else (apart <= 2 * k - d) & near


def far_pairs(met: DataFrame, first: DataFrame, per: int) -> DataFrame:
    """Place and first (another place) of lines that may be within a bound of two words or more of the holder of one of their
    keys. met: key and line (place, n_words, masks) of distinct lines; first: key and first, likewise."""
    pairs = joined(met, first, "key", "inner").where((F.col("first") < F.col("line")) & may_be_near(lambda c: F.col(f"line.{c}"), lambda c: F.col(f"first.{c}"), per))
    return materialise(pairs.select(*(F.col("line")[c].alias(c) for c in PLACE), F.struct(*(F.col("first")[c].alias(c) for c in PLACE)).alias("first")).distinct())


def differences(members: DataFrame, some: DataFrame) -> DataFrame:
    """members (line, FIRST: another line's place, left) with the numbered words (hashes) that just one of the two lines has, and
    a mark that all have. some: place and line of both."""
    flat = members.select(*(F.col("line")[c].alias(c) for c in (*PLACE, "n_words", *MASK)), *FIRST, "left")
    both = flat.join(some, PLACE).join(some.toDF(*FIRST, "other"), FIRST)
    kept = [*PLACE, "n_words", *MASK, *FIRST, "left"]

    def make():
        def handle(batch):
            words = [words_of(x) for name in ("line", "other") for x in batch[name]]
            n = np.fromiter(map(len, words), np.int64, len(words))
            h = np.split(numbered(n, hash_words(list(chain.from_iterable(words)))).view(np.int64), np.cumsum(n)[:-1])
            for *own, a, b in zip(*(batch[c] for c in kept), h[: len(h) // 2], h[len(h) // 2 :], strict=True):
                yield *own, [0, *np.setxor1d(a, b, assume_unique=True).tolist()]
        return handle

    return materialise(map_rows(both, make, f"{PLACED}, n_words int, {', '.join(f'{m} long' for m in MASK)}, first_doc long, first_part long, first_line int, left boolean, words array<long>"))


def pairs_by_differences(differing: DataFrame, per: int) -> DataFrame:
    """As far_pairs, of lines (differing: as of differences) that differ from the same one, where the later line is marked left.

    Lines within k edits differ in 2 * k words at most, so the smaller difference has k at most that the larger lacks. Before
    the first word that both have, in any order, stand only words that one has.
    """
    each = differing.select(*PLACE, "n_words", *MASK, *FIRST, "left", F.size("words").alias("size"), F.explode("words").alias("word"))
    shared = materialise(each.groupBy(*FIRST, "word").agg(F.count("*").alias("n")).where("n > 1"))
    own = Window.partitionBy(*FIRST, *PLACE)
    # words that no other line has come first, and no pair meets in them
    rank = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "word"))
    ranked = joined(each, shared, [*FIRST, "word"], "inner").withColumn("rank", rank).where(F.col("rank") <= 2 * F.floor(F.col("n_words") / per) + 1)
    ranked = materialise(ranked.select(*FIRST, "word", F.struct("size", *PLACE, "rank", "n_words", *MASK, "left").alias("b")))
    fewer = ranked.where(F.col("b.rank") <= F.floor(F.col("b.n_words") / per) + 1).withColumnRenamed("b", "a")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    earlier = F.struct(*map(a, PLACE)) < F.struct(*map(b, PLACE))
    apart = a("rank") + b("rank") - 2 + F.abs(a("size") - a("rank") - b("size") + b("rank"))
    ordered = (a("size") < b("size")) | (a("size") == b("size")) & earlier
    on = [*FIRST, "word"]
    met = fewer.where("a.left").join(ranked, on).unionAll(fewer.where("not a.left").join(ranked.where("b.left"), on))  # of two that aren't left, none is asked for
    pairs = met.where(ordered & F.when(earlier, b("left")).otherwise(a("left")) & may_be_near(a, b, per, apart))
    later, before = (F.when(earlier, F.struct(*map(x, PLACE))).otherwise(F.struct(*map(y, PLACE))) for x, y in ((b, a), (a, b)))
    return materialise(pairs.select(later.alias("line"), before.alias("first")).distinct().select("line.*", "first"))


def not_in(met: DataFrame, found: DataFrame) -> DataFrame:
    """met without the lines at the places of found."""
    some = materialise(found.select(*(F.col(c).alias(f"of_{c}") for c in PLACE)).distinct())
    return joined(met, some, F.expr(" and ".join(f"line.{c} = of_{c}" for c in PLACE)), "left_anti")


def large_groups(docs: DataFrame, later: DataFrame, first: DataFrame, large: DataFrame, close: DataFrame, per: int) -> DataFrame:
    """As far_pairs, of lines that aren't in close with the later holders of their large keys. later: the later holders; first: the
    earliest.

    Any line that is one for a whole group will do to differ from. An earliest holder that is a later one of other large keys
    gives way to the earliest of those, so that like groups are one, and their lines meet once.
    """
    of = materialise(joined(first, large, "key", "inner").select("key", *(F.col("first")[a].alias(b) for a, b in zip(PLACE, FIRST, strict=True))))
    members = materialise(joined(later, of, "key", "inner").select("line", *FIRST).distinct())
    way = materialise(members.groupBy(*(F.col("line")[c].alias(c) for c in PLACE)).agg(F.min(F.struct(*FIRST)).alias("to")).join(of.select(*(F.col(a).alias(b) for a, b in zip(FIRST, PLACE, strict=True))).distinct(), PLACE).toDF(*FIRST, "to"))
    members = joined(members, way, FIRST, "left").select("line", *(F.coalesce(F.col("to")[c], c).alias(c) for c in FIRST)).distinct()
    found = materialise(close.select(*(F.col(c).alias(f"of_{c}") for c in PLACE)).distinct())
    members = materialise(joined(members, found, F.expr(" and ".join(f"line.{c} = of_{c}" for c in PLACE)), "left").select("line", *FIRST, F.col("of_doc_id").isNull().alias("left")))
    some = line_texts(docs, members.select(*(F.col("line")[c].alias(c) for c in PLACE)).unionAll(members.select(*FIRST)))
    return pairs_by_differences(differences(members, some), per)


def later_rounds(docs: DataFrame, met: DataFrame, first: DataFrame, close: DataFrame, test: Callable[[list, list], bool], per: int, rounds: int | None) -> DataFrame:
    """close, and pairs of lines that aren't in it with later holders of their keys: the second, the third and so on, a pass
    each, or all at once where rounds is None."""
    def more(found, pairs):
        return materialise(found.unionAll(verified(pairs, line_texts(docs, pairs.select(*PLACE).unionAll(pairs.select("first.*"))), test)))

    if rounds is None:
        later = materialise(joined(met, first, "key", "inner").where(F.col("first") < F.col("line")).select("key", "line"))
        large = materialise(later.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("key"))
        few = joined(later, large, "key", "left_anti")
        pairs = far_pairs(not_in(few, close), few.withColumnRenamed("line", "first"), per)
        if not large.isEmpty():
            pairs = materialise(pairs.unionAll(large_groups(docs, later, first, large, close, per)).distinct())
        return more(close, pairs)
    for _ in range(rounds - 1):
        first = holders(met, first)
        if not first.limit(1).count():
            break
        close = more(close, far_pairs(not_in(met, close), first, per))
    return close


def duplicate_lines(docs: DataFrame, least: int = MIN_WORDS, per: int | None = None, rounds: int | None = 1) -> DataFrame:
    """doc_id, part, line_no (from 0), kind (exact, near) and the earlier line (first_doc, first_line) of every line to drop.

    Lines are parts between newlines, compared by their words (split at ASCII white space, A-Z lower-cased); a line
    without a word is never dropped, and lines may be as long as their texts. Order is by doc_id, then part, then place;
    part is a hash of the text, so rows that repeat an id with another text are documents of their own, and rows that
    repeat id and text are one. A line goes if its words are those of an earlier line, or if it is within its bound of
    edits of the first of some earlier equal lines. The bound is relative: one word for a line of `least` words or more
    (a fifth at most; shorter lines must be equal). An exact copy of a line that goes for being near goes too. per (8 or
    more): the bound is one word for each per words of the shorter line, one at least; bounds of two words or more are held
    against the earliest line of each of the line's keys, in `rounds` rounds against so many earlier ones, and with None
    against all of them (see above).
    """
    if per and per < 8:
        raise ValueError("per must be 8 or more: near lines must share some words in a row")
    docs = parted(docs)
    every, place = materialise(lines(docs, least, per)), F.struct(*PLACE)
    repeated = materialise(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    copies = materialise(joined(every.select(*PLACE, "h1", "h2"), repeated, ["h1", "h2"], "inner"))
    firsts = materialise(copies.groupBy("h1", "h2").agg(F.min(place).alias("first")))
    exact = joined(copies, firsts, ["h1", "h2"], "inner").where(place != F.col("first"))
    once = joined(every, firsts, ["h1", "h2"], "left").where(F.col("first").isNull() | (place == F.col("first")))  # a row per distinct line

    spread = once.select(F.struct(*PLACE, "n_words", *MASK).alias("line"), F.explode("keys").alias("key"))
    shared = materialise(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met = materialise(joined(spread, shared, "key", "inner"))
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    halves = met.where(~odd).select("line.doc_id", "line.part", "line.line_no").distinct()
    pairs = None
    if per:
        first = holders(met.where(odd))
        pairs = far_pairs(met.where(odd), first, per)
        halves = materialise(halves)
    some = line_texts(docs, halves if pairs is None else halves.unionAll(pairs.select(*PLACE)).unionAll(pairs.select("first.*")))
    close = near_lines(some if pairs is None else some.join(halves, PLACE, "left_semi"), least)
    if per:
        far = lambda a, b: within(a, b, min(len(a), len(b)) // per)
        close = close.unionAll(verified(pairs, some, far))
        if rounds != 1:
            close = later_rounds(docs, met.where(odd), first, close, far, per, rounds)
    close = close.groupBy(*PLACE).agg(F.min(F.struct(*FIRST)).alias("first"))
    exact = exact.select(*PLACE, F.lit("exact").alias("kind"), F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))
    return exact.unionByName(close.select(*PLACE, F.lit("near").alias("kind"), "first.first_doc", "first.first_line"))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, per: int | None = None, rounds: int | None = None) -> DataFrame:
    """docs with the text of the lines that stay, and n_lines_dropped, n_lines_near (of these, near ones) and n_lines_kept
    (lines with a word that stay). Unless `rounds` says otherwise, larger bounds are held against all earlier lines.

    docs: doc_id, text; other columns are kept, save of these three names, which are replaced. Rows that repeat an id are
    documents of their own unless their texts are equal too; those are treated alike. A null text stays null; rows with a
    null id stay as they are and take no part; an empty table gives an empty one. A document whose lines all go has an
    empty text.
    """
    drops = duplicate_lines(docs, least, per, rounds).groupBy(F.col("doc_id").alias("__doc_id"), F.col("part").alias("__of")).agg(F.collect_set("line_no").alias("__drop"), F.count_distinct(F.when(F.col("kind") == "near", F.col("line_no"))).alias("__near"))
    rows = docs.withColumn("__part", part_of("text"))
    rows = joined(rows, materialise(drops), (F.col("doc_id") == F.col("__doc_id")) & (F.col("__part") == F.col("__of")), "left")
    # the split text is bound once; places that stay are looked up in it, so the work is linear in lines
    parts = F.array(F.split("text", "\n", -1))
    kept = F.transform(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("__drop")), lambda i: F.get(p, i)), "\n"))[0]
    dropped = F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    with_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    n = {"n_lines_dropped": dropped, "n_lines_near": F.coalesce("__near", F.lit(0)).cast("long"), "n_lines_kept": with_words - dropped}
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)
    return rows.withColumns({"__text": text, **n}).drop("text", "__doc_id", "__of", "__part", "__drop", "__near").withColumnRenamed("__text", "text").select(*docs.drop(*n).columns, *n)
