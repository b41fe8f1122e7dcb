"""Phrase collocations from weighted acyclic automata of n-gram counts.

Documents become chunks of word numbers. A chunk sends hashes of its n-grams, and is told which of them can be frequent: the
sum over all chunks decides, so no frequent n-gram is lost. Of those it builds a count automaton from its sorted n-grams. The
automata are cut at phrases into prefix ranges; each range unites its parts and sums their weights. Ranges ask each other
for the counts of parts of their candidates: an acceptor of the wanted phrases is composed with the automaton that has them.
"""

from __future__ import annotations

import gc
from bisect import bisect_left
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import joined, map_rows, materialise, small_batches, to_arrow
from strata.llm.count_automata import Automaton, Phrase, build, compose, union

#: Words of a chunk (of one language; a text is never divided) and of all open chunks of a task.
CHUNK_WORDS, OPEN_WORDS = 2 << 20, 4 << 20
#: About how many n-grams of chunks meet in one task to be summed, and how many entries an automaton of a prefix range unites.
GROUP, RANGE = 4 << 20, 1 << 19
#: Phrases of each sampled chunk that tell where ranges are cut, and chunks of a language that are sampled, at least.
MARKS, SAMPLED = 256, 4
BREAKS, BLANK = b".,;:!?\n\x0b\x0c\r", b"\t"
SPLIT = bytes(10 if c in BREAKS else 32 if c in BLANK else c for c in range(256))
CHUNK = "chunk long, lang string, n_words long, vocab binary, ids binary"
MIX, MASK = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)), np.uint64(0xFFFFFFFF)


class Vocabulary(dict):
    """Numbers words as they come: 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pieces(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with b"\\n" after each piece and b"" here and there."""
    return (text.lower().translate(SPLIT).replace(b"\n", b" \n ") + b" \n").split(b" ")


def chunks(docs: DataFrame) -> DataFrame:
    """Documents as chunks per language: vocab (the words, a line each) and ids (from 1; 0 ends a piece)."""
    small_batches(docs.sparkSession)
    arrow = to_arrow(docs.sparkSession, CHUNK)

    def run(batches):
        number, opened = TaskContext.get().partitionId() << 32, {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            vocab, parts, n = opened.pop(lang)
            ids = np.concatenate(parts)
            row = (number, lang, n, b"\n".join(list(vocab)[2:]), (ids[ids > 0] - 1).astype("<u4").tobytes())
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into = opened.setdefault(lang, [Vocabulary(), [], 0])
                words = pieces(text)
                ids = np.fromiter(map(into[0].__getitem__, words), np.int32, len(words))
                into[1].append(ids)
                into[2] += int((ids > 1).sum())
                if into[2] >= CHUNK_WORDS:
                    yield close(lang)
                elif sum(x[2] for x in opened.values()) >= OPEN_WORDS:
                    yield close(max(opened, key=lambda x: opened[x][2]))
        for lang in list(opened):
            yield close(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, CHUNK)


def ngrams(lang: str, vocab: bytes, ids: bytes, longest: int) -> tuple[list[bytes], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """A chunk's words, its word numbers, and for each length n the hashes and the starts of its n-grams."""
    words = vocab.split(b"\n") if vocab else []
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    coded = np.array([0, *(xxhash.xxh3_64_intdigest(w, seed) for w in words)], np.uint64)
    ids = np.frombuffer(ids, "<u4")
    starts, hashes, out = np.flatnonzero(ids), coded[ids], []
    run = hashes[starts]
    for n in range(1, longest + 1):
        if n > 1:
            starts_on = starts + (n - 1)
            inside = starts_on < len(ids)
            inside[inside] = ids[starts_on[inside]] > 0
            starts, run = starts[inside], run[inside]
            run = ((run ^ (run >> np.uint64(29))) * MIX[0] + hashes[starts + (n - 1)]) * MIX[1]
        out.append((n, run ^ (run >> np.uint64(32)), starts))
    return words, ids, out


def dealt(values: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each sorted hash, and 32 bits that tell it from others there; both keep the order."""
    wide = (values >> np.uint64(32)) * np.uint64(groups) + (((values & MASK) * np.uint64(groups)) >> np.uint64(32))
    return (wide >> np.uint64(32)).astype(np.int64), (wide & MASK).astype(np.uint32)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of all, so that the zero bytes compress."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def frequent(table: DataFrame, longest: int, least: int) -> DataFrame:
    """chunk and flags: for each group of hashes which of the chunk's n-grams may occur `least` times in all chunks.

    An n-gram that does always is flagged; one that doesn't is by a collision of hashes alone.
    """
    total = table.agg(F.sum("n_words")).first()[0] or 0
    groups = max(1, -(-total * longest // GROUP))
    small = "<u1" if least < 256 else "<u4"

    def make():
        def handle(batch):
            for chunk, lang, vocab, ids in zip(batch["chunk"], batch["lang"], batch["vocab"], batch["ids"], strict=True):
                values, counts = np.unique(np.concatenate([h for _, h, _ in ngrams(lang, vocab, ids, longest)[2]]), return_counts=True)
                if not len(values):
                    continue
                group, low = dealt(values, groups)
                counts = np.minimum(counts, least).astype(small)
                ends = np.flatnonzero(np.diff(group, append=-1)) + 1
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    yield int(group[a]), chunk, packed(low[a:b]), counts[a:b].tobytes()
        return handle

    sent = map_rows(table, make, "bin long, chunk long, low binary, n binary", chunk=64)

    def meet(rows: pa.Table) -> pa.Table:
        # one bin: about GROUP n-grams of all chunks
        lows, counts = [unpacked(x) for x in rows["low"].to_pylist()], [np.frombuffer(x, small) for x in rows["n"].to_pylist()]
        values, where = np.unique(np.concatenate(lows), return_inverse=True)
        often = np.bincount(where, np.concatenate(counts), len(values)) >= least
        cuts = np.cumsum([len(x) for x in lows])[:-1]
        flags = [np.packbits(f).tobytes() for f in np.split(often[where], cuts)]
        return pa.table({"chunk": rows["chunk"], "bin": rows["bin"], "n": pa.array([len(x) for x in lows], pa.int64()), "flags": pa.array(flags, pa.binary())})

    flags = sent.groupBy("bin").applyInArrow(meet, "chunk long, bin long, n long, flags binary")
    return flags.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "flags"))).alias("flags"))


def key_of(lang: str) -> bytes:
    return quote(lang, safe="").encode()


def frequent_items(row: dict, longest: int) -> list[tuple[Phrase, int]]:
    """A chunk's n-grams that may be frequent, sorted, with their counts."""
    words, ids, grams = ngrams(row["lang"], row["vocab"], row["ids"], longest)
    every = np.concatenate([h for _, h, _ in grams])
    values, counts = np.unique(every, return_counts=True)
    often = np.concatenate([np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=x["n"]) for x in row["flags"]]).astype(bool)
    values, counts = values[often], counts[often]
    if not len(values):
        return []
    # a place of each, by tables of some of the hash's bits; those that fall together in one are looked up in the next
    place, left, shift, mask = np.empty(len(values), np.int64), np.arange(len(values), dtype=np.int32), 0, np.uint64((1 << 22) - 1)
    while len(left):
        slot, table = (values[left] >> np.uint64(shift)) & mask, np.full(1 << 22, -1, np.int32)
        table[slot] = left
        found = table[(every >> np.uint64(shift)) & mask]
        at = np.flatnonzero(found >= 0)
        found = found[at]
        hit = values[found] == every[at]
        place[found[hit]] = at[hit]
        left, shift = left[table[slot] != left], (shift + 21) % 63
    # in order of words: each word counts as its rank, none as 0
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.zeros(len(words) + 1, np.int64)
    rank[np.array(order) + 1] = np.arange(1, len(words) + 1)
    columns, sizes, end = np.zeros((longest, len(values)), np.int64), np.zeros(len(values), np.int64), 0
    for n, _, starts in grams:
        mine = np.flatnonzero((place >= end) & (place < end + len(starts)))
        for j in range(n):
            columns[j, mine] = rank[ids[starts[place[mine] - end] + j]]
        sizes[mine] = n
        end += len(starts)
    by_word = np.lexsort(columns[::-1])
    ranked, key = [b"", *map(words.__getitem__, order)], key_of(row["lang"])
    rows = zip(*([ranked[i] for i in c[by_word].tolist()] for c in columns), strict=True)
    return [((key, *r[:n]), m) for r, n, m in zip(rows, sizes[by_word].tolist(), counts[by_word].tolist(), strict=True)]


def by_chunk(rows: DataFrame, handle_one: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Runs handle_one on each row. It makes many small tuples, all of them needed, so the collector of cycles rests meanwhile."""
    def make():
        def handle(batch):
            for row in zip(*batch.values(), strict=True):
                gc.disable()
                try:
                    out = handle_one(dict(zip(batch, row, strict=True)))
                finally:
                    gc.enable()
                yield from out
        return handle

    return map_rows(rows, make, schema, chunk=4)


def cuts_of(table: DataFrame, flags: DataFrame, longest: int) -> list[Phrase]:
    """Phrases at which the order of phrases is cut into ranges of about RANGE entries each.

    Some chunks of each language tell them, by phrases at even distances: more of them the more ranges there will be. They
    only balance the ranges.
    """
    total, n_langs = table.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count_distinct("lang")).first()
    some = max(SAMPLED, total * longest // RANGE // MARKS // max(1, n_langs))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("chunk")))
    known = table.select("chunk", "lang").withColumns({"place": place, "of": F.count("*").over(Window.partitionBy("lang"))})
    sample = known.where(F.col("place") <= some).select("chunk", (F.col("of") / F.least("of", F.lit(some))).alias("weight"))

    def marks(row: dict) -> list[tuple]:
        items = frequent_items(row, longest)
        step = max(1, len(items) // MARKS)
        return [(b"\n".join(p), row["weight"] * step) for p, _ in items[step // 2 :: step]]

    found = by_chunk(joined(table, materialise(sample), "chunk", "inner").join(flags, "chunk"), marks, "mark binary, n double").collect()
    found = sorted((tuple(bytes(m).split(b"\n")), n) for m, n in found)
    entries = sum(n for _, n in found)
    ranges = int(-(-entries // RANGE))
    at, cuts = 0.0, []
    for phrase, n in found:
        at += n
        if at >= entries / ranges * (len(cuts) + 1) and len(cuts) < ranges - 1 and phrase not in cuts[-1:]:
            cuts.append(phrase)
    return cuts


def by_range(items: list[tuple[Phrase, int]], cuts: list[Phrase]) -> Iterator[tuple[int, list]]:
    """Sorted items by prefix range."""
    ends = [bisect_left(items, (c,)) for c in cuts]
    for n, (a, b) in enumerate(zip([0, *ends], [*ends, len(items)], strict=True)):
        if a < b:
            yield n, items[a:b]


def shard_automata(flagged: DataFrame, cuts: list[Phrase], longest: int) -> DataFrame:
    """range and automaton: those of each chunk, of its n-grams that may be frequent."""
    def automata(row: dict) -> list[tuple]:
        return [(n, build(items).dump()) for n, items in by_range(frequent_items(row, longest), cuts)]

    return by_chunk(flagged, automata, "range long, automaton binary")


def range_automata(shards: DataFrame, least: int) -> DataFrame:
    """range and automaton: the union of all shards' automata within the range, of n-grams that occur `least` times."""
    def unite(rows: pa.Table) -> pa.Table:
        often = build((p, n) for p, n in union([Automaton.load(x) for x in rows["automaton"].to_pylist()]) if n >= least)
        return pa.table({"range": rows["range"][:1], "automaton": pa.array([often.dump()], pa.binary())})

    return shards.groupBy("range").applyInArrow(unite, "range long, automaton binary")


def parts_of(phrase: Phrase) -> Iterator[Phrase]:
    """What a candidate needs the counts of: its beginnings, its ends, and all of two words or more inside it."""
    lang, words = phrase[:1], phrase[1:]
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            if b - a < len(words) and (a == 0 or b == len(words) or b - a > 1):
                yield lang + words[a:b]


def part_counts(ranges: DataFrame, cuts: list[Phrase]) -> DataFrame:
    """range and parts: automata of the counts of all parts of the range's candidates.

    A range asks another for each part once, however many candidates have it. A range that is asked much answers in several
    tasks.
    """
    def ask():
        def handle(batch):
            for mine, data in zip(batch["range"], batch["automaton"], strict=True):
                wanted = {part for phrase, _ in Automaton.load(data).items() if len(phrase) > 2 for part in parts_of(phrase)}
                for other, items in by_range([(p, 0) for p in sorted(wanted)], cuts):
                    yield other, mine, len(items), build(items).dump()
        return handle

    asked = materialise(map_rows(ranges, ask, "range long, asks long, n long, wanted binary", chunk=16))
    tasks = materialise(asked.groupBy("range").agg(F.ceil(F.sum("n") / (4 * RANGE)).alias("tasks")))  # a row per range
    own = joined(ranges, tasks, "range", "inner").select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("long").alias("asks"), F.col("automaton").alias("data"))
    rows = joined(asked, tasks, "range", "inner").select("range", F.pmod(F.xxhash64("asks"), "tasks").alias("task"), "asks", F.col("wanted").alias("data"))

    def answer(rows: pa.Table) -> pa.Table:
        asks, data = rows["asks"].to_pylist(), rows["data"].to_pylist()
        counts = Automaton.load(data[asks.index(None)])
        told = [(a, build(compose(Automaton.load(x), counts)).dump()) for a, x in zip(asks, data, strict=True) if a is not None]
        return pa.table({"range": pa.array([a for a, _ in told], pa.int64()), "part": pa.array([x for _, x in told], pa.binary())})

    answers = own.unionByName(rows).groupBy("range", "task").applyInArrow(answer, "range long, part binary")
    return answers.groupBy("range").agg(F.collect_list("part").alias("parts"))


def scored(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score and inside (phrases within it that it makes superfluous) of each candidate."""
    def make():
        def handle(batch):
            for data, told in zip(batch["automaton"], batch["parts"], strict=True):
                counts = {p: n for x in told for p, n in Automaton.load(x).items()}
                for phrase, a in Automaton.load(data).items():
                    if len(phrase) < 3:
                        continue
                    ways = ((counts[phrase[:k]], counts[phrase[:1] + phrase[k:]]) for k in range(2, len(phrase)))
                    score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(ways))
                    inside = [b" ".join(p[1:]).decode() for p in set(parts_of(phrase)) if len(p) > 2 and 100 * a >= 50 * counts[p]]
                    yield unquote(phrase[0].decode()), b" ".join(phrase[1:]).decode(), a, l, r, score, inside
        return handle

    return map_rows(ranges.join(parts, "range"), make, "lang string, phrase string, a long, l long, r long, score long, inside array<string>")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each language with their rank. Parts of a language are ranked first, so that no task ranks it whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n = rows.count()
    while n > 5 * k:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(-(-n // (5 * k))))).orderBy(*order)
        rows = materialise(rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank"))
        n, before = rows.count(), n
        if 4 * n > 3 * before:  # of most parts all are left
            break
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's k best phrases of 2 to `longest` words that occur `least` times.

    docs: text (null: empty) and lang (null: und); other columns are ignored. A-Z is lower-cased. Pieces end at .,;:!? and line
    ends, words at blanks and tabs; a phrase lies within a piece. a is its count, overlaps included; l and r are those of its
    parts at the cut that scores least (ties: the first); the score is floor(1000000 a a / (l r)), exact. A phrase inside a
    longer candidate that has at least half its count is left out. Repeated rows count each time; an empty table, or one
    without frequent phrases, gives no rows. Texts are read whole; a text's words are held by one task.

    Runs jobs: chunks, shard automata, ranges and candidates are written to the shared folder.
    """
    table = materialise(chunks(docs))
    flags = materialise(frequent(table, longest, least))
    cuts = cuts_of(table, flags, longest)
    ranges = materialise(range_automata(shard_automata(table.join(flags, "chunk"), cuts, longest), least))
    found = materialise(scored(ranges, part_counts(ranges, cuts)))
    gone = found.select("lang", F.explode("inside").alias("phrase")).distinct()
    left = materialise(found.drop("inside").join(gone, ["lang", "phrase"], "left_anti"))
    totals = materialise(table.groupBy("lang").agg(F.sum("n_words").alias("n")))
    return joined(top(left, k), totals, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# DuckDB SQL for collocations' rows over `documents`, with the default lengths, least count and k.
COLLOCATIONS_SQL = r"""
with d as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from d),
g as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase from w, (select unnest([1, 2, 3]) m) where len(w) >= m),
f as (select lang, m, phrase, count(*) f from g group by all),
n as (select lang, sum(f)::bigint n from f where m = 1 group by 1),
c as (select lang, m, phrase, f a, string_split(phrase, ' ') p from f where m > 1 and f >= 10),
cuts as (select lang, m, phrase, a, k, array_to_string(p[:k], ' ') one, array_to_string(p[k + 1:], ' ') two from (select *, unnest(range(1, m)) k from c)),
s as (select cuts.*, x.f l, y.f r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) score from cuts join f x on x.lang = cuts.lang and x.m = k and x.phrase = one join f y on y.lang = cuts.lang and y.m = cuts.m - k and y.phrase = two),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select distinct b.lang, b.phrase from c b join (select lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) phrase from c where m = 3) t on t.lang = b.lang and t.phrase = b.phrase and 100 * t.a >= 50 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score::bigint score
from best join n using (lang) where (lang, phrase) not in (select (lang, phrase) from inside) qualify rank <= 2000
"""
