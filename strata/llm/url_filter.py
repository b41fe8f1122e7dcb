"""URL filters: rules decide where they fit; elsewhere multinomial naive Bayes judges the words of host and path.

Hosts run words together. A unigram model over the words of all pages splits them: the likeliest segmentation by Viterbi.
Pages whose words hold a seed are taken as blocked, all others as allowed; the counts of both kinds over all pages make the
model, so words that go along with seeds count against a host that has none.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BROADCAST_BYTES, bytes_of, joined, map_rows, materialise

# Rules (host, then path) and what they decide.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# Words that mark a url as unwanted where the model is fitted.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "pills", "poker", "porn", "spam", "viagra", "xxx")
#: Words and tokens that are rarer than one in so many are left out of the models, which bounds these.
ONE_IN = 1_000_000
#: Letters of the longest word of the unigram model.
LONGEST = 24
#: Segmentations that a Python worker keeps.
KEPT = 50_000

LOWER = {c: c + 32 for c in range(65, 91)}
END, RUNS = re.compile(r"[/?#]"), re.compile(r"[a-z]+|[0-9]+")
#: Not text: scripts, styles, comments, tags, entities, and names with dots inside, which are hosts or files.
MARKUP = re.compile(rb"<(script|style)\b.*?(?:</\1|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>?|&#?\w{1,31};|(?<![\w.-])[\w-]+(?:\.[\w-]+)+", re.S | re.I)
LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, lower-cased) and path (without query and fragment); both empty if there is no ://."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    end = END.search(rest)
    host, rest = (rest, "") if end is None else (rest[: end.start()], rest[end.start() :])
    return host.translate(LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def word_counts(html: bytes) -> Counter:
    """The words a-z of a page's text."""
    words = Counter(MARKUP.sub(b" ", html).lower().translate(LETTERS).split())
    return Counter({w.decode(): n for w, n in words.items() if w.isalpha() and len(w) <= LONGEST})


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n over the texts of all pages, and over the parts of hyphened host names, once a host."""
    def make():
        def handle(batch):
            seen: Counter = Counter()
            for html in batch["html"]:
                seen.update(word_counts(html or b""))
            yield from seen.items()
        return handle

    def hosts():
        def handle(batch):
            for url in batch["url"]:
                yield (split_url(url)[0],)
        return handle

    names = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "[^a-z]+")))
    parts = map_rows(pages.select("url"), hosts, "host string").distinct().select(F.explode(names).alias("word"), F.lit(1).cast("long").alias("n")).where(F.length("word").between(1, LONGEST))
    texts = map_rows(pages.select(F.col("html").cast("binary").alias("html")), make, "word string, n long", chunk=1 << 16)
    return texts.unionAll(parts).groupBy("word").agg(F.sum("n").alias("n"))


def unigram_costs(words: DataFrame) -> tuple[dict[str, float], float]:
    """Minus the logarithm of each word's share, and the logarithm of the total: of words that make one in ONE_IN, so at most so many."""
    total = words.agg(F.sum("n")).first()[0] or 1
    found = words.where(F.col("n") * ONE_IN >= total).toArrow()
    return {w: log(total) - log(n) for w, n in zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)}, log(total)


def segment(name: str, costs: dict[str, float], total: float) -> list[str]:
    """The likeliest words of a name of letters a-z. An unknown word of n letters counts as 10 / (total * 10**n); of
    segmentations that are alike the one with the longest last word is taken."""
    best, back = [0.0], [0]
    for i in range(1, len(name) + 1):
        least, at = float("inf"), 0
        for j in range(max(0, i - LONGEST), i):
            cost = costs.get(name[j:i])
            cost = best[j] + (total + log(10) * (i - j - 1) if cost is None else cost)
            if cost < least:
                least, at = cost, j
        best.append(least)
        back.append(at)
    words, i = [], len(name)
    while i:
        words.append(name[back[i] : i])
        i = back[i]
    return words[::-1]


class Tokens:
    """The tokens of urls: words of the host with h:, of the path with p:, digits as #."""

    def __init__(self, costs: dict[str, float], total: float):
        self.costs, self.total, self.known = costs, total, {}

    def words(self, text: str) -> list[str]:
        out = []
        for run in RUNS.findall(text):
            if run.isdigit():
                out.append("#")
                continue
            if run not in self.known:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[run] = segment(run, self.costs, self.total)
            out += self.known[run]
        return out

    def __call__(self, host: str, path: str) -> list[str]:
        return [f"h:{w}" for w in self.words(host)] + [f"p:{w}" for w in self.words(path.translate(LOWER))]


def as_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict, rule_host and rule_path of rules (rule, verdict); of a rule that stands twice, block counts."""
    at = F.locate("/", F.col("rule"))
    rules = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    return rules.select("rule", "verdict", F.when(at > 0, F.substr("rule", F.lit(1), at - 1)).otherwise(F.col("rule")).alias("rule_host"), F.when(at > 0, F.substr("rule", at)).otherwise("").alias("rule_path"))


def by_suffix(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best, found = (-1, ""), (None, None)
    while True:
        for start, rule, verdict in rules.get(host, ()):
            if path.startswith(start) and (len(rule), rule) > best:
                best, found = (len(rule), rule), (rule, verdict)
        _, dot, host = host.partition(".")
        if not dot:
            return found


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, rule_verdict of distinct urls that a rule fits, by a join on the ends of hosts: for very many rules."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    some = F.slice(F.reverse(F.split("host", r"\.")), 1, labels)
    ends = F.transform(F.sequence(F.lit(1), F.size(some)), lambda i: F.array_join(F.reverse(F.slice(some, F.lit(1), i)), "."))
    long = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("rule_host"))
    fit = long.join(rules, "rule_host").where(F.startswith("path", "rule_path"))
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    return best.select("host", "path", "best.rule", F.col("best.verdict").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, seeds: tuple[str, ...] = SEEDS, labelled: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict (the rule's, else the model's) and score of each page.

    pages: page_id, url, html (for the unigram model); other columns are ignored. A null url, or one without ://, has an empty
    host and path, which no rule fits unless it has neither. A rule fits its host and subdomains where the path starts with
    its own; the longest wins. score is the logarithm of the odds of block (over 0: block) by naive Bayes over all tokens of
    the url, repeated ones counting each time; a url without tokens has the prior's. The model learns from all pages, block
    where a word is a seed, or from labelled (url, verdict) instead. Repeated rows are judged alike and count each time; null
    and empty html has no words; an empty table gives an empty one. limit: bytes of rules that are given to every worker;
    more are joined.
    """
    spark = pages.sparkSession
    rules = materialise(as_rules(rules if rules is not None else spark.createDataFrame(list(RULES), "rule string, verdict string")))
    small = bytes_of(rules) <= (BROADCAST_BYTES if limit is None else limit)
    by_host: dict[str, list] = {}
    for r in rules.collect() if small else ():
        by_host.setdefault(r["rule_host"], []).append((r["rule_path"], r["rule"], r["verdict"]))
    model = spark.sparkContext.broadcast((unigram_costs(materialise(unigrams(pages))), by_host))

    def make():
        words, rules_of = model.value
        tokens, marks = Tokens(*words), {f"{k}:{s}" for s in seeds for k in "hp"}

        def handle(batch):
            for page_id, url in zip(batch["page_id"], batch["url"], strict=True):
                host, path = split_url(url)
                found = tokens(host, path)
                yield page_id, host, path, *by_suffix(host, path, rules_of), found, not marks.isdisjoint(found)
        return handle

    parsed = materialise(map_rows(pages.select("page_id", "url"), make, "page_id long, host string, path string, rule string, rule_verdict string, tokens array<string>, seeded boolean"))
    if not small:
        fit = materialise(joined_rules(parsed, rules))
        parsed = joined(parsed.drop("rule", "rule_verdict"), fit, ["host", "path"], "left", limit)
    known = parsed.select("tokens", F.col("seeded").alias("block"))
    if labelled is not None:
        known = map_rows(labelled.select(F.lit(0).cast("long").alias("page_id"), "url", "verdict"), lambda: labels_of(make()), "tokens array<string>, block boolean")
    odds = spark.sparkContext.broadcast(fit_odds(materialise(known)))

    def scores():
        prior, of, other = odds.value

        def handle(batch):
            for row in zip(*(batch[c] for c in ("page_id", "host", "path", "rule", "rule_verdict", "tokens")), strict=True):
                score = sum((of.get(t, other) for t in row[5]), prior)
                yield *row[:4], row[4] or ("block" if score > 0 else "allow"), score
        return handle

    return map_rows(parsed.select("page_id", "host", "path", "rule", "rule_verdict", "tokens"), scores, "page_id long, host string, path string, rule string, verdict string, score double")


def labels_of(handle):
    """Rows of the parser, with the given verdict for whether a seed is there."""
    def labelled(batch):
        for row, verdict in zip(handle(batch), batch["verdict"], strict=True):
            if verdict is not None:
                yield row[5], verdict == "block"

    return labelled


def fit_odds(known: DataFrame) -> tuple[float, dict[str, float], float]:
    """Naive Bayes with add-one smoothing: the prior's log odds of block, each token's, and that of all others together.

    Tokens that make one in ONE_IN of all have odds of their own, so at most so many; the rest share one.
    """
    pages = known.agg(F.count("*").alias("n"), F.count_if("block").alias("block")).first()
    counts = materialise(known.select("block", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow")))
    total = counts.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow")).first()
    kept = counts.where((F.col("block") + F.col("allow")) * ONE_IN >= total["block"] + total["allow"]).toArrow()
    columns = [kept[c].to_pylist() for c in ("token", "block", "allow")]
    size = len(columns[0]) + 1
    odds = lambda b, a: log((b + 1) / (total["block"] + size)) - log((a + 1) / (total["allow"] + size))
    rest = odds(total["block"] - sum(columns[1]), total["allow"] - sum(columns[2]))
    return log(pages["block"] + 1) - log(pages["n"] - pages["block"] + 1), {t: odds(b, a) for t, b, a in zip(*columns, strict=True)}, rest
