"""URL filters: fixed rules first, else naive Bayes over the words of host and path.

Names of hosts run words together (cheappills, spam-farm). A unigram model splits them: its words and their counts are those of all
pages' texts and paths, whatever their number, and of the seeds; Viterbi search finds the most probable sequence of words, and letters that no word
covers stay as unknown runs, dearer with every letter. A run of letters is split once, with the words that its own
substrings are (by a join, so no dictionary is broadcast).

Multinomial naive Bayes then scores the words of host and path. Its labels come from seeds, words of blocked sites: pages whose host holds
one are its one class, the rest the other. Seeds are no features of the model that they label; what they say is added by itself
(`seed_odds`), so other words count by the company they keep. Counts of a word are smoothed by one occurrence that is divided like all
words are, so rare words say little, however unequal the classes. The odds of the most frequent words are
broadcast, those of all others joined to the pages that have them.

A null url, or one without "://", has an empty host and path, no rule, and is allowed. Only A-Z are lower-cased.
The longest rule that fits wins (of equally long ones the first given). Repeated rows are judged one by one; long urls are
read whole; null pages' texts teach nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, saved

#: Words of hosts that mark blocked sites.
SEEDS = frozenset("casino pills bets spam ads porn xxx viagra gambling lottery malware phishing warez escort poker slots".split())
#: Letters of a word at most.
LONGEST = 20
UPPER, LOWER = ascii_uppercase, ascii_lowercase


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    there = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        """The rule's host or a subdomain of it, and a path that starts with the rule's."""
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The rule that holds, as text, and its verdict; null without any."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(str(r))):  # the last that fits is outermost, so it wins
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, F.lit(str(rule))).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def word_counts(pages: DataFrame, seeds: frozenset[str] = SEEDS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(word, n): runs of 2 to LONGEST letters in the texts and paths of all pages, in lower case, and the seeds."""
    _, path = host_and_path(url_col)
    texts = [path]
    if html_col in pages.columns:
        texts.append(F.regexp_replace(F.col(html_col).cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " "))
    given = pages.withColumn(url_col, F.col(url_col).cast("string")).select(F.explode(F.split(F.lower(F.concat_ws(" ", *texts)), "[^a-z]+")).alias("word"))
    counted = given.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    own = pages.sparkSession.createDataFrame([(s, 1) for s in sorted(seeds)], "word string, n bigint")
    return counted.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def split_run(run: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest way to cover a run of letters with words; what no word covers costs `unknown` a letter."""
    best, back = [0.0], [(0, False)]
    for end in range(1, len(run) + 1):
        ways = [(best[end - 1] + unknown, (end - 1, False))]
        for start in range(max(0, end - LONGEST), end - 1):
            if (c := cost.get(run[start:end])) is not None:
                ways.append((best[start] + c, (start, True)))
        least, way = min(ways)
        best.append(least)
        back.append(way)
    parts, end, loose = [], len(run), ""
    while end:
        start, known = back[end]
        if known:
            parts += [loose] * bool(loose) + [run[start:end]]
            loose = ""
        else:
            loose = run[start:end] + loose
        end = start
    return [*parts, *[loose] * bool(loose)][::-1]


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts: their runs of letters, split."""
    total = words.agg(F.sum("n")).first()[0] or 1
    each = hosts.select("host", F.posexplode(F.filter(F.split("host", "[^a-z]+"), lambda r: r != "")).alias("place", "run"))
    runs = each.select("run").distinct()

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run").to_pylist():
                for a in range(0, len(run), 4096):  # a long run gives its substrings bit by bit
                    found = sorted({run[i:j] for i in range(a, min(len(run), a + 4096)) for j in range(i + 2, min(len(run), i + LONGEST) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([run] * len(found), pa.string()), pa.array(found, pa.string())], names=["run", "word"])

    known = runs.mapInArrow(lean(substrings), "run string, word string").join(words.hint("merge"), "word").groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    unknown = math.log(total) + 1  # more than the rarest word's cost, for each letter

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [split_run(run, {k["word"]: -math.log(k["n"] / total) for k in own or []}, unknown) for run, own in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(made, pa.list_(pa.string()))], names=["run", "words"])

    parts = runs.join(known, "run", "left").mapInArrow(lean(split), "run string, words array<string>")
    listed = each.join(parts.hint("merge"), "run").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("w"))
    return listed.select("host", F.flatten(F.transform("w", lambda x: x["words"])).alias("words"))


def _tokens(path: str) -> list[str]:
    """Tokens of a path, marked as such."""
    return ["/" + t for t in re.findall(r"[a-z]+", path.translate(_LOWERED))]


_LOWERED = str.maketrans(UPPER, LOWER)


@dataclass
class Model:
    words: DataFrame  # word, n: the unigram model
    odds: dict[str, float]  # of the most frequent words
    prior: float
    rest: DataFrame | None = None  # word, odds: of all words, if odds doesn't hold them all
    seeds: frozenset[str] = SEEDS
    seed_odds: float = 8.0

    def score(self, host_words: list[str], features: list[str]) -> float:
        """Log odds that the site is one to block, as far as seeds and the most frequent words tell."""
        return self.prior + self.seed_odds * (not self.seeds.isdisjoint(host_words)) + sum(self.odds.get(w, 0.0) for w in features)

    def features(self, host_words: list[str], path: str) -> list[str]:
        return [w for w in host_words if w not in self.seeds] + _tokens(path)


def _with_words(parts: DataFrame, words: DataFrame) -> DataFrame:
    """Rows with host, and words, those of the host. A host that many pages have is split once, and its pages' join can be split up by Spark."""
    hosts = saved(segmented(parts.select("host").where("host != ''").distinct(), words), "url-hosts")
    return parts.join(hosts.hint("merge"), "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def fit(pages: DataFrame, max_words: int = 4096, seeds: frozenset[str] = SEEDS, seed_odds: float = 8.0, url_col: str = "url", html_col: str = "html") -> Model:
    """Counts over all pages and words. What comes to the driver is bounded by max_words (the most
    frequent); the odds of the others stay a table."""
    host, path = host_and_path(url_col)
    words = saved(word_counts(pages, seeds, url_col, html_col), "url-unigrams")
    parts = pages.select(F.col(url_col).cast("string").alias(url_col)).select(host.alias("host"), path.alias("path"))
    model = Model(words, {}, -1.0, None, seeds, seed_odds)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[tuple[str | None, bool]] = Counter()
        bare = replace(model, words=None)
        for batch in batches:
            for own, p in zip(batch.column("words").to_pylist(), batch.column("path").to_pylist(), strict=True):
                blocked = not seeds.isdisjoint(own)
                count.update((w, blocked) for w in bare.features(own, p))
                count[(None, blocked)] += 1
                if len(count) > 100_000:
                    yield _rows(count)
                    count.clear()
        yield _rows(count)

    model.words = None  # no part of what tasks get
    n, ones = F.sum("n").alias("n"), F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("ones")
    judged = _with_words(parts.where("host != ''"), words).select("words", "path")
    rows = saved(judged.mapInArrow(lean(by_class), "word string, blocked boolean, n bigint").groupBy("word").agg(ones, n), "url-words")
    totals = {r.is_page: r for r in rows.groupBy(F.col("word").isNull().alias("is_page")).agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    pages_of, all_of = totals.get(True), totals.get(False)
    prior = math.log((pages_of.ones + 1) / (pages_of.n - pages_of.ones + 1)) if pages_of else -1.0
    if not all_of or not 0 < all_of.ones < all_of.n:  # one class has taught nothing
        return Model(words, {}, prior, None, seeds, seed_odds)
    share = all_of.ones / all_of.n
    apart = math.log(share / (1 - share))
    rows = rows.where("word is not null")
    few = rows.orderBy(F.desc("n"), "word").limit(max_words).collect()
    odds = {r.word: math.log((r.ones + share) / (r.n - r.ones + 1 - share)) - apart for r in few}
    table = rows.select("word", (F.log((F.col("ones") + F.lit(share)) / (F.col("n") - F.col("ones") + F.lit(1 - share))) - F.lit(apart)).alias("odds"))
    return Model(words, odds, prior, table if all_of.words > len(few) else None, seeds, seed_odds)


def _rows(count: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in count], pa.string()), "blocked": pa.array([b for _, b in count], pa.bool_()), "n": pa.array(list(count.values()), pa.int64())})


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict (block or allow), score (log odds to block), words (of the host)."""
    shared = pages.sparkSession.sparkContext.broadcast(replace(model, rest=None, words=None))
    parts = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).cast("string").alias(url_col))
    host, path = host_and_path(url_col)
    parts = _with_words(parts.select(id_col, host.alias("host"), path.alias("path")), model.words).select(id_col, "host", "path", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            there = [bool(h) for h in batch.column("host").to_pylist()]
            own = batch.column("words").to_pylist()
            features = [model.features(w, p) for w, p in zip(own, batch.column("path").to_pylist(), strict=True)]
            score = [model.score(w, f) if t else 0.0 for t, w, f in zip(there, own, features, strict=True)]
            rare = [[x for x in f if x not in model.odds] if t else [] for t, f in zip(there, features, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.string()))], names=[*batch.schema.names, "score", "rare"])

    scored = parts.mapInArrow(lean(run), f"{id_col} bigint, host string, path string, words array<string>, score double, rare array<string>")
    if model.rest is not None:
        scored = _with_rare(scored, model.rest)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), "score", "words")


def _with_rare(scored: DataFrame, odds: DataFrame) -> DataFrame:
    """Adds the odds of the words that the model doesn't hold. Rows are joined by host and path and words by themselves, and a
    word outside the model's is no more frequent than any of the model's, so no key has a large share of the rows."""
    some = F.size("rare") > 0
    words = scored.where(some).groupBy("host", "path").agg(F.first("rare").alias("rare")).select("host", "path", F.explode("rare").alias("word"))
    more = words.join(odds, "word").groupBy("host", "path").agg(F.sum("odds").alias("more"))
    joined = scored.where(some).join(more, ["host", "path"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return scored.where(~some).unionByName(joined.select(scored.columns))
