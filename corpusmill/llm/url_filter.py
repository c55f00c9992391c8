"""URL filters: rules first, then naive Bayes over the words of host and path.

Names such as ``bestcarloans`` are split into words by the most probable segmentation under word counts of the pages
themselves (Viterbi over unigrams). Multinomial naive Bayes learns from the URLs that a rule decides and judges the rest.

A null URL, or one without ``://``, has an empty host and path, fits no rule, and is judged by the prior alone; with
nothing to learn from, everything is allowed. Repeated rows are judged alike; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

# Fixed values: (verdict, host and path) of the rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LONGEST_GUESS = 20  # letters of a piece that no text has as a word; longer strangers are cut, words of the texts are not
WORD = re.compile(r"[a-z]{2,}")
NAME = re.compile(r"[a-z]+|[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host, and path, of a URL; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the URL's or a parent of it, and whose path the URL's starts with."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, folder = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + folder))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all rows, stored; every batch adds up its own words before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch[column].dropna():
                seen.update(WORD.findall(text.lower()))
            if seen:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    counted = texts.select(column).mapInPandas(count, "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "url-words")


class Splitter(dict):
    """Name to its words, worked out once for each distinct name. ``counts`` need only hold what is in the names."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        super().__init__()
        total = max(sum(counts.values()) if total is None else total, 1)
        self.known = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = [0.0] + [math.log(10.0 / total) - n * math.log(10.0) for n in range(1, LONGEST_GUESS + 1)]

    def __missing__(self, name: str) -> list[str]:
        best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        longer: dict[int, list[tuple[int, float]]] = {}
        for word in [w for w in self.known if LONGEST_GUESS < len(w) <= len(name)]:
            start = name.find(word)
            while start >= 0:
                longer.setdefault(start + len(word), []).append((start, self.known[word]))
                start = name.find(word, start + 1)
        for end in range(1, len(name) + 1):
            pieces = [(start, self.known.get(name[start:end], self.unknown[end - start])) for start in range(max(0, end - LONGEST_GUESS), end)]
            for start, gain in sorted(longer.get(end, ())) + pieces:
                if best[start] + gain > best[end]:
                    best[end], back[end] = best[start] + gain, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        if len(self) < 300_000:
            self[name] = out[::-1]
        return out[::-1]


def names_of(rows: DataFrame) -> DataFrame:
    """(mark, name, blocked, allowed): the names in host (``h``) and path (``p``) of (host, path, blocked) rows, each once.

    A number is ``#`` and its number of digits. ``blocked`` and ``allowed`` count what ruled rows hold; a row under no
    rule (null) adds nothing. The name '' counts the ruled rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, path, blocked in zip(batch["host"], batch["path"], batch["blocked"]):
                for mark, name in [("", ""), *names(host, path)]:
                    at = seen.setdefault((mark, name), [0, 0])
                    if not pd.isna(blocked):
                        at[int(not blocked)] += 1
            if seen:
                yield pd.DataFrame({"mark": [m for m, _ in seen], "name": [n for _, n in seen], "blocked": [x[0] for x in seen.values()], "allowed": [x[1] for x in seen.values()]})

    counted = rows.mapInPandas(count, "mark string, name string, blocked long, allowed long")
    return counted.groupBy("mark", "name").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))


def names(host: str, path: str) -> Iterator[tuple[str, str]]:
    """Names of the host, then of the path, in order."""
    for mark, part in (("h", host), ("p", path.lower())):
        for name in NAME.findall(part):
            yield mark, f"#{len(name)}" if name.isdigit() else name


def word_key(word: str) -> str:
    """What a word is joined by: itself, or where it is long its hash, so that no row of a name's pieces is long."""
    return word if len(word) <= LONGEST_GUESS else "#" + hashlib.md5(word.encode()).hexdigest()


def split_names(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of each distinct name: its pieces, of all lengths that words have, meet the whole table of words.

    A piece travels with the number of its name; the name itself stands in one row.
    """
    sizes = counts.groupBy(F.length("word").alias("size")).agg(F.sum("n").alias("n")).collect()  # one row a length
    total, lengths = sum(r["n"] for r in sizes), sorted(r["size"] for r in sizes)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = ((k, word_key(x[i : i + n])) for k, x in zip(batch["number"], batch["name"]) for n in lengths for i in range(len(x) - n + 1))
            while some := list(islice(found, 100_000)):
                yield pd.DataFrame(some, columns=["number", "key"]).drop_duplicates()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = []
            for name, known in zip(batch["name"], batch["known"]):
                words.append(Splitter({} if known is None else {r["word"]: r["n"] for r in known}, total)[name])
            yield pd.DataFrame({"name": batch["name"], "words": words})

    letters = found.where("name <> '' AND NOT startswith(name, '#')").select("name").distinct()
    letters = stored(letters.withColumn("number", F.monotonically_increasing_id()), "url-letters")
    key = F.when(F.length("word") <= LONGEST_GUESS, F.col("word")).otherwise(F.concat(F.lit("#"), F.md5("word")))
    met = letters.select("number", "name").mapInPandas(parts, "number long, key string").join(counts.withColumn("key", key), "key")
    known = met.groupBy("number").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return stored(letters.join(known, "number", "left").select("name", "known").mapInPandas(split, "name string, words array<string>"), "url-split")


@dataclass
class Bayes:
    """Log odds of block against allow: a prior, and for each token by its counts in blocked and allowed URLs, smoothed;
    ``b`` and ``a`` are the sizes of the classes. A token that no ruled URL has counts for the class sizes."""

    prior: float = 0.0
    a: float = 1.0
    b: float = 1.0
    smooth: float = 0.5

    def weight(self, blocked: Column, allowed: Column) -> Column:
        known = F.log((blocked + self.smooth) / self.b) - F.log((allowed + self.smooth) / self.a)
        return F.when(blocked + allowed > 0, known).otherwise(F.lit(math.log(self.a / self.b)))


def fit_bayes(found: DataFrame, table: DataFrame, smooth: float = 0.5) -> Bayes:
    """Learn from ``table``, the stored (token, blocked, allowed), and the counts of ruled rows in ``found``."""
    totals = table.where("blocked + allowed > 0").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count("*").alias("v")).first()
    urls = found.where("name = ''").first()
    if not urls or not totals["v"]:
        return Bayes(-1.0)
    b, a = (totals[x] + smooth * (totals["v"] + 1) for x in "ba")
    return Bayes(math.log((urls["blocked"] + 1) / (urls["allowed"] + 1)), a, b, smooth)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, texts: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, block_odds, host_words of every row.

    Words, tokens and names are tables that are joined, none is cut or gathered: names are split once each, tokens get
    their weights once each, and URLs meet their names by a join.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    rows = stored(rows.withColumn("ruled", verdicts).withColumn("row", F.monotonically_increasing_id()), "url-rows")
    found = stored(names_of(rows.select("host", "path", (F.col("ruled") == "block").alias("blocked"))), "url-names")
    split = found.where("name <> ''").join(split_names(found, word_counts(pages, texts)), "name", "left")
    split = stored(split.withColumn("words", F.coalesce("words", F.array("name"))).withColumn("number", F.monotonically_increasing_id()), "url-split-names")
    # a word travels with the number of its name, never with the name and its other words
    placed = split.select("number", "mark", "blocked", "allowed", F.posexplode("words").alias("at", "word"))
    placed = stored(placed.withColumn("token", F.concat_ws(":", "mark", "word")), "url-placed")
    table = stored(placed.groupBy("token").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")), "url-tokens")
    model = fit_bayes(found, table)
    weighed = placed.select("number", "at", "token").join(table.select("token", model.weight(F.col("blocked"), F.col("allowed")).alias("weight")), "token")
    weighed = weighed.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("weights"))
    weighed = split.select("number", "mark", "name", "words").join(weighed, "number")
    weighed = stored(weighed.select("mark", "name", "words", F.col("weights.weight").alias("weights")), "url-weights")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r, i, m, n) for r, h, p in zip(batch["row"], batch["host"], batch["path"]) for i, (m, n) in enumerate(names(h, p))]
            yield pd.DataFrame(out, columns=["row", "at", "mark", "name"])

    met = rows.select("row", "host", "path").mapInPandas(named, "row long, at int, mark string, name string").join(weighed, ["mark", "name"])
    shown = F.when(F.col("mark") == "h", F.concat_ws(" ", "words"))
    met = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown"), "weights"))).alias("met"))
    odds = F.aggregate(F.flatten("met.weights"), F.lit(0.0), lambda total, w: total + w)
    rows = rows.join(met.select("row", odds.alias("odds"), F.col("met.shown").alias("shown")), "row", "left")
    rows = rows.withColumn("block_odds", F.lit(model.prior) + F.coalesce("odds", F.lit(0.0)))
    # numbers stand as they are in host_words
    parts = F.regexp_extract_all("host", F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    words = F.array_join(F.transform(parts, lambda part, i: F.when(F.rlike(part, F.lit("^[0-9]")), part).otherwise(F.get("shown", i))), " ")
    verdict = F.coalesce("ruled", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_odds", words.alias("host_words"))
