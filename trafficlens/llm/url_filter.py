"""URL filters: rules, and for urls that no rule fits, naive Bayes over segmented hosts and paths.

Host names are runs of words without spaces. A unigram model (word counts over the visible text of all pages)
splits each label of a host by Viterbi: the split with the largest product of word probabilities. The words of
the host and the tokens of the path feed a multinomial naive Bayes classifier, learned from the urls that a rule
decides. Both models keep a bounded number of entries (parameters below), counted over all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.util import checkpoint, most_frequent

#: Entries of the unigram model and of the classifier's vocabulary: the most frequent, of equal ones the first in order.
UNIGRAMS = 50_000
FEATURES = 50_000
LONGEST_WORD = 24
CACHE_LABELS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
_PARTS = regex.compile(r"\p{L}+|\p{N}+")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """A rule from e.g. "block example.org/es/"."""
    verdict, where = line.split()
    host, slash, path = where.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null and without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? or # or the end; empty for null and without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


class Segmenter:
    """Viterbi over a unigram model of words."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: -log(n / total) for w, n in counts.items()}
        self.unknown = log(total) + log(10)  # and as much again for each letter: long unknown words are rarer
        self.known: dict[str, tuple[str, ...]] = {}

    def split(self, label: str) -> tuple[str, ...]:
        if (hit := self.known.get(label)) is not None:
            return hit
        best, back = [0.0], [0]
        for j in range(1, len(label) + 1):
            options = []
            for i in range(max(0, j - LONGEST_WORD), j):
                word = label[i:j]
                options.append((best[i] + self.cost.get(word, self.unknown + log(10) * len(word)), i))
            cost, i = min(options)
            best.append(cost)
            back.append(i)
        words, j = [], len(label)
        while j:
            words.append(label[back[j] : j])
            j = back[j]
        if len(self.known) >= CACHE_LABELS:
            self.known.clear()
        self.known[label] = out = tuple(reversed(words))
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        """The features of a url: h: words of the host, p: tokens of the path. All numbers are one token."""
        out = []
        for part in _PARTS.findall(host):
            out += ["h:#"] if part[0].isnumeric() else [f"h:{w}" for w in self.split(part.lower())]
        for part in _PARTS.findall(path):
            out.append("p:#" if part[0].isnumeric() else f"p:{part.lower()}")
        return out


def unigrams(pages: DataFrame, html_col: str) -> dict[str, int]:
    """Counts of the most frequent words in the visible text of all pages."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"<[^<>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in most_frequent(counts, "n", "word", UNIGRAMS).collect()}


def fit(labelled: DataFrame, counts: dict[str, int]) -> dict:
    """Naive Bayes from rows (host, path, verdict): log priors, and log likelihoods by token."""
    shared = labelled.sparkSession.sparkContext.broadcast(counts)  # at most UNIGRAMS words

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = Segmenter(shared.value)
        for frame in frames:
            seen: Counter = Counter()
            for host, path, verdict in zip(frame["host"], frame["path"], frame["verdict"]):
                seen[verdict, ""] += 1
                seen.update((verdict, t) for t in segment.tokens(host, path))
            yield pd.DataFrame({"verdict": [k[0] for k in seen], "token": [k[1] for k in seen], "n": list(seen.values())})

    each = labelled.select("host", "path", "verdict").mapInPandas(run, "verdict string, token string, n long")
    by = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in VERDICTS]
    table = checkpoint(each.groupBy("token").agg(*by, F.sum("n").alias("n")))
    # The empty token counts the urls themselves.
    urls = next(((r["allow"], r["block"]) for r in table.where("token = ''").collect()), (0, 0))
    rows = sorted(most_frequent(table.where("token <> ''"), "n", "token", FEATURES).collect())
    sums = [sum(r[v] for r in rows) + len(rows) + 1 for v in VERDICTS]
    return {
        "prior": [log((n + 1) / (sum(urls) + 2)) for n in urls],
        "token": {r["token"]: tuple(log((r[v] + 1) / s) for v, s in zip(VERDICTS, sums)) for r in rows},
        "other": tuple(log(1 / s) for s in sums),
    }


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and score (log odds of block; null where a rule decides).

    A url that is null or has no :// has an empty host and path, and gets the verdict of the class priors; with no
    evidence either way the verdict is allow. Without rules nothing is learned, and every verdict is allow. Of two rules
    that fit and are equally long the one later in order of its name decides. Repeated rows are judged each; very long urls
    and pages are read whole; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    judged = parsed.withColumn("__rule", rule_of(rules, F.col("host"), F.col("path")))
    counts = unigrams(pages, html_col)
    model = fit(judged.where("__rule IS NOT NULL").select("host", "path", F.col("__rule.verdict").alias("verdict")), counts)
    shared = pages.sparkSession.sparkContext.broadcast((counts, model))  # at most UNIGRAMS + FEATURES entries
    state: dict = {}

    @F.pandas_udf("double")
    def odds(hosts: pd.Series, paths: pd.Series, decided: pd.Series) -> pd.Series:
        counts, model = shared.value
        segment = state.setdefault("segment", Segmenter(counts))
        likely, other, (allow, block) = model["token"], model["other"], model["prior"]
        out = []
        for h, p, d in zip(hosts, paths, decided):
            if d:
                out.append(None)
                continue
            a, b = allow, block
            for t in segment.tokens(h, p):
                x, y = likely.get(t, other)
                a, b = a + x, b + y
            out.append(b - a)
        return pd.Series(out, dtype="float64")

    scored = judged.withColumn("score", odds("host", "path", F.col("__rule").isNotNull()))
    by_score = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), by_score).alias("verdict"), "score",
    )
