"""URL filters: rules first, then naive Bayes over the words that host and path are made of.

*Rules* are (host, path) pairs that allow or block.  A rule fits its host and all
subdomains if the path of the address starts with the rule's.  The longest rule
text wins, of equally long ones that with the longer host, of equal ones block.
Rules are a list in the driver's memory; a task looks up the suffixes of a host.

*Segmentation.*  Runs of letters in host and path are split into words by
Viterbi's algorithm under a unigram model: the number of times that a word
stands in all documents (lowered runs of letters) or in a label of a host or a
segment of a path that marks or digits cut in several, of which the
commonest are held, ``vocabulary`` at most (a stated size of the model; counts
cover every row, words of one count are in together or not at all).  A label that is one run is what is to be split, so it is no word.  A stretch that is no word
costs a fixed factor and one more for each letter.  Of equally likely splits the
one whose last word is longer is taken.  Digits become one token.

*Naive Bayes.*  An address with a word of the list of unwanted words is an example
of what to block, every other one of what to allow (or the caller brings his own
examples).  Tokens are counted by class over all addresses with grouped
aggregation, so words that keep company with unwanted ones tell as well.  The
multinomial model is smoothed by one; tokens outside the vocabulary take no part.
Ties allow.

Null addresses and those without ``://`` have an empty host and path, which no
rule fits and whose tokens say nothing (the commoner class decides).  Repeated
rows count as often as they occur.  Very long addresses are whole.  Other
columns are ignored, whatever their names; an empty table gives no rows, and
without documents the words of the addresses alone are known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, least_count, table, trimmed

#: Words that make an address an example of what to block, and the rules of the query: fixed values.
UNWANTED = ["ads", "adult", "bets", "betting", "casino", "escort", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Letters of the longest word that is looked for, and cost (log) of a stretch that is no word and of each of its letters.
LONGEST, UNKNOWN, LETTER = 24, math.log(10.0), math.log(10.0)
NUMBER = "0"
_RUNS = re.compile(r"[^\W\d_]+|\d+")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path``: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; then up to ``?``, ``#`` or the end."""
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.locate("://", url).alias("at"))
    rest = F.when(F.col("at") > 0, F.expr("substring(url, at + 3)")).otherwise("")
    p = p.select("page_id", rest.alias("rest")).withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    after = F.expr("substring(rest, length(host) + 1)")
    return p.select("page_id", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract(after, "^[^?#]*", 0).alias("path"))


class Rules:
    """Rules by host."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def of(self, host: str, path: str) -> tuple[str, str] | None:
        """Text and verdict of the rule that decides."""
        found = None
        at = 0
        while True:
            own = host[at:]
            for begin, verdict in self.by_host.get(own, ()):
                if path.startswith(begin):
                    found = max(found or (0,), (len(own) + len(begin), len(own), verdict == "block", own + begin, verdict))
            at = host.find(".", at) + 1
            if not at:
                return found and found[3:]


@dataclass
class Words:
    """Costs (negative logs of shares) of the words of a unigram model."""

    cost: dict[str, float]
    nothing: float
    _split: dict[str, list[str]] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: dict[str, int]) -> Words:
        total = math.log(sum(counts.values()) or 1)
        return cls({w: total - math.log(n) for w, n in counts.items()}, total + UNKNOWN)

    def split(self, run: str) -> list[str]:
        """The likeliest words of a run of letters."""
        best, cut = [0.0], [0]
        for z in range(1, len(run) + 1):
            # A stretch is a word or unknown; unknown ones of more than LONGEST letters are several.
            least, at = math.inf, z - 1
            for a in range(max(0, z - LONGEST), z):
                c = best[a] + min(self.cost.get(run[a:z], math.inf), self.nothing + LETTER * (z - a))
                if c < least:
                    least, at = c, a
            best.append(least)
            cut.append(at)
        out, z = [], len(run)
        while z:
            out.append(run[cut[z] : z])
            z = cut[z]
        return out[::-1]

    def tokens(self, text: str) -> list[str]:
        """Words of the runs of letters, and a mark for each number."""
        out: list[str] = []
        for run in _RUNS.findall(text.lower()):
            if run[0].isdigit():
                out.append(NUMBER)
            elif len(run) > 64:
                out += self.split(run)
            else:  # the same few runs come again and again
                if run not in self._split:
                    if len(self._split) >= 100_000:
                        self._split.clear()
                    self._split[run] = self.split(run)
                out += self._split[run]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_split": {}}


def word_counts(urls: DataFrame, texts: DataFrame | None = None, vocabulary: int = 50_000, keep: list[str] = UNWANTED) -> Words:
    """The unigram model of ``texts`` (column ``text``) and of the labels and segments of several runs in ``urls`` (``host, path``)."""
    runs = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")
    names = F.transform(F.split(F.concat_ws("/", "host", "path"), r"[./]"), runs)
    words = urls.select(F.explode(F.flatten(F.filter(names, lambda x: F.size(x) > 1))).alias("word"))
    if texts is not None:
        words = words.unionByName(texts.select(F.explode(runs(F.col("text").cast("string"))).alias("word")))
    counted = words.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = checkpointed(counted)
    top = counted.where(F.col("n") >= least_count(counted, vocabulary)).collect()  # a stated number of rows
    return Words.of({w: 1 for w in keep} | {r["word"]: r["n"] for r in top})


@dataclass
class Bayes:
    """Log odds of blocking: of the classes, and of each token of the vocabulary."""

    prior: float
    odds: dict[str, float]

    def score(self, tokens: list[str]) -> float:
        return self.prior + math.fsum(self.odds.get(t, 0.0) for t in tokens)


def _tokenised(urls: DataFrame, words: Words) -> DataFrame:
    """``page_id, host, path, tokens``: those of the vocabulary, and numbers."""
    held = urls.sparkSession.sparkContext.broadcast(words)  # of a stated size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for whole in batches:
            for b in batches_of(whole, "path", 2 << 20):
                tokens = []
                for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                    tokens.append([t for t in words.tokens(f"{host} {path}") if t == NUMBER or t in words.cost])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], [*b.schema.names, "tokens"])

    return urls.select("page_id", "host", "path").mapInArrow(trimmed(run), "page_id long, host string, path string, tokens array<string>")


def fit(tokens: DataFrame, unwanted: list[str] = UNWANTED, examples: DataFrame | None = None) -> Bayes:
    """Counted over all rows of ``tokens`` (``page_id, tokens``), or over those that ``examples`` (``page_id, blocked boolean``) names."""
    if examples is None:
        rows = tokens.select("tokens", F.arrays_overlap("tokens", F.array(*map(F.lit, unwanted))).alias("blocked"))
    else:
        rows = tokens.join(examples.select(F.col("page_id").cast("long").alias("page_id"), "blocked"), "page_id").select("tokens", "blocked")
    yes, no = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("blocked"), ~F.col("blocked")))
    classes = rows.agg(yes.alias("yes"), no.alias("no")).first()
    by_token = rows.select("blocked", F.explode("tokens").alias("token")).groupBy("token").agg(yes.alias("yes"), no.alias("no")).collect()  # no more than the vocabulary
    total = [sum(r[c] for r in by_token) + len(by_token) for c in ("yes", "no")]
    odds = {r["token"]: math.log((r["yes"] + 1) / total[0]) - math.log((r["no"] + 1) / total[1]) for r in by_token}
    return Bayes(math.log(((classes["yes"] or 0) + 1) / ((classes["no"] or 0) + 1)), odds)


def judge(tokens: DataFrame, bayes: Bayes, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, words``: the rule's verdict, else block where the log odds are above 0."""
    held = tokens.sparkSession.sparkContext.broadcast((bayes, Rules(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, rules = held.value
        for whole in batches:
            for b in batches_of(whole, "path", 2 << 20):
                decided = [rules.of(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
                score = [bayes.score(t) for t in b.column("tokens").to_pylist()]
                verdict = [d[1] if d else "block" if s > 0 else "allow" for d, s in zip(decided, score)]
                cols = [pa.array([d and d[0] for d in decided], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols, b.column("tokens")], ["page_id", "host", "path", "rule", "verdict", "score", "words"])

    return tokens.select("page_id", "host", "path", "tokens").mapInArrow(trimmed(run), "page_id long, host string, path string, rule string, verdict string, score double, words array<string>")


def filter_urls(pages: DataFrame, texts: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, unwanted: list[str] = UNWANTED, examples: DataFrame | None = None, vocabulary: int = 50_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row of ``pages`` with its host, path, rule, verdict, score and words."""
    urls = parsed(pages, id_col, url_col)
    words = word_counts(urls, texts, vocabulary, unwanted)
    tokens = checkpointed(_tokenised(urls, words))
    return judge(tokens, fit(tokens, unwanted, examples), rules)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
