"""URL filters: rules, then gradient-boosted trees on lexical features.

A rule is a host and a path prefix; it fits its host and all subdomains, and the longest that fits
wins. Rules are one expression in the scan. What no rule decides, trees judge from lexical features of the
URL: lengths, depth, digit ratio, entropy, parameter counts, hyphens, and statistics of the host's
suffixes (how often, and how often blocked, smoothed, in the labelled URLs of other folds).

The query's labelled URLs: where the path of a URL ends in the id of a labelled document, the URL takes its label, and a toxic or low-quality
document is a reason to block. Only documents whose crc32 of the id as text, mod ``FOLDS``, is not 0 are learnt from; the others are held out.
Nothing else, no list of words or hosts, says what is bad. The sample is bounded by ``SAMPLE``, dealt by hash.

Results for odd input: a null url, or one without ``://``, has empty host and path, and the trees
judge it like any other; without labelled URLs of both classes every such verdict is the only class there is, or allow;
a document with several labels is bad if one of them is; of rules of one length that fit, the one that sorts last wins;
null page_ids and repeated rows get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, crc32_of, first_by_hash
from .gbt import Trees, fit

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labelled URLs that the model is fitted on at most.
SAMPLE = 20_000
#: Labelled documents with crc32(doc_id) mod this 0 are held out.
FOLDS = 5
CUT = 0.5
FEATURES = ["length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "params", "hyphens", "marks", "vowels", "longest_run", "https", "fragment", "suffix1_n", "suffix1_rate", "suffix2_n", "suffix2_rate"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """The path: what follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (url) with host, path, rule and the rule's verdict (both null where none fits). A short list of rules."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * np.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


class Suffixes:
    """Counts and block rates of host suffixes in labelled URLs; a labelled URL's own fold is left out."""

    FOLDS = 5

    def __init__(self, hosts: list[str], y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.n = [Counter() for _ in range(self.FOLDS)]
        self.bad = [Counter() for _ in range(self.FOLDS)]
        for i, (h, v) in enumerate(zip(hosts, y.tolist(), strict=True)):
            for s in _suffixes(h):
                self.n[i % self.FOLDS][s] += 1
                self.bad[i % self.FOLDS][s] += v
        self.all_n, self.all_bad = sum(self.n, Counter()), sum(self.bad, Counter())

    def of(self, host: str, fold: int | None = None) -> list[float]:
        out = []
        for s in _suffixes(host):
            n, bad = self.all_n[s], self.all_bad[s]
            if fold is not None:
                n, bad = n - self.n[fold][s], bad - self.bad[fold][s]
            out += [float(np.log1p(n * (1.25 if fold is not None else 1))), (bad + 20 * self.prior) / (n + 20)]
        return out


def lexical(url: str, host: str, path: str) -> list[float]:
    n = len(url) or 1
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(map(str.isdigit, url))
    return [
        float(np.log1p(len(url))), float(len(host)), float(len(path)), float(len(query)), float(path.count("/")), float(host.count(".") + 1 if host else 0),
        digits / n, sum(map(str.isdigit, host)) / (len(host) or 1), _entropy(url), _entropy(host), float(len([p for p in query.split("&") if p])), float(host.count("-")),
        sum(not c.isalnum() for c in url) / n, sum(c in "aeiou" for c in host) / (len(host) or 1), float(max((len(x) for x in re.split(r"[^a-z]+", host)), default=0)),
        float(url[:8].lower() == "https://"), float("#" in url),
    ]


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees, Suffixes]:
    """Fit on rows url, y (1: block), ``sample`` of them at most."""
    rows = labelled.where("url is not null and y is not null").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y")
    got = first_by_hash(rows.select("url", "y", "host", "path"), ["url", "y"], sample).collect()
    y = np.array([r.y for r in got], float)
    suffixes = Suffixes([r.host for r in got], y)
    x = np.array([lexical(r.url, r.host, r.path) + suffixes.of(r.host, i % Suffixes.FOLDS) for i, r in enumerate(got)], float).reshape(len(got), len(FEATURES))
    # A fifth of the sample says after how many trees there is nothing more to learn.
    kept_back = np.arange(len(y)) % Suffixes.FOLDS == 0
    model = fit(x[~kept_back], y[~kept_back])
    return model.pruned(x[kept_back], y[kept_back]), suffixes


def judge(pages: DataFrame, model: Trees, suffixes: Suffixes, rules=RULES, cut: float = CUT) -> DataFrame:
    """page_id, url, host, path, rule, verdict and score (null where a rule decides) of every row."""

    def run(batches):
        for b in chunks(batches, 4096):
            urls, hosts, paths, said = (b.column(c).to_pylist() for c in ("url", "host", "path", "rule_verdict"))
            scores = [None] * len(urls)
            if at := [i for i, v in enumerate(said) if v is None]:
                x = np.array([lexical(urls[i] or "", hosts[i], paths[i]) + suffixes.of(hosts[i]) for i in at], float)
                for i, s in zip(at, model.score(x).tolist(), strict=True):
                    scores[i], said[i] = s, "block" if s > cut else "allow"
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "path", "rule")), pa.array(said, pa.string()), pa.array(scores, pa.float64())], ["page_id", "url", "host", "path", "rule", "verdict", "score"])

    ruled = with_rules(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    return ruled.mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string, score double")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, doc_id and y (1: block) of the URLs whose path ends in a labelled document's id."""
    ident = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') as long)")
    urls = pages.select(F.col("url").cast("string").alias("url")).where("url is not null").withColumn("path", path_of(F.col("url"))).select("url", ident.alias("doc_id")).where("doc_id is not null")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("y")).where("y is not null")
    return urls.join(marks, "doc_id").select("url", "doc_id", "y")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    learnt = labelled_urls(pages, labels).where(crc32_of("doc_id") % FOLDS != 0)
    return judge(pages, *train(learnt)).select("page_id", "host", "path", "rule", "verdict")
