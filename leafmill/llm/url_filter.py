"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The rules' own verdicts label the training URLs. A bounded sample of them (`sample`, by hash order)
is binned by SQL expressions and summed to distinct feature cells; the trees are grown from those
cells on the driver and become one nested CASE expression, so that scoring is a projection: no
shuffle, no Python on the executors. Both verdicts have the same total weight in training, so that a
URL unlike all labelled ones isn't judged by which rules happen to fit more URLs. Features are of the
URL's form: lengths, depth, ratios, entropy, counts, and the rates of its suffix and of its first path
segment; the host's own name is none, as it would only repeat the rules. At a split by a suffix or
segment that no labelled URL has, both branches count, by their shares of the training weight.

Edge cases: a null URL or one without `://` has empty host and path, fits no rule and is judged by
the trees from its empty features; repeated URLs are judged alike; without labelled URLs, or with
one label only, the trees are a constant (allow if there is no label); an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ascii_lower, read

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SAMPLE, BINS, TREES, DEPTH, RATE, LEAST_HESSIAN, L2, SUFFIX_CELLS = 20_000, 16, 24, 3, 0.3, 5.0, 1.0, 256


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), "path": F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null if none fits. Longest first, so the first fit wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _cell(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SUFFIX_CELLS)).cast("int")


def features(url: str = "url") -> dict[str, Column]:
    """Lexical measures of a URL; suffixes are cells of a table of fixed size."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(u, "(?s)\\?([^#]*)", 1)
    n = F.length(u)
    chars = F.split(u, "")
    probs = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))))
    labels = F.split(host, "\\.")
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "digit_ratio": F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(u, "0123456789", ""))) / n),
        "entropy": F.round(entropy, 6),
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(F.size(F.split(query, "&")).cast("double")),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "label_length": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "suffix": _cell(F.element_at(labels, -1)),
        "path_head": _cell(F.regexp_extract(path, "^/([^/]*)/", 1)),
    }


def _grow(cells: list[tuple[list[int], float, float]], names: list[str]) -> list[tuple]:
    """Boosted trees for the logistic loss over (bins, n, n_blocked) cells: a list of (split | leaf)."""
    total, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    base = math.log((bad + 0.5) / (total - bad + 0.5))
    score, trees = [base] * len(cells), [base]
    if bad in (0, total):
        return [base if total else -1.0]
    for _ in range(TREES):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        grad = [c[1] * p - c[2] for c, p in zip(cells, prob, strict=True)]
        hess = [c[1] * p * (1 - p) for c, p in zip(cells, prob, strict=True)]

        def node(rows: list[int], depth: int, grad=grad, hess=hess):
            g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
            best = (1e-6, None, None)
            if depth:
                for f in range(len(names)):
                    hist: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
                    for i in rows:
                        cell = hist[cells[i][0][f]]
                        cell[0] += grad[i]
                        cell[1] += hess[i]
                    gl = hl = 0.0
                    for b in sorted(hist)[:-1]:
                        gl, hl = gl + hist[b][0], hl + hist[b][1]
                        if min(hl, h - hl) >= LEAST_HESSIAN:
                            gain = gl * gl / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g * g / (h + L2)
                            best = max(best, (gain, f, b), key=lambda x: x[0])
            if best[1] is None:
                value = -RATE * g / (h + L2)
                for i in rows:
                    score[i] += value
                return value
            _, f, b = best
            left, right = [i for i in rows if cells[i][0][f] <= b], [i for i in rows if cells[i][0][f] > b]
            share = sum(cells[i][1] for i in left) / sum(cells[i][1] for i in rows)
            return (f, b, node(left, depth - 1), node(right, depth - 1), share)

        trees.append(node(list(range(len(cells))), DEPTH))
    return trees


class UrlModel:
    """Boosted trees as a SQL expression over the feature columns."""

    def __init__(self, labelled: DataFrame, url: str = "url", sample: int = SAMPLE) -> None:
        """labelled: columns url, host, path, blocked (0 or 1). sample bounds what is collected."""
        names = list(features())
        self.numeric, self.suffixes = names[:-2], names[-2:]
        got = self._sample(labelled.select(F.xxhash64(*sorted(labelled.columns)).alias("o"), "blocked", *[c.alias(k) for k, c in features(url).items()]), sample)
        self.cuts = {}
        for k in self.numeric:
            values = sorted(r[k] for r in got)
            at = [values[len(values) * q // BINS] for q in range(1, BINS)] if values else []
            self.cuts[k] = sorted(set(at))
        n_bad = sum(r.blocked for r in got)
        weight = {1: len(got) / (2 * n_bad) if n_bad else 1.0, 0: len(got) / (2 * (len(got) - n_bad)) if n_bad < len(got) else 1.0}
        base = 0.5
        self.rates = {}
        for k in self.suffixes:
            n, bad = [0] * SUFFIX_CELLS, [0] * SUFFIX_CELLS
            for r in got:
                n[r[k]] += weight[r.blocked]
                bad[r[k]] += r.blocked * weight[1]
            self.rates[k] = [min(BINS - 1, int(BINS * (b + 4 * base) / (m + 4))) if m else None for m, b in zip(n, bad, strict=True)]
        self.names = names
        cells: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for r in got:
            key = tuple([sum(r[k] > c for c in self.cuts[k]) for k in self.numeric] + [self.rates[k][r[k]] for k in self.suffixes])
            cells[key][0] += weight[r.blocked]
            cells[key][1] += r.blocked * weight[1]
        self.trees = _grow([(list(k), n, b) for k, (n, b) in sorted(cells.items())], names)

    def _sample(self, rows: DataFrame, sample: int) -> list:
        """At most `sample` rows of numbers, by their hash: only rows below a threshold, which rises until about enough pass, are sent to be sorted."""
        n = rows.count()
        share = min(1.0, 1.2 * sample / max(n, 1))
        while True:
            few = rows if share >= 1 else rows.filter(F.pmod("o", F.lit(1 << 32)) < int(share * (1 << 32)))
            got = few.orderBy("o", *self.numeric, "blocked").limit(sample).collect()
            if share >= 1 or 2 * len(got) >= sample:
                return got
            share = min(1.0, 4 * share)

    def _tree(self, t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        f, b, left, right, share = t
        k, left, right = self.names[f], self._tree(left), self._tree(right)
        if k in self.cuts:
            return F.when(F.col(f"_f.{k}") <= F.lit(float(self.cuts[k][b])), left).otherwise(right)
        cells = [[i for i, r in enumerate(self.rates[k]) if r is not None and (r <= b) == side] for side in (True, False)]
        return F.when(F.col(f"_f.{k}").isin(cells[0]), left).when(F.col(f"_f.{k}").isin(cells[1]), right).otherwise(F.lit(share) * left + F.lit(1 - share) * right)

    def probability(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """pages (with host and path) with block_probability."""
        f = F.struct(*[c.alias(k) for k, c in features(url).items()])
        total = F.lit(0.0)
        for t in self.trees:
            total = total + self._tree(t)
        own = [c for c in pages.columns if c != "block_probability"]
        scored = pages.select(F.struct(*own).alias("row"), f.alias("_f"))
        return scored.select("row.*", (1 / (1 + F.exp(-total))).alias("block_probability"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, verdict and block_probability (the trees')."""
    rule, verdict = rule_columns(rules)
    ruled = with_parts(pages, url).withColumns({"rule": rule, "verdict": verdict})
    model = UrlModel(ruled.filter("verdict IS NOT NULL").withColumn("blocked", (F.col("verdict") == "block").cast("int")), url, sample)
    scored = model.probability(ruled, url)
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")
