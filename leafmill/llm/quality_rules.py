"""Quality rules as a bitmask ledger: each rule is evaluated once, policies are masks over the bits.

All measurements are JVM-side expressions; no Python runs on the executors.

Edge cases: a null or empty text has no words and no lines, fails the rule on short texts and is
never kept; repeated rows are judged one by one; further columns pass through (measured columns of
the same name are replaced); an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import WS, read

WINDOW = 8

#: (rule, condition under which a document fails); a rule's bit is its position. Append only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("no_letters", "n_words > 0 AND NOT has_letter"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules that a document must not fail.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": sum(BIT.values()),
}


def let(value: Column, body) -> Column:
    """Evaluate value once and give it to body as a variable."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Window hashes are sorted; only texts with equal neighbours pay for the sort with positions.
    """
    last = F.size(words) - WINDOW

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), last)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(win: Column) -> Column:
        def span(pos: Column) -> Column:
            steps = F.transform(pos, lambda p, j: F.when(j == F.size(pos) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(pos, j + 1) - p)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"])), lambda e: e["i"]))
        return let(F.sort_array(twice), span)

    def counted(win: Column) -> Column:
        distinct = let(F.sort_array(win), lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.get(s, i) == F.get(s, i - 1)))
        return F.when(distinct, covered(win)).otherwise(F.lit(0))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last < 1, F.lit(0)).otherwise(let(let(hashes, windows), counted)).cast("long")


def measure(text: Column) -> Column:
    """The struct of all measurements of a text."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.trim(whole, F.lit(WS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(WS)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(whole, WS, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            whole.rlike("\\p{L}").alias("has_letter"),
        ),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "has_letter"]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `bits`: bit i is set where rule i of RULES fails."""
    own = [c for c in docs.columns if c not in [*MEASURES, "bits"]]
    m = docs.select(F.struct(*own).alias("row"), measure(F.col(text)).alias("m"))
    out = m.select(
        "row.*", F.col("m.n_words").alias("n_words"), F.col("m.word_chars").alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.lines.n").alias("n_lines"), F.col("m.n_repeat_words").alias("n_repeat_words"), F.col("m.has_letter").alias("has_letter"),
    )
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits + F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0))
    return out.withColumn("bits", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds `kept` from the stored bits alone; no rule is evaluated again."""
    return rows.withColumn("kept", F.col("bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and that fail only it. One pass, one row a rule."""
    mask = POLICIES[policy]
    names = [n for n, _ in RULES if BIT[n] & mask]
    hit = F.col("bits").bitwiseAND(F.lit(mask))
    by_bits = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in names]))
    each = by_bits.select("hit", "n", of.alias("r"))
    zero = F.lit(0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(zero)).alias("n_only"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")), "v1")
    base_failed = F.col("bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "bits")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS s
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, regexp_matches(t, '\p{L}') AS has_letter
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
       + (CASE WHEN n_words > 0 AND NOT has_letter THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, (bits & 15) = 0 AS kept, bits::BIGINT AS bits FROM b
"""
