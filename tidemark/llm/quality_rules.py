"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Spark expression over one row (no user function, no
shuffle), so the whole verdict is a map over the scan.  The measures are
built in three layers of columns, because arrays that several expressions
read must be columns of their own, or Spark would compute them once for each
use.

Defined results: a null or empty text has no words and fails the word-count
rule; null identifiers pass through; repeated rows give repeated rows; extra
columns of the input stay (``with_quality`` puts its own under a ``q_``
prefix, replacing columns of the same name); an empty table gives an empty
table.  Three-word windows are compared by 64-bit hash: within one text of a
million words, the chance of any false match is below 1e-7.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, Sealed, read, words

# Frequent function words of the four languages in the corpus.
STOP_WORDS = (
    "the of and to in is that for it on with as was by this be are at or from have not",
    "de la le les et des du en un une que qui dans pour par sur au est avec pas",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "de la que el en y a los se del las un por con no una su para es al lo como",
)
STOP = tuple(sorted({w for line in STOP_WORDS for w in line.split()}))


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; an open end is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict: a document is kept if it meets every row of this table.
RULES = (
    Rule("enough_words", "n_words", 50, None),
    Rule("repeated_words", "repeat_ratio", None, 0.5),
    Rule("word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``q_*`` measures, ``q_failed`` (names of rules not met) and ``q_kept``.

    ``docs`` must have no columns of these names, nor ``q__*``: see ``Sealed``.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # layer 1: words and lines
    df = docs.withColumns({
        "q__w": words(F.col(text)),
        "q__l": F.filter(F.split(raw, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "q_word_chars": F.char_length(F.regexp_replace(raw, f"[{SPACE}]+", "")).cast("long"),
        "q_n_symbols": (F.char_length(raw) - F.char_length(F.translate(raw, "#*$%&|<>", ""))).cast("long"),
    })
    w, n = F.col("q__w"), F.size("q__w")
    # layer 2: a hash for each window of three words
    df = df.withColumns({
        "q_n_words": n.cast("long"),
        "q_n_lines": F.size("q__l").cast("long"),
        "q_n_dup_lines": (F.size("q__l") - F.size(F.array_distinct("q__l"))).cast("long"),
        "q_n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP))).cast("long"),
        "q__h": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>")),
    })
    # layer 3: windows sorted by hash, only where any hash occurs twice
    h = F.col("q__h")
    df = df.withColumn("q__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s, m = F.col("q__s"), F.size("q__s")
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < m - 1) & (F.get(s, k + 1)["h"] == x["h"])))
    df = df.withColumn("q__t", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # layer 4: words under those windows; neighbours overlap
    t = F.col("q__t")
    covered = F.aggregate(F.transform(t, lambda x, k: F.when(k > 0, F.least(F.lit(3), x - F.get(t, k - 1))).otherwise(3)), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("q_n_repeat_words", F.coalesce(F.when(F.size(t) > 0, covered), F.lit(0)).cast("long")).drop("q__w", "q__l", "q__h", "q__s", "q__t")
    per_word = lambda x: F.when(F.col("q_n_words") > 0, F.col(x) / F.col("q_n_words")).otherwise(F.lit(0.0))
    df = df.withColumns({
        "q_mean_word_length": per_word("q_word_chars"),
        "q_symbol_ratio": per_word("q_n_symbols"),
        "q_stop_ratio": per_word("q_n_stop"),
        "q_repeat_ratio": per_word("q_n_repeat_words"),
        "q_dup_line_ratio": F.when(F.col("q_n_lines") > 0, F.col("q_n_dup_lines") / F.col("q_n_lines")).otherwise(F.lit(0.0)),
    })

    def met(r: Rule) -> Column:
        x = F.col(f"q_{r.measure}")
        parts = [x >= r.low] * (r.low is not None) + [x <= r.high] * (r.high is not None)
        return F.when(parts[0] & parts[-1], F.lit(None).cast("string")).otherwise(F.lit(r.name))

    failed = F.array_compact(F.array(*[met(r) for r in rules])) if rules else F.array().cast("array<string>")
    df = df.withColumn("q_failed", failed)
    # never false, but no filter on the verdict is moved below it, where Spark would write
    # the layers into one another and compute arrays anew for each of their elements
    fence = F.monotonically_increasing_id() >= 0
    return df.withColumn("q_kept", (F.size("q_failed") == 0) & fence)


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``measured``, which replace columns of ``docs`` of the same name."""
    table = Sealed(docs, text=text)
    df = measured(table.df, rules)
    new = [c for c in df.columns if c.startswith("q_")]
    return df.select(*[c for c, n in zip(table.open(), table.names, strict=True) if n not in new], *new)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' measures and verdict for every row of ``documents``."""
    df = with_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    return df.select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & F.col("q_kept")).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i+1], ws[i+2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i+1, i+2]) AS k FROM g WHERE n >= 2) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: list_contains([%STOP%], lower(x)))) AS n_stop
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1
  AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
""".replace("%STOP%", ", ".join(f"'{w}'" for w in STOP))
