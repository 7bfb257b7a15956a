"""Operator 8: quality rules with host-level verdicts, in DataFrame functions only.

Documents get word, symbol, line and repetition counts. The *base* rule and
some softer rules are applied to each; failures are aggregated by host, each
host's failure rate is shrunk towards the corpus by a beta prior fitted to all
hosts (method of moments), and the verdicts are joined back: on a host whose
shrunk rate is over the prior's mean by ``HOST_DEVIATIONS`` of its standard deviations, or over
``HOST_LIMIT``, a document has to pass the soft rules, too.

Cases: a null text counts as empty (no words, base rule fails); null hosts form
one host; rows that repeat are judged each; an empty table gives no rows; other
columns are carried and never clash, as working columns have a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: ASCII white space, as in the words' definition.
WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Soft rules: symbols in a hundred words, and the repeated lines in a hundred lines.
SYMBOL_PERCENT, DUP_LINE_PERCENT = 10, 30
#: Standard deviations of the prior over its mean, from which a host's documents must pass the soft rules.
HOST_DEVIATIONS = 3
#: A rate that is too much for any host.
HOST_LIMIT = 0.5
#: Limits for the strength of the prior, in documents.
PRIOR_LOW, PRIOR_HIGH = 1.0, 1000.0

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(x)`` with x bound to value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: sort (hash, position),
    keep positions with an equal neighbour, and add up the covered lengths."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal_neighbours(a: Column) -> Column:
        hit = F.filter(
            F.sequence(F.lit(0), F.size(a) - 1),
            lambda k: F.coalesce(F.get(a, k - 1)["h"] == F.get(a, k)["h"], F.lit(False))
            | F.coalesce(F.get(a, k + 1)["h"] == F.get(a, k)["h"], F.lit(False)),
        )
        return F.transform(hit, lambda k: F.get(a, k)["i"])

    starts = F.sort_array(_let(ordered, equal_neighbours))
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n")
        ),
    )
    return total["n"]


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of METRICS and ``n_lines`` (lines with a word)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumns({
        "_words": F.filter(F.split(whole, WHITE), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    })
    return out.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeated_words(F.col("_hashes")))
        .otherwise(F.lit(0))
        .cast("long"),
    ).drop("_words", "_lines", "_hashes")


def with_failures(metrics: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``soft_failed``."""
    n = F.col("n_words")
    return metrics.withColumns({
        "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n),
        "soft_failed": (100 * F.col("n_symbols") > SYMBOL_PERCENT * n)
        | (F.col("word_chars") < 2 * n)
        | (F.col("word_chars") > 20 * n)
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines")),
    })


def host_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, failures, the shrunk rate, and ``host_rejected``."""
    hosts = judged.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("n_failed"),
    )
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    fitted = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(PRIOR_LOW), F.least(F.lit(PRIOR_HIGH), fitted))).otherwise(F.lit(PRIOR_HIGH))
    # a scalar subquery: one value, whatever the input
    prior = moments.select(F.struct("m", strength.alias("strength"))).scalar()
    shrunk = (F.col("n_failed") + F.col("_prior.m") * F.col("_prior.strength")) / (F.col("n_docs") + F.col("_prior.strength"))
    m, strength = F.col("_prior.m"), F.col("_prior.strength")
    limit = F.least(F.lit(HOST_LIMIT), m + HOST_DEVIATIONS * F.sqrt(m * (1 - m) / (strength + 1)))
    return (
        hosts.withColumn("_prior", prior)
        .withColumn("host_rate", shrunk)
        .select("_host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > limit).alias("host_rejected"))
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) with the counts, ``base_failed``,
    ``soft_failed``, ``host_rejected`` and ``kept``. Counts are worked out once
    and written; hosts are aggregated from the written columns."""
    names = docs.columns if keep is None else keep
    clash = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in clash.items()))
    judged = with_failures(with_metrics(own, clash[text]))
    judged = written(
        judged.select(
            *dict.fromkeys([*(clash[c] for c in names), clash[host]]), *METRICS, "n_lines", "base_failed", "soft_failed"
        ),
        "quality",
    )
    verdicts = written(
        host_verdicts(judged, clash[host]).where("host_rejected").select("_host", "host_rejected"), "hosts"
    )
    joined = judged.withColumn("_host", F.coalesce(F.col(clash[host]).cast("string"), F.lit(""))).join(
        verdicts, "_host", "left"
    )
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    measured = [F.col(c) for c in [*METRICS, "base_failed", "soft_failed"] if c not in names]
    return joined.select(
        *(F.col(clash[c]).alias(c) for c in names),
        *measured,
        rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~(rejected & F.col("soft_failed"))).alias("kept"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return judged.select("doc_id", *METRICS, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not kept go."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text", "source")
    return judge(packed, keep=["_doc"]).where("kept").select("_doc.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT r, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2
), hit AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN hit USING (r)
), f AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    (100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
     OR 100 * n_dup_lines > 30 * n_lines) AS soft_failed FROM m
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS k FROM f GROUP BY host
), p AS (
  SELECT avg(k / n) AS mean, var_samp(k / n) AS var FROM h
), s AS (
  SELECT mean, CASE WHEN var > 0 THEN greatest(1.0, least(1000.0, mean * (1 - mean) / var - 1)) ELSE 1000.0 END AS str FROM p
), v AS (
  SELECT host, (k + mean * str) / (n + str) > least(0.5, mean + 3 * sqrt(mean * (1 - mean) / (str + 1))) AS bad FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (bad AND soft_failed) AS kept
FROM f JOIN v USING (host)
"""
