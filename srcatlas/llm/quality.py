r"""Quality rules with host verdicts, in DataFrame functions alone.

Each document gets its counts and rule failures. Failures are summed by host; a
host's rate is shrunk towards the mean of all hosts by a beta prior that is fitted
to the hosts by moments, and a host whose shrunk rate reaches the limit loses all its
documents. Verdicts are joined back on (host, salt), so a host with a third of all
rows is spread over the join's partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.llm._store import materialize

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 5
#: A document is short below so many words, repetitive above so many hundredths of repeated words.
MIN_WORDS, MAX_REPEAT = 10, 20
#: Shares of symbols in word characters and of repeated lines in lines with a word that count against the host.
MAX_SYMBOLS, MAX_DUP_LINES = 10, 30
#: A host is rejected at this shrunk failure rate.
HOST_LIMIT = 0.5
SALTS = 32


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words in those k-word windows whose words occur twice or more in the array, the first occurrence included."""
    hashed = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(w[i + o] for o in range(k)))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(F.transform(s, lambda x, j: F.when(((j > 0) & (F.try_element_at(s, F.greatest(j, F.lit(1)))["h"] == x["h"])) | F.coalesce(F.try_element_at(s, j + 2)["h"] == x["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        return F.aggregate(F.array_sort(twice), start, lambda a, i: F.struct((i + k).alias("upto"), (a["n"] + i + k - F.greatest(i, a["upto"])).alias("n")), lambda a: a["n"])

    # Distinct hashes are counted first; only texts in which a window repeats are sorted.
    some = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) < k, F.lit(0)).otherwise(some)


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    base = base.withColumns({"w": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)})
    counted = base.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    rules = {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT,
        "symbols": F.col("n_symbols") * 100 > F.col("word_chars") * MAX_SYMBOLS,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINES,
    }
    return counted.withColumns(rules).withColumn("base_failed", F.col("short") | F.col("repetitive"))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta of the prior, from the hosts' weighted mean and the variance that sampling leaves unexplained."""
    total = hosts.agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("x"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("h"), F.coalesce(F.sum(F.col("failed") * F.col("failed") / F.col("n")), F.lit(0.0)).alias("xx")).first()
    if not total.n:
        return 1.0, 1.0
    mean = min(max(total.x / total.n, 1e-6), 1 - 1e-6)
    spread = total.xx / total.n - (total.x / total.n) ** 2 - mean * (1 - mean) * total.h / total.n
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), the rules, base_failed, host_rate double, kept boolean.

    A null text has no words (and fails as short). A null host is a host of its own.
    A host fails by documents that fail any rule; kept is false if base_failed or if
    the host's shrunk rate reaches `limit`. Repeated rows count each. An empty table
    gives an empty result; other columns are not read.
    """
    found = materialize(measure(docs, id_col, text_col, host_col), "measured")
    failed = F.col("short") | F.col("repetitive") | F.col("symbols") | F.col("dup_lines")
    hosts = materialize(found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failed")), "hosts")
    alpha, beta = prior(hosts)
    rates = hosts.select(F.col("host").alias("__host"), ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    judged = salted.join(rates, salted["host"].eqNullSafe(rates["__host"]) & (salted["__salt"] == rates["__s"]))
    return judged.drop("__host", "__s", "__salt").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < limit))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS s, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS f FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, f) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT s + o) AS n FROM g, (SELECT unnest(range(0, 5)) AS o) WHERE g.n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS any_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE any_failed))::DOUBLE AS x FROM b GROUP BY source),
t AS (SELECT sum(x) / sum(n) AS p, greatest(1e-6, least(1 - 1e-6, sum(x) / sum(n))) AS mu, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 AS v, count(*) / sum(n) AS f FROM h),
k AS (SELECT mu, CASE WHEN v - mu * (1 - mu) * f > 0 THEN least(1e6, greatest(1.0, mu * (1 - mu) / (v - mu * (1 - mu) * f) - 1)) ELSE 1e6 END AS weight FROM t),
z AS (SELECT source, (x + mu * weight) / (n + weight) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.5 AS kept
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""
