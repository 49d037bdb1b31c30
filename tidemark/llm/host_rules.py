"""Quality rules whose failures are weighed host by host.

Every document is measured and checked against the rules. The share of failing documents of a host
is uncertain where the host is small, so it is shrunk towards the other hosts: shares are taken to
follow a beta distribution, fitted to the hosts by moments. A host whose shrunk share is surely too
high for any rule loses all of its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import words
from tidemark.session import stored

# Fewer words than this, or more than this percentage of words in repeated windows,
# fail the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
# Rules by which hosts are judged: name and SQL condition over the measured columns.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_lines >= 4",
}
# Shrunk share of failing documents above which a host is rejected.
HOST_LIMIT = 0.8
# Posterior deviations by which a share must lie above the limit.
CAUTION = 1.645


def measured(documents: DataFrame, host: str) -> DataFrame:
    """Columns: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words. `n_repeat_words` counts the words in windows of three words that occur
    twice or more; windows are told apart by 64-bit fingerprints. The columns are computed in steps
    because a step refers to the arrays of the one before more than once.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    split = rows.select(
        "doc_id",
        "host",
        words("text").alias("w"),
        F.expr(r"regexp_count(text, '[#*$%&|<>]')").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "host",
        F.size("w").alias("n_words"),
        F.length(F.concat_ws("", "w")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        F.expr("size(lines) - size(array_distinct(lines))").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    windows = hashed.select(
        "*",
        F.expr(
            "CASE WHEN n_words < 3 THEN array() ELSE"
            " transform(slice(h, 1, n_words - 2), (x, i) -> xxhash64(x, h[i + 1], h[i + 2])) END"
        ).alias("g"),
    ).drop("h")
    # Without a repeated window there is nothing to sort.
    sorted_ = windows.select(
        "*",
        F.expr(
            "CASE WHEN size(array_distinct(g)) = size(g) THEN array()"
            " ELSE sort_array(transform(g, (x, i) -> struct(x AS g, i AS i))) END"
        ).alias("s"),
    ).drop("g")
    places = sorted_.select(
        "*",
        F.expr(
            "sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].g = x.g)"
            " OR (k < size(s) - 1 AND s[k + 1].g = x.g)), x -> x.i))"
        ).alias("p"),
    ).drop("s")
    covered = (
        "aggregate(p, struct(0 AS n, 0 AS until), (a, i) ->"
        " struct(a.n + i + 3 - greatest(a.until, i) AS n, i + 3 AS until), a -> a.n)"
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    return places.select(
        "doc_id",
        "host",
        *[F.col(c).cast("long").alias(c) for c in counts],
        F.expr(covered).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(rows: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Columns: host, n_documents, for each rule its shrunk share, rejected. `rows` is measured().

    The prior of a rule has the share m of all failing documents as its mean, and the strength
    1 / r - 1, where r is the part of the shares' variance that lies between hosts, found by moments
    after the chance variance within hosts is taken off. Hosts that differ by chance alone (r <= 0)
    are all given m. A host is rejected if for some rule the posterior mean less CAUTION posterior
    deviations is above the limit, so a few documents never decide. Rows without a host form one.
    """
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_documents"),
        *[F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()],
    )
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_documents").alias("n"),
        F.sum(F.expr("double(n_documents) * n_documents")).alias("squares"),
        *[F.sum(name).alias(f"{name}_x") for name in RULES],
        *[F.sum(F.expr(f"double({name}) * {name} / n_documents")).alias(f"{name}_xx") for name in RULES],
    ).first()
    shrunk, lower = [], []
    for name in RULES:
        mean, strength = _prior(
            sums["hosts"], sums["n"], sums["squares"], sums[f"{name}_x"], sums[f"{name}_xx"]
        )
        share = (
            f"{mean!r}D"
            if strength is None
            else f"({name} + {mean * strength!r}D) / (n_documents + {strength!r}D)"
        )
        weight = "1e18D" if strength is None else f"(n_documents + {strength + 1!r}D)"
        shrunk.append(F.expr(share).alias(name))
        lower.append(f"{name} - {CAUTION!r}D * sqrt({name} * (1 - {name}) / {name}_weight)")
        shrunk.append(F.expr(weight).alias(f"{name}_weight"))
    judged = hosts.select("host", "n_documents", *shrunk)
    return judged.select(
        "host",
        "n_documents",
        *RULES,
        (F.greatest(*[F.expr(x) for x in lower]) > host_limit).alias("rejected"),
    )


def _prior(hosts: int, n: int, squares: float, x: int, xx: float) -> tuple[float, float | None]:
    """Mean and strength of the prior, None if it is infinitely strong.

    `squares` is the sum of squared host sizes, `x` the failing documents, `xx` the sum over hosts
    of failing documents squared / documents.
    """
    mean = x / n if n else 0.0
    chance = mean * (1 - mean)
    room = n - squares / n - (hosts - 1) if n else 0.0
    if chance <= 0 or room <= 0:
        return mean, 0.0 if chance > 0 else None
    between = (xx - x * mean - chance * (hosts - 1)) / (chance * room)
    if between <= 0:
        return mean, None
    return mean, max(1 / min(between, 1.0) - 1, 0.0)


def judge(documents: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The columns of measured(), and base_failed, host_rejected, kept; one row per document.

    The measures are written to the shared folder, as hosts are counted first and then joined back.
    Nulls, repeated rows and extra columns have no special meaning: each row is judged by itself.
    """
    rows = stored(measured(documents, host))
    verdicts = host_verdicts(rows, host_limit).select(F.col("host").alias("of"), "rejected")
    failed = F.expr(f"({RULES['short']}) OR ({RULES['repetitive']})")
    return (
        rows.join(verdicts, F.expr("host <=> of"), "left")
        .select(*rows.columns, failed.alias("base_failed"), F.col("rejected").alias("host_rejected"))
        .withColumn("kept", F.expr("NOT base_failed AND NOT host_rejected"))
    )
