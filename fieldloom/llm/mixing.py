"""Mixing sources to target weights by soft membership, with DataFrame functions only.

1. Classifier. Words of labelled documents are hashed to BUCKETS; per bucket and domain they are counted, and a bucket's
   weight for a domain is its log odds there, shrunk to 0 by a background of BACKGROUND words so that rare words say
   little. The labelled rows are a sample of at most SAMPLE_ROWS by hash of the id, so they can be broadcast.
2. Posteriors. Every word of every document adds its bucket's weights (at most BUCKETS rows, broadcast); the sums,
   at most CLIP below the best, give soft memberships.
3. Rates. Nonnegative rates r of documents minimise
   sum_k ((T_k - target_k) / B) ** 2 / s_k + RIDGE * sum_i n_i / B * (r_i - 1) ** 2, T_k = sum_i r_i n_i p_ik,
   by projected gradient steps in the metric of tokens. A step is one aggregate of as many sums as there are domains
   and a column expression; the table stays distributed and is checkpointed every few steps.

Domains come from the labels: toxic; else quality 0 is "low", quality 1 is "clean".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_key, without

DOMAINS = ("clean", "low", "toxic")
#: Share of tokens that each domain shall have.
TARGETS = {"clean": 0.94, "low": 0.05, "toxic": 0.01}
SAMPLE_ROWS, BUCKETS, BACKGROUND, CLIP = 20_000, 1 << 17, 20_000.0, 8.0
STEPS, RIDGE, CLOSE, CHECKPOINT_EVERY = 60, 1e-4, 1e-5, 10
BLANKS = " \t\n\x0b\x0c\r"


def sample(labels: DataFrame, id_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, domain number: of each labelled id once (toxic before low before clean), at most so many by hash of the id."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    each = labels.select(F.col(id_col).alias("_fl_label_id"), kind.alias("_fl_domain")).where("_fl_label_id is not null and _fl_domain is not null")
    return each.groupBy("_fl_label_id").agg(F.max("_fl_domain").alias("_fl_domain")).orderBy(F.xxhash64("_fl_label_id"), "_fl_label_id").limit(rows)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("long")


def words(text: Column) -> Column:
    """Words without leading or trailing blanks; one empty word for a text without any."""
    return F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))), r"[\x20\x09-\x0D]+")


def bucket_weights(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...), log priors of the domains."""
    both = docs.select(F.col(id_col).alias("_fl_id"), F.col(text_col).alias("_fl_text")).join(F.broadcast(labelled), F.col("_fl_id") == F.col("_fl_label_id"))
    each = both.select("_fl_domain", F.explode(words(F.col("_fl_text"))).alias("_fl_word")).where("_fl_word <> ''").select("_fl_domain", bucket(F.col("_fl_word")).alias("bucket"))
    counts = checkpointed(each.groupBy("bucket").agg(*[F.count_if(F.col("_fl_domain") == k).alias(f"c{k}") for k in range(len(DOMAINS))]))
    n = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(DOMAINS))]).first()
    size = labelled.groupBy("_fl_domain").count().collect()  # one row a domain
    rows = {r["_fl_domain"]: r["count"] for r in size}
    everything = sum(n) or 1
    share = sum((F.col(f"c{k}") for k in range(len(DOMAINS))), F.lit(0)) / F.lit(float(everything))
    weight = [F.log((F.col(f"c{k}") + BACKGROUND * share) / (F.lit(float(n[k]) + BACKGROUND)) / share).alias(f"w{k}") for k in range(len(DOMAINS))]
    total = sum(rows.values())
    return counts.select("bucket", *weight), [math.log((rows.get(k, 0) + 1) / (total + len(DOMAINS))) for k in range(len(DOMAINS))]


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float], id_col: str, text_col: str) -> DataFrame:
    """_fl_row, _fl_id, _fl_key, n_tokens, p0, p1, ... of each row of docs."""
    each = docs.select(F.monotonically_increasing_id().alias("_fl_row"), F.col(id_col).alias("_fl_id"), text_key(F.col(text_col)).alias("_fl_key"), words(F.col(text_col)).alias("_fl_words"))
    each = each.select("_fl_row", "_fl_id", "_fl_key", F.explode("_fl_words").alias("_fl_word")).select("_fl_row", "_fl_id", "_fl_key", F.when(F.col("_fl_word") != "", bucket(F.col("_fl_word"))).alias("bucket"))
    sums = each.join(F.broadcast(weights), "bucket", "left").groupBy("_fl_row", "_fl_id", "_fl_key").agg(F.count("bucket").alias("n_tokens"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(len(DOMAINS))])
    each_k = range(len(DOMAINS))
    logits = sums.select("_fl_row", "_fl_id", "_fl_key", "n_tokens", *[(F.lit(priors[k]) + F.col(f"w{k}")).alias(f"l{k}") for k in each_k])
    best = F.greatest(*[F.col(f"l{k}") for k in each_k])
    odds = logits.select("_fl_row", "_fl_id", "_fl_key", "n_tokens", *[F.exp(F.greatest(F.col(f"l{k}") - best, F.lit(-CLIP))).alias(f"e{k}") for k in each_k])
    whole = sum((F.col(f"e{k}") for k in range(len(DOMAINS))), F.lit(0.0))
    return odds.select("_fl_row", "_fl_id", "_fl_key", "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(DOMAINS))])


def _bound(at: list[float], targets: list[float], k: int) -> float:
    """What domain k may have without repeats, beside all of the first domain."""
    return at[0] if k == 0 else at[0] * targets[k] / targets[0] if targets[0] > 0 else math.inf


def fit_rates(soft: DataFrame, targets: list[float], repeats: bool) -> tuple[DataFrame, list[float], list[float]]:
    """soft with a column rate; the domains' shares before; their expected token totals after.

    The targets' total is that of all tokens if repeats are allowed. Else rates stay within 1, the first domain keeps
    all its tokens, and the other targets are upper bounds beside it: a domain below its bound is left as it is, and a
    scarce one takes nothing from the others.
    """
    k_all = range(len(targets))
    totals = lambda df: [float(x or 0) for x in df.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p{k}")) for k in k_all]).first()]
    now = soft.withColumn("rate", F.lit(1.0))
    at = totals(now)
    tokens = sum(at)
    if not tokens:
        return now, [0.0 for _ in k_all], at
    shares = [x / tokens for x in at]
    wanted = [targets[k] * tokens if repeats else min(at[k], _bound(at, targets, k)) for k in k_all]
    step = 1 / (1 + RIDGE)
    for i in range(1, STEPS + 1):
        if max(abs(a - w) for a, w in zip(at, wanted, strict=True)) <= CLOSE * tokens:
            break
        pull = [(at[k] - wanted[k]) / tokens / shares[k] if shares[k] > 0 else 0.0 for k in k_all]
        moved = F.col("rate") * (1 - step * RIDGE) + step * RIDGE
        for k in k_all:
            moved = moved - F.col(f"p{k}") * (step * pull[k])
        now = now.withColumn("rate", F.greatest(F.lit(0.0), moved if repeats else F.least(F.lit(1.0), moved)))
        if i % CHECKPOINT_EVERY == 0:
            now = checkpointed(now)
        at = totals(now)
    return now, shares, at


def _mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], repeats: bool, id_col: str, text_col: str, examples: DataFrame | None) -> DataFrame:
    labelled = checkpointed(sample(labels, id_col))
    weights, priors = bucket_weights(docs if examples is None else examples, labelled, id_col, text_col)
    soft = checkpointed(posteriors(docs, weights, priors, id_col, text_col))
    want = [targets[d] for d in DOMAINS]
    rated, shares, _ = fit_rates(soft, want, repeats)
    chance = F.pmod(F.xxhash64(F.col("_fl_id"), F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    top = F.greatest(*[F.col(f"p{k}") for k in range(len(DOMAINS))])
    short = F.lit(False)
    for k in range(len(DOMAINS)):
        if shares[k] <= (want[k] if repeats else _bound(shares, want, k)):
            short = short | (F.col(f"p{k}") == top)
    copies = F.floor(F.col("rate") + chance)
    return rated.select(
        "_fl_id", "_fl_key", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate",
        F.when(short, F.greatest(copies, F.lit(1))).otherwise(copies).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text", examples: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id, n_tokens, p_<domain>, rate, copies.

    The classifier is fitted on the labelled rows of examples (docs, if none are given): where filters have taken rows
    out of docs before, examples are the rows before them, so that a domain they nearly emptied is still known.
    copies rounds the rate up or down by a hash of the id, so that its mean is the rate; a document whose likeliest
    domain has less than its target (without repeats: its bound) keeps one copy at least. Null and empty texts have no tokens and the priors as
    memberships. Labels with a null id or neither quality nor toxic are left out; without labels all documents have the
    priors. Rows with a null or repeated id are rows of their own; an empty table gives none; other columns are ignored.
    """
    return _mix(docs, labels, targets, repeats, id_col, text_col, examples).drop("_fl_key").withColumnRenamed("_fl_id", id_col)


def thinned(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", examples: DataFrame | None = None) -> DataFrame:
    """docs without those that the mix gives no copy, none repeated, with all their columns; examples as in mix."""
    mixed = _mix(docs, labels, targets, False, id_col, text_col, examples)
    dropped = checkpointed(mixed.where("copies < 1").select(F.col("_fl_id").alias("_fl_drop_id"), F.col("_fl_key").alias("_fl_drop_key")))
    return without(docs, dropped, id_col, text_col)
