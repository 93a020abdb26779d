"""Quality rules: counts over a text, and a hashed n-gram log-likelihood ratio.

Tokens are lower-cased runs of letters, digits and ``_``, and runs of other signs. Their unigrams and bigrams
fall into ``BUCKETS`` by hash. Two multinomials over the buckets are fitted: one on trusted documents, one on
all documents. A text's score is the mean, over its n-grams, of the logarithm of the ratio of the
two; below one threshold for all documents it is rejected.

Trusted documents and the labelled rows that set the threshold are bounded samples (``EXAMPLES`` rows of each
label, the first by a hash of the id). The threshold is the cut that rejects the least share of trusted and
keeps the least share of distrusted ones; a trusted document lost counts ``TRUST`` times as much. Without trusted rows
all texts score 0 and nothing is rejected for its score; without distrusted ones the cut is below every trusted score.

Only column expressions run here. Null and empty texts have no words; they fail the base rules. Rows are
judged one by one, so repeated rows get the same verdict; other columns do not matter.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import text_of

BUCKETS = 8192
EXAMPLES = 20_000
TRUST = 4.0
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BINS = 200  # of scores, per unit
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) with the counts of the base rules and their verdict."""
    words = F.array_remove(F.split("text", r"[ \t-\r]+"), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    rows = rows.select("*", words.alias("words"), lines.alias("lines"))
    windows = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    )
    rows = rows.select(
        "row",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Windows are sorted only where one occurs twice.
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select("row", "text", *COUNTS[:4], F.when(repeated, placed).alias("placed"))
    twice = F.filter(
        "placed",
        lambda x, k: F.coalesce(x["h"] == F.get("placed", k - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("placed", k + 1)["h"], F.lit(False)),
    )
    rows = rows.select("row", "text", *COUNTS[:4], F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    reach = F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0), lambda total, n: total + n)
    rows = rows.select("row", "text", *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def sealed(rows: DataFrame) -> DataFrame:
    """The same rows. A filter above them stays above, instead of being pushed down to where every reference
    to an array would compute the array again."""
    return rows.select(F.explode_outer(F.array(F.struct("*"))).alias("_sealed")).select("_sealed.*")


def with_tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).drop("text")


def bucket(*terms: Column) -> Column:
    """The bucket of an n-gram: the hash modulo ``BUCKETS``, a power of two."""
    return F.xxhash64(*terms).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def buckets() -> Column:
    """The buckets of the unigrams and bigrams of ``tokens``."""
    single = F.transform("tokens", lambda t: bucket(t))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("tokens") - 2),
        lambda i: bucket(F.get("tokens", i), F.get("tokens", i + 1)),
    )
    return F.when(F.size("tokens") >= 2, F.concat(single, pairs)).otherwise(single)


def _literal(values: list[float]) -> Column:
    """A constant array; it is folded into the plan once."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


class Model:
    """Log ratios by bucket, and the threshold."""

    def __init__(self, ratios: list[float], threshold: float) -> None:
        self.ratios, self.threshold = ratios, threshold

    def with_score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` in the place of ``text``."""
        rows = with_tokens(rows)
        rows = rows.withColumn("buckets", buckets()).drop("tokens")
        ratios = _literal(self.ratios)
        total = F.aggregate("buckets", F.lit(0.0), lambda total, b: total + F.get(ratios, b))
        mean = F.when(F.size("buckets") > 0, total / F.size("buckets")).otherwise(F.lit(0.0))
        return rows.withColumn("score", mean).drop("buckets")


def labelled(labels: DataFrame, examples: int) -> DataFrame:
    """At most ``examples`` ids of each label: (doc_id, trusted). Small enough to send to all tasks."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [
        known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for label in (0, 1)
    ]
    return chosen[0].unionByName(chosen[1]).select("doc_id", (F.col("quality") == 1).alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """The model of a corpus ``docs`` (doc_id, text) with ``labels`` (doc_id, quality)."""
    sample = F.broadcast(labelled(labels, examples))
    texts = docs.select("doc_id", text_of().alias("text"))
    marked = with_tokens(texts.join(sample, "doc_id", "left").select("trusted", "text"))
    # The outer form, for the reason given at ``sealed``.
    counts = marked.select(F.explode_outer(buckets()).alias("bucket"), "trusted").where("bucket IS NOT NULL")
    rows = counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(F.col("trusted")).alias("target")).collect()  # BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return Model([0.0] * BUCKETS, -math.inf)
    ratios = [
        math.log((t + 1) / (n_target + BUCKETS)) - math.log((r + 1) / (n_raw + BUCKETS))
        for t, r in zip(target, raw, strict=True)
    ]
    model = Model(ratios, -math.inf)
    tried = with_counts(texts.join(sample, "doc_id").select(F.col("trusted").alias("row"), "text"))
    scored = sealed(model.with_score(tried)).where(~F.col("base_failed"))
    bins = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.count_if(F.col("row")).alias("trusted"), F.count_if(~F.col("row")).alias("junk")
    )
    model.threshold = cut([(r.bin, r.trusted, r.junk) for r in bins.collect()])  # the bins of a bounded range
    return model


def cut(bins: list[tuple[int, int, int]]) -> float:
    """The score below which to reject, from (bin, trusted, distrusted) counts; the middle of equally good cuts."""
    trusted, junk = sum(b[1] for b in bins) or 1, sum(b[2] for b in bins)
    lowest = min((b for b, t, _ in bins if t), default=0)
    if not junk:
        return lowest / BINS
    edges = sorted({b for b, _, _ in bins} | {b + 1 for b, _, _ in bins})
    loss = {e: TRUST * sum(t for b, t, _ in bins if b < e) / trusted + sum(j for b, _, j in bins if b >= e) / junk for e in edges}
    best = [e for e in edges if loss[e] <= min(loss.values()) + 1e-12]
    return (best[0] + best[-1]) / 2 / BINS


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``), the counts, base_failed, score and kept."""
    rows = with_counts(docs.select(F.struct("*").alias("row"), text_of().alias("text")))
    scored = model.with_score(rows)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))
    return sealed(scored.withColumn("kept", kept))
