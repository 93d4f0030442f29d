"""Quality rules: counted rules and a hashed n-gram log-likelihood ratio.

Only DataFrame functions are used. Texts are cut into runs of letters, digits
and underscores, and runs of other characters; one and two such pieces in a row
are the n-grams, hashed into a fixed number of buckets. Two multinomials over
the buckets are counted over all documents: the raw corpus, and the trusted
target. A document's score is the mean over its n-grams of
``log(target share / raw share)``; a document below the threshold is rejected.

Results for odd input: a null or empty text has no words, zero counts, a ratio
of 0 and fails the base rules. Texts of any length are used whole. Repeated
rows are judged one by one (equal text, equal result); an empty table gives an
empty result. Columns named like the added ones are replaced; others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
SPACE_RUN = SPACE + "+"
SYMBOL = r"[#*$%&|<>]"
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules.

    ``buckets``: hash buckets of the n-grams; the driver holds one number each.
    ``smoothing``: added to every bucket's count, times the bucket's share in
    the raw corpus for the target.
    ``threshold``: least mean log ratio of a kept document.
    ``trusted_words``: least words of a document of the trusted target.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    buckets: int = 10_000
    smoothing: float = 1.0
    threshold: float = -0.35
    trusted_words: int = 50


def paired(values: str, step: int) -> Column:
    """Hashes of each value of an array with the one ``step`` places on; the last ``step`` have none."""
    rest = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, rest), F.slice(values, step + 1, rest), lambda x, y: F.xxhash64(x, y))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACES))
    split = F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    cut = docs.drop(*COUNTS).withColumns({"_words": split, "_lines": lines})
    counted = cut.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        paired("_words", 1).alias("_windows"),
    ).drop("_words", "_lines")
    # Each step hashes two windows that touch to one of twice the words.
    windowed = counted
    for size in (2, 4):
        windowed = windowed.withColumn("_windows", paired("_windows", size))
    # Only texts in which a window repeats are sorted to find where.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    by_hash = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_windows = windowed.withColumn("_sorted", F.when(repeats, by_hash)).drop("_windows")

    def in_run(entry: Column, j: Column) -> Column:
        same_before = F.get("_sorted", j - 1)["h"] == entry["h"]
        same_after = F.get("_sorted", j + 1)["h"] == entry["h"]
        return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_sorted", in_run), lambda entry: entry["i"]))
    placed = sorted_windows.withColumn("_starts", starts).drop("_sorted")
    reach = F.transform(
        "_starts",
        lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1), p + WINDOW) - p),
    )
    covered = F.aggregate(reach, F.lit(0), lambda total, r: total + r)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_starts"
    )


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )


def trusted(rules: Rules, text: str = "text") -> Column:
    """The trusted target: long enough, no symbol of the rules, no shouting."""
    whole = F.coalesce(F.col(text), F.lit(""))
    right = ~whole.rlike(SYMBOL) & ~whole.rlike(r"\p{Lu}{4}")
    if rules.trusted_words < 2:
        return right
    # The space before the last word that is asked for; what follows isn't looked at.
    long_enough = rf"^{NO_SPACE}*+(?:{SPACE}++{NO_SPACE}++){{{rules.trusted_words - 2}}}+{SPACE}"
    return right & whole.rlike(long_enough)


def cut_up(text: str = "text") -> Column:
    """Pieces of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(PIECE), F.lit(0))


def bucket(value: Column, rules: Rules) -> Column:
    return F.pmod(value, F.lit(rules.buckets)).cast("int")


def bucket_counts(docs: DataFrame, rules: Rules, text: str = "text", target: Column | None = None) -> DataFrame:
    """``bucket raw target``: n-grams per bucket over all documents and over the trusted ones."""
    flag = F.coalesce(trusted(rules, text) if target is None else target, F.lit(False))
    pieces = docs.select(cut_up(text).alias("_pieces"), flag.alias("_t"))
    # Not exploded as a bare column: Spark would infer a filter on its size, and cut the texts up for it again.
    after = F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 1, F.lit(0)))
    placed = pieces.select("_t", F.explode(F.arrays_zip(F.col("_pieces").alias("one"), after.alias("next"))).alias("_n"))
    # One or two pieces in a row; the last one has no successor.
    one = F.xxhash64("_n.one")
    two = F.when(F.col("_n.next").isNotNull(), F.xxhash64(one, F.xxhash64("_n.next")))
    ngrams = placed.select("_t", F.explode(F.array(bucket(one, rules), bucket(two, rules))).alias("bucket"))
    # Added up per task before the shuffle: at most two rows per bucket and task.
    by_flag = ngrams.filter("bucket IS NOT NULL").groupBy("bucket", "_t").agg(F.count(F.lit(1)).alias("n"))
    return by_flag.groupBy("bucket").agg(
        F.sum("n").alias("raw"), F.sum(F.when(F.col("_t"), F.col("n")).otherwise(F.lit(0))).alias("target")
    )


def log_ratios(counts: DataFrame, rules: Rules) -> list[float]:
    """One log ratio per bucket; the driver gets at most ``rules.buckets`` rows."""
    found = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw_total = sum(r for r, _ in found.values())
    target_total = sum(t for _, t in found.values())
    ratios = []
    for bucket in range(rules.buckets):
        raw, target = found.get(bucket, (0, 0))
        raw_share = (raw + rules.smoothing) / (raw_total + rules.smoothing * rules.buckets)
        target_share = (target + rules.smoothing * rules.buckets * raw_share) / (
            target_total + rules.smoothing * rules.buckets
        )
        ratios.append(log(target_share / raw_share))
    return ratios


def with_ratio(docs: DataFrame, ratios: list[float], rules: Rules, text: str = "text") -> DataFrame:
    """Adds ``log_ratio``: the mean log ratio of a text's n-grams, 0 without any."""
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def added(total: Column, value: Column) -> Column:
        return total + F.get(weights, F.pmod(value, F.lit(rules.buckets)))

    def mean(hashes: Column) -> Column:
        rest = F.greatest(F.size(hashes) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(hashes, 1, rest), F.slice(hashes, 2, rest), lambda x, y: F.xxhash64(x, y))
        total = F.aggregate(pairs, F.aggregate(hashes, F.lit(0.0), added), added)
        return F.when(F.size(hashes) > 0, total / (F.size(hashes) + rest)).otherwise(F.lit(0.0))

    hashes = F.transform(cut_up(text), lambda piece: F.xxhash64(piece))
    # The hashes are bound to a name, so the text is cut up once for all uses.
    return docs.withColumn("log_ratio", F.transform(F.array(hashes), mean)[0])


def judged(docs: DataFrame, rules: Rules = Rules(), text: str = "text", target: Column | None = None) -> DataFrame:
    """All rows with counts, ``log_ratio``, ``base_failed`` and ``kept``."""
    ratios = log_ratios(bucket_counts(docs, rules, text, target), rules)
    scored = with_ratio(base_counts(docs, text), ratios, rules, text)
    failed = scored.withColumn("base_failed", base_failed(rules))
    kept = ~F.col("base_failed") & (F.col("log_ratio") >= rules.threshold)
    # Generated, so that a filter on the verdict stays above it. Pushed down, the
    # filter would hold the expressions of all steps, multiplied at each of them.
    return failed.withColumn("kept", F.explode(F.array(kept)))
