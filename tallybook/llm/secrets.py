r"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Only DataFrame functions are used. Besides the fixed kinds (``assign``,
``access``, ``hex``) every run of at least ``min_chars`` characters of
``[A-Za-z0-9+/_-]`` with an inferred encoding is tested. ``=`` after a run is
padding: it belongs to the span, but is not tested, and parts a name from its
value. The encoding is the smallest of hex, base32, base36, base62 and base64
whose alphabet holds all its characters; runs of letters of one case or of
digits only are words or numbers and have none.

Each test has a null hypothesis of sources that are not random, so that a small
p-value is evidence *for* randomness:

* alphabet uniformity: symbols drawn from few symbols that come back, whose
  frequencies have a symmetric Dirichlet law of total ``concentration``;
* runs: symbols in runs of one class (upper, lower, digit, separator) as in
  words, constants and numbers joined by separators or case, letters with the
  frequencies of words (:data:`CHAINS`, :data:`LETTERS`);
* serial correlation: a symbol is the neighbour of the one before it in the
  alphabet, or the same, with probability ``step_share``.

The statistic is the likelihood ratio of the null's source to the uniform one.
Its inverse has mean 1 at most under the null, so by Markov's inequality the
ratio is a p-value at every length; no normal approximation limits what 20
symbols can show. The factor ``len(ALPHABETS)`` pays for choosing the encoding
by the string. A string is random only if all nulls are rejected, so its p-value
is the largest of them.

Before that the chi-squared, runs and serial-correlation statistics of the
string must agree with a uniform source (:func:`p_value`): a string of which one
lies beyond its margin from the uniform value, at one-sided level ``1 - gate``,
is not random whatever its likelihood, and counts as a test with p-value 1. A
uniform string of 20 symbols fails one of them with a probability of about
0.0005. The statistics alone can't find secrets, since 20 to 40 symbols seldom
show by them that a source is *inside* the margins; so they exclude, and the
ratios are the evidence.

Over all strings of the corpus the step-up procedure of
Benjamini and Hochberg holds the share of false discoveries at ``rate``, with
weights in proportion to a string's length: long strings have more power, and
the weights spend more of the error there. Ranks come from a
histogram of ``log10(p / length)`` with steps of 0.01, rounded up, so the
table that is ranked has a fixed number of rows. Discoveries that touch no
fixed-kind span are added as kind ``random``.

Odd input: a null or empty text has no spans. Texts are used whole. Repeated
rows get equal spans, and each counts as a test. An empty table gives an empty
result. Columns of the input are kept unless they are named like an added one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, and their patterns.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Classes of symbols are upper, lower, digit and separator; a row is the class before.
CHAINS = {
    "words": [[0.10, 0.85, 0.03, 0.02], [0.06, 0.85, 0.03, 0.06], [0.05, 0.10, 0.65, 0.20], [0.15, 0.65, 0.15, 0.05]],
    "constants": [[0.85, 0.03, 0.04, 0.08], [0.10, 0.80, 0.04, 0.06], [0.15, 0.05, 0.60, 0.20], [0.70, 0.10, 0.15, 0.05]],
    "numbers": [[0.40, 0.10, 0.40, 0.10], [0.10, 0.40, 0.40, 0.10], [0.05, 0.05, 0.80, 0.10], [0.10, 0.10, 0.75, 0.05]],
}
# How often a letter comes in words of several languages of Latin script, out of LETTERS' sum.
LETTERS = dict(
    zip(
        "abcdefghijklmnopqrstuvwxyz",
        [85, 17, 32, 44, 142, 18, 19, 37, 73, 4, 8, 43, 28, 79, 57, 25, 6, 66, 70, 70, 38, 12, 12, 5, 10, 6],
    )
)
SPAN = "array<struct<kind:int,start:int,end:int>>"


@dataclass(frozen=True)
class Battery:
    min_chars: int = 20
    rate: float = 0.05
    uniformity_margin: float = 2.0
    runs_margin: float = 0.25
    serial_margin: float = 0.5
    gate: float = 0.95
    concentration: float = 0.5
    step_share: float = 0.9


def _placed(text: Column, pattern: str, matches: Column | None = None) -> Column:
    """Start, end (code points, exclusive) and text of all matches of a pattern, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if matches is None else matches
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(pieces.alias("gap"), found.alias("m"))
    walked = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")),
        lambda acc, z: F.when(z["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.length(z["gap"]) + F.length(z["m"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(z["gap"])).alias("s"),
                            (acc["at"] + F.length(z["gap"]) + F.length(z["m"])).alias("e"),
                            z["m"].alias("m"),
                        )
                    ),
                ).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    # Texts without a match, which most are, are scanned once only.
    return F.when(F.size(found) > 0, walked).otherwise(
        F.array().cast("array<struct<s:int,e:int,m:string>>")
    )


def _of_kind(kind: int, placed: Column) -> Column:
    return F.transform(
        placed,
        lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end")),
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, by start, then kind."""
    value = lambda x: F.regexp_extract(x["m"], "^" + ASSIGN, 2)
    assign = F.filter(_placed(text, ASSIGN), lambda x: F.length(value(x)) >= 6)
    spans = F.concat(
        _of_kind(0, assign), _of_kind(1, _placed(text, ACCESS)), _of_kind(2, _placed(text, HEX))
    )
    return _ordered(spans)


def _ordered(spans: Column) -> Column:
    by_start = F.array_sort(
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    )
    return F.transform(
        by_start, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    ).cast(SPAN)


def _normal_below(z: Column) -> Column:
    """The standard normal distribution function, to 8e-8 (a five-term rational fit)."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (
        0.319381530
        + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z <= 0, tail).otherwise(1.0 - tail)


def encoding(token: Column) -> Column:
    """Name of the smallest alphabet that holds the string, null for words and numbers."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    two_cases = token.rlike("[a-z]") & token.rlike("[A-Z]")
    one_case = ~two_cases
    return (
        F.when(~(mixed | two_cases), F.lit(None).cast("string"))
        .when(one_case & token.rlike("^[0-9a-fA-F]+$"), "hex")
        .when(one_case & token.rlike("^[2-7a-zA-Z]+$"), "base32")
        .when(one_case & token.rlike("^[0-9a-zA-Z]+$"), "base36")
        .when(token.rlike("^[0-9A-Za-z]+$"), "base62")
        .otherwise("base64")
    )


def _alphabet(name: Column) -> Column:
    return F.create_map(*[x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(v))])[name]


def _symbols(token: Column, name: Column) -> Column:
    plain = F.when(name.isin("hex", "base32", "base36"), F.lower(token)).otherwise(
        F.translate(token, "-_", "+/")
    )
    return F.split(plain, "")


def log_p(token: Column, name: Column, battery: Battery) -> Column:
    """Largest log10 p-value of the likelihood-ratio tests of one string; at most 0."""
    alphabet = _alphabet(name)
    every, total = ALPHABETS["base64"], sum(LETTERS.values())
    chance = [math.log(LETTERS[c.lower()] / total if c.isalpha() else 1 / 10 if c.isdigit() else 1 / 2) for c in every]
    chances = F.array(*map(F.lit, chance))
    chains = {
        chain: F.array(*[F.lit(math.log(x)) for before in rows for x in before]) for chain, rows in CHAINS.items()
    }

    def kind(place: Column) -> Column:
        return F.when(place <= 26, 0).when(place <= 52, 1).when(place <= 62, 2).otherwise(3)

    def added(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))

    def neighbours(values: Column) -> Column:
        n = F.size(values)
        return F.arrays_zip(F.slice(values, 1, n - 1).alias("a"), F.slice(values, 2, n - 1).alias("b"))

    def ratios(x: Column) -> Column:
        code, place, k = x["code"], x["place"], x["k"].cast("double")
        n = F.size(code).cast("double")
        uniform = n * F.log(k)
        # The chance of a symbol after c of its kind among i: (concentration / k + c) / (concentration + i).
        counts = F.transform(F.array_distinct(code), lambda v: F.size(F.filter(code, lambda c: c == v)))
        again = added(
            counts,
            lambda c: added(F.sequence(F.lit(0), c - 1), lambda j: F.log(battery.concentration / k + j)),
        )
        few = again - added(F.sequence(F.lit(0), F.size(code) - 1), lambda i: F.log(battery.concentration + i))
        # The first class has the four probabilities alike.
        emitted = added(place, lambda p: F.element_at(chances, p)) - math.log(len(next(iter(CHAINS.values()))))
        kinds = neighbours(F.transform(place, kind))
        moved = [
            added(kinds, lambda p, chain=chain: F.element_at(chain, p["a"] * 4 + p["b"] + 1))
            for chain in chains.values()
        ]
        # The alphabet is closed to a ring, so that every symbol has two neighbours.
        near = added(
            neighbours(code),
            lambda p: F.when(
                F.pmod(p["a"] - p["b"] + 1, x["k"]) <= 2, F.log(F.lit(battery.step_share) * k / 3)
            ).otherwise(F.log(F.lit(1 - battery.step_share) * k / (k - 3))),
        )
        largest = F.greatest(few + uniform, emitted + F.greatest(*moved) + uniform, near)
        return F.least(F.lit(0.0), (largest + math.log(len(ALPHABETS))) / math.log(10))

    symbols = _symbols(token, name)
    bound = F.array(
        F.struct(
            F.transform(symbols, lambda c: F.instr(alphabet, c) - 1).alias("code"),
            F.transform(symbols, lambda c: F.instr(F.lit(every), c)).alias("place"),
            F.length(alphabet).alias("k"),
        )
    )
    return F.transform(bound, ratios)[0]


def p_value(token: Column, name: Column, battery: Battery) -> Column:
    """Largest p-value of one string against the margins, by normal approximation."""
    alphabet = _alphabet(name)
    digits = F.transform(_symbols(token, name), lambda c: F.instr(alphabet, c) - 1)

    def tests(x: Column) -> Column:
        code, k = x["code"], x["k"].cast("double")
        n = F.size(code).cast("double")
        counts = F.transform(
            F.array_distinct(code), lambda v: F.size(F.filter(code, lambda c: c == v)).cast("double")
        )
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
        chi = squares * k / n - n
        shift = n * battery.uniformity_margin * (1 - 16 / (k * k)) * F.least(F.lit(1.0), k / 64 + 0.25)
        uniform = (chi - (k - 1) - shift) / F.sqrt(2 * (k - 1) + 4 * shift)
        pairs = F.arrays_zip(
            F.slice(code, 1, F.size(code) - 1).alias("a"), F.slice(code, 2, F.size(code) - 1).alias("b")
        )
        mean, variance = (k - 1) / 2, (k * k - 1) / 12
        changes = F.aggregate(
            pairs,
            F.lit(0.0),
            lambda s, p: s + ((p["a"] * 2 < k) != (p["b"] * 2 < k)).cast("double"),
        )
        runs = (F.abs(changes / (n - 1) - 0.5) - battery.runs_margin) * 2 * F.sqrt(n - 1)
        product = F.aggregate(
            pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean)
        )
        serial = (F.abs(product / (n - 1) / variance) - battery.serial_margin) * F.sqrt(n - 1)
        return F.greatest(_normal_below(uniform), _normal_below(runs), _normal_below(serial))

    bound = F.array(F.struct(digits.alias("code"), F.length(alphabet).alias("k")))
    return F.transform(bound, tests)[0]


def tested_strings(text: Column, battery: Battery) -> Column:
    """Start, end, length and ``level = log10(p / length)`` of every string with an encoding.

    Levels are rounded up to 0.01 and held within -30 and 0; 0 for strings that the battery excludes.
    """
    runs = _placed(text, "[A-Za-z0-9+/_-]{%d,}=*" % battery.min_chars)
    named = F.transform(
        F.transform(
            runs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.rtrim(x["m"], F.lit("=")).alias("t"))
        ),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), encoding(x["t"]).alias("k")),
    )
    coded = F.filter(named, lambda x: x["k"].isNotNull())
    return F.transform(
        coded,
        lambda x: F.struct(
            x["s"].alias("start"),
            x["e"].alias("end"),
            F.length(x["t"]).alias("n"),
            F.when(p_value(x["t"], x["k"], battery) > battery.gate, 0.0)
            .otherwise(
                F.greatest(
                    F.lit(-30.0),
                    F.least(
                        F.lit(0.0),
                        F.ceil((log_p(x["t"], x["k"], battery) - F.log10(F.length(x["t"]).cast("double"))) * 100) / 100,
                    ),
                )
            )
            .alias("level"),
        ),
    )


def discovery_level(docs: DataFrame, text: str, battery: Battery) -> float:
    """The largest level that the step-up procedure accepts, over all strings; -inf for none.

    Tests are added up by level: at most 3001 rows are ranked.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    strings = docs.select(F.explode(tested_strings(whole, battery)).alias("x"))
    levels = strings.groupBy(F.col("x.level").alias("level")).agg(
        F.count(F.lit(1)).alias("m"), F.sum("x.n").alias("chars")
    )
    rows = sorted((r["level"], r["m"], r["chars"]) for r in levels.collect())
    tests, chars = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, below = float("-inf"), 0
    for level, m, _ in rows:
        below += m
        # p / weight <= rate * rank / tests, with weight = length * tests / chars
        if 10**level * chars / tests <= battery.rate * below / tests:
            best = level
    return best


def scanned(docs: DataFrame, text: str = "text", battery: Battery = Battery()) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (kind, start, end; kinds as in :data:`KINDS`)."""
    level = discovery_level(docs, text, battery)
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns(
        {"base_spans": base_spans(whole), "_tested": tested_strings(whole, battery)}
    )
    added = F.filter(
        "_tested",
        lambda x: (x["level"] <= F.lit(level))
        & ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    random = F.transform(
        added, lambda x: F.struct(F.lit(3).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    return found.withColumn("spans", _ordered(F.concat("base_spans", random.cast(SPAN)))).drop("_tested")


def listed(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def redacted(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``found`` of :func:`scanned` with every stretch covered by spans replaced by a mark."""
    # Spans come by start, so what has been covered so far ends at `at`.
    walked = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["end"] <= acc["at"], acc)
        .when(
            (x["start"] < acc["at"]) & (acc["at"] > 0),
            F.struct(x["end"].alias("at"), acc["out"].alias("out")),
        )
        .otherwise(
            F.struct(
                x["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]),
                    F.lit(mark),
                ).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, walked).otherwise(F.col(text)))
