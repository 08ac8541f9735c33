"""Secret scan: fixed patterns, and a battery of randomness tests on every other long token.

Base kinds (fixed patterns): ``assign`` (a key word, a sign and a value), ``access`` (an access key id) and ``hex``. Spans are
in code points, end exclusive.

The method adds kind ``random``. A token is a run of at least ``MIN_TOKEN`` letters, digits, ``+ / _ -`` with optional ``=`` at
its end. Its encoding is the smallest alphabet that holds it (decimal, hexadecimal, letters of one case, base 32, lower base 36, base
62, base 64). Three tests look at it: uniform use of the alphabet, runs, and the dependence of neighbours. Each has two sides.

- *Against randomness*: chi-squared for uniform use, the number of runs above and below the middle, the correlation of
  neighbours; their p-values are joined by the Cauchy combination. A token stays if randomness is not refused at ``REFUSE``.
- *Against ordinary text*: the same three features as likelihood ratios of the random token to an ordinary one. Uniformity:
  symbol counts under equal shares against letter shares of running text, in the likeliest of a few ``STYLES`` of writing.
  Runs: changes of character class, where a capital that opens a word counts once. Neighbours: each symbol given the one before it, as vowels and
  consonants alternate in text and not in a key. Under ordinary text each ratio has expectation 1 at most; so has their mean, divided by
  the number of encodings as the encoding was picked from the token. Its inverse is thus a p-value.

These p-values go into the step-up rule. Long tokens reach far smaller ones than short tokens, so discoveries are controlled within
strata of length: the Benjamini-Hochberg line at ``FALSE_SHARE`` is drawn in each stratum over all different tokens of the corpus,
however often each is copied. For that only counts on a fixed grid of log p are shuffled; the grid's upper edges stand for the
p-values, which keeps the bound on the safe side. Digits alone are ordinary (a style), so a random number is not reported.

Everything is DataFrame functions. Defined cases: null text counts as empty, no spans; repeated rows and equal ids are judged row by
row; ties on the grid are all in or all out; extra columns are ignored. Tokens that overlap a base span are left to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickmill.llm.common import stored
from wickmill.llm.pseudonyms import let

# Fixed patterns of the base kinds, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 12

MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}={{0,2}}"
REFUSE = 0.001
FALSE_SHARE = 0.05
# Letters in running text of European languages, per mille, a to z, rounded.
LETTERS = (80, 15, 30, 42, 140, 16, 18, 40, 72, 5, 10, 48, 27, 72, 62, 24, 6, 65, 66, 72, 42, 14, 14, 4, 10, 8)
VOWELS = "aeiouy"
# Share of vowels after a vowel, and after a consonant.
VOWEL_AFTER = (0.2, 0.5)
# Styles of ordinary tokens: shares of small letters, capitals, digits and separators.
STYLES = {
    "words": (0.90, 0.03, 0.03, 0.04),
    "camel": (0.74, 0.14, 0.04, 0.08),
    "capitals": (0.03, 0.90, 0.03, 0.04),
    "slug": (0.45, 0.05, 0.35, 0.15),
    "number": (0.05, 0.05, 0.80, 0.10),
}
# Greatest share of class changes between neighbours in ordinary tokens.
CHANGES = 0.25
# First lengths of the strata.
STRATA = (20, 24, 32, 48, 64, 128)
# The grid of -ln p: steps of 1/8 up to 125.
STEP, CELLS = 8, 1000

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Alphabets by name, smallest first.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}


# Elements of one inner fold.
CHUNK = 256


def walk(items: Column, first: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """An array of ``emit(state, next state, item)`` along ``items``, where ``step(state, item)`` gives the next state.

    Folds go over chunks and, inside, over their items, so appending results costs little more than the results themselves.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(state: Column, item: Column) -> Column:
        return let(
            step(state["state"], item),
            lambda s: F.struct(s.alias("state"), F.concat(state["out"], F.array(emit(state["state"], s, item))).alias("out")),
        )

    def outer(state: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * CHUNK + 1, CHUNK), F.struct(state["state"].alias("state"), none.alias("out")), inner)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(state["out"], p["out"]).alias("out")))

    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    walked = F.aggregate(chunks, F.struct(first.alias("state"), none.alias("out")), outer)["out"]
    return F.when(F.size(items) > 0, walked).otherwise(none)


SPANS = "struct<start:int,end:int,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """start, end and value of every leftmost, non-overlapping match: what lies between matches gives the places."""
    none = F.array().cast(f"array<{SPANS}>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pieces = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def span(at: Column, end: Column, piece: Column) -> Column:
        return F.struct((at + piece["gap"]).alias("start"), end.alias("end"), piece["value"].alias("value"))

    # There is one gap more than there are matches.
    held = F.filter(pieces, lambda p: p["value"].isNotNull())
    found = let(held, lambda items: walk(items, F.lit(0), lambda at, p: at + p["gap"] + F.length(p["value"]), span, SPANS))
    return F.when(text.rlike(pattern), found).otherwise(none)


def apart(tokens: Column, taken: Column) -> Column:
    """Tokens that share no character with a taken span, by one walk over all spans in order."""

    def labelled(spans: Column, is_token: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(is_token).alias("token"), s["end"].alias("end"), s["value"].alias("value")),
        )

    both = F.array_sort(F.concat(labelled(tokens, True), labelled(taken, False)))

    def free(items: Column) -> Column:
        # Each span with what comes next; tokens do not overlap each other, so an overlapping neighbour is a taken span.
        paired = F.transform(items, lambda s, i: F.struct(s.alias("span"), F.get(items, i + 1)["start"].alias("next")))
        covered = lambda end, s: F.when(s["span"]["token"], end).otherwise(F.greatest(end, s["span"]["end"]))

        def judge(end: Column, _: Column, s: Column) -> Column:
            span = s["span"]
            good = span["token"] & (end <= span["start"]) & F.coalesce(s["next"] >= span["end"], F.lit(True))
            return F.when(good, F.struct(span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value")))

        return F.filter(let(paired, lambda all_: walk(all_, F.lit(0), covered, judge, SPANS)), lambda s: s.isNotNull())

    return F.when(F.size(taken) == 0, tokens).otherwise(let(both, free))


def _keyed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number per row), assign, access, hex (arrays of start, end, value) and tokens not inside them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(matches(F.col("text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE)
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id", assigned.alias("assign"), matches(F.col("text"), ACCESS).alias("access"), matches(F.col("text"), HEX).alias("hex"),
        matches(F.col("text"), TOKEN).alias("tokens"),
    )
    return found.withColumn("tokens", apart(F.col("tokens"), F.concat("assign", "access", "hex")))


def _upper_tail(z: Column) -> Column:
    """P(normal > z): a fixed five-term approximation of the error function, absolute error below 2e-7."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(value: Column) -> Column:
    body = F.regexp_replace(value, "=+$", "")
    special = lambda letters: letters.replace("-", r"\-")
    return F.coalesce(*(F.when(body.rlike(f"^[{special(a)}]+$"), F.lit(name)) for name, a in ALPHABETS.items()))


def test_tokens(tokens: DataFrame) -> DataFrame:
    """``tokens(value, ...)`` with ``p_random`` (the tests against randomness) and ``log_p_text`` (those against ordinary text)."""
    body = F.regexp_replace("value", "=+$", "")
    alphabet = F.coalesce(*(F.when(F.col("encoding") == name, F.lit(a)) for name, a in ALPHABETS.items()))
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    named = tokens.withColumn("encoding", encoding(F.col("value"))).withColumn("_alphabet", alphabet)
    named = named.withColumn("_chars", chars).withColumn("_n", F.size("_chars").cast("double")).withColumn("_k", F.length("_alphabet").cast("double"))
    placed = named.withColumn("_x", F.transform("_chars", lambda c: F.call_function("instr", F.col("_alphabet"), c) - 1))
    n, k, x = F.col("_n"), F.col("_k"), F.col("_x")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)).cast("double"))
    chi = k / n * total(F.transform(counts, lambda c: c * c)) - n
    df = k - 1
    # Wilson and Hilferty: the cube root of chi-squared per degree is nearly normal.
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    above = F.transform(x, lambda v: (v >= k / 2).cast("double"))
    n_1 = total(above)
    n_2 = n - n_1
    pairs = F.sequence(F.lit(0), F.size(x) - 2)
    runs = 1 + total(F.transform(pairs, lambda i: (F.get(above, i) != F.get(above, i + 1)).cast("double")))
    mean_runs = 1 + 2 * n_1 * n_2 / n
    var_runs = 2 * n_1 * n_2 * (2 * n_1 * n_2 - n) / (n * n * (n - 1))
    z_runs = F.when(var_runs > 0, (runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))
    mid = (k - 1) / 2
    product = total(F.transform(pairs, lambda i: (F.get(x, i) - mid) * (F.get(x, i + 1) - mid)))
    z_serial = product / ((k * k - 1) / 12) / F.sqrt(n - 1)
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    tests = [clip(_upper_tail(z_chi)), clip(2 * _upper_tail(F.abs(z_runs))), clip(2 * _upper_tail(F.abs(z_serial)))]
    cauchy = sum((F.tan((0.5 - p) * F.lit(3.141592653589793)) for p in tests[1:]), F.tan((0.5 - tests[0]) * F.lit(3.141592653589793))) / 3
    p_random = 0.5 - F.atan(cauchy) / F.lit(3.141592653589793)

    log_e = _against_text(n, k)
    return (
        placed.withColumn("p_random", p_random).withColumn("_kinds", F.transform("_chars", _class)).withColumn("_vowels", F.transform("_chars", _vowel))
        .withColumn("log_p_text", F.least(-log_e, F.lit(0.0)))
        .drop("_alphabet", "_chars", "_n", "_k", "_x", "_kinds", "_vowels")
    )


def _class(c: Column) -> Column:
    """0 small letter, 1 capital, 2 digit, 3 separator."""
    return F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)


def _vowel(c: Column) -> Column:
    """1 vowel, 0 consonant, null for what is no letter."""
    return F.when(_class(c) < 2, F.lower(c).isin(*VOWELS).cast("int"))


def _against_text(n: Column, k: Column) -> Column:
    """Log of the joined likelihood ratio, from ``_chars``, ``_kinds``, ``_vowels``, length and size of the alphabet."""
    kinds, vowels = F.col("_kinds"), F.col("_vowels")
    whole = sum(LETTERS)
    of_letter = F.array(*(F.lit(math.log(m / whole)) for m in LETTERS))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    log_letters = total(
        F.transform("_chars", lambda c: F.coalesce(F.get(of_letter, F.call_function("instr", F.lit(_LOWER), F.lower(c)) - 1), F.lit(0.0)))
    )

    def number_of(kind: int) -> Column:
        return F.size(F.filter(kinds, lambda v: v == kind)).cast("double")

    n_of = [number_of(kind) for kind in range(4)]

    def style(shares: tuple[float, ...]) -> Column:
        each = (shares[0], shares[1], shares[2] / 10, shares[3] / 4)
        return sum((n_of[i] * math.log(p) for i, p in enumerate(each)), F.lit(0.0))

    uniform = -n * F.log(k) - F.greatest(*map(style, STYLES.values())) - log_letters

    pairs = F.sequence(F.lit(0), F.size(kinds) - 2)
    # A capital and the small letter behind it are one word's opening; separators divide words.
    change = lambda a, b: (a != b) & (a != 3) & (b != 3) & ~((a == 1) & (b == 0))
    changes = total(F.transform(pairs, lambda i: change(F.get(kinds, i), F.get(kinds, i + 1)).cast("double")))
    rates = F.coalesce(*(F.when(F.col("encoding") == name, F.lit(_change_rate(a))) for name, a in ALPHABETS.items()))
    runs = changes * F.log(rates / CHANGES) + (n - 1 - changes) * F.log((1 - rates) / (1 - CHANGES))
    runs = F.when(rates > CHANGES, runs).otherwise(F.lit(0.0))

    vowel_share = sum(LETTERS[_LOWER.index(v)] for v in VOWELS) / whole

    def neighbours(a: Column, b: Column) -> Column:
        after = F.when(a == 1, F.lit(VOWEL_AFTER[0])).otherwise(F.lit(VOWEL_AFTER[1]))
        said = F.when(b == 1, after / vowel_share).otherwise((1 - after) / (1 - vowel_share))
        return F.when(a.isNotNull() & b.isNotNull(), F.log(said)).otherwise(F.lit(0.0))

    chain = total(F.transform(pairs, lambda i: neighbours(F.get(vowels, i), F.get(vowels, i + 1))))
    # Each symbol given the one before it.
    serial = uniform - chain

    def joined(parts: Column) -> Column:
        top = F.array_max(parts)
        return top + F.log(total(F.transform(parts, lambda e: F.exp(e - top))) / 3) - math.log(len(ALPHABETS))

    return let(F.array(uniform, runs, serial), joined)


def _change_rate(alphabet: str) -> float:
    """Share of neighbours that count as a change where symbols are drawn evenly from the alphabet."""
    shares = [sum(c in part for c in alphabet) / len(alphabet) for part in (_LOWER, _UPPER, _DIGITS)]
    return sum(shares) ** 2 - sum(p * p for p in shares) - shares[0] * shares[1]


def _stratum(value: Column) -> Column:
    n = F.length(value)
    return F.greatest(*(F.when(n >= first, F.lit(k)).otherwise(F.lit(0)) for k, first in enumerate(STRATA)))


def _cell(log_p: Column) -> Column:
    """Grid cell of -ln p, rounded down, so the cell's p is never below the token's."""
    return F.least(F.floor(-log_p * STEP), F.lit(CELLS)).cast("int")


def discovery_lines(tested: DataFrame) -> DataFrame:
    """stratum, least_cell: the Benjamini-Hochberg line of each stratum over its different tokens (``digest``). Strata without one are left out."""
    counted = tested.select("stratum", "cell", "digest").distinct().groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    # Both windows hold at most CELLS + 1 rows of counts a stratum.
    whole = Window.partitionBy("stratum")
    above = whole.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.exp(-F.col("cell") / F.lit(float(STEP)))
    lined = counted.withColumn("ahead", F.sum("n").over(above)).withColumn("all", F.sum("n").over(whole))
    return lined.where(share <= FALSE_SHARE * F.col("ahead") / F.col("all")).groupBy("stratum").agg(F.min("cell").alias("least_cell"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of every document; see the module for the columns' meaning."""
    found = stored(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    tokens = found.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    tested = stored(
        test_tokens(tokens)
        .withColumn("stratum", _stratum(F.col("value")))
        .withColumn("cell", _cell(F.col("log_p_text")))
        .withColumn("digest", F.md5("value"))
        .select("row", "start", "end", "digest", "p_random", "stratum", "cell"),
        "secret-tokens",
    )
    chosen = (
        tested.join(F.broadcast(discovery_lines(tested)), "stratum")
        .where((F.col("cell") >= F.col("least_cell")) & (F.col("p_random") >= REFUSE))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("random"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.array_sort(F.concat(*(_keyed(F.col(kind), kind) for kind in KINDS[:3])))
    both = found.drop("tokens").join(chosen, "row", "left").withColumn("base", base)
    every = F.array_sort(F.concat("base", F.coalesce("random", none)))
    return both.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
