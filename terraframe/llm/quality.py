"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gives two histograms: character classes (lower-case ASCII letters, upper-case ones, digits, blanks, line ends,
other ASCII, everything beyond ASCII) and common words (the function words of its language, in either case, and all other words as one
bin).
References are the mean histograms of all documents of a language, over the whole table. A document is rejected when the
Jensen-Shannon distance (square root of the divergence in bits) to its language's reference is above a threshold in either
histogram. Guards: below MIN_CHARS characters or MIN_WORDS words the histogram says too little and isn't judged.

Means are weighted by document, not by length, so one huge text doesn't make a reference. The rows sent to every task are the
references, at most one a known language and one for all others.

Base rules: fewer than 50 words, or more than half of the words in repeated three-word windows.

One pass over the texts writes a small table of features; references and verdicts are made from that.

Nulls and odd inputs: null text has no words and fails the base rules. A null or unknown lang counts as "other"; "other" has no
common words of its own and is compared by characters alone. Repeated rows are each judged. Empty tables work. Other columns
pass through; of columns named as the results are, the results' win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

MIN_WORDS, MIN_CHARS, MAX_REPEATED = 50, 200, 50
MAX_CHARS_JSD, MAX_WORDS_JSD = 0.26, 0.305
COMMON = {
    "en": "the of and to in that for with is was on by from as at are this it or an be not have which",
    "de": "der die das und in zu den mit von für auf ist im nicht ein eine dem des sich auch es an werden aus",
    "fr": "le la les de des et en un une du que est pour dans qui par sur pas au plus avec ne se il",
    "es": "el la los las de que y en un una por con para es se no del al su como más o lo a",
}
CLASSES = ("lower", "upper", "digit", "blank", "line", "punct", "other")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_jsd", "words_jsd", "kept")


def features(docs: DataFrame) -> DataFrame:
    """Adds the counts of the base rules, __lang, __p (character classes) and __q (common words, all others last); one pass, no
    shuffle."""
    d = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    d = d.withColumn("__w", F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    # characters by class: each step leaves a shorter text
    d = d.withColumn("__a", F.regexp_replace("__t", "[a-z]+", "")).withColumn("__b", F.regexp_replace("__a", "[\\x20\\x09\\x0B-\\x0D]+", ""))
    d = d.withColumn("__c", F.regexp_replace("__b", "\n+", "")).withColumn("__d", F.regexp_replace("__c", "[A-Z]+", ""))
    d = d.withColumn("__e", F.regexp_replace("__d", "[0-9]+", "")).withColumn("__f", F.regexp_replace("__e", "[\\x00-\\x7F]+", ""))
    steps = [F.length(f"__{x}") for x in "tabcdef"]
    lower, blank, line, upper, digit, punct = (a - b for a, b in zip(steps, steps[1:]))
    parts = dict(lower=lower, upper=upper, digit=digit, blank=blank, line=line, punct=punct, other=steps[-1])
    d = d.withColumn("word_chars", (F.length("__t") - (blank + line)).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("__e", F.lit("[#*$%&|<>]")).cast("long"))
    size = F.greatest(F.length("__t"), F.lit(1))
    d = d.withColumn("__p", F.array(*[(parts[c] / size).cast("double") for c in CLASSES]))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    # three-word windows as hashes; the same with the position in the low bits, sorted, puts equal windows side by side
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    part = lambda i: F.slice("__h", i, F.greatest(F.size("__h") - 2, F.lit(0)))
    d = d.withColumn("__g", F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("__m", F.expr("shiftleft(-1L, length(bin(size(__g))))"))
    d = d.withColumn("__s", F.sort_array(F.transform("__g", lambda x, i: x.bitwiseAND(F.col("__m")).bitwiseOR(i.cast("long")))))
    at = lambda x: F.get("__g", x.bitwiseAND(F.bitwise_not("__m")).cast("int"))
    same = lambda a, b: (a.bitwiseXOR(b).bitwiseAND(F.col("__m")) == 0) & (at(a) == at(b))
    pair = F.zip_with("__s", F.slice("__s", 2, F.greatest(F.size("__s"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.when(same(a, b), F.array(a, b))))
    d = d.withColumn("__d2", F.flatten(F.filter(pair, lambda x: x.isNotNull())))
    d = d.withColumn("__r", F.sort_array(F.array_distinct(F.transform("__d2", lambda x: x.bitwiseAND(F.bitwise_not("__m"))))))
    gaps = F.zip_with("__r", F.slice("__r", 2, F.greatest(F.size("__r"), F.lit(1))), lambda a, b: F.when(b.isNull(), F.lit(3).cast("long")).otherwise(F.least(b - a, F.lit(3).cast("long"))))
    d = d.withColumn("n_repeat_words", F.when(F.size("__r") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    lang = F.lower(F.coalesce("lang", F.lit(""))) if "lang" in docs.columns else F.lit("")
    d = d.withColumn("__lang", F.when(lang.isin(*COMMON), lang).otherwise("other"))
    every = sorted({w for x in COMMON.values() for w in x.split()})
    d = d.withColumn("__k", F.filter(F.transform("__w", lambda w: F.lower(w)), lambda w: w.isin(every)))
    own = F.array().cast("array<string>")
    for code, words in COMMON.items():
        own = F.when(F.col("__lang") == code, F.array(*[F.lit(w) for w in words.split()])).otherwise(own)
    size = F.greatest(F.col("n_words"), F.lit(1))
    d = d.withColumn("__q", F.transform(own, lambda w: ((F.size("__k") - F.size(F.array_remove("__k", w))) / size).cast("double")))
    keep = [c for c in docs.columns]
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.length("__t").alias("__n"), "__lang", "__p", "__q")


def _bins(name: str, n: int) -> list[Column]:
    """The first n entries of a histogram, zero where it has fewer."""
    return [F.coalesce(F.get(name, F.lit(i)), F.lit(0.0)) for i in range(n)]


WIDTH = max(len(x.split()) for x in COMMON.values())


def references(feats: DataFrame) -> DataFrame:
    """Mean histograms of each language: at most len(COMMON) + 1 rows."""
    mean = lambda name, n: F.array(*[F.avg(x) for x in _bins(name, n)])
    return feats.groupBy("__lang").agg(mean("__p", len(CLASSES)).alias("__rp"), mean("__q", WIDTH).alias("__rq"))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2; the shorter one ends in zeros."""
    half = lambda a, b: F.when(a > 0, 0.5 * a * F.log2(2 * a / (a + b))).otherwise(0.0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: half(zero(a), zero(b)) + half(zero(b), zero(a)))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def judge(docs: DataFrame, with_text: bool = True, max_chars: float = MAX_CHARS_JSD, max_words: float = MAX_WORDS_JSD) -> DataFrame:
    """docs with the counts, base_failed, both distances (null where a guard applies) and kept. with_text: whether text is among
    the columns given back."""
    base = docs.select(*[c for c in docs.columns if c not in RESULTS])
    feats = features(base)
    feats = table(feats if with_text else feats.drop("text"), "features")
    d = feats.join(F.broadcast(references(feats)), "__lang", "left")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    rest = lambda x: F.concat(F.array(F.greatest(1.0 - total(x), F.lit(0.0))), x)
    d = d.withColumn("chars_jsd", F.when(F.col("__n") >= MIN_CHARS, jsd(F.col("__p"), F.col("__rp"))))
    words = jsd(rest(F.col("__q")), rest(F.col("__rq")))
    d = d.withColumn("words_jsd", F.when((F.col("n_words") >= MIN_WORDS) & (F.col("__lang") != "other"), words))
    far = (F.coalesce("chars_jsd", F.lit(0.0)) > max_chars) | (F.coalesce("words_jsd", F.lit(0.0)) > max_words)
    d = d.withColumn("kept", ~F.col("base_failed") & ~far)
    return d.select(*[c for c in base.columns if with_text or c != "text"], *RESULTS)
