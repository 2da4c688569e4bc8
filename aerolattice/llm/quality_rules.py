"""Quality rules in DataFrame functions alone: base counts, and how far a text is from its language.

A text's histogram of character classes and its histogram of common words are compared to those of its
language by the Jensen-Shannon distance (base 2, 0 to 1). The references are sums over all documents of
the language that pass the base rules. Texts that are too short for a histogram are not judged by it, and a
language of too few words in all is no reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on are this from an or "
    "der die und das von zu mit den ist im auf nicht ein eine "
    "le la les de des et en un une du que est pour dans par sur "
    "el los las y del se con su al lo es para"
).split()
#: White space between words, and symbols that the base rules count.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
#: Character classes, each counted in what those before it leave; the rest is a class of its own.
CLASSES = (r"\p{Ll}+", SPACE, r"\p{Lu}+", r"\p{N}+", r"[.,;:'\"!?()\-]+", SYMBOLS)

#: Characters and words below which a histogram is not judged, and the largest distances that pass.
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.315
#: Words below which a language is no reference of its own, and references up to which they are broadcast.
MIN_REFERENCE_WORDS = 2000
MAX_BROADCAST = 1000
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _codes() -> Column:
    """A map from each common word to a letter of its own."""
    pairs = [F.lit(x) for k, w in enumerate(COMMON_WORDS) for x in (w, chr(0x100 + k))]
    return F.create_map(*pairs)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``classes`` and ``common``: the two histograms as arrays of counts.

    Each step is a projection of its own, so that what several others need is computed once.
    """
    longest = max(map(len, COMMON_WORDS))
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")

    windows = F.transform(
        F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]),
    )
    df = df.withColumn("_windows", windows)
    found_twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_ranked", F.when(found_twice, ranked)).drop("_windows")
    places = F.filter(
        F.transform("_ranked", lambda x, k: F.when((x.h == F.get("_ranked", k - 1).h) | (x.h == F.get("_ranked", k + 1).h), x.i)),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("_places", F.array_sort(places)).drop("_ranked")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i - a.last)).alias("n"), i.alias("last")),
        lambda a: a.n,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")

    short = F.filter("_words", lambda w: F.length(w) <= longest)
    df = df.withColumn("_codes", _codes_of(short)).drop("_words")
    counts = [F.length("_codes") - F.length(F.replace("_codes", F.lit(chr(0x100 + k)))) for k in range(len(COMMON_WORDS))]
    df = df.withColumn("common", F.array(*counts, (F.col("n_words") - F.length("_codes")).cast("int"))).drop("_codes")

    before = "_text"
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_rest{k}", F.regexp_replace(before, pattern, ""))
        df = df.withColumn(f"_n{k}", F.length(before) - F.length(f"_rest{k}")).drop(before)
        before = f"_rest{k}"
    df = df.withColumn("n_symbols", F.col(f"_n{len(CLASSES) - 1}").cast("long"))
    names = [f"_n{k}" for k in range(len(CLASSES))]
    return df.withColumn("classes", F.array(*names, F.length(before))).drop(before, *names)


def _codes_of(words: Column) -> Column:
    table = _codes()
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, F.lower(w)), F.lit(""))), "")


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.transform(counts, lambda n: n / F.greatest(total, F.lit(1)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), F.lit(0.0)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance and kept for each row of ``docs``.

    Null and empty texts have no words and fail the base rules. A text is kept if it passes these and
    both distances, each judged only from MIN_CHARS characters or MIN_WORDS words on. A language whose
    texts that pass the base rules have fewer than MIN_REFERENCE_WORDS words in all is compared to the sum over
    all languages; a null one is a language of its own. Equal rows have equal results; other columns,
    whatever their names, are left out. An empty table gives an empty one.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = written(features(base).drop("text").withColumn("base_failed", failed), "rules")

    sizes = {"classes": len(CLASSES) + 1, "common": len(COMMON_WORDS) + 1}
    sums = [F.sum(F.when(~F.col("base_failed"), F.col(c)[k])).alias(f"{c}{k}") for c, n in sizes.items() for k in range(n)]
    words = F.sum(F.when(~F.col("base_failed"), F.col("n_words"))).alias("words")
    of_lang = rows.groupBy("lang").agg(words, *sums)
    of_all = of_lang.agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for c, n in sizes.items() for k in range(n)])
    arrays = [F.array(*[F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k in range(n)]).alias(f"ref_{c}") for c, n in sizes.items()]
    total = of_all.first()
    everything = {c: F.array(*[F.lit(total[f"{c}{k}"] or 0) for k in range(n)]) for c, n in sizes.items()}
    large = written(of_lang.where(F.col("words") >= MIN_REFERENCE_WORDS).select("lang", *arrays), "references")
    judged = rows.join(F.broadcast(large) if large.count() <= MAX_BROADCAST else large, "lang", "left")
    judged = reduce(lambda d, c: d.withColumn(f"ref_{c}", F.coalesce(f"ref_{c}", everything[c])), sizes, judged)
    judged = judged.withColumn("class_distance", jensen_shannon(_shares("classes"), _shares("ref_classes")))
    judged = judged.withColumn("word_distance", jensen_shannon(_shares("common"), _shares("ref_common")))
    chars = F.aggregate("classes", F.lit(0), lambda a, n: a + n)
    far = ((chars >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return judged.select("doc_id", *BASE, "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
