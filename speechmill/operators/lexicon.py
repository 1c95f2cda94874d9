"""Lexicon, near-miss phrases and synthesis plans for many projects at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..functions.rows import let
from ..session import settled

# Words of the ranked list and of its part that gets phones.
WORD_PATTERN = "^[a-z]{2,12}$"
PROMPT_WORDS = 20_000
PHONE_WORDS = 50_000
CONTENT_WORDS = 8_000
NEAR_LIMIT, NEAR_PER_WORD, MAX_DISTANCE, LENGTH_SLACK, APPENDED_NEAREST = 16, 4, 4, 2, 10
RECENT_WINDOW = 48

# Words that carry no content.
STOP_WORDS = [
    "about", "after", "also", "because", "been", "before", "being", "between", "could", "does", "from", "have", "into",
    "more", "most", "only", "other", "over", "same", "some", "than", "that", "their", "them", "then", "there", "these",
    "they", "this", "through", "very", "were", "what", "when", "where", "which", "while", "with", "would", "your",
]

# Listed sound-alikes.
SOUND_ALIKES = {
    "beep": ["peep", "deep", "bleep", "boop"],
    "boop": ["beep", "loop", "scoop"],
    "hey": ["hi", "okay", "hey there"],
    "hello": ["yellow", "hollow", "hello there"],
    "buddy": ["body", "bunny", "muddy"],
    "computer": ["commuter", "calculator", "compute"],
    "assistant": ["assistance", "resistant", "assistant now"],
    "bump": ["pump", "dump", "bumped"],
    "wake": ["wait", "bake", "awake"],
    "word": ["world", "work", "words"],
}

# The phone symbols of the public pronunciation dictionary.
PHONES = ("AA AE AH AO AW AY B CH D DH EH ER EY F G HH IH IY JH K L M N NG OW OY P R S SH T TH UH UW V W Y Z ZH").split()


Uniform = Callable[[Column, str], Column]


def frequency_lexicon(tokens: DataFrame, word: Column, size: int = PROMPT_WORDS) -> DataFrame:
    """The ``size`` most frequent plain words with their rank (from 1).

    ``word`` is the normal form of the column ``word``. Raw words are counted
    first, so only distinct ones are normalised; counts combine map-side and
    only ``size`` rows reach the final ordering.
    """
    raw = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = raw.select(word.alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("word").rlike(WORD_PATTERN))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "word")).cast("bigint"))


def content_words(lexicon: DataFrame, size: int = CONTENT_WORDS) -> DataFrame:
    """Words of 4 to 10 letters, no stop words, no -ed / -ing; the first ``size`` by rank."""
    w = F.col("word")
    kept = lexicon.filter(F.length(w).between(4, 10) & ~w.isin(STOP_WORDS) & ~w.rlike("(ed|ing)$"))
    return kept.orderBy("rank").limit(size)


def phone_code(phones: Column) -> Column:
    """Phones as a string with one character per phone, so that the built-in
    edit distance counts phones. A symbol outside the dictionary gets one of
    11,172 characters by its hash, so that two of them rarely count as equal."""
    known = F.array(*[F.lit(p) for p in PHONES])

    def other(p: Column) -> Column:
        return F.decode(F.unhex(F.hex(F.crc32(p) % 11_172 + 0xAC00)), "UTF-16BE")

    return F.array_join(F.transform(phones, lambda p: F.when(
        F.array_contains(known, p), F.chr(F.array_position(known, p) + 64)).otherwise(other(p))), "")


def deletion_hashes(codes: np.ndarray, most: int) -> np.ndarray:
    """Hashes of all strings left after taking up to ``most`` characters out of
    equally long strings, given as rows of character codes; one column per choice."""
    rows, n = codes.shape
    out = []
    for gone in range(min(most, n) + 1):
        for kept in combinations(range(n), n - gone):
            h = np.full(rows, n - gone + 1, dtype=np.uint64)
            for j in kept:
                h = h * np.uint64(0x100000001B3) + codes[:, j]
            out.append(h ^ (h >> np.uint64(29)))
    return np.stack(out, axis=1)


def deletion_rows(df: DataFrame, keep: Sequence[str], code: str, most: int) -> DataFrame:
    """``keep`` and ``_v``, a hash, for every string left after taking up to ``most`` characters out of ``code``."""
    keep = list(keep)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("_v", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            strings = batch.column(len(keep)).to_pylist()
            lengths = np.array([len(x or "") for x in strings])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                codes = np.array([strings[i] or "" for i in at], dtype=f"<U{max(n, 1)}").view(np.uint32).reshape(len(at), -1)[:, :n].astype(np.uint64)
                hashes = deletion_hashes(codes, most)
                step = max(1, 500_000 // hashes.shape[1])
                for a in range(0, len(at), step):
                    part = hashes[a: a + step]
                    rows = pa.array(np.repeat(at[a: a + step], part.shape[1]))
                    columns = [*[batch.column(k).take(rows) for k in range(len(keep))], pa.array(part.ravel().view(np.int64))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(*keep, code).mapInArrow(run, schema)


def pairs_within(targets: DataFrame, lexicon: DataFrame, far: int) -> DataFrame:
    """Pairs of a target (word, _tc) and a lexicon word (near, near_rank, _nc) at an edit distance of 1 to ``far``.

    Codes that near become the same string when each loses at most ``far``
    characters, so hashes of these strings are the join key. The distance is
    computed only for pairs that meet, once each. Ranks name lexicon words.
    """
    left, right = deletion_rows(targets, ["word"], "_tc", far), deletion_rows(lexicon, ["near_rank"], "_nc", far)
    met = left.join(right, "_v").select("word", "near_rank").distinct().join(lexicon, "near_rank").join(targets, "word")
    close = met.filter(F.abs(F.length("_tc") - F.length("_nc")) <= LENGTH_SLACK)
    return close.withColumn("distance", F.levenshtein("_tc", "_nc", far)).filter(F.col("distance").between(1, far)).select("word", "distance", "near_rank", "near")


def near_words(targets: DataFrame, lexicon: DataFrame, limit: int = NEAR_LIMIT, code: str = "code", most: int | None = None) -> DataFrame:
    """Nearest lexicon words of each target (word, code, exclude): distance 1..4, ranked.

    The search is by deletion neighbourhoods (:func:`pairs_within`), first up to
    distance 2, where most words have enough neighbours that no target excludes;
    only words that have too few go on to 3, and then to 4. At most ``limit``
    and the words that a target excludes (``most``, else read from the targets)
    are kept of a word's nearest; the targets then drop theirs. ``lexicon`` is
    read in each round: hand in a written table. Words are few bytes but much
    work, so they are dealt over the session's shuffle partitions.
    """
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lex = lexicon.filter(F.length("word") > 2).select(
        F.col("word").alias("near"), F.col("rank").alias("near_rank"), F.col(code).alias("_nc")).repartition(tasks, "near")
    order = ["distance", "near_rank", "near"]
    kept = limit + (int(targets.agg(F.max(F.size("exclude"))).first()[0] or 0) if most is None else most)
    wanted = settled(targets.select("word", "exclude", F.col(code).alias("_tc")).distinct(), "near-targets")
    left, found = wanted.select("word", "_tc").distinct(), []
    for far in range(2, MAX_DISTANCE + 1):
        ranked = pairs_within(left.repartition(tasks, "word"), lex, far).withColumn("_r", F.row_number().over(W.partitionBy("word").orderBy(*order)))
        near = settled(ranked.filter(F.col("_r") <= kept).select("word", *order), "near-words")
        met = near.groupBy("word").agg(F.collect_list("near").alias("_n"))
        free = F.size(F.array_except(F.coalesce("_n", F.array().cast("array<string>")), "exclude"))
        full = left.select("word").join(wanted, "word").join(met, "word", "left").groupBy("word").agg(F.min(free).alias("_free")).filter(F.col("_free") >= limit)
        left = settled(left.join(full, "word", "left_anti"), "near-targets")
        done = far == MAX_DISTANCE or left.isEmpty()
        found.append(near if done else near.join(left, "word", "left_anti"))
        if done:
            break
    nearest = found[0]
    for rows in found[1:]:
        nearest = nearest.unionByName(rows)
    allowed = wanted.select("word", "exclude").join(nearest, "word").filter(~F.array_contains("exclude", F.col("near")))
    return allowed.withColumn("position", F.row_number().over(W.partitionBy("word", "exclude").orderBy(*order))).filter(
        F.col("position") <= limit).select("word", "exclude", "near", "near_rank", "distance", "position")


def _replace_at(words: Column, index: Column, value: Column) -> Column:
    return F.transform(words, lambda w, i: F.when(i == index, value).otherwise(w))


def near_miss_phrases(phrases: DataFrame, near: DataFrame, uniform: Uniform, fillers: DataFrame | None = None, per_word: int = NEAR_PER_WORD,
                      limit: int = 10) -> DataFrame:
    """Phrases with one word replaced by a near word: phrase_id and ``variant``.

    ``phrases(phrase_id, words)``; ``near`` from :func:`near_words`, of which
    ``per_word`` are drawn for each word. A one-word phrase also gets some of its
    ten nearest words with a drawn word of ``fillers`` (word, rank from 1 without
    gaps) appended, or "now" where there is no other filler than the word itself.
    """
    each = phrases.select("phrase_id", "words", F.array_distinct("words").alias("exclude"), F.posexplode("words").alias("at", "word"))
    met = each.join(near, ["word", "exclude"])

    def drawn(rows: DataFrame, purpose: str) -> DataFrame:
        chance = uniform(F.col("phrase_id") * 1_000_003 + F.col("at") * 100 + F.col("position"), purpose)
        nth = F.row_number().over(W.partitionBy("phrase_id", "at").orderBy(chance, "position"))
        return rows.withColumn("position", nth).filter(F.col("position") <= per_word)

    picked = drawn(met, "near")
    replaced = picked.select("phrase_id", "words", "at", "position",
                             F.array_join(_replace_at(F.col("words"), F.col("at"), F.col("near")), " ").alias("variant"), F.lit(0).alias("part"))
    single = drawn(met.filter((F.size("words") == 1) & (F.col("position") <= APPENDED_NEAREST)), "appended")
    filler = F.lit("now")
    if fillers is not None:
        pool = fillers.select(F.col("word").alias("filler"), F.col("rank").alias("_k"))
        own = pool.select(F.col("filler").alias("word"), F.col("_k").alias("_own"))
        # one draw among the pool without the phrase's own word: ranks from its own on move up by one
        n = pool.agg(F.count(F.lit(1))).scalar() - F.when(F.col("_own").isNotNull(), 1).otherwise(0)
        k = (F.floor(uniform(F.col("phrase_id") * 1_000_003 + F.col("position"), "filler") * n) + 1).cast("bigint")
        single = single.join(own, "word", "left").withColumn("_k", k).withColumn("_k", F.col("_k") + F.when(F.col("_own") <= F.col("_k"), 1).otherwise(0))
        single = single.join(pool, "_k", "left")
        filler = F.coalesce("filler", F.lit("now"))
    appended = single.select("phrase_id", "words", "at", "position", F.concat_ws(" ", "near", filler).alias("variant"), F.lit(1).alias("part"))
    rows = replaced.unionByName(appended).filter((F.col("variant") != "") & (F.col("variant") != F.array_join("words", " ")))
    first = rows.groupBy("phrase_id", "variant").agg(F.min(F.struct("part", "at", "position")).alias("_o"))
    w = W.partitionBy("phrase_id").orderBy("_o", "variant")
    return first.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("phrase_id", "variant", "position")


def sound_alikes(word: Column) -> Column:
    """Listed sound-alikes of a word, else the suffix rules."""
    listed = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in SOUND_ALIKES.items()))
    now, no, please = F.concat(word, F.lit(" now")), F.concat(F.lit("not "), word), F.concat(word, F.lit(" please"))
    n = F.length(word)

    def stem(k: int) -> Column:
        return F.substr(word, F.lit(1), n - k)

    by_rule = (
        F.when(F.endswith(word, F.lit("ing")) & (n > 5), F.array(stem(3), now))
        .when(F.endswith(word, F.lit("er")) & (n > 4), F.array(stem(2), now))
        .when(n <= 3, F.array(now, no)).otherwise(F.array(now, no, please))
    )
    return F.coalesce(F.try_element_at(listed, word), by_rule)


def candidates(words: Column, phonetic: Column) -> Column:
    """Hard-negative candidates of a phrase (array of its words), in order, distinct.

    ``phonetic`` are the near-miss phrases found before. The phrase itself and
    everything that contains it as a word run drops out.
    """
    return let(words, lambda w: _candidates(w, phonetic))


def _candidates(words: Column, phonetic: Column) -> Column:
    n, first, last = F.size(words), F.get(words, F.lit(0)), F.element_at(words, -1)
    alike = sound_alikes(first)
    lead = F.get(alike, F.lit(0))
    single = F.concat(alike, F.array(F.concat(first, F.lit(" now"))))
    all_first = F.array_join(F.transform(words, lambda w: F.get(sound_alikes(w), F.lit(0))), " ")
    one_each = F.flatten(F.transform(words, lambda w, i: F.transform(
        F.slice(sound_alikes(w), 1, 2), lambda r: F.array_join(_replace_at(words, i, r), " "))))
    several = F.concat(F.array(all_first), one_each, F.array(first, last))
    doubled = F.when((n == 2) & (first == last), F.array(
        F.concat_ws(" ", first, lead), F.concat_ws(" ", lead, first), F.concat_ws(" ", first, first, first))).otherwise(F.array().cast("array<string>"))
    rest = F.coalesce(F.nullif(F.array_join(F.slice(words, 2, F.greatest(n - 1, F.lit(0))), " "), F.lit("")), first)
    head = F.coalesce(F.nullif(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), " "), F.lit("")), first)
    built = F.concat(F.when(n == 1, single).otherwise(several), doubled, F.array(rest, head))
    every = F.concat(F.coalesce(phonetic, F.array().cast("array<string>")), F.when(n > 0, built).otherwise(F.array().cast("array<string>")))
    flat = F.transform(every, text.squeeze)
    kept = let(F.array_join(words, " "), lambda whole: F.filter(
        flat, lambda v: (v != "") & (v != whole) & ~text.contains_run(F.split(v, " "), words)))
    return F.array_distinct(kept)


def weighted_words(projects: DataFrame, lexicon: DataFrame, count: int, uniform: Uniform) -> DataFrame:
    """Frequency-weighted stream of ``count`` words per project: rank = n * u^2.

    ``projects(slug, key, words)``; ``lexicon`` is the ranked list, of bounded
    size; ``uniform(key, purpose)`` draws in [0, 1). Words of the phrase and of
    the last 48 accepted ones are drawn again, up to a fixed number of draws.
    The stream of a project is one fold over its draws, of bounded length.
    """
    ranked = lexicon.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w")).scalar()
    n = F.size("_lex")
    window = F.least(F.lit(RECENT_WINDOW), (n / 2).cast("int"))
    none = F.array().cast("array<string>")

    def accept(out: Column, i: Column) -> Column:
        u = uniform(F.col("key") * 1_000_003 + i, "word")
        return let(F.get("_lex", F.least(F.floor(n * u * u), n - 1).cast("int")), lambda word: F.when(
            (F.length(word) >= 2) & ~F.array_contains("words", word)
            & ~F.array_contains(F.slice(out, F.greatest(F.size(out) - window, F.lit(0)) + 1, window), word), F.array_append(out, word)).otherwise(out))

    def drawn(out: Column, first: int, last: int) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), out, lambda out, i: F.when(F.size(out) >= count, out).otherwise(accept(out, i)))

    # nearly all streams are full after a few draws for each word; only the others go on
    stream = let(drawn(none, 0, count * 4 - 1), lambda out: F.when(F.size(out) >= count, out).otherwise(drawn(out, count * 4, count * 40 + 63)))
    stream = F.when(n > 0, stream).otherwise(none)
    filled = projects.withColumn("_lex", ranked).select("slug", stream.alias("_out"))
    return filled.select("slug", F.posexplode("_out").alias("i", "word"))


def synthesis_plan(projects: DataFrame, count: int, voices: Sequence[str], carriers: Sequence[str], uniform: Uniform,
                   speed: tuple[float, float] = (0.9, 1.1), lead_fraction: float = 0.5, seconds_per_word: float = 0.4,
                   margin: float = 0.3, seed_base: int = 0) -> DataFrame:
    """One row per clip to synthesise: voice round robin, speed, lead-in, text, time budget."""
    rows = projects.select("slug", "key", "phrase", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    at = F.col("key") * 1_000_003 + F.col("i")
    voice = F.element_at(F.array(*[F.lit(v) for v in voices]), (F.col("i") % len(voices) + 1).cast("int"))
    rows = rows.withColumn("voice", voice).withColumn("speed", F.lit(speed[0]) + uniform(at, "speed") * (speed[1] - speed[0]))
    carrier = F.element_at(F.array(*[F.lit(c) for c in carriers]), (F.floor(uniform(at, "carrier") * len(carriers)) + 1).cast("int"))
    rows = rows.withColumn("lead", F.when(uniform(at, "lead") < lead_fraction, carrier).otherwise(""))
    rows = rows.withColumn("text", F.when(F.col("lead") == "", F.col("phrase")).otherwise(F.concat_ws(" ", "lead", "phrase")))
    words = F.greatest(F.size(text.tokens(F.col("text"))), F.lit(1))
    return rows.withColumn("seconds", words * seconds_per_word / F.col("speed") + margin).withColumn("seed", F.lit(seed_base) + F.col("i")).drop("key")
