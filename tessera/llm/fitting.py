"""The name model of `names.learn`, fitted on a whole table of texts.

One pass over the texts counts, in every task, words and pairs of words with what stands beside them; the counts are
written, added up and judged by joins. The driver gets what the model consists of, and nothing by text or pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import CAMEL, LOWER_PAIR, NO_NAME, PIECE, SCOTTISH, TOKEN, WHOLE, NameModel, bare, beside, capital, pairs
from tessera.session import written

#: Counts that a task holds before it hands them on; equal ones are added up later.
_HELD = 200_000
_COUNTED = "kind string, a string, b string, shaped boolean, left string, right string, n bigint"
#: The forms of pairs, with a bit for each; a given name or initial alone before a family name is no form of its own.
_FORMS = {"plain": 1, "middle": 2, "capitals": 4, "comma": 8, "lower": 16}


class _Remembered(dict):
    """A function of a word, kept for words it was asked for."""

    def __init__(self, f: Callable[[str], bool]) -> None:
        self.f = f

    def __missing__(self, word: str) -> bool:
        self[word] = value = self.f(word)
        return value


def _holds_any(words: Iterable[str]) -> Callable[[str], bool]:
    """Whether one of the words stands anywhere in a text."""
    words = set(words)
    if "" in words:
        return lambda text: True
    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, True)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


def _counter(given: set[str], family: set[str], hold: int = _HELD):
    """Counts words, accented spellings and pairs in batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = given | family
        holds_name = _holds_any(names)
        known = _Remembered(lambda w: bare(w) in names)
        words, couples, accented = Counter(), Counter(), set()
        may_be = lambda w, listed: w in listed or len(w) > 2 and w not in NO_NAME

        def rows() -> pa.RecordBatch:
            total = Counter()
            for w, n in words.items():
                low = bare(w)
                total["small" if w[0].islower() else "large", low, None, None, None, None] += n
                if CAMEL.fullmatch(w) and not SCOTTISH.match(w):
                    for p in PIECE.findall(w):
                        total["piece", bare(p), None, None, None, None] += n
            for w in accented:
                for part in {w, *w.split("-")}:
                    if bare(part) != part.lower():
                        total["spelled", bare(part), part.lower(), None, None, None] += 1
            total.update(couples)
            columns = list(zip(*((*key, n) for key, n in total.items()))) or [()] * 7
            kinds = [pa.bool_() if i == 3 else pa.int64() if i == 6 else pa.string() for i in range(7)]
            for held in (words, couples, accented, known):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "a", "b", "shaped", "left", "right", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                found = WHOLE.findall(text)
                words.update(found)
                if any(map(known.__getitem__, found)):  # small words beside names of the lexicon are no common ones
                    lows = [bare(w) for w in found]
                    for i, w in enumerate(found):
                        if w[0].islower() and (i and lows[i - 1] in given or i + 1 < len(lows) and lows[i + 1] in family):
                            words[w] -= 1
                if not text.isascii():
                    accented.update(w for w in TOKEN.findall(text) if not w.isascii())
                for m in pairs(text):
                    if m[4]:
                        a, b, form = m[1], m[4], "middle" if m[2] else "capitals" if m[4].isupper() or m[1].isupper() else "plain"
                    elif m[7]:
                        a, b, form = m[8], m[7], "comma"
                    else:
                        a, b, form = m[6], m[6], "initial"
                    shaped = all(capital(w) and w.lower() not in NO_NAME for w in (a, b))
                    low_a, low_b = bare(a), bare(b)
                    if shaped or (form == "initial" or may_be(low_a, given)) and any(may_be(p, family) for p in low_b.split("-")):
                        couples[form, low_a, low_b, shaped, *beside(text, *m.span())] += 1
                if holds_name(text):
                    for a, b in LOWER_PAIR.findall(text):
                        if a not in NO_NAME and b not in NO_NAME:
                            couples["lower", bare(a), bare(b), True, None, None] += 1
                if len(words) + len(couples) + len(accented) > hold:
                    yield rows()
        yield rows()

    return run


def fit(texts: DataFrame, given: set[str], family: set[str], rounds: int = 3) -> NameModel:
    """What `names.learn` teaches of the column `text`, of every text and the whole of it; null texts count for nothing."""
    spark = texts.sparkSession
    listed = lambda words: F.broadcast(spark.createDataFrame(pa.table({"word": pa.array(sorted(words), pa.string())})))
    counted = written(texts.where("text is not null").select("text").mapInArrow(_counter(given, family), _COUNTED), "names")
    number = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    words = written(counted.where(F.col("kind").isin("small", "large", "piece")).groupBy(F.col("a").alias("word")).agg(number("small"), number("large"), number("piece")), "names-words")
    bit = F.element_at(F.create_map(*[F.lit(x) for item in _FORMS.items() for x in item]), F.col("kind"))
    couples = written(counted.where(F.col("kind").isin(*_FORMS) & F.col("shaped")).groupBy(F.col("a").alias("g"), F.col("b").alias("f")).agg(F.bit_or(bit).alias("forms"), F.sum("n").alias("n")), "names-pairs")
    parts = couples.withColumn("p", F.explode(F.array_distinct(F.split("f", "-"))))

    more_given, more_family = set(), set()
    fit_words = words.where("large >= 2 and small <= large and not piece > 0")
    for _ in range(rounds):
        known_given, known_family = listed(given | more_given), listed(family | more_family)
        behind = parts.join(known_given, F.col("g") == F.col("word"), "left_semi").join(known_family, F.col("p") == F.col("word"), "left_anti")
        before = parts.join(known_family, F.col("p") == F.col("word"), "left_semi").join(known_given, F.col("g") == F.col("word"), "left_anti")
        seen = behind.select(F.lit("f").alias("kind"), F.col("p").alias("word"), F.col("g").alias("partner"), "forms").unionByName(before.select(F.lit("g").alias("kind"), F.col("g").alias("word"), F.col("f").alias("partner"), "forms"))
        proven = seen.groupBy("kind", "word").agg(F.count_distinct("partner").alias("partners"), F.bit_count(F.bit_or("forms")).alias("forms")).where("partners >= 2 and forms >= 2 and length(word) >= 3")
        found = [(r.kind, r.word) for r in proven.join(fit_words, "word", "left_semi").select("kind", "word").collect() if r.word not in NO_NAME]
        more_given |= {w for kind, w in found if kind == "g"}
        more_family |= {w for kind, w in found if kind == "f"}
        if not found:
            break
    if both := more_given & more_family:  # the place it is more often in decides
        held = listed(both)
        as_given = couples.join(held, F.col("g") == F.col("word")).select("word", F.col("n").alias("more"))
        as_family = parts.join(held, F.col("p") == F.col("word")).select("word", (-F.col("n")).alias("more"))
        for word, more in as_given.unionByName(as_family).groupBy("word").agg(F.sum("more")).collect():
            (more_family if more > 0 else more_given).discard(word)

    names, learned = given | family | more_given | more_family, more_given | more_family
    spelled = counted.where("kind = 'spelled'").join(listed(learned), F.col("a") == F.col("word"), "left_semi").select("b").distinct()
    kinds = words.select("word", (F.expr("small > large / 4 and length(word) > 1")).alias("common"), (F.col("piece") > 0).alias("piece")).where("common or piece").toArrow().to_pylist()
    return NameModel(
        frozenset(more_given),
        frozenset(more_family),
        frozenset(r.b for r in spelled.collect()) if learned else frozenset(),
        frozenset(r["word"] for r in kinds if r["common"] and r["word"] not in names),
        frozenset(r["word"] for r in kinds if r["piece"]) - given - family,
        _context(counted.where(F.col("kind").isin("plain", "middle", "capitals", "comma", "initial")), listed(given | more_given), listed(family | more_family)),
    )


def _context(couples: DataFrame, known_given: DataFrame, known_family: DataFrame) -> dict[str, float]:
    """What stands beside pairs of two known parts, against what stands beside other pairs of the shape of a name."""
    ends = couples.select("b").distinct().withColumn("p", F.explode(F.split("b", "-"))).join(known_family, F.col("p") == F.col("word"), "left_semi").select("b").distinct().withColumn("family", F.lit(True))
    begins = known_given.select(F.col("word").alias("a"), F.lit(True).alias("given"))
    judged = couples.join(F.broadcast(begins), "a", "left").join(ends, "b", "left")
    judged = judged.withColumn("name", F.coalesce("family", F.lit(False)) & (F.coalesce("given", F.lit(False)) | (F.col("kind") == "initial"))).where("name or shaped")
    features = judged.select("name", "n", F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"), F.lit("n"))).alias("feature"))
    side = lambda name: F.sum(F.when(F.col("name") == name, F.col("n")).otherwise(0))
    sides = {r.feature: (r.good, r.bad) for r in features.groupBy("feature").agg(side(True).alias("good"), side(False).alias("bad")).where("good + bad >= 5").collect()}
    good, bad = sides.pop("n", (0, 0))
    if not good or not bad:
        return {}
    return {feature: math.log((g + 0.5) / (good + 1)) - math.log((b + 0.5) / (bad + 1)) for feature, (g, b) in sides.items()}
