"""The name model is fitted on every text and the whole of it, and equals the one learned in memory."""

from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.fitting import _counter, fit
from tessera.llm.names import learn
from tessera.llm.pii import find_pii, fitted

DATA = "/root/testdata/sf0.01"
SCHEMA = "kind string, rec_key string, text string"
TAUGHT = ["We saw Ana Velmora.", "Velmora, Ana came.", "Then Berta Velmora left.", "Project Zuloaga and Project Ibarra"]
NAMES = [("Ana", "given"), ("Berta", "given"), ("Zuloaga", "family"), ("Ibarra", "family")]
ODD = [
    *TAUGHT, "", "...", "ana velmora", "with berta velmora of ana", "Ana K. Velmora-Zuloaga met K. Velmora, J. R. Ibarra and P. O'Neil", "ANA VELMORA", "Ana Crèvebois", "Crèvebois, Berta", "ANA CRÈVEBOIS", "Berta Crèvebois-Ibarra",
    "MeadowAnchor Ibarra met McAdam Ibarra", "Meadow Anchor", "the meadow, the anchor", "Tamsel Zuloaga", "Zuloaga, Tamsel", "Ibarra, Tamsel", "Ana Tamsel", "Tamsel, Ana", "Berta Tamsel", "Tamsel Tamsel", "Sr. Ana Ibarra y Où Est", "the Ana Server", "ſtraße ÄÖ Übel",
]


def same(got, want):
    assert (got.given, got.family, got.spelled, got.common, got.pieces) == (want.given, want.family, want.spelled, want.common, want.pieces)
    assert got.context == pytest.approx(want.context)


def names_of(names):
    return {n.lower() for n, kind in names if kind == "given"}, {n.lower() for n, kind in names if kind == "family"}


def test_equals_what_is_learned_in_memory(spark):
    texts = [*pd.read_parquet(f"{DATA}/leaves.parquet").content.dropna(), *ODD * 3]
    for given, family in (names_of(NAMES), names_of(map(tuple, pd.read_parquet(f"{DATA}/known_names.parquet").values)), ({"ana"}, set()), ({"", "the"}, {"velmora-zuloaga"})):
        same(fit(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3), given, family), learn(texts, given, family))
    given, family = names_of(NAMES)
    model = learn(ODD * 3, given, family)
    assert "velmora" in model.family and model.spelled == {"crèvebois"} and "tamsel" in model.given | model.family
    same(fit(spark.createDataFrame([], "text string"), given, family), learn([], given, family))


def test_long_texts_teach(spark):
    long = "past the bright beacon, " * 300
    texts = spark.createDataFrame([("turn", "1", long), ("turn", "2", "We saw Bright Beacon there.")], SCHEMA)
    assert find_pii(texts, spark.createDataFrame(NAMES, "name string, kind string")).collect() == []


def test_every_text_teaches(spark):
    """Among 60,000 texts a name is learned from the three that have it."""
    filler = spark.range(60_000).select(F.lit("leaf").alias("kind"), F.col("id").cast("string").alias("rec_key"), F.lit("nothing here").alias("text"))
    texts = filler.unionByName(spark.createDataFrame([("turn", str(i), t) for i, t in enumerate(TAUGHT)], SCHEMA))
    assert fitted(texts, NAMES).family == {"velmora"}


def test_counts_handed_on_early_add_up():
    given, family = names_of(NAMES)
    batches = [pa.RecordBatch.from_pydict({"text": ODD[i : i + 5]}) for i in range(0, len(ODD), 5)]

    def added(hold):
        total, made = Counter(), list(_counter(given, family, hold)(iter(batches)))
        for batch in made:
            for *key, n in zip(*batch.to_pydict().values()):
                if key[0] != "spelled":
                    total[tuple(key)] += n
        return len(made), +total, {key[:3] for batch in made for key in zip(*batch.to_pydict().values()) if key[0] == "spelled"}

    few, many = added(1_000_000), added(3)
    assert few[0] == 1 and many[0] > 5 and few[1:] == many[1:]
