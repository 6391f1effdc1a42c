import re

import pytest
from pyspark.sql import functions as F

from verbaloom.operators import search

TOKENS = ["The", "other", "theTHE", "É", "éa", "a", "", "ab", "Straße", "STRASSE", "😀x😀y", "x y", "tth", "the"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"l{i % 2}", TOKENS[i % len(TOKENS)]) for i in range(60)]
    stream = spark.createDataFrame(rows, "doc_id long, lang string, token string")
    return stream, search.build(stream)


@pytest.mark.parametrize("sought", ["the", " The ", "a", "É", "th", "straße", "😀y", "😀x😀", "nothing", "", "rasse", "y"])
def test_equals_the_scan(index, sought):
    stream, found = index
    held = F.contains(F.lower("token"), F.lower(F.trim(F.lit(sought))))
    want = stream.filter(held)
    assert sorted(r[0] for r in found.tokens(sought).collect()) == sorted(r[0] for r in want.select("token").distinct().collect())
    assert sorted(map(tuple, found.places(sought).collect())) == sorted(map(tuple, want.collect()))
    first = lambda df: [tuple(r) for r in df.orderBy("doc_id").limit(7).collect()]
    assert first(found.places(sought, F.col("lang") == "l1")) == first(want.filter("lang = 'l1'"))


def test_reads_its_grams_only(index):
    """The scan of the n-grams gets them as a filter."""
    plan = index[1].tokens("other")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(gram, \[", plan), plan
