"""Queries against their SQL over hand-made documents with words that are odd: letters without a capital of their own, names that are keywords."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from test_queries import plain

from lorespark import registry
from lorespark.functions import text
from lorespark.operators import islands

TEXTS = ["er ßä liegt hier", "ßsch und ßer dort", "ßge é ǆ der", "\ufb01n ᾳbc ŉx", "sndnd eror or inally", "constwh eraha rom n", "abc atch or ut", "abc ut n xyz", "abc ove inal xyz"]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    # every text under every language of the island queries
    rows = [(5 * i + k, t, "de", f"src{k}", len(t)) for i, t in enumerate(TEXTS) for k in range(5)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["f2_identifier_words", "g1_code_entities", "g1_island_facts", "w9_overload_ordinals"])
def test_same_rows_over_odd_words(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert plain(got) == plain(con.execute(registry.oracle_sql()[name]).df())


def test_capitals_one_letter_for_one(spark):
    words = ["ßä", "\ufb01n", "ᾳbc", "étude", "x", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.capitalized("w")).collect()
    assert [r[0] for r in got] == ["ẞä", "\ufb01n", "ᾼbc", "Étude", "X", ""]


def test_members_and_raw_identifiers_may_be_keywords():
    called = lambda body, language: [f[2] for f in islands.facts(body, language) if f[0] == "call"]
    assert called("class A {\n  go() { this.for(1); x?.catch(2); if (y) { z() } }\n}\n", "typescript") == ["this.for", "x.catch", "z"]
    assert [f[:3] for f in islands.facts("fn r#match() { r#for!(1); for x in y() {} }\n", "rust")] == [("function", "match", "match"), ("call", "for", "for"), ("call", "y", "y")]
