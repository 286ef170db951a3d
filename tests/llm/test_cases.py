"""Cases that once went wrong: repeated ids in mixing, scripts and forms of surrogates, columns with the names that operators use."""

import collections
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from haplospark.llm import mixing, pu_quality, quality_rules, surrogates, toxicity
from tests.llm.tools import DOCS, docs, rows, words, write


def mixture():
    """Sources: a large; b of one id with many texts; c of one row three hundred times; d small, so at its cap, with many empty texts; null."""
    text = lambda n, word: " ".join([word] * n)
    out = [(i, text(5 + i % 7, f"a{i}"), "en", "a", 1) for i in range(900)]
    out += [(7, text(3 + i % 5, f"b{i}"), "en", "b", 1) for i in range(300)]
    out += [(8, text(10, "c"), "en", "c", 1)] * 300
    out += [(2000 + i, "" if i % 4 else "d d d", "en", "d", 1) for i in range(80)] + [(3000 + i, None, "en", "d", 1) for i in range(40)]
    return out + [(None, text(4, f"n{i}"), "en", None, 1) for i in range(150)]


def test_mix_of_repeated_ids_meets_its_targets(spark):
    df = docs(spark, mixture()).repartition(3)
    found = mixing.mix(df).collect()
    assert len(found) == len(mixture()) and max(r.copies for r in found) <= 3
    taken, target = collections.Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 12 for s, t in target.items()), (taken, target)
    copies = collections.Counter()
    for r in mixing.mixed_rows(df).collect():
        copies[r.source] += len(words(r.text))
    assert copies == taken
    again = mixing.mix(df.repartition(2)).groupBy("source").agg(F.sum("taken")).collect()
    assert dict(map(tuple, again)) == dict(taken)


def test_no_row_is_taken_four_times(spark):
    found = mixing.mixed_rows(docs(spark, mixture()).where("source = 'd' OR source = 'a'").withColumn("mix_p", F.lit(1)))
    each = found.where("source = 'd'").groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert each == 3 and found.columns[-1] == "mix_p"


LEAKS = [
    "Card ٤١١١١١١١١١١١١١١١ was used", "id ١٢٣-٤٥-٦٧٨٩ here", "Dr. Øø Ðð left", "Mr Łukasz Ærø and Mr 王 小明", "see 2001:0db8:85a3:0000:0000:8a2e:0370:7334 or fe80::1ff:fe23:4567:890a",
    "ring 020 7946 0958 now", "Frau Ąžuolė Čiurlionytė", "१२३-४५-६७८९ and 123-45-6789", "Mrs Ольга Ґедзь", "token=ключ-пароль-٤٥٦",
]


@pytest.mark.parametrize("text", LEAKS)
def test_no_entity_stays(text):
    new, found = surrogates.replaced(text, b"key")
    assert found and re.search(surrogates.MAYBE.replace(r"\p{Nd}", r"\d"), text)
    for kind, a, b in found:
        assert text[a:b] not in new, (kind, text[a:b], new)
    assert [k for k, *_ in found] == [k for k, *_ in surrogates.replaced(new, b"other")[1]]  # still of its type
    assert surrogates.replaced(text, b"key")[0] == new


def test_digits_of_two_scripts_are_one_entity():
    new = surrogates.replaced("१२३-४५-६७८९ and 123-45-6789", b"key")[0].split(" and ")
    assert [int(c) for c in new[0] if c != "-"] == [int(c) for c in new[1] if c != "-"] and new[0] != new[1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcœþłşőαβдж漢字ابجदक٤5७", min_size=2, max_size=12), st.binary(min_size=1, max_size=8))
def test_forms_are_kept_and_distinct(text, key):
    made = surrogates.same_form(text, key, "t")
    assert len(made) == len(text) and [c.isdecimal() for c in made] == [c.isdecimal() for c in text]
    assert all(surrogates.PLACES[a] is None and a == b or surrogates.PLACES[a][0] == surrogates.PLACES[b][0] for a, b in zip(text, made))
    assert surrogates.same_form(made, key, "t") != surrogates.same_form(text, key, "t") or made == text


@pytest.mark.parametrize("entity", ["12:30:45", "std::vector", "a::b", "Mr", "2024-01-02 10:00:00"])
def test_plain_text_stays(entity):
    assert surrogates.replaced(f"It was {entity} then.", b"key") == (f"It was {entity} then.", [])


CLASHES = ["__text", "whole_text", "whole_text_", "new_text", "found_in", "score", "entities", "mix_p", "mix_h", "toxicity"]


def test_columns_of_any_name(spark, tmp_path):
    named = docs(spark).withColumns({c: F.lit(1) for c in CLASHES})
    keep = ["doc_id", *CLASHES]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    n = len(rows())
    assert quality_rules.repetition_counts(named, keep=tuple(keep)).count() == n
    assert pu_quality.quality_scores(named, labels, keep).count() == n
    assert toxicity.toxicity_scores(named, labels, keep, out="toxicity_score").count() == n
    assert surrogates.with_surrogates(named, keep).columns == [*[c for c in keep if c != "entities"], "text", "entities"]
    assert surrogates.with_surrogates(named, keep).count() == n
    d = write(tmp_path, labels=labels)
    assert corpus_pipeline.drop_toxic(spark, named, d).columns == named.columns
    assert set(mixing.mixed_rows(named).columns) == set(named.columns)
    assert DOCS
