"""Quality rules, language model, near-duplicates, token files: against plain Python."""

import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haplospark.llm import chunks, huffman, kernels, language_model, near_dedup, quality_rules, token_files
from tests.llm.tools import DOCS, docs, lower_az, rows, words, write


def rule_counts(text):
    text = text or ""
    w = words(text)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = collections.Counter(line for line in text.split("\n") if words(line))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(n - 1 for n in lines.values()), len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢\n\t*|", max_size=60), max_size=8))
def test_rule_counts_match_plain_python(texts):
    found = quality_rules.repetition(pa.array([*texts, None], pa.string()))
    for i, text in enumerate([*texts, None]):
        assert tuple(int(found[c][i]) for c in quality_rules.COUNTS[:5]) == rule_counts(text)


def test_quality_rules_whole_table(spark, tmp_path):
    d = write(tmp_path, documents=docs(spark))
    found = quality_rules.op1_quality_rules(spark, d).collect()
    assert len(found) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in found:
        expect = rule_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expect
        assert r.base_failed == (expect[0] < 20 or 100 * expect[4] > 30 * expect[0])
        assert not (r.base_failed and r.kept)
    clash = docs(spark).selectExpr("*", "1 as n_words")
    assert quality_rules.repetition_counts(clash).count() == len(rows())
    assert quality_rules.repetition_counts(docs(spark, [])).count() == 0


def test_language_model(spark, tmp_path):
    d = write(tmp_path, documents=docs(spark))
    found = language_model.op3_language_model(spark, d).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(i, words(lower_az(t)) + ["\0end"]) for i, t, *_ in rows()]
    c = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    expect = sorted((i is None, i, held(i), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens)
    got = sorted((r.doc_id is None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found)
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in expect]
    assert all(r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    empty = docs(spark, []).selectExpr("doc_id", "text", "0 as role")
    assert language_model.language_scores(empty).count() == 0


def test_pair_probabilities_are_a_distribution():
    """Mixture weights of every bucket sum to 1 and never fall below 0."""
    rng = np.random.default_rng(1)
    h = np.c_[rng.integers(0, 16, 300), rng.integers(0, 121, 300), rng.integers(1, 121, 300), rng.integers(1, 50, 300)]
    w = language_model.learn_weights(h, 1e-3)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers_come_back(numbers):
    x = np.array(numbers, np.uint64)
    assert (chunks.unpack(chunks.pack(x)) == x).all()


def brute_classes(data, shingle=5, similar=0.8):
    sets = []
    for i, t, *_ in data:
        w = words(lower_az(t))
        sets.append((i, {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a][1] & sets[b][1])
        if both >= similar * (len(sets[a][1]) + len(sets[b][1]) - both):
            parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[root(k)].append(i)
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_near_duplicates(spark, tmp_path):
    data = rows()
    d = write(tmp_path, documents=docs(spark, data))
    found = near_dedup.NearDuplicates(docs(spark, data)).classes().collect()
    groups = collections.defaultdict(list)
    for r in found:
        groups[r["class"]].append(str(r.doc_id))
    assert sorted(sorted(g) for g in groups.values()) == brute_classes(data)
    assert near_dedup.op5_near_dedup(spark, d).count() == len(data)
    left = near_dedup.without_near_duplicates(docs(spark, data))
    assert left.columns == docs(spark).columns and left.count() == len(groups)
    assert near_dedup.NearDuplicates(docs(spark, [])).classes().count() == 0


def test_many_near_copies_make_one_class(spark):
    """A bucket far larger than a round's leaders, with stragglers."""
    base = [f"v{i}" for i in range(120)]
    data = [(i, " ".join(base[: 40 + i % 60] + [f"z{i}"] + base[40 + i % 60 :]), "en", "s", 1) for i in range(300)] + [(999, "quite another text of seven words", "en", "s", 1)]
    found = {r.doc_id: r["class"] for r in near_dedup.NearDuplicates(docs(spark, data)).classes().collect()}
    assert len({found[i] for i in range(300)}) == 1 and found[999] != found[0]


def test_classes_have_names_of_their_own(spark):
    """Ids that repeat or are null do not join unrelated texts."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    data = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (None, three, "en", "s", 1), (None, "quite another text", "en", "s", 1), (7, three.upper(), "en", "s", 1)]
    found = near_dedup.NearDuplicates(docs(spark, data)).classes().collect()
    names = collections.defaultdict(set)
    for r in found:
        names[r["class"]].add((r.class_id, r.class_mark))
    assert len(found) == 5 and len(names) == 4 and all(len(x) == 1 for x in names.values())
    assert len({x for (x,) in map(tuple, names.values())}) == 4
    assert {r.class_id for r in found if r.doc_id == 7} == {7} and sum(r.class_size == 2 for r in found) == 2


def test_links_are_found_among_many_near_copies(spark):
    """Of pairs that are 0.8 alike by weight or plainly, by brute force, 0.9 or more end in one class; others only through such links."""
    rng = np.random.default_rng(4)
    data = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(90)]
        for k in range(9):
            w = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 3)):
                w[at] = f"g{g}k{k}e{at}"
            data.append((len(data), " ".join(w), "en", "s", 1))
    sets = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t, *_ in data)]
    df = collections.Counter(s for x in {tuple(sorted(x)): x for x in sets}.values() for s in x)
    n = len({tuple(sorted(x)) for x in sets})
    weight = {s: round(32 * (1 + math.log1p(n / c) / (2 * math.log1p(n)))) for s, c in df.items()}

    def alike(a, b):
        both = [s for s in a if s in b]
        shared, union = sum(min(a[s], b[s]) * weight[s] for s in both), sum(a[s] * weight[s] for s in a) + sum(b[s] * weight[s] for s in b)
        return max(shared / (union - shared), len(both) / (len(a) + len(b) - len(both))) >= 0.8

    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if i // 9 == j // 9 and alike(sets[i], sets[j])]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    found = {r.doc_id: r["class"] for r in near_dedup.NearDuplicates(docs(spark, data)).classes().collect()}
    assert len(pairs) > 100 and np.mean([found[i] == found[j] for i, j in pairs]) >= 0.9
    assert all(root(i) == root(j) for i, j in itertools.combinations(range(len(sets)), 2) if found[i] == found[j])


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = rng.integers(1, 60, 400), rng.integers(1, 60, 400)
    near_dedup.BANDS, saved = 12, near_dedup.BANDS
    order = np.argsort(keys)
    keys, a, b = keys[order], a[order], b[order]
    b[:200] = a[:200]
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = total = 0
    for trial in range(30):
        salted = kernels.mix(keys + np.uint64(trial))
        _, x = near_dedup.signatures(np.repeat([0, 1], 400), np.r_[salted, salted], np.r_[a, b])
        agree, total = agree + (x[0] == x[1]).sum(), total + x.shape[1]
    near_dedup.BANDS = saved
    assert abs(agree / total - exact**near_dedup.ROWS) < 0.12


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000))
def test_huffman_round_trip(ids):
    counts = np.bincount(ids, minlength=301)
    lengths = huffman.code_lengths(counts)
    payload, bits, offsets = huffman.encode(np.array(ids), lengths, huffman.canonical(lengths))
    assert bits == int(lengths[ids].sum())
    assert huffman.decode(payload, offsets, len(ids), huffman.decode_table(lengths)).tolist() == ids


def test_huffman_respects_its_limit():
    counts = np.array([1 << min(i, 40) for i in range(60)])
    lengths = huffman.code_lengths(counts, 8).astype(int)
    assert lengths.max() == 8 and (0.5**lengths).sum() == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBéÉ \n.'|<>=9漢s_̸", max_size=30), max_size=6))
def test_pieces_give_the_same_ids_as_whole_texts(texts):
    from tokenizers import Tokenizer

    path, _ = token_files.tokenizer_file()
    direct = Tokenizer.from_file(path)
    texts = [*texts, "a<|endoftext|>b <|ENDOFTEXT|>"]
    ids, at = token_files.WordIds.of(path).ids(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == direct.encode(text, add_special_tokens=False).ids + [1]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path, vocabulary = token_files.tokenizer_file()
    direct = Tokenizer.from_file(path)
    d = write(tmp_path, documents=docs(spark))
    found = token_files.op8_token_files(spark, d).collect()
    expect, start = [], 0
    for i, t, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(direct.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        expect.append((str(i), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in found) == sorted(expect)
    token_files.write_token_files(docs(spark), f"{tmp_path}/files", path, vocabulary)
    whole = token_files.read_token_files(spark, f"{tmp_path}/files").collect()
    assert {str(r.doc_id): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in whole} == {e[0]: e[3] for e in expect}
    assert token_files.token_digests(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,0)"])
def test_token_files_take_ids_of_other_types(spark, kind):
    long = "x" * 200_000
    x = spark.createDataFrame([(2, "b c"), (1, long), (None, None), (2, "b c")], "i long, text string").select(F.col("i").cast(kind).alias("doc_id"), "text")
    found = sorted(((str(r.doc_id), r.start, r.n_tokens) for r in token_files.token_digests(x).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == ["None", "1", "2", "2"] and found[0][1:] == (0, 1)
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:])) and found[2][2] == found[3][2]


def test_plain_words_are_encoded_together():
    """One call for all plain words of a batch; ids and lengths as of each word alone."""
    calls, ids = [], token_files.WordIds(token_files.tokenizer_file()[0])
    one = ids.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return one.encode_batch_fast(texts, **how)

    ids.tokenizer = Counted()
    plain = ["don't", "é'll", "''t", "ab12c", "a_b", "x.", "'", "ÿ÷"[:1], "zyzzyvas", "|"]
    odd = ["²x", "ıß", "<|endoftext|>", "x<|y", "İ", "中文", "\x85", "É"]
    for given_words in (plain + odd, plain, odd, odd[::-1] + plain):
        calls.clear()
        flat, length = ids.encoded(given_words)
        assert sum(calls) == 1 + len([w for w in given_words if w in odd])
        at = np.r_[0, np.cumsum(length)]
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [one.encode(w, add_special_tokens=False).ids for w in given_words]
    ids.last[:] = False  # a tokenizer without ids for the end of a part
    assert ids.encoded(plain)[0].tolist() == [i for w in plain for i in one.encode(w, add_special_tokens=False).ids]


def test_chunks_are_filled_over_batches(spark):
    """Chunks of a role don't end with a batch, and have an end however short their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x = spark.range(200).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("Ab c"), F.col("id").cast("string"))).alias("text"), (F.col("id") % 3).cast("int").alias("role"), F.lit(1).cast("long").alias("mark"))
        whole = chunks.chunked(x, "test-chunks").collect()
        small = chunks.chunked(x, "test-chunks", most=400).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.role for r in whole) == [0, 1, 2]
    for made in (whole, small):
        assert len({r.chunk for r in made}) == len(made)
        assert sorted((i, r.role) for r in made for i in r.doc_ids) == [(i, i % 3) for i in range(200)]
        assert all(c == (2 if i % 9 else 0) for r in made for i, c in zip(r.doc_ids, r.counts))
    assert len(small) > 3 and all(16 * len(r.doc_ids) <= 400 for r in small)
