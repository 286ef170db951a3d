"""Pieces against the library, hard negatives and centroids against plain Python."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from haplospark.llm import centroids, hard_negatives, pieces
from tests.llm.tools import docs, rows, write

PATH = public_tokenizers.path(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ALPHABET = "ab ethr ▁\t\né漢\U0001f642́-0x<s>/"
VECTORS = "vec_id long, embedding array<float>, label int, text string, anchor long"


def same(text):
    packed = pieces.model(PATH).encode(text)
    ids = np.frombuffer(packed, "<u4").tolist()
    assert ids == LIBRARY.encode(text or "", add_bos=True, add_eos=True), repr(text)[:200]
    assert pieces.model(PATH).decode(packed) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=60), st.text(max_size=30), st.lists(st.sampled_from([" ", "  ", "the", "therein", "aaaa", "▁" * 7, "<0x0A>", "tion", "Straße"]), max_size=20).map("".join)))
def test_pieces_are_the_library_s(text):
    same(text)


def test_pieces_of_runs_and_long_texts(monkeypatch):
    for n in [*range(1, 80), 1000]:
        same(" " * n)
        same("x" + " " * n + "therefore")
        same("a" * n)
        same(" " * n + "漢")
    r = random.Random(1)
    same("".join(r.choice(ALPHABET) for _ in range(40_000)))
    same("".join(r.choice("abc") for _ in range(20_000)))
    monkeypatch.setattr(pieces, "SEGMENT", 50)
    same("".join(r.choice("the a  of▁") for _ in range(3_000)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 270), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert pieces.model(PATH).decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


def test_pieces_whole_table(spark, tmp_path):
    d = write(tmp_path, documents=docs(spark))
    found = sorted(map(tuple, pieces.op11_pieces(spark, d).collect()), key=str)
    expect = []
    for i, text, *_ in rows():
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert found == sorted(expect, key=str)
    clash = docs(spark).selectExpr("*", "1 AS ids", "2 AS decoded")
    assert pieces.with_text(pieces.with_ids(clash)).columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    assert pieces.with_text(pieces.with_ids(clash)).count() == len(rows())
    assert pieces.with_ids(docs(spark, [])).count() == 0


def vectors(seed, n, dims=6):
    """Random small vectors with ties, copies beyond what one pass gathers, repeated and null ids, and rows that take no part."""
    r = random.Random(seed)
    out = [(i, [round(r.uniform(-0.1, 0.1), 2) for _ in range(dims)], r.randrange(4), "x", 1) for i in range(n)]
    out += [(1000 + r.randrange(200), [0.1] * dims, r.randrange(4), None, None) for _ in range(2 * hard_negatives.GATHER)]
    out += [(200, [0.05] * dims, 1, "x", 1)] * 3 + [(None, [0.1] * dims, c, "x", 1) for c in range(4)]
    out += [(300, None, 1, "x", 1), (400, [0.1] * dims, None, "x", 1), (500, [math.inf] * dims, 1, "x", 1), (600, [None] * dims, 1, "x", 1), (700, [math.nan] + [0.0] * (dims - 1), 1, "x", 1)]
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def mined(data):
    kept = [(i, whole(v), (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c, *_ in data if usable(v) and c is not None]
    first = lambda found: sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:5]
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(i, sum(p * q for p, q in zip(x, y)), c == label) for b, (i, y, c) in enumerate(kept) if b != a]
        for positive, high in first([(i, s) for i, s, own in scored if own]):
            for rank, (negative, score) in enumerate(first([(i, s) for i, s, own in scored if not own and 80 * high <= 100 * s <= 100 * high]), 1):
                out.append((anchor, positive, rank, negative, high, score))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "n", "digit"), [(1, 260, 8), (2, 60, 2)])
def test_hard_negatives(spark, tmp_path, monkeypatch, seed, n, digit):
    monkeypatch.setattr(hard_negatives, "DIGIT_BITS", digit)
    data = vectors(seed, n)
    data += [(900, [0.1, 0.09], 2, "short", 1), (901, [0.1] * 9, 3, "long", 1), (902, [], 1, "none", 1)]
    d = write(tmp_path, embeddings=spark.createDataFrame(data, VECTORS).repartition(3))
    found = sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, d).collect()), key=str)
    assert found == mined(data) and found


def test_hard_negatives_of_nothing(spark, tmp_path):
    d = write(tmp_path, embeddings=spark.createDataFrame([], VECTORS))
    assert hard_negatives.op12_hard_negatives(spark, d).collect() == []
    alone = write(tmp_path / "alone", embeddings=spark.createDataFrame([(100, [0.1], 1, "x", 1), (101, [0.1], 1, "x", 1)], VECTORS))
    assert hard_negatives.op12_hard_negatives(spark, alone).collect() == []


def test_products_are_exact():
    big = np.full((2, 8), 1 << 26, np.int64)
    assert (hard_negatives.products(big, big) == 8 << 52).all()


def clustered(data, k, rounds, width):
    kept = [(i, whole(v)) for i, v, *_ in data if usable(v) and len(v) == width]
    hashed = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    at = [v for _, v in hashed[:k]]
    nearest = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        at = [[sum(x[d] for x in mine) // len(mine) for d in range(width)] if (mine := [x for (_, x), o in zip(kept, own) if o == j]) else c for j, c in enumerate(at)]
    last = [(i, *nearest(x)[::-1]) for i, x in kept]
    of = [sum(d for _, c, d in last if c == j) for j in range(k)]
    return sorted([(i, c, d, of[c], sum(of), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in last], key=str)


@pytest.mark.parametrize("n", [400, 10])
def test_centroids(spark, tmp_path, n):
    data = vectors(3, n, 64) + [(950, [0.1] * 63, 1, "short", 1)]
    d = write(tmp_path, embeddings=spark.createDataFrame(data, VECTORS).repartition(3))
    found = sorted(map(tuple, centroids.op13_exponion_clusters(spark, d).collect()), key=str)
    assert found == clustered(data, 40, 5, 64)


def test_centroids_skip_and_tie():
    """Bounds over several rounds of moved centroids, many ties and doubled centroids: as a full scan."""
    r = np.random.default_rng(5)
    x = r.integers(-4, 5, (3000, 3))
    at = np.concatenate([x[:15], x[:5]])
    cluster, upper, lower, before = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x)), None
    for _ in range(8):
        centroids.assign(x, cluster, upper, lower, centroids.Centroids(at, before))
        full = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all()
        before, at = at, np.array([np.floor_divide(x[cluster == j].sum(axis=0), (cluster == j).sum()) if (cluster == j).any() else c for j, c in enumerate(at)])


def test_centroids_of_nothing(spark, tmp_path):
    d = write(tmp_path, embeddings=spark.createDataFrame([], VECTORS))
    found = centroids.op13_exponion_clusters(spark, d)
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    one = write(tmp_path / "one", embeddings=spark.createDataFrame([(1, [0.5] * 64, 1, "x", 1)] * 3, VECTORS))
    assert {r.distance for r in centroids.op13_exponion_clusters(spark, one).collect()} == {0}
