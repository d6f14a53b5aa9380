"""Very long texts beside empty ones, and tables whose further columns clash with the operators' own names."""

import random

import pytest

from stemma.llm import minhash, packing, simhash, suffixes, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row_id string, fingerprint string, start string, key string, n_tokens string, head string, rep string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"word{rng.randrange(5000)}" for _ in range(60_000)]
    other = [*words[:59_000], *(f"other{k}" for k in range(1000))]
    return [(1, " ".join(words)), (2, " ".join(other)), (3, None), (4, ""), (5, "x" * 300_000), (6, "few words")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], SCHEMA).repartition(2)


def test_near_duplicates(docs):
    got = {r["row_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True)}


def test_passages(docs):
    got = {r["row_id"]: (r["start_word"], r["n_words"], r["first_id"]) for r in suffixes.repeats(docs).collect()}
    assert got == {1: (0, 59_000, 1), 2: (0, 59_000, 1)}


def test_fingerprints(docs, rows):
    got = {r["row_id"]: r for r in simhash.fingerprint_edits(docs).collect()}
    assert {i: r["n_chars"] for i, r in got.items()} == {i: len(t or "") for i, t in rows}
    assert got[1]["near_next"] > 0.9 and got[3]["fingerprint"] == "0" * 32
    assert simhash.fingerprints(docs).columns.count("fingerprint") == 1


def test_packing(docs, rows):
    got = packing.pack(docs, PATH).collect()
    from stemma.llm.tokens import encoder

    want = sum(len(encoder(PATH).encode(t or "")) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == want


def test_token_counts(docs, rows):
    from stemma.llm.tokens import encoder

    out = token_counts.count_tokens(docs, PATH)
    assert out.columns.count("n_tokens") == 1
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(encoder(PATH).encode(t or "")) for i, t in rows}
