"""Fingerprints, packing and token counts against brute force and the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import packing, queries, simhash, token_counts, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, start long"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in rows], SCHEMA).repartition(parts)


def texts(n=60, seed=3):
    rng = random.Random(seed)
    pool = [f"wörd{k}" if k % 9 == 0 else f"term{k}" for k in range(400)]
    out = [" ".join(rng.choices(pool, k=rng.randint(1, 400))) + rng.choice(["", "\n\n ", "  x", "'s we'll 12345"]) for _ in range(n)]
    return out + [None, "", " ", "a", "ab cd", "  lead", "日本語のテキスト。" * 30, "emoji 🙂🙂   sep", "<|endoftext|> x", "\t\t\n mixed \r\n\r\n  end ", "aaaa" * 700]


def slow():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_both_encoders_agree():
    enc, ref = tokens.Encoder(PATH), slow()
    assert enc.fast is not None
    for t in texts():
        assert enc.encode(t or "") == ref.encode(t or "", add_special_tokens=False).ids
    rng = random.Random(1)
    alphabet = [c for c in map(chr, range(9, 0x30FA)) if tokens._SETTLED.fullmatch(c)]
    for _ in range(300):
        t = "".join(rng.choices(alphabet, k=40)) + "".join(rng.choices(" \n\ta1.'é", k=60))
        assert tokens._SETTLED.fullmatch(t) and enc.fast.encode_ordinary(t) == ref.encode(t, add_special_tokens=False).ids


def test_differencing():
    placed, heaviest = packing.differencing([8, 7, 6, 5, 4], 2)
    assert heaviest == max(sum(s for s, p in zip([8, 7, 6, 5, 4], placed) if p == k) for k in (0, 1)) == 16
    rng = random.Random(5)
    sizes = [rng.randint(1, 512) for _ in range(400)]
    placed, heaviest = packing.differencing(sizes, 60)
    loads = np.bincount(placed, weights=sizes, minlength=60)
    assert heaviest == loads.max() and loads.max() - loads.min() < 64
    assert packing.differencing([5], 1)[1] == 5 and max(np.bincount(packing.balanced([9, 9, 9], 10))) == 1


def test_pack_round_trip(spark):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "no id")]
    got = packing.pack(docs(spark, rows), PATH).collect()
    ref, sequences, pieces = slow(), {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= packing.WINDOW
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["row_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    for i, t in rows:
        if i not in (3, None):
            own = sorted(pieces[i], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == [*ref.encode(t or "", add_special_tokens=False).ids, 1]
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_packing_pads_little():
    rng = random.Random(2)
    sizes = [rng.randint(1, 512) for _ in range(packing.GROUP)]
    n = packing.balanced(sizes, packing.WINDOW).max() + 1
    assert n * packing.WINDOW <= 1.03 * sum(sizes)


def test_fingerprint_by_votes():
    for t in texts(8):
        found = [w for w in (t or "").encode().lower().split()]
        want = bytes(16)
        if found:
            from collections import Counter

            from stemma.llm.words import mix64, word_hashes

            mark = simhash._MARK[0]
            h = [mark, *word_hashes(found), mark]
            votes = [0.0] * 128
            with np.errstate(over="ignore"):
                for (a, b), c in Counter(zip(h, h[1:])).items():
                    x = mix64(np.array([a], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + b)
                    y = mix64(x + np.uint64(0x452821E638D01377))
                    bits = np.unpackbits(np.concatenate([x, y]).view(np.uint8))
                    for k in range(128):
                        votes[k] += (1 + np.log(c)) * (1 if bits[k] else -1)
            want = np.packbits([v > 0 for v in votes]).tobytes()
        assert simhash.fingerprint(t) == want


def test_edits_follow_the_order_of_ids(spark):
    rows = [(7 * i, t) for i, t in enumerate(texts(30))] + [(7, "tie b"), (None, "null id")]
    got = simhash.fingerprint_edits(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = map(simhash.fingerprint, (t, edited, n))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.fingerprint_edits(docs(spark, [])).count() == 0
    only = simhash.fingerprint_edits(docs(spark, [(1, "only one text here")])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0


def test_radius_search_is_complete(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 7))) for b in base for _ in range(6)]
    all_fp = {f"{b:032x}" for b in base + near}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "fingerprint string")
    ask = sorted(all_fp)[::5]
    got = simhash.radius_search(frame(ask), frame([*all_fp, *ask])).collect()
    want = {(a, b, d) for a in ask for b in all_fp if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= simhash.RADIUS}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("radius", [0, 4, 8, 20])
def test_radius_search_at_the_border(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)] + [0, (1 << 128) - 1]
    pairs = {(f"{b:032x}", f"{b ^ sum(1 << k for k in rng.sample(range(128), d)):032x}", d) for b in base for d in {max(0, radius - 1), radius, radius + 1} for _ in range(4)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "fingerprint string")
    got = simhash.radius_search(frame([p[0] for p in pairs]), frame([p[1] for p in pairs]), radius).collect()
    assert sorted(tuple(r) for r in got) == sorted(p for p in pairs if p[2] <= radius)


def test_search_finds_edited_texts(spark):
    rng = random.Random(6)
    pool = [f"w{k}" for k in range(3000)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, edited = [], {}
    for i in range(60):
        w = rng.choices(pool, k=rng.randint(80, 400))
        e = list(w)
        for _ in range(len(w) // 60):
            e[rng.randrange(len(e))] = rng.choice(pool)
        a, b = shingles(w), shingles(e)
        assert len(a & b) / len(a | b) >= 0.75
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(e))]
    marks = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(docs(spark, rows)).collect()}
    frame = lambda odd: spark.createDataFrame([(f,) for i, f in marks.items() if i % 2 == odd], "fingerprint string")
    got = {(r["query_fp"], r["found_fp"]) for r in simhash.radius_search(frame(0), frame(1)).collect()}
    want = {(marks[2 * i], marks[2 * i + 1]) for i in range(60)}
    assert len(got & want) >= 0.95 * len(want) and got <= want


def test_column_of_fingerprints(spark):
    got = simhash.fingerprints(docs(spark, [(1, "a b"), (2, None)])).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {1: simhash.fingerprint("a b").hex(), 2: "0" * 32}


def test_trees_follow_edits():
    ref, enc, rng = slow(), tokens.encoder(PATH).encode, random.Random(9)
    count = lambda t: len(ref.encode(t, add_special_tokens=False).ids)
    for t in texts(20):
        t = (t or "") * 9
        tree = token_counts.Tree.of(t, enc)
        assert tree.tokens[1] == count(t) and tree.chars[1] == len(t)
        for _ in range(12):
            start, delete = rng.randint(0, len(t) + 5), rng.choice([0, 1, 3, 40, 3000])
            insert = rng.choice(["", " ", "x", "  y", "\n\n", "'s", " one two three " * rng.randint(1, 300), "é"])
            s = min(start, len(t))
            want = t[:s] + insert + t[min(s + delete, len(t)) :]
            t, again = tree.edit(t, start, delete, insert, enc)
            assert t == want and tree.chars[1] == len(t) and tree.tokens[1] == count(t)


def test_long_texts_encode_only_what_an_edit_touches():
    enc = tokens.encoder(PATH).encode
    t = "some plain words here " * 20_000
    tree = token_counts.Tree.of(t, enc)
    edited, again = tree.edit(t, 200_000, 5, "new", enc)
    assert again < 4 * token_counts.LEAF and tree.tokens[1] == len(enc(edited))


def test_texts_without_spaces_are_cut():
    enc = tokens.encoder(PATH).encode
    kana = "".join(random.Random(2).choices("あいうえおかきくけこ漢字仮名", k=30)) + "。"
    for t in (kana * 4000, "alpha,beta;gamma." * 5000, "line\n" * 20_000, "a.b,c" * 9000):
        parts = token_counts.leaf_texts(t)
        assert max(map(len, parts)) < 2 * token_counts.LEAF and "".join(parts) == t
        tree = token_counts.Tree.of(t, enc)
        assert tree.tokens[1] == len(enc(t))
        edited, again = tree.edit(t, len(t) // 2, 3, "。新しい", enc)
        assert again < 4 * token_counts.LEAF and tree.tokens[1] == len(enc(edited))


def test_cuts_are_borders_of_pre_tokens():
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(PATH).pre_tokenizer
    rng = random.Random(12)
    alphabet = [*" \n\t'.,;:!?()|<>_-\"", *"aéßsZ7٣", "日", "ア", "。", "、", "…", "🙂", "\u0301", "\u00a0"]
    cuts = 0
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(2, 24)))
        starts = {a for _, (a, _) in split.pre_tokenize_str(t)}
        found = {m.start() for m in token_counts._CUT.finditer(t)}
        cuts += len(found)
        assert found <= starts, (t, found - starts)
    assert cuts > 3000


def test_a_tree_is_dealt_anew_only_when_a_leaf_has_grown():
    enc = tokens.encoder(PATH).encode
    t = "some plain words here " * 2000
    tree = token_counts.Tree.of(t, enc)
    leaves, built = tree.leaves, []
    deal = tree.deal
    tree.deal = lambda *a: (built.append(1), deal(*a))
    for _ in range(40):
        t, _ = tree.edit(t, 20_000, 0, " more words of text" * 20, enc)
        assert tree.chars[1] == len(t)
    assert tree.tokens[1] == len(enc(t)) and 1 <= len(built) <= 8 and tree.leaves > leaves
    t, _ = tree.edit(t, 0, len(t), "x", enc)
    assert (tree.tokens[1], tree.chars[1]) == (1, 1)


def test_a_null_tree_is_counted_anew(spark):
    rows = docs(spark, [(1, "some words"), (2, None)]).withColumn("token_tree", F.lit(None).cast(token_counts.TREE)).withColumn("n_tokens", F.lit(None).cast("long"))
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("delete"), F.lit("two more ").alias("insert")))
    got = {r["doc_id"]: (r["text"], r["n_tokens"]) for r in token_counts.apply_edits(rows.withColumn("edits", edits), PATH).collect()}
    assert got == {i: (t, len(tokens.encoder(PATH).encode(t))) for i, t in ((1, "two more some words"), (2, "two more "))}


def test_counts_and_edits_on_tables(spark):
    rows = list(enumerate(texts(10))) + [(2, "again"), (None, None)]
    counted = token_counts.count_tokens(docs(spark, rows), PATH)
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(None).cast("int").alias("delete"), F.lit("zz top").alias("insert")), F.struct(F.lit(-4).alias("start"), F.lit(1).alias("delete"), F.lit(None).cast("string").alias("insert")))
    got = token_counts.apply_edits(counted.withColumn("edits", edits), PATH).collect()
    ref, want = slow(), []
    for i, t in rows:
        t = t or ""
        t = (t[:2] + "zz top" + t[2:])[1:]
        want.append((i, t, len(ref.encode(t, add_special_tokens=False).ids)))
    assert sorted(str((r["doc_id"], r["text"], r["n_tokens"])) for r in got) == sorted(map(str, want))
    assert {"part", "start"} <= set(got[0].asDict())
    assert token_counts.count_tokens(docs(spark, []), PATH).count() == 0


def test_packing_query_digests(spark, tmp_path):
    docs(spark, list(enumerate(texts(10)))).write.parquet(str(tmp_path / "documents.parquet"))
    ref, by = slow(), {}
    for r in queries.op3_packing(spark, str(tmp_path)).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts(10)):
        ids, at = [*ref.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
