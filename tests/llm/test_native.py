"""Line dedup, mixing and sharding against brute force, with the edge cases their docstrings define."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from stemma.llm import line_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, taken string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in rows], SCHEMA)


def corpus(n=300):
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else ("hot" if i % 3 == 0 else f"s{i % 7}")
        text = None if i % 41 == 0 else "" if i % 43 == 0 else " ".join(f"w{(i * j) % 97}" for j in range(1, 3 + i % 50))
        rows.append((i, text, source))
    return rows + [(900, "twice", "s5"), (900, "twice", "s5"), (None, "no id", None), (None, None, None)]


def test_shards_match_the_mixture(spark):
    rows = corpus()
    got = sharding.assign_shards(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(8))
    for shard, n in per.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    source = {i: s for i, _, s in rows}
    hot = Counter(r["shard"] for r in got if source[r["row_id"]] == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    text = {i: t or "" for i, t, _ in rows if i is not None}
    for r in got:
        if r["row_id"] is not None:
            raw = text[r["row_id"]].encode()
            assert (r["size"], r["crc"]) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_rank_by_brute_force(spark):
    rows = [(i, f"t{i}", None if i % 5 == 0 else f"s{i % 3}") for i in range(120)]
    ranks = sharding.interleave(docs(spark, rows), id_col="doc_id", source_col="source", text_col="text", seed=7).collect()
    by = {}
    for r in ranks:
        by.setdefault(r["src"], []).append(r)
    for own in by.values():
        assert [r["row_id"] for r in sorted(own, key=lambda r: r["frac"])] == [r["row_id"] for r in sorted(own, key=lambda r: r["h"])]
        assert all(0 < r["frac"] < 1 for r in own)


def test_shards_of_nothing(spark):
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def test_shard_files(spark, tmp_path):
    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(40)]
    sharding.write_shards(docs(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(4))


def level_by_force(sizes, weights, share, most):
    """Share out, stop what is above its cap, reshare the excess until none is above."""
    budget, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in sizes if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in rest) for s in sizes}
        over = {s for s in rest if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(spark):
    rows = corpus()
    got = mixing.mix(docs(spark, rows)).collect()
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level_by_force(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    source = {i: s for i, _, s in rows}
    taken, targets = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["row_id"]]] += r["taken"]
        targets[source[r["row_id"]]] = r["target"]
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs(spark, rows).repartition(3)).collect()
    key = lambda r: str((r["row_id"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_are_the_balanced_ones(spark):
    """The conditions that entropy balancing has: targets, one tilt for each source, one for length, and the bound."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}") for i, n in enumerate(np.exp(rng.normal(3 + (np.arange(400) % 5) / 3, 1)).astype(int) + 1)]
    got = mixing.mix(docs(spark, rows)).collect()
    size, rate = np.array([r["size"] for r in got], float), np.array([r["rate"] for r in got])
    src = np.array([f"s{r['row_id'] % 5}" for r in got])
    target = {s: r["target"] for s, r in zip(src, got)}
    z = np.log(size + 1) - (size * np.log(size + 1)).sum() / size.sum()
    assert (rate <= 2).all() and len(set(rate[rate < 2])) > 20
    for s in set(src):
        assert abs((size * rate)[src == s].sum() - target[s]) < 1e-6 * target[s]
    free = rate < 2
    capped = {s for s in target if target[s] >= 2 * size[src == s].sum()}
    # One slope over all sources that have anything to balance.
    slopes = []
    for s in set(src) - capped:
        own = free & (src == s)
        slope, start = np.polyfit(z[own], np.log(rate[own]), 1)
        assert np.allclose(start + slope * z[own], np.log(rate[own]), atol=1e-9)
        slopes.append(slope)
    assert np.ptp(slopes) < 1e-9 and abs(slopes[0]) > 1e-4
    assert abs((size * rate * z).sum() + mixing.RIDGE * sum(target.values()) * slopes[0]) < 1e-6 * size.sum()


def test_many_rows_without_an_id(spark):
    rows = [(None, f"t{k} " * 4, "s1") for k in range(300)] + [(7, f"u{k} " * 4, "s1") for k in range(100)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len({r["h"][:3] for r in got}) > 300 and abs(sum(r["taken"] for r in got) - 2400) <= 1
    assert mixing.take_copies(docs(spark, rows)).count() == 600
    assert mixing.take_copies(docs(spark, [(None, "a b c d", "s")] * 10)).count() == 15
    assert len({r["frac"] for r in sharding.interleave(docs(spark, rows), id_col="doc_id", source_col="source", text_col="text", seed=7).collect()}) == 400


def test_mix_copies_rows(spark):
    rows = [(i, "a b c d", f"s{i % 2}") for i in range(50)]
    out = mixing.take_copies(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    per = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert max(per.values()) <= 2 and abs(sum(per.values()) - 75) <= 2
    assert mixing.take_copies(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"own line {i}\nshared footer \n\nalso {i}", f"site{i % 12}") for i in range(40)]
    rows += [(100 + i, f"narrow\nown {i}", f"site{i % 9}") for i in range(30)]
    rows += [(200 + i, f"edge\nx{i}", f"site{i}") for i in range(10)]
    rows += [(300, None, None), (301, "", None), (302, "\n".join(["shared footer"] * 3), "z"), (None, "shared footer\nkeep", None), (None, "shared footer\nkeep", None)]
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert out.columns[:-2] == docs(spark, []).columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[0][0]["text"] == rows[0][1] and got[0][0]["removed_lines"] == 0
    assert all(got[i][0]["text"] == f"own line {i}\n\nalso {i}" and got[i][0]["removed_lines"] == 1 for i in range(1, 40))
    assert all(got[100 + i][0]["text"] == f"narrow\nown {i}" for i in range(30))
    assert got[200][0]["text"] == "edge\nx0" and all(got[200 + i][0]["text"] == f"x{i}" for i in range(1, 10))
    assert got[300][0]["text"] is None and got[300][0]["n_lines"] == 0 and got[301][0]["text"] == ""
    assert got[302][0]["text"] == "" and got[302][0]["removed_lines"] == 3
    assert [r["text"] for r in got[None]] == ["keep", "keep"]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_counts_near_the_threshold_exactly(spark):
    # A sketch of 16 registers is far off here; the exact counts decide.
    rows = [(k * 1000 + i, f"line {k}\n{k} {i}", f"site{i}") for k in range(30) for i in range(60 + k % 3 - 1)]
    found = line_dedup.boilerplate(docs(spark, rows), min_sites=60, lg_k=4)
    assert found.count() == sum(60 + k % 3 - 1 >= 60 for k in range(30))


def test_whole_texts(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    out = line_dedup.dedup_lines(docs(spark, [(1, long, "a"), (2, long, "b")]), min_sites=2).orderBy("doc_id").collect()
    assert out[0]["text"] == long and out[1]["text"] == "" and out[1]["removed_lines"] == 20_000
    assert mixing.mix(docs(spark, [(1, long, "a")])).select(F.sum("size")).first()[0] == 40_000
