"""Each stage of the pipeline against a brute-force version of what it decides."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stemma.llm import quality

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=4):
    rng = random.Random(seed)
    pool = [f"word{k}" for k in range(800)]
    rows, labels = [], []

    def add(text, good=True, toxic=False):
        i = len(rows)
        rows.append((i, text, "en", f"site{rng.randrange(12)}", len(text)))
        labels.append((i, int(good), int(toxic)))

    for _ in range(260):
        w = rng.choices(pool, k=rng.randint(20, 120))
        text = " ".join(w)
        if rng.random() < 0.3:
            text += "\nfooter of every site"
        kind = rng.random()
        if kind < 0.12:
            add(" ".join(x + "%%%" for x in w), good=False)
        elif kind < 0.24:
            for _ in range(4):
                w[rng.randrange(len(w))] = "vile"
            add(" ".join(w), toxic=True)
        else:
            add(text)
            if rng.random() < 0.15:
                add(text)
            if rng.random() < 0.15:
                add(" ".join([*w[:-1], "changed"]))
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{n}")
        docs = spark.read.parquet(f"{folder}/out{n}")
        out.append(docs)
    return folder, [d.collect() for d in out], out


def test_columns(stages):
    _, _, frames = stages
    assert all(f.columns == frames[0].columns for f in frames[:5])


def test_quality_stage(spark, stages):
    folder, rows, frames = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    accepted = {r["doc_id"] for r in quality.classify(frames[0], labels).filter("accepted").collect()}
    assert {r["doc_id"] for r in rows[1]} == accepted
    verdict = {i: q and not t for i, q, t in corpus()[1]}
    assert sum(verdict[i] == (i in accepted) for i in verdict) / len(verdict) > 0.97


def test_line_stage(stages):
    _, rows, _ = stages
    sites, first = defaultdict(set), {}
    for r in rows[1]:
        for line in r["text"].split("\n"):
            sites[line].add(r["source"])
            first[line] = min(first.get(line, r["doc_id"]), r["doc_id"])
    want = {}
    for r in rows[1]:
        kept = [x for x in r["text"].split("\n") if len(sites[x]) < 10 or first[x] == r["doc_id"]]
        want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in rows[2]} == {i: t for i, t in want.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])


def test_near_stage(stages):
    _, rows, _ = stages
    grams = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows[2] for w in [r["text"].lower().split()]}
    up = {i: i for i in grams}
    for _ in range(4):
        for i in grams:
            for j in grams:
                if i < j and 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j]):
                    up[i] = up[j] = min(up[i], up[j])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(i for i, r in up.items() if i == r)


def test_mixing_stage(stages):
    _, rows, _ = stages
    size = {r["doc_id"]: len(r["text"].split()) for r in rows[3]}
    sizes, source = Counter(), {}
    for r in rows[3]:
        sizes[r["source"]] += size[r["doc_id"]]
        source[r["doc_id"]] = r["source"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in sizes}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in rows[4]:
        taken[r["source"]] += size[r["doc_id"]]
    assert all(abs(taken[s] - target[s]) <= max(v for i, v in size.items() if source[i] == s) for s in sizes)
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 2


def test_packing_stage(spark, stages):
    folder, rows, _ = stages
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(cp.tokenizer_path())
    want = sum(len(ref.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(r["length"] for r in rows[5]) == want
    assert cp.run(spark, folder).agg(F.sum("length")).first()[0] == want


def test_every_stage_takes_an_empty_table(spark, stages):
    folder, _, frames = stages
    empty = frames[0].filter("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stages_take_nulls(spark, stages):
    folder, _, _ = stages
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "some text here", "en", None, 14), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], SCHEMA)
    for _, stage in cp.STAGES[:3]:
        assert stage(spark, odd, folder).count() >= 3
    assert cp.mix_sources(spark, odd, folder).count() >= 1 and cp.pack_windows(spark, odd, folder).count() == 4


def test_columns_named_like_an_operators_own_keep_their_values(spark, stages):
    folder, _, frames = stages
    names = ["evidence", "accepted", "n_lines", "removed_lines", "posterior", "site_rate", "own_n_lines", "taken", "row_id", "h", "size"]
    clashing = frames[0].select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns
        assert out.filter(" OR ".join(f"{n} <> concat('{n} ', doc_id)" for n in names)).count() == 0 < out.count()


def test_long_texts_go_through_all_stages(spark, stages, tmp_path):
    folder, _, frames = stages
    rng = random.Random(3)
    long = "\n".join(" ".join(rng.choices([f"word{k}" for k in range(800)], k=30)) for _ in range(1500))
    docs = frames[0].unionByName(spark.createDataFrame([(9000, long, "en", "site1", len(long)), (9001, long + " end", "en", "site2", len(long) + 4)], SCHEMA))
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, folder)
        docs.write.mode("overwrite").parquet(str(tmp_path / f"{_}"))
        docs = spark.read.parquet(str(tmp_path / f"{_}"))
    assert [(r["doc_id"], r["text"]) for r in docs.filter("doc_id >= 9000").distinct().collect()] in ([(9000, long)], [])
