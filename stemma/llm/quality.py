"""Quality classification by hierarchical empirical Bayes.

Two logistic classifiers, one for quality and one for toxicity, give each
document its evidence: the smaller of their log odds that it is good, less the
log odds of the training rows.  Their features are the presence of the
words, and of the beginnings of words, that tell good from bad labels best, and
a few shares of a text's shape.  They are trained on a bounded sample of the
labelled rows.

The evidence of all documents, labelled or not, is then summed up by host and
by path in grouped aggregations.  A host's share of good documents is shrunk to
the corpus's, a path's to its host's, with strengths estimated from how much
the groups differ beyond chance: sparse sites take the prior of what is above
them, large ones keep their own.  A document's prior is its path's posterior
without the document itself, and its posterior adds its evidence to it.

Defined results: good means quality 1 and not toxic; labels that are null or
repeat an id with another verdict are not used; with labels of one kind only,
or none, there is no evidence and everything is accepted; a text that is null
or has no words has evidence 0; a null host or path is a group of its own;
repeated rows are scored alike; columns of the names that are added are
replaced; an empty table gives no rows.

Every text is scored once: rows with their evidence are a table, from which the
groups are summed up and the verdicts are made.  ``url_sites`` gives host and
path columns for tables that have addresses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.plans.storage import broadcast_if_small, materialise

#: Labelled rows to train on, words kept as features, the ridge penalty, posterior needed, groups that may be broadcast.
SAMPLE, VOCABULARY, RIDGE, ACCEPT, SMALL = 6000, 900, 0.3, 0.5, 200_000
#: A word is a feature if the sample has it in this many documents and it tells the labels apart by so many deviations.
LEAST_DOCS, LEAST_Z = 8, 3.0
#: Bytes of the beginnings of words.
BEGINNINGS = (5, 6, 7)
#: Bounds of the strength with which a group is shrunk, in documents.
STRENGTH = (2.0, 1000.0)

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_AROUND = b".,;:'\"()!?"
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()|!?")


def shape(raw: bytes, found: list[bytes], distinct: int) -> list[float]:
    """Shares that describe a text's shape, each in a small range."""
    n, letters = max(1, len(found)), max(1, sum(map(len, found)))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / letters
    lines = raw.split(b"\n")
    return [
        share(_SYMBOL) ** 0.5, share(_UPPER) ** 0.5, share(_DIGIT) ** 0.5, share(b"|") ** 0.5, share(b"!?") ** 0.5, share(b".,;:") ** 0.5,
        min(letters / n, 30) / 10, distinct / n, np.log1p(n) / 5, 1 - len(set(lines)) / len(lines), min(len(lines) / n, 1) ** 0.5,
    ]


def features(text: str | None) -> tuple[set[bytes], list[float]] | None:
    """The distinct words and the shape of a text; None where it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    if not found:
        return None
    distinct = set(raw.lower().split())
    form = shape(raw, found, len(distinct))
    return {w.strip(_AROUND) for w in distinct} - {b""}, form


def terms(own: list[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words, told from words by the space behind them."""
    return {*own, *(w[:k] + b" " for k in BEGINNINGS for w in own if len(w) > k)}


class Model:
    """A logistic model: weights of terms and of standardised shape features."""

    def __init__(self, vocabulary: dict[bytes, float], centre, scale, weights, bias: float):
        self.vocabulary, self.centre, self.scale, self.weights, self.bias = vocabulary, centre, scale, weights, bias

    def log_odds(self, found: list[bytes], form: list[float]) -> float:
        z = np.clip((np.array(form) - self.centre) / self.scale, -6, 6)
        return self.bias + float(z @ self.weights) + sum(self.vocabulary.get(t, 0.0) for t in found)


class Judge:
    """Models that must all find a document good, and the training rows' log odds that they do."""

    def __init__(self, models: list[Model], prior: float):
        self.models, self.prior = models, prior
        known = set().union(*(m.vocabulary for m in models))
        self.words, self.begun = {t for t in known if t[-1:] != b" "}, {t[:-1] for t in known if t[-1:] == b" "}
        self.least = {t[: BEGINNINGS[0]] for t in self.begun}

    def evidence(self, text: str | None) -> float:
        made = features(text)
        if made is None or not self.models:
            return 0.0
        own, form = made
        found = self.words & own
        for w in [w for w in own if w[: BEGINNINGS[0]] in self.least]:
            found.update(w[:k] + b" " for k in BEGINNINGS if len(w) > k and w[:k] in self.begun)
        # In a fixed order, so that equal texts have equal evidence wherever they are scored.
        ordered = sorted(found)
        return float(np.clip(min(m.log_odds(ordered, form) for m in self.models) - self.prior, -30, 30))


def judge(rows: list[tuple[bytes, list[float], bool, bool]]) -> Judge | None:
    """Train on (words joined by spaces, shape, quality, clean); None unless some rows are good in both and some are not."""
    n_good = sum(q and c for *_, q, c in rows)
    if n_good in (0, len(rows)):
        return None
    models = [fit([(own, form, verdict[k]) for own, form, *verdict in rows]) for k in (0, 1)]
    return Judge([m for m in models if m], float(np.log(n_good / (len(rows) - n_good))))


def fit(rows: list[tuple[bytes, list[float], bool]]) -> Model | None:
    """Train on (words joined by spaces, shape, good); None unless both kinds are there."""
    good = np.array([r[2] for r in rows], bool)
    if good.all() or not good.any():
        return None
    # Both counts of a term in one number: good rows in units of 2 ** 32.
    counts: dict[bytes, int] = {}
    for joined, _, is_good in rows:
        one = 1 << 32 if is_good else 1
        for t in terms(joined.split(b" ")):
            counts[t] = counts.get(t, 0) + one
    n_bad, n_good = int((~good).sum()), int(good.sum())
    told = []
    for w, both in counts.items():
        bad, fine = both & 0xFFFFFFFF, both >> 32
        if bad + fine >= LEAST_DOCS:
            p = (bad + fine) / (n_bad + n_good)
            z = (bad / n_bad - fine / n_good) / (p * (1 - p) * (1 / n_bad + 1 / n_good) + 1e-12) ** 0.5
            if abs(z) >= LEAST_Z:
                told.append((-abs(z), w))
    counts.clear()
    chosen = [w for _, w in sorted(told)[:VOCABULARY]]
    place = {w: k for k, w in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, (joined, _, _) in enumerate(rows):
        x[k, [place[w] for w in place.keys() & terms(joined.split(b" "))]] = 1
    form = np.array([r[1] for r in rows])
    centre, scale = form.mean(axis=0), form.std(axis=0) + 1e-3
    x = np.concatenate([x, np.clip((form - centre) / scale, -6, 6).astype(np.float32), np.ones((len(rows), 1), np.float32)], axis=1)
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(np.float64), -30, 30)))
        gradient = (x.T @ (p - good).astype(np.float32)).astype(np.float64) + penalty * w
        curved = x * (p * (1 - p) + 1e-6).astype(np.float32)[:, None]
        step = np.linalg.solve((curved.T @ x).astype(np.float64) + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    n = len(chosen)
    return Model(dict(zip(chosen, w[:n].tolist(), strict=True)), centre, scale, w[n:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Judge | None:
    """Fit on at most ``sample`` labelled documents, chosen by the hash of their id."""
    verdicts = F.struct((F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("c"))
    sound = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias("__q_id"), verdicts.alias("v"))
    sound = sound.groupBy("__q_id").agg(F.min("v").alias("v"), F.max("v").alias("other")).filter("v = other")
    picked = F.broadcast(sound.orderBy(F.xxhash64("__q_id"), "__q_id").limit(sample).select("__q_id", "v.q", "v.c"))  # ``sample`` rows at most

    def made(batches):
        for batch in batches:
            out = [features(t.as_py()) for t in batch.column(0)]
            kept = [k for k, f in enumerate(out) if f is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b" ".join(sorted(out[k][0])) for k in kept], pa.binary()), pa.array([out[k][1] for k in kept], pa.list_(pa.float64())), *(batch.column(c).take(pa.array(kept, pa.int64())) for c in (1, 2, 3))],
                ["words", "shape", "q", "c", "id"],
            )

    joined = docs.select(F.col(id_col).alias("__q_id"), F.col(text_col).alias("text")).join(picked, "__q_id").select("text", "q", "c", F.col("__q_id").cast("long").alias("id"))
    seen = joined.mapInArrow(made, "words binary, shape array<double>, q boolean, c boolean, id long").orderBy("id", "words").toArrow().to_pylist()
    return judge([(r["words"], r["shape"], r["q"], r["c"]) for r in seen])


def _with_evidence(df: DataFrame, model: Judge, text_col: str) -> DataFrame:
    names, place = df.columns, df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("evidence", T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = [model.evidence(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "evidence"])

    return df.mapInArrow(run, schema)


def _key(*columns: str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, above: str) -> float:
    """Documents that the prior ``above`` counts as, by the moments of how group rates differ from it."""
    p = F.col(above)
    row = groups.filter("n > 1").agg(F.sum(F.col("n") * (F.col("good") / F.col("n") - p) ** 2).alias("seen"), F.sum(p * (1 - p)).alias("chance"), F.sum("n").alias("n"), F.sum(p * (1 - p) * F.col("n")).alias("spread")).first()
    if not row["n"] or row["seen"] is None:
        return STRENGTH[1]
    between = (row["seen"] - row["chance"]) / row["n"]
    within = row["spread"] / row["n"]
    return STRENGTH[1] if between <= 0 else float(min(max(within / between - 1, STRENGTH[0]), STRENGTH[1]))


def site_rates(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(path, n, good, host_rate, strength) for each path, shrunk through its host, from (host, path, evidence).

    A path's key must name its host as well.
    """
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(0.0))))
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"))
    paths = materialise(paths, "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = hosts.withColumn("above", F.lit(float(rate)))
    k = _strength(hosts, "above")
    hosts = hosts.select("host", ((F.col("good") + k * F.col("above")) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    return materialise(paths.withColumn("strength", F.lit(_strength(paths, "host_rate"))).select("path", "n", "good", "host_rate", "strength"), "sites")


def url_sites(df: DataFrame, url_col: str, host: str = "host", path: str = "path") -> DataFrame:
    """``df`` with the host of its addresses, in lower case without ``www.``, and the first part of their paths.

    What is no address has neither; an address without a path has an empty one.
    """
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]*)?(?:/([^/?#]*))?"
    is_url = F.col(url_col).rlike(pattern)
    name = F.regexp_replace(F.lower(F.regexp_extract(url_col, pattern, 1)), r"^www\.", "")
    return df.withColumns({host: F.when(is_url, name), path: F.when(is_url, F.regexp_extract(url_col, pattern, 2))})


def classify(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: tuple[str, ...] = ("lang",),
    accept: float = ACCEPT,
    sample: int = SAMPLE,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``evidence``, ``site_rate`` (its path's posterior without it), ``posterior`` and ``accepted``.

    With ``keep``, only these columns of ``df`` are carried and returned.
    """
    added = ("evidence", "site_rate", "posterior", "accepted")
    plain = df.drop(*added)
    kept = [c for c in plain.columns if keep is None or c in keep]
    model = train(plain, labels, id_col=id_col, text_col=text_col, sample=sample)
    if model is None:
        return plain.select(*kept).withColumns({"evidence": F.lit(0.0), "site_rate": F.lit(0.5), "posterior": F.lit(0.5), "accepted": F.lit(True)})
    host, path, known = (_free(n, plain.columns) for n in ("__host", "__path", "__site"))
    keyed = plain.withColumns({host: _key(host_col), path: _key(host_col, *path_cols)})
    scored = _with_evidence(keyed.select(*dict.fromkeys([*kept, text_col, host, path])), model, text_col)
    scored = materialise(scored.select(*kept, host, path, "evidence"), "scored")
    sites = broadcast_if_small(site_rates(scored, host, path), SMALL)
    joined = scored.join(sites.select(F.col("path").alias(path), F.struct("n", "good", "host_rate", "strength").alias(known)), path)
    site, own = F.col(known), 1 / (1 + F.exp(-F.col("evidence")))
    rate = (F.greatest(site["good"] - own, F.lit(0.0)) + site["strength"] * site["host_rate"]) / (site["n"] - 1 + site["strength"])
    rated = joined.withColumn("site_rate", F.least(F.greatest(rate, F.lit(0.001)), F.lit(0.999)))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site_rate")))))
    return rated.withColumn("posterior", posterior).withColumn("accepted", F.col("posterior") >= accept).select(*kept, *added)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
