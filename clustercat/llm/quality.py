"""Document quality by hierarchical empirical Bayes.

A document's evidence comes from logistic models over its words and shape, fitted
on a bounded sample of labelled rows. Sites say how often their documents are bad: the
expected numbers of bad documents are summed by host and by path, a path is shrunk
towards its host and a host towards the whole corpus, by as much as the spread
between sites asks for. The posterior joins the document's likelihood ratio with the
prior of its path, which leaves out the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustercat.llm.common import located, sampled, small_batches, word_blocks
from clustercat.storage import keep

CACHE_WORDS = 200_000
PREFIXES = (4, 5, 6)
SHAPE = ("words", "upper", "symbols", "unique", "variety", "repeats", "length", "lines")
TONE = ("strongest", "two")
PLAIN_MARKS = frozenset(".,;:'’\"?!-()")


def bare(word: str) -> str:
    """The word in lower case without what isn't a letter at its ends."""
    word = word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not word[end - 1].isalpha():
        end -= 1
    return word[start:end]


def word_features(word: str) -> list[str]:
    """The bare word and its prefixes, marked by their length."""
    if len(word) < 3:
        return []
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


class Words:
    """What a worker remembers of words: whether in capitals, with symbols, and their evidence."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._start()

    def _start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, 4))

    def indexes(self, words: list[bytes]) -> np.ndarray:
        places = list(map(self.known.get, words))
        if None in places:
            for word in dict.fromkeys(words):
                if word not in self.known:
                    self._learn(word)
            places = list(map(self.known.__getitem__, words))
        return np.array(places, np.int64)

    def _learn(self, word: bytes) -> None:
        if len(self.known) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        text = word.decode(errors="replace")
        evidence = max((self.lexicon.get(f, 0.0) for f in word_features(bare(text))), default=0.0)
        marked = text.endswith("!!") or any(not c.isalnum() and c not in PLAIN_MARKS for c in text)
        upper = sum(map(str.isupper, text)) > 1 and text == text.upper()
        self.rows[len(self.known)] = upper, marked, len(text), evidence
        self.known[word] = len(self.known)

    def features(self, text: str | None) -> list[float]:
        """The document's shape and tone, in the order of ``SHAPE`` and ``TONE``."""
        data = (text or "").encode()
        if len(self.known) > CACHE_WORDS:  # between documents, so a document's indexes agree
            self._start()
        parts = [self.indexes(words) for words in word_blocks(data) if words]
        if not parts:
            return [0.0] * (len(SHAPE) + len(TONE))
        at = np.concatenate(parts)
        n, unique = len(at), len(np.unique(at))
        seen = self.rows[at]
        lines = data.split(b"\n")
        return [
            np.log1p(n),
            seen[:, 0].mean(),
            seen[:, 1].mean(),
            unique / n,
            np.log1p(unique) / np.log1p(n),
            float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0,
            seen[:, 2].mean(),
            len(set(lines)) / len(lines),
            seen[:, 3].max(),
            (np.partition(seen[:, 3], -2)[-2:] if n > 1 else seen[:, 3]).sum(),
        ]


# Parts of the labelled sample, each judged with the words of the others.
FOLDS = 5


@dataclass
class Logistic:
    """Logistic model that adds up, for each feature, a step function or (``straight``) a multiple of it."""

    columns: list[int]
    straight: bool = False
    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    rate: float = 0.0

    def _design(self, x: np.ndarray) -> np.ndarray:
        one = np.ones((len(x), 1))
        if self.straight:
            return np.hstack([x[:, self.columns], one])
        parts = []
        for column, edges in zip(self.columns, self.edges):
            part = np.zeros((len(x), len(edges) + 1))
            part[np.arange(len(x)), np.searchsorted(edges, x[:, column], side="right")] = 1
            parts.append(part)
        return np.hstack([*parts, one])

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 24, ridge: float = 0.5) -> Logistic:
        """Newton's method with a small ridge; a sample of one class gives no evidence."""
        self.rate = float(y.mean()) if len(y) else 0.0
        if not 0 < self.rate < 1:
            return self
        # Even steps, and finer ones towards both ends of each feature.
        at = np.concatenate([np.linspace(0, 1, bins + 1)[1:-1], [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998]])
        self.edges = [np.unique(np.quantile(x[:, c], at)) for c in self.columns]
        design = self._design(x)
        weights = np.zeros(design.shape[1])
        weights[-1] = np.log(self.rate / (1 - self.rate))
        penalty = np.append(np.full(design.shape[1] - 1, ridge), 1e-6)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            slope = design.T @ (y - p) - penalty * weights
            move = np.linalg.solve(design.T @ (design * w[:, None]) + np.diag(penalty), slope)
            weights += np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-5:
                break
        self.weights = weights
        return self

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of each row: the model's log odds less those of its sample."""
        if self.weights is None:
            return np.zeros(len(x))
        return self._design(x) @ self.weights - np.log(self.rate / (1 - self.rate))


@dataclass
class QualityModel:
    lexicon: dict[str, float]
    low: Logistic
    toxic: Logistic


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, bound: int) -> DataFrame:
    """``id, text, low, toxic`` of about ``bound`` labelled documents, one row an id; an id labelled twice counts by its mean."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        (F.avg("quality") < 0.5).cast("int").alias("low"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")
    )
    marks = sampled(marks.filter("low is not null and toxic is not null"), bound, "doc_id")
    names = [F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    rows = located(docs.select(*names)).join(marks, "doc_id")
    # An id may be that of many documents: the first stands for it, so the sample is bounded.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("_cc_file", "_cc_row"))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n", "_cc_file", "_cc_row")
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bound: int = 20_000,
    lexicon_size: int = 20_000,
) -> QualityModel:
    """Fit on about ``bound`` labelled documents.

    The lexicon's evidence comes from all of them. The models must not see words that were
    found in the very rows they are fitted on, so each fold's features are made
    with a lexicon of the other folds.
    """
    small_batches(docs)
    sample = keep(labelled_sample(docs, labels, id_column, text_column, bound), "quality-sample")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32()]

        def flush():
            columns = [pa.array(c, k) for c, k in zip((names, marks, folds), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "fold"])

        for batch in batches:
            names, marks, folds = [], [], []
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found: set[str] = set()
                for words in word_blocks((text.as_py() or "").encode()):
                    for word in set(words):
                        found.update(word_features(bare(word.decode(errors="replace"))))
                names.extend(found)
                marks.extend([toxic] * len(found))
                folds.extend([fold] * len(found))
                if len(names) > 200_000:
                    yield flush()
                    names, marks, folds = [], [], []
            yield flush()

    counts = [F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")]
    rows_of = {r["fold"]: (r["t"], r["c"]) for r in sample.groupBy("fold").agg(*counts).collect()}
    counted = sample.select("text", "toxic", "fold").mapInArrow(emit, "feature string, toxic int, fold int")
    counted = counted.groupBy("feature", "fold").agg(*counts)
    # A feature that is rare among toxic rows is in no lexicon; the rest is kept fold by fold.
    common = counted.groupBy("feature").agg(F.sum("t").alias("all_t"), F.sum("c").alias("all_c")).filter("all_t >= 4")
    counted = keep(counted.join(common, "feature"), "quality-words")

    def lexicon_without(fold: int | None) -> dict[str, float]:
        toxic, clean = (sum(n[i] for f, n in rows_of.items() if f != fold) for i in (0, 1))
        if fold is None:
            found = counted.select("feature", F.col("all_t").alias("t"), F.col("all_c").alias("c")).distinct()
        else:
            own = [F.sum(F.when(F.col("fold") == fold, F.col(c)).otherwise(0)) for c in "tc"]
            found = counted.groupBy("feature", "all_t", "all_c").agg(own[0].alias("own_t"), own[1].alias("own_c"))
            found = found.selectExpr("feature", "all_t - own_t as t", "all_c - own_c as c")
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
        doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
        strong = found.filter("t >= 4").withColumn("evidence", odds - 2 * doubt).filter("evidence > 1")
        strong = strong.orderBy(F.desc("evidence"), "feature").limit(lexicon_size)
        return {r["feature"]: r["evidence"] for r in strong.select("feature", "evidence").collect()}

    lexicon = lexicon_without(None)
    rows = []
    for fold in sorted(rows_of):
        shaped = shapes(sample.filter(F.col("fold") == fold), "text", ["low", "toxic"], lexicon_without(fold))
        rows += shaped.collect()  # bounded by the sample
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(SHAPE) + len(TONE))
    low = np.array([r["low"] for r in rows], float)
    bad = np.array([r["toxic"] for r in rows], float)
    shape = list(range(len(SHAPE)))
    tone = list(range(len(SHAPE), len(SHAPE) + len(TONE)))
    return QualityModel(lexicon, Logistic(shape).fit(x, low), Logistic(tone, straight=True).fit(x, bad))


def shapes(docs: DataFrame, text: str, columns: list[str], lexicon: dict[str, float]) -> DataFrame:
    """``columns`` and the features ``x`` of every row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            x = pa.array([words.features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], x], [*batch.schema.names[1:], "x"])

    source = docs.select(F.col(text).cast("string").alias("_text"), *columns)
    schema = source.drop("_text").withColumn("x", F.array(F.lit(0.0))).schema
    return source.mapInArrow(convert, schema)


def document_evidence(docs: DataFrame, text: str, columns: list[str], model: QualityModel) -> DataFrame:
    """``columns`` and the log likelihood ratios ``low`` and ``toxic`` of every row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in batches:
            x = np.array([words.features(t.as_py()) for t in batch.column(0)], float).reshape(-1, len(SHAPE) + len(TONE))
            found = [pa.array(model.low.evidence(x)), pa.array(model.toxic.evidence(x))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], [*batch.schema.names[1:], "low", "toxic"])

    source = docs.select(F.col(text).cast("string").alias("_text"), *columns)
    schema = source.drop("_text").withColumns({"low": F.lit(0.0), "toxic": F.lit(0.0)}).schema
    return source.mapInArrow(convert, schema)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, bad: str, parent: Column) -> float:
    """Rows that the prior of a level is worth, from how far its groups lie apart (method of moments)."""
    mean = F.col(bad) / F.col("n")
    spread, noise, p = groups.agg(
        F.sum(F.col("n") * (mean - parent) ** 2) / F.sum("n"),
        F.sum(parent * (1 - parent)) / F.sum("n"),
        F.sum(F.col("n") * parent * (1 - parent)) / F.sum("n"),
    ).first()
    between = (spread or 0.0) - (noise or 0.0)
    if between <= 0 or not p:
        return 1e6
    return float(min(max(p / between - 1, 1.0), 1e6))


def site_priors(rows: DataFrame, rates: dict[str, float]) -> tuple[DataFrame, DataFrame, dict[str, dict[str, float]]]:
    """Expected bad documents by host and by path, and the strength of each level's prior.

    ``rows`` has ``host, path`` (no nulls) and ``p_low, p_toxic``.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p_low").alias("p_low"), F.sum("p_toxic").alias("p_toxic")]
    paths = keep(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = keep(
        paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "p_low", "p_toxic"))), "hosts"
    )
    strength = {}
    named = hosts.select("host", *(F.col(c).alias(f"host_{c}") for c in ("n", "p_low", "p_toxic")))
    inside = paths.join(named, "host")
    for kind, rate in rates.items():
        strength[kind] = {
            "host": _strength(hosts, f"p_{kind}", F.lit(rate)),
            "path": _strength(inside, f"p_{kind}", F.col(f"host_p_{kind}") / F.col("host_n")),
        }
    return paths, named, strength


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    bound: int = 20_000,
    limit: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: ``id, low, toxic`` (posteriors), ``kept`` and its locator.

    A document is rejected if either posterior is above ``limit``. ``host`` and ``path`` default to the
    source and the source's part in the document's language; nulls are one site. Null
    and empty texts are judged by their shape, zero words. Repeated rows and ids are
    rows of their own; other columns are ignored; an empty table gives no rows. Without labels of
    both kinds for a model there is no evidence of that kind, and the posterior is the labels'
    share, or 0 without labels.
    """
    model = fit(docs, labels, id_column, text_column, bound)
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    source = located(
        docs.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), F.col(text_column).alias("text"))
    )
    rates = {"low": model.low.rate, "toxic": model.toxic.rate}
    rows = document_evidence(source, "text", ["id", "host", "path", "_cc_file", "_cc_row"], model)
    odds = {k: float(np.log(max(r, 1e-9) / max(1 - r, 1e-9))) for k, r in rates.items()}
    rows = rows.withColumns({f"p_{k}": 1 / (1 + F.exp(-(F.col(k) + odds[k]))) for k in rates})
    rows = keep(rows, "document-evidence")
    paths, hosts, strength = site_priors(rows, rates)
    sites = paths.select("host", "path", *(F.col(c).alias(f"path_{c}") for c in ("n", "p_low", "p_toxic")))
    joined = rows.join(sites.join(hosts, "host"), ["host", "path"])
    posterior = {}
    for kind, rate in rates.items():
        own, s = F.col(f"p_{kind}"), strength[kind]
        of_host = (F.col(f"host_p_{kind}") - own + s["host"] * rate) / (F.col("host_n") - 1 + s["host"])
        of_path = (F.col(f"path_p_{kind}") - own + s["path"] * of_host) / (F.col("path_n") - 1 + s["path"])
        known = 0 < rate < 1
        posterior[kind] = 1 / (1 + F.exp(-(F.col(kind) + _logit(of_path)))) if known else F.lit(float(rate))
    judged = joined.select("id", "_cc_file", "_cc_row", *(posterior[k].alias(k) for k in rates))
    return judged.withColumn("kept", (F.col("low") <= limit) & (F.col("toxic") <= limit))
