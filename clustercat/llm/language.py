"""Language of documents and pages by Bayesian fusion of evidence.

The text gives a likelihood from byte trigrams. A page also declares a language in its
markup and has an address whose suffix tells something; how reliable both are is
counted over the whole corpus. The prior is the host's: its languages are counted too and
smoothed towards its domain's, and these towards the corpus's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import small_batches
from clustercat.storage import keep

BUCKETS = 1 << 15
BLOCK = 1 << 20
# Trigrams overlap and words repeat, so each counts for less than an independent observation.
TEMPER = 0.2
# Labelled documents that each language has in the sample, if there are as many.
LEAST = 500

# Parts of a page that don't speak: where they open, and what closes each.
_opened = re.compile(r"<!--|<(script|style|nav|header|footer|aside)\b", re.IGNORECASE)
_closed = {
    None: re.compile("-->"),
    **{name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "nav", "header", "footer", "aside")},
}
_tag = re.compile(r"<[^>]*>")
_html = re.compile(r"<html\b", re.IGNORECASE)
_lang = re.compile(r"\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]+)", re.IGNORECASE)
_letters = re.compile(r"[^\W\d_]+")


def _spoken(html: str) -> str:
    """The page with each closed silent part as one blank; one that is never closed stays. Every sign is passed once a kind."""
    parts, at, look, open_ended = [], 0, 0, set()
    while found := _opened.search(html, look):
        kind = found[1] and found[1].lower()
        end = None if kind in open_ended else _closed[kind].search(html, found.end())
        if end is None:
            open_ended.add(kind)
            look = found.end()
        else:
            parts += [html[at : found.start()], " "]
            at = look = end.end()
    return "".join([*parts, html[at:]])


def page_text(html: str) -> str:
    """What a page says, without scripts, styles, navigation and tags."""
    spoken = _spoken(html)
    last = spoken.rfind(">") + 1  # behind it no tag ends, so none has to be looked for
    return _tag.sub(" ", spoken[:last]) + spoken[last:]


def declared_language(html: str) -> str:
    """Start of the ``lang`` that the first ``<html>`` with one declares, in lower case, or nothing."""
    at = 0
    while found := _html.search(html, at):
        at = html.find(">", found.end())
        at = len(html) if at < 0 else at
        if lang := _lang.search(html, found.end(), at):
            return lang[1].lower()
    return ""


def trigram_counts(text: str) -> np.ndarray:
    """How often each hashed byte trigram occurs in the words of a text."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), BLOCK):
        words = " ".join(_letters.findall(text[at : at + BLOCK].lower()))
        codes = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint32)
        if len(words):
            grams = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(0x9E3779B1)
            counts += np.bincount(grams >> np.uint32(17), minlength=BUCKETS)
    return counts


def fit_text_model(
    docs: DataFrame, text_column: str, lang_column: str, bound: int, key: str
) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram in each.

    The languages are those of all labelled documents. Each is learnt from about its equal part of ``bound``
    documents, or ``LEAST`` if that is more, or all if it has no more, so a rare one stays however large the table is.
    """
    parts = 1_000_000
    rows = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(7), "key", "text"), F.lit(parts)))
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    if not seen:
        return [], np.zeros((0, BUCKETS))
    share = max(bound // len(seen), LEAST)
    # The row that is drawn first always takes part.
    limits = [(r["lang"], max(int(min(1.0, share / r["n"]) * parts), r["least"]) + 1) for r in seen]
    limit = F.create_map(*(F.lit(x) for pair in limits for x in pair))
    rows = rows.filter(F.col("draw") < limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                totals[lang] = totals.get(lang, 0) + trigram_counts(text.as_py())
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"]
            )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    # At most BUCKETS rows for each language of the sample.
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in seen)
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in found:
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(rows: DataFrame, columns: list[str], model: np.ndarray) -> DataFrame:
    """``columns`` and ``ll``: each language's tempered log likelihood, and ``declared`` from the markup.

    ``rows`` has ``text`` and ``is_html``.
    """
    table = model.T * TEMPER

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely, declared = [], []
            for text, is_html in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py() or ""
                declared.append(declared_language(text) if is_html else "")
                counts = trigram_counts(page_text(text) if is_html else text)
                at = np.flatnonzero(counts)
                score = counts[at] @ table[at] if len(at) else np.zeros(table.shape[1])
                likely.append(score - score.max(initial=-np.inf) if len(score) else score)
            arrays = [pa.array(likely, pa.list_(pa.float64())), pa.array(declared, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *arrays], [*batch.schema.names[2:], "ll", "declared"])

    source = rows.select("text", "is_html", *columns)
    schema = source.drop("text", "is_html").withColumns({"ll": F.array(F.lit(0.0)), "declared": F.lit("")}).schema
    return source.mapInArrow(convert, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(column: str, size: int) -> Column:
    return F.array(*(F.sum(F.col(column)[k]) for k in range(size)))


def fuse(evidence: DataFrame, langs: list[str], smoothing: float = 5.0) -> DataFrame:
    """``evidence`` (``ll, declared, suffix, domain, host``, no nulls) with ``lang, probability, text_lang``."""
    n = len(langs)
    rows = keep(evidence.withColumn("soft", _softmax(F.col("ll"))), "language-evidence")
    totals = rows.agg(*(F.sum(F.col("soft")[k]) for k in range(n))).first()
    totals = np.array([t or 0.0 for t in totals])
    share = (totals + 1) / (totals + 1).sum()
    corpus = F.array(*(F.lit(float(s)) for s in share))
    joined = rows
    for name in ("declared", "suffix"):
        # How often a language comes with this value, smoothed; "" says nothing.
        counts = rows.filter(F.col(name) != "").groupBy(name).agg(_sums("soft", n).alias("c"), F.count(F.lit(1)).alias("m"))
        known = rows.filter(F.col(name) != "").agg(_sums("soft", n).alias("t"), F.count(F.lit(1)).alias("all")).first()
        seen = [float(x or 0.0) for x in (known["t"] or [0.0] * n)] or [0.0] * n
        every = max(known["all"], 1)
        table = counts.select(
            name,
            F.array(
                *(F.log((F.col("c")[k] + smoothing * F.col("m") / every) / F.lit(seen[k] + smoothing)) for k in range(n))
            ).alias(f"by_{name}"),
        )
        joined = joined.join(keep(table, name), name, "left")
    domains = keep(
        rows.groupBy("domain").agg(_sums("soft", n).alias("c"), F.count(F.lit(1)).alias("m")).select(
            "domain",
            F.transform(F.arrays_zip("c", corpus.alias("g")), lambda z: (z["c"] + smoothing * z["g"])).alias("c"),
            (F.col("m") + smoothing).alias("m"),
        ).select("domain", F.transform("c", lambda x: x / F.col("m")).alias("by_domain")),
        "domains",
    )
    hosts = rows.groupBy("domain", "host").agg(_sums("soft", n).alias("hc"), F.count(F.lit(1)).alias("hm"))
    hosts = keep(hosts.join(domains, "domain").select("domain", "host", "hc", "hm", "by_domain"), "hosts")
    joined = joined.join(hosts, ["domain", "host"])
    zeros = F.array(*(F.lit(0.0) for _ in langs))
    parts = F.arrays_zip(
        F.col("ll"), F.col("soft"), F.coalesce("by_declared", zeros).alias("d"), F.coalesce("by_suffix", zeros).alias("s"),
        F.col("hc"), F.col("by_domain"),
    )
    # A row's own text doesn't speak twice: it is taken out of its host's counts.
    score = F.transform(
        parts,
        lambda z: z["ll"] + z["d"] + z["s"]
        + F.log(F.greatest(z["hc"] - z["soft"], F.lit(0.0)) + smoothing * z["by_domain"]),
    )
    final = joined.withColumn("posterior", _softmax(score))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return final.withColumns(
        {"lang": best(F.col("posterior")), "probability": F.array_max("posterior"), "text_lang": best(F.col("soft"))}
    )


def identify(
    docs: DataFrame,
    pages: DataFrame,
    bound: int = 8_000,
    doc_id: str = "doc_id",
    page_id: str = "page_id",
) -> DataFrame:
    """One row per document and per page: ``kind, doc_id, page_id, lang, probability, text_lang, declared``.

    The text model is fitted on about ``bound`` documents with a language, shared equally by the languages of
    all documents, and at least ``LEAST`` of each that has as many. A document's host is its source;
    it has no address and no markup. Empty and null texts get what their host and
    markup say; null sources and addresses are one host; ties go to the language first in order;
    repeated rows are rows of their own; other columns are ignored. Empty
    tables give no rows, and without a labelled document ``lang`` is null.
    """
    small_batches(docs)
    langs, model = fit_text_model(docs, "text", "lang", bound, doc_id)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    one = docs.select(
        F.lit("document").alias("kind"), F.col(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"),
        F.lit("").alias("suffix"), source.alias("domain"), source.alias("host"), F.col("text"), F.lit(False).alias("is_html"),
    )
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))
    two = pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col(page_id).cast("long").alias("page_id"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        host.alias("host"), F.col("html").alias("text"), F.lit(True).alias("is_html"),
    )
    both = one.unionByName(two)
    columns = ["kind", "doc_id", "page_id", "suffix", "domain", "host"]
    if not langs:
        nothing = F.lit(None).cast("string")
        return both.select("kind", "doc_id", "page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"),
                           nothing.alias("text_lang"), F.lit("").alias("declared"))
    fused = fuse(text_evidence(both, columns, model), langs)
    return fused.select("kind", "doc_id", "page_id", "lang", "probability", "text_lang", "declared")
