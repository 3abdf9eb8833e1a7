"""Language identification by Bayesian evidence fusion.

For a page with text x, declared markup language d and host h, over the languages l of the labelled sample,

    log p(l | x, d, h) = tempered log p(x | l) + log p(d | l) + log p(l | h) + constant

* p(x | l): naive Bayes over hashed byte trigrams of the whole text, fitted to a bounded sample: of each label
  the different texts whose hash falls into a range that holds ``per_language`` of them on average, and at least that of least hash. Trigrams overlap, so the mean log likelihood counts
  as ``weight`` independent ones at most. Labels may be wrong: junk that bears one would teach the model that it is a language. So of the sample only
  texts that are typical of their label count: a text's typicality is the mean, over its trigrams, of the share of the label's other texts that
  hold the trigram, and it must reach ``typical`` of the label's median. What less than about that share of a label's texts have to themselves
  is left out, however alike they are. Only the sample is trimmed; every document is then judged by its likelihood.
* p(d | l): how often pages whose text speaks for l declare d, by grouped aggregation over all pages, with added counts.
* p(l | h): prior of the host, smoothed towards its registered domain, that towards its address suffix, that towards the whole corpus;
  registered domains have two labels, three below a country's general suffix such as co.uk; each level adds ``kappa`` pseudo-counts of the next. A page's own count is taken out of every level.

A page is rejected (language null) if its text has no letters, or its mean log likelihood under the best language is no better than
``margin`` nats over a uniform choice of trigrams (then no language explains it, whatever is declared), or if the best posterior is under
``least``.

There is one language for each label, at most ``MOST_LABELS`` (more are an error); a page's row of likelihoods and the model (64 KiB a language) grow with their number.
Counts are combined before the shuffle; a host with a third of all pages is one row of counts, joined back adaptively.

Defined cases: null or empty text is rejected; null URL or no declared language are values of their own; with no labelled rows nothing can be
judged, so all languages are null and nothing is rejected; repeated rows are judged alike; an empty table gives no rows; extra columns are
carried by ``filter_documents`` and ignored by ``identify_pages``. Markup that is never closed counts as text: of a ``<`` all that follows it, of
a script, style or comment all but the mark that opens it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import flat_bytes, lean, slices
from auditloom.llm._store import drop, save

BUCKETS = 1 << 14
PER_LANGUAGE, WEIGHT, KAPPA, MARGIN, LEAST = 500, 60.0, 20.0, 0.5, 0.5
#: Labels that a model may have: it is then at most 64 MiB.
MOST_LABELS = 1000
#: Share of a label's median typicality that a text must reach to teach the model.
TYPICAL = 1 / 3
#: Bytes of text, and likelihoods, that are worked out together.
SLICE, CELLS = 1 << 19, 1 << 20
#: Second-level labels that registries below two-letter suffixes give names under.
GENERAL = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
_HTML = re.compile(r"<html\b([^>]*)", re.IGNORECASE)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,8})""", re.IGNORECASE)
_TAG = re.compile(r"<[A-Za-z/!?]")


def page_text(source: str) -> tuple[str, str | None]:
    """(visible text, declared primary language) of a page, in one pass."""
    root = _HTML.search(source)
    declared = _LANG.search(root.group(1)) if root else None
    out, at, low = [], 0, source.lower()
    if len(low) != len(source):
        low = source  # some character changes its length in lower case: tag names then count as written
    absent: set[str] = set()

    def past(mark: str, start: int) -> int:
        """The place behind the next ``mark``, 0 if there is none."""
        found = -1 if mark in absent else low.find(mark, start)
        if found < 0:
            absent.add(mark)
        return found + len(mark) if found >= 0 else 0

    while tag := _TAG.search(source, at):
        begin = tag.start()
        out.append(source[at:begin])
        end = 0
        if low.startswith("<!--", begin):
            end = past("-->", begin + 4) or begin + 4
        else:
            for name in ("script", "style"):
                if low.startswith("<" + name, begin) and (inner := past("</" + name, begin + 1)):
                    end = past(">", inner) or inner
        end = end or past(">", begin + 1)
        if not end:
            out.append(source[begin:])
            at = len(source)
            break
        at = end
    out.append(source[at:])
    return html.unescape(" ".join(out)), declared.group(1).lower() if declared else None


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, its text); ASCII letters in lower case, other ASCII as spaces, trigrams of one text only."""
    lower = np.arange(256, dtype=np.uint32)
    lower[:128] = 32
    lower[65:91] = lower[97:123] = np.arange(97, 123)
    x = lower[data]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    blank = code == 0x202020
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[:-2] == text[2:]) & ~blank
    return bucket[inside], text[:-2][inside]


class TextModel:
    """Log likelihood of trigram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)

    def mean_log(self, texts: pa.Array) -> np.ndarray:
        """Mean log likelihood of each text (rows) by language (columns), over a uniform choice; -inf for no trigrams."""
        data, offsets = flat_bytes(texts)
        bucket, text = trigrams(data, offsets)
        n = np.bincount(text, minlength=len(texts))
        sums = np.stack([np.bincount(text, row[bucket], len(texts)) for row in self.log], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n[:, None] > 0, sums / n[:, None] + np.log(BUCKETS), -np.inf)


def _bucket_counts(sample: DataFrame, names: list[str], presence: bool) -> np.ndarray:
    """Trigrams, or with ``presence`` texts that hold them, of each label (rows) by bucket; at most labels * BUCKETS rows come to the driver."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                labels = np.array(batch.column(0).to_pylist())
                bucket, text = trigrams(*flat_bytes(batch.column(1)))
                if presence:
                    bucket, text = (x.astype(np.int64) for x in np.divmod(np.unique(bucket * batch.num_rows + text), batch.num_rows))
                for label in np.unique(labels).tolist():
                    n = np.bincount(bucket[(labels == label)[text]], minlength=BUCKETS)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["l", "b", "n"])

    counts = np.zeros((len(names), BUCKETS))
    found = sample.select("l", "t").mapInArrow(count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    place = {l: i for i, l in enumerate(names)}
    counts[[place[l] for l in found.column("l").to_pylist()], found.column("b").to_numpy()] = found.column("n").to_numpy()
    return counts


def _typicality(sample: DataFrame, names: list[str]) -> DataFrame:
    """(l, h, share): how typical of its label each text is, null without trigrams; a label's only text is."""
    sizes = dict(map(tuple, sample.groupBy("l").count().collect()))  # one row a label
    held = _bucket_counts(sample, names, True)
    place = {l: i for i, l in enumerate(names)}

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                labels = batch.column(0).to_pylist()
                bucket, text = trigrams(*flat_bytes(batch.column(2)))
                row, others = np.array([place[l] for l in labels]), np.array([max(1, sizes[l] - 1) for l in labels])
                sums = np.bincount(text, (held[row[text], bucket] - 1) / others[text], len(labels))
                n = np.bincount(text, minlength=len(labels))
                share = np.where(np.array([sizes[l] for l in labels]) == 1, 1.0, sums / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, mask=n == 0)], names=["l", "h", "share"])

    return sample.select("l", "h", "t").mapInArrow(score, "l string, h long, share double")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, typical: float = TYPICAL) -> TextModel | None:
    """A text model of the typical ones among a bounded sample, about ``per_language`` texts of each label; equal texts count once."""
    rows = labelled.select(F.lower(F.col(label_col)).alias("l"), F.col(text_col).cast("string").alias("t")).filter("l IS NOT NULL AND t IS NOT NULL AND t != ''")
    rows = rows.withColumn("h", F.xxhash64("t"))
    low = F.col("h").bitwiseAND(0xFFFFFFFF)
    sizes = rows.groupBy("l").agg(F.count_distinct("h").alias("texts"), F.min(low).alias("least"))
    names = sorted(r.l for r in sizes.select("l").limit(MOST_LABELS + 1).collect())  # one row a label
    if not names:
        return None
    if len(names) > MOST_LABELS:
        raise ValueError(f"{len(names)} labels, more than {MOST_LABELS}: the model takes 64 KiB a label in the driver and in every task")
    # Of different texts, not rows: a label of mostly copies would get few texts or none.
    limit = sizes.select("l", F.greatest(F.col("least"), (float(1 << 32) * per_language / F.col("texts")).cast("long")).alias("limit"))
    # One row a label, next to 64 KiB a label of the model, which every task gets.
    sample = save(rows.join(F.broadcast(limit), "l").filter(low <= F.col("limit")).groupBy("l", "h").agg(F.any_value("t").alias("t")), "sample")
    scored = save(_typicality(sample, names), "typical")
    teach = scored.join(scored.groupBy("l").agg(F.median("share").alias("middle")), "l").filter(F.col("share") >= typical * F.col("middle")).select("l", "h")
    model = TextModel(names, _bucket_counts(sample.join(teach, ["l", "h"]), names, False))
    drop(sample, scored)
    return model


def host_levels(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain, address suffix) of a URL; empty strings where there are none."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return levels_of(host)


def levels_of(host: Column) -> tuple[Column, Column, Column]:
    general = host.rlike(rf"\.({'|'.join(GENERAL)})\.[a-z][a-z]$")
    return host, F.when(general, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)), F.substring_index(host, ".", -1)


Extract = Callable[[pa.RecordBatch], tuple[pa.Array, list[str | None] | None]]


def _parts(batch: pa.RecordBatch, text: str | pa.Array, languages: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded text and likelihoods."""
    most = max(1, CELLS // languages)
    for part in slices(batch, text, SLICE):
        for start in range(0, part.num_rows, most):
            yield part.slice(start, most)


def _scored(rows: DataFrame, model: TextModel, extract: Extract, kept: str, columns: list[str]) -> DataFrame:
    """``columns`` of rows plus ll (mean log likelihood by language) and declared."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, "t", len(model.languages)):
                texts, declared = extract(batch)
                ll = model.mean_log(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32)), pa.array(ll.ravel()))
                said = declared if declared is not None else batch.column(batch.schema.get_field_index("declared")).to_pylist()
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), lists, pa.array(said, pa.string())], names=[*columns, "ll", "said"])

    return rows.mapInArrow(run, f"{kept}, ll array<double>, said string")


class Fusion:
    """What all pages together say, small enough to be sent along: evidence of declared languages, and the corpus prior."""

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray], kappa: float):
        self.languages, self.kappa = languages, kappa
        whole = sum(counts.values(), np.zeros(len(languages)))
        kinds = [*languages, "none", "other"]
        share = np.array([counts.get(s, np.zeros(len(languages))).sum() + 1 for s in kinds])
        share = share / share.sum()
        self.row = {s: i for i, s in enumerate(kinds)}
        self.said = np.log(np.array([(counts.get(s, np.zeros(len(languages))) + kappa * share[i]) / (whole + kappa) for s, i in self.row.items()]))
        self.prior = (whole + 1) / (whole.sum() + len(languages))

    def kinds(self, said: list[str | None]) -> np.ndarray:
        return np.array([self.row["none"] if s is None else self.row.get(s, self.row["other"]) for s in said], np.int64)

    def posterior(self, ll: np.ndarray, said: list[str | None], levels: list[np.ndarray], own: np.ndarray, weight: float) -> np.ndarray:
        """Rows of probabilities by language. levels: counts of suffix, domain and host; a judged page's own count is taken out."""
        prior = np.broadcast_to(self.prior, ll.shape)
        mine = np.zeros(ll.shape)
        judged = np.flatnonzero(own >= 0)
        mine[judged, own[judged]] = 1
        for n in levels:
            n = np.maximum(n - mine, 0)
            prior = (n + self.kappa * prior) / (n.sum(axis=1, keepdims=True) + self.kappa)
        joint = np.maximum(ll, -1e6) * weight + self.said[self.kinds(said)] + np.log(prior)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        return joint / joint.sum(axis=1, keepdims=True)


def _own(ll: np.ndarray, margin: float) -> np.ndarray:
    """The language that the text alone speaks for, -1 if none explains it."""
    return np.where(ll.max(axis=1) > margin, ll.argmax(axis=1), -1)


LEVELS = ("host", "domain", "suffix")


def _corpus(evidence: DataFrame, model: TextModel, kappa: float, margin: float) -> tuple[Fusion, DataFrame]:
    """Grouped aggregation of what texts speak for: the fusion's tables, and (host, domain, suffix, counts of each by language)."""
    own = F.when(F.array_max("ll") > margin, F.array_position(F.col("ll"), F.array_max("ll")).cast("int") - 1)
    known = F.when(F.col("said").isNull(), "none").when(F.col("said").isin(*model.languages), F.col("said")).otherwise("other")
    judged = evidence.select(*LEVELS, known.alias("said"), own.alias("own")).filter(F.col("own").isNotNull())
    grouped = save(judged.groupBy(*LEVELS, "said", "own").agg(F.count("*").alias("n")), "hosts")
    said: dict[str, np.ndarray] = {}
    for r in grouped.groupBy("said", "own").agg(F.sum("n").alias("n")).collect():  # at most (languages + 2) * languages rows
        said.setdefault(r.said, np.zeros(len(model.languages)))[r.own] = r.n

    def packed(by: list[str], name: str) -> DataFrame:
        """The counts of a group, at most one for each language."""
        return grouped.groupBy(*by, "own").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("own", "n")).alias(name))

    priors = packed([*LEVELS], "host_n").join(packed(["domain", "suffix"], "domain_n"), ["domain", "suffix"]).join(packed(["suffix"], "suffix_n"), "suffix")
    priors = save(priors, "priors")
    drop(grouped)
    return Fusion(model.languages, said, kappa), priors


def _dense(column: pa.Array, k: int) -> np.ndarray:
    """Rows of counts by language from lists of (own, n); null lists are zeros."""
    out = np.zeros((len(column), k))
    flat = column.flatten()
    out[np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0))), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
    return out


def _decide(scored: DataFrame, priors: DataFrame, fusion: Fusion, kept: list[str], weight: float, margin: float, least: float) -> DataFrame:
    """``kept`` columns of scored with language, confidence, text_language and declared."""
    names = fusion.languages
    joined = scored.join(priors, list(LEVELS), "left").select(*kept, "ll", "said", "suffix_n", "domain_n", "host_n")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = len(kept), max(1, CELLS // len(names))
        for batch in (whole.slice(start, most) for whole in batches for start in range(0, whole.num_rows, most)):
            ll, said = batch.column(n).flatten().to_numpy().reshape(-1, len(names)), batch.column(n + 1).to_pylist()
            own = _own(ll, margin)
            p = fusion.posterior(ll, said, [_dense(batch.column(n + 2 + i), len(names)) for i in range(3)], own, weight)
            best, at = p.max(axis=1), p.argmax(axis=1)
            fine = (own >= 0) & (best >= least)
            verdict = [pa.array([names[i] if ok else None for i, ok in zip(at.tolist(), fine.tolist(), strict=True)], pa.string()), pa.array([c if o >= 0 else None for c, o in zip(best.tolist(), own.tolist(), strict=True)], pa.float64()), pa.array([names[o] if o >= 0 else None for o in own.tolist()], pa.string()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *verdict], names=[*kept, "language", "confidence", "text_language", "declared"])

    schema = ", ".join(f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in kept)
    return joined.mapInArrow(run, schema + ", language string, confidence double, text_language string, declared string")


def identify_pages(pages: DataFrame, model: TextModel | None, weight: float = WEIGHT, kappa: float = KAPPA, margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """(page_id, language, confidence, text_language, declared, host): a row a page."""
    host, domain, suffix = host_levels(F.col("url"))
    kept = ["page_id", "host", "domain", "suffix"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col("html").cast("string").alias("t"))
    model = model or TextModel(["und"], np.zeros((1, BUCKETS)))

    def extract(batch: pa.RecordBatch) -> tuple[pa.Array, list[str | None]]:
        read = [page_text(x or "") for x in batch.column(4).to_pylist()]
        return pa.array([t for t, _ in read], pa.string()), [d for _, d in read]

    scored = save(_scored(rows, model, extract, "page_id long, host string, domain string, suffix string", kept), "evidence")
    fusion, priors = _corpus(scored, model, kappa, margin)
    return _decide(scored, priors, fusion, ["page_id", "host"], weight, margin, least).select("page_id", "language", "confidence", "text_language", "declared", "host")


def filter_documents(docs: DataFrame, model: TextModel | None, text_col: str = "text", declared_col: str | None = "lang", host_col: str = "source", weight: float = WEIGHT, kappa: float = KAPPA, margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose language is rejected; ``host_col`` stands for the host.

    ``declared_col`` stands for the markup language. It must be no label that the model was fitted to; None says that nothing is declared.
    """
    if model is None:
        return docs
    host = F.lower(F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    levels = [c.alias(name) for c, name in zip(levels_of(host), LEVELS, strict=True)]
    columns = docs.columns

    def extract(batch: pa.RecordBatch) -> tuple[pa.Array, None]:
        return batch.column(batch.schema.get_field_index("t")).fill_null(""), None

    said = (F.lower(F.col(declared_col).cast("string")) if declared_col else F.lit(None).cast("string")).alias("declared")
    evidence = _scored(docs.select(*levels, said, F.col(text_col).cast("string").alias("t")), model, extract, "host string, domain string, suffix string", list(LEVELS))
    fusion, priors = _corpus(evidence, model, kappa, margin)
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    joined = docs.select(row, *levels, said).join(priors, list(LEVELS), "left").select("row", "declared", "suffix_n", "domain_n", "host_n")
    at = columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores and judges in one pass, so that a task has one Python worker."""
        for whole in batches:
            for batch in _parts(whole, whole.column(0).field(at), len(model.languages)):
                row = batch.column(0)
                ll = model.mean_log(row.field(at).cast(pa.string()).fill_null(""))
                own = _own(ll, margin)
                p = fusion.posterior(ll, batch.column(1).to_pylist(), [_dense(batch.column(2 + i), len(model.languages)) for i in range(3)], own, weight)
                fine = pa.array((own >= 0) & (p.max(axis=1) >= least))
                yield pa.RecordBatch.from_arrays([row.field(i).filter(fine) for i in range(len(columns))], names=columns)

    return joined.mapInArrow(run, docs.schema)
