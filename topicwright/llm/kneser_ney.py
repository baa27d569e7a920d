"""Quality classifier: an interpolated modified Kneser-Ney model of ORDER characters, a threshold on perplexity for each language.

Characters are UTF-16 units, so an n-gram of four is one long: its suffix and
its context are bit operations, and all counting and scoring of n-grams is joins
and sums on longs. A text begins with ORDER - 1 marks. Below the single units
lies an equal share for every unit that the corpus has in the language.

Training text is the trusted rows' (quality 1, not toxic): at most `most` ids,
those with the smallest hash, is the classifier's bounded sample; a fifth of all
ids, by hash, is never in it. One pass over the corpus gives each group of rows
its distinct n-grams with their counts in training text. From these follow,
language by language, counts and continuation counts of each order, their
discounts D1, D2, D3+, context sums and back-off weights, and by joins on
(language, n-gram), sharded by it, the log probability of every distinct n-gram
of the corpus. The scores that a group needs are joined to its n-grams and
written as a file of the shared folder, and a second pass over the documents,
where they lie, adds them up. So no text is shuffled, no table of n-grams is
broadcast or collected, and what is gathered grows with the corpus; only the
names and thresholds of the bounded sample's languages reach the driver.

Groups are what a row says of itself (see common.located): they don't depend on
file splits, cores or executors. A score file or a score that isn't there is an
error, never a verdict.

A document is rejected if its perplexity is over `margin` times the quantile, in
its language, of all trusted documents outside the training sample. Quantiles
are taken over log perplexities in bins of 1 / BINS (their upper edges).

Defined results: null and empty texts have null perplexity and stay; so do texts
of a language (or null language) without training text, for which there is no
model; where no trusted text is held out there is no threshold and texts stay;
repeated rows are scored each; without labels nothing is rejected.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, begin, bounded_batches, by_bytes, discard, keeps, located, materialise, new_folder

ORDER = 4
#: N-grams that a task keeps before it gives them out.
KEPT = 1 << 21
SLICE_BYTES = 1 << 20
START = 2
#: One of so many trusted ids is never trained on.
HELD_OUT = 5
#: Bins of a unit of log perplexity in the thresholds' histograms.
BINS = 1000
_MASK = {k: (1 << 16 * k) - 1 for k in range(1, ORDER)}


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends at each unit of the texts, number of units of each)."""
    pad = np.full(ORDER - 1, START, np.uint16)
    parts, n = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        units = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16)
        parts += [pad, units]
        n[k] = len(units)
    if not n.sum():
        return np.empty(0, np.uint64), n
    codes = np.concatenate(parts).astype(np.uint64)
    h = codes[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        h |= codes[ORDER - 1 - back : len(codes) - back] << np.uint64(16 * back)
    ends = np.cumsum(n + ORDER - 1)
    real = np.ones(len(codes), bool)
    for back in range(1, ORDER):
        real[(ends - n - back)] = False
    return h[real[ORDER - 1 :]], n


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id) of the trusted rows of the labels, each once."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()


def sample_ids(ids: DataFrame, most: int) -> np.ndarray:
    """At most `most` of the ids that may be trained on, ascending."""
    mine = ids.filter(F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT)) != 0)
    return np.array(sorted(r["id"] for r in mine.orderBy(F.xxhash64("id"), "id").limit(most).collect()), np.int64)


def _is_in(ids: pa.Array, trusted: np.ndarray) -> np.ndarray:
    values = ids.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(trusted, values), max(0, len(trusted) - 1))
    return (trusted[at] == values if len(trusted) else np.zeros(len(values), bool)) & ids.is_valid().to_numpy(zero_copy_only=False)


def _merge(kept: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if kept is None:
        return keys, counts
    both, at = np.unique(np.concatenate([kept[0], keys]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([kept[1], counts]), len(both)).astype(np.int64)


def group_grams(docs: DataFrame, sample: np.ndarray) -> DataFrame:
    """(group, lang, g, n) of rows with group, id, lang and text: the distinct n-grams of each group and their counts in its training rows; a group read in several tasks comes in parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("kneser_ney")
        kept: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for (group, lang), (keys, counts) in kept.items():
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), group)), pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(counts[at : at + 100_000])], ["group", "lang", "g", "n"])
            kept.clear()

        for batch in batches:
            for some in by_bytes(batch, "text", SLICE_BYTES):
                texts, langs, groups = (some.column(c).to_pylist() for c in ("text", "lang", "group"))
                good = _is_in(some.column("id"), sample)
                rows_of: dict[tuple[int, str], list[int]] = defaultdict(list)
                for k, key in enumerate(zip(groups, langs, strict=True)):
                    if key[1] is not None and texts[k]:
                        rows_of[key].append(k)
                for key, rows in rows_of.items():
                    h, n = _grams([texts[k] for k in rows])
                    keys = np.unique(h)
                    counts = np.zeros(len(keys), np.int64)
                    own, many = np.unique(h[np.repeat(good[rows], n)], return_counts=True)
                    counts[np.searchsorted(keys, own)] = many
                    kept[key] = _merge(kept.get(key), keys, counts)
                if sum(len(keys) for keys, _ in kept.values()) > KEPT:
                    yield from give()
        yield from give()

    return docs.mapInArrow(count, "group long, lang string, g long, n long")


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of an order from its counts of counts; where these don't give one, half the count."""
    n = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    table = counts.groupBy("lang").agg(*n).withColumn("y", F.when(F.col("n1") > 0, y))
    d = [F.coalesce(F.when(F.col("y").isNotNull() & (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * F.col("y") * F.col(f"n{k + 1}") / F.col(f"n{k}")))), F.lit(k / 2)).alias(f"d{k}") for k in (1, 2, 3)]
    return table.select("lang", *d)


def gram_scores(grams: DataFrame) -> DataFrame:
    """(lang, g, p): probability of the last unit of every distinct n-gram of (group, lang, g, n), for languages with training text."""
    types = materialise(grams.groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    counts = {ORDER: types.filter("n > 0")}
    wanted = {ORDER: types.join(F.broadcast(types.filter("n > 0").select("lang").distinct()), "lang", "left_semi").select("lang", "g")}  # a row a language of the bounded sample
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit(_MASK[k]))
        counts[k] = materialise(counts[k + 1].select("lang", shorter.alias("g")).groupBy("lang", "g").agg(F.count("*").alias("n")), f"counts-{k}")
        wanted[k] = wanted[k + 1].select("lang", shorter.alias("g")).distinct()
    scored: DataFrame | None = None
    for k in range(1, ORDER + 1):
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        held = counts[k].join(F.broadcast(_discounts(counts[k])), "lang").select("lang", "g", "n", cut.alias("d"), F.shiftrightunsigned("g", 16).alias("context"))
        context = held.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        rows = wanted[k].withColumn("context", F.shiftrightunsigned("g", 16)).join(held.select("lang", "g", "n", "d"), ["lang", "g"], "left")
        if k == 1:  # one context a language: a row each
            units = wanted[1].groupBy("lang").agg((1 / F.count("*")).alias("lower"))
            rows = rows.join(F.broadcast(context), ["lang", "context"], "left").join(F.broadcast(units), "lang")
        else:
            lower = scored.select("lang", F.col("g").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.join(context, ["lang", "context"], "left").withColumn("suffix", F.col("g").bitwiseAND(F.lit(_MASK[k - 1]))).join(lower, ["lang", "suffix"])
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.coalesce(F.col("n") - F.col("d"), F.lit(0.0)) + F.col("freed") * F.col("lower")) / F.col("total"))
        before, scored = scored, materialise(rows.select("lang", "g", p.alias("p")), f"scores-{k}")
        if before is not None:
            discard(before)
    discard(types, *(counts[k] for k in range(1, ORDER)))
    return scored


def write_scores(grams: DataFrame, scores: DataFrame) -> str:
    """Writes, for each group, the log probabilities of its n-grams by language; returns the folder."""
    folder = new_folder(grams.sparkSession, "perplexity")

    def write(part: pa.Table) -> pa.Table:
        group = part.column("group")[0].as_py()
        tables = {}
        langs = part.column("lang").unique().to_pylist()
        for k, lang in enumerate(langs):
            some = part.filter(pc.equal(part.column("lang"), lang))
            keys, first = np.unique(some.column("g").to_numpy().view(np.uint64), return_index=True)
            tables[f"keys{k}"], tables[f"logs{k}"] = keys, np.log(some.column("p").to_numpy()[first])
        out = io.BytesIO()
        np.savez(out, langs=np.array(langs), **tables)
        SharedFiles(folder).write(f"{group}.npz", [out.getvalue()])
        return pa.table({"group": pa.array([group], pa.int64())})

    own = grams.select("group", "lang", "g").join(scores, ["lang", "g"])
    own.groupBy("group").applyInArrow(write, "group long").write.format("noop").mode("overwrite").save()
    return folder


@lru_cache(maxsize=4)
def _scores_of(folder: str, group: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    with np.load(io.BytesIO(SharedFiles(folder).read(f"{group}.npz"))) as f:
        return {str(lang): (f[f"keys{k}"], f[f"logs{k}"]) for k, lang in enumerate(f["langs"])}


def _log_perplexities(folder: str, langs_known: frozenset[str], some: pa.RecordBatch) -> list[float | None]:
    """Of rows with group, lang and text: null for those that no model is for."""
    texts, langs, groups = (some.column(c).to_pylist() for c in ("text", "lang", "group"))
    out: list[float | None] = [None] * len(texts)
    rows_of: dict[tuple[int, str], list[int]] = defaultdict(list)
    for k, key in enumerate(zip(groups, langs, strict=True)):
        if key[1] in langs_known and texts[k]:
            rows_of[key].append(k)
    for (group, lang), rows in sorted(rows_of.items()):
        keys, logs = _scores_of(folder, group)[lang]
        h, n = _grams([texts[k] for k in rows])
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        if not (keys[at] == h).all():
            raise RuntimeError("a row holds another text than when its n-grams were counted")
        before = np.concatenate([[0.0], np.cumsum(logs[at])])
        ends = np.cumsum(n)
        for k, nll, size in zip(rows, (before[ends - n] - before[ends]).tolist(), n.tolist(), strict=True):
            out[k] = nll / size
    return out


def _thresholds(held: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, threshold) from rows (lang, log) of held-out documents, by the quantile of their bins; a task hands on a count a bin."""
    bins = held.select("lang", F.ceil(F.col("log") * BINS).alias("bin"))
    return bins.groupBy("lang").agg((F.exp(F.percentile("bin", F.lit(quantile)) / BINS) * margin).alias("threshold"))


@lru_cache(maxsize=4)
def _rejected(folder: str, group: int) -> np.ndarray:
    return np.frombuffer(SharedFiles(folder).read(f"{group}.bin"), "<i8")


def _forget() -> None:
    _scores_of.cache_clear()
    _rejected.cache_clear()


keeps("kneser_ney", _forget)


class Model:
    """A trained model of a table: verdicts on its rows, and the rows that stay."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float, margin: float, most: int, id_col: str, text_col: str, lang_col: str):
        bounded_batches(docs.sparkSession)
        self.names, self.schema, self.id_col, self.lang_col = docs.columns, docs.schema, id_col, lang_col
        self.docs, self.group, self.row = located(docs, text_col)
        ids = trusted(labels)
        sample = sample_ids(ids, most)
        slim = self.docs.select(F.col(self.group).alias("group"), F.col(self.row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
        grams = materialise(group_grams(slim, sample), "group-grams")
        known = frozenset(r["lang"] for r in grams.filter("n > 0").select("lang").distinct().collect())  # languages of the bounded sample
        scores = gram_scores(grams)
        folder = write_scores(grams, scores)
        discard(grams, scores)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("kneser_ney")
            for batch in batches:
                for some in by_bytes(batch, "text", SLICE_BYTES):
                    trained = pa.array(_is_in(some.column("id"), sample))
                    found = pa.array(_log_perplexities(folder, known, some), pa.float64())
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("group", "row", "id", "lang")), found, trained], ["group", "row", "id", "lang", "log", "trained"])

        scored = materialise(slim.mapInArrow(score, "group long, row long, id long, lang string, log double, trained boolean"), "perplexities")
        held = scored.filter("log is not null and not trained").join(ids, "id", "left_semi").select("lang", "log")
        limits = [(r["lang"], r["threshold"]) for r in _thresholds(held, quantile, margin).collect()]  # languages of the bounded sample
        self.thresholds = dict(limits)
        limit = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, threshold double"))  # the same rows
        perplexity = F.exp("log")
        accepted = F.coalesce(perplexity <= F.col("threshold"), F.lit(True))
        self.judged = scored.join(limit, "lang", "left").select("group", "row", "id", "lang", perplexity.alias("perplexity"), "threshold", accepted.alias("accepted"))

    def verdicts(self) -> DataFrame:
        """(id_col, lang_col, perplexity, threshold, accepted) of each row."""
        return self.judged.drop("group", "row").withColumnsRenamed({"id": self.id_col, "lang": self.lang_col})

    def accepted(self) -> DataFrame:
        """The rows that aren't rejected, with all their columns: each group's rejected places are a file, which the pass over the rows reads."""
        folder, names, group, row = new_folder(self.docs.sparkSession, "rejected"), self.names, self.group, self.row

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, rows in zip(batch.column("group").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                    SharedFiles(folder).write(f"{g}.bin", [np.array(sorted(rows), "<i8").tobytes()])
                yield batch.select(["group"])

        places = self.judged.groupBy("group").agg(F.collect_list(F.when(~F.col("accepted"), F.col("row"))).alias("rows"))  # at most GROUP_ROWS
        places.mapInArrow(write, "group long").write.format("noop").mode("overwrite").save()

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups, rows = batch.column(group).to_numpy(), batch.column(row).to_numpy()
                fine = np.ones(len(rows), bool)
                for g in np.unique(groups).tolist():
                    own = groups == g
                    fine[own] = ~np.isin(rows[own], _rejected(folder, g))
                yield batch.select(names).filter(pa.array(fine))

        return self.docs.mapInArrow(keep, self.schema)


def train(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.08, most: int = 200_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of docs' trusted rows and its verdicts on all of docs; labels: doc_id, quality, toxic."""
    return Model(docs, labels, quantile, margin, most, id_col, text_col, lang_col)
