"""Language identification by interpolated Kneser-Ney character models (operator 6).

Texts are lower-cased, runs of non-letters become one space, and characters beyond the BMP are
folded into its private area, so that a 4-gram of characters is one 64-bit number.  4-grams
of all learning rows are counted per language inside tasks, summed by Spark, and turned into
one model per language: sorted arrays of n-gram hashes for the orders 4 to 1, with the
interpolated Kneser-Ney probability of each n-gram and the back-off weight of each context.

A text's language is the one with the lowest cross-entropy per character.  Softmax over the
negative cross-entropies, with a temperature fitted on all learning rows, gives the
confidence; ``rejected`` marks texts whose cross-entropy exceeds what all but
``reject_share`` of the learning rows have in their own language (to a ``BINS``-th of a bit).

No n-gram is left out.  Models of up to ``broadcast_entries`` summed (language, 4-gram) rows are
broadcast; larger ones stay Spark tables partitioned and sorted by n-gram (``TableModels``), built by
grouping and joined with the counted n-grams of the texts.  Costs are whole numbers of 2^-24 bit, so
sums do not depend on their order and both ways give the same result.

Null texts and texts without a letter are ``und`` with score 0.  Rows with a null language or
null text are not learned from; with no learning row at all every text is ``und``.  Ties
go to the language that sorts first.  Rows that repeat an id give a row each; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, held_out, slices, stored

ORDER = 4
UND = "und"
UNSEEN = 1.0 / 65536
SCALE = 1 << 24
BINS = 4096
_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Code point -> 16-bit symbol of letters, 0x20 for everything else (built once per process)."""
    if not _TABLE:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        folded = np.where(points < 0x10000, points, 0xE000 + points % 0x1900)
        _TABLE.append(np.where(letter, folded, 0x20).astype(np.uint16))
    return _TABLE[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams of all texts as uint64, number per text).

    A text reads as its words between single spaces: each letter and each word's closing space is
    the end of one gram, and what would reach back before the text is spaces."""
    joined = "".join((t or "").lower().replace("\0", " ") + "\0" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _classes()[points]
    space = symbols == 0x20
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    s = symbols[keep].astype(np.uint64)
    n = len(s)
    # text i holds the kept symbols bounds[i] to bounds[i + 1], the last of them its closing space
    bounds = np.concatenate(([0], np.cumsum(keep)[points == 0]))
    padded = np.concatenate((np.full(ORDER - 1, 0x20, np.uint64), s))
    g = padded[:n].copy()
    for i in range(1, ORDER):
        g = g << np.uint64(16) | padded[i:n + i]
    for back in range(ORDER - 1):  # the first grams of a text see spaces, not the text before
        at = bounds[:-1] + back
        at = at[at < bounds[1:]]
        blank = sum(0x20 << 16 * i for i in range(back + 1, ORDER))
        g[at] = (g[at] & np.uint64((1 << 16 * (back + 1)) - 1)) | np.uint64(blank)
    good = g != np.uint64(0x0020002000200020)  # a text's leading space
    counts = np.diff(np.concatenate(([0], np.cumsum(good)))[bounds])
    return g[good], counts


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``rows(lang, text)``: counted per slice, then summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            langs = part.column(0).to_numpy(zero_copy_only=False)
            texts = part.column(1).to_pylist()
            for lang in pd.unique(langs):
                g, _ = grams([t for t, own in zip(texts, langs) if own == lang])
                if len(g):
                    keys, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                                                      pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


class KneserNey:
    """Interpolated Kneser-Ney model of one language in sorted arrays, one per order.

    Order n holds the discounted probability of each n-gram and the weight its context passes on to the
    next lower order; lower orders count different left neighbours instead of occurrences."""

    def __init__(self, grams4: np.ndarray, counts: np.ndarray):
        self.orders = []
        keys, n = grams4, counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            sort = np.argsort(keys)
            keys, n = keys[sort], n[sort]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, first = np.unique(keys >> np.uint64(16), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            kinds = np.diff(np.append(first, len(n)))
            share = np.maximum(n - d, 0) / np.repeat(total, kinds)
            self.orders.append((keys, share.astype(np.float32), context, (d * kinds / np.maximum(total, 1)).astype(np.float32)))
            lower = keys & np.uint64((1 << 16 * (order - 1)) - 1)
            keys, n = np.unique(lower, return_counts=True)
            n = n.astype(np.float64)

    def probability(self, asked: np.ndarray) -> np.ndarray:
        """Probability of each 4-gram's last character after the others."""
        p = np.full(len(asked), UNSEEN)
        for order, (keys, share, context, weight) in zip(range(1, ORDER + 1), reversed(self.orders)):
            g = asked & np.uint64((1 << 16 * order) - 1)
            p = _lookup(keys, share, g, 0.0) + _lookup(context, weight, g >> np.uint64(16), 1.0) * p
        return p

    def bits(self, asked: np.ndarray) -> np.ndarray:
        """-log2 of ``probability``."""
        return _costs(self.probability(asked)) / SCALE


def _costs(p: np.ndarray) -> np.ndarray:
    """-log2 of probabilities in whole numbers of 1 / SCALE bit."""
    return np.rint(-np.log2(np.maximum(p, 1e-12)) * SCALE).astype(np.int32)


def _per_character(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits per character of summed costs (texts x languages); 0 for texts without a letter."""
    return sums / (np.maximum(counts, 1) * float(SCALE))[:, None]


class Decision:
    """How cross-entropies become a language, a confidence and a rejection."""

    def __init__(self, langs: list[str], sharpness: float = 20.0, limits: dict[str, float] | None = None):
        self.langs, self.sharpness, self.limits = langs, sharpness, limits or {}

    def decide(self, h: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, confidence, rejected)."""
        if not self.langs or not len(h):
            return [UND] * len(h), np.zeros(len(h)), np.ones(len(h), bool)
        best = h.argmin(1)
        lowest = h[np.arange(len(h)), best]
        score = 1.0 / np.exp(-self.sharpness * (h - lowest[:, None])).sum(1)
        has = counts > 0
        limit = np.array([self.limits.get(x, np.inf) for x in self.langs])[best]
        return [self.langs[b] if ok else UND for b, ok in zip(best, has)], np.where(has, score, 0.0), ~has | (lowest > limit)

    def calibrate(self, measured: DataFrame, reject_share: float) -> None:
        """Temperature and limits from ``measured(lang, n, h)``: cross-entropies of rows of known languages.

        Tasks add up the loss at each temperature and count the rows per language and ``BINS``-th of a bit (rounded up),
        so the driver sees a histogram, whatever the number of rows."""
        place, steps = {x: i for i, x in enumerate(self.langs)}, [0.5 * 1.5 ** i for i in range(16)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            losses, bins = np.zeros(len(steps)), Counter()
            for part in batches:
                part = part.filter(pc.greater(part.column(1), 0))
                if not part.num_rows:
                    continue
                own = np.array([place[x] for x in part.column(0).to_pylist()])
                h = part.column(2).flatten().to_numpy().reshape(-1, len(place))
                gap, each = h - h.min(1, keepdims=True), np.arange(len(own))
                for i, t in enumerate(steps):
                    losses[i] += float((np.log(np.exp(-t * gap).sum(1)) + t * gap[each, own]).sum())
                bins.update(zip(own.tolist(), np.ceil(h[each, own] * BINS).astype(np.int64).tolist()))
            if bins:
                rows = [(-1, i, x) for i, x in enumerate(losses.tolist())] + [(lang, b, float(n)) for (lang, b), n in bins.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.float64()))],
                                                 names=["lang", "bin", "value"])

        found = measured.select("lang", "n", "h").mapInArrow(run, "lang int, bin long, value double").groupBy("lang", "bin").agg(
            F.sum("value").alias("value")).toPandas().sort_values(["lang", "bin"])
        if not len(found):
            return
        loss = found[found["lang"] == -1]["value"].to_numpy()
        self.sharpness = min(zip(loss, steps))[1]
        for i, mine in found[found["lang"] >= 0].groupby("lang"):
            upto = mine["value"].to_numpy().cumsum()
            at = (upto[-1] - 1) * (1 - reject_share)
            low, high = (mine["bin"].to_numpy()[np.searchsorted(upto, x, side="right")] / BINS for x in (np.floor(at), np.ceil(at)))
            self.limits[self.langs[i]] = float((low + (high - low) * (at - np.floor(at))) * 1.05)


class LanguageModels(Decision):
    """Models in memory, one per language."""

    def __init__(self, models: dict[str, KneserNey], sharpness: float = 20.0, limits: dict[str, float] | None = None):
        super().__init__(sorted(models), sharpness, limits)
        self.models = [models[x] for x in self.langs]
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.cost = np.zeros((0, len(self.langs)), np.int32)

    def __getstate__(self):
        return {"langs": self.langs, "models": self.models, "sharpness": self.sharpness, "limits": self.limits}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character, texts x languages; characters scored)."""
        g, counts = grams(texts)
        codes, unique = pd.factorize(g)
        new = unique[~np.isin(unique, self.seen)]
        if len(new):
            if len(self.seen) > 1_000_000:
                self._forget()
                new = unique
            cost = np.stack([_costs(m.probability(new)) for m in self.models], axis=1)
            keys = np.concatenate((self.seen, new))
            sort = np.argsort(keys)
            self.seen, self.cost = keys[sort], np.concatenate((self.cost, cost))[sort]
        table = self.cost[np.searchsorted(self.seen, unique)]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        has = counts > 0
        starts = (np.cumsum(counts) - counts)[has]
        for i in range(len(self.langs)):
            if len(starts):
                out[has, i] = np.add.reduceat(table[codes, i].astype(np.int64), starts)
        return _per_character(out, counts), counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, confidence, rejected)."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        return self.decide(*self.cross_entropy(texts))

    def measured(self, rows: DataFrame) -> DataFrame:
        """(lang, n, h) of ``rows(lang, text)``: characters scored and bits per character in each language."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for part in slices(batches, 1):
                h, n = shared.value.cross_entropy(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], names=["lang", "n", "h"])

        return rows.select("lang", "text").mapInArrow(run, "lang string, n long, h array<double>")


def _low(gram: str, order: int) -> Column:
    """The last ``order`` characters of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1).cast("long"))


class TableModels(Decision):
    """The models of ``KneserNey`` as tables, for any number of n-grams.

    For each order from 1 to 4 one table of gram -> {language: discounted probability} and one of
    context -> {language: back-off weight}, both partitioned and sorted by their key."""

    def __init__(self, counts: DataFrame, langs: list[str]):
        super().__init__(langs)
        self.tables: list[tuple[DataFrame, DataFrame]] = []
        level = counts.select((F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int").alias("lang"), "gram", "n")
        for order in range(ORDER, 0, -1):
            once, twice = (F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2))
            d = [0.5] * len(langs)
            for r in level.groupBy("lang").agg(once, twice).collect():  # a row per language
                if r["n1"] and r["n2"]:
                    d[r["lang"]] = r["n1"] / (r["n1"] + 2 * r["n2"])
            discount = F.get(F.lit(d), F.col("lang"))
            at = level.withColumn("context", F.shiftrightunsigned("gram", 16))
            contexts = at.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).alias("kinds"))
            share = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
            weight = discount * F.col("kinds") / F.greatest(F.col("total"), F.lit(1.0))
            self.tables.insert(0, (
                self._keyed(at.join(contexts, ["lang", "context"]).select("gram", "lang", share.cast("float").alias("share")), "share"),
                self._keyed(contexts.select(F.col("context").alias("gram"), "lang", weight.cast("float").alias("weight")), "weight")))
            if order > 1:
                level = stored(level.select("lang", _low("gram", order - 1).alias("gram")).groupBy("lang", "gram").agg(
                    F.count(F.lit(1)).alias("n")), "langid-lower")

    @staticmethod
    def _keyed(values: DataFrame, name: str) -> DataFrame:
        by_lang = F.map_from_entries(F.collect_list(F.struct("lang", name)))
        return stored(values.groupBy("gram").agg(by_lang.alias(name)).repartition("gram").sortWithinPartitions("gram"), f"langid-{name}")

    def costs(self, asked: DataFrame) -> DataFrame:
        """(gram, cost per language) of the distinct 4-grams ``asked(gram)``."""
        levels = [asked]
        for order in range(ORDER - 1, 0, -1):
            levels.insert(0, levels[0].select(_low("gram", order).alias("gram")).distinct())
        p = levels[0].select("gram", F.array_repeat(F.lit(UNSEEN), len(self.langs)).alias("p"))
        for order, (shares, weights) in enumerate(self.tables, 1):
            if order > 1:
                p = levels[order - 1].withColumn("low", _low("gram", order - 1)).join(p.withColumnRenamed("gram", "low"), "low").drop("low")
            p = (p.withColumn("context", F.shiftrightunsigned("gram", 16))
                 .join(weights.withColumnRenamed("gram", "context"), "context", "left").join(shares, "gram", "left")
                 .select("gram", F.transform("p", lambda q, i: F.coalesce(F.element_at("share", i).cast("double"), F.lit(0.0))
                                             + F.coalesce(F.element_at("weight", i).cast("double"), F.lit(1.0)) * q).alias("p")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cost = pa.array(_costs(batch.column(1).flatten().to_numpy(zero_copy_only=False)))
                width = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (len(cost) // max(batch.num_rows, 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(width, cost)], names=["gram", "cost"])

        return p.mapInArrow(run, "gram long, cost array<int>")

    def sums(self, rows: DataFrame) -> DataFrame:
        """(row, n, sums) of the ``rows(row, text)`` with a letter: characters and summed cost per language."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 1):
                g, counts = grams(part.column(1).to_pylist())
                owner = np.repeat(part.column(0).to_numpy(), counts)
                sort = np.lexsort((g, owner))
                g, owner = g[sort], owner[sort]
                first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])))) if len(g) else sort
                n = np.diff(np.append(first, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(owner[first], pa.int64()), pa.array(g[first].view(np.int64)), pa.array(n, pa.int64())],
                                                 names=["row", "gram", "n"])

        pairs = rows.select("row", "text").mapInArrow(run, "row long, gram long, n long")
        cost = stored(self.costs(stored(pairs.select("gram").distinct(), "langid-asked")), "langid-costs")
        summed = [F.sum(F.col("n") * F.get("cost", F.lit(i))).alias(f"s{i}") for i in range(len(self.langs))]
        return pairs.join(cost, "gram").groupBy("row").agg(F.sum("n").alias("n"), *summed).select(
            "row", "n", F.array(*[f"s{i}" for i in range(len(self.langs))]).alias("sums"))

    def measured(self, rows: DataFrame) -> DataFrame:
        """As ``LanguageModels.measured``, without the rows that hold no letter."""
        rows = stored(rows.select("lang", "text").withColumn("row", F.monotonically_increasing_id()), "langid-sample")
        h = F.transform("sums", lambda s: s / (F.col("n") * F.lit(float(SCALE))))
        return rows.select("row", "lang").join(self.sums(rows), "row").select("lang", "n", h.alias("h"))


def fit(rows: DataFrame, broadcast_entries: int = 4_000_000, reject_share: float = 0.001) -> LanguageModels | TableModels:
    """Models, temperature and limits from all ``rows(id, lang, text)``; ``broadcast_entries`` bounds the models that are
    held in memory."""
    counts = stored(count_grams(rows), "langid-counts")
    if counts.count() > broadcast_entries:
        model = TableModels(counts, sorted(r["lang"] for r in counts.select("lang").distinct().collect()))
    else:
        model = LanguageModels({lang: KneserNey(part["gram"].to_numpy().view(np.uint64), part["n"].to_numpy())
                                for lang, part in counts.toPandas().groupby("lang", sort=True)})
    if not model.langs:
        return model
    model.calibrate(model.measured(rows), reject_share)
    return model


def predict(docs: DataFrame, model: LanguageModels | TableModels, id_col: str, text_col: str, more: dict[str, Column] | None = None) -> DataFrame:
    """id, (more), lang_pred, score, rejected per row; one narrow pass if the model is in memory."""
    def out(part: pa.RecordBatch, found: tuple, gone: set[str]) -> pa.RecordBatch:
        keep = [i for i, name in enumerate(part.schema.names) if name not in gone]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *[pa.array(x, t) for x, t in zip(found, kinds)]],
                                          names=[*[part.schema.names[i] for i in keep], "lang_pred", "score", "rejected"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"),
                       *[c.alias(n) for n, c in (more or {}).items()])
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])
    if isinstance(model, TableModels):
        row, n, sums = (fresh(rows.columns, x) for x in ("row", "n", "sums"))
        rows = stored(rows.withColumn(row, F.monotonically_increasing_id()), "langid-rows")
        found = model.sums(rows.select(F.col(row).alias("row"), "text")).toDF(row, n, sums)
        decision, width = Decision(model.langs, model.sharpness, model.limits), len(model.langs)
        none = F.array_repeat(F.lit(0).cast("long"), width)
        rows = rows.drop("text").join(found, row, "left").withColumns({n: F.coalesce(n, F.lit(0)), sums: F.coalesce(sums, none)})

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                counts = part.column(n).to_numpy()
                total = part.column(sums).flatten().to_numpy().reshape(-1, width)
                yield out(part, decision.decide(_per_character(total, counts), counts), {row, n, sums})

        return rows.mapInArrow(finish, schema).withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield out(part, shared.value.predict(part.column(1).to_pylist()), {"text"})

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row:
    id, held_out, lang_pred, score, rejected."""
    out = held_out(id_col)
    learn = docs.filter(~out & col(lang_col).isNotNull() & col(text_col).isNotNull()).select(
        col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    return predict(docs, fit(learn, **options), id_col, text_col, {"held_out": out})
