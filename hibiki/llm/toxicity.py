"""A convolutional text classifier for toxicity, trained in numpy, applied in Arrow batches.

A word is the sum of two hashed embeddings, of the word and of its first letters, so that
inflected forms share what is known of their stem. Filters of several widths slide over the words
of a whole text, each keeps its maximum, and a logistic unit weighs them. Max pooling sends the
gradient to one window per filter only, so a training step touches few embeddings; rows that no
step touched are zero, and unknown words cannot add up to a verdict in a long text.

The classifier is fitted on all labelled rows. They are dealt by a hash into parts of about
``part_bytes`` of text, and each round every part is trained for an epoch in a task of its own, from
the same start; the mean of the parts, for an embedding that of the parts which touched it, starts
the next round. Only the model passes through the driver, whose size the buckets bound. A fifth of
the labelled rows, by the hash, is kept from training: on all of these the thresholds are chosen,
per language where it has enough toxic rows, else overall. The same rows give the same model.

Rows: null and empty texts are scored like a text without known words. Several labels of one key
count as toxic if one is; null labels and keys are not learned from. Without usable labels every
score is 0. Rows that repeat are scored each; columns that are not named are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.llm.common import give_back, prepare, span_hashes, text_bytes, word_spans
from hibiki.session import broadcast_if, bucket_table, new_path

BUCKETS = 1 << 18
STEM_BYTES = 5
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PADS = max(WIDTHS)

#: Text of the rows that one task trains on, about; they are held in memory as numbers.
PART_BYTES = 16 * 1024 * 1024
EPOCHS = 6
#: Buckets the parts lie in, at most; parts of a bucket are trained one after the other.
MAX_BUCKETS = 4096
#: Bytes of a label that is sent to all tasks, about, and of all that may be.
LABEL_BYTES, BROADCAST_BYTES = 32, 64 * 1024 * 1024
#: Words whose responses are held at once in training; a longer text is a piece of its own.
_PIECE = 1 << 17
#: Words scored, or searched for the strongest places, at once; a longer text is taken alone.
_STEP = 1 << 14
#: Values are added up as whole numbers of this fraction, so that their order does not matter.
_UNIT = 2.0 ** -40
#: Toxic rows of a language that its own threshold takes.
OWN_THRESHOLD = 20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of their stems, and the first word of each text (and the end)."""
    data, offsets = text_bytes(column)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    starts, ends, first = word_spans(data, offsets)
    mask = np.uint64(BUCKETS - 1)
    words = span_hashes(data, starts, ends) & mask
    stems = span_hashes(data, starts, np.minimum(ends, starts + STEM_BYTES)) & mask
    return words.astype(np.int32), stems.astype(np.int32), first


def _laid_out(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers with empty places (bucket BUCKETS) behind each text, and where texts begin."""
    texts = len(first) - 1
    begins = first + PADS * np.arange(texts + 1)
    out = np.full(len(ids) + PADS * texts, BUCKETS, np.int32)
    lengths = np.diff(first)
    out[np.arange(len(ids)) + np.repeat(PADS * np.arange(texts), lengths)] = ids
    return out, begins


@dataclass
class Model:
    rows: dict[str, tuple[np.ndarray, np.ndarray]]  # embeddings that training touched
    filters: list[np.ndarray]  # per width: (width, SIZE, FILTERS)
    shifts: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for name in ("words", "stems"):
            at, values = self.rows[name]
            table = np.zeros((BUCKETS + 1, SIZE), np.float32)
            table[at] = values
            out.append(table)
        return out[0], out[1]


def _responses(x: np.ndarray, filters: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
    """What each filter says at each place; -inf where a window would reach into the next text."""
    places, parts = len(x), []
    every = x @ np.concatenate([w.transpose(1, 0, 2).reshape(SIZE, -1) for w in filters], axis=1)
    at = 0
    for w in filters:
        z = every[:, at:at + FILTERS].copy()
        for k in range(1, w.shape[0]):
            z[:places - k] += every[k:, at + k * FILTERS:at + (k + 1) * FILTERS]
        at += w.shape[0] * FILTERS
        parts.append(z)
    z = np.concatenate(parts, axis=1)
    for k in range(1, PADS):
        z[begins[1:] - k] = -np.inf
    return z


def _strongest(x: np.ndarray, filters: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter says most in each text, and what; texts are taken some at a time."""
    at, most, a = [], [], 0
    while a < len(begins) - 1:
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + _STEP, "right")) - 1)
        own = begins[a:b + 1] - begins[a]
        z = _responses(x[begins[a]:begins[b]], filters, own)
        best = np.stack([z[i:j].argmax(axis=0) + i for i, j in zip(own[:-1], own[1:])])
        at.append(best + begins[a])
        most.append(np.take_along_axis(z, best, axis=0))
        a = b
    return np.concatenate(at), np.concatenate(most)


def _score(model: Model, words: np.ndarray, stems: np.ndarray, begins: np.ndarray, tables) -> np.ndarray:
    x = tables[0][words] + tables[1][stems]
    pooled = np.maximum.reduceat(_responses(x, model.filters, begins), begins[:-1], axis=0)
    logits = np.maximum(pooled + model.shifts, 0) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


class _Adam:
    """Adam for dense arrays, and for rows of a table that a step touches."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.steps = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def step(self, gradient: np.ndarray, rows=slice(None)) -> None:
        self.steps += 1
        self.m[rows] = m = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = v = 0.99 * self.v[rows] + 0.01 * gradient * gradient
        m, v = m / (1 - 0.9 ** self.steps), v / (1 - 0.99 ** self.steps)
        self.value[rows] -= (self.rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)


def _used(texts: Sequence[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that texts use, in order, and the place of each; the empty place comes behind them."""
    seen = np.zeros(BUCKETS + 1, bool)
    for text in texts:
        seen[text[k]] = True
    seen[BUCKETS] = False
    at, place = np.flatnonzero(seen), np.full(BUCKETS + 1, -1, np.int32)
    place[at] = np.arange(len(at))
    place[BUCKETS] = len(at)
    return at, place


def _drawn(rng: np.random.Generator, at: np.ndarray) -> np.ndarray:
    """The rows ``at`` of a table of random embeddings, and a row of zeros; drawn some at a time."""
    table, step = np.zeros((len(at) + 1, SIZE), np.float32), 1 << 12
    for start in range(0, BUCKETS + 1, step):
        drawn = rng.normal(0, 0.05, (min(step, BUCKETS + 1 - start), SIZE)).astype(np.float32)
        a, b = np.searchsorted(at, [start, start + step])
        table[a:b] = drawn[at[a:b] - start]
    return table


def train(
    texts: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
    batch: int = 32, seed: int = 7, start: Model | None = None, turn: tuple[int, ...] = (),
) -> Model:
    """Fit a model to texts given as (word buckets, stem buckets), from a model if one is given.

    ``turn`` varies the order of the texts. The model holds the embeddings touched here. Only those
    that the texts use are held meanwhile.
    """
    rng = np.random.default_rng(seed)
    names = ("words", "stems")
    used = {n: _used(texts, k) for k, n in enumerate(names)}
    tables = {n: _Adam(_drawn(rng, used[n][0]), 0.02) for n in names}
    touched = {n: np.zeros(len(used[n][0]), bool) for n in names}
    total = FILTERS * len(WIDTHS)
    filters = [_Adam(rng.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32), 0.01) for w in WIDTHS]
    shifts = _Adam(np.zeros(total, np.float32), 0.01)
    weights = _Adam(np.abs(rng.normal(0.3, 0.1, total)).astype(np.float32), 0.01)
    bias = _Adam(np.full(1, -2, np.float32), 0.01)
    if start is not None:
        for n in names:
            at, values = start.rows[n]
            place = used[n][1][at]
            tables[n].value[place[place >= 0]] = values[place >= 0]
        dense = [*start.filters, start.shifts, start.weights, np.array([start.bias], np.float32)]
        for own, value in zip([*filters, shifts, weights, bias], dense):
            own.value[...] = value
    if turn:
        rng = np.random.default_rng([seed, *turn])
    lengths = np.array([len(t[0]) for t in texts])
    # Texts of similar length share a batch, batches come in random order.
    for _ in range(epochs):
        order = np.argsort(lengths + rng.normal(0, 50, len(texts)), kind="stable")
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            changes, spots, pushes = [], {n: [] for n in names}, []
            for chosen in _pieces(groups[g], lengths):
                first = np.concatenate([[0], np.cumsum(lengths[chosen])])
                laid = [_laid_out(np.concatenate([texts[i][k] for i in chosen]), first) for k in (0, 1)]
                ids, begins = {n: used[n][1][laid[k][0]] for k, n in enumerate(names)}, laid[0][1]
                x = tables["words"].value[ids["words"]] + tables["stems"].value[ids["stems"]]
                at, most = _strongest(x, [f.value for f in filters], begins)  # text, filter
                pooled = most + shifts.value
                hidden = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ weights.value + bias.value[0], -30, 30)))
                delta = ((p - labels[chosen]) / len(groups[g])).astype(np.float32)
                back = delta[:, None] * weights.value * (pooled > 0)
                change = [np.zeros_like(f.value) for f in filters]
                for k, (w, f) in enumerate(zip(WIDTHS, filters)):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    for o in range(w):
                        place = at[:, own] + o
                        change[k][o] = np.einsum("tf,tfs->sf", back[:, own], x[place])
                        pushes.append((back[:, own, None] * f.value[o].T[None]).reshape(-1, SIZE))
                        for n in names:
                            spots[n].append(ids[n][place.ravel()])
                changes.append([*change, back.sum(axis=0), hidden.T @ delta, delta.sum(keepdims=True)])
            for own, *parts in zip([*filters, shifts, weights, bias], *changes):
                own.step(sum(parts[1:], parts[0]))
            pushes = np.concatenate(pushes)
            moved = np.abs(pushes).sum(axis=1) > 0
            for n in names:
                rows, which = np.unique(np.concatenate(spots[n])[moved], return_inverse=True)
                gradient = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(gradient, which, pushes[moved])
                real = rows < len(used[n][0])
                tables[n].step(gradient[real], rows[real])
                touched[n][rows[real]] = True
    kept = {n: (used[n][0][touched[n]], tables[n].value[:-1][touched[n]]) for n in names}
    return Model(kept, [f.value for f in filters], shifts.value, weights.value, float(bias.value[0]))


def _pieces(chosen: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The texts in pieces of at most so many words, or of one text."""
    start, words = 0, 0
    for i, n in enumerate(lengths[chosen]):
        if i > start and words + n > _PIECE:
            yield chosen[start:i]
            start, words = i, 0
        words += n
    yield chosen[start:]


# -- the mean of models -----------------------------------------------------------------------------

_PLACES = ", ".join(f"v{i} long" for i in range(SIZE))
_KINDS = ("words", "stems", "dense")


def _unfolded(model: Model) -> pa.Table:
    """A model as rows (kind, row, values): its embeddings, and its other numbers in lines of SIZE."""
    dense = np.concatenate([
        *[f.ravel() for f in model.filters], model.shifts, model.weights, [np.float32(model.bias)]
    ])
    lines = np.zeros((-(-len(dense) // SIZE), SIZE), np.float32)
    lines.ravel()[:len(dense)] = dense
    parts = [model.rows["words"], model.rows["stems"], (np.arange(len(lines)), lines)]
    kinds = np.repeat(np.arange(len(parts)), [len(at) for at, _ in parts])
    values = np.rint(np.concatenate([v for _, v in parts]).astype(np.float64) / _UNIT).astype(np.int64)
    return pa.table({
        "kind": pa.array(kinds, pa.int32()), "row": pa.array(np.concatenate([at for at, _ in parts]), pa.int32()),
        **{f"v{i}": values[:, i] for i in range(SIZE)},
    })


def _folded(table: pa.Table, start: Model | None) -> Model:
    """The model of rows (kind, row, n, sums of n values); embeddings not named are those of the start."""
    kinds, rows, n = (table.column(c).to_numpy() for c in ("kind", "row", "n"))
    sums = np.stack([table.column(f"v{i}").to_numpy() for i in range(SIZE)], axis=1)
    values = (sums * _UNIT / n[:, None]).astype(np.float32)
    found = {}
    for kind, name in enumerate(_KINDS):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(rows[own])]
        at, new = rows[own].astype(np.int64), values[own]
        if start is not None and name != "dense":
            left = ~np.isin(start.rows[name][0], at)
            at, new = np.concatenate([at, start.rows[name][0][left]]), np.concatenate([new, start.rows[name][1][left]])
            new, at = new[np.argsort(at)], np.sort(at)
        found[name] = at, new
    dense, filters = found.pop("dense")[1].ravel(), []
    for w in WIDTHS:
        filters.append(dense[:w * SIZE * FILTERS].reshape(w, SIZE, FILTERS))
        dense = dense[w * SIZE * FILTERS:]
    total = FILTERS * len(WIDTHS)
    return Model(found, filters, dense[:total], dense[total:2 * total], float(dense[2 * total]))


def _round(rows: DataFrame, start: Model | None, epochs: int, turn: tuple[int, ...]) -> Model:
    """Train every part for so many epochs from the same start, and take the mean."""
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        # Sorted are the rows' places, so that their words are not copied.
        order = np.lexsort([part.column(c).to_numpy() for c in ("h", "order")])
        cut = [[np.frombuffer(v.as_buffer(), np.int32) for v in part.column(c)] for c in ("words", "stems")]
        cut = [[column[i] for i in order] for column in cut]
        marks = part.column("toxic").to_numpy()[order].astype(np.float32)
        own = (*turn, key[0].as_py()) if turn else ()
        found = _unfolded(train(list(zip(*cut)), marks, epochs, start=shared.value, turn=own))
        give_back()
        return found

    models = rows.groupBy("part").applyInArrow(run, f"kind int, row int, {_PLACES}")
    sums = models.groupBy("kind", "row").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(SIZE)]
    )
    # At most a row per bucket and kind.
    model = _folded(sums.toArrow(), start)
    shared.unpersist()
    return model


def _best_thresholds(scored: DataFrame) -> tuple[float | None, dict[str, float]]:
    """The best threshold of rows (lang, toxic, score) overall, None without both kinds of rows, and
    of each language that has enough toxic rows.

    A threshold lies midway between two neighbouring scores (0 and 1 included), where F1 is highest,
    the one nearest to the middle of equal ones. Rows are counted by score first: what is ordered
    per language are at most as many counts as there are scores of six digits.
    """
    counts = scored.groupBy("lang", F.round("score", 6).alias("score")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("toxic") == 1).alias("hits")
    )
    # Every row counts for its language and for the whole.
    of = F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")),
                           F.struct(F.lit(False).alias("all"), F.col("lang").alias("lang"))))
    counts = counts.select(of.alias("of"), "score", "rows", "hits").filter("of.all OR of.lang IS NOT NULL")
    ends = counts.select("of").distinct().select(
        "of", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"), F.lit(0).alias("rows"), F.lit(0).alias("hits")
    )
    counts = counts.unionByName(ends).groupBy("of", "score").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits"))
    down = Window.partitionBy("of").orderBy(F.desc("score"))
    every = Window.partitionBy("of")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    cuts = counts.select(
        "of", ((F.col("score") + F.lead("score").over(down)) / 2).alias("cut"),
        F.sum("rows").over(so_far).alias("said"), F.sum("hits").over(so_far).alias("hits"),
        F.sum("rows").over(every).alias("n"), F.sum("hits").over(every).alias("toxic"),
    ).filter("cut IS NOT NULL AND toxic > 0 AND toxic < n")
    cuts = cuts.filter(F.col("of.all") | (F.col("toxic") >= OWN_THRESHOLD))
    f1 = 2 * F.col("hits") / F.greatest(F.col("said") + F.col("toxic"), F.lit(1))
    cuts = cuts.withColumn("f1", f1).withColumn("most", F.max("f1").over(every))
    best = cuts.filter("f1 >= most - 1e-12").groupBy("of").agg(
        F.min_by("cut", F.struct(F.abs(F.col("cut") - 0.5), F.col("cut"))).alias("cut")
    ).select("of.*", "cut").collect()  # a row per language
    overall = [r.cut for r in best if r["all"]]
    return (overall[0] if overall else None), {r.lang: r.cut for r in sorted(best, key=str) if not r["all"]}


def _features_table(rows: DataFrame, parts: int) -> DataFrame:
    """The rows as numbers, once per key and text, by part: (part, order, h, words, stems, toxic)."""
    spark, buckets = rows.sparkSession, min(parts, MAX_BUCKETS)
    named = rows.withColumn("part", F.pmod(F.xxhash64("order", "h"), F.lit(parts)).cast("int"))
    once = named.repartition(buckets, "part").groupBy("part", "order", "h").agg(
        F.min("t").alias("t"), F.max("toxic").alias("toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, stems, first = features(batch.column(0))
            cut = lambda ids: pa.array([ids[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], cut(found), cut(stems)], ["part", "order", "h", "toxic", "words", "stems"]
            )
        give_back()

    columns = "part int, order long, h long, toxic int, words binary, stems binary"
    found = once.select("t", "part", "order", "h", "toxic").mapInArrow(run, columns)
    quoted = columns.replace("order ", "`order` ")
    table = bucket_table(spark, new_path(spark, "toxicity"), quoted, "part", buckets, "part")
    found.write.insertInto(table)
    return spark.table(table)


def fit(
    docs: DataFrame, labels: DataFrame, part_bytes: int = PART_BYTES, epochs: int = EPOCHS,
    key: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic",
) -> Model | None:
    """Learn from all labelled rows that are not held out; None without both kinds of rows."""
    prepare(docs.sparkSession)
    marked = (
        labels.filter(F.col(toxic).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("k")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
        .withColumn("order", F.xxhash64("k", F.lit("sample")))
    )
    aside = F.col("order") % 5 == 0
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("k"), body.alias("t"), F.xxhash64(body).alias("h"), F.col(lang).alias("lang"))
    # Labels of a checked size are sent, so that texts without one are not shuffled.
    marked = broadcast_if(marked, LABEL_BYTES, BROADCAST_BYTES)
    # Rows of a key with equal texts count once.
    seen = (
        named.select("k", "h", F.octet_length("t").alias("bytes")).join(marked.filter(~aside), "k")
        .groupBy("order", "h").agg(F.max("bytes").alias("bytes"), F.max("toxic").alias("toxic"))
        .agg(F.sum("bytes").alias("bytes"), F.min("toxic").alias("low"), F.max("toxic").alias("high")).first()
    )
    if seen.low == seen.high:
        return None
    parts = max(1, -(-seen.bytes // part_bytes))
    rows = _features_table(named.join(marked.filter(~aside), "k").select("order", "h", "t", "toxic"), parts)
    if parts == 1:
        model = _round(rows, None, epochs, ())
    else:
        model = None
        for i in range(epochs):
            model = _round(rows, model, 1, (i,))
    check = named.join(marked.filter(aside), "k").select("order", "h", "t", "lang", "toxic")
    scored = add_scores(check, model, "score", "t", ["order", "h", "lang", "toxic"]).groupBy("order", "h").agg(
        F.min("lang").alias("lang"), F.max("toxic").alias("toxic"), F.min("score").alias("score")
    )
    overall, own = _best_thresholds(scored)
    if overall is not None:
        model.threshold, model.thresholds = overall, own
    return model


def _score_texts(model: Model, texts, tables) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
    words, begins = _laid_out(np.concatenate([t[0] for t in texts]), first)
    stems, _ = _laid_out(np.concatenate([t[1] for t in texts]), first)
    return _score(model, words, stems, begins, tables)


def add_scores(
    docs: DataFrame, model: Model | None, column: str = "score", text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The kept columns (all by default) and the score, rounded to six digits."""
    prepare(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if model and batch.num_rows:
                words, stems, first = features(batch.column(len(keep)))
                a = 0
                while a < batch.num_rows:
                    b = max(a + 1, int(np.searchsorted(first, first[a] + _STEP, "right")) - 1)
                    own, part = first[a:b + 1] - first[a], slice(first[a], first[b])
                    laid, begins = _laid_out(words[part], own)
                    scores[a:b] = _score(model, laid, _laid_out(stems[part], own)[0], begins, tables)
                    a = b
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores.round(6))], [*keep, column]
            )
        del tables
        give_back()

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(column, T.DoubleType())])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its key as text divides by 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def threshold_of(model: Model | None, lang: str = "lang") -> Column:
    """The score from which on a text of its language counts as toxic."""
    if model is None:
        return F.lit(0.5)
    out = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        out = F.when(F.col(lang) == name, value).otherwise(out)
    return out


def drop_toxic(
    docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows below their language's threshold, with all their columns."""
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text).alias("text"),
                          F.col(lang).alias("lang"))
    scored = add_scores(carried, model, "score", "text", ["row", "lang"])
    return scored.filter(F.col("score") < threshold_of(model)).select("row.*")
