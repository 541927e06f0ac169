"""Language ID: a byte convolutional network, trained in numpy.

Filters of several widths slide over the embedded bytes of a window; each filter's
maximum over the window goes through a softmax layer. A text is cut into windows of
WINDOW bytes, all of them are scored, and their mean probabilities decide.

As embedding and convolution are both linear, a filter of width w is a sum of w table
lookups by byte; for scoring, tables of two neighbouring bytes are laid out once.

Training takes a bounded sample of labelled rows, whatever the size of the table: of each
language the SAMPLE distinct texts of the least hashes, or fewer where many languages share TOTAL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Flat, column, join_counted, workers
from .textops import blocks, byte_sizes

WINDOW = 192
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
#: Pieces of text that a language gives to training at most, that all languages give, and their characters.
SAMPLE, TOTAL, PIECE = 1200, 200_000, 192
#: The least score of a text that is taken to be in a language at all.
LEAST = 0.4
EPOCHS, RATE, BATCH = 12, 0.01, 64
UNDETERMINED = "und"


@dataclass
class Network:
    labels: list[str]
    #: of each width: (width, 256, FILTERS), a byte's share in a filter by its place
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that make up the text, the last padded with blanks."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """A network for the labels that occur, by Adam on the cross entropy of single windows."""
    names = sorted(set(labels))
    y_all = np.array([names.index(x) for x in labels])
    x_all = np.concatenate([windows_of(t)[:1] for t in texts])
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    p = {
        "emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "dense": rng.normal(0, 0.3, (total, len(names))).astype(np.float32),
        "bias": np.zeros(total, np.float32),
        "out": np.zeros(len(names), np.float32),
    }
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    balance = len(y_all) / (len(names) * np.bincount(y_all, minlength=len(names)))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y_all))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, y = x_all[rows], y_all[rows]
            e = p["emb"][x]
            pooled, where = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                seen = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
                z = seen @ p[f"f{w}"]
                top = z.argmax(axis=1)
                where.append(top)
                pooled.append(np.take_along_axis(z, top[:, None], axis=1)[:, 0])
            a = np.concatenate(pooled, axis=1) + p["bias"]
            h = np.maximum(a, 0)
            prob = _softmax(h @ p["dense"] + p["out"])
            d = prob.copy()
            d[np.arange(len(y)), y] -= 1
            d *= (balance[y] / len(y))[:, None]
            d = d.astype(np.float32)
            grad = {"dense": h.T @ d, "out": d.sum(axis=0)}
            da = (d @ p["dense"].T) * (a > 0)
            grad["bias"] = da.sum(axis=0)
            demb = np.zeros_like(p["emb"])
            row = np.arange(len(y))[:, None]
            for k, w in enumerate(WIDTHS):
                top, dz = where[k], da[:, k * FILTERS : (k + 1) * FILTERS]
                f = p[f"f{w}"].reshape(w, EMBED, FILTERS)
                df = np.zeros_like(f)
                for i in range(w):
                    byte = x[row, top + i]
                    df[i] = np.einsum("bfe,bf->ef", p["emb"][byte], dz)
                    np.add.at(demb, byte, dz[:, :, None] * f[i].T[None])
                grad[f"f{w}"] = df.reshape(w * EMBED, FILTERS)
            grad["emb"] = demb
            step += 1
            for name, g in grad.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    tables = [np.einsum("be,wef->wbf", p["emb"], p[f"f{w}"].reshape(w, EMBED, FILTERS)) for w in WIDTHS]
    return Network(names, tables, p["bias"], p["dense"], p["out"])


class Scorer:
    """Scores many windows: every filter's response is the sum of lookups of two bytes at once."""

    def __init__(self, net: Network):
        self.net = net
        self.parts = []
        for table in net.tables:
            w, own = len(table), []
            for i in range(0, w - 1, 2):
                own.append((i, (table[i][:, None] + table[i + 1][None]).reshape(65536, FILTERS).astype(np.float32)))
            if w % 2:
                own.append((w - 1, np.repeat(table[w - 1], 256, axis=0).astype(np.float32)))
            self.parts.append((w, own))

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of each row of WINDOW bytes, the probability of every label."""
        pair = np.empty(rows.shape, np.uint16)
        pair[:, :-1] = rows[:, :-1].astype(np.uint16) * 256 + rows[:, 1:]
        pair[:, -1] = rows[:, -1].astype(np.uint16) * 256
        top = []
        for w, own in self.parts:
            n = WINDOW - w + 1
            z = np.take(own[0][1], pair[:, own[0][0] : own[0][0] + n], axis=0)
            for i, table in own[1:]:
                z += np.take(table, pair[:, i : i + n], axis=0)
            top.append(z.max(axis=1))
        h = np.maximum(np.concatenate(top, axis=1) + self.net.bias, 0)
        return _softmax(h @ self.net.dense + self.net.out)


def predict(texts: list[bytes], scorer: Scorer, rows_at_once: int = 512) -> np.ndarray:
    """Of each text, the mean over its windows of every label's probability."""
    count = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    rows = np.frombuffer(b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, count.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
    prob = np.concatenate([scorer.probabilities(rows[i : i + rows_at_once]) for i in range(0, len(rows), rows_at_once)])
    sums = np.add.reduceat(prob, np.cumsum(count) - count, axis=0)
    return sums / count[:, None]


def _predict_batches(net, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net.value)
        labels = np.array(net.value.labels, object)
        for batch in batches:
            text, letters = batch.column(at_text).cast(pa.binary()), batch.column(len(batch.columns) - 1)
            name = np.full(len(batch), UNDETERMINED, object)
            score = np.zeros(len(batch))
            some = text.filter(letters)
            at = np.flatnonzero(letters.to_numpy(zero_copy_only=False))
            for lo, hi in blocks(byte_sizes(some)):
                prob = predict(some.slice(lo, hi - lo).to_pylist(), scorer)
                best = prob.argmax(axis=1)
                name[at[lo:hi]] = labels[best]
                score[at[lo:hi]] = np.clip(prob[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(name, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "_lang", "_score"]
            )

    return run


def held_out(id_col: str):
    """Rows that are not learnt from: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, total: int = TOTAL) -> Network | None:
    """A network learnt from a bounded sample of the labelled rows that are not held out; None without such rows.

    Each language gives the `sample` distinct texts of the least hashes, or total / languages of
    them if that is less; copies of a text count once. The sample's text comes from anywhere in
    the text: PIECE characters from a place that a hash chooses. Null labels, null texts and texts
    without a letter teach nothing. Other columns play no part, whatever their names.
    """
    workers(docs.sparkSession)
    usable = docs.select(column(text_col).cast("string").alias("_text"), column(lang_col).cast("string").alias("_lang"), held_out(id_col).alias("_held"))
    usable = usable.filter("not _held and _lang is not null and _text is not null").filter(F.col("_text").rlike(r"\p{L}"))
    usable = usable.withColumn("_h", F.pmod(F.xxhash64("_text", F.lit("lang")), F.lit(1 << 40)))
    counts = usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct("_h").alias("_texts")).cache()
    languages = counts.count()
    if not languages:
        return None
    each = max(1, min(sample, total // languages))
    # a threshold on the hash thins each language to a little over its share, then the least hashes are taken
    near = join_counted(usable, counts, "_lang", "_n").filter(F.col("_h") <= F.lit(1.4 * each + 64) / F.col("_texts") * (1 << 40))
    place = F.lit(1) + F.pmod("_h", F.greatest(F.lit(1), F.length("_text") - PIECE + 1)).cast("int")
    pieces = near.select("_lang", "_h", F.substring("_text", place, F.lit(PIECE)).alias("_piece")).dropDuplicates(["_lang", "_h"])
    pieces = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).filter(F.col("_rank") <= each)
    rows = pieces.orderBy("_h", "_lang").limit(total).collect()
    counts.unpersist()
    rows = [r for r in rows if any(c.isalpha() for c in r["_piece"])]
    return train([r["_piece"].encode() for r in rows], [r["_lang"] for r in rows]) if rows else None


def _identified(flat: Flat, net: Network | None, text_col: str) -> DataFrame:
    """The table's rows with _lang and _score."""
    own = flat.rows.select(*flat.own)
    text = F.col(flat.name(text_col))
    letters = F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return own.withColumns({"_lang": F.lit(UNDETERMINED), "_score": F.lit(0.0)})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    shared = own.sparkSession.sparkContext.broadcast(net)
    at = flat.own.index(flat.name(text_col))
    return own.withColumn("_letters", letters).mapInArrow(_predict_batches(shared, at), f"{fields}, _lang string, _score double")


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. Texts that are null or have no letter are `und`, with score 0.

    So are all texts if there is no network. Only the text decides, all of it however long: the
    mean of its windows' probabilities. Rows that repeat are predicted alike; an empty table gives an
    empty result. Columns of docs called lang_pred or score give way, others stay as they are.
    """
    workers(docs.sparkSession)
    flat = Flat(docs, keys=False)
    return flat.restored(_identified(flat, net, text_col), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network that has not seen the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(own, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = LEAST) -> DataFrame:
    """docs without those that are in no language, or in none of `languages` (None: any that was learnt).

    A document is in no language if its text is null or has no letter, or if the network gives no
    language a mean probability of `least`. Without a labelled row there is no network, and only
    the first rule holds. All columns stay as they are, whatever their names.
    """
    workers(docs.sparkSession)
    flat = Flat(docs, keys=False)
    net = fit(docs)
    found = _identified(flat, net, "text")
    if net is None:
        return flat.restored(found.filter(F.col(flat.name("text")).cast("string").rlike(r"\p{L}")))
    wanted = F.col("_lang") != UNDETERMINED if languages is None else F.col("_lang").isin(*languages)
    return flat.restored(found.filter(wanted & (F.col("_score") >= least)))
