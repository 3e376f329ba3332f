"""Language identification with interpolated Kneser-Ney character models.

Texts are folded to lower-case letters with single blanks between words. Every
language has a model of ``ORDER`` characters, smoothed by interpolated
Kneser-Ney. N-grams are kept as sorted arrays of 64-bit hashes, one array per
order for all languages, with one column of log probabilities per language, so
that one binary search serves all of them. The language with the lowest cross-entropy per character
wins; a text that even the winner finds less likely than anything seen in calibration is rejected.

Models are fitted on a bounded sample of labelled rows (``MODEL_ROWS``, about the same number for every
language, whole texts), a fifth of which is kept back for calibration. All rows are scored, in full.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_RANGE, hash_share, remainder, small_batches, stored, table, text_chunks

ORDER = 4
#: Labelled rows that the models are fitted on, over all languages.
MODEL_ROWS = 8_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_BLANK = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 8_000_000


@cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case letter or mark, else a blank; and whether it is a letter."""
    fold, letter = np.full(0x110000, _BLANK, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            fold[c] = ord(chr(c).lower()[0])
            letter[c] = kind == "L"
    return fold, letter


def folded(text: bytes) -> np.ndarray:
    """Letter codes of a text after ORDER - 1 blanks; empty if it has no letter."""
    fold, letter = _fold()
    raw = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    if not letter[raw].any():
        return np.empty(0, dtype=np.uint32)
    codes = fold[raw]
    blank = codes == _BLANK
    blank[1:] &= blank[:-1].copy()  # keeps the first blank of a run
    if codes[0] == _BLANK:
        blank[0] = True
    return np.concatenate((np.full(ORDER - 1, _BLANK, dtype=np.uint32), codes[~blank]))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the value is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # per order: sorted hashes
    chance: list[np.ndarray] = field(default_factory=list)  # per order: log probability by language
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)  # log weight of the lower order by language
    unseen: np.ndarray | None = None  # log probability of a character that no text had
    sharpness: float = 8.0
    limits: np.ndarray | None = None  # per power of two of the length: cross-entropy beyond which a text is rejected

    def logs(self, codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        """log p of the character at each place given those before it, by language."""
        if not order:
            return np.broadcast_to(self.unseen, (len(at), len(self.languages)))
        key = _hash([codes[at - k] for k in range(order - 1, -1, -1)])
        place, there = _find(self.grams[order - 1], key)
        out = self.chance[order - 1][place]
        if not there.all():
            rest = at[~there]
            lower = self.logs(codes, rest, order - 1)
            if order > 1:
                place, known = _find(self.contexts[order - 1], _hash([codes[rest - k] for k in range(order - 1, 0, -1)]))
                lower = lower + np.where(known[:, None], self.backoff[order - 1][place], 0)
            out[~there] = lower
        return out

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy by language) per text; no characters if it has no letter.

        Short texts are looked up together, long ones piece by piece.
        """
        parts = [folded(t) for t in texts]
        size = np.array([len(p) for p in parts])
        counts = np.maximum(0, size - ORDER + 1)
        total = np.zeros((len(texts), len(self.languages)))
        step = max(1, _CELLS // max(1, len(self.languages)))
        start = 0
        while start < len(parts):
            end = start + 1
            while end < len(parts) and size[start : end + 1].sum() <= step:
                end += 1
            if size[start:end].sum() > step:
                for a in range(ORDER - 1, size[start], step):
                    at = np.arange(a, min(a + step, size[start]))
                    total[start] -= self.logs(parts[start], at, ORDER).sum(axis=0, dtype=np.float64)
            elif size[start:end].sum():
                codes = np.concatenate(parts[start:end])
                begin = np.cumsum(size[start:end]) - size[start:end]
                real = np.ones(len(codes), dtype=bool)
                for k in range(ORDER - 1):
                    real[begin[size[start:end] > 0] + k] = False
                at = np.nonzero(real)[0]
                sums = np.zeros((len(at) + 1, len(self.languages)))
                np.cumsum(self.logs(codes, at, ORDER), axis=0, dtype=np.float64, out=sums[1:])
                edge = np.concatenate(([0], np.cumsum(counts[start:end])))
                total[start:end] = -(sums[edge[1:]] - sums[edge[:-1]])
            start = end
        return counts, total / np.maximum(counts, 1)[:, None]

    def decide(self, counts: np.ndarray, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, score, rejected) per text that has letters."""
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        band = np.minimum(np.log2(np.maximum(counts, 1)).astype(int), len(self.limits) - 1)
        return best, score, low > self.limits[band]


def _unique(codes: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with the sum of their weights, or their number."""
    key = _hash(list(codes.T))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return codes[first], np.bincount(back, weights=weight, minlength=len(first))


def fit(languages: list[str], language: np.ndarray, codes: np.ndarray, count: np.ndarray) -> Model:
    """Models from the distinct n-grams of highest order: language number, ORDER letter codes, count."""
    model = Model(languages, unseen=np.zeros(len(languages)))
    per = []  # per language and order: rows, value, discount
    for n in range(len(languages)):
        levels, rows, value = {}, codes[language == n], count[language == n].astype(float)
        for order in range(ORDER, 0, -1):
            once, twice = (value == 1).sum(), (value == 2).sum()
            levels[order] = rows, value, min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            rows, value = _unique(rows[:, 1:]) if order > 1 else (rows, value)  # number of distinct characters before
        per.append(levels)
    alphabet = len(np.unique(codes[:, -1])) + 1
    below_keys, below = np.empty(0, dtype=np.uint64), np.full((1, len(languages)), 1.0 / alphabet)
    for order in range(1, ORDER + 1):
        every = np.concatenate([p[order][0] for p in per])
        key, first = np.unique(_hash(list(every.T)), return_index=True)
        rows = every[first]
        tail = _find(below_keys, _hash(list(rows[:, 1:].T)))[0] if order > 1 else np.zeros(len(rows), dtype=np.int64)
        heads = _hash(list(rows[:, :-1].T)) if order > 1 else np.zeros(len(rows), dtype=np.uint64)
        contexts = np.unique(heads)
        head = np.searchsorted(contexts, heads)
        chance, weight = np.empty((len(rows), len(languages))), np.ones((len(contexts), len(languages)))
        for n, levels in enumerate(per):
            own, value, discount = levels[order]
            place = np.searchsorted(key, _hash(list(own.T)))
            total = np.bincount(head[place], weights=value, minlength=len(contexts))
            kinds = np.bincount(head[place], minlength=len(contexts))
            weight[:, n] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            direct = np.zeros(len(rows))
            direct[place] = (value - discount) / total[head[place]]
            chance[:, n] = direct + weight[head, n] * below[tail, n]
            if order == 1:
                model.unseen[n] = np.log(weight[0, n] / alphabet) if len(own) else np.log(1.0 / alphabet)
        model.grams.append(key)
        model.chance.append(np.log(chance).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log(weight).astype(np.float32))
        below_keys, below = key, chance
    return model


def calibrate(model: Model, truth: np.ndarray, counts: np.ndarray, entropy: np.ndarray) -> None:
    """Set how sharply entropies turn into scores, and the rejection limit of each length."""
    bands = 24
    model.limits = np.full(bands, np.inf)
    use = counts > 0
    truth, counts, entropy = truth[use], counts[use], entropy[use]
    if not len(truth):
        return
    gaps = entropy - entropy.min(axis=1, keepdims=True)
    own = gaps[np.arange(len(truth)), truth]
    likely = {s: (-s * own - np.log(np.exp(-s * gaps).sum(axis=1))).mean() for s in 2.0 ** np.arange(0, 8)}
    model.sharpness = max(likely, key=likely.get)
    low, band = entropy.min(axis=1), np.minimum(np.log2(counts).astype(int), bands - 1)
    # the worst calibration text of a length or longer, and half as much again above the typical one
    reach = -np.inf
    for b in range(bands - 1, -1, -1):
        if (band == b).any():
            reach = max(reach, low[band == b].max() + 0.5 * np.median(low))
        model.limits[b] = reach if np.isfinite(reach) else low.max() + 0.5 * np.median(low)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = MODEL_ROWS) -> Model | None:
    """Fit on labelled rows outside the hold-out; None if there are none.

    ``rows`` bounds the sample; every language gets an equal share of it, or all of its rows if it has fewer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = {x: min(1.0, rows / len(languages) / n) for x, n in sizes.items()}
    cut = F.create_map(*[F.lit(v) for x in languages for v in (x, int(share[x] * HASH_RANGE))])
    taken = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(HASH_RANGE)) < cut[F.col("lang")]
    sample = stored(labelled.filter(taken), "language")
    kept_back = hash_share(F.col("doc_id"), 0.2, "calibrate")
    number = {x: n for n, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            names = batch.column(1).to_pylist()
            for name in sorted(set(names)):
                parts = [folded(t) for t, x in zip(texts, names) if x == name]
                grams = [np.stack([p[k : len(p) - ORDER + 1 + k] for k in range(ORDER)], axis=1) for p in parts if len(p)]
                if not grams:
                    continue
                kinds, n = _unique(np.concatenate(grams))
                spelled = [bytes(r).decode("utf-32-le", "replace") for r in kinds.astype("<u4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number[name]] * len(n)), pa.array(spelled), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )

    counted = sample.filter(~kept_back).mapInArrow(count, "lang long, gram string, n long")
    # distinct n-grams of a bounded number of texts
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    if not grams.num_rows:
        return None
    spelled = "".join(grams["gram"].to_pylist())
    codes = np.frombuffer(spelled.encode("utf-32-le"), dtype=np.uint32).reshape(-1, ORDER)
    model = fit(languages, grams["lang"].to_numpy(), codes, grams["n"].to_numpy())

    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            counts, entropy = shared.value.entropies(texts)
            truth = [number[x] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(truth), pa.array(counts.astype(np.int64)), pa.array(entropy.tolist(), type=pa.list_(pa.float64()))],
                ["truth", "n", "entropy"],
            )

    judged = sample.filter(kept_back).mapInArrow(judge, "truth long, n long, entropy array<double>").toArrow()
    calibrate(
        model,
        judged["truth"].to_numpy().astype(np.int64),
        judged["n"].to_numpy().astype(np.int64),
        np.array(judged["entropy"].to_pylist(), dtype=float).reshape(-1, len(languages)),
    )
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of every row with lang_pred, score and rejected.

    NULL, empty and letterless texts are ``und`` with score 0 and rejected; without a model all texts are.
    Long texts are scored in full. An added column replaces one of the same name. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    out = docs.select(*(keep if keep is not None else docs.columns)).drop(*added)
    frame = out if text in out.columns else docs.select(*out.columns, text)
    shared, names = spark.sparkContext.broadcast(model), out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in text_chunks(batches, text):
            n = len(texts)
            name, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
            if model is not None:
                counts, entropy = model.entropies(texts)
                best, sure, odd = model.decide(counts, entropy)
                has = counts > 0
                name = [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                score, rejected = np.where(has, sure, 0.0), ~has | odd
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(name), pa.array(score), pa.array(rejected)], [*names, *added]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), *(f"{k} {v}" for k, v in added.items())])
    return frame.mapInArrow(run, schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``; ``rejected`` says whether the pipeline lets the text go."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), keep=["doc_id"])
    held_out = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
