"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every character that is no letter counts as a space.
The n-grams are the letters, the pairs with at least one letter and the triples
around a letter, so that word beginnings and ends count too.  Each n-gram is
hashed into one of ``2 ** bits`` buckets.

Fitting is one narrow pass with one aggregation: each task keeps a count matrix
of languages x buckets and emits its non-zero cells, which are summed by key;
what comes to the driver is that matrix, whose size depends on ``bits`` and
``max_langs`` but not on the corpus.  Scoring is one narrow pass: the matrix of
log-probabilities is broadcast, and each task treats a slice of texts as a
sparse batch (bucket numbers and row starts) and sums the matrix rows with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import column, forget, slices

#: Bytes of text in a sparse batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Characters that are treated at once; their arrays take some forty times as much, however long a text is.
WINDOW = 1 << 18
#: Label of texts without any letter.
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each character of the basic plane is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def ngram_windows(texts: list[str | None], bits: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each window of ``WINDOW`` characters of all texts in a row, and n = 1, 2, 3: the buckets of the n-grams
    that begin there, and where those of each text begin.  A long text spreads over several windows."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    joined = " " + " ".join(lowered) + "  "
    del lowered
    for lo in range(0, len(joined) - 2, WINDOW):
        flat = np.frombuffer(joined[lo : lo + WINDOW + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[np.minimum(flat, 0xFFFF)]
        for i in np.flatnonzero(flat > 0xFFFF):
            letter[i] = chr(flat[i]).isalpha()
        code = np.where(letter, flat, np.uint32(32)).astype(np.uint32)
        n = len(flat) - 2
        a, b, c = code[:n], code[1 : n + 1], code[2:]
        la, lb = letter[:n], letter[1 : n + 1]
        mix = np.uint32(0x9E3779B1)
        out = []
        for keep, value in (
            (la, lambda k: a[k] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)),
            (la | lb, lambda k: a[k] * np.uint32(0xC2B2AE35) + b[k] * np.uint32(0x165667B1) + np.uint32(0x51ED270B)),
            (lb, lambda k: (a[k] * np.uint32(0xC2B2AE35) + b[k]) * np.uint32(0x165667B1) + c[k] * np.uint32(0x2545F491)),
        ):
            at = np.flatnonzero(keep)
            h = value(at)
            out.append((((h ^ (h >> np.uint32(15))) * mix) >> np.uint32(32 - bits), np.searchsorted(at + lo, starts)))
        yield out


def per_text(begin: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` n-grams each text has."""
    return np.diff(np.append(begin, n))


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # languages x buckets
    log_prior: np.ndarray
    bits: int

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-posterior of each text and language up to a constant; the number of the text's letters and n-grams."""
        total = np.tile(self.log_prior, (len(texts), 1))
        letters, grams = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for window in ngram_windows(texts, self.bits):
            letters += per_text(window[0][1], len(window[0][0]))
            for h, begin in window:
                each = per_text(begin, len(h))
                grams += each
                filled = each > 0
                if len(h):
                    for k in range(len(self.langs)):
                        total[filled, k] += np.add.reduceat(self.log_prob[k][h], begin[filled], dtype=np.float64)
        return total, letters, grams

    def usual(self) -> np.ndarray:
        """The mean log-probability of an n-gram of each language in texts of that language."""
        p = np.exp(self.log_prob.astype(np.float64))
        return (p * self.log_prob).sum(1)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16, smoothing: float = 0.5, max_langs: int = 400) -> LanguageModel:
    """A model of all rows with a non-null language; rows with a null text count for the prior alone.

    ``max_langs`` bounds the count matrix; more languages raise ValueError.
    Without any labelled row the model has no language and determines none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches, "_text", BATCH_BYTES):
            langs = column(batch, "_lang").to_pylist()
            names = sorted(set(langs))
            if len(seen.keys() | set(names)) > max_langs:
                raise ValueError(f"more than {max_langs} languages")
            code = np.array([names.index(x) for x in langs])
            cells = np.zeros(len(names) << bits, np.int64)
            for window in ngram_windows(column(batch, "_text").to_pylist(), bits):
                for h, begin in window:
                    each = np.repeat(code, per_text(begin, len(h)))
                    cells += np.bincount((each << bits) + h, minlength=len(cells))
            for k, name in enumerate(names):
                row = seen.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                row[:-1] += cells[k << bits : (k + 1) << bits]
                row[-1] += int((code == k).sum())
        for name, row in seen.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])

    labelled = df.where(df[lang_col].isNotNull()).select(df[text_col].alias("_text"), df[lang_col].alias("_lang"))
    cells = labelled.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(cells["lang"]))
    if len(langs) > max_langs:
        raise ValueError(f"{len(langs)} languages; at most {max_langs} are allowed")
    counts = np.zeros((len(langs), (1 << bits) + 1))
    counts[np.searchsorted(langs, cells["lang"]), cells["bucket"].to_numpy()] = cells["n"].to_numpy()
    docs, counts = counts[:, -1], counts[:, :-1]
    prob = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * (1 << bits))
    return LanguageModel(langs, np.log(prob).astype(np.float32), np.log(docs / max(docs.sum(), 1)), bits)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score", margin_col: str | None = None) -> DataFrame:
    """``df`` with the likeliest language of each whole text and its posterior probability (0 to 1).

    A null text or one without a letter gets ``und`` and 0, and so does every
    text if the model has no language.  Equal posteriors go to the language that
    sorts first.  Repeated rows are scored alike; all other columns pass
    through.  A clash of column names raises ValueError.

    ``margin_col`` adds how far the mean log-probability of the text's n-grams
    lies below (negative) or above what is usual in that language, null for
    ``und``: posteriors compare languages only and are near 1 for texts in none of them.
    """
    made = [pred_col, score_col, *([margin_col] if margin_col else [])]
    if set(made) & set(df.columns) or len(set(made)) < len(made):
        raise ValueError(f"the table has one of the columns {made}")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        usual = m.usual()
        for batch in slices(batches, text_col, BATCH_BYTES):
            total, letters, grams = m.scores(column(batch, text_col).to_pylist())
            ok = (letters > 0) & bool(m.langs)
            best = total.argmax(1) if m.langs else np.zeros(len(total), np.int64)
            with np.errstate(under="ignore"):
                post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if m.langs else np.zeros(len(total))
            pred = [m.langs[k] if o else UNDETERMINED for k, o in zip(best, ok, strict=True)]
            out = [pa.array(pred, pa.string()), pa.array(np.where(ok, post, 0.0))]
            if margin_col and m.langs:
                mean = (total[np.arange(len(best)), best] - m.log_prior[best]) / np.maximum(grams, 1)
                out.append(pa.array(mean - usual[best], mask=~ok))
            elif margin_col:
                out.append(pa.nulls(len(pred), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *made])

    kinds = {pred_col: F.lit("").cast("string"), score_col: F.lit(0.0)} | ({margin_col: F.lit(None).cast("double")} if margin_col else {})
    return df.mapInArrow(score, df.limit(0).withColumns(kinds).schema)
