"""Language identification by error-correcting output codes (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedledger.llm.worker import ship

ship(__name__)

FEATURES = 1 << 14
UNKNOWN = "und"
BLOCK_BYTES = 1 << 20
SHARPNESS = 6.0
MARGIN = 0.1  # ambiguous below this lead of the best codeword's score over the second's
EXHAUSTIVE_UP_TO = 8
# ASCII letters stay, other ASCII bytes part words; bytes of other characters stay.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(languages: int) -> np.ndarray:
    """One codeword of -1 and 1 per language, with many places between any two.

    Up to eight languages: every way of parting them in two, so any two words differ in
    2**(n-2) of 2**(n-1)-1 places. Beyond: the words of a simplex code, bit ``b`` of word ``l`` being the
    parity of ``l & b``, so any two of 2**k-1 places differ in 2**(k-1).
    """
    if languages < 2:
        return np.zeros((languages, 0))
    number = np.arange(languages)[:, None]
    if languages <= EXHAUSTIVE_UP_TO:
        bits = np.where(number < languages - 1, np.arange(1, 1 << (languages - 1))[None, :] >> np.minimum(number, languages - 2) & 1, 0)
    else:
        width = int(languages - 1).bit_length()
        both = number & np.arange(1, 1 << width)[None, :]
        bits = np.zeros_like(both)
        for k in range(width):
            bits ^= both >> k & 1
    return bits * 2.0 - 1.0


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the lower-cased words of a text, in blocks of bounded size."""
    raw = b" " + b" ".join(text.lower().encode().translate(_TO_SPACE).split()) + b" "
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(len(data) - 2, 0), BLOCK_BYTES):
        block = data[at:at + BLOCK_BYTES + 2].astype(np.uint32)
        packed = (block[:-2] << np.uint32(16)) | (block[1:-1] << np.uint32(8)) | block[2:]
        yield (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - (FEATURES - 1).bit_length())


def trigram_counts(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang``, ``feature``, ``n`` summed over all rows; each task sums its rows before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(FEATURES, np.int64))
                for block in trigrams(text.as_py() or ""):
                    own += np.bincount(block, minlength=FEATURES)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used])],
                                             names=["lang", "feature", "n"])

    counts = labelled.select(F.col(lang_col).cast("string"), text_col).mapInArrow(run, "lang string, feature int, n long")
    return counts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labelled: Column, lang_col: str = "lang", text_col: str = "text") -> dict:
    """One binary classifier per code place, learned from all rows where ``labelled`` holds and a language is given.

    A place's classifier is linear in the trigram shares of a text: the log-odds between the
    languages with 1 and those with 0 at that place, all languages weighing alike. The model
    has ``FEATURES`` weights per place, whatever the number of rows; only counts per language and
    feature reach the driver.
    """
    rows = trigram_counts(docs.where(labelled & F.col(lang_col).isNotNull()), lang_col, text_col).collect()
    names = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), FEATURES))
    for lang, feature, n in rows:
        counts[number[lang], feature] = n
    code = codewords(len(names))
    if not names:
        return {"names": [], "code": code, "weights": np.zeros((FEATURES, 0), np.float32)}
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = [np.log(shares[code[:, b] > 0].mean(axis=0)) - np.log(shares[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    return {"names": names, "code": code, "weights": np.array(weights, np.float32).reshape(-1, FEATURES).T.copy()}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its score and its lead, per row of margins, by loss-weighted decoding.

    A codeword's loss is the sum over its places of the logistic loss of the margin times the
    bit; the scores are the losses' softmax, 0 to 1. Equal scores go to the first language.
    """
    loss = np.logaddexp(0.0, -SHARPNESS * margins[:, None, :] * code[None, :, :]).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    score = share[np.arange(len(share)), best]
    share[np.arange(len(share)), best] = -1.0
    second = share.max(axis=1) if share.shape[1] > 1 else np.zeros(len(share))
    return best, score, score - second


def predict(docs: DataFrame, model: dict, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of every row, with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; no shuffle.

    A null text, or one without a letter, is ``und`` with score 0 and not ambiguous. Whole texts
    are read, of any length; without any labelled language all are ``und``.
    """
    names, code, weights = model["names"], model["code"], model["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.zeros((batch.num_rows, code.shape[1]))
            known = np.zeros(batch.num_rows, bool)
            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                text = value.as_py()
                if not names or not text or not any(map(str.isalpha, text)):  # letters: category L, not the signs of No and Nl
                    continue
                known[row], total = True, 0
                for block in trigrams(text):
                    margins[row] += weights[block].sum(axis=0, dtype=np.float64)
                    total += len(block)
                margins[row] /= max(total, 1)
            if names:
                best, score, lead = decode(margins, code)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            else:
                lang, score, lead = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)),
                 pa.array(known & (lead < MARGIN))], names=[*columns, "lang_pred", "score", "ambiguous"])

    narrow = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("__text"))
    schema = narrow.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return narrow.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: those whose id, as text, has a crc32 of 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``.

    Learns from the rows that are not held out and have a language; predicts all from their text
    alone. A null id is held out; repeated rows are predicted each; other columns are ignored.
    """
    model = train(docs, ~held_out(id_col), lang_col, text_col)
    marked = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__body"))
    return predict(marked, model, [id_col, "held_out"], "__body")


def keep_known(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: neither ``und`` nor ambiguous."""
    model = train(docs, ~held_out(id_col), lang_col, text_col)
    columns = docs.columns
    own = docs.select(*columns, F.col(text_col).alias("__body"))
    judged = predict(own, model, columns, "__body")
    return judged.where(~F.col("ambiguous") & (F.col("lang_pred") != UNKNOWN)).select(*columns)
