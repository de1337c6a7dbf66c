"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 8).

Letters are lower-cased, runs of anything else become one space, and all n-grams of ``ORDERS``
characters are hashed to ``BUCKETS`` buckets. Training counts every labelled training text: each task
adds up one dense table per language, and the tables are added by (language, stretch of buckets).
The smoothed log-probability matrix (languages x BUCKETS float32, at most ``MAX_LANGS`` languages, so
64 MB at most) is broadcast; batches of texts are scored by gathering rows and adding them per text.

Texts are worked on in parts of about ``PIECE`` characters; a longer text is cut behind white space (the few n-grams across a
cut are not counted), so memory does not follow the longest text. ``strangeness`` says how much less likely a text's n-grams
are, in nats an n-gram, than the language's own are on average: near 0 for its texts, high for languages that were not learned.

Defined cases: a null text or one without letters is ``und`` with score 0; so is every text if nothing
was learned; ties go to the language that is first by code point; null ids count as held in
(their crc32 is null) and are not learned from; repeated rows and other columns are harmless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, mix64, table

ORDERS = (2, 3, 4)
BITS = 16
BUCKETS = 1 << BITS
STRETCH = 1 << 12
MAX_LANGS = 256
SMOOTH = 0.5
#: Characters worked on at once: n-grams take some 200 times that in bytes.
PIECE = 500_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts in order, the offsets of each text, and whether it has a letter."""
    parts = [(t or "").lower() for t in texts]
    lens = np.array([len(p) + 1 for p in parts], np.int64)
    chars = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    row = np.repeat(np.arange(len(parts)), lens)
    # a space stays where the one before it is a letter or belongs to another text
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.where(letter, chars, 32)[keep].astype(U)
    row = row[keep]
    has = np.bincount(row, weights=letter[keep], minlength=len(parts)) > 0
    found, rows = [], []
    state = np.zeros(len(chars), U)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        state = state[: len(chars) - n + 1] * U(0x100000001B3) + chars[n - 1 :] + U(1)
        if n in ORDERS:
            same = row[: len(state)] == row[n - 1 :]
            found.append((mix64(state[same] + U(n << 56)) >> U(64 - BITS)).astype(np.uint32))
            rows.append(row[: len(state)][same])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(len(parts) + 1, np.int64), has
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    off = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(parts)))]).astype(np.int64)
    return np.concatenate(found)[order], off, has


def parts(texts: list[str | None], most: int = PIECE):
    """(rows, strings): all texts in parts of about ``most`` characters; the strings of a row join to its text."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            to = len(text)
            if to - at > most:
                to = at + most
                cut = max(text.rfind(c, at, to) for c in " \n\t")
                to = cut + 1 if cut > at else to
            rows.append(row)
            held.append(text[at:to])
            size += to - at
            at = to
            if size >= most:
                yield np.array(rows), held
                rows, held, size = [], [], 0
            if at >= len(text):
                break
    if rows:
        yield np.array(rows), held


def _count(batches):
    tables: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            docs[lang] = docs.get(lang, 0) + int((langs == lang).sum())
        for rows, texts in parts(batch.column("text").to_pylist()):
            for lang in sorted(set(langs[rows])):
                if lang not in tables:
                    if len(tables) >= MAX_LANGS:
                        raise ValueError(f"more than {MAX_LANGS} languages")
                    tables[lang] = np.zeros(BUCKETS, np.int64)
                got, _, _ = grams([texts[i] for i in np.flatnonzero(langs[rows] == lang)])
                tables[lang] += np.bincount(got, minlength=BUCKETS)
    for lang, t in tables.items():
        for k in range(0, BUCKETS, STRETCH):
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang], "k": [k], "docs": [docs[lang]], "counts": [t[k : k + STRETCH].tobytes()]}
            )


def _add(key, table_):
    total = np.zeros(STRETCH, np.int64)
    for c in table_.column("counts").to_pylist():
        total += np.frombuffer(c, np.int64)
    docs = int(np.sum(table_.column("docs").to_numpy()))
    return pa.table({"lang": [key[0].as_py()], "k": [key[1].as_py()], "docs": [docs], "counts": [total.tobytes()]})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages in order, log priors, the log-probability matrix (BUCKETS x languages) of text, lang, and each language's mean log-probability."""
    schema = "lang string, k long, docs long, counts binary"
    got = docs.select("text", "lang").filter("lang IS NOT NULL").mapInArrow(_count, schema)
    rows = got.groupBy("lang", "k").applyInArrow(_add, schema).collect()
    langs = sorted({r["lang"] for r in rows})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.zeros((len(langs), BUCKETS))
    prior = np.zeros(len(langs))
    for r in rows:
        i = langs.index(r["lang"])
        counts[i, r["k"] : r["k"] + STRETCH] = np.frombuffer(bytes(r["counts"]), np.int64)
        prior[i] = r["docs"]
    counts += SMOOTH
    matrix = np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts
    usual = (np.exp(matrix) * matrix).sum(axis=1) if langs else prior
    return langs, np.log(prior / prior.sum()) if langs else prior, np.ascontiguousarray(matrix.T, np.float32), usual


def predict(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score (the posterior of the predicted language), grams (how many the text has) and strangeness."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MAX_LANGS languages at most
    keep = [c for c in dict.fromkeys(keep) if c not in ("lang_pred", "score", "grams", "strangeness")]
    d = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = d.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "grams": F.lit(0).cast("long"), "strangeness": F.lit(0.0)}).schema

    def label(batches):
        langs, prior, matrix, usual = shared.value
        for batch in batches:
            n = batch.num_rows
            total, size, has = np.zeros((n, len(langs))), np.zeros(n, np.int64), np.zeros(n, bool)
            for rows, texts in parts(batch.column("text").to_pylist(), PIECE // max(1, len(langs) // 8)):
                got, off, letters = grams(texts)
                has[rows[letters]] = True
                np.add.at(size, rows, np.diff(off))
                full = np.flatnonzero(np.diff(off) > 0)
                if langs and len(full):
                    np.add.at(total, rows[full], np.add.reduceat(matrix[got].astype(np.float64), off[full], axis=0))
            pred, score, strange = ["und"] * n, np.zeros(n), np.zeros(n)
            if langs and n:
                best = (total + prior).argmax(axis=1)
                posterior = np.exp(total + prior - (total + prior).max(axis=1, keepdims=True))
                score = np.where(has, 1 / posterior.sum(axis=1), 0.0)
                pred = [langs[b] if h else "und" for b, h in zip(best, has)]
                strange = np.where(size > 0, usual[best] - total[np.arange(n), best] / np.maximum(size, 1), 0.0)
            found = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size), pa.array(strange, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "lang_pred", "score", "grams", "strangeness"])

    return d.mapInArrow(label, schema)


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
