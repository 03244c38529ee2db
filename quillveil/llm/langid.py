"""Language identification with hyperdimensional profiles.

Every letter (lower-cased, any script) has a random vector of +1 and -1 that follows from its code
point; a run of other characters is one boundary symbol.  A trigram's vector binds its three
letters' vectors, permuted by place (rotated by two, one and no steps), by multiplication.  A text's
profile bundles (adds) the vectors of all its trigrams, and a language's prototype bundles the profiles
of its training texts.  A text gets the language with the largest cosine to its profile.

Prototypes are sums of integers, exact and independent of order; training adds them per task, then by
language in one small shuffle of (language, dimension) sums.  What is broadcast is one vector for each learned
language.  Scoring is row by row over whole texts.  Null texts and texts without a letter: ``und``, score 0.
Null languages are not learned from; without any prototype every text is ``und``.  Ties go to the language first in order.
Repeated rows: each learned from and scored.  An empty table gives no prototype and an empty result.  Vectors of trigrams
are made in blocks, so the memory of a text follows its length, not the number of its trigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

UNKNOWN = "und"
#: Trigrams whose vectors are made at once, and cells of a document-by-trigram matrix.
_GRAMS, _CELLS = 2048, 3_000_000
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its letter in lower case, or 0; built once a worker."""
    if "letters" not in _tables:
        out = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def _vectors(symbols: np.ndarray, dims: int) -> np.ndarray:
    """One row of +1 and -1 for each code point."""
    words = np.stack([K.keyed(dims // 64, 1000 + int(s)) for s in symbols])
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


class Profiles:
    """Bundled trigram vectors of the texts of a chunk."""

    def __init__(self, dims: int):
        self.dims = dims

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x dims, how many letters each text has)."""
        docs = len(off) - 1
        out, letters = np.zeros((docs, self.dims), np.float32), np.zeros(docs, np.int64)
        if not len(buf):
            return out, letters
        points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = K.code_points(buf)[off]
        if first[-1] != len(points):  # malformed bytes: decode text by text
            texts = [t.encode("utf-32-le") for t in K.strings(buf, off)]
            points, first = np.frombuffer(b"".join(texts), np.uint32), np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])])
        low = _letters()[points]
        letters = K.sums((low > 0).astype(np.int64), first)
        doc = np.repeat(np.arange(docs), np.diff(first))
        use = letters[doc] > 0
        keep = (low > 0) | np.concatenate([[True], (low[:-1] > 0) | (doc[1:] != doc[:-1])])  # one boundary for a run
        keep &= use
        low, doc = low[keep], doc[keep]
        if not len(low):
            return out, letters
        # a boundary before and after every text
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        stop = np.append(edge[1:], len(doc))
        where = np.concatenate([stop, edge])  # of two at one place, the end of a text comes before the begin of the next
        low, doc = np.insert(low, where, 0), np.insert(doc, where, np.concatenate([doc[edge], doc[edge]]))
        symbols, own = self._index(low)
        size = len(symbols)
        same = doc[2:] == doc[:-2]
        at = doc[2:][same]
        code = ((own[:-2] * size + own[1:-1]) * size + own[2:])[same]
        grams, local = self._index(code, size**3)
        by_gram = np.argsort(local.astype(np.uint16) if len(grams) <= 1 << 16 else local, kind="stable")
        at, local = at[by_gram], local[by_gram]
        vectors = _vectors(symbols, self.dims)
        second, first_ = np.roll(vectors, 1, 1), np.roll(vectors, 2, 1)
        for lo in range(0, len(grams), _GRAMS):
            own_grams = grams[lo : lo + _GRAMS]
            x, y = np.searchsorted(local, (lo, lo + len(own_grams)))
            a, b, c = own_grams // (size * size), own_grams // size % size, own_grams % size
            bound = (first_[a] * second[b] * vectors[c]).astype(np.float32)
            step = max(1, _CELLS // len(own_grams))
            some, row = (np.arange(docs), at[x:y]) if docs <= step else np.unique(at[x:y], return_inverse=True)
            for k in range(0, len(some), step):
                texts, use = some[k : k + step], slice(None) if len(some) <= step else (row >= k) & (row < k + step)
                counts = np.bincount((row[use] - k) * len(own_grams) + local[x:y][use] - lo, minlength=len(texts) * len(own_grams)).astype(np.float32)
                out[texts] += counts.reshape(len(texts), len(own_grams)) @ bound
        return out, letters

    @staticmethod
    def _index(x: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct values in order and each value's place among them; by a table unless it would be large."""
        if (top or 0x110000) > 1 << 25:
            return np.unique(x, return_inverse=True)
        seen = np.zeros(top or 0x110000, bool)
        seen[x] = True
        values = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.int32)
        place[values] = np.arange(len(values))
        return values, place[x].astype(np.int64)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", dims: int = 1024) -> dict[str, np.ndarray]:
    """Prototypes by language, from the rows for which learn holds."""
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t"))

    def bundled(batches):
        total: dict[str, np.ndarray] = {}
        profiles = Profiles(dims)
        for whole in batches:
            for b in K.slices(whole, "t", K.LARGE_CHUNK):
                x, _ = profiles(*K.utf8(b.column(1)))
                names = np.array(b.column(0).to_pylist(), object)
                for name in set(names):
                    total[name] = total.get(name, 0) + x[names == name].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.int64).tolist() for v in total.values()])], names=["l", "v"])

    parts = rows.mapInArrow(K.frees(bundled), "l string, v array<long>").select("l", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("l", "i").agg(F.sum("x").alias("x")).toArrow()
    out: dict[str, np.ndarray] = {}
    for name, i, x in zip(sums["l"].to_pylist(), sums["i"].to_pylist(), sums["x"].to_pylist(), strict=True):
        out.setdefault(name, np.zeros(dims))[i] = x
    return {name: v / norm for name, v in sorted(out.items()) if (norm := np.linalg.norm(v))}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, unless named), lang_pred and score, the cosine (0 if negative); extra columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(prototypes)

    def kernel(buf: np.ndarray, off: np.ndarray) -> dict[str, object]:
        names = list(sent.value)
        if not names:
            return {"lang_pred": pa.array([UNKNOWN] * (len(off) - 1), pa.string()), "score": np.zeros(len(off) - 1)}
        matrix = np.stack([sent.value[n] for n in names])
        x, letters = Profiles(matrix.shape[1])(buf, off)
        x = x.astype(np.float64)
        cosine = x @ matrix.T / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        best = cosine.argmax(1)
        pred = np.array(names, object)[best]
        pred[letters == 0] = UNKNOWN
        score = np.where(letters > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return {"lang_pred": pa.array(pred.tolist(), pa.string()), "score": score}

    return K.map_text(docs, text, [K.field("lang_pred", T.StringType()), K.field("score", T.DoubleType())], kernel, docs.columns if keep is None else keep, limit=K.LARGE_CHUNK)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    return identify(docs, fit(docs, remainder != 0), keep=["doc_id"]).select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score")
