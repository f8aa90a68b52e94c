"""Language identification by a bit-sliced Bloom filter of character n-grams.

Every slot of the filter holds a mask with a bit for each language. The masks at an n-gram's slots,
combined by AND, are the languages whose training text holds the n-gram (and a known share of false
positives). A document's n-grams are counted by language, the counts are corrected for the false
positives, and the highest one decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, mix, rows, stored, table

#: An n-gram is a language's if it has at least this part of its highest share in any language: training texts
#: quote other languages, and without the bound each language would soon hold the n-grams of all (see README).
MIN_RATIO = 0.1
#: Slots are as many as the language with most n-grams asks for, but 2 to these powers at least and at most; a
#: fuller filter has more false positives, which are measured and corrected for.
HASHES, BITS_PER_GRAM, LEAST_SLOTS, MOST_SLOTS, PARTS = 4, 16, 10, 22, 64
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20
_SALTS = mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams around each letter of lower-cased texts, other characters as 0, and their text's number."""
    lower = [t.lower() for t in texts]
    joined = "\0\0".join(lower) + "\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.int64)
    before = np.concatenate(([0], codes[:-1]))
    after = np.concatenate((codes[1:], [0]))
    at = np.flatnonzero(codes)
    owner = np.searchsorted(np.cumsum([len(t) + 2 for t in lower]), at, "right")
    return before[at] << 42 | codes[at] << 21 | after[at], owner


def parts(values: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts with up to `most` characters; a longer text is a run of its own."""
    lo, size = 0, 0
    for k, t in enumerate(values):
        n = len(t or "")
        if k > lo and size + n > most:
            yield lo, k
            lo, size = k, 0
        size += n
    if values:
        yield lo, len(values)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, held) over all rows of (text, lang), summed in each task before they move."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("held", pa.int64())])

    def merged(pile: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in pile]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in pile]), len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piles: dict[str, list] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = [texts[k] or "" for k in np.flatnonzero(langs == lang)]
                for lo, hi in parts(own):
                    pile = piles.setdefault(lang, [])
                    pile.append(np.unique(grams(own[lo:hi])[0], return_counts=True))
                    if len(pile) >= 16:
                        piles[lang] = [merged(pile)]
        for lang, pile in piles.items():
            keys, held = merged(pile)
            yield rows(schema, np.full(len(keys), lang, object), keys, held)

    return labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, held long").groupBy("lang", "gram").agg(F.sum("held").alias("held"))


@dataclass
class LanguageFilter:
    """masks: a row of 64-bit words for each slot. rates: each language's share of false positives."""

    langs: list[str]
    masks: np.ndarray
    rates: np.ndarray

    @classmethod
    def of(cls, langs: list[str], masks: np.ndarray) -> LanguageFilter:
        """The common language, which unknown text gets, is first."""
        filled = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
        return cls(langs, masks, filled**HASHES)

    @staticmethod
    def _slots(g: np.ndarray, salt: np.uint64, slots: int) -> np.ndarray:
        x = g.astype(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * salt
        return ((x ^ (x >> np.uint64(32))) * salt >> np.uint64(64 - int(slots).bit_length() + 1)).astype(np.int64)

    def containing(self, g: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of the languages that hold it."""
        out = self.masks[self._slots(g, _SALTS[0], len(self.masks))]
        for salt in _SALTS[1:]:
            out &= self.masks[self._slots(g, salt, len(self.masks))]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of n-grams and, by language, of those held, less the expected false ones."""
        g, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts))
        masks = self.containing(g)
        held = np.stack([np.bincount(owner, ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(float), len(texts)) for k in range(len(self.langs))], 1)
        return total, np.maximum(0, (held - total[:, None] * self.rates) / np.maximum(1e-9, 1 - self.rates))


def slots_for(most: int) -> int:
    return 1 << min(MOST_SLOTS, max(LEAST_SLOTS, int(np.ceil(np.log2(max(1, most) * BITS_PER_GRAM)))))


def bit_sliced(members: DataFrame, langs: int, slots: int) -> np.ndarray:
    """The masks from (number of a language, n-gram): tasks merge the bits of each slot, the driver gets the filter alone."""
    schema = pa.schema([("slot", pa.int64()), ("number", pa.int32())])
    width = slots // PARTS

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, g = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield rows(schema, np.concatenate([LanguageFilter._slots(g, salt, slots) for salt in _SALTS]), np.tile(number, HASHES))

    def merged(t):
        masks = np.zeros((width, -(-langs // 64)), np.uint64)
        slot, number = t.column("slot").to_numpy() % width, t.column("number").to_numpy()
        np.bitwise_or.at(masks, (slot, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
        return pa.table({"part": t.column("part")[:1], "masks": pa.array([masks.tobytes()], pa.binary())})

    bits = members.select("number", "gram").mapInArrow(placed, "slot long, number int").distinct()
    out = np.zeros((PARTS, width, -(-langs // 64)), np.uint64)
    for r in bits.withColumn("part", F.expr(f"cast(slot div {width} as int)")).groupBy("part").applyInArrow(merged, "part int, masks binary").collect():
        out[r.part] = np.frombuffer(r.masks, np.uint64).reshape(width, -1)
    return out.reshape(slots, -1)


def learn(labelled: DataFrame) -> LanguageFilter | None:
    """The filter from (text, lang); rows without a language don't count. None without any n-gram.

    The list of languages must fit the driver, and the filter (2^22 slots of 8 bytes for each 64
    languages at most); n-grams never reach it.
    """
    counts = stored(gram_counts(labelled.where("lang is not null")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("held").alias("total")).collect()
    if not totals:
        return None
    langs = [r.lang for r in sorted(totals, key=lambda r: (-r.total, r.lang))]
    total = {r.lang: r.total for r in totals}
    plan = labelled.sparkSession.createDataFrame([(k, lang, total[lang]) for k, lang in enumerate(langs)], "number int, lang string, total long")
    share = counts.join(plan, "lang").withColumn("share", F.col("held") / F.col("total"))
    members = share.withColumn("highest", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= MIN_RATIO * F.col("highest"))
    members = stored(members.select("number", "gram"), "members")
    most = members.groupBy("number").count().agg(F.max("count")).first()[0]
    return LanguageFilter.of(langs, bit_sliced(members, len(langs), slots_for(most)))


def identify_languages(docs: DataFrame, model: LanguageFilter | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score): the language with the highest corrected count; score is its share of the text's n-grams.

    A null text, one without a letter, and any text without a model is und with score 0. A text
    with letters but no known n-gram gets the commonest language with score 0. Ties go to the
    commoner language. Rows are judged one by one, repeated ones too.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # 2^MOST_SLOTS slots at most
    own = [f for f in docs.select(id_col, *keep).schema]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for lo, hi in parts(texts) if known else ():
                total, held = known.counts([t or "" for t in texts[lo:hi]])
                best = held.argmax(1)
                some = total > 0
                pred[lo:hi][some] = np.array(known.langs, object)[best[some]]
                score[lo:hi][some] = np.clip(held[np.arange(len(best)), best][some] / total[some], 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return docs.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{types}, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    return identify_languages(docs, learn(docs.where(~F.col("held_out"))), keep=("held_out",))
