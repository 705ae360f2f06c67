"""Language identification by rank-order profiles of character n-grams.

A language's profile is its PROFILE most frequent n-grams (1 to 3 letters, with word edges) over all training texts;
a text's is the same over the text. The prediction is the language with the smallest out-of-place distance: the sum
of differences in rank, with PROFILE for n-grams that the language's profile lacks.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language first in code
point order, those of n-grams to the smaller code; null languages teach nothing; with no language learned all texts
are `und`; repeated rows count each time; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm import textkernel as tk
from quarrymill.llm.packing import runs

PROFILE = 400
UNKNOWN = "und"
#: Texts taken together, so that an index fits above a 50-bit n-gram.
MOST_TEXTS = 1 << 13
#: Distinct n-grams that a training task holds before it sends its sums.
HELD = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code of each letter, 0 for all other code points."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0 between words and texts) and the text of each position."""
    raw = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    # a code point's first byte is where UTF-8 has no continuation
    begins = np.cumsum((raw & 0xC0) != 0x80)
    ends = np.concatenate([[0], begins])[offsets]
    letters = _letters()[points]
    # a gap after each text
    n = np.diff(ends)
    text = np.repeat(np.arange(len(n)), n)
    spaced = np.zeros(len(letters) + len(n) + 1, np.uint64)
    spaced[1 + np.arange(len(letters)) + text] = letters
    of = np.concatenate([[0], np.repeat(np.arange(len(n)), n + 1)])
    return spaced, of


#: The first slot of a pair's number where letters need 21 bits: no code point.
_NONE = np.uint64(0x1FFFFF)


def _grams(letters: np.ndarray, of: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of 1 to 3 letters as numbers, and their texts. Edges of words count, gaps do not.

    Numbers are below 2 ** 50 (16 bits a letter) unless a letter lies beyond the basic plane (far: there are some), and
    from 2 ** 63 on (21 bits a letter) if one does.
    """
    some = letters != 0
    sixteen, tag = np.uint64(16), np.uint64(48)
    one = np.flatnonzero(some)
    two = np.flatnonzero(some[:-1] | some[1:])
    three = np.flatnonzero(some[1:-1])
    codes = [
        letters[one] | (np.uint64(1) << tag),
        letters[two] << sixteen | letters[two + 1] | (np.uint64(2) << tag),
        letters[three] << np.uint64(32) | letters[three + 1] << sixteen | letters[three + 2] | (np.uint64(3) << tag),
    ]
    if far:
        high = letters > 0xFFFF
        for k, (code, at) in enumerate(zip(codes, (one, two, three), strict=True), 1):
            where = np.flatnonzero(np.logical_or.reduce([high[at + i] for i in range(k)]))
            wide = np.full(len(where), (np.uint64(1) << np.uint64(63)) | (_NONE << np.uint64(42) if k == 2 else np.uint64(0)))
            for i in range(k):
                wide |= letters[at[where] + i] << np.uint64(21 * (k - 1 - i))
            code[where] = wide
    # the letter, not the gap before it, tells the text
    texts = [of[one], np.where(some[two], of[two], of[np.minimum(two + 1, len(of) - 1)]), of[three + 1]]
    return np.concatenate(codes), np.concatenate(texts)


def _counts(data: np.ndarray, offsets: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text or its key, n-gram, count), by key and n-gram."""
    letters, of = _codes(data, offsets)
    beyond = bool(letters.max(initial=0) > 0xFFFF)
    grams, texts = _grams(letters, of, beyond)
    owner = texts if key is None else key[texts]
    if beyond:  # the few with letters beyond the basic plane are counted apart
        far = np.flatnonzero(grams >> np.uint64(50))
        apart = np.lexsort((grams[far], owner[far]))
        far_owner, far_grams = owner[far][apart], grams[far][apart]
        at = np.flatnonzero(np.append(True, (far_owner[1:] != far_owner[:-1]) | (far_grams[1:] != far_grams[:-1])))
        rest = np.delete(np.arange(len(grams)), far)
        owner, grams, far_n = owner[rest], grams[rest], np.diff(np.append(at, len(far_grams)))
        far_owner, far_grams = far_owner[at], far_grams[at]
    packed = np.sort(owner.astype(np.uint64) << np.uint64(50) | grams)
    at, n = runs(packed)
    packed = packed[at]
    owner, grams = (packed >> np.uint64(50)).astype(np.int64), packed & np.uint64((1 << 50) - 1)
    if not beyond:
        return owner, grams, n
    owner, grams, n = np.concatenate([owner, far_owner]).astype(np.int64), np.concatenate([grams, far_grams]), np.concatenate([n, far_n])
    order = np.lexsort((grams, owner))
    return owner[order], grams[order], n[order]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for rows, data, offsets in tk.chunks(batch):
        for k in range(0, len(offsets) - 1, MOST_TEXTS):
            cut = offsets[k : k + MOST_TEXTS + 1]
            yield slice(rows.start + k, rows.start + k + len(cut) - 1), data, cut


def train(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the languages in docs (text, lang): their most frequent n-grams, most frequent first.

    All texts are counted, by task and then by Spark; only profiles (size n-grams a language) reach the driver and are
    sent to tasks: 3 KB a language, so the number of different `lang` values bounds them, not that of texts.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n_held = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(total)], ["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column("lang").cast(pa.string()).to_numpy(zero_copy_only=False)
            for rows, data, offsets in _chunks(batch):
                names, key = np.unique(langs[rows].astype(str), return_inverse=True)
                owner, grams, n = _counts(data, offsets, key)
                for i, name in enumerate(names):
                    mine = owner == i
                    held.setdefault(str(name), []).append((grams[mine], n[mine]))
                n_held += len(grams)
                if n_held > HELD:
                    yield from send()
                    held, n_held = {}, 0
        yield from send()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(sums, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    top = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "rank").collect():
        found.setdefault(r.lang, []).append((r.rank, r.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for k, v in sorted(found.items())}


def distances(data: np.ndarray, offsets: np.ndarray, profiles: dict[str, np.ndarray], size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text (row) to each language (column), and the length of each text's profile."""
    n_texts = len(offsets) - 1
    text, grams, n = _counts(data, offsets)
    order = np.lexsort((grams, -n, text))
    text, grams = text[order], grams[order]
    first = np.searchsorted(text, np.arange(n_texts + 1))
    rank = np.arange(len(text)) - first[text]
    top = rank < size
    text, grams, rank = text[top], grams[top], rank[top]
    out = np.zeros((n_texts, len(profiles)))
    for j, profile in enumerate(profiles.values()):
        by_gram = np.argsort(profile)
        known = profile[by_gram]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        away = np.where(known[at] == grams, np.abs(by_gram[at] - rank), size)
        out[:, j] = np.bincount(text, away, n_texts)
    return out, np.bincount(text, minlength=n_texts)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """The `keep` columns of docs, lang_pred and score: how much nearer the language is than the next, 0 to 1."""
    names = list(profiles)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for _, data, offsets in _chunks(batch):
                if not names:
                    pred += [UNKNOWN] * (len(offsets) - 1)
                    score += [0.0] * (len(offsets) - 1)
                    continue
                far, n = distances(data, offsets, profiles, size)
                best = far.argmin(axis=1)
                near = np.sort(far, axis=1)
                other = near[:, 1] if len(names) > 1 else np.maximum(1, n * size)
                sure = np.where(n > 0, (other - near[:, 0]) / np.maximum(1, other), 0.0)
                pred += [names[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
                score += np.clip(sure, 0.0, 1.0).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(modulus: int = 4, rest: int = 2):
    """Whether a document is kept from training: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    profiles = train(marked.where("NOT held_out"))
    return predict(marked, profiles, ("doc_id", "held_out"))
