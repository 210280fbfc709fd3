"""Language ID with spans of mixed-language text (operator 6).

Each word gets a score per language: naive Bayes over its byte trigrams and the
word itself, hashed into tables of fixed size.  The scripts that a word is
written in narrow the languages first: one that never (under ``SCRIPT_SHARE``
of its training words) uses a script is no candidate for such a word.  Viterbi
with a penalty for each change of language then labels all words of a text;
runs of one label are its spans, and the language with most letters is the
text's.  Many texts are worked off in step, one word of each at a time.
Letters of any script count: those outside the table of ranges are told from
signs by their code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import textvec as tv
from memlake.plans.names import free_names

U64 = np.uint64
GRAMS = 1 << 15  # slots for trigrams, and as many for words
SCRIPT_SHARE = 0.01
STEP_BYTES = 8 << 20

#: Scripts by the lead byte of UTF-8: first and last byte, bit.
SCRIPT_RANGES = [
    (0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xCA, 0),  # Latin
    (0xCD, 0xCF, 1),  # Greek
    (0xD0, 0xD4, 2),  # Cyrillic
    (0xD5, 0xD5, 3),  # Armenian
    (0xD6, 0xD7, 4),  # Hebrew
    (0xD8, 0xDD, 5),  # Arabic, Syriac
    (0xE0, 0xE0, 6),  # Indic, Thai, Lao
    (0xE1, 0xE1, 7),  # Georgian, Ethiopic, Khmer and others
    (0xE3, 0xE3, 8),  # Kana
    (0xE4, 0xE9, 9),  # Han
    (0xEA, 0xED, 10),  # Hangul
    (0xF0, 0xF4, 11),  # beyond the basic plane
]
SCRIPT = np.zeros(256, np.uint16)
for _first, _last, _bit in SCRIPT_RANGES:
    SCRIPT[_first : _last + 1] = 1 << _bit
SCRIPTS = np.uint16(0xFFF)
#: All other lead bytes: rarer scripts, compatibility forms, and signs.
OTHER = np.uint16(1 << 13)
SCRIPT[0xC2:0xF5][SCRIPT[0xC2:0xF5] == 0] = OTHER
#: Set beside the script's bit for A-Z and a-z.
PLAIN = np.uint16(1 << 12)
SCRIPT[0x41:0x5B] |= PLAIN
SCRIPT[0x61:0x7B] |= PLAIN


def _folded(part: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters."""
    out = tv.LOWER[part]
    if len(out) > 1:
        upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[upper] += 0x20
    return out


def _features(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of trigrams, first trigram of each word, slots of words); a word of n bytes has n trigrams, edges marked."""
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))
    body = part[at].astype(np.uint32)
    before = np.empty_like(body)
    before[1:] = body[:-1]
    before[first] = 1
    after = np.empty_like(body)
    after[:-1] = body[1:]
    after[first + lengths - 1] = 2
    gram = (before << np.uint32(16)) | (body << np.uint32(8)) | after
    gram = ((gram * np.uint32(2654435769)) >> np.uint32(17)).astype(np.int32)
    whole = GRAMS + (tv.word_hashes(part, starts, ends) >> U64(49)).astype(np.int32)
    return gram, first, whole


def _parts(data: np.ndarray, offsets: np.ndarray, low: int, high: int):
    part = _folded(data[offsets[low] : offsets[high]])
    starts, ends, of_row = tv.tokens(part, offsets[low : high + 1] - offsets[low], tv.ALNUM)
    # Each sum runs on to the next word; what lies between words has no script.
    scripts = np.bitwise_or.reduceat(SCRIPT[part], starts) if len(starts) else np.zeros(0, np.uint16)
    known: dict[bytes, bool] = {}
    for i in np.flatnonzero(scripts == OTHER):
        word = part[starts[i] : ends[i]].tobytes()
        if word not in known:
            known[word] = any(c.isalpha() for c in word.decode("utf-8", "replace"))
        if not known[word]:
            scripts[i] = 0
    return part, starts, ends, of_row, scripts


def _count_features(langs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((langs, 2 * GRAMS + 16), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            data, offsets = tv.utf8(batch.column("text"))
            for low, high in tv.slices(offsets):
                part, starts, ends, of_row, scripts = _parts(data, offsets, low, high)
                if not len(starts):
                    continue
                gram, _, whole = _features(part, starts, ends)
                own = np.repeat(label[low:high], np.diff(of_row))
                by_byte = np.repeat(own, ends - starts)
                for lang in np.unique(own):
                    table[lang, : 2 * GRAMS] += np.bincount(gram[by_byte == lang], minlength=2 * GRAMS)
                    table[lang, : 2 * GRAMS] += np.bincount(whole[own == lang], minlength=2 * GRAMS)
                    for bit in range(12):
                        table[lang, 2 * GRAMS + bit] += int((scripts[own == lang] >> bit & 1).sum())
        lang, slot = np.nonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(table[lang, slot])], ["label", "slot", "n"])

    return run


class Model:
    """Languages, log probabilities per slot (2 * GRAMS, languages) and the scripts of each language."""

    def __init__(self, langs: list[str], scores: np.ndarray, scripts: np.ndarray):
        self.langs, self.scores, self.scripts = langs, scores, scripts


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows_per_lang: int = 4000, max_langs: int = 200) -> Model | None:
    """Learn from about ``rows_per_lang`` labelled rows of each language (all, if it has fewer).

    The sample is chosen by a hash of ``key_col`` and the text, so it is the
    same whatever the layout; null and repeated keys are keys as any other.  The
    model is a dense table of 65,536 numbers a language, so more than
    ``max_langs`` labels raise.  Without labelled rows there is no model (None).
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.lit(5), F.col(key_col), F.col(text_col).cast("string")), F.lit(1 << 20)).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(counts)
    if not langs:
        return None
    limits = [int((1 << 20) * min(1.0, rows_per_lang / counts[s])) for s in langs]
    label = F.array_position(F.array(*[F.lit(s) for s in langs]), F.col("lang")).cast("int")
    sample = known.withColumn("label", label - 1).where(F.col("h") < F.element_at(F.array(*[F.lit(x) for x in limits]), label))
    found = (
        sample.select("label", "text").mapInArrow(_count_features(len(langs)), "label int, slot int, n long")
        .groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow())  # at most languages x (2 * GRAMS + 16) rows
    table = np.zeros((len(langs), 2 * GRAMS + 16))
    table[found["label"].to_numpy(), found["slot"].to_numpy()] = found["n"].to_numpy()
    words = table[:, GRAMS : 2 * GRAMS].sum(axis=1, keepdims=True)
    grams = table[:, :GRAMS].sum(axis=1, keepdims=True)
    logs = np.hstack([
        np.log((table[:, :GRAMS] + 0.5) / (grams + 0.5 * GRAMS)), np.log((table[:, GRAMS : 2 * GRAMS] + 0.5) / (words + 0.5 * GRAMS))])
    logs -= logs.mean(axis=0, keepdims=True)
    share = table[:, 2 * GRAMS : 2 * GRAMS + 12] / np.maximum(words, 1)
    scripts = ((share >= SCRIPT_SHARE) << np.arange(12)).sum(axis=1).astype(np.uint16)
    return Model(langs, np.ascontiguousarray(logs.T.astype(np.float32)), scripts)


def _word_scores(model: Model, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    """(words, languages): mean over the trigrams twice plus the word, 0 for words without letters."""
    gram, first, whole = _features(part, starts, ends)
    sums = np.add.reduceat(model.scores[gram], first, axis=0)
    sums *= (2.0 / (ends - starts))[:, None].astype(np.float32)
    sums += model.scores[whole]
    barred = (scripts[:, None] & SCRIPTS & ~model.scripts[None, :]) != 0
    barred &= ~barred.all(axis=1, keepdims=True)
    sums[barred] -= 30.0
    sums[scripts == 0] = 0.0
    return sums


def viterbi(scores: np.ndarray, of_row: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, where each change of label within a row costs ``penalty``."""
    counts = np.diff(of_row)
    order = np.argsort(-counts, kind="stable")
    lengths, begin = counts[order], of_row[:-1][order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
    langs = scores.shape[1]
    stay = np.zeros(scores.shape, bool)
    top = np.zeros(len(scores), np.int16)
    best = np.zeros((len(lengths), langs), np.float32)
    for t in range(steps):
        n = active[t]
        at = begin[:n] + t
        prev = best[:n]
        if t:
            lead = prev.argmax(axis=1)
            most = prev[np.arange(n), lead] - np.float32(penalty)
            keep = prev >= most[:, None]
            stay[at], top[at] = keep, lead
            prev = np.maximum(prev, most[:, None])
            prev -= most[:, None]
        best[:n] = prev + scores[at]
    label = np.zeros(len(scores), np.int16)
    now = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], top[at])
    return label


def _label(model: Model, penalty: float, spans: bool, names: list[str]):
    langs = np.array([*model.langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tv.utf8(batch.column(len(batch.columns) - 1))
            for low, high in tv.slices(offsets, STEP_BYTES):
                base = offsets[low]
                scores, scripts, size, begin, cut = [], [], [], [], [np.zeros(1, np.int64)]
                for a, b in tv.slices(offsets[low : high + 1]):
                    part, starts, ends, of_row, script = _parts(data, offsets, low + a, low + b)
                    if len(starts):
                        scores.append(_word_scores(model, part, starts, ends, script))
                    scripts.append(script)
                    size.append(ends - starts)
                    begin.append(starts + offsets[low + a] - base)
                    cut.append(of_row[1:] + cut[-1][-1])
                of_row = np.concatenate(cut)
                script, size, begin = np.concatenate(scripts), np.concatenate(size), np.concatenate(begin)
                n = high - low
                row = np.repeat(np.arange(n), np.diff(of_row))
                lettered = script != 0
                if len(script):
                    label = viterbi(np.concatenate(scores), of_row, penalty)
                    share = np.bincount((row * len(model.langs) + label)[lettered], size[lettered], n * len(model.langs)).reshape(n, -1)
                else:
                    label, share = np.zeros(0, np.int16), np.zeros((n, len(model.langs)))
                total = share.sum(axis=1)
                pred = np.where(total > 0, share.argmax(axis=1), len(model.langs))
                # Without A-Z, what lies beyond ASCII may be signs only.
                plain = np.bincount(row, weights=(script & PLAIN) != 0, minlength=n)
                for i in np.flatnonzero((total > 0) & (plain == 0)):
                    text = data[offsets[low + i] : offsets[low + i + 1]].tobytes().decode("utf-8", "replace")
                    if not any(c.isalpha() for c in text):
                        pred[i], total[i] = len(model.langs), 0
                score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
                out = [*[c.slice(low, n) for c in batch.columns[:-1]], pa.array(langs[pred], pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
                if spans:
                    out.append(_span_column(of_row, label, begin, size, model.langs))
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], *names])

    return run


def _span_column(of_row: np.ndarray, label: np.ndarray, begin: np.ndarray, size: np.ndarray, langs: list[str]) -> pa.Array:
    """Runs of one label per row: language, first byte and end byte in the text, words."""
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[of_row[:-1][of_row[:-1] < of_row[1:]]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(label)) - 1
    runs = np.searchsorted(first, of_row)
    of_run = np.repeat(np.arange(len(of_row) - 1), np.diff(runs))
    zero = begin[of_row[:-1][of_run]] if len(first) else first  # the row's first word
    parts = [pa.array([langs[i] for i in label[first]], pa.string()), pa.array((begin[first] - zero).astype(np.int64)),
             pa.array((begin[last] + size[last] - zero).astype(np.int64)), pa.array((last - first + 1).astype(np.int64))]
    return pa.ListArray.from_arrays(runs.astype(np.int32), pa.StructArray.from_arrays(parts, ["lang", "start", "end", "words"]))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", penalty: float = 6.0, spans: bool = False,
             pred_col: str = "lang_pred", score_col: str = "score", spans_col: str = "lang_spans") -> DataFrame:
    """``docs`` with the language of each whole text, its share of the letters (0 to 1) and, if asked, its spans.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text when ``model`` is None (nothing to learn from); letters of any script
    make a text lettered.  Of languages with equal letters the first in
    alphabetical order wins.  Each row is judged by its whole text alone, so
    repeated rows and null ids are as any other; long texts take memory of a few
    hundred bytes a word.  Spans count bytes from the text's first word.
    Columns of these names are replaced, all others pass through, whatever
    their names; an empty table gives an empty result.
    """
    new = [pred_col, score_col, *[spans_col] * spans]
    docs = docs.drop(*new)
    kind = "array<struct<lang:string,start:bigint,end:bigint,words:bigint>>"
    if model is None:
        docs = docs.withColumn(pred_col, F.lit("und")).withColumn(score_col, F.lit(0.0))
        return docs.withColumn(spans_col, F.array().cast(kind)) if spans else docs
    (text,) = free_names(docs, "__text")
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], f"`{pred_col}` string", f"`{score_col}` double", *[f"`{spans_col}` {kind}"] * spans])
    return docs.withColumn(text, F.col(text_col).cast("string")).mapInArrow(_label(model, penalty, spans, new), shape)
