"""Language identification: words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word backs off:
to the mean over those of its character n-grams (with marks at both ends) of the
longest order of which any is known, then to the next shorter order.

A word is a run of letters in lower case; a run of over ``RUN`` letters counts
as several words of that many, in training as in scoring. Words and n-grams are
64-bit hashes, so the model is two arrays of numbers, and texts are scored by
array operations on a bounded amount of text at a time: nothing is remembered
from one text to the next, and a task's memory does not grow with the input.

Training counts every word and n-gram of a bounded sample of labelled rows (of
each language about ``sample`` rows and ``chars`` characters at most, chosen by a
hash of the id). The sample bounds the model, and only the model reaches the
driver. Texts are scored whole.

Defined results: null text and text without a letter are ``und`` with score 0;
so is everything if there is no labelled row; null labels and null ids are not
learned from; ties go to the first language by name; repeated rows give a row
each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released
from .spans import hashes, rolling, within

#: Training rows and characters of a language; longest n-gram.
SAMPLE, CHARS, LONGEST = 4_000, 8_000_000, 4
#: Of a known word's probability in languages that do not have it.
FLOOR = 0.1
UNKNOWN = "und"
#: Letters of a word; characters worked on at a time (a multiple of RUN); counts that a training task gathers.
RUN, PART, FOUND = 256, 1 << 18, 1 << 20
#: Numbers of the marks at a word's ends, beyond all characters.
FIRST, LAST = 0x110000, 0x110001


@dataclass
class Model:
    """langs in order of name; sorted hashes of words and n-grams; for each its log probability by language."""

    langs: list[str]
    keys: object
    logs: object
    longest: int = LONGEST


def held_out(doc: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc.cast("string")) % 4 == 2, F.lit(False))


@functools.cache
def _letters():
    """Whether each code point is a letter."""
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), "?", 0x110000)


def _cut(text: str) -> Iterator[str]:
    """Parts of at most PART characters; words are cut only as RUN says."""
    at, n = 0, len(text)
    while n - at > PART:
        end = at + PART
        while end > at and text[end - 1].isalpha():
            end -= 1
        if end == at:
            end = at + PART
        yield text[at:end]
        at = end
    yield text[at:]


def _parts(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts with the texts' numbers, about PART characters at a time."""
    numbers, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in _cut(t or ""):
            if size + len(part) > PART and parts:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part.lower())
            size += len(part)
    if parts:
        yield numbers, parts


def _words(parts: list[str]):
    """(codes, starts, ends, part): the words of the parts."""
    import numpy as np

    codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    on = np.zeros(len(codes) + 2, "i1")
    on[1:-1] = _letters()[codes]
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) and int((ends - starts).max()) > RUN:
        many = -(-(ends - starts) // RUN)
        stop, nth = np.repeat(ends, many), np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(starts, many) + nth * RUN
        ends = np.minimum(starts + RUN, stop)
    sizes = np.fromiter(map(len, parts), "i8", len(parts))
    return codes, starts, ends, np.searchsorted(np.cumsum(sizes + 1), starts, side="right")


def _marked(codes, starts, ends):
    """(sums, starts, ends): the words' letters between marks, one after the other."""
    import numpy as np

    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), "u4")
    out[first], out[first + sizes - 1] = FIRST, LAST
    inside = np.ones(len(out), "?")
    inside[first] = inside[first + sizes - 1] = False
    out[inside] = codes[within(starts, sizes - 2)]
    return rolling(out), first, first + sizes


def _grams(sums, starts, ends, k: int):
    """(hashes, word, sizes): the n-grams of order k of marked words, the word of each, and how many each word has."""
    import numpy as np

    n = np.maximum(ends - starts - k + 1, 0)
    word = np.repeat(np.arange(len(starts)), n)
    at = within(starts, n)
    return hashes(sums, at, at + k, k), word, n


def _counts(parts: list[str], longest: int):
    """(kind, key, n): every word and n-gram of the parts, and how often it occurs."""
    import numpy as np

    codes, starts, ends, _ = _words(parts)
    keys, at, n = np.unique(hashes(rolling(codes), starts, ends, 0), return_index=True, return_counts=True)
    out = [(np.zeros(len(keys), "i4"), keys, n)]
    sums, first, last = _marked(codes, starts[at], ends[at])
    for k in range(1, longest + 1):
        h, word, _ = _grams(sums, first, last, k)
        keys, where = np.unique(h, return_inverse=True)
        out.append((np.full(len(keys), k, "i4"), keys, np.bincount(where, weights=n[word], minlength=len(keys)).astype("i8")))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, chars: int = CHARS, longest: int = LONGEST) -> Model:
    """Learns from the rows of docs with text, label and id."""
    import numpy as np

    rows = docs.select(F.col(doc).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("x")).where("id is not null and lang is not null and x is not null")
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)), F.sum(F.length("x"))).collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, "u8"), np.zeros((0, 0), "f4"), longest)
    grain = 1 << 20
    shares = {k: min(grain, max(1, sample * grain // n), max(1, chars * grain // max(1, size))) for k, (n, size) in sizes.items()}
    table = F.create_map(*(F.lit(x) for n, k in enumerate(langs) for x in (k, (n << 24) + shares[k])))
    code = F.element_at(table, F.col("lang"))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(grain)) < code.bitwiseAND(F.lit((1 << 24) - 1))).select(F.shiftright(code, 24).cast("int").alias("lang"), "x")

    def count(batches):
        import pyarrow as pa

        def out(lang, found):
            kind, key, n = (np.concatenate(c) for c in zip(*found, strict=True))
            key, first, where = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(key)).astype("i8")
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang, "i4")), pa.array(kind[first]), pa.array(key.view("i8")), pa.array(n)], names=["lang", "kind", "key", "n"])

        found: dict[int, list] = {}
        for b in batches:
            by = b.column("lang").to_numpy()
            for lang in np.unique(by).tolist():
                for _, parts in _parts(b.column("x")[i].as_py() for i in np.flatnonzero(by == lang)):
                    found.setdefault(lang, []).append(_counts(parts, longest))
                    if sum(len(x[0]) for x in found[lang]) > FOUND:
                        yield out(lang, found.pop(lang))
        for lang, x in found.items():
            yield out(lang, x)

    counts = some.mapInArrow(released(count), "lang int, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # bounded by the sample
    lang_of, kind_of, n = (got.column(c).to_numpy() for c in ("lang", "kind", "n"))
    keys, first, at = np.unique(got.column("key").to_numpy().view("u8"), return_index=True, return_inverse=True)
    totals = np.maximum(1, np.bincount(kind_of * len(langs) + lang_of, weights=n, minlength=(longest + 1) * len(langs)).reshape(-1, len(langs)))
    share = np.zeros((len(keys), len(langs)))
    share[at, lang_of] = n / totals[kind_of, lang_of]
    floor = np.minimum(FLOOR * share.max(axis=1, initial=0.0)[:, None], 0.5 / totals[kind_of[first]])
    return Model(langs, keys, np.log(np.where(share > 0, share, floor)).astype("f4"), longest)


def _found(model: Model, h):
    """(place, known): of hashes in the model."""
    import numpy as np

    if not len(model.keys):
        return np.zeros(len(h), "i8"), np.zeros(len(h), "?")
    at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
    return at, model.keys[at] == h


def _vectors(model: Model, codes, starts, ends, keys):
    """Log probabilities of words by language: their own, else the mean over known n-grams of the longest order that has any, else zero."""
    import numpy as np

    at, known = _found(model, keys)
    out = model.logs[at].astype("f8")
    rest = np.flatnonzero(~known)
    out[rest] = 0
    if len(rest):
        sums, first, last = _marked(codes, starts[rest], ends[rest])
    for k in range(model.longest, 0, -1):
        if not len(rest):
            break
        h, word, _ = _grams(sums, first, last, k)
        at, known = _found(model, h)
        word, at = word[known], at[known]
        n = np.bincount(word, minlength=len(rest))
        some = n > 0
        for g in range(len(model.langs)):
            out[rest[some], g] = (np.bincount(word, weights=model.logs[at, g], minlength=len(rest)) / np.maximum(n, 1))[some]
        rest, first, last = rest[~some], first[~some], last[~some]
    return out - out.max(axis=1, keepdims=True)


def predictions(model: Model, texts: Iterable[str | None], n: int):
    """(best, score): the number of the language of each of n texts (-1: none), and its posterior probability."""
    import numpy as np

    total, many = np.zeros((n, max(1, len(model.langs)))), np.zeros(n, "i8")
    for numbers, parts in _parts(texts) if model.langs else ():
        codes, starts, ends, part = _words(parts)
        if not len(starts):
            continue
        keys, at, where = np.unique(hashes(rolling(codes), starts, ends, 0), return_index=True, return_inverse=True)
        v, of = _vectors(model, codes, starts[at], ends[at], keys), np.array(numbers)[part]
        lo, hi = numbers[0], numbers[-1] + 1
        many[lo:hi] += np.bincount(of - lo, minlength=hi - lo)
        for g in range(len(model.langs)):
            total[lo:hi, g] += np.bincount(of - lo, weights=v[where, g], minlength=hi - lo)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    best = np.where(many > 0, p.argmax(axis=1), -1)
    return best, np.where(many > 0, p.max(axis=1) / p.sum(axis=1), 0.0)


def identify(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang_pred, score): score is the posterior probability of the language, languages being equal beforehand."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        names = pa.array([*sent.value.langs, UNKNOWN], pa.string())
        for b in batches:
            best, score = predictions(sent.value, (t.as_py() for t in b.column("x")), len(b))
            best[best < 0] = len(names) - 1
            yield pa.RecordBatch.from_arrays([b.column("doc"), names.take(pa.array(best)), pa.array(score)], names=["doc", "lang_pred", "score"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("x")).mapInArrow(released(run), f"doc {kind}, lang_pred string, score double").toDF(doc, "lang_pred", "score")


def known_language(docs: DataFrame, model: Model, least: float = 0.5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text has a language with at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            best, score = predictions(sent.value, (t.as_py() for t in b.column(text)), len(b))
            yield b.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(released(run), docs.schema)
