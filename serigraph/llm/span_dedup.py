"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serigraph.llm._common import CHUNK_BYTES, checkpoint, mixed, record_batch, shared_folder, text_chunks
from serigraph.llm._words import powers, words_of

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[ord(c) for c in "\"')]"]] = True
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def least_of_windows(h: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
    """Whether the hash of each word is the least in some window of consecutive words of the same number in of."""
    out = np.zeros(len(h), bool)
    n = len(h) - window + 1
    if n < 1:
        return out
    least = h[:n].copy()
    for k in range(1, window):
        np.minimum(least, h[k : n + k], out=least)
    whole = of[:n] == of[window - 1 :]
    for k in range(window):
        out[k : n + k] |= whole & (least == h[k : n + k])
    return out


@dataclass
class Sentences:
    """Sentences of some texts, those of text i from first[i] on: first and past-last word, hash, whether a sentence (and no later piece of one) starts."""

    begin: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    word_start: np.ndarray  # byte offsets in the joined texts


def sentences(texts: list[bytes], longest: int) -> Sentences:
    """A sentence ends at a word that ends in . ! or ? (quotes and brackets may follow), before a line break, and with the text.

    One of more than longest words, as in text without stops, is cut into pieces after each word whose hash is the least of
    a window of so many words of it: no piece is longer, and a passage has the same pieces wherever it stands, but at its ends.
    """
    words = words_of(texts)
    n = len(words.start)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.zeros(n, bool)
    if n:
        final = words.end - 1
        ends = _STOPS[data[final]] | (_CLOSERS[data[final]] & (final > words.start) & _STOPS[data[final - 1]])
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        following = np.append(words.start[1:], len(data))
        ends |= breaks[following] > breaks[words.end]
        last = words.first[1:] - 1
        ends[last[last >= words.first[:-1]]] = True
    of = np.cumsum(ends) - ends
    starts = np.concatenate([[True], ends[:-1]]) if n else ends
    long = np.bincount(of)[of] > longest if n else ends
    ends[long] |= least_of_windows(words.hash[long], of[long], longest)
    stop = np.flatnonzero(ends) + 1
    begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    # a hash that depends on the words and their order in the sentence only
    h = np.zeros(len(stop), np.uint64)
    if len(stop):
        place = np.arange(n) - np.repeat(begin, stop - begin)
        h = mixed(np.add.reduceat(words.hash * powers(int(place.max()) + 1, _STEP)[place], begin))
    return Sentences(begin, stop, h, starts[begin], np.searchsorted(begin, words.first), words.start)


def runs_of(s: Sentences, a: int, b: int, sentences_: int, words_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (from a on) and hash of the runs of one text, whose pieces are a to b, in order of start: each of sentences_ whole
    sentences; from each piece, and to the end of each sentence, the shortest that has as many pieces and words_ words."""
    begin, stop, h = s.begin[a:b], s.stop[a:b], s.hash[a:b]
    n = len(h)
    every = np.arange(n)
    end = np.maximum(np.searchsorted(stop, begin + words_, side="left") + 1, every + sentences_)
    first = np.flatnonzero(s.starts[a:b])
    ends = np.append(first[1:], n)[: len(first)]
    back = np.minimum(np.searchsorted(begin, stop[ends - 1] - words_, side="right") - 1, ends - sentences_)
    starts = np.concatenate([every[end <= n], first[: max(0, len(first) - sentences_ + 1)], back[back >= 0]])
    stops = np.concatenate([end[end <= n], ends[sentences_ - 1 :], ends[back >= 0]])
    both = np.unique(starts * (n + 1) + stops)
    starts, stops = both // (n + 1), both % (n + 1)
    # the sum of h[i + k] * _STEP ** k over the run, as a difference of sums from the start of the text
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(n, _STEP))])
    return starts, stops, mixed((sums[stops] - sums[starts]) * powers(n, _BACK)[starts] + (stops - starts).astype(np.uint64))


RUNS = "doc_id long, h long"


def _runs(docs: DataFrame, sentences_: int, words_: int, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in text_chunks(batch.column("text")):
                s = sentences(texts, longest)
                found: list[list] = [[], []]
                for i in range(len(texts)):
                    *_, key = runs_of(s, s.first[i], s.first[i + 1], sentences_, words_)
                    own = np.unique(key).view(np.int64)
                    found[0].append(np.full(len(own), ids[first + i]))
                    found[1].append(own)
                yield record_batch({"doc_id": (np.concatenate(found[0]), pa.int64()), "h": (np.concatenate(found[1]), pa.int64())})

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, RUNS)


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which is smaller than a checkpoint of it; it stays there for whoever reads the result."""
    path = f"{shared_folder(df.sparkSession)}/runs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated(s: Sentences, a: int, b: int, cut: list[int] | None, sentences_: int, words_: int, giant: int) -> list[tuple[int, int]]:
    """Stretches of pieces a to b, those of one text, to be removed: cut has the keys of runs whose first place is another text."""
    start, end, key = runs_of(s, a, b, sentences_, words_)
    again = np.ones(len(start), bool)
    again[np.unique(key, return_index=True)[1]] = False  # the first place in this text
    if cut:
        again |= np.isin(key.view(np.int64), np.array(cut, np.int64))
    cover = np.zeros(b - a + 1, np.int64)
    np.add.at(cover, start[again], 1)
    np.add.at(cover, end[again], -1)
    covered = cover.cumsum()[:-1] > 0
    if not covered.any():
        return []
    first = np.flatnonzero(s.starts[a:b])
    length = np.diff(np.append(first, b - a))
    words = np.append(s.begin[a:b][first[1:]], s.stop[b - 1]) - s.begin[a:b][first]
    goes = np.repeat((np.add.reduceat(covered, first, dtype=np.int64) == length) | (words > giant), length) & covered
    edge = np.flatnonzero(np.diff(goes.astype(np.int8), prepend=0, append=0)) + a
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, sentences_: int = 3, words_: int = 25, longest: int = 12, giant: int = 50) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, n_words_removed, removed) for every row of docs (doc_id, text).

    Every run of sentences_ consecutive sentences, however short, is hashed and joined over all documents. The first place
    of a run, by doc_id and position, stays; sentences covered by runs at any other place are removed, with the white space
    after them. So that a passage is found too where other text runs into its first and last sentence, sentences of more than
    longest words also count by pieces, of which a run has as many and words_ words at least: with the defaults every
    repeated passage of over 50 words holds one. Pieces alone are removed only inside sentences of more than giant words, such as text
    without stops; of a shorter sentence all is covered, or it stays.

    n_sentences and n_removed count pieces, which are sentences up to longest words. removed: the byte spans taken out,
    start:end, comma-joined. Rows that repeat a doc_id are versions of one document: what they share stays in each. Null ids take
    no part; null text stays null, with no sentences. Very long texts are read and compared whole. An empty table gives an
    empty one. Other columns are dropped.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = _written(_runs(rows, sentences_, words_, longest))
    repeats = runs.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc").drop("last_doc")
    # a table of its own, so that a run that very many documents hold can be split among tasks
    flagged = runs.join(checkpoint(repeats), "h").where("doc_id <> first_doc").groupBy("doc_id").agg(F.collect_set("h").alias("cut"))  # at most the document's own runs

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = batch.column("doc_id"), batch.column("cut").to_pylist()
            for first, texts in text_chunks(batch.column("text"), CHUNK_BYTES):
                s = sentences(texts, longest)
                base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                out, count, gone, gone_words, told = [], [], [], [], []
                for i, text in enumerate(texts):
                    a, b = int(s.first[i]), int(s.first[i + 1])
                    kept, holes, at, n, n_words = [], [], 0, 0, 0
                    for low, high in repeated(s, a, b, cuts[first + i], sentences_, words_, giant):
                        start = int(s.word_start[s.begin[low]] - base[i])
                        stop = int(s.word_start[s.begin[high]] - base[i]) if high < b else len(text)
                        kept.append(text[at:start])
                        holes.append(f"{start}:{stop}")
                        at, n, n_words = stop, n + high - low, n_words + int(s.stop[high - 1] - s.begin[low])
                    kept.append(text[at:])
                    valid = batch.column("text")[first + i].is_valid
                    out.append(b"".join(kept).decode() if valid else None)
                    count.append(b - a)
                    gone.append(n)
                    gone_words.append(n_words)
                    told.append(",".join(holes))
                yield record_batch({
                    "doc_id": (ids.slice(first, len(texts)), pa.int64()), "text": (out, pa.string()), "n_sentences": (count, pa.int64()),
                    "n_removed": (gone, pa.int64()), "n_words_removed": (gone_words, pa.int64()), "removed": (told, pa.string()),
                })

    schema = "doc_id long, text string, n_sentences long, n_removed long, n_words_removed long, removed string"
    return rows.join(flagged, "doc_id", "left").mapInArrow(clean, schema)
