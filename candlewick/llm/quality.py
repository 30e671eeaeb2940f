"""Quality rules, and lines that many documents of a host repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import saved, texts
from candlewick.llm.textkit import Words, ids, mix, slices, windows, within

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "host bigint, body bigint, line_keys array<bigint>, line_words array<int>")


def repeated_words(words: Words, hashes: np.ndarray, k: int = 8) -> np.ndarray:
    """Words per text that lie in a ``k``-word window found twice or more in that text."""
    at = within(words, k)
    n_docs = len(words.off) - 1
    if not len(at):
        return np.zeros(n_docs, np.int64)
    key = windows(hashes, k)[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    return np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def _lines(text: bytes) -> tuple[int, dict[bytes, int]]:
    """Repeated lines with a word, and words per distinct normalised line
    (A-Z in lower case, blanks to one space, trimmed), all its occurrences together."""
    seen: set[bytes] = set()
    again, found = 0, {}
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        again += line in seen
        seen.add(line)
        name = b" ".join(parts).lower()
        found[name] = found.get(name, 0) + len(parts)
    return again, found


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        column = batch.column(1)
        doc_ids, hosts = ids(batch), batch.column(2).to_pylist()
        for lo, hi, data, off in slices(column):
            words = Words(data, off)
            hashes = words.hashes()
            inside = np.concatenate([[0], np.cumsum(~words.blank & ((data & 0xC0) != 0x80))])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
            raw = data.tobytes()
            again, keys, sizes, bodies = [], [], [], []
            for i in range(hi - lo):
                text = raw[off[i]:off[i + 1]]
                dup, found = _lines(text)
                again.append(dup)
                host = (hosts[lo + i] or "").encode()
                keys.append([xxhash.xxh64_intdigest(host + b"\n" + x) - (1 << 63) for x in found])
                sizes.append(list(found.values()))
                bodies.append(xxhash.xxh64_intdigest(text) - (1 << 63))
            yield pa.record_batch([
                pa.array(doc_ids[lo:hi]), pa.array(words.counts()), pa.array(np.diff(inside[off])), pa.array(np.diff(symbols[off])),
                pa.array(again, pa.int64()), pa.array(repeated_words(words, hashes)),
                pa.array([xxhash.xxh64_intdigest((h or "").encode()) - (1 << 63) for h in hosts[lo:hi]], pa.int64()),
                pa.array(bodies, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "host", "body", "line_keys", "line_words"])


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 20, max_share: float = 0.02,
                  min_words: int = 20, min_left: float = 0.3) -> DataFrame:
    """Rule measures of each document and whether it is kept.

    Lines are normalised and hashed with their host; a line is boilerplate if
    more than ``min_docs`` different texts of the host have it and more than
    ``max_share`` of the host's different texts (exact copies count as one text,
    so a text is not boilerplate for being copied).  Boilerplate lines are
    removed; a document left with fewer than ``min_words`` words or less than
    ``min_left`` of its words is rejected, as is one that fails the base rules
    (under 20 words, or over 30 % of the words in repeated 8-word windows).

    Needs ``doc_id`` (integer), ``text`` and the host column; a null text is
    empty, a null host is the host "", rows without doc_id are left out and other
    columns are ignored.
    Repeated rows are measured one by one and give equal rows.  An empty table
    gives an empty result.  Lines are counted by (host, line), never by host
    alone, and counts are combined before the shuffle.
    """
    docs = texts(docs, F.col(host).cast("string").alias("host"))
    measured = saved(docs.mapInArrow(measure, MEASURES))
    lines = measured.select("doc_id", "host", "body", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select(
        "doc_id", "host", "body", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words"))
    sizes = measured.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counts = lines.select("line", "host", "body").distinct().groupBy("line", "host").agg(F.count("*").alias("n"))
    common = (counts.filter(F.col("n") > min_docs).join(sizes, "host")
              .filter(F.col("n") > F.col("texts") * F.lit(max_share)).select("line"))
    removed = lines.join(common, "line").groupBy("doc_id").agg(F.sum("words").alias("gone"))
    # repeated rows of one document share its sum: bring it back to one row's
    copies = measured.groupBy("doc_id").agg(F.count("*").alias("copies"))
    removed = removed.join(copies, "doc_id").select("doc_id", (F.col("gone") / F.col("copies")).cast("long").alias("gone"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return measured.join(removed, "doc_id", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_boilerplate_words"),
        failed.alias("base_failed"), (~failed & (left >= min_words) & (left >= F.col("n_words") * F.lit(min_left))).alias("kept"))
