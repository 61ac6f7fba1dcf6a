"""Line-first cleaning: rules per line, failing lines go, then documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.words import Words, chunks, utf8
from pathweave.session import ship_package

#: A document goes if more than this share of its words stood in failing lines.
MAX_LOSS = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOL = re.compile(r"[#*$%&|<>]")
_NAVIGATION = re.compile(r"[|»›•→]|::|&gt;")
_BOILERPLATE = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie|enable javascript|lorem ipsum"
    r"|click here|subscribe|sign (?:in|up)|log ?in\b|released under the|licensed under|copyright ©",
    re.IGNORECASE,
)


def line_rule(line: str) -> str | None:
    """The first rule that a line fails: symbols, navigation, shouting, punctuation, repeats or
    boilerplate; None if it passes."""
    words = line.split()
    n = len(words)
    if len(_SYMBOL.findall(line)) > 0.5 * n:
        return "navigation" if n and len(_NAVIGATION.findall(line)) > 0.25 * n else "symbols"
    if n >= 3 and len(_NAVIGATION.findall(line)) > 0.25 * n:
        return "navigation"
    if n >= 3 and 2 * line.count("!!") > n:
        return "punctuation"
    if n >= 5 and line.isupper():
        return "shouting"
    if n >= 10 and len(set(words)) < 0.3 * n:
        return "repeats"
    if n <= 12 and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """The text without failing and repeated lines; lines equal to an earlier one, lines
    removed, and words removed."""
    seen: set[str] = set()
    kept, dup, gone, lost = [], 0, 0, 0
    for line in text.split("\n"):
        # a line of white space alone is no line with a word
        if not (bare := line.strip(" \t\n\r\x0b\x0c")):
            kept.append(line)
            continue
        if line in seen:
            dup += 1
        elif line_rule(bare) is None:
            seen.add(line)
            kept.append(line)
            continue
        seen.add(line)
        gone += 1
        lost += len(bare.split())
    return "\n".join(kept), dup, gone, lost


def _repeat_words(words: Words) -> np.ndarray:
    """Per text, the words that stand in a window found twice or more in it."""
    n_texts = len(words.first) - 1
    hashes, place = words.windows(WINDOW)
    if not len(hashes):
        return np.zeros(n_texts, np.int64)
    text = np.searchsorted(words.first, place, side="right") - 1
    keyed = hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(keyed), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, place[twice], 1)
    np.add.at(step, place[twice] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
    return inside[words.first[1:]] - inside[words.first[:-1]]


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_removed long, n_words_removed long, base_failed boolean, kept boolean, clean_text string"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _measure(column: pa.Array, with_text: bool) -> list[pa.Array]:
    data, offsets = utf8(column)
    words = Words(data, offsets, lower=False)
    n_words = np.diff(words.first)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    # a code point begins at any byte that does not continue one
    chars = count(((data & 0xC0) != 0x80) & ~np.isin(data, np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)))
    repeat = _repeat_words(words)
    cleaned = [clean_lines(t) for t in column.to_pylist()]
    removed = np.array([c[3] for c in cleaned], dtype=np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (removed <= MAX_LOSS * n_words)
    longs = [n_words, chars, count(_IS_SYMBOL[data]), np.array([c[1] for c in cleaned]), repeat, np.array([c[2] for c in cleaned]), removed]
    return [pa.array(x.astype(np.int64)) for x in longs] + [pa.array(failed), pa.array(kept), pa.array([c[0] if with_text else None for c in cleaned], pa.string())]


def line_quality(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Measure and judge every row of ``docs`` (``doc_id``, ``text``) by its whole text.

    Returns ``_row`` (a struct of the row's columns but ``text``, whatever their names) and the
    columns of ``METRICS``; ``clean_text`` is the text without its failing lines (null if not
    ``with_text``).  Null and empty texts have no words and fail.  Repeated rows are judged
    alike, each for itself; an empty table gives an empty result.  One piece of about 1 MB of
    text, or one longer text, is in memory at a time.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["_row"], *T.StructType.fromDDL(METRICS).fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_measure(batch.column(1), with_text)], names)

    ship_package(source.sparkSession)
    return source.mapInArrow(run, schema)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; ``text`` is the cleaned text and
    ``n_chars`` (if there is one) its length."""
    judged = line_quality(docs).where("kept")
    columns = [F.col("clean_text").alias(c) if c == "text" else F.length("clean_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return judged.select(*columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_quality(docs, with_text=False)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed", "base_failed", "kept")
