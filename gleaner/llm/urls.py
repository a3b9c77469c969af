"""URL filters: rules first, else host words and naive Bayes.

Host labels and path parts are split into words: a unigram Viterbi over word counts of the
pages' own text splits concatenated names, with a cost that grows with length for pieces that are no known word. Multinomial
naive Bayes over those words, fitted on the URLs that the rules decide, judges all other URLs. Each class's shares of
tokens are drawn towards those of both together, so a class of few URLs says little and neither is preferred for its size. A number
is a token of its first digit and its length.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.textvec import LOWER, spans, stretches, text_chunks
from gleaner.session import materialise

BLOCK = 5_000  # rows that are segmented with one set of word counts
STEM = 20  # letters of a word that are looked up; longer words by their first ones, then compared whole
MAX_INLINE_RULES = 256  # beyond, rules are joined
TOKEN_BITS = 18
SHRINK = 100.0  # tokens that a class is thought to share with both together before any is seen
KEPT = 256  # letters of a name, bytes of a path part, whose result is kept for the next one
HELD_PARTS = 200_000  # stretches of names that a task holds before it passes them on
NUMBER = "#"
_RUNS = re.compile(r"([^\W\d_]+)|(\d+)")


OUTSIDE = np.ones(256, bool)  # bytes that end a word
OUTSIDE[65:91] = OUTSIDE[97:123] = False


class Segmenter:
    """Unigram Viterbi over words with counts. An unknown stretch of ``n`` letters costs as a word of probability 10 / (total * 10**n)."""

    def __init__(self, words: Sequence[str], counts: Sequence[int], total: int | None = None):
        total = max(sum(counts) if total is None else total, 1)
        self.__setstate__((math.log10(total), {w: math.log10(c) - math.log10(total) for w, c in zip(words, counts, strict=True)}))

    def __getstate__(self) -> tuple:
        return self.total, self.log

    def __setstate__(self, state: tuple) -> None:
        self.total, self.log = state
        self.long: dict[str, list[str]] = {}
        for word in sorted(w for w in self.log if len(w) > STEM):
            self.long.setdefault(word[:STEM], []).append(word)
        self._short = lru_cache(1 << 16)(self._split)

    def split(self, name: str) -> tuple[str, ...]:
        """The words of a run of letters; those of short ones are kept."""
        return self._short(name) if len(name) <= KEPT else self._split(name)

    def _split(self, name: str) -> tuple[str, ...]:
        """An unknown stretch is one piece at any length: what it costs is kept with the best place for it to begin. 12 bytes for each letter."""
        n = len(name)
        best, came = array("d", [-math.inf]) * (n + 1), array("i", bytes(4 * (n + 1)))
        best[0] = 0.0
        opened, since = -math.inf, 0  # best of best[start] + start, and that start
        for end in range(n + 1):
            if end:
                value = opened + 1 - self.total - end
                if value > best[end]:
                    best[end], came[end] = value, since
            here = best[end]
            if here + end > opened:
                opened, since = here + end, end
            stem = name[end : end + STEM]
            for size in range(1, len(stem) + 1):
                log = self.log.get(stem[:size])
                if log is not None and here + log > best[end + size]:
                    best[end + size], came[end + size] = here + log, end
            for word in self.long.get(stem, ()) if self.long else ():
                if name.startswith(word, end) and here + self.log[word] > best[end + len(word)]:
                    best[end + len(word)], came[end + len(word)] = here + self.log[word], end
        out, end = [], n
        while end:
            out.append(name[came[end] : end])
            end = came[end]
        return tuple(reversed(out))

    def tokens(self, text: str) -> list[str]:
        """The words of a host or path: letters are segmented, numbers are a token each, all else parts."""
        out = []
        for name in names(text):
            out += [name] if name[0] == NUMBER else self.split(name)
        return out


def names(text: str) -> list[str]:
    """The runs of letters of a host or path, lower-cased, and for a run of digits ``#``, its first digit and its length."""
    runs = _RUNS.findall(text.lower())
    return [f"{NUMBER}{digits[0]}{len(digits)}" if digits else letters for letters, digits in runs]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = np.zeros(256, bool)
    letters[97:123] = True
    parts, held = [], 0

    def out(parts):
        both = pd.concat(parts).groupby("word", as_index=False).sum()
        return pa.RecordBatch.from_arrays([pa.array(both["word"], pa.string()), pa.array(both["n"])], ["word", "n"])

    for batch in batches:
        for _, _, whole, cuts in text_chunks(batch.column(0)):
            shown_before = True  # at the cut of a long text: the nearest bracket before is none or a closing one
            for first, last in stretches(whole, OUTSIDE) if len(cuts) == 2 else [(0, len(whole))]:
                buf, offsets = whole[first:last], cuts if len(cuts) > 2 else np.array([0, last - first])
                inside, place = LOWER[buf], np.arange(len(buf), dtype=np.int32)
                mark = np.maximum.accumulate(np.where((buf == 60) | (buf == 62), place, -1))
                shown = np.where(mark < 0, shown_before, buf[mark] == 62)
                if len(cuts) > 2 and len(buf):
                    begin = np.repeat(offsets[:-1], np.diff(offsets))
                    shown |= mark < begin  # brackets of an earlier row say nothing
                shown_before = bool(shown[-1]) if len(shown) else True
                starts, ends, _ = spans(letters[inside] & shown, offsets)
                ok = ends - starts >= 2
                starts, ends = starts[ok], ends[ok]
                if not len(starts):
                    continue
                size = ends - starts
                at = np.cumsum(size) - size
                flat = inside[np.repeat(starts - at, size) + np.arange(int(size.sum()))]
                words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(at, size.sum()).astype(np.int32)), pa.py_buffer(flat))
                got = pc.value_counts(words)
                parts.append(pd.DataFrame({"word": got.field(0).to_pandas(), "n": got.field(1).to_numpy()}))
                held += len(got)
                if held > 500_000:
                    yield out(parts)
                    parts, held = [], 0
    if parts:
        yield out(parts)


def word_counts(df: DataFrame, text_col: str = "html") -> DataFrame:
    """``word, n`` over all texts of a column: runs of two or more ASCII letters outside of tags, lower-cased, of any length."""
    counted = df.select(df[text_col].cast("string").alias("text")).mapInArrow(_count_batches, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What words of each block's names may begin with: all stretches of 2 to ``STEM`` letters, and the longest name that holds each. The same stretch may come again."""
    parts: dict[tuple[int, str], int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.string()), pa.array(parts.values(), pa.int32())], ["block", "stem", "room"])
        parts.clear()
        return out

    for batch in batches:
        seen: set[tuple[int, str]] = set()
        for block, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for name in (name for text in texts for name in names(text or "")):
                if len(name) <= KEPT:
                    if (block, name) in seen:
                        continue
                    seen.add((block, name))
                n = len(name)
                for i in range(n - 1):
                    for j in range(i + 2, min(i + STEM, n) + 1):
                        key = (block, name[i:j])
                        parts[key] = max(parts.get(key, 0), n - i)
                    if len(parts) > HELD_PARTS:
                        yield flush()
    yield flush()


def segmented(pages: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``words`` (the segmented host) and ``slots`` (the hashed tokens of host and path) to written rows with ``host`` and ``path``.

    All words of ``counts`` (``word, n``, written) and their exact total count: rows are dealt to blocks, and each
    block gets the counts of all words that its names may hold.
    """
    columns = pages.columns
    total = counts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-pages.count() // block))
    dealt = pages.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))  # equal rows are dealt too
    parts = dealt.select("__block", "host", "path").mapInArrow(_part_batches, "block long, stem string, room int").groupBy("block", "stem").agg(F.max("room").alias("room"))
    stems = counts.select("word", "n", F.substring("word", 1, STEM).alias("stem"))
    known = parts.join(stems, "stem").where(F.length("word") <= F.col("room")).where((F.length("word") > STEM) | (F.col("word") == F.col("stem")))
    known = known.select(F.col("block").alias("__block"), "word", "n")
    h, p = columns.index("host"), columns.index("path")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        split = Segmenter(right.column("word").to_pylist(), right.column("n").to_pylist(), total)
        slots, named = _slots(split), lambda host: " ".join(split.tokens(host))
        own = left.select(columns)
        hosts, paths = own.column(h).to_pylist(), own.column(p).to_pylist()
        lists = [slots(a or "", b or "") for a, b in zip(hosts, paths, strict=True)]
        return own.append_column("words", pa.array([named(a or "") for a in hosts], pa.string())).append_column("slots", pa.array(lists, pa.list_(pa.int32())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return materialise(dealt.groupBy("__block").cogroup(known.groupBy("__block")).applyInArrow(run, f"{fields}, words string, slots array<int>"), "urls-segmented")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lowered; path: then up to ``?``, ``#`` or end. Else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Rule(NamedTuple):
    text: str
    verdict: str


def inline_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or null; of equally long ones the smaller text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        own_host, slash, rest = rule.text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def match_rules(pages: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Add ``rule`` and ``verdict`` to rows with ``host`` and ``path``: the longest rule ``host/path`` that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's. Up to 256 rules are tested in
    place; a longer list or a DataFrame (``rule, verdict``) is joined by host suffix, once for each distinct host and path.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_INLINE_RULES:
        return pages.withColumn("__m", inline_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("__m.rule"), "verdict": F.col("__m.verdict")}).drop("__m")
    table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame([tuple(r) for r in rules], "rule string, verdict string")
    table = table.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = pages.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    best = (
        asked.join(table, "suffix")
        .where(F.startswith("path", F.col("start")))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct((-F.length("rule")).alias("a"), F.col("rule").alias("b"))).alias("m"))
        .select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))
    )
    return pages.join(best, (pages["host"] == best["__h"]) & (pages["path"] == best["__p"]), "left").drop("__h", "__p")


def _slot(token: str) -> int:
    h = 1469598103934665603
    for b in token.encode():
        h = (h ^ b) * 1099511628211 & (1 << 64) - 1
    return (h ^ h >> 32) & (1 << TOKEN_BITS) - 1


def _slots(split: Segmenter):
    kept = lru_cache(1 << 17)(_slot)
    slot = lambda token: kept(token) if len(token) <= KEPT else _slot(token)
    whole = lambda text: tuple(slot(t) for t in split.tokens(text))
    short = lru_cache(1 << 16)(whole)
    of = lambda text: short(text) if len(text) <= KEPT else whole(text)

    def run(host: str, path: str) -> list[int]:
        return [*of(host), *(s for part in path.split("/") for s in of(part))]

    return run


class Model(NamedTuple):
    """For each hashed token log P(token | block) - log P(token | allow), and the same of the classes."""

    weights: np.ndarray
    prior: float


def _train_batches(split: Segmenter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots(split)
        found = {"block": np.zeros(1 << TOKEN_BITS, np.int64), "allow": np.zeros(1 << TOKEN_BITS, np.int64)}
        for batch in batches:
            for host, path, verdict in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                np.add.at(found[verdict], slots(host, path), 1)
        for verdict, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["verdict", "slot", "n"])

    return run


def fit(decided: DataFrame, split: Segmenter | None = None, shrink: float = SHRINK, prior: float = 0.0) -> Model:
    """Multinomial naive Bayes over all rows of ``host, path, verdict``, or without ``split`` of ``slots, verdict`` (see ``segmented``). Counts are summed on executors; at most two tables of 2**18 numbers come back.

    A class's probability of a token is its own share, drawn towards the share in both classes together as if ``shrink`` more
    tokens had been seen: a token that neither has, and every token while one class has no rows, says nothing. ``prior``: log odds of block; by default the classes are equally
    likely, as the shares of rows that rules decide tell nothing about the others.
    """
    if split is None:
        counts = decided.select("verdict", F.explode("slots").alias("slot")).groupBy("verdict", "slot").agg(F.count("*").alias("n"))
    else:
        counts = decided.select("host", "path", "verdict").mapInArrow(_train_batches(split), "verdict string, slot long, n long")
    got = counts.groupBy("verdict", "slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    found = np.zeros((2, 1 << TOKEN_BITS))
    for i, verdict in enumerate(("block", "allow")):
        own = got[got["verdict"] == verdict]
        found[i, own["slot"].to_numpy(np.int64)] = own["n"]
    sizes, both = found.sum(1), found.sum(0)
    if not sizes.all():
        return Model(np.zeros(1 << TOKEN_BITS, np.float32), prior)
    seen = np.flatnonzero(both)
    shares = (found[:, seen] + shrink * both[seen] / both.sum()) / (sizes + shrink)[:, None]
    weights = np.zeros(1 << TOKEN_BITS, np.float32)
    weights[seen] = np.log(shares[0] / shares[1])
    return Model(weights, prior)


def judge(pages: DataFrame, model: Model) -> DataFrame:
    """Put ``block_score`` (log odds of block) in place of the ``slots`` of rows from ``segmented``."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    kept = pages.drop("slots").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("slots")
            sizes = np.diff(lists.offsets.to_numpy())
            weights = held.value.weights[lists.flatten().to_numpy()]
            score = np.bincount(np.repeat(np.arange(len(lists)), sizes), weights, minlength=len(lists)) + held.value.prior
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "block_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.drop("slots").schema)
    return pages.mapInArrow(run, f"{fields}, block_score double")


def _prepared(df: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    host, path = host_and_path(df[url_col].cast("string"))
    pages = match_rules(df.select(df[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path")), rules)
    return segmented(materialise(pages, "urls-pages"), materialise(word_counts(df, text_col), "urls-words"))


def filter_urls(df: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, words, block_score`` for every row.

    ``verdict`` is the rule's, or ``block`` where the log odds are above 0, else ``allow``. Null URLs and such without
    ``://`` have an empty host and path, no rule and the verdict of the classes alone. Null ids and repeated rows stay; URLs and texts of any
    length are read whole; other columns are not read. An empty table gives an empty result.
    """
    pages = _prepared(df, rules, id_col, url_col, text_col)
    judged = judge(pages, fit(pages.where("verdict is not null")))
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") > 0, "block").otherwise("allow")))


def accuracy(df: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", parts: int = 5) -> DataFrame:
    """``verdict, n, right``: how the method, fitted on the other rows that rules decide, judges one of ``parts`` of them, by the rule's verdict."""
    pages = _prepared(df, rules, id_col, url_col, text_col).where("verdict is not null")
    held = F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == 0
    judged = judge(pages.where(held), fit(pages.where(~held)))
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if((F.col("block_score") > 0) == (F.col("verdict") == "block")).alias("right"))
