"""Language identification with a linear-chain conditional random field over words.

A word is a run of ASCII letters or bytes of longer UTF-8 sequences, lower-cased. Its
features are its affixes of one to four bytes, the byte trigrams and 4-grams of the word with
its edges, the word itself, and the language whose lexicon lists it; all but the lexicon are
hashed into one table. Labels of neighbouring words are tied by learned
transitions, and forward-backward gives every word its marginal probabilities. A
document's language is the one with the largest share of its words.

Training sequences are made of pieces of several training documents, so that transitions
between languages occur and are learned. Everything runs on many words in lockstep: a
chunk of texts is one long sequence cut into lanes, whose transfer matrices join
them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.llm.textvec import CHUNK_BYTES, IS_LETTER, IS_SPACE, LOWER, crc32_text, prefix_hash, span_hash, spans, stretches, text_chunks
from gleaner.session import materialise

MAX_TRAIN_DOCS = 3000  # documents that the model is fitted on, at most
MAX_TRAIN_BYTES = 1_000_000  # and their text together (besides the shortest of a language without one that fits)
MAX_LABELS = 128  # languages to learn; more are an error, as the tables grow with them
TABLE_BITS = 16
LANE = 128
PIECE = 32  # words of one document in a row in a training sequence
LEXICON_COUNT, LEXICON_SHARE = 3, 0.8
EPOCHS = 24
UNKNOWN = "und"

_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(16)]
_GRAM = np.uint64(0xD6E8FEB86659FD93)


class Model(NamedTuple):
    """Languages, feature weights (table rows, then one row a language for its lexicon, then zeros), transitions, lexicon."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_lang: np.ndarray


def _lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals lowered, in place of the same bytes."""
    low = LOWER[buf]
    if len(low) > 1:
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[at] += 0x20
    return low


class Words(NamedTuple):
    """The words of a chunk and their hashed features: ``fixed`` (one id for each word and kind) and n-grams by position."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    word: np.ndarray
    fixed: list[np.ndarray]
    grams: list[np.ndarray]


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    low = _lowered(buf)
    inside = IS_LETTER[buf]
    starts, ends, row = spans(inside, offsets)
    h = prefix_hash(low)
    shift = np.uint64(64 - TABLE_BITS)
    word = span_hash(h, starts, ends)
    fixed = [(word * _SALT[0] >> shift).astype(np.int32)]
    for k in range(1, 5):
        fixed.append((span_hash(h, starts, np.minimum(starts + k, ends)) * _SALT[k] >> shift).astype(np.int32))
        fixed.append((span_hash(h, np.maximum(ends - k, starts), ends) * _SALT[4 + k] >> shift).astype(np.int32))
    wide = np.full(len(buf) + 5, 32, np.uint32)
    wide[1 : len(buf) + 1] = np.where(inside, low, 32)
    gram3 = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    gram4 = gram3[:-1] | wide[3:] << np.uint32(24)
    # position p is the gram that starts one byte before byte p
    grams = [(g[: len(buf)].astype(np.uint64) * (_GRAM ^ _SALT[9 + i]) >> shift).astype(np.int32) for i, g in enumerate((gram3, gram4))]
    return Words(starts, ends, row, word, fixed, grams)


def emissions(w: Words, model: Model) -> np.ndarray:
    """Feature scores of each word and language (float32)."""
    table, n_langs = model.weights, len(model.langs)
    out = np.zeros((len(w.starts), n_langs), np.float32)
    for ids in w.fixed:
        out += table[ids]
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, w.word), len(model.lexicon) - 1)
        hit = model.lexicon[at] == w.word
        out += table[np.where(hit, (1 << TABLE_BITS) + model.lexicon_lang[at], (1 << TABLE_BITS) + n_langs)]
    for extra, ids in enumerate(w.grams):
        for lang in range(n_langs):
            total = np.zeros(len(ids) + 1)
            np.cumsum(table[:, lang][ids], out=total[1:])
            last = np.maximum(w.ends - extra, w.starts + 1)
            out[:, lang] += total[last] - total[w.starts]
    return out


class _Lanes:
    """A run of words cut into lanes of equal length: factors, where sequences begin, and the steps at which the last lane has no more words."""

    def __init__(self, e: np.ndarray, first: np.ndarray, transitions: np.ndarray):
        self.n, self.k = e.shape
        self.lanes = -(-self.n // LANE)
        self.rest = self.n - (self.lanes - 1) * LANE
        f, begin = np.ones((self.lanes * LANE, self.k), np.float32), np.zeros(self.lanes * LANE, bool)
        f[: self.n] = np.exp(e - e.max(1, keepdims=True))
        begin[: self.n] = first
        self.f, begin = (np.ascontiguousarray(x.reshape(self.lanes, LANE, *x.shape[1:]).swapaxes(0, 1)) for x in (f, begin))
        self.t = np.exp(transitions - transitions.max()).astype(np.float32)
        self.broken = [np.flatnonzero(x) for x in begin]

    def step(self, s: int, m: np.ndarray, nxt: np.ndarray, fresh: np.ndarray | float) -> np.ndarray:
        """``nxt`` with sequences that begin at step ``s`` set to ``fresh`` and, past the last word, the last lane as it was in ``m``."""
        if len(self.broken[s]):
            nxt[self.broken[s]] = fresh
        if s >= self.rest:
            nxt[-1] = m[-1]
        return nxt

    def products(self) -> np.ndarray:
        """What each lane makes of a message, as a matrix for each lane."""
        through = np.broadcast_to(np.eye(self.k, dtype=np.float32), (self.lanes, self.k, self.k)).copy()
        for s in range(LANE):
            nxt = through @ self.t
            if len(self.broken[s]):
                nxt[self.broken[s]] = through[self.broken[s]].sum(2, keepdims=True)
            nxt *= self.f[s][:, None, :]
            through = self.step(s, through, nxt, nxt[self.broken[s]])
            through /= through.sum((1, 2), keepdims=True)
        return through


def carried(e: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """What a run of words makes of a message from before it, as one matrix (up to a factor)."""
    out = np.eye(e.shape[1], dtype=np.float32)
    if len(e):
        for m in _Lanes(e, first, transitions).products():
            out = out @ m
            out /= out.sum()
    return out


def marginals(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each label at each word of a row of sequences, by forward-backward.

    ``e``: log scores (words, labels). ``first``: which words begin a sequence. The words are cut into
    lanes of equal length; products of transfer matrices carry the messages over the cuts. ``enter`` and ``leave`` are the messages
    from before and behind, where the words are a stretch of a longer run.
    """
    n, k = e.shape
    if not n:
        return e
    if enter is None:
        first = first.copy()
        first[0] = True
    run = _Lanes(e, first, transitions)
    f, t, lanes = run.f, run.t, run.lanes
    through = run.products()
    ins, outs = np.ones((lanes, k), np.float32), np.ones((lanes, k), np.float32)
    if enter is not None:
        ins[0] = enter
    if leave is not None:
        outs[-1] = leave
    for i in range(1, lanes):
        v = ins[i - 1] @ through[i - 1]
        ins[i] = v / v.sum()
    for i in range(lanes - 2, -1, -1):
        v = through[i + 1] @ outs[i + 1]
        outs[i] = v / v.sum()

    alpha, a = np.empty_like(f), ins
    for s in range(LANE):
        nxt = a @ t
        if len(run.broken[s]):
            nxt[run.broken[s]] = 1.0
        nxt *= f[s]
        a = run.step(s, a, nxt, nxt[run.broken[s]])
        a /= a.sum(1, keepdims=True)
        alpha[s] = a
    b = outs
    for s in range(LANE - 1, -1, -1):
        alpha[s] *= b
        b = run.step(s, b, (b * f[s]) @ t.T, 1.0)
        b /= b.sum(1, keepdims=True)
    alpha /= alpha.sum(2, keepdims=True)
    return alpha.swapaxes(0, 1).reshape(-1, k)[:n]


def _pairs(e: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (steps, sequences, labels) and expected transitions of training sequences of equal length."""
    steps, n, k = e.shape
    f = np.exp(e - e.max(2, keepdims=True))
    et = np.exp(t - t.max())
    alpha, beta = np.empty_like(f), np.ones_like(f)
    a = f[0] / f[0].sum(1, keepdims=True)
    alpha[0] = a
    for s in range(1, steps):
        a = (a @ et) * f[s]
        a /= a.sum(1, keepdims=True)
        alpha[s] = a
    for s in range(steps - 2, -1, -1):
        b = (beta[s + 1] * f[s + 1] * mask[s + 1][:, None] + (1 - mask[s + 1][:, None])) @ et.T
        beta[s] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    ahead = f[1:] * beta[1:]
    total = np.einsum("sbj,sbj->sb", alpha[:-1] @ et, ahead)
    return post, np.einsum("sbi,sbj->ij", alpha[:-1] * (mask[1:] / total)[:, :, None], ahead) * et


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> Model:
    """Fit the model on whole texts by Adam over the exact gradient of the regularised log-likelihood."""
    names = sorted(set(langs))
    k = len(names)
    empty = Model(names, np.zeros(((1 << TABLE_BITS) + k + 1, k), np.float32), np.zeros((k, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    (chunk,) = text_chunks(pa.array(texts, pa.string()), 1 << 62) if texts else [(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    w = words_of(chunk[2], chunk[3])
    n = len(w.starts)
    if not n or k < 2:
        return empty
    label = np.array([names.index(x) for x in langs])[w.row]
    _, inverse = np.unique(w.word, return_inverse=True)
    unique = np.unique(w.word)
    by = np.zeros((len(unique), k))
    np.add.at(by, (inverse, label), 1)
    total = by.sum(1)
    listed = (total >= LEXICON_COUNT) & (by.max(1) >= LEXICON_SHARE * total)
    lexicon, lexicon_lang = unique[listed], by[listed].argmax(1)

    # sequences of LANE words: pieces of PIECE words, dealt by their hash
    first = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=len(texts)))])[:-1]
    piece = np.arange(n) - first[w.row]
    piece = np.cumsum(piece % PIECE == 0) - 1
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    order = np.argsort(w.word[starts] * _SALT[3], kind="stable")
    size = np.diff(np.concatenate([starts, [n]]))[order]
    line = np.repeat(starts[order] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(n)
    seqs = -(-n // LANE)
    at = np.full(seqs * LANE, -1)
    at[:n] = line
    at = at.reshape(seqs, LANE).T
    mask = (at >= 0).astype(np.float64)

    found = np.searchsorted(lexicon, w.word).clip(0, max(len(lexicon) - 1, 0)) if len(lexicon) else np.zeros(n, np.int64)
    hit = (lexicon[found] == w.word) if len(lexicon) else np.zeros(n, bool)
    lex = np.where(hit, (1 << TABLE_BITS) + lexicon_lang[found], (1 << TABLE_BITS) + k) if len(lexicon) else np.full(n, (1 << TABLE_BITS) + k)
    counts = [np.maximum(w.ends - extra, w.starts + 1) - w.starts for extra in range(len(w.grams))]
    lengths = sum(counts) + len(w.fixed) + 1
    edges = np.cumsum(lengths) - lengths
    ids = np.empty(int(lengths.sum()), np.int32)
    for i, own in enumerate([*w.fixed, lex]):
        ids[edges + i] = own
    at_gram = edges + len(w.fixed) + 1
    for g, count in zip(w.grams, counts, strict=True):
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        ids[np.repeat(at_gram, count) + inside] = g[np.repeat(w.starts, count) + inside]
        at_gram = at_gram + count
    rows = (1 << TABLE_BITS) + k + 1
    gold = np.zeros((n, k))
    gold[np.arange(n), label] = 1
    gold_t = np.zeros((k, k))
    ok = (at[1:] >= 0) & (at[:-1] >= 0)
    np.add.at(gold_t, (label[at[:-1][ok]], label[at[1:][ok]]), 1)
    weights, trans = np.zeros((rows, k), np.float32), np.zeros((k, k))
    m, v = np.zeros((rows, k)), np.zeros((rows, k))
    mt, vt = np.zeros((k, k)), np.zeros((k, k))
    for step in range(1, epochs + 1):
        e = np.stack([np.add.reduceat(weights[:, j][ids], edges) for j in range(k)], 1)
        post, joint = _pairs(np.where(mask[:, :, None] > 0, e[at], 0), mask, trans)
        diff = gold.copy()
        diff[at[at >= 0]] -= post[at >= 0]
        grad = np.stack([np.bincount(ids, np.repeat(diff[:, j], lengths), rows) for j in range(k)], 1) / n - 1e-6 * weights
        grad[-1] = 0
        grad_t = (gold_t - joint) / n
        for g, p, m1, v1, rate in ((grad, weights, m, v, 0.1), (grad_t, trans, mt, vt, 0.2)):
            m1 += 0.1 * (g - m1)
            v1 += 0.01 * (g * g - v1)
            p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-8)
    return Model(names, weights, trans, lexicon, lexicon_lang)


def fit(df: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Fit on at most ``max_docs`` rows of ``train_col`` with ``max_bytes`` of text, all languages alike: of each language the texts that
    hash lowest, taken in turns. A text that does not fit is passed over; a language left without a text gets its shortest one with a letter,
    whatever its length. Only hashes and lengths are ranked; the texts taken are then read whole."""
    src = df.where(df[train_col] & df[text_col].isNotNull() & df[lang_col].isNotNull())
    src = src.select(src[text_col].cast("string").alias("text"), src[lang_col].cast("string").alias("lang"))
    key = F.xxhash64("text", "lang")
    keys = materialise(src.select("lang", key.alias("key"), F.octet_length("text").alias("size"), F.col("text").rlike(r"\p{L}").alias("letter")).dropDuplicates(["key"]), "crf-keys")
    least = F.min(F.when(F.col("letter"), F.struct("size", "key"))).alias("least")
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"), least).orderBy(F.desc("n"), "lang").limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages to learn")
    each = max(1, max_docs // max(len(counts), 1))
    below = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, (1 << 65) * each // r["n"])) for r in counts]  # twice as many hashes as are needed
    near = keys.join(F.broadcast(df.sparkSession.createDataFrame(below, "lang string, top long")), "lang").where("key <= top")
    turn = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    ranked = near.withColumn("turn", turn).where(F.col("turn") <= each).orderBy("turn", "lang").limit(max_docs).collect()
    total, taken, met = 0, [], set()
    for r in ranked:
        if total + r["size"] > max_bytes:
            continue
        total += r["size"]
        taken.append((r["key"],))
        if r["letter"]:
            met.add(r["lang"])
    taken += [(r["least"]["key"],) for r in counts if r["least"] is not None and r["lang"] not in met]
    chosen = df.sparkSession.createDataFrame(taken, "key long")  # max_docs rows at most
    rows = src.withColumn("key", key).join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"]).orderBy("key").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def _no_letter(text: bytes) -> bool:
    return not any(map(str.isalpha, text.decode("utf-8", "ignore")))


def _shares(buf: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their marginals, each row's share of every language, and which rows have a letter."""
    n, k = len(offsets) - 1, len(model.langs)
    w = words_of(buf, offsets)
    count = np.bincount(w.row, minlength=n)
    first = np.concatenate([[True], w.row[1:] != w.row[:-1]]) if len(w.row) else np.zeros(0, bool)
    post = marginals(emissions(w, model), first, model.transitions)
    shares = np.zeros((n, k))
    has = np.flatnonzero(count)
    if len(has):
        shares[has] = np.add.reduceat(post.astype(np.float64), np.flatnonzero(first), 0) / count[has][:, None]
    ascii_letter = np.zeros(n, bool)
    plain = (buf < 128) & IS_LETTER[buf]
    ascii_letter[np.searchsorted(offsets, np.flatnonzero(plain), "right") - 1] = True
    letter = ascii_letter.copy()
    for i in np.flatnonzero(~ascii_letter & (count > 0)):
        letter[i] = not _no_letter(buf[offsets[i] : offsets[i + 1]].tobytes())
    return w, post, shares, letter


def _long_share(buf: np.ndarray, model: Model) -> tuple[np.ndarray, bool]:
    """The share of every language in one long text, and whether it has a letter: a stretch at a time, first what each stretch makes of a
    message, then its marginals between the messages from both sides. The same as in one piece."""
    cuts = list(stretches(buf, IS_SPACE))

    def scores(i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = cuts[i]
        e = emissions(words_of(buf[a:b], np.array([0, b - a])), model)
        return e, np.zeros(len(e), bool)

    k, letter = len(model.langs), any(not _no_letter(buf[a:b].tobytes()) for a, b in cuts)
    products = [carried(*scores(i), model.transitions) for i in range(len(cuts))]
    leave = [np.ones(k, np.float32)]
    for m in reversed(products[1:]):
        v = m @ leave[-1]
        leave.append(v / v.sum())
    enter, total, count = None, np.zeros(k), 0
    for i, back in enumerate(reversed(leave)):
        e, first = scores(i)
        if not len(e):
            continue
        post = marginals(e, first, model.transitions, enter, back)
        total, count = total + post.sum(0, dtype=np.float64), count + len(e)
        if enter is None:  # up to here the run begins with its first word
            first[0] = True
            enter = carried(e, first, model.transitions).sum(0)
        else:
            enter = enter @ products[i]
        enter = enter / enter.sum()
    return total / max(count, 1), letter


def identify(df: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """Add ``pred_col`` and ``score_col`` (the share of the words' probability that the language holds).

    ``und`` with score 0 for a null text, a text without a letter, and under a model that knows no language. Texts are read
    whole at any length; equal texts, equal results; repeated rows stay repeated; earlier columns of these
    names are replaced.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)
    kept = df.drop(pred_col, score_col)
    names = kept.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(at)):
                pred, score = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                if held.value.langs:
                    if b - a == 1 and len(buf) > CHUNK_BYTES:
                        share, has = _long_share(buf, held.value)
                        shares, letter = share[None, :], np.array([has])
                    else:
                        _, _, shares, letter = _shares(buf, offsets, held.value)
                    pred[letter] = np.array(held.value.langs, object)[shares[letter].argmax(1)]
                    score[letter] = shares[letter].max(1).clip(0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns), pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, pred_col, score_col]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{pred_col}` string, `{score_col}` double")


def tag(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, lang, score``: the runs of words of one language in each text, as UTF-8 byte offsets, with
    the mean marginal probability. Texts without words give no row. A text's words are held together, at about 70 bytes for each of its bytes."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, offsets in text_chunks(batch.column(1)):
                w, post, _, _ = _shares(buf, offsets, held.value)
                if not len(w.row) or not held.value.langs:
                    continue
                best = post.argmax(1)
                cut = np.flatnonzero(np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (best[1:] != best[:-1])]))
                last = np.concatenate([cut[1:], [len(best)]]) - 1
                mean = np.add.reduceat(post.max(1).astype(np.float64), cut) / (last - cut + 1)
                ids = batch.column(0).take(pa.array(a + w.row[cut]))
                base = offsets[w.row[cut]]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(w.starts[cut] - base), pa.array(w.ends[last] - base), pa.array(np.array(held.value.langs, object)[best[cut]], pa.string()), pa.array(mean)],
                    ["doc_id", "start", "end", "lang", "score"],
                )

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, end long, lang string, score double")


def predict(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows whose crc32(id as text) mod 4 is not 2 and return ``doc_id, held_out, lang_pred, score`` for every row.

    Null ids count as the empty string. An empty table gives an empty result.
    """
    src = df.select(
        df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang")
    ).withColumn("held_out", F.expr(f"{crc32_text('doc_id')} % 4 = 2"))
    model = fit(src.withColumn("learn", ~F.col("held_out")), "learn")
    return identify(src.drop("lang"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
