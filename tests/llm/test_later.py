"""Line dedup, ranked lexical search and conversation repair: whole queries against brute force, odd rows, long texts."""

import base64
import hashlib
import heapq
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import lexical, linededup, pieces, queries, repair, sharding, urls
from gleaner.session import shared_dir
from gleaner.sources.versions import Conflict

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
CLASH = ("h1", "h2", "n", "k", "id", "t1", "kept", "place", "is_hot", "score", "rank", "term", "slot", "conv", "code", "nth", "mark", "audit", "signature")


def wide(df):
    """With columns named like those that the operators use inside."""
    for c in CLASH:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def same_as_sql(df, sql, sf=SF):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel, columns = c.sql(sql), sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(x) for x in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


@pytest.mark.parametrize("name", ["op11_lines", "op12_lexical", "op13_repair"])
def test_whole_query_against_sql(spark, name):
    same_as_sql(queries.QUERIES[name](spark, SF), queries.ORACLES[name])


# --- 11 ---------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_lines(texts, least, min_chars=1):
    keys = [[x.strip(SPACE).translate(LOWERED) for x in (t or "").split("\n")] for t in texts]
    counts = Counter(k for ks in keys for k in set(ks))
    gone = {k for k, n in counts.items() if n >= least and len(k) >= min_chars}
    out = []
    for t, ks in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if k not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def odd_texts():
    rng = random.Random(5)
    pool = ["Share this", " share THIS\t", "Privé", "PRIVé", "", " ", "x", " ", "日本語", "a\rb", "Read more\r", "\x00"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(60)] + [None, "", "\n", "only once", "Share this\n" * 3000, "\n".join(f"line {i}" for i in range(20_000))]
    return texts + ["Share this\nsame\nsame"] * 5


@pytest.mark.parametrize("least, min_chars", [(10, 1), (2, 1), (5, 3), (1, 0)])
def test_lines_against_brute_force(spark, least, min_chars):
    texts = odd_texts()
    df = wide(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.drop_frequent(df, least=least, min_chars=min_chars).collect()}
    assert got == dict(enumerate(slow_lines(texts, least, min_chars)))


def test_lines_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb", None, None)] * 6 + [(None, "a\nc", None, None)] * 5 + [(2, "b", None, None)]
    got = linededup.drop_frequent(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["kept"]) for r in got) == sorted([(1, 1, "b")] * 6 + [(0, 1, "c")] * 5 + [(2, 0, "b")])
    assert linededup.drop_frequent(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_levelled_reopened_and_guarded(spark, monkeypatch):
    monkeypatch.setattr(linededup, "RECOUNT", 4)
    root = f"{shared_dir(spark)}/lines-test"
    store = linededup.LineRuns(spark, root, least=3)
    lots = [[f"hot\nlot {i}\nrow {i} {j}" for j in range(5)] for i in range(5)]
    levels = []
    for lot in lots:
        store.add(spark.createDataFrame([(t,) for t in lot], "text string"))
        levels.append([r[1] for r in store.runs()])
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]
    assert store.frequent().count() == 6  # hot, and the line of each lot
    spark.sql(f"DROP TABLE {store.runs()[0][0]}")  # a new session does not know the tables
    again = linededup.LineRuns(spark, root, least=3)
    assert again.frequent().count() == 6 and again.frequent().agg(F.max("n")).first()[0] == 25
    with pytest.raises(Conflict):
        again.versions.put(again.versions.read(), again.versions.latest())
    version = again.compact()
    assert [r[1] for r in again.runs()] == [3] and again.compact() == version
    assert again.frequent().count() == 6


def test_a_known_frequent_key_is_not_added_again(spark):
    store = linededup.LineRuns(spark, f"{shared_dir(spark)}/lines-anti", least=3, fanout=9)
    batch = spark.createDataFrame([("shared\nown %d" % i,) for i in range(4)], "text string")
    store.add(batch)
    store.add(batch)
    sizes = sorted(spark.table(r[0]).count() for r in store.runs())
    assert sizes == [4, 5]  # the second run lacks the shared line


# --- 12 ---------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_search(docs, items, top=10):
    terms = lambda t: [x.translate(LOWERED) for x in TERM.findall(t or "")]
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(heapq.nsmallest(top, found))]
    return out


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE_PAIRS", 50)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    rng = random.Random(2)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "日本", "x1", "of", "THE"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\x00", "_", "\n"]) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "!!"), (153, docs[3][1]), (None, docs[3][1]), (154, "alpha " * 3000), (155, "beta")] + [docs[7]] * 3
    items = [(i, " ".join(rng.choices([*words, "missing"], k=rng.randint(0, 9)))) for i in range(20)] + [(20, None), (21, "missing"), (None, "alpha beta")]
    d, q = wide(spark.createDataFrame(docs, "doc_id long, text string")), wide(spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((tuple(r) for r in lexical.search(d.repartition(5), q).collect()), key=str)
    assert got == sorted(slow_search(docs, items), key=str)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_repeated_items_are_one(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    got = lexical.search(d, spark.createDataFrame([(1, "b"), (1, "b"), (1, "a")], "item_id long, text string"))
    assert sorted(r["rank"] for r in got.collect()) == [1, 1, 2]


def test_long_texts_are_read_in_windows(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "abc", "日本", " ", "-", "z" * 40]) for _ in range(900)), "ab abc", "x" * 500 + " ab"]
    block = lexical.block_of([(0, "ab abc 日本 zzz"), (1, "x" * 30)])
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = lexical.postings(buf, offsets, block)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(lexical, "CHUNK_BYTES", size)
        got = lexical.postings(buf, offsets, block)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 1000, 1 << 17, 1 << 40):
        key = rng.integers(0, top, 5000)
        assert np.array_equal(lexical.radix_order(key), np.argsort(key, kind="stable"))


# --- 13 ---------------------------------------------------------------------------------------


def slow_solve(signature):
    """The cheapest audit by trying all of them, with up to two inserts between rows."""
    states = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "")}

    def grown(cells):
        for _ in range(2):
            for state, (cost, audit) in list(cells.items()):
                for role in "ua":
                    to = states.get((state, role))
                    if to and (cost + 5, audit + "I") < cells.get(to, (1 << 30, "")):
                        cells[to] = (cost + 5, audit + "I")
        return cells

    for c in signature:
        after = {}
        for state, (cost, audit) in grown(dict(now)).items():
            ways = [("D", 2, state)]
            if not c.isdigit():
                extra = 5 if c.isupper() else 0
                own = states.get((state, c.lower()))
                if own:
                    ways.append(("K", extra, own))
                ways += [("R", 1 + extra, states[state, r]) for r in "ua" if (state, r) in states]
            for edit, more, to in ways:
                if (cost + more, audit + edit) < after.get(to, (1 << 30, "")):
                    after[to] = (cost + more, audit + edit)
        now = after
    return min(v for s, v in grown(dict(now)).items() if s in ("", "a"))


def test_solutions_against_a_forward_search(monkeypatch):
    rng = random.Random(4)
    for stride in (128, 3):
        monkeypatch.setattr(repair, "STRIDE", stride)
        for _ in range(1500):
            s = "".join(rng.choices("suaxSUAX1234", [4, 9, 9, 2, 1, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 14)))
            assert repair.solve(s) == slow_solve(s), s
    cost, audit = repair.solve("ua" * 50_000 + "1")
    assert cost == 2 and len(audit) == 100_001


def slow_repair(rows):
    """Contract of the query, conversation by conversation. Rows: conv, turn, role, text."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, faults, legal = set(), "", Counter(), 0
        for _, role, text in own:
            i = "suax".find(role[:1]) if role[:1] in ("s", "u", "a") else 3
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            codes += {"": "suax", "truncated": "SUAX"}.get(fault, "1234")[i]
        legal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = slow_solve(codes)
        lines, state, todo = [], "", iter(own)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(todo)[1:]
            if edit == "D":
                continue
            nxt = "a" if state == "u" else "u"
            if edit == "K":
                state = role[:1]
            else:
                role, state = {"u": "user", "a": "assistant"}[nxt], nxt
            lines.append(f"{role}:{text}")
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], legal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["Yes.", "no", "Why?\t", " \n", None, "日本!", "x.", "same."]
    roles = ["user", "assistant", "system", "tool", None, "", "supervisor"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), rng.choices(roles, [9, 9, 2, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += [(500, None, "user", "Hello."), (500, None, "assistant", "Hi.")]
    rows += [(501, 0, "user", "Hello.")] * 4  # repeated rows
    rows = [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(x[0], x[1]) for x in rows[:i]} or r[0] == 501]  # ties have an order of their own
    df = wide(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = repair.digest(repair.damage(df), df).collect()
    got = {r["conv_id"]: tuple(r[c] for c in (*repair.STATS, "audit", "repaired_sha256")) for r in found}
    assert len(found) == len(got)
    want = slow_repair(rows)
    assert got == want
    assert repair.digest(repair.damage(df.limit(0)), df.limit(0)).count() == 0


def test_repaired_rows_are_legal_and_hash_alike(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    damaged = repair.damage(df)
    rows = defaultdict(list)
    for r in repair.repaired(damaged).orderBy("conv_id", "place").collect():
        rows[r["conv_id"]].append(r)
    want = {r["conv_id"]: r["repaired_sha256"] for r in repair.digest(damaged, df).collect()}
    assert {c: hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rows.get(c, [])).encode()).hexdigest() for c in want} == want
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own)) for own in rows.values())
    assert {r["edit"] for own in rows.values() for r in own} <= {"K", "R", "I"}
    assert all([r["place"] for r in own] == list(range(len(own))) for own in rows.values())


def test_one_long_conversation(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("row "), "id", F.lit(".")).alias("text"))
    got = repair.digest(repair.damage(df), df).first()
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"row {i}.") for i in range(n)]
    kinds = Counter(zlib.crc32(f"1:{i}".encode()) % 20 for i in range(n))
    assert got["gaps"] >= kinds[0] - 2 and got["blank"] == kinds[1] and got["duplicate"] == kinds[3] and got["truncated"] == kinds[2]
    cost, audit = repair.solve("".join(_codes(rows)))
    assert (got["cost"], got["audit"]) == (cost, audit)


def _codes(rows):
    for _, i, role, _ in rows:
        kind = zlib.crc32(f"1:{i}".encode()) % 20
        at = 0 if kind == 4 else (role == "assistant")
        if kind:
            yield {1: "23", 2: "UA"}.get(kind, "ua")[at] + ("23"[at] if kind == 3 else "")


# --- long texts and clashing columns of earlier operators ----------------------------------------


def test_stages_leave_columns_of_their_own_names(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("lang_pred", "LANG_SCORE", "lang_score_", "quality_score", "quality_pred", "__key", "learn", "__learn")
    left = docs.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in names))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.schema == left.schema
        left = spark.createDataFrame(out.collect(), out.schema)
        assert left.count() and all(r[c] == f"{c}-{r['doc_id']}" for r in left.collect() for c in names)
    plain = docs
    for _, stage in p.STAGES[:-1]:
        plain = spark.createDataFrame(stage(spark, plain, SF).collect(), docs.schema)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in plain.collect()}


def test_pieces_of_text_without_white_space(monkeypatch):
    rng = random.Random(9)
    m = pieces.load(open(queries.PIECE_MODEL, "rb").read())
    texts = [
        "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(900)),
        base64.b64encode(rng.randbytes(3000)).decode(),
        "a" * 3000,
        "".join(rng.choice("abcé日🎉thing") for _ in range(3000)) + " and the " + "end" * 900,
        "plain words here",
        "",
    ]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8).copy(), np.cumsum([0, *map(len, raw)])
    monkeypatch.setattr(pieces, "LONG", 1 << 40)
    want = pieces.encode_chunk(buf, offsets, m)
    monkeypatch.setattr(pieces, "LONG", 500)
    for window in (1 << 16, 60):
        monkeypatch.setattr(pieces, "WINDOW", window)
        got = pieces.encode_chunk(buf, offsets, m)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert pieces.decode_chunk(*got, m) == raw


def test_a_long_part_is_done_in_time():
    m = pieces.load(open(queries.PIECE_MODEL, "rb").read())
    for text in ("日本語処理" * 40_000, base64.b64encode(random.Random(1).randbytes(400_000)).decode(), "a" * 600_000):
        raw, began = text.encode(), time.process_time()
        ids, bounds = pieces.encode_chunk(np.frombuffer(raw, np.uint8).copy(), np.array([0, len(raw)]), m)
        assert time.process_time() - began < 20 and pieces.decode_chunk(ids, bounds, m) == [raw]


def test_user_pieces_in_long_parts(monkeypatch):
    field = lambda number, raw: bytes([number << 3 | 2]) + bytes([len(raw)]) + raw
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    vocabulary = [("<unk>", 0, pieces.UNKNOWN), ("▁", -3, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("aab", -4.2, 1), ("bba", 0, pieces.USER), ("abab", 0, pieces.USER)]
    m = pieces.load(b"".join(piece(*p) for p in vocabulary))
    rng = random.Random(3)
    for _ in range(20):
        raw = "".join(rng.choice(["a", "b", "ab", "é", "bb"]) for _ in range(60)).encode()
        buf, offsets = np.frombuffer(raw, np.uint8).copy(), np.array([0, len(raw)])
        monkeypatch.setattr(pieces, "LONG", 1 << 40)
        want = pieces.encode_chunk(buf, offsets, m)
        monkeypatch.setattr(pieces, "LONG", 1)
        for window in (1 << 16, 7):
            monkeypatch.setattr(pieces, "WINDOW", window)
            assert np.array_equal(pieces.encode_chunk(buf, offsets, m)[0], want[0])


def test_long_urls(spark, monkeypatch):
    rng = random.Random(2)
    words = spark.createDataFrame([("news", 50), ("paper", 20), ("a" * 25, 3)], "word string, n long")
    long = "".join(rng.choice("abcdefghij") for _ in range(3000))
    rows = [("newspaper.com", "/x"), (f"{long}news.org", f"/{long}/paper{'a' * 25}"), (None, None)]
    pages = spark.createDataFrame(rows, "host string, path string")
    whole = sorted((tuple(r) for r in urls.segmented(pages, words).collect()), key=str)
    monkeypatch.setattr(urls, "HELD_PARTS", 100)
    monkeypatch.setattr(urls, "KEPT", 5)
    assert sorted((tuple(r) for r in urls.segmented(pages, words).collect()), key=str) == whole
    assert {r[2] for r in whole} >= {"news paper com", ""}
    block = pa.RecordBatch.from_pydict({"b": [1], "h": [long * 20], "p": [""]})
    assert max(b.num_rows for b in urls._part_batches(iter([block]))) <= 100 + urls.STEM


def test_lots_go_on_after_another_writer(spark, monkeypatch):
    root = f"{shared_dir(spark)}/store-lots"
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    df = spark.range(60).withColumn("text", F.md5(F.col("id").cast("string")))
    place, met = a._place, []

    def late(aside, version):
        if version == 2 and not met:
            met.append(b.append(df.where("id < 5")))
        return place(aside, version)

    monkeypatch.setattr(a, "_place", late)
    assert a.append_lots(df, F.col("id") % 4, 4) == 5 and met == [2]
    assert [a.read(v).count() for v in range(1, 6)] == [15, 20, 35, 50, 65]
    assert a.append_lots(df.limit(0), F.lit(0), 1) == 5
