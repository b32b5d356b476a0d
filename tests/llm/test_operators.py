"""Operators against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import collections
import gzip
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat, decontaminate, exact, id_files, minhash, packing, substring, token_counts, tokens, toxicity, warc
from newsloom.llm import queries as registered
from newsloom.llm.common import components, new_folder
from newsloom.llm.words import words
from tests.compare import duck, compare
from tests.llm import brute
from tests.llm.conftest import ODD, SCHEMA

OWNED = [(k, t) for k, t in ODD if k is not None]


def rows_of(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select(*columns).collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- words, filters, sketches -------------------------------------------------------------

def test_words_equal_their_hashes():
    texts = [None, "", "b a b", " A\tb\x0bc\x0c", "é" * 300_000 + " é", "x" * 700_000]
    found = words(pa.array(texts), fold=True)
    own = [brute.WORD.findall(brute.fold(t or "")) for t in texts]
    assert found.counts.tolist() == [len(w) for w in own]
    named = {}
    for word, value in zip([w for o in own for w in o], found.hashes.tolist(), strict=True):
        assert named.setdefault(word, value) == value
    assert len(set(named.values())) == len(named)


def test_quotient_filter_is_lossless():
    draw = np.random.default_rng(1)
    parts = [draw.integers(0, 1 << 64, 500, np.uint64, endpoint=False) for _ in range(3)]
    parts[1][:100] = parts[0][:100]
    parts[2][:7] = parts[0][0]
    merged = {}
    made = collections.defaultdict(list)
    for part in parts:
        for f in exact.CountingQuotientFilter.build(part, 9):
            made[f.block].append(exact.CountingQuotientFilter.from_bytes(f.block, 9, f.to_bytes()))
    for group in made.values():
        f = exact.CountingQuotientFilter.merge(group)
        merged |= dict(zip(f.values.tolist(), f.counts.tolist(), strict=True))
    assert merged == dict(collections.Counter(np.concatenate(parts).tolist()))


def test_sketch_fills_and_estimates():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 64, 1200, np.uint64, endpoint=False)
    for low, want in ((200, 1000 / 1400), (20, 1180 / 1220)):
        other = np.concatenate((base[low:], draw.integers(0, 1 << 64, low, np.uint64, endpoint=False)))
        same = [(minhash.sketch(base, 200, s) == minhash.sketch(other, 200, s)).mean() for s in range(10)]
        assert abs(np.mean(same) - want) < 0.05
    one = minhash.sketch(base[:1], 120, 5)
    assert (one < np.iinfo(np.uint64).max).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (200, 200)]
    got = rows_of(components(spark.createDataFrame(links, "a long, b long"), "a", "b"), "node", "label")
    assert got == {i: (1,) for i in range(1, 61)} | {i: (90,) for i in (90, 95, 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- exact, substring, near dedup ------------------------------------------------------------

def test_exact_groups(docs):
    got = exact.exact_groups(docs(OWNED))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(OWNED)


def test_exact_odd_rows(spark, docs):
    assert exact.exact_groups(empty(spark)).count() == 0
    got = exact.exact_groups(docs([(1, "a"), (1, "a"), (2, "a "), (None, "a"), (None, "a")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (1, 2, 3, False), (2, 2, 3, True)]
    left = exact.drop_exact_copies(docs([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "c")]))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "c"), (1, "a"), (3, "b")] and "label" in left.columns


def test_substring(docs, spark):
    for size in (2, 5, 20):
        got = substring.repeated_words(docs(OWNED), size=size)
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(OWNED, size)
    assert substring.repeated_words(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_substring_random(docs, seed):
    draw = random.Random(seed)
    rows = [(k, " ".join(draw.choice("ab" if draw.random() < 0.3 else "abcdefgh") for _ in range(draw.randint(0, 120)))) for k in range(60)]
    rows += [(100 + k, draw.choice(rows)[1] + " z " + draw.choice(rows)[1]) for k in range(20)]
    draw.shuffle(rows)
    got = substring.repeated_words(docs(rows).repartition(5), size=6)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows, 6)


def test_substring_without_key(docs):
    text = " ".join(map(str, range(30)))
    got = substring.repeated_words(docs([(None, text), (5, text), (None, text)])).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_near_groups(docs, spark):
    got = minhash.near_groups(docs(OWNED))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute.near(OWNED)
    assert minhash.near_groups(empty(spark)).count() == 0
    loose = minhash.near_groups(docs([(None, "a b c"), (3, "a b c"), (3, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in loose) == [(0, 0, True), (3, 3, True)]


@pytest.mark.parametrize("settings", [minhash.Settings(), minhash.Settings(5, 80, 36, 5)])
def test_near_groups_around_the_threshold(docs, settings):
    """Many copies with few and with many edits: stars, chains and near misses."""
    draw = random.Random(settings.percent)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for k in range(250):
        words_ = list(base)
        for _ in range(draw.randint(0, 8)):
            words_[draw.randrange(90)] = f"e{draw.randrange(400)}"
        rows.append((k, " ".join(words_)))
    rows += [(1000 + k, " ".join(f"c{k + i}" for i in range(0, 80))) for k in range(0, 60, 3)]
    draw.shuffle(rows)
    got = minhash.near_groups(docs(rows).repartition(6), settings=settings)
    want = brute.near(rows, settings.shingle, settings.percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert len({c for _, c, _ in want.values()}) > 3


# --- decontamination, toxicity ------------------------------------------------------------------

def test_decontamination(spark, docs, folder, corpus):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    table = [(r["item_id"], r["text"]) for r in items.collect()]
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.contaminated(docs(corpus), items).collect()}
    assert got == brute.leaks(corpus, table)
    left = decontaminate.drop_contaminated(docs(corpus), items)
    assert {r.doc_id for r in left.select("doc_id").collect()} == {k for k, v in got.items() if not v}


def test_decontamination_recall_over_blocks(spark, docs, corpus, folder):
    """Whole items and paraphrases set into other texts are found by every size of block; clean texts are not."""
    draw = random.Random(5)
    table = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [t for k, t in corpus if not brute.leaks([(k, t)], table)[k]][:60]
    rows, want = [], set()
    for k, text in enumerate(clean):
        words_ = text.split()
        if k % 2:
            item = draw.choice(table)[1].split()
            head = [w if draw.random() > 0.15 or i > len(item) // 2 else "changed" for i, w in enumerate(item)]
            cut = draw.randint(0, len(words_))
            words_[cut:cut] = head
            want.add(k)
        rows.append((k, " ".join(words_)))
    items = spark.createDataFrame(table + [(900, None), (901, " "), (None, "x y"), table[0]], "item_id long, text string")
    found = decontaminate.contaminated(docs(rows), items, decontaminate.Retrieval(block=7)).filter("contaminated")
    got = {r.doc_id for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


@pytest.mark.parametrize("rank", [None, 100])
def test_decontamination_finds_copies_of_every_item(spark, docs, rank):
    """More than 256 independent passages, the last of less weight, one item longer than a block: no copy is lost."""
    table = [(k, " ".join([f"v{k}x{i}" for i in range(16)] * 2)) for k in range(270)]
    table += [(k, " ".join(f"v{k}x{i}" for i in range(2000 if k == 299 else 32))) for k in range(270, 300)]
    rows = [(k, f"one two three {text} end of it") for k, text in table]
    how = decontaminate.Retrieval() if rank is None else decontaminate.Retrieval(rank=rank)
    items = spark.createDataFrame(table, "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs(rows), items, how).collect()}
    assert found == {k: [k] for k, _ in table}
    assert decontaminate.drop_contaminated(docs(rows), items, how).isEmpty()


def test_decontamination_repeated_words_and_shared_ids(spark, docs):
    """Items of few words said often are found, and so are all texts of an item_id and, when dropping, those without."""
    text = {k: " ".join([f"v{k}x{i}" for i in range(4)] * 8) for k in range(5)}
    items = spark.createDataFrame([(1, text[1]), (2, text[2]), (2, text[3]), (None, text[4])], "item_id long, text string")
    rows = [(k, f"one two three {t} end of it") for k, t in text.items()]
    found = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs(rows), items).collect()}
    assert found == {0: [], 1: [1], 2: [2], 3: [2], 4: []}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs(rows), items).collect()] == [0]


def test_decontamination_odd_rows(spark, docs, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(docs(ODD), items).filter("contaminated").count() == 0
    none = decontaminate.contaminated(docs(ODD), items.limit(0))
    assert none.count() == len(ODD) and none.filter("contaminated OR size(item_ids) > 0").isEmpty()
    assert decontaminate.drop_contaminated(docs(ODD), items.limit(0)).count() == len(ODD)


def _labelled(count: int, seed: int):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(count):
        sentences = [" ".join(f"v{draw.randrange(300)}" for _ in range(8)) + "." for _ in range(draw.randint(1, 12))]
        toxic = int(draw.random() < 0.3)
        if toxic:
            at = draw.randrange(len(sentences))
            sentences[at] = sentences[at][:-1] + f" {draw.choice(('badword', 'nastyish', 'vileness'))}{draw.choice(('', 'en', 'er'))}."
        rows.append((k, " ".join(sentences)))
        labels.append((k, toxic))
    return rows, labels


def test_toxicity_held_out(spark, docs):
    rows, labels = _labelled(900, 3)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs(rows), frame).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 100 < len(held) < 260
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = dict(rows)
    for r in held:
        if r.predicted and truth[r.doc_id]:
            worst = [s for s in text[r.doc_id].split(".") if s][r.worst_sentence]
            assert any(w in worst for w in ("badword", "nastyish", "vileness"))
    assert {r.doc_id for r in toxicity.drop_toxic(docs(rows), frame).collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_never_learns_from_held_out(spark, docs):
    rows, labels = _labelled(300, 4)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = frame.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.weights_of(toxicity.train(docs(rows), x)) for x in (frame, flipped))
    assert (a == b).all() and np.abs(a[:-1]).max() > 0


def test_toxicity_odd_rows(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs(ODD), none).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.toxic_scores(empty(spark), none).count() == 0
    assert toxicity.drop_toxic(docs(ODD), none).count() == len(ODD)


# --- tokens: packing, counts, id files ------------------------------------------------------------

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(corpus, name):
    rows = corpus[:120] + [(-1, t) for _, t in ODD] + [(-2, t) for t in (
        "don't  stop\n\n it's<|endoftext|>x <|startoftext|>", "a\x1cb\x85c\xa0d", "naïve ½ x² №5 “q” – €3", "  lead\t\ttail  ", "İI ſ K")]
    made = tokens.Encoder(registered.public_tokenizers.path(name), cache_pieces=50)
    for _, text in rows:
        want = made.library.encode(text or "", add_special_tokens=False).ids
        assert made.encode(text or "").tolist() == want and made.count(text or "") == len(want)
    texts = [t for _, t in rows]
    want = [made.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in made.encode_all(pa.array(texts))] == want
    assert made.count_all(pa.array(texts)).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_on_random_texts(name):
    draw = random.Random(11)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "Ö", "7", "42", ".", "_", "'", "'s", "’", "²", "ß", "foo", "Bar,", "×", "\r\n", "漢"]
    made = tokens.Encoder(registered.public_tokenizers.path(name), cache_pieces=200)
    texts = ["".join(draw.choice(parts[:draw.choice((13, 23))]) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    want = [made.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in made.encode_all(pa.array(texts))] == want
    assert [made.encode(t).tolist() for t in texts] == want


@pytest.mark.parametrize("shares", [None, {"s0": 0.7, "s1": 0.3}])
def test_packing(docs, corpus, shares):
    rows = corpus[:80] + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = packing.pack(docs(rows).repartition(4), registered.WORD_TOKENIZER, window=512, shares=shares).collect()
    want = brute.library_ids(rows, "word_bpe_49k.json", [2])
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert b"".join(r.ids for r in pieces) == want[k].tobytes()
        for r in pieces:
            assert r.ids_crc32 == brute.crc(want[k][r.start:r.start + r.length]) and r.doc_tokens == len(want[k])
    total = sum(map(len, want.values()))
    assert sorted(by_window) == list(range(-(-total // 512)))
    shares_seen = []
    for number, pieces in sorted(by_window.items()):
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        full = sum(r.length for r in pieces)
        assert full == 512 or number == max(by_window)
        shares_seen.append(sum(r.length for r in pieces if r.source == "s0") / full)
    target = 0.7 if shares else sum(len(want[k]) for k, v in by_doc.items() if v[0].source == "s0") / total
    early = shares_seen[:len(shares_seen) // 4] if shares else shares_seen[:-1]
    assert max(abs(x - target) for x in early) <= 3 / 512


def test_packing_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SOURCES", 3)
    monkeypatch.setattr(packing, "SHARED_QUEUES", 2)
    rows = [(i, f"word{i} " * (40 if i % 20 < 3 else 7), "en", f"s{i % 20}", 1) for i in range(400)]
    made = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), registered.WORD_TOKENIZER, 2, window=256)
    by_doc, by_window = {}, {}
    for r in made.collect():
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_doc) == 400
    for pieces in [*([(a, n) for a, n, _ in p] for p in by_doc.values()), *by_window.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    assert all(sum(n for _, n, _ in p) == p[0][2] for p in by_doc.values())
    assert all(sum(n for _, n in w) == 256 for k, w in by_window.items() if k != max(by_window))


def test_packing_nothing(spark):
    assert packing.pack(empty(spark), registered.WORD_TOKENIZER).count() == 0


def test_token_counts_use_the_cache(spark, docs, corpus):
    rows = corpus[:60] + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)]
    cache = new_folder(spark, "cache")
    want = {k: (len((t or "").encode()), len(ids)) for (k, t), ids in zip(
        rows, brute.library_ids(list(enumerate(t for _, t in rows)), "byte_bpe_50k.json", []).values(), strict=True)}
    for part in (rows[:40], rows):
        got = rows_of(token_counts.token_counts(docs(part), registered.BYTE_TOKENIZER, cache), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert got == {k: (*want[k], want[k][1] > 1024) for k, _ in part}
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in rows})
    nothing = token_counts.token_counts(empty(spark), registered.BYTE_TOKENIZER, cache)
    assert nothing.count() == 0 and spark.read.parquet(cache).count() == stored.count()
    keyless = token_counts.token_counts(docs([(None, "a"), (None, "a"), (1, "a")]), registered.BYTE_TOKENIZER, cache)
    assert [r.n_tokens for r in keyless.collect()] == [1, 1, 1]


def test_id_files(spark, docs, corpus):
    rows = corpus[:150] + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)]
    folder = new_folder(spark, "ids")
    got = rows_of(id_files.id_digests(docs(rows).repartition(5), folder, registered.BYTE_TOKENIZER), "doc_id", "start", "n_tokens", "ids_crc32")
    want, at = {}, 0
    coded = brute.library_ids(rows, "byte_bpe_50k.json", [2])
    for k in sorted(coded):
        want[k] = (at, len(coded[k]), brute.crc(coded[k]))
        at += len(coded[k])
    assert got == want
    assert id_files.read_document(spark, folder, 10_003) == [coded[10_003].tolist()]
    assert id_files.read_document(spark, folder, -5) == []
    assert id_files.id_digests(empty(spark), new_folder(spark, "ids"), registered.BYTE_TOKENIZER).count() == 0
    few = id_files.id_digests(docs(ODD[:3] + ODD[-3:]), new_folder(spark, "ids"), registered.BYTE_TOKENIZER)
    assert few.count() == 6


def test_id_files_refuse_another_dictionary(spark, docs, corpus):
    folder = new_folder(spark, "ids")
    index = id_files.write_ids(docs(corpus), folder, registered.BYTE_TOKENIZER)
    id_files.files.write(folder, "dictionary.zdict", b"")
    with pytest.raises(Exception, match="not an id file"):
        id_files.read_ids(index, folder).collect()


# --- archives, conversations -----------------------------------------------------------------------

PAGE = "<html>" + "é" * 600 + "</html>"
PAGES = [(1, "http://a/ b", PAGE), (2, None, PAGE), (3, "http://c", PAGE), (4, "http://d", None), (5, "http://e", ""),
         (6, "http://f", "short"), (7, "http://g", "short"), (8, "http://h", "\r\n\r\nWARC/1.1\r\n" + "x" * 1100), (9, "u", "y" * 1000), (10, "u", "y" * 1000)]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'q' AS sha1", "1 AS bytes", "2 AS target")
    got = rows_of(warc.archived(pages, new_folder(spark, "warc")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.pages([(k, h) for k, _, h in PAGES])
    assert warc.archived(pages.limit(0), new_folder(spark, "warc")).count() == 0
    keyless = spark.createDataFrame([(None, "u", PAGE), (None, "v", PAGE), (3, "w", PAGE)], "page_id long, url string, html string")
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in warc.archived(keyless, new_folder(spark, "warc")).collect()]
    assert sorted(kinds, key=str) == sorted([(None, "revisit", 3), (None, "revisit", 3), (3, "response", None)], key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    data = warc.arc_bytes(version, "20240102030405", [("http://a", 3, b"one\n\n"), (None, None, b"")])
    found = list(warc.parse_arc(data))
    assert [f["URL"] for f, _ in found] == ["http://a", "-"]
    assert [warc.split_http(c)[1] for _, c in found] == [b"one\n\n", b""]
    assert warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z" and warc.iso_date("x").startswith("1970")


def test_arc_lines_not_written_here():
    body = b"HTTP/1.1 200 OK\r\n\r\n"
    one = warc.arc_bytes(1, "20240102030405", [("http://a", 1, b"one")])
    two = warc.arc_bytes(2, "20240102030405", [("http://b", 2, b"two")])
    blank_type = b"http://c 0.0.0.0 20240102030405 text/html; charset=utf-8 %d\n" % (len(body) + 3) + body + b"abc\n"
    no_length = b"http://d 0.0.0.0 20240102030405 text/html -\nlost\n"
    last = b"http://e 0.0.0.0 20240102030405 text/html 500\n" + body + b"cut"
    found = list(warc.parse_arc(one + blank_type + no_length + two))
    assert [f["URL"] for f, _ in found] == ["http://a", "http://c", "http://b"]
    assert found[1][0]["Content-type"] == "text/html; charset=utf-8"
    assert [warc.split_http(c)[1] for _, c in found] == [b"one", b"abc", b"two"]
    assert warc.split_http(list(warc.parse_arc(one + last))[1][1])[1] == b"cut"
    members = gzip.compress(one) + gzip.compress(two)
    assert [f["URL"] for f, _ in warc.parse_arc(members)] == ["http://a", "http://b"]
    assert list(warc.parse_arc(b"")) == list(warc.parse_arc(b"no header line\n")) == []
    assert [c for _, c in warc.parse_arc(b"http://f 0.0.0.0 20240102030405 text/html 2\nok\n")] == [b"ok"]


def test_warc_record_is_whole():
    record = {"url": "u", "date": "2024-01-01T00:00:00Z", "mime": "text/html", "page_id": 1, "payload": b"WARC/1.1\r\n\r\n", "sha1": "00" * 20,
              "record_id": "urn:uuid:1", "target": None, "target_url": None, "target_date": None}
    stream = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(warc._warc_record(record)) * 2))
    assert [warc.split_http(b)[1] for _, b in warc.parse_warc(stream)] == [record["payload"]] * 2


def test_chat_windows(spark):
    draw = random.Random(9)
    rows = []
    for conv in range(25):
        for turn in range(draw.randint(1, 40)):
            role = "system" if turn == 0 and conv % 3 else draw.choice(("user", "assistant"))
            text = draw.choice((None, "", "<end>\n", "\\l<text>", "hi \\b <turn> ", " ".join("w" for _ in range(draw.randint(1, 90)))))
            rows.append((conv, turn, role, text))
    rows += [(None, 1, None, "x"), (None, None, "assistant", "y\\"), (50, 0, "system", "alone"), (51, 2, "assistant", "t"), (51, 2, "assistant", "t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS n", "'z' AS cid", "2 AS window", "3 AS conv", "4 AS tokens")
    made = chat.windows(frame, budget=120, history=30)
    got = rows_of(chat.digests(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chats(rows)
    sized = made.withColumn("tokens", chat.word_tokens(F.regexp_replace("formatted", "<turn>|<text>|<end>\n", "")))
    assert made.filter("window > 0").count() > 20 and made.filter("repeated > 0").count() > 20
    assert sized.filter(F.col("tokens") <= 120).count() >= 0.9 * sized.count()
    assert chat.digests(chat.windows(frame.limit(0))).count() == 0


# --- registered queries ---------------------------------------------------------------------------------

def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registered.CHECKS))
def test_against_sql(spark, folder, name):
    assert compare(name, spark, folder, duck(folder), registered.QUERIES, registered.CHECKS)[0] is None


@pytest.mark.parametrize("name, plain, columns", [
    ("op2_substring_dedup", brute.substring, ("doc_id", "n_words", "n_removed", "kept_sha256")),
    ("op9_minhash_near_dedup", brute.near, ("doc_id", "n_shingles", "component_id", "kept"))])
def test_against_brute_force(spark, folder, corpus, name, plain, columns):
    assert rows_of(registered.QUERIES[name](spark, folder), *columns) == plain(corpus)


def test_other_queries(spark, folder, corpus):
    run = {n: q for n, q in registered.QUERIES.items()}
    coded = brute.library_ids(corpus, "byte_bpe_50k.json", [])
    assert rows_of(run["op6_token_counts"](spark, folder), "doc_id", "n_tokens") == {k: (len(v),) for k, v in coded.items()}
    got = rows_of(run["op8_id_files"](spark, folder), "doc_id", "n_tokens", "ids_crc32")
    assert got == {k: (len(v) + 1, brute.crc(np.append(v, 2))) for k, v in coded.items()}
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    got = rows_of(run["op5_arc_to_warc"](spark, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.pages(pages)
    turns = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = rows_of(run["op10_chat_windows"](spark, folder), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chats(turns)
    words_ = brute.library_ids(corpus, "word_bpe_49k.json", [2])
    pieces = run["op1_mixture_packing"](spark, folder).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))
    assert rows_of(pieces, "doc_id", "sum(length)", "max(doc_tokens)") == {k: (len(v), len(v)) for k, v in words_.items()}
    assert run["op7_toxicity"](spark, folder).count() == len(corpus) == run["op4_decontamination"](spark, folder).count()
