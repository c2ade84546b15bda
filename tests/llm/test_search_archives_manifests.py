"""Ranked search, WARC archives and Merkle manifests against brute force, and on odd rows, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyarrow import fs

from gaugewise.llm import dualtree, merkle, ordered, warc
from gaugewise.session import fresh_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- places in one order


def test_placed(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.6 else rng.choice("bc"), rng.randrange(50), i, rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, id int, v long")
    whole = Counter()
    for g, _, _, v in rows:
        whole[g] += v
    got = {r["id"]: (r["place"], r["whole"]) for r in ordered.placed(
        df, [F.col("k").desc(), F.col("id")], F.col("v"), "test", "g").collect()}
    sums = Counter()
    for g, k, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        assert got[i] == (sums[g], whole[g])
        sums[g] += v
    every = {r["id"]: r["place"] for r in ordered.placed(df, [F.col("k"), F.col("id")], F.lit(1), "test").collect()}
    assert [every[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(900))


# --- op13


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proofs(hashes, fanout):
    """Root, and for each leaf the siblings before and after it, level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            run = i // fanout * fanout
            paths[leaf].append(("".join(hashes[run:i]), "".join(hashes[i + 1:run + fanout])))
        hashes = [sha("".join(hashes[i:i + fanout])) for i in range(0, len(hashes), fanout)]
        at = [i // fanout for i in at]
    return hashes[0], paths


def brute_manifest(rows, fanout):
    """(doc_id, leaf) -> subroot, root, proof, folded root."""
    def leaf(r, cut=False):
        text = r[1].replace("\n", "") if cut and r[1] is not None else r[1]
        return sha("".join(map(encoded, (r[0], r[2], r[3], r[4], text))))

    sources = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *proofs([leaf(r) for r in own], fanout))
    root, above = proofs([trees[s][1] for s in sources], fanout)
    out = []
    for s, top in zip(sources, above):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, even)
            for before, after in path + top:
                h = sha(before + h + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in path + top)), h, h == root))
    return out


DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def manifest_rows(spark, rows, fanout=3):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in (
        "g", "key", "leaf", "h", "x", "path", "place", "range", "n", "i", "p", "root")})
    return [tuple(r) for r in merkle.checked(docs, fanout).collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["a\nb", "a b", "", None, "ñ\n\U0001F600"]) and f"{i}\n{rng.random()}",
             rng.choice(["hot", "hot", "hot", None, "s", "é", "z", ""]), rng.choice(["en", None]), rng.choice([3, None]))
            for i in range(130)]
    assert order(manifest_rows(spark, rows, fanout)) == order(brute_manifest(rows, fanout))


def test_manifest_of_odd_rows(spark):
    long = "word\n" * 200_000
    rows = [(1, long, "a", "en", 5), (1, long, "a", "en", 5), (1, "x", "a", "en", 5), (None, "n\n", "a", "en", 5),
            (None, "n\n", "a", None, 5), (None, None, "a", None, None), (2, "", "alone", "en", 0), (3, None, None, None, None)]
    got = manifest_rows(spark, rows)
    assert order(got) == order(brute_manifest(rows, 3))
    assert all(r[6] for r in got if r[0] is None), "rows without id are never tampered with"
    one = manifest_rows(spark, rows[:1])
    assert one == brute_manifest(rows[:1], 3) and one[0][4] == sha("") and one[0][1] == one[0][2] == one[0][3]
    assert manifest_rows(spark, []) == []


def test_manifest_tells_every_change(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], "en", i) for i in range(20)]
    roots = {manifest_rows(spark, rows)[0][3]}
    for change in ([*rows, rows[3]], [(0, "text 0", "b", "en", 0), *rows[1:]]):
        roots.add(manifest_rows(spark, change)[0][3])
    assert len(roots) == 3


# --- op12


def brute_records(rows, least=warc.LEAST):
    out, seen = [], Counter()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        seen[payload] += 1
        revisit = len(payload) >= least and seen[payload] > 1
        first = min((i for i in same if i is not None), default=None)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return out


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(4)
    body = ["<p>" + "é" * 60 + "</p>", "x" * 99, "x" * 100, "y" * 400, "", None, "\r\n\r\nWARC/1.1\r\n\r\n" * 9]
    rows = [(i, f"http://h{i % 3}.example/{i}", rng.choice(body) if i % 2 else f"{rng.random()}" * 20) for i in range(300)]
    rows += [(7, "http://again.example/", rows[7][2]), rows[9], rows[9], (None, None, "y" * 400), (None, None, "z" * 300),
             (None, "u", "z" * 300), (400, "http://a.example/ä b\r\nX-Page-ID: 9", "long " * 300_000), (401, None, "q" * 100)]
    rng.shuffle(rows)
    return rows


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in (
        "digest", "bytes", "shard", "first", "copies", "rows", "place", "range", "payload_digest")})


def test_archive(spark, page_rows):
    folder = fresh_path(spark, "warc-test")
    files = warc.write(pages_of(spark, page_rows), folder, shard_bytes=40_000, file_bytes=9_000).collect()
    assert len(files) > 5 and len({f["name"] for f in files}) == len(files)
    got = warc.read(spark, folder, payloads=True).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert order(tuple(r[c] for c in fields) for r in got) == order(brute_records(page_rows))
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    whole = {r["payload_digest"] for r in got if r["payload"] is not None}
    assert {r["payload_digest"] for r in got} == whole, "every payload is kept once"
    assert {r["url"] for r in got if r["page_id"] == 400} == {"http://a.example/%C3%A4%20b%0D%0AX-Page-ID:%209"}
    store, path = warc.place(folder)
    names = {i.base_name for i in store.get_file_info(fs.FileSelector(path))}
    assert {n for n in names if not n.startswith(".")} == {f["name"] for f in files} | {"manifest"}, "nothing temporary stays"
    assert sum(f["records"] for f in files) == len(page_rows)
    assert all(f["bytes"] < 9_000 + 4_000 or f["records"] == 1 for f in files)
    assert {i.size for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".gz")} == {
        f["bytes"] for f in files}
    first = min(files, key=lambda f: f["name"])
    with store.open_input_stream(f"{path}/{first['name']}", compression=None) as source:
        ids = [warc.parsed(m)[0].get("X-Page-ID") for m in warc._members(source, hashlib.sha256())][1:]
    assert [int(i) for i in ids] == sorted(int(i) for i in ids)


def test_archive_is_the_same_however_rows_lie(spark, page_rows):
    kept = []
    for partitions, seed in ((3, 1), (17, 2)):
        rows = page_rows[:]
        random.Random(seed).shuffle(rows)
        folder = fresh_path(spark, "warc-test")
        files = warc.write(pages_of(spark, rows).repartition(partitions), folder, shard_bytes=40_000, file_bytes=9_000)
        kept.append(sorted(tuple(f) for f in files.collect()))
    assert kept[0] == kept[1]


def test_archive_tells_damage(spark, page_rows):
    folder = fresh_path(spark, "warc-test")
    files = warc.write(pages_of(spark, page_rows), folder).collect()
    store, path = warc.place(folder)
    with store.open_input_stream(f"{path}/{files[0]['name']}", compression=None) as source:
        data = bytearray(source.read())
    data[len(data) // 2] ^= 1
    with store.open_output_stream(f"{path}/{files[0]['name']}", compression=None) as out:
        out.write(bytes(data))
    with pytest.raises(Exception):
        warc.read(spark, folder).collect()


def test_archive_of_nothing(spark):
    folder = fresh_path(spark, "warc-test")
    assert warc.write(pages_of(spark, [(1, "", "")]).filter("page_id > 1"), folder).collect() == []
    assert warc.read(spark, folder).collect() == []


def test_renaming_again_changes_nothing(spark, tmp_path):
    files = warc._Files(str(tmp_path), 3, 1 << 20)
    files.add(warc.page_record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).digest(), 0, False, 1))
    files.close()
    batch = warc._reports(files.done)
    for _ in range(2):
        list(warc._named(str(tmp_path))(iter([batch])))
    assert (tmp_path / files.done[0]["name"]).stat().st_size == files.done[0]["bytes"]
    (tmp_path / files.done[0]["name"]).unlink()
    with pytest.raises(OSError):
        list(warc._named(str(tmp_path))(iter([batch])))


# --- op11


def words(text):
    return re.findall(dualtree.WORD, (text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(words(text))) for i, text in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 25 + 75 * bag.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words(text) if bag[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if absent else doc_id, -score) for rank, (score, absent, doc_id) in enumerate(
            sorted(scores)[:k], 1)]
    return out


def search_rows(spark, docs, items, **options):
    names = {c: F.lit("clash") for c in ("n", "t", "tf", "impact", "lead", "next", "at", "score", "rank", "terms", "w")}
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns(names)
    items = spark.createDataFrame(items, "item_id long, text string").withColumns(names)
    return [tuple(r) for r in dualtree.searched(docs, items, **options).collect()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmno" for b in ("", "Ñ", "1", "longer-than_sixteen bytes", "é" * 12)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(700)]
    docs += [(700 + i, docs[5][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[4][1]), (None, None), (900, None),
                                                         (901, ""), (902, "?!"), (903, text(60_000))]
    items = [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "nowhere"), (2, items[2][1]), (None, "a b"), (63, "a " * 50), (64, docs[5][1])]
    return docs, items


def test_search(spark, corpus):
    docs, items = corpus
    assert order(search_rows(spark, docs, items)) == order(brute_search(docs, items))
    assert order(search_rows(spark, docs, items, k=3, sample=50)) == order(brute_search(docs, items, 3))


def test_search_in_blocks(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(dualtree, "BLOCK_ITEMS", 30)
    monkeypatch.setattr(dualtree, "BLOCK_TERMS", 60)
    assert len(list(dualtree.item_blocks(spark.createDataFrame(items, "item_id long, text string")))) > 2
    assert order(search_rows(spark, docs, items)) == order(brute_search(docs, items))


def test_search_of_nothing(spark):
    assert search_rows(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert search_rows(spark, [(1, "a")], [(1, None)]) == []
    assert search_rows(spark, [], [(1, "a")]) == [] and search_rows(spark, [(1, "a")], []) == []


def test_batches_are_pruned():
    """Documents of other words than an item's are dropped in whole batches, unseen."""
    import numpy as np
    rng, width = np.random.default_rng(1), 400
    weight = np.full(width, 100, np.int64)
    items = dualtree.Items([Counter({str(t): 1 for t in range(i, i + 5)}) for i in range(0, 390, 5)],
                           {str(t): t for t in range(width)}, weight)
    search = dualtree.Search(items, 10, np.zeros(len(items.own), np.int64))
    docs = [np.unique(np.clip(rng.normal(c, 3, 20).astype(int), 0, width - 1)) for c in np.sort(rng.uniform(0, width, 4000))]
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    t = np.concatenate(docs)
    search.chunk(list(range(len(docs))), first, t, rng.integers(1, 1000, len(t)), width)
    assert search.opened < 0.2 * search.batches
