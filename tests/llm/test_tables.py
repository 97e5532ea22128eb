"""Centroid clustering, WARC archives and Merkle manifests against brute force."""

import base64
import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import catalog, centroids, manifest, warc
from tests.llm.frames import SCHEMA, documents, odd, prose

# centroid clustering


def brute_clusters(vectors: list[tuple], k: int, rounds: int, seed: int) -> list[tuple]:
    rows = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows), key=lambda r: (r[0], "" if r[0] else r[1], r[2]))
    centers = [v for _, _, v in hashed[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, *nearest(v)[::-1]) for i, v in rows]
    total = Counter()
    for _, j, d in found:
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, j, d, total[j], sum(total.values()), digest[j]) for i, j, d in found]


def clustered(df, k=8, rounds=10, **options):
    return centroids.cluster(centroids.whole_vectors(df, "vec_id", "embedding", 64, 1024), k, rounds, seed=3, **options)


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


@pytest.fixture(scope="module")
def vectors(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")


def test_clusters_of_odd_vectors(spark, vectors):
    base = [(r.vec_id, list(r.embedding)) for r in vectors.limit(120).collect()]
    v = base[0][1]
    rows = base + base[:3] + [(None, v), (None, base[1][1]), (900, None), (901, []), (902, v[:63]), (903, v + [0.0]), (904, [None] + v[1:])]
    rows += [(905, [float("nan")] + v[1:]), (906, [float("inf")] + v[1:]), (907, [0.0] * 64), (908, [-x for x in v])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = df.withColumns({"v": F.lit("clash"), "id": F.lit(1), "CLUSTER": F.lit(2), "near": F.lit(None)})
    assert same(centroids.with_inertia(clustered(wide), "vec_id").collect(), brute_clusters(rows, 8, 10, 3))


@pytest.mark.parametrize("refresh", [0.0, 2.0])
def test_stored_bounds_serve_any_number_of_rounds(vectors, refresh):
    """Results do not depend on when stored distances are written anew: every round, or never."""
    found = centroids.with_inertia(clustered(vectors, refresh=refresh), "vec_id").collect()
    assert same(found, brute_clusters([(r.vec_id, r.embedding) for r in vectors.collect()], 8, 10, 3))


def test_bounds_save_measurements(spark):
    r = np.random.default_rng(5)
    middles = r.normal(size=(8, 64)) * 2
    rows = [(i, (middles[i % 8] + r.normal(size=64) * 0.2).tolist()) for i in range(1200)]
    found = clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.measured[0] == 8 * 1200 and max(found.measured[4:]) < 0.5 * 8 * 1200
    assert same(centroids.with_inertia(found, "vec_id").collect(), brute_clusters(rows, 8, 10, 3))


def test_total_displacement_is_what_loosens():
    """A centroid that went away and came back costs nothing, however long its way was."""
    at = np.zeros((1, 2, 4), np.int64)
    at[0, 1] = 1000
    away = at + np.array([0, 600])[None, :, None]
    v = np.zeros((1, 4), np.int64)
    near, far, since, _, _ = centroids.History(at).nearest(v, None, None, None)
    back = centroids.History(np.concatenate([at, away, at]))
    assert back.nearest(v, near, far, since)[-1] == 0


def test_few_equal_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<float>")
    rows = centroids.with_inertia(clustered(df), "vec_id").collect()
    assert [(r.cluster, r.distance, r.inertia) for r in rows] == [(0, 0, 0)] * 3
    nothing = centroids.with_inertia(clustered(df.limit(0)), "vec_id")
    assert nothing.count() == 0 and len(nothing.columns) == 6
    with pytest.raises(Exception, match="component too large"):
        clustered(spark.createDataFrame([(1, [1e30] * 64)], df.schema))


def test_large_components_stay_exact():
    r = np.random.default_rng(1)
    v, c = r.integers(-(1 << 26), 1 << 26, (20, 64)), r.integers(-(1 << 26), 1 << 26, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert centroids.squared(v, c).tolist() == want


# WARC archives


def brute_records(rows: list[tuple], least: int = 0) -> list[tuple]:
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, uri, html in rows:
        data = (html or "").encode()
        target = last.get(data)
        revisit = target is not None and target != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((None if i is None else str(i), "revisit" if revisit else "response", digest, len(data), str(target) if revisit else None, True, None if revisit else data))
    return out


ODD_PAGES = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7?q=a b\r\nX: y", "<p>same</p>"), (7, None, "<p>same</p>"), (3, "é", "<p>same</p>"), (None, "n", "<p>same</p>"),
    (4, "e", ""), (5, "e", None), (None, None, None), (6, "x", "é\r\n\r\nWARC/1.1\r\n" * 40_000), (8, "x", "\x1f\x8b"), (9, "x", "a" * 3_000_000), (10, "x", "😀\x00"),
]


@pytest.mark.parametrize("least, archive_bytes", [(0, 1 << 30), (5, 600)])
def test_archives_round_trip(spark, least, archive_bytes):
    df = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).withColumn("ID", F.lit(0)).repartition(3)
    archives = warc.write_archives(df, warc.archive_folder(spark), "page_id", "url", "html", "2024-01-01T00:00:00Z", least, archive_bytes=archive_bytes)
    listed = archives.collect()
    assert sum(r.records for r in listed) == len(ODD_PAGES) and (len(listed) > 3) == (archive_bytes < 1000)
    found = warc.read_archives(archives).collect()
    columns = ("record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "verified")
    assert same([(*(r[c] for c in columns), None if r.payload is None else bytes(r.payload)) for r in found], brute_records(ODD_PAGES, least))
    none = warc.write_archives(df.limit(0), warc.archive_folder(spark), "page_id", "url", "html", "2024-01-01T00:00:00Z")
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_pages_are_read_back(spark, folder):
    rows = catalog.QUERIES["op12_warc"](spark, folder).collect()
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    want = [(None if r[4] is None else int(r[4]), r[3], r[2], r[1], int(r[0])) for r in brute_records(pages)]
    assert same([(r.refers_to, r.payload_bytes, r.payload_digest, r.record_type, r.page_id) for r in rows], want)


def _archive(*records: list[bytes]) -> bytes:
    return b"".join(b"".join(warc.member(r, 6)) for r in records)


def _one(payload: bytes = b"text " * 500) -> list[bytes]:
    return warc.record("1", "http://a/", payload, None, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reader_works_on_pieces_of_any_size(piece):
    data = _archive(_one(), _one(b""), _one(bytes(range(256)) * 50))
    found = [warc.parsed(*r) for r in warc.Reader(io.BytesIO(data), piece).records()]
    assert [p for _, p in found] == [b"text " * 500, b"", bytes(range(256)) * 50] and all(row[-1] for row, _ in found)


def test_every_member_is_one_record():
    data, count = _archive(_one(), _one(b"x")), 0
    while data:  # a plain gzip reader sees one member a record
        inflater = zlib.decompressobj(31)
        assert inflater.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
        data, count = inflater.unused_data, count + 1
    assert count == 2


def test_broken_archives_are_told():
    whole = _one()
    wrong = [x.replace(b"text text", b"text next") for x in whole]
    (row, _), = [warc.parsed(*r) for r in warc.Reader(io.BytesIO(_archive(wrong))).records()]
    assert row[-1] is False
    short = [x.replace(b"Content-Length: 25", b"Content-Length: 35") for x in whole]
    for data in (_archive(whole)[:-9], _archive(short), _archive([*whole, b"more"]), _archive([b"HTTP/1.1 200\r\n\r\n"]), _archive(whole + whole), _archive(whole[:2])):
        with pytest.raises((warc.BrokenArchive, zlib.error)):
            list(warc.Reader(io.BytesIO(data)).records())


# Merkle manifests


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text) -> str:
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute_tower(nodes: list[str]) -> list[list[str]]:
    floors = [nodes]
    while len(floors[-1]) > 1:
        floors.append([sha(*floors[-1][i : i + 3]) for i in range(0, len(floors[-1]), 3)])
    return floors


def brute_path(floors, i):
    found = []
    for nodes in floors[:-1]:
        start = i // 3 * 3
        found.append((nodes[start:i], nodes[i + 1 : start + 3]))
        i //= 3
    return found


def brute_manifest(rows) -> list[tuple]:
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r, leaf_of(r, r.text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0].doc_id is not None, int(x[1][:15], 16) if x[0].doc_id is None else x[0].doc_id, x[1][15:30]))
    towers = {g: brute_tower([leaf for _, leaf in groups[g]]) for g in names}
    top = brute_tower([towers[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (r, leaf) in enumerate(groups[g]):
            path = brute_path(towers[g], i) + brute_path(top, k)
            cut = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf_of(r, r.text.replace("\n", "") if cut else r.text)
            for left, right in path:
                node = sha(*left, node, *right)
            proof = sha(*(x for left, right in path for x in left + right))
            out.append((r.doc_id, leaf, towers[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def proved(docs):
    return catalog.manifest_of(docs).collect()


def test_manifest_of_the_table(spark, folder):
    docs = catalog.documents(spark, folder)
    found = proved(docs)
    assert same(found, brute_manifest(docs.collect()))
    assert 0 < sum(r.verified for r in found) < len(found)


def test_manifest_of_odd_rows(spark):
    """Null ids, sources and texts, repeated rows, ids that share a source, sparse and negative ids."""
    ids = [-5, -(1 << 62), (1 << 62) + 3, 4095, 4096, 8192, 1 << 36, (1 << 63) - 1, -(1 << 63)]
    more = [(i, "a\nb", None, s, i % 7) for i in ids for s in (None, "", "é", "Z", "z:9")]
    more += [(4, f"other {i}", "en", "s", 1) for i in range(3)] + [(None, f"no id {i}", None, None, None) for i in range(5)]
    docs = odd(spark).union(spark.createDataFrame(more + more[:7], SCHEMA)).repartition(5)
    wide = docs.withColumns({"leaf": F.lit("clash"), "GROUP": F.lit(1), "pos": F.lit(2)})
    assert same(proved(wide), brute_manifest(docs.collect()))
    assert proved(docs.limit(0)) == []
    assert same(proved(docs.where("doc_id = 1")), brute_manifest(docs.where("doc_id = 1").collect()))


def test_manifest_of_several_rounds(spark):
    """More leaves than one array holds, in one source, and more sources than one array holds."""
    r = random.Random(3)
    rows = [(r.randrange(10**6), f"t{i}\n", None, "hot" if i < 2500 else f"s{i}", 1) for i in range(3400)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA)
    assert same(proved(docs), brute_manifest(docs.collect()))


def test_equal_rows_are_counted_before_they_meet(spark):
    docs = documents(spark, [(1, prose(1, 5))]).select("*", F.explode(F.sequence(F.lit(1), F.lit(40_000))).alias("copy")).drop("copy")
    found = proved(docs)
    assert len(found) == 40_000 and len({r.leaf for r in found}) == 1 and len({r.root for r in found}) == 1
    assert found[0].root == brute_tower([found[0].leaf] * 40_000)[-1][0]


def test_ranks_are_numbers_of_smaller_values(spark):
    r = random.Random(9)
    rows = [(str(r.randrange(3)), r.choice([r.randrange(100), r.randrange(10**5), r.randrange(-(1 << 60), 1 << 60)]), r.randrange(1, 4)) for _ in range(800)]
    found, shared = manifest.ranked(spark.createDataFrame(rows, "g string, v long, n long"), ["g"], "v", "n", "rank")
    assert shared
    for x in found.collect():
        assert x["rank"] == sum(n for g, v, n in rows if g == x.g and v < x.v)
