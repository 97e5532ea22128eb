"""The registered queries of the corpus operators: name, function of (spark, folder), SQL form or None."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, centroids, decontamination, html_text, language, licenses, manifest, near_dedup, quality, sharding, substring_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_bpe")
def op1_bpe(spark, folder):
    """Token ids of every document and their way back, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, folder).select("doc_id", "text"), path, decoded="decoded", drop=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_quality")
def op2_quality(spark, folder):
    """Base counts and verdict of every document."""
    return quality.quality(documents(spark, folder).select("doc_id", "text"), cleaned=False).drop("text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "n_failed_lines"
    )


@query("op3_sharding")
def op3_sharding(spark, folder):
    """Shard and slot of every document after a global shuffle; row counts of shards are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    light = documents(spark, folder).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    plan = sharding.shuffle_plan(light, ["doc_id", "size", "text_crc32"], shards=8, seed=17)
    return plan.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_token_counts")
def op8_token_counts(spark, folder):
    """Tokens of every document under a sentencepiece model."""
    docs = documents(spark, folder).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows a language model may learn from: crc32 of the id's digits, mod 3, is not 1."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


@query("op10_language")
def op10_language(spark, folder):
    """Language of every document by a model learned from two thirds of them."""
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = language.fit(learnable(docs), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored


@query("op7_html")
def op7_html(spark, folder):
    """Main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op9_licenses", licenses.scan_sql())
def op9_licenses(spark, folder):
    """Licences of every document: as its whole text, and as notices among its lines."""
    return licenses.scan(documents(spark, folder), "doc_id")


@query("op4_near_dedup")
def op4_near_dedup(spark, folder):
    """Component of every document under links of 85 percent."""
    return near_dedup.near_duplicates(documents(spark, folder), percent=85).drop("row")


@query("op6_decontamination")
def op6_decontamination(spark, folder):
    """Documents that hold passages of the benchmark, and which."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.find_leaks(documents(spark, folder), items)


@query("op5_substring_dedup")
def op5_substring_dedup(spark, folder):
    """Passages of every document that an earlier one has too."""
    return substring_dedup.shared_passages(documents(spark, folder)).drop("row")


def clusters_sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """The same rounds with every distance measured, one common table expression a round."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS cluster, v AS c FROM
        (SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM
        (SELECT r, cluster, CAST({distance} AS BIGINT) AS d FROM kept, c{t}) GROUP BY r)""")
        if t < rounds:
            ctes.append(f"""m{t} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS c FROM
            (SELECT cluster, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM
            (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t} JOIN kept USING (r)) GROUP BY ALL)) GROUP BY cluster)""")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (cluster))")
    return f"""WITH {", ".join(ctes)}
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (cluster)"""


@query("op11_centroids", clusters_sql())
def op11_centroids(spark, folder):
    """Cluster of every whole vector after ten rounds from eight seeds."""
    embeddings = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = centroids.whole_vectors(embeddings, "vec_id", "embedding", dim=64, scale=1024)
    return centroids.with_inertia(centroids.cluster(vectors, k=8, rounds=10, seed=3), "vec_id")


def base32_sql(hexadecimal: str) -> str:
    """Base32 of 40 hexadecimal digits: eight times five digits give four characters."""
    parts = []
    for at in range(1, 41, 5):
        number = f"CAST('0x' || substr({hexadecimal}, {at}, 5) AS INT)"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


@query(
    "op12_warc",
    f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {base32_sql("h")} AS payload_digest,
      CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to, TRUE AS verified FROM g""",
)
def op12_warc(spark, folder):
    """Every page as a record of gzip archives, as read back from them."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    archives = warc.write_archives(pages, warc.archive_folder(spark), "page_id", "url", "html", date="2024-01-01T00:00:00Z")
    found = warc.read_archives(archives, payloads=False)
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "verified"
    )


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(a, c), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, c: {bits}), 4294967295)"


def manifest_sql(levels: int = 13, top_levels: int = 6) -> str:
    """The same trees level by level, with a row a node, for groups of at most 3^levels rows without repeated ids."""

    def e(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"

    def folded(nodes: str, many: int) -> list[str]:
        """Tables {nodes}0.. of nodes, {nodes}s0.. of what stands left and right of them."""
        out, run = [], "PARTITION BY g, pos // 3 ORDER BY pos ROWS BETWEEN"
        for t in range(many):
            out.append(f"""{nodes}s{t} AS MATERIALIZED (SELECT g, pos, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
            coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {nodes}{t} WHERE n > 1)""")
            out.append(f"""{nodes}{t + 1} AS MATERIALIZED (SELECT g, pos // 3 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d, (n + 2) // 3 AS n
            FROM {nodes}{t} WHERE n > 1 GROUP BY g, pos // 3, n)""")
        return out

    def climbed(rows: str, nodes: str, many: int) -> list[str]:
        return [
            f"""{rows}{t + 1} AS (SELECT r.* REPLACE (r.pos // 3 AS pos, coalesce(sha256(s.a || r.f || s.b), r.f) AS f, r.p || coalesce(s.a || s.b, '') AS p)
            FROM {rows}{t} r LEFT JOIN {nodes}s{t} s USING (g, pos))"""
            for t in range(many)
        ]

    def roots(nodes: str, many: int) -> str:
        return " UNION ALL ".join(f"SELECT g, d FROM {nodes}{t} WHERE n = 1" for t in range(many + 1))

    head = " || ".join(e(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes = [
        f"""x AS MATERIALIZED (SELECT doc_id, source, {e("source")} AS g, sha256({head} || {e("text")}) AS leaf,
        sha256({head} || CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {e("replace(text, chr(10), '')")} ELSE {e("text")} END) AS claimed,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)""",
        "l0 AS MATERIALIZED (SELECT g, pos, leaf AS d, n FROM x)",
        *folded("l", levels),
        f"subroots AS MATERIALIZED ({roots('l', levels)})",
        """t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, d, count(*) OVER () AS n, s.g AS own
        FROM subroots s JOIN (SELECT DISTINCT g, source FROM x) USING (g))""",
        *folded("t", top_levels),
        f"top AS MATERIALIZED ({roots('t', top_levels)})",
        "r0 AS (SELECT doc_id, leaf, g, pos, claimed AS f, '' AS p FROM x)",
        *climbed("r", "l", levels),
        f"u0 AS (SELECT doc_id, leaf, '' AS g, t0.pos, f, p, t0.d AS subroot FROM r{levels} r JOIN t0 ON t0.own = r.g)",
        *climbed("u", "t", top_levels),
    ]
    return f"""WITH {", ".join(ctes)} SELECT doc_id, leaf, subroot, top.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = top.d AS verified
    FROM u{top_levels}, top"""


def manifest_of(docs: DataFrame) -> DataFrame:
    """Manifest of documents; where 2 divides crc32 of the id's digits, a text without its line ends is held against it."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaf = manifest.leaf_digest([*fields, F.col("text")])
    changed = manifest.leaf_digest([*fields, F.replace("text", F.lit("\n"), F.lit(""))])
    return manifest.proofs(docs, "doc_id", "source", leaf, F.when(tampered & F.contains("text", F.lit("\n")), changed).otherwise(leaf))


@query("op13_manifest", manifest_sql())
def op13_manifest(spark, folder):
    """Leaf, proof and verdict of every document under a manifest of all."""
    return manifest_of(documents(spark, folder))
