"""Corpus operators: tokens, n-grams, readability, lexical features and term weights.

Rows are whole texts. Per-text work uses array functions inside one row; corpus
statistics are grouped counts. A term table is long: document, term, weight.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerlens.functions import lexicons as L
from ledgerlens.functions import scalars as S
from ledgerlens.operators.ordering import slice_count
from ledgerlens.session import cut_lineage

# whitespace as Python's str.split() sees it
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
WORD_PATTERN = r"[a-zA-Z]+(?:'[a-zA-Z]+)?"
TERM_PATTERN = r"\b[a-z][a-z-]{1,}\b"
#: Character n-grams and words that a task remembers, and n-gram rows that it hands over at once.
GRAMS, GRAM_ROWS = 1 << 17, 1 << 17


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a source to all cores if it is read in fewer pieces, for work that costs more than moving its rows.

    A large source is read in more pieces than there are cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def words(text: str | Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(S.col(text), SPACE), lambda w: w != "")


def tokens(text: str | Column, stopwords: Sequence[str] = tuple(L.STOPWORDS), min_length: int = 3) -> Column:
    """Lower-case letter words without stopwords and short words."""
    found = F.regexp_extract_all(F.lower(S.col(text)), F.lit(WORD_PATTERN), F.lit(0))
    return F.filter(found, lambda w: (~w.isin(*stopwords)) & (F.length(w) >= min_length))


def ngrams(tokens_: Column, n: int) -> Column:
    """Neighbouring tokens joined by a space."""
    if n == 1:
        return tokens_
    starts = F.when(F.size(tokens_) >= n, F.sequence(F.lit(1), F.size(tokens_) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens_, i, n), " "))


def flesch(text: str | Column) -> Column:
    """Approximate reading ease: vowels stand for syllables, at least one per word; 0 for empty text."""
    t = S.col(text)
    w = words(t)
    n = F.size(w)
    sentences = F.greatest(F.size(F.split(t, "[.!?]+")), F.lit(1))
    syllables = F.aggregate(
        w, F.lit(0), lambda acc, x: acc + F.greatest(F.lit(1), F.length(F.regexp_replace(x, "[^aeiouAEIOU]", "")))
    )
    score = 206.835 - 1.015 * (n / sentences) - 84.6 * (syllables / F.nullif(n, F.lit(0)))
    return F.when(n > 0, score).otherwise(0.0)


def _mean_length(w: Column) -> Column:
    total = F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.coalesce(total / F.nullif(F.size(w), F.lit(0)), F.lit(0.0))


LEXICONS = {"positive": L.POSITIVE, "negative": L.NEGATIVE, "uncertainty": L.UNCERTAINTY, "modal_strong": L.MODAL_STRONG}


def lexical_features(df: DataFrame, text: str, lexicons: Mapping[str, Sequence[str]] = LEXICONS, negations: Sequence[str] = tuple(L.NEGATIONS)) -> DataFrame:
    """Twelve features of a sentence. Lexicon features count distinct words.

    A text is split once; one lookup per distinct word finds those of any lexicon, which are few.
    """
    t = F.col(text)
    lower = F.lower(t)
    w = F.col("_w")
    listed = sorted({x for lex in lexicons.values() for x in lex})
    among = lambda lex: lambda x: x.isin(*lex)
    hits = {f"lm_{name}": F.size(F.filter("_d", among(lex))) for name, lex in lexicons.items()}
    negated = F.lit(False)
    for part in negations:
        negated = negated | F.contains(lower, F.lit(part))
    split = df.withColumn("_w", words(lower)).withColumn("_d", F.array_distinct(F.filter("_w", lambda x: x.isin(*listed))))
    return split.withColumns(
        {
            "word_count": F.size(w),
            "char_count": F.length(t),
            "avg_word_length": _mean_length(w),
            **hits,
            "lm_pos_neg_ratio": hits["lm_positive"] / (hits["lm_negative"] + 1),
            "has_negation": S.flag(negated),
            "has_numeric": S.flag(t.rlike(r"\p{Nd}")),
            "uppercase_ratio": F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / F.greatest(F.length(t), F.lit(1)),
            "exclamation_count": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
        }
    ).drop("_w", "_d")


def disclosure_features(df: DataFrame, text: str, keywords: Sequence[str] = tuple(L.CLIMATE)) -> DataFrame:
    """Length, words, mean word length and keyword hits per word; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = words(t)
    hits = F.regexp_count(t, F.lit("(?i)" + "|".join(keywords)))
    return df.withColumns(
        {
            "fe_text_len": F.length(t),
            "fe_word_count": F.size(w),
            "fe_avg_word_len": _mean_length(w),
            "fe_claim_density": hits / F.greatest(F.size(w), F.lit(1)),
        }
    )


# --- counts per class -------------------------------------------------------

def ngram_counts(df: DataFrame, text: str, label: str, n: int = 1, **token_options) -> DataFrame:
    # tokens become a column first: inside the n-gram lambda they would be recomputed per position
    rows = df.select(label, tokens(text, **token_options).alias("_t"))
    grams = rows.select(label, F.explode(ngrams(F.col("_t"), n)).alias("gram"))
    return grams.groupBy(label, "gram").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group; Spark keeps k per group before it shuffles."""
    best = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_ngrams(df: DataFrame, text: str, label: str, n: int = 1, k: int = 20, **token_options) -> DataFrame:
    return top_per_group(ngram_counts(df, text, label, n, **token_options), label, "n", "gram", k)


def vocabulary(df: DataFrame, text: str, label: str, **token_options) -> DataFrame:
    """Distinct tokens and mean tokens per text, by class."""
    rows = df.select(label, tokens(text, **token_options).alias("_t"))
    sizes = rows.groupBy(label).agg(F.avg(F.size("_t")).alias("mean_tokens"))
    vocab = rows.select(label, F.explode("_t").alias("w")).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("vocabulary"))
    return sizes.join(vocab, label, "left").withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0)))


def discriminative_terms(df: DataFrame, text: str, label: str, classes: Sequence, per_class: int = 40, min_count: int = 3, k: int = 20) -> DataFrame:
    """Frequent terms that one class uses most: largest class count over all counts plus one.

    Terms come from the top list of any class, their counts from all texts. Returns class shares.
    """
    counts = cut_lineage(ngram_counts(df, text, label, 1))  # read for the lists and for the counts
    listed = top_per_group(counts, label, "n", "gram", per_class).select("gram").distinct()
    table = counts.join(listed, "gram", "left_semi").groupBy("gram").agg(
        *[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)).alias(f"class_{c}") for c in classes]
    )
    names = [f"class_{c}" for c in classes]
    total = S.row_sum(names)
    scored = table.where(total >= min_count).withColumn("disc", F.greatest(*[F.col(n) for n in names]) / (total + 1))
    best = scored.orderBy(F.desc("disc"), "gram").limit(k)
    return best.select("gram", "disc", *[(F.col(n) / total).alias(n) for n in names])


# --- term weights -----------------------------------------------------------

def plain_text(text: str | Column) -> Column:
    """Lower-case text in which every non-ASCII word character is "1" and other non-ASCII characters are blanks.

    Word boundaries then mean the same in every regular-expression engine.
    """
    lower = F.lower(S.col(text))
    spaced = F.regexp_replace(lower, r"[^\p{L}\p{N}_\x00-\x7F]", " ")
    return F.regexp_replace(spaced, r"[^\x00-\x7F]", "1")


def word_terms(df: DataFrame, doc: str, text: str, stopwords: Sequence[str] = (), max_n: int = 2, pattern: str = TERM_PATTERN) -> DataFrame:
    """Term counts per document for word n-grams: doc, term, tf."""
    found = F.regexp_extract_all(plain_text(text), F.lit(pattern), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found
    rows = df.select(doc, kept.alias("_t"))
    grams = [ngrams(F.col("_t"), n) for n in range(1, max_n + 1)]
    exploded = rows.select(doc, F.explode(F.concat(*grams) if len(grams) > 1 else grams[0]).alias("term"))
    return exploded.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def _padded_grams(word: str, low: int, high: int) -> list[str]:
    """All character n-grams of a word between two blanks; a word shorter than ``low`` is one gram."""
    p = f" {word} "
    return [p[i : i + n] for n in range(low, high + 1) if n == low or len(p) >= n for i in range(max(len(p) - n + 1, 1))]


def char_terms(df: DataFrame, doc: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """Character n-gram counts inside words padded by one blank: doc, term, tf.

    The texts of a document meet in one exchange, of a fixed number of tasks, as grams are many times their bytes, and
    follow each other; a task counts the words and then the grams of one document at a time. No row per gram is shuffled.
    """
    joined = F.array_join(words(F.lower(F.col(text))), " ")
    rows = df.select(doc, joined.alias("_words")).where(F.col("_words") != "").repartition(slice_count(df), doc).sortWithinPartitions(doc)
    key = rows.schema[doc].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}  # of grams
        known: dict[str, np.ndarray] = {}  # grams of words
        ids, hits, tf = [], [], []

        def grams(word: str) -> np.ndarray:
            if word not in known:
                known[word] = np.array([numbers.setdefault(g, len(numbers)) for g in _padded_grams(word, low, high)])
            return known[word]

        def flush() -> pa.RecordBatch:
            which = pa.array(np.repeat(np.arange(len(ids)), [len(h) for h in hits]))
            columns = [pa.array(ids, to_arrow_type(key)).take(which), pa.array([*numbers], pa.string()).take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(tf))]
            for c in (ids, hits, tf):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, [doc, "term", "tf"])

        pairs = ((i, w) for b in batches for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows_held = 0
        for i, texts in itertools.groupby(pairs, key=lambda r: r[0]):
            counts = Counter(itertools.chain.from_iterable(t.split(" ") for _, t in texts))
            lists = [grams(w) for w in counts]
            times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), [len(g) for g in lists])
            found = np.bincount(np.concatenate(lists), times)
            ids.append(i)
            hits.append(np.flatnonzero(found))
            tf.append(found[hits[-1]].astype(np.int64))
            rows_held += len(hits[-1])
            if rows_held >= GRAM_ROWS or len(numbers) >= GRAMS or len(known) >= GRAMS:
                yield flush()
                rows_held = 0
                if len(numbers) >= GRAMS or len(known) >= GRAMS:
                    numbers.clear()
                    known.clear()
        if ids:
            yield flush()

    schema = T.StructType([T.StructField(doc, key), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(counted, schema)


def fit_tfidf(terms: DataFrame, n_docs: Column | int, min_df: int = 2, max_df: float = 1.0, max_terms: int | None = None) -> DataFrame:
    """Vocabulary with document counts and smoothed inverse document frequencies.

    ``max_terms`` keeps the terms with the largest total count, ties by term.
    """
    size = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = stats.withColumn("_size", size).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_size")))
    if max_terms:
        kept = kept.orderBy(F.desc("total"), F.asc("term")).limit(max_terms)
    return kept.select("term", "df", "total", (F.log((1 + F.col("_size")) / (1 + F.col("df"))) + 1).alias("idf"))


def apply_tfidf(terms: DataFrame, vocab: DataFrame, doc: str) -> DataFrame:
    """Sublinear weights with unit length per document: doc, term, weight."""
    raw = terms.join(vocab.select("term", "idf"), "term").select(
        doc, "term", ((1 + F.log(F.col("tf"))) * F.col("idf")).alias("_w")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("_w") / length).alias("weight"))


def class_term_means(weights: DataFrame, docs: DataFrame, doc: str, label: str, k: int = 20) -> DataFrame:
    """Terms with the largest mean weight per class, over all documents of the class."""
    sizes = docs.groupBy(label).agg(F.count(F.lit(1)).alias("_docs"))
    sums = weights.join(docs.select(doc, label), doc).groupBy(label, "term").agg(F.sum("weight").alias("_s"))
    means = sums.join(sizes, label).select(label, "term", F.round(F.col("_s") / F.col("_docs"), 9).alias("mean_weight"))
    return top_per_group(means, label, "mean_weight", "term", k)


def chi2_terms(weights: DataFrame, docs: DataFrame, doc: str, label: str, k: int = 200) -> DataFrame:
    """Chi-squared of summed weights against the class shares; the k largest."""
    sizes = docs.groupBy(label).agg(F.count(F.lit(1)).alias("_docs"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    shares = sizes.withColumn("_share", F.col("_docs") / total).select(label, "_share")
    observed = weights.join(docs.select(doc, label), doc).groupBy("term", label).agg(F.sum("weight").alias("_o"))
    # a class that never uses the term contributes its expected weight
    per = observed.join(shares, label).groupBy("term").agg(
        F.sum("_o").alias("_f"),
        F.sum(F.col("_o") * F.col("_o") / F.col("_share")).alias("_q"),
    )
    scored = per.select("term", F.round(F.col("_q") / F.col("_f") - F.col("_f"), 9).alias("chi2"))
    return scored.orderBy(F.desc("chi2"), "term").limit(k)


def pivot_terms(weights: DataFrame, doc: str, terms: Sequence[str], prefix: str = "tfidf_") -> DataFrame:
    """One column per chosen term; documents without any chosen term are absent."""
    chosen = weights.where(F.col("term").isin(*terms))
    return chosen.groupBy(doc).agg(
        *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("weight"))), F.lit(0.0)).alias(f"{prefix}{t.replace(' ', '_')}") for t in terms]
    )


def combine_blocks(blocks: Sequence[DataFrame], doc: str, name: str = "features") -> DataFrame:
    """Join feature blocks on the document and assemble one vector; absent blocks count as 0."""
    first, *rest = blocks
    out = first
    for b in rest:
        out = out.join(b, doc, "left")
    inputs = [c for c in out.columns if c != doc]
    filled = out.select(doc, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(inputs)])
    return VectorAssembler(inputCols=[f"_{i}" for i in range(len(inputs))], outputCol=name).transform(filled).select(doc, name)


def map_batches(df: DataFrame, fn: Callable, schema: str, batch: int | None = None) -> DataFrame:
    """Apply a caller's batch function (pandas frame in, pandas frame out), e.g. a text embedding."""

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            step = batch or max(len(pdf), 1)
            for i in range(0, len(pdf), step):
                yield fn(pdf.iloc[i : i + step])

    return df.mapInPandas(run, schema)
