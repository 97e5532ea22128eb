"""Text features and term weights on labelled documents; three classes from two labels."""

from pyspark.sql import functions as F

from ledgerlens.functions import lexicons as L
from ledgerlens.operators import text as X
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage

SENT = "sent AS (SELECT doc_id, text, quality+toxic AS label FROM documents JOIN labels USING (doc_id))"
STOP = list(dict.fromkeys(L.STOPWORDS + L.REPORT_STOPWORDS))
_in = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
TOK = f"tok AS (SELECT doc_id, label, list_filter(regexp_extract_all(lower(text), '[a-zA-Z]+(?:''[a-zA-Z]+)?'), lambda w: w NOT IN ({_in(L.STOPWORDS)}) AND length(w)>2) AS t FROM sent)"
_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\s\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')"


def sentences(t):
    return X.spread(t.documents.select("doc_id", "text")).join(t.labels, "doc_id").select("doc_id", "text", (F.col("quality") + F.col("toxic")).alias("label"))


def _gram_sql(n):
    return "t" if n == 1 else f"[array_to_string(t[i:i+{n - 1}], ' ') FOR i IN range(1, greatest(len(t)-{n - 2}, 1))]"


def _top_sql(n, k):
    return f"""g AS (SELECT label, gram, count(*) AS n FROM (SELECT label, unnest({_gram_sql(n)}) AS gram FROM tok) GROUP BY 1,2),
top AS (SELECT label, gram, n, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, gram) i FROM g) WHERE i<={k})"""


@query("top_ngrams", "X1 X2 W17", f"WITH {SENT}, {TOK}, {_top_sql(1, 20)} SELECT * FROM top")
def top_ngrams(t):
    return X.top_ngrams(sentences(t), "text", "label", 1, 20)


@query("top_bigrams", "X2", f"WITH {SENT}, {TOK}, {_top_sql(2, 20)} SELECT * FROM top")
def top_bigrams(t):
    return X.top_ngrams(sentences(t), "text", "label", 2, 20)


@query("vocab_by_class", "X3", f"""
WITH {SENT}, {TOK} SELECT label, mean_tokens, coalesce(vocabulary,0) AS vocabulary FROM (SELECT label, avg(len(t)) AS mean_tokens FROM tok GROUP BY 1)
LEFT JOIN (SELECT label, count(DISTINCT w) AS vocabulary FROM (SELECT label, unnest(t) AS w FROM tok) GROUP BY 1) USING (label)""", "mean_tokens")
def vocab_by_class(t):
    return X.vocabulary(sentences(t), "text", "label")


@query("flesch", "X4", f"""
WITH w AS (SELECT doc_id, text, {_SPLIT.format('text')} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w)=0 THEN 0 ELSE 206.835-1.015*(len(w)*1.0/greatest(len(regexp_split_to_array(text,'[.!?]+')),1))
  -84.6*(list_sum(list_transform(w, lambda x: greatest(1, length(regexp_replace(x,'[^aeiouAEIOU]','','g')))))/len(w)) END AS flesch FROM w""", "flesch")
def flesch(t):
    return t.documents.select("doc_id", X.flesch("text").alias("flesch"))


@query("term_disc", "X5 A19", f"""
WITH {SENT}, {TOK}, {_top_sql(1, 40)},
p AS (SELECT gram, coalesce(sum(n) FILTER (label=0),0) a, coalesce(sum(n) FILTER (label=1),0) b, coalesce(sum(n) FILTER (label=2),0) c FROM g WHERE gram IN (SELECT gram FROM top) GROUP BY 1)
SELECT gram, greatest(a,b,c)/(a+b+c+1) AS disc, a/(a+b+c) AS class_0, b/(a+b+c) AS class_1, c/(a+b+c) AS class_2 FROM p WHERE a+b+c>=3 ORDER BY disc DESC, gram LIMIT 20""",
       "disc class_0 class_1 class_2")
def term_disc(t):
    return X.discriminative_terms(sentences(t), "text", "label", [0, 1, 2])


def _lex(words):
    return f"CAST(len(list_filter(d, lambda x: x IN ({_in(words)}))) AS INTEGER)"


LEXICAL = f"""
WITH a AS (SELECT doc_id, text, lower(text) AS lo, {_SPLIT.format('lower(text)')} AS w FROM documents), b AS (SELECT *, list_distinct(w) AS d FROM a)
SELECT doc_id, CAST(len(w) AS INTEGER) AS word_count, CAST(length(text) AS INTEGER) AS char_count,
 coalesce(list_sum(list_transform(w, lambda x: length(x)))*1.0/nullif(len(w),0),0) AS avg_word_length,
 {_lex(L.POSITIVE)} AS lm_positive, {_lex(L.NEGATIVE)} AS lm_negative, {_lex(L.UNCERTAINTY)} AS lm_uncertainty, {_lex(L.MODAL_STRONG)} AS lm_modal_strong,
 {_lex(L.POSITIVE)}*1.0/({_lex(L.NEGATIVE)}+1) AS lm_pos_neg_ratio,
 CAST({" OR ".join("contains(lo, '" + n.replace("'", "''") + "')" for n in L.NEGATIONS)} AS INTEGER) AS has_negation,
 CAST(regexp_matches(text, '\\p{{Nd}}') AS INTEGER) AS has_numeric,
 length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))*1.0/greatest(length(text),1) AS uppercase_ratio,
 CAST(length(text)-length(replace(text,'!','')) AS INTEGER) AS exclamation_count FROM b"""


@query("text_lexical", "X6", LEXICAL, "avg_word_length lm_pos_neg_ratio uppercase_ratio")
def text_lexical(t):
    return X.lexical_features(X.spread(t.documents.select("doc_id", "text")), "text").drop("text")


@query("text_disclosure", "X7", f"""
WITH a AS (SELECT doc_id, text, {_SPLIT.format('text')} AS w FROM documents)
SELECT doc_id, CAST(length(text) AS INTEGER) AS fe_text_len, CAST(len(w) AS INTEGER) AS fe_word_count,
 coalesce(list_sum(list_transform(w, lambda x: length(x)))*1.0/nullif(len(w),0),0) AS fe_avg_word_len,
 len(regexp_extract_all(text, '(?i){"|".join(L.CLIMATE)}'))*1.0/greatest(len(w),1) AS fe_claim_density FROM a""", "fe_avg_word_len fe_claim_density")
def text_disclosure(t):
    return X.disclosure_features(X.spread(t.documents.select("doc_id", "text")), "text").drop("text")


TERMS = rf"""
k AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '1', 'g'), '\b[a-z][a-z-]{{1,}}\b'),
  lambda w: w NOT IN ({_in(STOP)})) AS t FROM sent),
terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM k UNION ALL SELECT doc_id, unnest({_gram_sql(2)}) FROM k) GROUP BY 1,2)"""


def _weights_sql(terms, max_terms, max_df=0.95):
    return f"""
nd AS (SELECT count(*) AS nd FROM sent),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, ln((1+any_value(nd))/(1.0+count(*)))+1 AS idf FROM {terms}, nd GROUP BY term
  HAVING count(*)>=2 AND count(*)<={max_df}*any_value(nd) ORDER BY total DESC, term LIMIT {max_terms}),
raw AS (SELECT doc_id, term, (1+ln(tf))*idf AS w FROM {terms} JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, w/sqrt(sum(w*w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def weights(t, max_terms=8000):
    rows = sentences(t)
    terms = cut_lineage(X.word_terms(rows, "doc_id", "text", STOP))  # texts are split once, for the fit and to apply it
    vocab = X.fit_tfidf(terms, rows.agg(F.count(F.lit(1))).scalar(), 2, 0.95, max_terms)
    return X.apply_tfidf(terms, vocab, "doc_id"), vocab


@query("tfidf", "X8", f"WITH {SENT}, {TERMS}, {_weights_sql('terms', 8000)} SELECT doc_id, term, weight FROM weights", "weight")
def tfidf(t):
    return weights(t)[0]


@query("tfidf_vocabulary", "X8", f"WITH {SENT}, {TERMS}, {_weights_sql('terms', 8000)} SELECT * FROM vocab", "idf")
def tfidf_vocabulary(t):
    return weights(t)[1]


CHARS = rf"""
cw AS (SELECT doc_id, ' '||w||' ' AS p, count(*) AS n FROM (SELECT doc_id, unnest({_SPLIT.format('lower(text)')}) AS w FROM sent) GROUP BY 1,2),
chars AS (SELECT doc_id, term, CAST(sum(n) AS BIGINT) AS tf FROM (
  SELECT doc_id, n, unnest([substring(p, i, 2) FOR i IN range(1, length(p))]) AS term FROM cw UNION ALL
  SELECT doc_id, n, unnest([substring(p, i, 3) FOR i IN range(1, length(p)-1)]) FROM cw UNION ALL
  SELECT doc_id, n, unnest([substring(p, i, 4) FOR i IN range(1, greatest(length(p)-2,1))]) FROM cw) GROUP BY 1,2)"""


@query("char_tfidf", "X9", f"WITH {SENT}, {CHARS}, {_weights_sql('chars', 3000)} SELECT doc_id, term, weight FROM weights", "weight")
def char_tfidf(t):
    rows = sentences(t)
    terms = X.char_terms(rows, "doc_id", "text")  # counted again to apply it: cheaper than to store a row per gram
    vocab = X.fit_tfidf(terms, rows.agg(F.count(F.lit(1))).scalar(), 2, 0.95, 3000)
    return X.apply_tfidf(terms, vocab, "doc_id")


CHI2 = """
share AS (SELECT label, count(*)*1.0/(SELECT count(*) FROM sent) AS p FROM sent GROUP BY 1),
obs AS (SELECT term, label, sum(weight) AS o FROM weights JOIN sent USING (doc_id) GROUP BY 1,2),
f AS (SELECT term, sum(o) AS f FROM obs GROUP BY 1),
chi AS (SELECT term, round(sum((coalesce(o,0)-f*p)**2/(f*p)),9) AS chi2 FROM f CROSS JOIN share LEFT JOIN obs USING (term, label) GROUP BY 1)"""


@query("chi2_terms", "X10", f"WITH {SENT}, {TERMS}, {_weights_sql('terms', 2000)}, {CHI2} SELECT term, chi2 FROM chi ORDER BY chi2 DESC, term LIMIT 200", "chi2")
def chi2_terms(t):
    return X.chi2_terms(weights(t, 2000)[0], sentences(t), "doc_id", "label", 200)


@query("tfidf_top_terms", "X11 W17", f"""WITH {SENT}, {TERMS}, {_weights_sql('terms', 8000)},
m AS (SELECT label, term, round(sum(weight)/any_value(nl),9) AS mean_weight FROM weights JOIN sent USING (doc_id) JOIN (SELECT label, count(*) nl FROM sent GROUP BY 1) USING (label) GROUP BY 1,2)
SELECT label, term, mean_weight, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_weight DESC, term) i FROM m) WHERE i<=20""", "mean_weight")
def tfidf_top_terms(t):
    return X.class_term_means(weights(t)[0], sentences(t), "doc_id", "label", 20)


_LEXICAL_NAMES = ["word_count", "char_count", "avg_word_length", "lm_positive", "lm_negative", "lm_uncertainty", "lm_modal_strong", "lm_pos_neg_ratio", "has_negation",
                  "has_numeric", "uppercase_ratio", "exclamation_count"]


@query("combined_features", "X12", f"""WITH {SENT}, {TERMS}, {_weights_sql('terms', 2000)}, {CHI2},
chosen AS (SELECT term FROM chi ORDER BY chi2 DESC, term LIMIT 50), lexical AS ({LEXICAL.replace('FROM documents', 'FROM sent')}),
part AS (SELECT doc_id, sum(weight) AS s FROM weights WHERE term IN (SELECT term FROM chosen) GROUP BY 1)
SELECT doc_id, CAST({len(_LEXICAL_NAMES)} + (SELECT count(*) FROM chosen) AS INTEGER) AS n_features, {"+".join(f"coalesce({c},0)" for c in _LEXICAL_NAMES)}+coalesce(s,0) AS total
FROM lexical LEFT JOIN part USING (doc_id)""", "total")
def combined_features(t):
    from pyspark.ml.functions import vector_to_array

    rows = sentences(t)
    weighted = weights(t, 2000)[0]  # texts are split once, for the choice and for the columns
    chosen = [r["term"] for r in X.chi2_terms(weighted, rows, "doc_id", "label", 50).collect()]
    blocks = [X.lexical_features(rows, "text").drop("text", "label"), X.pivot_terms(weighted, "doc_id", chosen)]
    arrays = X.combine_blocks(blocks, "doc_id").withColumn("v", vector_to_array("features"))
    return arrays.select("doc_id", F.size("v").alias("n_features"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


def vowel_counts(pdf):
    """Stands in for a caller's embedding model: one vector per text."""
    out = pdf[["doc_id"]].copy()
    for v in "aeiou":
        out[f"v_{v}"] = pdf["text"].str.count(v).astype("float64")
    return out


@query("batch_embedding", "X13", "SELECT doc_id, " + ", ".join(f"(length(text)-length(replace(text,'{v}','')))*1.0 AS v_{v}" for v in "aeiou") + " FROM documents", " ".join(f"v_{v}" for v in "aeiou"))
def batch_embedding(t):
    return X.map_batches(t.documents.select("doc_id", "text"), vowel_counts, "doc_id long, " + ", ".join(f"v_{v} double" for v in "aeiou"), batch=32)
