"""Complaint text analysis as set-based Spark jobs.

Every per-text decision (cleaning, sentiment, category, priority) is a column
expression evaluated inside the scan stage; keyword extraction is the only
step that needs a shuffle (word frequencies per text).  Word lists are the
fixed values of ``murmur.constants``; callers may pass their own.

* clean_text: lower, drop URLs, drop e-mail-like tokens, keep only ASCII
  letters, digits, white space and . , ! ?, collapse white space; null -> ''.
* sentiment: count of negative / positive terms occurring as substrings of
  the lower-cased text; more negative -> (negative, -0.5), more positive ->
  (positive, 0.5), else (neutral, 0.0).
* category: per category the number of its terms occurring; the highest wins,
  the first category in list order on ties, none -> Other.
* priority: critical if score < -0.6 and an urgent term occurs; high if an
  urgent term occurs or score < -0.5; medium if score < -0.2; else low.
* keywords: lower-cased words without punctuation, not stop words, longer
  than 3 characters; the 5 most frequent, earlier first occurrence on ties.
* A null text yields the failure row: unknown / 0.0 / Other / low / [].
"""

from __future__ import annotations

from collections import Counter
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.constants import (CATEGORY_TERMS, KEYWORD_MIN_LENGTH, KEYWORD_STOP_WORDS, KEYWORDS_KEPT, NO_KEYWORDS,
                              NEGATIVE_TERMS, OTHER_CATEGORY, POLARITY_NEGATIVE, POLARITY_POSITIVE,
                              POSITIVE_TERMS, PRIORITY_CRITICAL_SCORE, PRIORITY_HIGH_SCORE,
                              PRIORITY_LEVELS, PRIORITY_MEDIUM_SCORE, SENTIMENT_SCORE, URGENT_TERMS)
from murmur.functions.text import (EMAIL_PATTERN_ANCHORED, NON_WORD_PATTERN, SPECIAL_PATTERN, URL_PATTERN,
                                   count_contained, any_contained, squeeze_spaces, whole_word_count, words)

LEMMA_CHUNK_BYTES = 4_000_000           # texts whose distinct words are looked up together
ANALYSIS_COLUMNS = ["complaint_id", "original_text", "cleaned_text", "sentiment", "sentiment_score",
                    "category", "priority", "keywords"]


def clean_text(c: Column, lowercase: bool = True, remove_urls: bool = True, remove_emails: bool = True,
               remove_special_chars: bool = True) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    if lowercase:
        s = F.lower(s)
    # a URL needs 'http' or 'www.', an e-mail-like token needs '@': the byte
    # scans skip the regular expressions for the many texts without them
    if remove_urls:
        s = F.when(s.contains("http") | s.contains("www."), F.regexp_replace(s, URL_PATTERN, "")).otherwise(s)
    if remove_emails:
        s = F.when(s.contains("@"), F.regexp_replace(s, EMAIL_PATTERN_ANCHORED, "")).otherwise(s)
    if remove_special_chars:
        s = F.regexp_replace(s, SPECIAL_PATTERN, "")
    return squeeze_spaces(s)


def remove_stopwords(c: Column, stop_words: list[str]) -> Column:
    """Drop stop words (case-insensitive), white-space tokens."""
    stops = F.array(*[F.lit(w.lower()) for w in stop_words])
    kept = F.filter(words(c), lambda w: ~F.array_contains(stops, F.lower(w)))
    return F.array_join(kept, " ")


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: rows are told apart by their texts, whatever their ids."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """(word) of every distinct white-space token."""
    return df.select(F.explode(words(F.col(text_col))).alias("word")).distinct()


def lemmatize(df: DataFrame, text_col: str, id_col: str | None, lemmas: DataFrame | None) -> DataFrame:
    """Replace tokens by lemmas from a (form, lemma) table; identity without a table.

    Texts are dealt to chunks of a few MB; the distinct words of a chunk are
    joined to the forms that change, and a chunk's texts are rebuilt with the
    lemmas found.  Texts without a form that changes stay as they are.
    Rows that share an id, or have none, keep their own texts (``id_col`` is
    not used); of several lemmas of a form the smallest counts.
    """
    if lemmas is None:
        return df
    text = F.col(text_col)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(*df.columns), F.lit(size // LEMMA_CHUNK_BYTES + 1))
    placed = df.withColumn("_chunk", chunk)
    tokens = placed.select("_chunk", text.alias("_t")).repartition("_chunk").select(
        "_chunk", F.explode(F.array_distinct(words(F.col("_t")))).alias("form")).distinct()
    forms = lemmas.filter(F.col("form") != F.col("lemma")).groupBy("form").agg(F.min("lemma").alias("lemma"))
    found = tokens.join(forms, "form").select(F.col("_chunk").alias("_at"), "form", "lemma")

    def rebuild(group: pa.Table, changed: pa.Table) -> pa.Table:
        group = group.drop_columns("_chunk")
        lemma = dict(zip(changed.column("form").to_pylist(), changed.column("lemma").to_pylist()))
        out = []
        for t in group.column(text_col).to_pylist():
            parts = t.split() if t else []              # the white space of ``words``
            out.append(" ".join([lemma.get(w, w) for w in parts]) if not lemma.keys().isdisjoint(parts) else t)
        return group.set_column(group.column_names.index(text_col), text_col, pa.array(out, pa.string()))

    return placed.groupBy("_chunk").cogroup(found.groupBy("_at")).applyInArrow(rebuild, df.schema)


def preprocess(df: DataFrame, text_col: str, stop_words: list[str] | None = KEYWORD_STOP_WORDS,
               lemmas: DataFrame | None = None, out_col: str = "cleaned_text", **cleaning) -> DataFrame:
    """``df`` plus ``out_col``: cleaned, stop words dropped, lemmas in place of forms, spaces squeezed.

    A null text gives ''.  ``cleaning`` are the switches of ``clean_text``;
    None leaves out the stop word or lemma step.
    """
    # each step reads the one before as a column (it is used several times and must be computed once)
    out = df.withColumn(out_col, clean_text(F.col(text_col), **cleaning))
    if stop_words:
        out = out.withColumn(out_col, squeeze_spaces(remove_stopwords(F.col(out_col), stop_words)))
    return lemmatize(out, out_col, None, lemmas)


def sentiment(text: Column, negative: list[str] = NEGATIVE_TERMS, positive: list[str] = POSITIVE_TERMS,
              low: Column | None = None):
    """(label, score) columns from substring term hits (``low``: the text already lower-cased)."""
    low = F.lower(text) if low is None else low
    neg, pos = count_contained(low, negative), count_contained(low, positive)
    label = (F.when(text.isNull(), "unknown").when(neg > pos, "negative").when(pos > neg, "positive")
             .otherwise("neutral"))
    score = (F.when(text.isNull(), 0.0).when(neg > pos, -SENTIMENT_SCORE).when(pos > neg, SENTIMENT_SCORE)
             .otherwise(0.0))
    return label, score.cast("double")


def lexicon_polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Mean weight of the matched tokens from a caller's (term, weight) table.

    Returns (id, polarity, sentiment) with polarity rounded to 3 digits and the
    +/- 0.1 thresholds; texts without a matched token get 0 / neutral.  Rows
    that share an id keep their own texts' polarity.
    """
    text = F.col(text_col)
    toks = df.select(*_text_key(text), F.explode(words(F.regexp_replace(F.lower(text), NON_WORD_PATTERN, ""))).alias("term"))
    pol = toks.join(lexicon.select("term", "weight"), "term").groupBy("_k1", "_k2").agg(F.avg("weight").alias("_p"))
    out = df.select(id_col, *_text_key(text)).join(pol, ["_k1", "_k2"], "left").select(
        id_col, F.coalesce(F.floor(F.col("_p") * 1000 + 0.5) / 1000, F.lit(0.0)).alias("polarity"))
    return out.withColumn("sentiment", F.when(F.col("polarity") > POLARITY_POSITIVE, "positive")
                          .when(F.col("polarity") < POLARITY_NEGATIVE, "negative").otherwise("neutral"))


def category_struct(low: Column, categories: dict[str, list[str]] = CATEGORY_TERMS,
                    whole_word: bool = False) -> Column:
    """struct(s = best score, o = -position, c = name) of the winning category."""
    scored = []
    for i, (name, terms) in enumerate(categories.items()):
        score = whole_word_count(low, terms) if whole_word else count_contained(low, terms)
        scored.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("c")))
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def classify_category(text: Column, categories: dict[str, list[str]] = CATEGORY_TERMS,
                      whole_word: bool = False, low: Column | None = None) -> Column:
    """Category with most term hits; list order breaks ties; Other when none."""
    best = category_struct(F.lower(text) if low is None else low, categories, whole_word)
    return F.when(text.isNull() | (best["s"] == 0), OTHER_CATEGORY).otherwise(best["c"])


def determine_priority(text: Column, score: Column, urgent: list[str] = URGENT_TERMS,
                       low: Column | None = None) -> Column:
    has_urgent = any_contained(F.lower(text) if low is None else low, urgent)
    return (F.when(text.isNull(), "low")
            .when((score < PRIORITY_CRITICAL_SCORE) & has_urgent, "critical")
            .when(has_urgent | (score < PRIORITY_HIGH_SCORE), "high")
            .when(score < PRIORITY_MEDIUM_SCORE, "medium")
            .otherwise("low"))


def keyword_tokens(df: DataFrame, id_col: str, text_col: str,
                   stop_words: list[str] = KEYWORD_STOP_WORDS) -> DataFrame:
    """(id, pos, word) for the candidate keywords of each text."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    cleaned = F.regexp_replace(F.lower(F.col(text_col)), NON_WORD_PATTERN, "")
    toks = df.select(id_col, F.posexplode(words(cleaned)).alias("pos", "word"))
    return toks.filter((F.length("word") >= KEYWORD_MIN_LENGTH) & ~F.array_contains(stops, F.col("word")))


def with_top_keywords(df: DataFrame, text_col: str, out_col: str = "_top_keywords", n: int = KEYWORDS_KEPT,
                      stop_words: list[str] = KEYWORD_STOP_WORDS) -> DataFrame:
    """Add ``out_col``: array<struct<word, freq, first_pos>> of the ``n`` top keywords, in rank order.

    Row-local: a text is one row, so its words are counted in an Arrow batch
    with no shuffle and no join back to the text.
    """
    stops = frozenset(stop_words)
    least = KEYWORD_MIN_LENGTH

    def top(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            tokens = t.split() if t else []             # the white space of ``words``
            held = Counter(tokens)                      # by first occurrence, which ``nsmallest`` keeps on ties
            best = nsmallest(n, ((w, k) for w, k in held.items() if len(w) >= least and w not in stops), key=lambda x: -x[1])
            out.append([{"word": w, "freq": k, "first_pos": tokens.index(w)} for w, k in best])
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("freq", pa.int64()), ("first_pos", pa.int64())])))

    cleaned = F.regexp_replace(F.lower(F.col(text_col)), NON_WORD_PATTERN, "")
    count = F.arrow_udf(top, "array<struct<word: string, freq: bigint, first_pos: bigint>>")
    return df.withColumn(out_col, count(cleaned))


def extract_keywords(df: DataFrame, id_col: str, text_col: str, n: int = KEYWORDS_KEPT,
                     stop_words: list[str] = KEYWORD_STOP_WORDS, row_local: bool = False) -> DataFrame:
    """(id, word, freq, first_pos, rank) for the top ``n`` keywords of every text.

    Rows that share an id are one text.  An id of one row takes its keywords
    from ``with_top_keywords``, so only ids are shuffled; the rows of repeated
    ids are aggregated by (id, word), with a top-n window.
    ``row_local=True`` gives every row its own keywords.
    """
    if not row_local:
        shared = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_id")
        own = extract_keywords(df, id_col, text_col, n, stop_words, row_local=True)
        if shared.isEmpty():
            return own
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        freq = word_frequencies(df.join(shared, same, "left_semi"), id_col, text_col, stop_words)
        w = Window.partitionBy(id_col).orderBy(F.desc("freq"), "first_pos")
        ranked = freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n) \
            .select(id_col, "word", "freq", F.col("first_pos").cast("bigint").alias("first_pos"), "rank")
        return own.join(shared, same, "left_anti").union(ranked)
    top = with_top_keywords(df.select(id_col, text_col), text_col, "_top", n, stop_words)
    top = top.select(id_col, F.posexplode("_top").alias("_r", "_k"))
    return top.select(id_col, F.col("_k.word").alias("word"), F.col("_k.freq").alias("freq"),
                      F.col("_k.first_pos").alias("first_pos"), (F.col("_r") + 1).alias("rank"))


def word_frequencies(df: DataFrame, id_col: str, text_col: str,
                     stop_words: list[str] = KEYWORD_STOP_WORDS) -> DataFrame:
    """Set-based (id, word, freq, first_pos) of every candidate keyword (all words, not only the top)."""
    toks = keyword_tokens(df, id_col, text_col, stop_words)
    return toks.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first_pos"))


def keyword_lists(keywords: DataFrame, id_col: str) -> DataFrame:
    """(id, keywords array in rank order) from ``extract_keywords`` rows."""
    return keywords.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_k")) \
        .select(id_col, F.transform("_k", lambda s: s["word"]).alias("keywords"))


def analyze_complaints(df: DataFrame, id_col: str = "complaint_id", text_col: str = "complaint_text",
                       n_keywords: int = KEYWORDS_KEPT, whole_word: bool = False,
                       row_local_keywords: bool = True, with_keywords: bool = True) -> DataFrame:
    """The full per-text analysis (ANALYSIS_COLUMNS), computed on the original text.

    Keywords are row-local by default: no shuffle, and repeated or null ids
    keep their own.  ``row_local_keywords=False`` aggregates by (id, word) and
    needs unique ids.
    """
    # the lower-cased text is its own column, referenced by every term test
    # (the optimizer keeps a projection that is used many times)
    pre = df.select(F.col(id_col).alias("complaint_id"), F.col(text_col).alias("original_text"),
                    F.lower(F.col(text_col)).alias("_low"))
    text, low = F.col("original_text"), F.col("_low")
    # term counts are columns of their own: each is referenced several times
    # by the decisions below and must be computed once per text
    hits = pre.select("complaint_id", "original_text",
                      count_contained(low, NEGATIVE_TERMS).alias("_neg"),
                      count_contained(low, POSITIVE_TERMS).alias("_pos"),
                      any_contained(low, URGENT_TERMS).alias("_urg"),
                      category_struct(low, whole_word=whole_word).alias("_best"))
    neg, pos = F.col("_neg"), F.col("_pos")
    label = (F.when(text.isNull(), "unknown").when(neg > pos, "negative").when(pos > neg, "positive")
             .otherwise("neutral"))
    score = (F.when(text.isNull(), 0.0).when(neg > pos, -SENTIMENT_SCORE).when(pos > neg, SENTIMENT_SCORE)
             .otherwise(0.0)).cast("double")
    scored = hits.select("complaint_id", "original_text", "_urg", "_best", label.alias("sentiment"),
                         score.alias("sentiment_score"))
    sc, urg = F.col("sentiment_score"), F.col("_urg")
    priority = (F.when(text.isNull(), "low")
                .when((sc < PRIORITY_CRITICAL_SCORE) & urg, "critical")
                .when(urg | (sc < PRIORITY_HIGH_SCORE), "high")
                .when(sc < PRIORITY_MEDIUM_SCORE, "medium")
                .otherwise("low"))
    category = F.when(text.isNull() | (F.col("_best.s") == 0), OTHER_CATEGORY).otherwise(F.col("_best.c"))
    empty = F.array().cast("array<string>")
    if not with_keywords:
        # summaries that never read keywords skip their aggregation and join
        return scored.select(
            "complaint_id", "original_text", clean_text(text).alias("cleaned_text"), "sentiment", "sentiment_score",
            category.alias("category"), priority.alias("priority"), empty.alias("keywords"))
    if row_local_keywords:
        scored = with_top_keywords(scored, "original_text", "_top", n_keywords)
        keywords = F.when(text.isNull(), empty).otherwise(F.transform("_top", lambda k: k["word"]))
        return scored.select(
            "complaint_id", "original_text", clean_text(text).alias("cleaned_text"), "sentiment", "sentiment_score",
            category.alias("category"), priority.alias("priority"), keywords.alias("keywords"))
    base = scored.select(
        "complaint_id", "original_text", clean_text(text).alias("cleaned_text"), "sentiment", "sentiment_score",
        category.alias("category"), priority.alias("priority"))
    kw = keyword_lists(extract_keywords(df, id_col, text_col, n_keywords), id_col) \
        .withColumnRenamed(id_col, "complaint_id")
    return base.join(kw, "complaint_id", "left") \
        .withColumn("keywords", F.coalesce(F.col("keywords"), empty)).select(*ANALYSIS_COLUMNS)


def text_summary(analyzed: DataFrame) -> DataFrame:
    """One row: totals, mean score, percent negative, high + critical count."""
    return analyzed.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg("sentiment_score").alias("mean_sentiment_score"),
        (F.count(F.when(F.col("sentiment") == "negative", 1)) * 100.0 / F.count(F.lit(1))).alias("pct_negative"),
        F.count(F.when(F.col("priority").isin("high", "critical"), 1)).alias("high_priority"),
        F.count_distinct("category").alias("categories"),
    )


def distributions(analyzed: DataFrame) -> DataFrame:
    """(field, value, count) for sentiment, category and priority in one GROUPING SETS pass."""
    g = analyzed.groupingSets([[F.col("sentiment")], [F.col("category")], [F.col("priority")]],
                              "sentiment", "category", "priority") \
        .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
    field = F.when(F.col("_gid") == 3, "sentiment").when(F.col("_gid") == 5, "category").otherwise("priority")
    value = F.when(F.col("_gid") == 3, F.col("sentiment")).when(F.col("_gid") == 5, F.col("category")) \
        .otherwise(F.col("priority"))
    return g.select(field.alias("field"), value.alias("value"), "count")


def value_distribution(analyzed: DataFrame, col: str, top: int | None = None) -> DataFrame:
    d = analyzed.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)
    return d.limit(top) if top else d


def priority_distribution(analyzed: DataFrame) -> DataFrame:
    """Priority counts in fixed order, zeros included (left join from the level list)."""
    levels = analyzed.sparkSession.createDataFrame([(i, p) for i, p in enumerate(PRIORITY_LEVELS)],
                                                   "priority_rank int, priority string")
    counts = analyzed.groupBy("priority").agg(F.count(F.lit(1)).alias("count"))
    return levels.join(counts, "priority", "left").select(
        "priority_rank", "priority", F.coalesce("count", F.lit(0)).alias("count"))


def sentiment_by_category(analyzed: DataFrame) -> DataFrame:
    """Crosstab category x sentiment (fixed sentiment columns, zeros filled)."""
    return analyzed.groupBy("category").pivot("sentiment", ["negative", "neutral", "positive", "unknown"]) \
        .agg(F.count(F.lit(1))).na.fill(0)


def overview_kpis(analyzed: DataFrame) -> DataFrame:
    return analyzed.agg(
        F.count(F.lit(1)).alias("total"),
        (F.count(F.when(F.col("sentiment") == "negative", 1)) * 100.0 / F.count(F.lit(1))).alias("pct_negative"),
        F.count(F.when(F.col("priority").isin("high", "critical"), 1)).alias("high_priority"),
        F.count_distinct("category").alias("categories"))


def filter_text(analyzed: DataFrame, sentiments=None, categories=None) -> DataFrame:
    out = analyzed
    if sentiments:
        out = out.filter(F.col("sentiment").isin(*sentiments))
    if categories:
        out = out.filter(F.col("category").isin(*categories))
    return out


def format_report(analyzed: DataFrame) -> DataFrame:
    """A multi-line text report per analysed complaint; a text without keywords names none."""
    topics = F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise(NO_KEYWORDS)
    report = F.concat(
        F.lit("Complaint: "), F.coalesce(F.col("original_text"), F.lit("")),
        F.lit("\nSentiment: "), F.upper("sentiment"),
        F.lit("\nSentiment Score: "), F.format_string("%.3f", F.col("sentiment_score")),
        F.lit("\nCategory: "), F.col("category"), F.lit("\nPriority Level: "), F.upper(F.col("priority")),
        F.lit("\nKey Topics: "), topics)
    return analyzed.select("complaint_id", report.alias("report"))


def load_text_dedup(df: DataFrame, text_col: str | None = None, id_col: str = "complaint_id",
                    order_col: str | None = None) -> DataFrame:
    """Accept ``complaint_text`` or ``text``; drop null texts, keep the first of duplicate texts.

    "First" is the smallest ``order_col`` (default: the id column).  Needs an
    id column: the caller supplies a key; generated ids would depend on file
    order.
    """
    if text_col is None:
        text_col = "complaint_text" if "complaint_text" in df.columns else "text"
    if text_col not in df.columns:
        raise ValueError("input needs a 'complaint_text' or 'text' column")
    if text_col != "complaint_text":
        df = df.withColumnRenamed(text_col, "complaint_text")
    order_col = order_col or id_col
    w = Window.partitionBy("complaint_text").orderBy(order_col)
    return df.filter(F.col("complaint_text").isNotNull()) \
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
