"""Purchase sequences and ranking."""

from pyspark.sql import functions as F

from basketry.operators import profiling, sequences
from basketry.plans.registry import query
from basketry.session import materialised
from basketry.sources import views
from basketry.sources.views import with_views

BINS, MAX_LEN = 10, 30


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def customer_segments(spark, d):
    return views.customers(spark, d).select("customer_id", (F.col("age") % 5).alias("customer_cluster"))


def registry(spark, d):
    return sequences.token_registry(views.transactions(spark, d), customer_segments(spark, d), True, BINS)


def prepared(spark, d, tokens=None):
    tokens = tokens or materialised(registry(spark, d))
    return sequences.prepare_sequences(
        views.transactions(spark, d), tokens, customer_segments(spark, d), True, BINS, MAX_LEN
    )


REGISTRY = f"""reg0 AS (SELECT DISTINCT 0 AS o, 'ITEM' AS kind, article_id AS value FROM tx
 UNION SELECT DISTINCT 1, 'SEG', age % 5 FROM cu UNION SELECT DISTINCT 2, 'CH', sales_channel_id FROM tx
 UNION SELECT 3, 'PB', i FROM range({BINS}) t(i)),
reg AS (SELECT kind, value::BIGINT AS value, CASE WHEN kind = 'ITEM' THEN value::VARCHAR ELSE kind || '=' || value END AS key,
 row_number() OVER (ORDER BY o, value) + 1 AS token FROM reg0)"""


@query("j01_token_registry", with_views("tx cu", "SELECT * FROM reg", REGISTRY))
def j01(spark, d):
    return registry(spark, d)


@query("j02_deduplicate", with_views("tx", "SELECT DISTINCT * FROM tx"))
def j02(spark, d):
    return sequences.deduplicate(views.transactions(spark, d))


def band_sql(source, divisor="count(price)"):
    return f"""bands AS (SELECT s.*, least(greatest(floor(dr / (SELECT {divisor} FROM {source}) * {BINS}), 0), {BINS - 1})::INT AS price_bin
 FROM (SELECT *, dense_rank() OVER (ORDER BY price) AS dr FROM {source}) s)"""


@query(
    "e05_price_bands",
    with_views("tx", "SELECT price_bin, count(*) AS n, min(price) AS low, max(price) AS high FROM bands GROUP BY 1", band_sql("tx")),
)
def e05(spark, d):
    return (
        sequences.price_bands(views.transactions(spark, d), BINS)
        .groupBy("price_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    )


@query(
    "e05_price_bands_by_distinct",
    with_views(
        "tx", "SELECT price_bin, count(*) AS n FROM bands GROUP BY 1", band_sql("tx", "count(DISTINCT price)")
    ),
)
def e05_distinct(spark, d):
    banded = sequences.price_bands(views.transactions(spark, d), BINS, by_distinct=True)
    return banded.groupBy("price_bin").agg(F.count(F.lit(1)).alias("n"))


LAST = """lastch AS (SELECT customer_id, arg_max(sales_channel_id, (t_dat, article_id, sales_channel_id)) AS last_channel
 FROM tx GROUP BY customer_id)"""


@query("e07_last_channel", with_views("tx", "SELECT * FROM lastch", LAST))
def e07(spark, d):
    return sequences.last_channel(views.transactions(spark, d))


def known_keys(df):
    return df.filter(F.col("t_dat").isNotNull() & F.col("customer_id").isNotNull() & F.col("article_id").isNotNull())


# Rows that agree in day, article and channel differ in price only, and nulls come first among them.
@query(
    "e08_fill_prices",
    with_views(
        "rtx",
        """SELECT customer_id, t_dat, article_id, sales_channel_id, coalesce(f, last_value(f IGNORE NULLS) OVER
 (PARTITION BY customer_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS price FROM (SELECT *, last_value(price IGNORE NULLS) OVER
 (PARTITION BY customer_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY t_dat NULLS FIRST, article_id, sales_channel_id NULLS FIRST, price NULLS FIRST) AS i FROM rtx
  WHERE t_dat IS NOT NULL AND customer_id IS NOT NULL AND article_id IS NOT NULL))""",
    ),
)
def e08(spark, d):
    return sequences.fill_prices(known_keys(views.raw_transactions(spark, d)))


BANDS = (
    "dd AS (SELECT DISTINCT * FROM tx),\n"
    + band_sql("dd")
    + ", cband AS (SELECT customer_id, floor(median(price_bin))::INT AS price_band FROM bands GROUP BY customer_id)"
)


@query("j03_customer_bands", with_views("tx", "SELECT * FROM cband", BANDS))
def j03(spark, d):
    return sequences.customer_bands(sequences.deduplicate(views.transactions(spark, d)), BINS)


SEQ = f"""{REGISTRY}, {BANDS}, {LAST},
items AS (SELECT customer_id, token, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id DESC) AS back,
 count(*) OVER (PARTITION BY customer_id) AS n FROM dd JOIN reg ON kind = 'ITEM' AND value = article_id),
body AS (SELECT customer_id, list(token ORDER BY back DESC) AS items FROM items WHERE back <= {MAX_LEN - 3} AND n >= 2 GROUP BY customer_id),
seqs AS (SELECT b.customer_id, list_concat([s.token, c.token, p.token], items) AS sequence, 3 AS prefix_length, items[-1] AS last_item
 FROM body b JOIN cu USING (customer_id) JOIN lastch USING (customer_id) JOIN cband USING (customer_id)
 JOIN reg s ON s.kind = 'SEG' AND s.value = age % 5 JOIN reg c ON c.kind = 'CH' AND c.value = last_channel
 JOIN reg p ON p.kind = 'PB' AND p.value = price_band)"""


@query(
    "j04_prefix_tokens",
    with_views("tx cu", "SELECT customer_id, array_to_string(sequence[1:3], ',') AS prefix, prefix_length FROM seqs", SEQ),
)
def j04(spark, d):
    p = prepared(spark, d)
    return p.select(
        "customer_id", F.array_join(F.slice("sequence", 1, 3).cast("array<string>"), ",").alias("prefix"), "prefix_length"
    )


@query(
    "j05_sequences",
    with_views(
        "tx cu", "SELECT customer_id, array_to_string(sequence, ',') AS sequence, prefix_length, last_item FROM seqs", SEQ
    ),
)
def j05(spark, d):
    return prepared(spark, d).select("customer_id", joined("sequence"), "prefix_length", "last_item")


P = sequences.PRIME


def score_sql(salt):
    x = f"((base + (i + 1) * {69_621 * (2 * salt + 1)} + {salt}) % {P})"
    return f"(({x} * {x} + {48_271 * salt + 12_345}) % {P} * 16807 % {P})"


MASKED = f"""rowsx AS (SELECT customer_id, prefix_length, len(sequence) AS n, ('0x' || substr(md5(customer_id || ':42'), 1, 12))::BIGINT % {P} AS base,
 unnest(range(len(sequence))) AS i, unnest(sequence) AS token FROM seqs),
scored AS (SELECT *, CASE WHEN i >= prefix_length THEN {score_sql(1)} END AS s1, {score_sql(2)} AS s2, {score_sql(3)} AS s3 FROM rowsx),
picked AS (SELECT *, i >= prefix_length AND row_number() OVER (PARTITION BY customer_id ORDER BY s1 NULLS LAST, i)
  <= greatest(1, floor((n - prefix_length) * 0.15)) AS chosen FROM scored),
masked AS (SELECT customer_id, i, CASE WHEN NOT chosen THEN token WHEN s2 / {P}.0 < 1 - 0.1 - 0.1 THEN 1 WHEN s2 / {P}.0 < 1 - 0.1
  THEN 2 + s3 % ((SELECT max(token) + 1 FROM reg) - 2) ELSE token END AS inp, CASE WHEN chosen THEN token ELSE -100 END AS lab FROM picked)"""


def masked(spark, d):
    tokens = materialised(registry(spark, d))
    vocab_size = tokens.agg(F.max("token")).first()[0] + 1
    return sequences.mask_sequences(prepared(spark, d, tokens), vocab_size)


@query(
    "j06_masked_rows",
    with_views(
        "tx cu",
        """SELECT customer_id, string_agg(inp, ',' ORDER BY i) AS input, string_agg(lab, ',' ORDER BY i) AS labels FROM masked GROUP BY customer_id""",
        f"{SEQ}, {MASKED}",
    ),
)
def j06(spark, d):
    return masked(spark, d).select("customer_id", joined("input"), joined("labels"))


@query(
    "j07_padded_rows",
    with_views(
        "tx cu",
        f"""SELECT customer_id, repeat('0,', 40 - n) || ids AS input_ids, repeat('-100,', 40 - n) || labs AS label_ids,
 repeat('0,', 40 - n) || rtrim(repeat('1,', n), ',') AS attention_mask FROM (SELECT customer_id, count(*) AS n, string_agg(inp, ',' ORDER BY i) AS ids,
 string_agg(lab, ',' ORDER BY i) AS labs FROM masked GROUP BY customer_id)""",
        f"{SEQ}, {MASKED}",
    ),
)
def j07(spark, d):
    out = sequences.pad_left(masked(spark, d), 40)
    return out.select("customer_id", joined("input_ids"), joined("label_ids"), joined("attention_mask"))


@query(
    "j08_evaluation_rows",
    with_views(
        "tx cu",
        """SELECT customer_id, array_to_string(list_concat(sequence[:-2], [1]), ',') AS input,
 repeat('-100,', len(sequence) - 1) || sequence[-1] AS labels FROM seqs""",
        SEQ,
    ),
)
def j08(spark, d):
    out = sequences.evaluation_rows(prepared(spark, d))
    return out.select("customer_id", joined("input"), joined("labels"))


@query(
    "j09_customer_split",
    f"""SELECT c_custkey AS customer_id, CASE WHEN ('0x' || substr(md5(c_custkey || ':42'), 1, 12))::BIGINT % {P} / {P}.0 < 0.1
 THEN 'validation' ELSE 'train' END AS split FROM customer""",
)
def j09(spark, d):
    return sequences.split_customers(views.customers(spark, d).select("customer_id"))


SPLIT = """b AS (SELECT min(t_dat) AS lo, date_diff('day', min(t_dat), max(t_dat)) + 1 AS days FROM tx),
e AS (SELECT lo + floor(days * 0.8)::INT AS te, lo + floor(days * 0.8)::INT + floor(days * 0.1)::INT AS ve FROM b),
sp AS (SELECT tx.*, CASE WHEN t_dat <= te THEN 'train' WHEN t_dat <= ve THEN 'validation' ELSE 'test' END AS split FROM tx, e)"""


@query(
    "j10_temporal_split",
    with_views(
        "tx",
        """SELECT split, min(t_dat) AS first_date, max(t_dat) AS last_date, count(*) AS transactions,
 count(DISTINCT customer_id) AS customers, round(count(*) * 100.0 / (SELECT count(*) FROM tx), 4) AS pct FROM sp GROUP BY split""",
        SPLIT,
    ),
)
def j10(spark, d):
    return rounded(sequences.split_summary(sequences.split_by_date(views.transactions(spark, d))), ["pct"], 4)


KS = [5, 10, 20]

# Last item out, context the item before; followers of the context, then popular items.
NEXT = """ho AS (SELECT customer_id, max(article_id) FILTER (b = 1) AS truth, max(article_id) FILTER (b = 2) AS context, max(t_dat) AS td FROM
 (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id DESC) AS b FROM dd) WHERE b <= 2
 GROUP BY customer_id HAVING count(*) = 2),
tr AS (SELECT * FROM dd WHERE NOT EXISTS (SELECT 1 FROM ho WHERE ho.customer_id = dd.customer_id AND truth = article_id AND td = t_dat)),
nx AS (SELECT * FROM (SELECT article_id AS item, lead(article_id) OVER (PARTITION BY customer_id ORDER BY t_dat, article_id) AS next_item FROM tr)
 WHERE next_item IS NOT NULL),
nc AS (SELECT item, next_item, count(*) AS n FROM nx GROUP BY ALL),
fo AS (SELECT item, next_item AS candidate, 1 + n / sum(n) OVER (PARTITION BY item) AS score,
 row_number() OVER (PARTITION BY item ORDER BY n DESC, next_item) AS i FROM nc),
po AS (SELECT article_id AS candidate, count(*) / (SELECT count(*) FROM tr) AS score FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
me AS (SELECT item, candidate, max(score) AS score FROM (SELECT item, candidate, score FROM fo WHERE i <= 20 UNION ALL
 SELECT item, candidate, score FROM (SELECT DISTINCT article_id AS item FROM tr), po) GROUP BY ALL),
sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS rank FROM me) WHERE rank <= 20),
pre AS (SELECT customer_id, truth, candidate, score, rank, candidate = truth AS correct FROM ho JOIN sc ON item = context)"""
DD = "dd AS (SELECT DISTINCT * FROM tx)"


def next_item_case(spark, d):
    train, cases = sequences.leave_last_out(materialised(sequences.deduplicate(views.transactions(spark, d))))
    train, cases = materialised(train), materialised(cases)
    return sequences.transition_scores(train, 20), cases, train


@query(
    "j14_next_item_scores",
    with_views("tx", "SELECT item, candidate, round(score, 6) AS score, rank FROM sc", f"{DD}, {NEXT}"),
)
def j14(spark, d):
    scores, _, _ = next_item_case(spark, d)
    return rounded(scores, ["score"])


@query(
    "j13_top_predictions",
    with_views("tx", "SELECT customer_id, truth, candidate, round(score, 6) AS score, rank, correct FROM pre WHERE rank <= 5", f"{DD}, {NEXT}"),
)
def j13(spark, d):
    scores, cases, _ = next_item_case(spark, d)
    return rounded(sequences.top_predictions(scores, cases, 5), ["score"])


def metrics_sql(source):
    return " UNION ALL ".join(
        f"""SELECT {k} AS k, (SELECT count(*) FROM ho) AS cases,
 (SELECT count(*) FROM {source} WHERE correct AND rank <= {k}) / (SELECT count(*) FROM ho) AS recall,
 (SELECT coalesce(sum(1 / log2(rank + 1)), 0) FROM {source} WHERE correct AND rank <= {k}) / (SELECT count(*) FROM ho) AS ndcg"""
        for k in KS
    )


def model_metrics(spark, d):
    scores, cases, _ = next_item_case(spark, d)
    ranked = sequences.top_predictions(scores, cases, 20).withColumnRenamed("candidate", "item")
    return sequences.ranking_metrics(ranked, cases.select("customer_id", F.col("truth").alias("item")), KS)


@query(
    "j11_ranking_metrics",
    with_views(
        "tx",
        f"SELECT k, cases, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM ({metrics_sql('pre')})",
        f"{DD}, {NEXT}",
    ),
)
def j11(spark, d):
    return rounded(model_metrics(spark, d), ["recall", "ndcg"])


# Popularity alone as the second set-up.
@query(
    "j16_compare_metrics",
    with_views(
        "tx",
        f"""SELECT k, round(a.recall, 6) AS recall_1, round(a.ndcg, 6) AS ndcg_1, round(b.recall, 6) AS recall_2, round(b.ndcg, 6) AS ndcg_2,
 round(b.recall - a.recall, 6) AS recall_change, round(b.ndcg - a.ndcg, 6) AS ndcg_change
FROM ({metrics_sql('pre')}) a JOIN ({metrics_sql('pop')}) b USING (k)""",
        f"""{DD}, {NEXT}, pr AS (SELECT candidate, row_number() OVER (ORDER BY score DESC, candidate) AS rank FROM po),
pop AS (SELECT customer_id, rank, candidate = truth AS correct FROM ho, pr)""",
    ),
)
def j16(spark, d):
    _, cases, train = next_item_case(spark, d)
    top = train.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "article_id").limit(20)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "article_id"))).alias("l")).scalar()
    ranked = cases.select("customer_id", F.posexplode(listed).alias("p", "c")).select(
        "customer_id", F.col("c.article_id").alias("item"), (F.col("p") + 1).alias("rank")
    )
    popular = sequences.ranking_metrics(ranked, cases.select("customer_id", F.col("truth").alias("item")), KS)
    out = sequences.compare_metrics(model_metrics(spark, d), popular)
    return rounded(out, [c for c in out.columns if c != "k"])


@query(
    "j12_sequence_statistics",
    with_views(
        "tx cu",
        """SELECT count(*) AS sequences, min(len(sequence)) AS min_length, max(len(sequence)) AS max_length,
 round(avg(len(sequence)), 6) AS mean_length, round(avg(prefix_length), 6) AS mean_prefix, median(len(sequence)) AS median_length,
 round(quantile_cont(len(sequence), 0.95), 6) AS p95_length FROM seqs""",
        SEQ,
    ),
)
def j12(spark, d):
    out = sequences.sequence_statistics(materialised(prepared(spark, d)))
    return rounded(out, ["mean_length", "mean_prefix", "p95_length"])


@query(
    "j12_vocabulary_make_up",
    with_views("tx cu", "SELECT kind, count(*) AS tokens FROM reg GROUP BY kind", REGISTRY),
)
def j12_vocab(spark, d):
    return sequences.vocabulary_make_up(registry(spark, d))


@query(
    "j15_segment_distribution",
    with_views(
        "tx cu",
        """SELECT 'customer_cluster' AS "column", (age % 5)::VARCHAR AS value, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, (age % 5)::VARCHAR) AS rank,
 round(count(*) * 100.0 / (SELECT count(*) FROM ev), 4) AS pct FROM ev JOIN cu USING (customer_id) GROUP BY age % 5""",
        SPLIT + ", ev AS (SELECT DISTINCT customer_id FROM sp WHERE split = 'test')",
    ),
)
def j15(spark, d):
    tested = sequences.split_by_date(views.transactions(spark, d)).filter(F.col("split") == "test")
    population = customer_segments(spark, d).join(tested.select("customer_id"), "customer_id", "left_semi")
    return rounded(profiling.top_values(population, ["customer_cluster"]), ["pct"], 4)


@query(
    "g10_decode_tokens",
    with_views(
        "tx cu",
        """SELECT customer_id, last_item AS token, value AS article_id FROM seqs JOIN reg ON kind = 'ITEM' AND token = last_item""",
        SEQ,
    ),
)
def g10(spark, d):
    tokens = materialised(registry(spark, d))
    last = prepared(spark, d, tokens).select("customer_id", F.col("last_item").alias("token"))
    return sequences.decode(last, tokens)
