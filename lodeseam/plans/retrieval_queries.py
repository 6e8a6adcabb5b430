"""Queries of retrieval, with their SQL. As queries serve the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam import providers
from lodeseam.functions import text
from lodeseam.operators import retrieval as R
from lodeseam.plans.text_queries import IX, QA, SQL as _TEXT_SQL, WORDS, _index, _qa
from lodeseam.session import cut_lineage, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    ix = table(spark, d, "doc_index").where("embedding_valid").select("id", F.col("embedding").alias("v"))
    return R.usable_vectors(ix, "v", 64).dropDuplicates(["id"])


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).where("id % 100 = 0 and question is not null").select(F.col("id").alias("query_id"), F.col("question").alias("query"))


VEC = "(select distinct on (id) id, embedding::double[] v from doc_index where embedding_valid and len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0)"
Q = f"(select id query_id, question query from {QA} where id % 100 = 0 and question is not null)"


def _knn_sql(distance: str, k: int) -> str:
    return (
        f"with v as {VEC}, p as (select q.id query_id, d.id, round({distance}, 6) distance from v q, v d where q.id % 100 = 0) "
        f"select query_id, id, distance, \"rank\"::int \"rank\" from (select *, row_number() over (partition by query_id order by distance, id) \"rank\" from p where not isnan(distance)) where \"rank\" <= {k}"
    )


@query(_knn_sql("1 - list_cosine_similarity(q.v, d.v)", 15))
def knn_cosine(spark, d):
    v = _vectors(spark, d)
    return R.knn(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 15)


@query(_knn_sql("list_distance(q.v, d.v)", 5))
def knn_l2(spark, d):
    v = _vectors(spark, d)
    return R.knn(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 5, metric="l2")


EMB = (
    "(select id, dim, w / sqrt(sum(w * w) over (partition by id)) w from (select id, ('0x' || substr(h, 1, 8))::bigint % 64 dim, sum(case when ('0x' || substr(h, 9, 1))::int % 2 = 0 then 1.0 else -1.0 end)::double w "
    "from (select id, sha256(unnest({w})) h from {t}) group by 1, 2) where w <> 0)"
)


@query(f"select id, dim, round(w, 6) w from {EMB.format(w=WORDS.format('content'), t=IX.format('content'))}")
def hash_embedding(spark, d):
    e = _index(spark, d, "content").select("id", F.posexplode(providers.embed(F.col("content"))).alias("dim", "w"))
    return e.where("w <> 0").select("id", F.col("dim").cast("bigint").alias("dim"), F.round("w", 6).alias("w"))


def _bm25(content: str, q: str) -> str:
    return (
        f"t as (select id, {WORDS.format('content')} w from {content}), n as (select count(*) n, avg(len(w)) a from t), "
        "df as (select term, count(*) df from (select id, unnest(list_distinct(w)) term from t) group by 1), raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) r from df, n), "
        "idf as (select term, case when r < 0 then 0.25 * (select avg(r) from raw) else r end idf from raw), "
        f"qt as (select query_id, term, count(*) qtf from (select query_id, unnest({WORDS.format('query')}) term from {q}) group by 1, 2), "
        "tf as (select id, term, len, count(*) tf from (select id, len(w) len, unnest(w) term from t) where term in (select term from qt) group by 1, 2, 3), "
        "bm as (select query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) score from tf join qt using (term) join idf using (term), n group by 1, 2)"
    )


@query(
    f"with {_bm25(IX.format('content'), Q)} select query_id, id, score, \"rank\"::int \"rank\" from (select *, row_number() over (partition by query_id order by score desc, id) \"rank\" from bm where score > 0) where \"rank\" <= 10"
)
def bm25_topk(spark, d):
    return R.bm25_top(_index(spark, d, F.col("content").alias("text")), _questions(spark, d), 10)


@query(
    f"with t as (select id, {WORDS.format('content')} w from {IX.format('content')}), n as (select count(*) n, avg(len(w)) a from t), df as (select term, count(*) df from (select unnest(list_distinct(w)) term from t) group by 1) "
    "select term, df, round(ln(n - df + 0.5) - ln(df + 0.5), 6) idf from df, n"
)
def bm25_stats(spark, d):
    t = _index(spark, d, "content").select(text.words(F.col("content")).alias("w"))
    n = t.count()
    df = t.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5), 6).alias("idf"))


SP = "(select distinct on (id) id, map_entries(sparse_vector) e from doc_index where sparse_vector is not null)"


@query(
    f"with s as (select id, unnest(e) x from {SP}), p as (select a.id query_id, b.id, round(sum(a.x.value * b.x.value), 6) score from s a join s b on a.x.key = b.x.key where a.id % 100 = 0 group by 1, 2) "
    "select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) r from p where score > 0) where r <= 10"
)
def sparse_dot(spark, d):
    s = table(spark, d, "doc_index").where("sparse_vector is not null").select("id", F.col("sparse_vector").alias("v")).dropDuplicates(["id"])
    scores = R.sparse_scores(s, s.where("id % 100 = 0").withColumnRenamed("id", "query_id")).where("score > 0")
    return R.top_k(scores, "query_id", [F.desc("score"), F.col("id")], 10).drop("rank")


def _hybrid(spark: SparkSession, d: str, k: int, include_propositions: bool = False, questions: DataFrame | None = None) -> DataFrame:
    """Dense and lexical rankings of the questions over all texts, fused; propositions left out before ranking."""
    ix = _index(spark, d, "content", "level", "media_type").where(F.coalesce(F.col("media_type") != "image", F.lit(False)))
    if not include_propositions:
        ix = ix.where(~F.col("level").eqNullSafe(0))
    q = _questions(spark, d) if questions is None else questions
    docs = ix.select("id", F.col("content").alias("text"))
    dense = R.knn(docs.select("id", providers.embed(F.col("text")).alias("v")), q.select("query_id", providers.embed(F.col("query")).alias("v")), k)
    lexical = R.bm25_top(docs, q, 2 * k)
    alpha = q.select("query_id", text.select_alpha(F.col("query"), F.lit(False)).alias("alpha"))
    return R.fuse(dense, lexical, alpha, k)


def _fused_sql(k: int, where: str, Q: str = Q) -> str:
    ix = f"(select distinct id, content from doc_index where media_type <> 'image' and {where})"
    alpha = _TEXT_SQL["select_alpha"].split(" alpha from ")[0].replace("select id, ", "").replace("question", "query").replace("then 0.75", "then 0.55")
    return (
        f"{_bm25(ix, Q)}, de as {EMB.format(w=WORDS.format('content'), t=ix)}, qe as {EMB.format(w=WORDS.format('query'), t='(select query_id id, query from ' + Q + ')')}, "
        # documents that share no slot with the query have distance 1
        f"dd as (select q.query_id, x.id, round(1 - coalesce(s, 0), 6) distance from {Q} q cross join (select distinct id from de) x left join (select qe.id query_id, de.id, sum(qe.w * de.w) s from qe join de using (dim) group by 1, 2) j on j.query_id = q.query_id and j.id = x.id), "
        f"dr as (select *, row_number() over (partition by query_id order by distance, id) r from dd qualify r <= {k}), lr as (select *, row_number() over (partition by query_id order by score desc, id) r from bm where score > 0 qualify r <= {2 * k}), "
        f"al as (select query_id, {alpha} alpha from {Q}), u as (select query_id, id, max(dr) dense_rank, max(lr) lex_rank from (select query_id, id, r dr, null lr from dr union all select query_id, id, null, r from lr) group by 1, 2), "
        "sc as (select u.*, round(alpha * coalesce(1.0::double / (60 + dense_rank), 0) + (1 - alpha) * coalesce(1.0::double / (60 + lex_rank), 0), 9) score from u join al using (query_id)), "
        f"hy as (select *, row_number() over (partition by query_id order by score desc, dense_rank nulls last, lex_rank nulls last, id) \"rank\" from sc qualify \"rank\" <= {k})"
    )


@query(f"with {_fused_sql(15, 'level is distinct from 0')} select query_id, id, dense_rank::int dense_rank, lex_rank::int lex_rank, score, \"rank\"::int \"rank\" from hy")
def rrf_hybrid(spark, d):
    return _hybrid(spark, d, 15)


@query(
    f"with {_fused_sql(15, 'true')}, ix as (select distinct id, parent_id, level from doc_index), h as (select hy.*, ix.parent_id, ix.level, p.id pid from hy join ix using (id) left join ix p on ix.parent_id = p.id where ix.level is distinct from 0 or ix.parent_id is not null), "
    "s as (select *, case when level = 0 and pid is not null then parent_id else id end shown_id, row_number() over (partition by query_id, case when level = 0 then parent_id else id end order by \"rank\") f from h) "
    "select query_id, id, shown_id, \"rank\"::int \"rank\" from s where f = 1"
)
def parent_expand(spark, d):
    docs = _index(spark, d, "parent_id", "level")
    return R.expand_propositions(_hybrid(spark, d, 15, include_propositions=True), docs).select("query_id", "id", "shown_id", "rank")


def _texts(spark, d, hits: DataFrame) -> DataFrame:
    return hits.join(_index(spark, d, F.col("content").alias("text"), "source", "page"), "id").join(_questions(spark, d), "query_id")


_CITE = "'• ' || regexp_extract(replace(source, '\\', '/'), '[^/]*$') || case when page <> 0 then ', p.' || page else '' end"
_PLAIN = "source || case when page is not null then ' (page ' || page || ')' else '' end"


@query(
    f"with {_fused_sql(15, 'level is distinct from 0')}, e as (select query_id, {_CITE} entry, min(\"rank\") first from hy join {IX.format('source, page')} using (id) group by 1, 2) "
    "select query_id, string_agg(entry, chr(10) order by first, entry) citations from e group by 1"
)
def source_citations(spark, d):
    """The sources of each question's hits, in the order in which they are first met."""
    h = _hybrid(spark, d, 15).join(_index(spark, d, "source", "page"), "id")
    each = h.groupBy("query_id", text.citation(F.col("source"), F.col("page")).alias("entry")).agg(F.min("rank").alias("first"))
    return each.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("first", "entry"))).getField("entry"), "\n").alias("citations"))


@query(f"with {_fused_sql(15, 'level is distinct from 0')} select query_id, string_agg(s, '; ' order by s) sources from (select distinct query_id, {_PLAIN} s from hy join {IX.format('source, page')} using (id)) group by 1")
def legacy_sources(spark, d):
    s = F.concat("source", F.when(F.col("page").isNotNull(), F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise(""))
    each = _hybrid(spark, d, 15).join(_index(spark, d, "source", "page"), "id").select("query_id", s.alias("s")).distinct()
    return each.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("s")), "; ").alias("sources"))


_F1 = f"(2.0::double * len(list_intersect(list_distinct({WORDS.format('query')}), list_distinct({WORDS.format('content')}))) / (len(list_distinct({WORDS.format('query')})) + len(list_distinct({WORDS.format('content')}))))"


@query(
    f"with {_fused_sql(10, 'level is distinct from 0')}, c as (select query_id, hy.id, round({_F1}, 6) score, \"rank\" r from hy join {IX.format('content')} using (id) join {Q} using (query_id)) "
    "select query_id, id, score, \"rank\"::int \"rank\" from (select *, row_number() over (partition by query_id order by score desc, r) \"rank\" from c) where \"rank\" <= 5"
)
def cross_rerank(spark, d):
    h = _texts(spark, d, _hybrid(spark, d, 10)).withColumn("ce", F.round(providers.rerank_score(F.col("query"), F.col("text")), 6)).withColumnRenamed("rank", "r")
    return R.top_k(h.drop("score"), "query_id", [F.desc("ce"), F.col("r")], 5).select("query_id", "id", F.col("ce").alias("score"), "rank")


@query(
    f"with {_fused_sql(10, 'level is distinct from 0')}, c as (select query_id, hy.id, round({_F1}, 6) score, \"rank\" r from hy join {IX.format('content')} using (id) join {Q} using (query_id)), "
    "o as (select *, row_number() over (partition by query_id order by score desc, r) o, count(*) over (partition by query_id) n from c) "
    "select query_id, id, (case when n <= 2 then r when o = 1 then 1 when o = 2 then n else o - 1 end)::int place from o"
)
def attention_reorder(spark, d):
    h = _texts(spark, d, _hybrid(spark, d, 10)).withColumn("ce", F.round(providers.rerank_score(F.col("query"), F.col("text")), 6))
    return R.reorder_for_attention(h, "ce").select("query_id", "id", "place")


def _token_vectors(c):
    """Eight-dimensional vectors of unit length from the digests of words."""
    raw = F.transform(text.words(c), lambda w: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substring(F.sha2(w, 256), 2 * j + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1))
    return F.transform(raw, lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, y: s + y * y))))


@query(
    f"with qw as (select query_id, generate_subscripts(w, 1) i, sha256(unnest(w)) h from (select query_id, {WORDS.format('query')} w from {Q})), qv as (select query_id, i, list_transform(range(0, 8), lambda j: ('0x' || substr(h, (2 * j + 1)::bigint, 2))::int / 127.5::double - 1) v from qw), "
    "dv as (select distinct on (id) id, colbert_vecs from doc_index where colbert_vecs is not null), d as (select id, unnest(colbert_vecs)::double[] v from dv), "
    "m as (select query_id, id, i, max(list_dot_product(qv.v, d.v) / sqrt(list_dot_product(qv.v, qv.v))) m from qv, d group by 1, 2, 3), "
    "a as (select query_id, id, round(avg(m), 5) score from m group by 1, 2) select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) r from a) where r <= 10"
)
def maxsim(spark, d):
    """Late interaction of the questions with every row that has token vectors; the ten best of each question."""
    docs = table(spark, d, "doc_index").where("colbert_vecs is not null").select("id", F.col("colbert_vecs").cast("array<array<double>>").alias("dv")).dropDuplicates(["id"])
    return R.max_sim_top(docs, _questions(spark, d).select("query_id", _token_vectors(F.col("query")).alias("qv")), 10, 5)


@query()
def mmr_select(spark, d):
    """Five diverse of each question's fifteen fused hits."""
    h = _texts(spark, d, _hybrid(spark, d, 15)).select("query_id", "id", "rank", providers.embed(F.col("text")).alias("v"), providers.embed(F.col("query")).alias("q"))
    return R.mmr(h, 5, 0.7)


@query()
def legacy_mmr(spark, d):
    h = _texts(spark, d, _hybrid(spark, d, 15)).select("query_id", "id", "rank", providers.embed(F.col("text")).alias("v"), providers.embed(F.col("query")).alias("q"))
    return R.mmr(h, 10, 0.7, unit=False)


def retrieve_chain_hits(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """Fifteen fused, seven reranked, five diverse, in the order of attention."""
    h = _texts(spark, d, _hybrid(spark, d, k)).withColumn("ce", F.round(providers.rerank_score(F.col("query"), F.col("text")), 6)).withColumnRenamed("rank", "r").drop("score")
    seven = R.top_k(h, "query_id", [F.desc("ce"), F.col("r")], 7)
    vectors = seven.select("query_id", "id", "rank", providers.embed(F.col("text")).alias("v"), providers.embed(F.col("query")).alias("q"))
    five = R.mmr(vectors, 5, 0.7).withColumnRenamed("place", "rank")
    return R.reorder_for_attention(five.join(seven.select("query_id", "id", "query", "text", "source", "page", "ce"), ["query_id", "id"]), "ce")


@query()
def retrieve_chain(spark, d):
    return retrieve_chain_hits(spark, d).select("query_id", "id", "ce", "place")


def observations(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    """``query_id, observation``: the three best reranked hits of whatever is asked (``query_id, query``) as one text."""
    asked = cut_lineage(asked.select("query_id", "query"))
    h = _hybrid(spark, d, 10, questions=asked).join(_index(spark, d, F.col("content").alias("text"), "source", "page"), "id").join(asked, "query_id")
    h = h.withColumn("ce", F.round(providers.rerank_score(F.col("query"), F.col("text")), 6)).withColumnRenamed("rank", "r").drop("score")
    three = R.top_k(h, "query_id", [F.desc("ce"), F.col("r")], 3).withColumn("s", text.snippet(F.col("source"), F.col("page"), F.col("text")))
    return three.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "s"))).alias("l")).select("query_id", F.array_join("l.s", "\n\n---\n\n").alias("observation"))


@query()
def agent_chain(spark, d):
    return observations(spark, d, _questions(spark, d))


#: The second sub-query of a question: what stands behind its first three words.
_REST = r"^(?:\S+\s+){1,3}"
Q2 = f"(select query_id, regexp_replace(query, '{_REST}', '') query from {Q})"


@query(
    f"with a as (with {_fused_sql(15, 'level is distinct from 0')} select * from hy), b as (with {_fused_sql(15, 'level is distinct from 0', Q2)} select * from hy), "
    "h as (select query_id question_id, id, \"rank\" r, score, 1 query_no from a union all select query_id, id, \"rank\", score, 2 from b), "
    "f as (select *, first_value(query_no) over w fq, first_value(r) over w fr, row_number() over (partition by question_id, id order by query_no desc, r desc) l from h window w as (partition by question_id, id order by query_no, r)) "
    "select question_id, id, fq::int first_query, fr::int first_rank, score from f where l = 1"
)
def multi_query_union(spark, d):
    """Two searches per question, one for it and one for its end alone, and the union of their hits."""
    q = _questions(spark, d)
    both = q.select(F.col("query_id").alias("question_id"), F.posexplode(F.array("query", F.regexp_replace("query", _REST, ""))).alias("no", "query"))
    # both are asked in one pass over the documents, under numbers of their own
    both = cut_lineage(both.select(F.xxhash64("question_id", "no").alias("query_id"), "question_id", (F.col("no") + 1).alias("query_no"), "query"))
    hits = _hybrid(spark, d, 15, questions=both.select("query_id", "query")).join(both.select("query_id", "question_id", "query_no"), "query_id")
    return R.union_hits(hits.select("question_id", "query_no", "id", "rank", "score"))


@query(
    f"with {_fused_sql(15, 'level is distinct from 0')}, ov as (select query_id, hy.id, query, content, doc_type, 1 - distance dot, len(list_intersect({WORDS.format('query')}, {WORDS.format('content')})) overlap from hy join dd using (query_id, id) join {IX.format('content, doc_type')} using (id) join {Q} using (query_id)) "
    f"select query_id, id, round(0.6 * round(dot, 6) + 0.4 * overlap / greatest(max(overlap) over (partition by query_id), 1) + case when len(list_filter({WORDS.format('query')}, lambda w: contains(lower(content), w))) > 0 then 0.05 else 0 end + case when contains(lower(query), lower(doc_type)) then 0.05 else 0 end, 6) score from ov"
)
def linear_hybrid(spark, d):
    h = _hybrid(spark, d, 15).select("query_id", "id")
    both = h.join(_index(spark, d, F.col("content").alias("text"), F.col("doc_type").alias("section")), "id").join(_questions(spark, d), "query_id")
    dot = F.aggregate(F.zip_with(providers.embed(F.col("text")), providers.embed(F.col("query")), lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return R.linear_hybrid(both.withColumn("dot", F.round(dot, 6))).select("query_id", "id", "score")


@query("select case when sum(len(" + WORDS.format("content") + ")) * 1.3 < 0.75 * 50000 then 'whole_corpus' else 'retrieve' end plan from " + IX.format("content"))
def cag_bypass(spark, d):
    n = _index(spark, d, "content").agg(F.sum(text.word_count(F.col("content"))).alias("n"))
    return n.select(F.when(F.col("n") * 1.3 < 0.75 * 50000, "whole_corpus").otherwise("retrieve").alias("plan"))


@query()
def ann_recall(spark, d):
    """Recall of the inverted file against the exact nearest five."""
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index, centres = R.ivf_index(v, 16)
    exact, near = R.knn(v, q, 5), R.ivf_search(index, centres, q, 5, probes=8)
    hit = exact.select("query_id", "id").join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.count("*").alias("n"))
