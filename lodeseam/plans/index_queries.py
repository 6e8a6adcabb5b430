"""Queries of index keeping, evaluation, conversations and agents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam import providers
from lodeseam.functions import text
from lodeseam.operators import agent, conversation, evaluate, maintenance
from lodeseam.operators.retrieval import top_k
from lodeseam.plans.retrieval_queries import EMB, observations
from lodeseam.plans.text_queries import IX, QA, TRIM, WORDS, _index, _qa
from lodeseam.session import table

QUERIES, SQL = {}, {}
SIGNATURE = "local_minnow-64_unpin"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    "select doc_id, doc_hash from (select doc_id, sha256(coalesce(text, '')) doc_hash, row_number() over (partition by sha256(coalesce(text, '')) order by doc_id) n from documents) "
    "where n = 1 and doc_hash not in (select sha256(content) from doc_index where content is not null)"
)
def dedup_insert(spark, d):
    """The corpus inserted into the index: what is not there yet, once."""
    existing = table(spark, d, "doc_index").where("content is not null").select(text.doc_hash(F.col("content")).alias("doc_hash"))
    return maintenance.new_rows(table(spark, d, "documents").select("doc_id", "text"), existing, "text", "doc_id").select("doc_id", "doc_hash")


_FILES = "(select source filename, max(file_hash) file_hash from doc_index group by 1)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_index").groupBy(F.col("source").alias("filename")).agg(F.max("file_hash").alias("file_hash"))


@query(
    f"select coalesce(f.filename, r.filename) filename, case when r.filename is null then 'new' when f.filename is null then 'deleted' when coalesce(f.file_hash <> r.file_hash, true) then 'content_changed' "
    f"when embed_model is distinct from '{SIGNATURE}' then 'model_changed' else 'unchanged' end state from {_FILES} f full join indexed_files r on f.filename = r.filename"
)
def cdc_status(spark, d):
    return maintenance.file_states(_files(spark, d), table(spark, d, "indexed_files"), SIGNATURE)


@query(f"select coalesce(f.filename, r.filename) filename, case when f.filename is not null then f.file_hash else r.file_hash end file_hash, case when f.filename is not null then 'new_model' else embed_model end embed_model from {_FILES} f full join indexed_files r on f.filename = r.filename")
def registry_upsert(spark, d):
    return maintenance.upsert_registry(table(spark, d, "indexed_files"), _files(spark, d), "new_model")


@query("select id, source from (select distinct id, source from doc_index) where regexp_extract(source, '[^/]*$') not in (select regexp_extract(filename, '[^/]*$') from purge_log where filename is not null)")
def purge(spark, d):
    return maintenance.purge_files(_index(spark, d, "source"), table(spark, d, "purge_log").where("filename is not null"))


@query("select distinct id from doc_index where level = 1 and media_type <> 'image' and id not in (select parent_id from doc_index where level = 0 and parent_id is not null)")
def unenriched_chunks(spark, d):
    return maintenance.unenriched(_index(spark, d, "level", "media_type", "parent_id")).select("id")


@query("select distinct id, level from doc_index where level is null or level < 2")
def raptor_reset(spark, d):
    return maintenance.without_summaries(_index(spark, d, "level"))


@query(f"select q.id, q.chunk_id from {QA} q where chunk_id in (select id from doc_index)")
def qa_cascade(spark, d):
    return _qa(spark, d).join(table(spark, d, "doc_index").select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select("id", "chunk_id")


@query("select count(distinct id) n_rows, count(distinct case when level = 2 then id end) n_level2, count(distinct source) n_sources from doc_index")
def index_stats(spark, d):
    return table(spark, d, "doc_index").agg(F.count_distinct("id").alias("n_rows"), F.count_distinct(F.when(F.col("level") == 2, F.col("id"))).alias("n_level2"), F.count_distinct("source").alias("n_sources"))


@query("select distinct id, level from doc_index where level = 1 and embedding is not null and media_type <> 'image'")
def cluster_scan(spark, d):
    return table(spark, d, "doc_index").where("level = 1 and embedding is not null and media_type <> 'image'").select("id", "level").distinct()


@query(
    f"with c as (select id, regexp_extract(source, '^(.*)/', 1) k, content from {IX.format('source, content, level')} where level = 1), r as (select *, row_number() over (partition by k order by id) r, count(*) over (partition by k) n from c) "
    "select k as \"cluster\", n, '[Cluster Summary — ' || n || ' chunks]' || chr(10) || string_agg(substring(content, 1, 600), chr(10) || chr(10) order by r) summary from r where n >= 2 and r <= 8 group by k, n"
)
def raptor_summaries(spark, d):
    c = _index(spark, d, "source", "content", "level").where("level = 1").select("id", F.regexp_extract("source", "^(.*)/", 1).alias("k"), "content")
    return maintenance.cluster_summaries(c, "k")


@query()
def raptor_clusters(spark, d):
    """Soft clusters of the chunk vectors: reduced by principal components, the number of components by BIC."""
    from lodeseam.operators.cluster import cluster_vectors

    v = table(spark, d, "doc_index").where("level = 1 and embedding_valid and size(embedding) = 64").select("id", F.col("embedding").cast("array<double>").alias("v")).dropDuplicates(["id"])
    return cluster_vectors(v.where(F.forall("v", lambda x: (~F.isnan(x)) & (F.abs(x) < float("inf")))))


@query(
    f"with c as (select id, content, case when length(content) < 20 then [content] else list_filter(list_transform(string_split(regexp_replace(content, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')}), lambda x: x <> '') end p from {IX.format('content, level')} where level = 1) "
    "select id parent_id, unnest(p) content, sha256(id || '_' || unnest(p)) doc_hash from c"
)
def propositions(spark, d):
    return maintenance.propositions(_index(spark, d, "content", "level").where("level = 1").select("id", "content")).select("parent_id", "content", "doc_hash")


@query("select id, embedding is not null and embedding_valid valid, case when embedding is not null and embedding_valid then len(embedding) else 64 end::int n from (select distinct id, embedding, embedding_valid from doc_index)")
def embedding_mask(spark, d):
    ix = table(spark, d, "doc_index")
    v, ok = providers.mask_failures(F.when(F.col("embedding_valid"), F.col("embedding").cast("array<double>")), F.lit("text"))
    return ix.select("id", ok.alias("valid"), F.size(v).alias("n")).distinct()


@query(
    f"with e as {EMB.format(w=WORDS.format('content'), t=IX.format('content'))}, s as (select id, source from (select distinct id, source, content from doc_index)), n as (select source, count(*) n from s group by 1) "
    "select source, dim, round(sum(w) / n, 5) w from e join s using (id) join n using (source) group by source, dim, n having abs(round(sum(w) / n, 5)) > 0"
)
def source_vectors(spark, d):
    """The mean vector of every source, by partial sums per dimension."""
    e = _index(spark, d, "source", "content")
    n = e.groupBy("source").agg(F.count("*").alias("n"))
    s = e.select("source", F.posexplode(providers.embed(F.col("content"))).alias("dim", "w")).groupBy("source", "dim").agg(F.sum("w").alias("w"))
    return s.join(n, "source").select("source", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("w") / F.col("n"), 5).alias("w")).where("w <> 0")


# --- evaluation ------------------------------------------------------------------------------------------------

# through text, as statistics of Parquet files that leave NaN out mislead isnan
_S = "case when {0} is null or {0}::varchar = 'nan' then 0.0 else greatest(0.0, least(1.0, {0})) end"
_EV = "(select distinct * from eval_results)"


def _evals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_results").distinct()


@query(f"select id, round(({_S.format('faithfulness')} + {_S.format('answer_relevance')} + {_S.format('context_recall')}) / 3, 2)::double overall from {_EV}")
def ragas_overall(spark, d):
    return _evals(spark, d).select("id", evaluate.overall(*[evaluate.score(F.col(c)) for c in ("faithfulness", "answer_relevance", "context_recall")]).alias("overall"))


_ORDER = [F.asc_nulls_last, F.col]
_CHECKED = f"case when {_S.format('faithfulness')} = 0 then 1.0 else {_S.format('faithfulness')} end::double"
_ROLL = f"select id, round(avg({_CHECKED}) over (order by evaluated_at nulls last, id rows between 9 preceding and current row), 6) mean, row_number() over (order by evaluated_at nulls last, id) - 1 pos from {_EV}"


def _checked(spark, d):
    """A score of 0 counts as 1 in the gate, as it does in what this engine has to equal."""
    s = evaluate.score(F.col("faithfulness"))
    return _evals(spark, d).select("id", "evaluated_at", F.when(s == 0, 1.0).otherwise(s).alias("f")), [F.asc_nulls_last("evaluated_at"), F.asc("id")]


@query(_ROLL)
def rolling_quality(spark, d):
    e, order = _checked(spark, d)
    return evaluate.rolling_mean(e, "f", order).select("id", "mean", "pos")


@query(
    f"with r as ({_ROLL}) select id, pos, coalesce(last_value(case when mean < 0.5 then true when mean > 0.7 then false end ignore nulls) over (order by pos rows between unbounded preceding and current row), false) degraded from r"
)
def quality_gate(spark, d):
    e, order = _checked(spark, d)
    return evaluate.quality_gate(e, "f", order).select("id", "pos", "degraded")


@query(f"select coalesce(strftime(evaluated_at, '%Y-%m'), 'none') as \"month\", count(*) n, round(avg({_S.format('faithfulness')}), 6)::double mean, round(stddev_pop({_S.format('faithfulness')}), 6)::double std from {_EV} group by 1")
def score_stats(spark, d):
    s = evaluate.score(F.col("faithfulness"))
    month = F.coalesce(F.substring(F.col("evaluated_at").cast("string"), 1, 7), F.lit("none"))
    return _evals(spark, d).groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("std"))


@query()
def bootstrap_ci(spark, d):
    """The interval of the mean over all stored scores."""
    return evaluate.interval(_evals(spark, d).select(evaluate.score(F.col("faithfulness")).alias("f")), "f")


@query(f"select id, question from {QA} order by sha256(id || '-42'), id limit 50")
def sample_n(spark, d):
    return _qa(spark, d).select("id", "question").orderBy(F.sha2(F.concat(F.col("id").cast("string"), F.lit("-42")), 256), "id").limit(50)


@query("select distinct id from doc_index where level = 1 and media_type <> 'image' order by id limit 10")
def first_chunks(spark, d):
    return table(spark, d, "doc_index").where("level = 1 and media_type <> 'image'").select("id").distinct().orderBy("id").limit(10)


# --- conversations ---------------------------------------------------------------------------------------------

_CONV = f"(select chunk_id conv_id, id * 3 + k turn, case k when 0 then 'system' when 1 then 'user' else 'assistant' end role, case k when 0 then 'Be exact.' when 1 then question else answer end content from {QA}, range(0, 3) t(k) where chunk_id is not null)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of each chunk as one conversation: a rule, a question and an answer by turns."""
    q = _qa(spark, d).where("chunk_id is not null")
    three = F.array(F.struct(F.lit("system").alias("role"), F.lit("Be exact.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return q.select(F.col("chunk_id").alias("conv_id"), "id", F.posexplode(three).alias("k", "m")).select("conv_id", (F.col("id") * 3 + F.col("k")).alias("turn"), "m.role", "m.content")


@query(f"select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) r from {_CONV}) where r <= 4")
def history_tail(spark, d):
    return conversation.tail(_messages(spark, d), 4).select("conv_id", "turn", "role")


@query(f"select conv_id, turn, upper(role[1]) || role[2:] || ': ' || substring(coalesce(content, ''), 1, 300) line from (select *, row_number() over (partition by conv_id order by turn desc) r from {_CONV}) where r > 8")
def memory_evicted(spark, d):
    return conversation.evicted(_messages(spark, d))


@query(
    f"with c as {_CONV}, p as (select conv_id, sum(length(coalesce(content, '')) // 4 + 4) n, max(case when role = 'user' then turn end) last from c group by 1) "
    f"select conv_id, turn, case when n > 100 and turn = last then substring(coalesce(content, ''), 1, (greatest(1, length(coalesce(content, '')) // 4 - (n - 100) - 10) * 4)::bigint) || chr(10) || '[...truncated for length...]' else content end content from c join p using (conv_id)"
)
def message_truncate(spark, d):
    return conversation.truncate(_messages(spark, d), most=100).select("conv_id", "turn", "content")


@query(
    f"with c as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn desc) g from {_CONV}), s as (select conv_id, g, max(turn) t, string_agg(content, chr(10) || chr(10) order by turn) r from c where role = 'system' group by 1, 2) "
    "select conv_id, turn, case when role = 'user' then 'user' else 'model' end role, case when role = 'user' and r is not null then '[SYSTEM INSTRUCTIONS]' || chr(10) || r || chr(10) || '[END SYSTEM INSTRUCTIONS]' || chr(10) || chr(10) || content else content end content from c left join s using (conv_id, g) where role <> 'system' "
    "union all select conv_id, t, 'user', '[SYSTEM INSTRUCTIONS]' || chr(10) || r || chr(10) || '[END SYSTEM INSTRUCTIONS]' from s where g = 0"
)
def fold_system(spark, d):
    return conversation.fold_system(_messages(spark, d))


@query(
    f"select q.id, 'Context:' || chr(10) || '<DOCUMENT index=\"1\" source=\"' || regexp_extract(source, '[^/]*$') || '\">' || substring(content, 1, 1500) || '</DOCUMENT>' || chr(10) || chr(10) || 'Sources referenced:' || chr(10) || source || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) "
    f"|| 'Instructions:' || chr(10) || '1. Use the context only.' || chr(10) || '2. State no more than it says.' || chr(10) || '3. Name the source of every claim.' || chr(10) prompt from {QA} q join {IX.format('source, content')} i on q.chunk_id = i.id"
)
def prompt_build(spark, d):
    both = _qa(spark, d).join(_index(spark, d, "source", "content").withColumnRenamed("id", "chunk_id"), "chunk_id")
    block = conversation.document_block(F.lit(1), text.basename(F.col("source")), F.col("content"), 1500)
    return both.select("id", conversation.answer_prompt(F.col("question"), block, F.col("source"), F.lit("State no more than it says."), F.lit("")).alias("prompt"))


# --- grading, checking, agents -----------------------------------------------------------------------------------


@query(
    f"with q as (select q.id, list_distinct({WORDS.format('question')}) w, {WORDS.format('content')} c, content from {QA} q join {IX.format('content')} i on q.chunk_id = i.id) "
    "select id, case when content = '' then 'IRRELEVANT' when len(list_intersect(w, c)) / len(w) >= 0.8 then 'EXACT' when len(list_intersect(w, c)) / len(w) >= 0.3 then 'AMBIGUOUS' else 'IRRELEVANT' end grade from q"
)
def crag_grade(spark, d):
    both = _qa(spark, d).join(_index(spark, d, "content").withColumnRenamed("id", "chunk_id"), "chunk_id")
    return both.select("id", agent.grade(F.col("question"), F.col("content")).alias("grade"))


_SENTS = r"(select id * 1000 + generate_subscripts(s, 1) id, id qa_id, chunk_id, generate_subscripts(s, 1) no, unnest(s) t from (select id, chunk_id, string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) s from " + QA + " where answer is not null and chunk_id is not null))"


@query(
    f"with s as {_SENTS}, ix as {IX.format('content, parent_id')}, se as {EMB.format(w=WORDS.format('t'), t='s')}, ce as {EMB.format(w=WORDS.format('content'), t='ix')}, "
    "k as (select id chunk_id, id other from ix union select a.id, b.id from ix a join ix b on a.parent_id = b.id), mm as (select s.id, k.other, round(sum(se.w * ce.w), 6) sim from s join se using (id) join k on k.chunk_id = s.chunk_id join ce on ce.id = k.other and ce.dim = se.dim group by 1, 2), m as (select id, max(sim) sim from mm group by 1) "
    f"select qa_id, no, case when length(trim(t)) < 15 or lower(trim(t)) in {agent.CONNECTIVES!r} or coalesce(sim, 0) >= 0.75 then t else '[Unverified] ' || trim(t) end sentence from s left join m using (id) where chunk_id in (select id from doc_index)"
)
def cite_enforce(spark, d):
    q = _qa(spark, d).where("answer is not null and chunk_id is not null")
    s = q.select(F.col("id").alias("qa_id"), "chunk_id", F.posexplode(F.split("answer", r"(?<=[.!?])\s+")).alias("no", "t"))
    # a sentence is compared with the chunk asked about and with the row above it; the best counts
    rows = _index(spark, d, "content", "parent_id")
    c = rows.select("id", providers.embed(F.col("content")).alias("cv"))
    up = rows.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct(F.array_compact(F.array("id", "parent_id")))).alias("id"))
    both = s.withColumn("sv", providers.embed(F.col("t"))).join(up, "chunk_id").join(c, "id")
    dot = F.round(F.aggregate(F.zip_with("sv", "cv", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda x, y: x + y), 6)
    best = both.groupBy("qa_id", "no", "t").agg(F.max(dot).alias("dot"))
    return best.select("qa_id", (F.col("no") + 1).cast("bigint").alias("no"), agent.mark_unverified(F.col("t"), F.col("dot")).alias("sentence"))


@query(f"select q.id, contains(lower(answer), lower(regexp_extract(source, '[^/]*$'))) mentioned from {QA} q join {IX.format('source')} i on q.chunk_id = i.id where answer is not null")
def source_mentioned(spark, d):
    both = _qa(spark, d).where("answer is not null").join(_index(spark, d, "source").withColumnRenamed("id", "chunk_id"), "chunk_id")
    return both.select("id", F.contains(F.lower("answer"), F.lower(text.basename(F.col("source")))).alias("mentioned"))


def _search(spark: SparkSession, d: str):
    """The agent's tool: whatever text is asked, the three best hits as one observation."""
    return lambda asked: observations(spark, d, asked)


@query()
def react_trajectory(spark, d):
    """Two searches at most: for the question, then for the text that its first observation begins with."""
    q = _qa(spark, d).where("id % 100 = 0 and question is not null").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    out = agent.run_react(q, _search(spark, d), agent.ScriptedReasoner(hops=2))
    return out.select("query_id", "answer", F.size("steps").alias("n_steps"))


@query()
def ircot_trajectory(spark, d):
    q = _qa(spark, d).where("id % 100 = 0 and question is not null").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return agent.run_ircot(q, _search(spark, d))


@query(
    f"select q.id question_id, ((q.id + 7) * 2)::varchar || coalesce(chr(10) || chr(10) || substring(i.content, 1, 200), '') answer from {QA} q left join {IX.format('content')} i on q.chunk_id = i.id and length(trim(i.content)) > 20 and regexp_matches(i.content, '^The ') where question is not null"
)
def plan_execute(spark, d):
    """Plans of two steps per question: a calculation, and a row to be looked up by its number, of which texts that begin with "The " are shown."""
    steps = F.array(F.concat(F.lit("please calculate ("), F.col("id").cast("string"), F.lit(" + 7) * 2")), F.concat(F.lit("row "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("none"))))
    plans = _qa(spark, d).where("question is not null").select(F.col("id").alias("question_id"), steps.alias("steps"))
    rows = _index(spark, d, "content").where((F.length(F.trim("content")) > 20) & F.col("content").startswith("The "))
    rows = rows.select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("query"), F.substring("content", 1, 200).alias("observation"))
    return agent.plan_execute(plans, lambda asked: asked.join(rows, "query", "left").select("query_id", "observation"))


@query(f"select id, n from (select chunk_id, id, row_number() over (partition by chunk_id order by id) n from {QA} where chunk_id is not null) where n <= 3")
def questions_per_chunk(spark, d):
    q = _qa(spark, d).where("chunk_id is not null").select("chunk_id", "id")
    return top_k(q, "chunk_id", [F.col("id")], 3, "n").select("id", F.col("n").cast("bigint").alias("n"))
