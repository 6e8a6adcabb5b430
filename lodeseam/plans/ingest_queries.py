"""Queries of sources and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseam.operators import chunk
from lodeseam.plans.text_queries import IX, TRIM, _index
from lodeseam.session import table
from lodeseam.sources import files, html

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


DOCS = "(select doc_id, text from documents where text is not null)"
_NW = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_UP = "(upper({0}) = {0} and lower({0}) <> {0})"
_HEAD = f"(({_UP.format('line')} and length(line) > 2 and {_NW.format('line')} <= 8) or ({_NW.format('line')} <= 5 and {_UP.format('line[1]')} and not regexp_matches(line, '[.,:;?!]$') and not regexp_matches(line, '\\d')))"
_SHORT = f"({_UP.format('line')} or ({_NW.format('line')} <= 4 and {_UP.format('line[1]')}))"


def _sections_sql(rule: str) -> str:
    strip = TRIM.format("unnest(string_split(content, chr(10)))")
    return (
        f"with l as (select id, {strip} line, generate_subscripts(string_split(content, chr(10)), 1) pos from {IX.format('content')}), "
        f"f as (select *, {rule} h from l where line <> ''), g as (select *, sum(h::int) over (partition by id order by pos) g from f) "
        "select id, coalesce(max(case when h then line end), 'General') heading, string_agg(case when not h then line end, ' ' order by pos) body from g group by id, g having count(*) filter (not h) > 0"
    )


@query(_sections_sql(_HEAD))
def sections(spark, d):
    return _index(spark, d, "content").select("id", F.inline(chunk.sections(F.col("content"))))


@query(_sections_sql(_SHORT))
def legacy_sections(spark, d):
    return _index(spark, d, "content").select("id", F.inline(chunk.sections(F.col("content"), chunk.is_short_heading)))


_SENT = r"string_split(regexp_replace({}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"
_INIT = "{o: []::varchar[], c: ''}"


def _fold(col: str, fits: str, longer: str, done: str, fresh: str) -> str:
    parts = f"list_transform({_SENT.format(col)}, lambda s: {{o: []::varchar[], c: s}})"
    return f"list_reduce({parts}, lambda a, x: case when {fits} then {{o: a.o, c: {longer}}} else {{o: {done}, c: {fresh}}} end, {_INIT})"


_JOINED = TRIM.format("(a.c || ' ' || x.c)")
_PARENTS = f"case when {TRIM.format('r.c')} <> '' then r.o || [{TRIM.format('r.c')}] else r.o end"
_PACK = _fold("text", f"length({_JOINED}) // 4 <= 1500", _JOINED, f"case when {TRIM.format('a.c')} <> '' then a.o || [{TRIM.format('a.c')}] else a.o end", "x.c")


@query(f"select doc_id, generate_subscripts(p, 1) - 1 parent_no, unnest(p) parent from (select doc_id, {_PARENTS} p from (select doc_id, {_PACK} r from {DOCS}))")
def parent_pack(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunk.pack_parents(F.col("text"))).alias("parent_no", "parent")).withColumn("parent_no", F.col("parent_no").cast("bigint"))


@query(
    f"with p as (select doc_id, unnest(p) parent, generate_subscripts(p, 1) - 1 parent_no from (select doc_id, {_PARENTS} p from (select doc_id, {_PACK} r from {DOCS}))), "
    f"w as (select doc_id, parent_no, unnest(range(0, length(parent), 1948)) s, parent from p), c as (select doc_id, parent_no, s, {TRIM.format('substring(parent, s + 1, 2048)')} child from w) "
    "select doc_id, parent_no, row_number() over (partition by doc_id order by parent_no, s) - 1 child_id, child from c where child <> ''"
)
def parent_child(spark, d):
    return chunk.parent_child(_docs(spark, d), "text").select("doc_id", F.col("parent_no").cast("bigint").alias("parent_no"), F.col("child_id").cast("bigint").alias("child_id"), "child")


@query(f"select doc_id, generate_subscripts(range(0, length(text), 1948), 1) - 1 no, substring(text, unnest(range(0, length(text), 1948)) + 1, 2048) piece from {DOCS}")
def child_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunk.windows(F.col("text"), 2048, 100)).alias("no", "piece")).withColumn("no", F.col("no").cast("bigint"))


_FLAT = _fold("text", "length(a.c) + length(x.c) <= 800", "a.c || ' ' || x.c", f"a.o || [{TRIM.format('a.c')}]", "right(a.c, 150) || ' ' || x.c")
_ENDS = f"case when r.c <> '' then r.o || [{TRIM.format('r.c')}] else r.o end"


@query(f"select doc_id, generate_subscripts(p, 1) - 1 no, unnest(p) chunk from (select doc_id, {_ENDS} p from (select doc_id, {_FLAT} r from {DOCS}))")
def flat_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunk.flat_chunks(F.col("text"))).alias("no", "chunk")).withColumn("no", F.col("no").cast("bigint"))


_OLD = _fold("text", "length(a.c) + length(x.c) <= 1500", "a.c || ' ' || x.c", f"a.o || [{TRIM.format('a.c')}]", "x.c")


@query(
    f"with p as (select doc_id, unnest(p) parent, generate_subscripts(p, 1) - 1 parent_no from (select doc_id, {_ENDS} p from (select doc_id, {_OLD} r from {DOCS}))), "
    "w as (select doc_id, parent_no, unnest(range(0, length(parent), 300)) s, parent from p) select doc_id, parent_no, s, substring(parent, s + 1, 400) child from w"
)
def legacy_parent_child(spark, d):
    parents = _docs(spark, d).select("doc_id", F.posexplode(chunk.pack_parents_by_chars(F.col("text"))).alias("parent_no", "p"))
    out = parents.select("doc_id", F.col("parent_no").cast("bigint").alias("parent_no"), F.posexplode(chunk.windows(F.col("p"), 400, 100)).alias("i", "child"))
    return out.select("doc_id", "parent_no", (F.col("i").cast("bigint") * 300).alias("s"), "child")


_LINES = f"list_filter(regexp_split_to_array({TRIM.format('content')}, '\\r\\n|\\n|\\r'), lambda x: {TRIM.format('x')} <> '')"


@query(
    f"with t as (select id, content, {_LINES} l from {IX.format('content, doc_type')} where lower(doc_type) = 'table'), "
    "u as (select *, l[1] header, case when regexp_matches(coalesce(l[2], ''), '^\\|[\\s\\-|]+\\|$') then l[3:] else l[2:] end rows from t), "
    "g as (select *, case when length(content) // 4 <= 100 or len(rows) = 0 then [content] else list_transform(range(0, len(rows), 15), "
    "lambda i: header || chr(10) || '|' || repeat(' --- |', len(string_split(header, '|'))) || chr(10) || array_to_string(rows[i + 1:i + 15], chr(10))) end c from u) "
    "select id, generate_subscripts(c, 1) - 1 no, unnest(c) chunk, header from g"
)
def table_chunks(spark, d):
    t = _index(spark, d, "content", "doc_type").where(F.lower("doc_type") == "table")
    c = t.select("id", F.posexplode(chunk.table_chunks(F.col("content"), atomic_tokens=100)).alias("no", "c"))
    return c.select("id", F.col("no").cast("bigint").alias("no"), F.col("c.text").alias("chunk"), "c.header")


def _rendered(*cols: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when {c} is not null then '{c}: ' || {c}::varchar end" for c in cols) + ")"


@query(f"select n_nationkey key, {_rendered('n_nationkey', 'n_name', 'n_regionkey')} row_text from nation")
def tabular_nation(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return files.render_rows(t).select(F.col("n_nationkey").alias("key"), "row_text")


@query(f"select p_partkey key, {_rendered('p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size')} row_text from part")
def tabular_part(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return files.render_rows(t).select(F.col("p_partkey").alias("key"), "row_text")


@query("select id, '| item | page |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' | ' || coalesce(page::varchar, '') || ' |' md from " + IX.format("source, page"))
def markdown_tables(spark, d):
    rows = F.array(F.array(F.lit("item"), F.lit(" page ")), F.array(F.col("source"), F.col("page").cast("string")))
    return _index(spark, d, "source", "page").select("id", files.markdown_table(rows).alias("md"))


_PAGE = "'<html><head><style>p { x }</style><script>if (a < b) c()</script></head><body><!-- note --><p>' || replace(text, '. ', '.</p><p>') || '&amp;&nbsp;&lt;b&gt;</p></body></html>'"


def _undo(x: str) -> str:
    for entity, to in html.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{to.replace(chr(39), chr(39) * 2)}')"
    return x


@query(
    f"with p as (select doc_id, {_PAGE} h from {DOCS}) select doc_id, "
    + TRIM.format("regexp_replace(" + _undo(r"regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')") + r", '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')")
    + " visible from p"
)
def html_text(spark, d):
    page = F.concat(
        F.lit("<html><head><style>p { x }</style><script>if (a < b) c()</script></head><body><!-- note --><p>"), F.replace(F.col("text"), F.lit(". "), F.lit(".</p><p>")), F.lit("&amp;&nbsp;&lt;b&gt;</p></body></html>")
    )
    return _docs(spark, d).select("doc_id", html.visible_text(page).alias("visible"))


_ROUTES = "case lower(regexp_extract(source, '\\.([^./]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in files.READERS.items()) + " else 'unstructured' end"


@query(f"select {_ROUTES} reader, count(*) n_files from (select distinct source from doc_index) group by 1")
def ext_router(spark, d):
    t = table(spark, d, "doc_index").select("source").distinct()
    return t.groupBy(files.route(F.col("source")).alias("reader")).agg(F.count("*").alias("n_files"))
